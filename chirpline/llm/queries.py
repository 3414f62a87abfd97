"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this package
QUERIES = {
    "op1_token_id_files": "token_files",
    "op2_decontamination": "decontaminate",
    "op3_html_main_text": "extract",
    "op4_secret_scan": "secrets",
    "op5_jaccard_join": "neardup",
    "op6_neighbour_quality": "quality",
    "op7_prefix_token_counts": "token_counts",
    "op8_hamming_top_k": "hamming",
    "op9_poisson_mixing": "mixing",
    "op10_perspective_rotation": "chat",
    "op11_periodic_runs": "periodic",
    "op12_toxicity": "toxicity",
    "op13_embedding_whitening": "whitening",
}
#: query -> name of its SQL in the module
SQL = {"op2_decontamination": "OP2_SQL", "op5_jaccard_join": "OP5_SQL", "op8_hamming_top_k": "OP8_SQL", "op9_poisson_mixing": "OP9_SQL", "op10_perspective_rotation": "OP10_SQL"}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{QUERIES[name]}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{QUERIES[name]}"), sql) for name, sql in SQL.items()}
