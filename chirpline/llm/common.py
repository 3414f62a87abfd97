"""Helpers shared by the training-data operators: tables, lineage cuts, Arrow tasks, column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.sources.shared import cut, drop_cut, shared_dir

from .workers import tidy

__all__ = ["bound_batches", "cut", "drop_cut", "map_arrow", "own_columns", "shared_dir", "table", "text_bytes"]

#: Rows and bytes of an Arrow batch at most (one row may be larger).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit("").cast("binary"))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ``BATCH``; lower ones stay."""
    for key, most in BATCH.items():
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0) if not spark.conf.get(key).startswith("-") else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded size, by workers that give their memory back after a task."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def own_columns(df: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under made names that clash with nothing, and the own name of each."""
    made = {f"{prefix}{i}": c for i, c in enumerate(df.columns)}
    return df.toDF(*made), made
