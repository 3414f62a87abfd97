"""Connected components by rounds of the least label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.sources.shared import cut, drop_cut


def components(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, id, label: the least id that the edges (by, a, b) of a group reach from each node (by, id).

    Each round takes the least label among the neighbours, then the label of that label, so the number
    of rounds grows with the logarithm of the longest path.
    """
    both = cut(edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    now = cut(nodes.select(*by, "id", F.col("id").alias("label"), F.col("id").alias("old")), "labels")
    while True:
        near = both.join(now.select(*by, F.col("id").alias("b"), "label"), [*by, "b"]).groupBy(*by, F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = now.join(near, [*by, "id"], "left").select(*by, "id", F.least("label", F.coalesce("near", "label")).alias("to"), F.col("label").alias("old"))
        jump = now.select(*by, F.col("id").alias("to"), F.col("label").alias("beyond"))
        new = cut(step.join(jump, [*by, "to"], "left").select(*by, "id", F.least("to", F.coalesce("beyond", "to")).alias("label"), "old"), "labels")
        drop_cut(now)
        now = new
        if new.where("label < old").isEmpty():
            break
    drop_cut(both)
    return now.drop("old")
