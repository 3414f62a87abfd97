"""Streaming twins: live merging, bouts, chunk counts and matching.

Streams have ``ts`` (timestamp), ``t0_us`` and ``t1_us``; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 minute"


def with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("t0_us"))


def _gap(extra_us: int = 0):
    """An interval of a row's length and a bit more, as text."""
    return F.concat((F.col("t1_us") - F.col("t0_us") + extra_us).cast("string"), F.lit(" microseconds"))


def live_merge(stream: DataFrame, by: list[str], late: str = LATE) -> DataFrame:
    """Merged events as sessions of interval length; points are dropped, which matching ignores too."""
    rows = stream.where("t1_us > t0_us").withWatermark("ts", late)
    out = rows.groupBy(*by, F.session_window("ts", _gap()).alias("w")).agg(F.count(F.lit(1)).alias("n_boxes"))
    return out.select(*by, F.unix_micros("w.start").alias("t0_us"), F.unix_micros("w.end").alias("t1_us"), "n_boxes")


def live_bouts(stream: DataFrame, by: list[str], gap_us: int, late: str = LATE) -> DataFrame:
    """Bouts of calls that don't overlap: a gap of at most ``gap_us`` stays within a bout."""
    rows = stream.where("t1_us > t0_us").withWatermark("ts", late)
    out = rows.groupBy(*by, F.session_window("ts", _gap(gap_us)).alias("w")).agg(F.count(F.lit(1)).alias("n_calls"), F.max("t1_us").alias("t1_us"))
    return out.select(*by, F.unix_micros("w.start").alias("t0_us"), "t1_us", "n_calls")


def live_counts(stream: DataFrame, by: list[str], width: str = "1 second", late: str = LATE) -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(*by, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.unix_micros("w.start").alias("t0_us"), "n")


def live_matches(gt: DataFrame, pred: DataFrame, by: list[str], longest: str = "2 minutes", late: str = LATE) -> DataFrame:
    """Overlapping (call, detection) pairs; both watermarks and the longest interval bound the state."""
    g = gt.withWatermark("ts", late).select(*(F.col(c).alias(f"g_{c}") for c in gt.columns))
    p = pred.withWatermark("ts", late).select(*(F.col(c).alias(f"p_{c}") for c in pred.columns))
    same = [F.col(f"g_{c}") == F.col(f"p_{c}") for c in by]
    near = (F.col("p_ts") >= F.col("g_ts") - F.expr(f"interval {longest}")) & (F.col("p_ts") <= F.col("g_ts") + F.expr(f"interval {longest}"))
    hit = (F.col("p_t0_us") < F.col("g_t1_us")) & (F.col("p_t1_us") > F.col("g_t0_us")) & (F.col("g_t1_us") > F.col("g_t0_us")) & (F.col("p_t1_us") > F.col("p_t0_us"))
    return g.join(p, [*same, near, hit])
