"""Scans along time lines in two levels, so that no task holds a whole line.

Rows are dealt over buckets of their line (``__line``: the line's columns and the bucket, one struct,
so that NULL keys meet). What a scan needs from the buckets before or after comes from a table of one
row for each bucket in use: aggregates of the bucket, carried along the line. Rows and carried state
meet by bucket; windows over ``__line`` then need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = "__line"
#: Rows of a bucket before a row, and with it.
EARLIER = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, 0)


def on_lines(df: DataFrame, by: list[str], at: Column, bucket: int) -> DataFrame:
    """``df`` with ``__line``: its time line and the bucket of ``at``."""
    return df.withColumn(LINE, F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.floor(at / bucket).alias("bucket")))


def carried(rows: DataFrame, summary: dict[str, Column], carry: dict[str, Callable]) -> DataFrame:
    """``rows`` with the columns of ``carry``, each made over the buckets of a line.

    ``summary`` aggregates a bucket's rows; a ``carry`` gets the windows of the buckets before and of
    those after, and combines summaries over one of them.
    """
    per = rows.groupBy(LINE).agg(*(c.alias(n) for n, c in summary.items()))
    keys = [f"{LINE}.{f.name}" for f in rows.schema[LINE].dataType.fields[:-1]]
    line = Window.partitionBy(*keys).orderBy(f"{LINE}.bucket")
    before, after = line.rowsBetween(*EARLIER), line.rowsBetween(1, Window.unboundedFollowing)
    return rows.join(per.select(LINE, *(f(before, after).alias(n) for n, f in carry.items())), LINE)


def in_bucket(*order, frame=None):
    """The window of a bucket's rows in an order, by default without a frame."""
    w = Window.partitionBy(LINE).orderBy(*order)
    return w if frame is None else w.rowsBetween(*frame)


def running_count(rows: DataFrame, flag: str, name: str, order: list) -> DataFrame:
    """``rows`` with the number of true ``flag`` s along the whole line up to each row."""
    n = F.col(flag).cast("long")
    out = carried(rows, {"__n": F.sum(n)}, {"__base": lambda before, after: F.coalesce(F.sum("__n").over(before), F.lit(0))})
    return out.withColumn(name, F.col("__base") + F.sum(n).over(in_bucket(*order, frame=UPTO))).drop("__base")
