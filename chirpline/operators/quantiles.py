"""Ranks and exact quantiles of groups of any size: no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(cells: DataFrame, by: list[str], value: str, counts: list[str]) -> DataFrame:
    """``cells`` (a row per group and value) with under_<c> and all_<c> for each count.

    ``under_`` is the group's sum of the count at lower values, ``all_`` its sum. Values are dealt by
    range; sums within a range are added to those of the ranges before, a row per group and range.
    """
    ranged = cells.repartitionByRange(*by, value).withColumn("__range", F.spark_partition_id())
    sums = ranged.groupBy(*by, "__range").agg(*(F.sum(c).alias(c) for c in counts))
    group = Window.partitionBy(*by)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"__{c}") for c in (*by, "__range")]
    bases = sums.select(*named, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__base_{c}") for c in counts), *(F.sum(c).over(group).alias(f"all_{c}") for c in counts))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "__range")]
    out = placed.join(bases, same).withColumns({f"under_{c}": F.col(f"__base_{c}") + F.col(f"__in_{c}") for c in counts})
    return out.select(*cells.columns, *(f"under_{c}" for c in counts), *(f"all_{c}" for c in counts))


def quantile(value: str, q: float, count: str = "n") -> Column:
    """Aggregate over :func:`ranked` rows: the exact, linearly interpolated quantile."""
    at = F.lit(q) * (F.max(f"all_{count}") - 1)

    def ranked_at(rank) -> Column:  # the value that holds a rank, from 0
        place = rank(F.lit(q) * (F.col(f"all_{count}") - 1))
        return F.min(F.when(F.col(f"under_{count}") + F.col(count) > place, F.col(value)))

    low, high = ranked_at(F.floor), ranked_at(F.ceil)
    return low + (at - F.floor(at)) * (high - low)


def quantiles(df: DataFrame, by: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """by and a column for each named quantile of the values that aren't NULL."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("n"))
    rows = ranked(cells, by, "__value", ["n"])
    return rows.groupBy(*by).agg(*(quantile("__value", q).alias(name) for name, q in named.items()))
