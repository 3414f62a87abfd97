"""Operator 9: mix sources to target weights by Poisson replication.

A source with ``n`` documents and target share ``w`` of ``total`` output documents has the mean
repetition rate ``w * total / n``. Each document draws its number of copies by inverting the
Poisson distribution of that rate at a number in [0, 1) hashed from the seed and the doc_id, so
the draw is the same on every run and every partitioning. The copies are then shuffled globally
by a hash of seed, doc_id and copy. All of it is DataFrame work: one counting pass, a join with a
table of a row per source, one shuffle of the copies.

Nulls: a null source is a source of its own; null doc_ids draw as the text "null". Rows that
repeat a doc_id draw alike. Sources without a given weight get weight 0 and no copies. An empty
table gives an empty result. :func:`mix_sources` replaces columns named as those it makes,
:func:`resample` returns the documents' own columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, own_columns, table

SEED = 20
#: Share of a source in the target, from its count n: n ** TEMPERATURE, made to sum to one.
TEMPERATURE = 0.5
#: Cumulative probabilities that a broadcast source table may hold in all.
BROADCAST_STEPS = 200_000
#: Ways that a larger source table is dealt, so that a hot source is split.
SALTS = 64


def uniform(seed: int, *cols):
    """A number in [0, 1) with 52 bits, hashed from the seed and the columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """A row per source: source, n, rate. ``weights`` (source, weight) overrides the temperature."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double"))
        counts = counts.join(w, counts.source.eqNullSafe(F.col("w_source")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    size = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    # one row of sums beside a row per source
    return counts.join(F.broadcast(sums)).select("source", "n", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * size / F.col("n")).otherwise(0.0).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """source, rate and cdf: P(X <= k) for k = 0, 1, ... until the tail is below 2 ** -52."""
    steps = rates.withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("rate") + 10 * F.sqrt("rate")) + 30).cast("int"))))
    upto = Window.partitionBy("source").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    p = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial)).otherwise((F.col("k") == 0).cast("double"))
    sums = steps.withColumn("p", p).withColumn("c", F.sum("p").over(upto))
    return sums.groupBy("source", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def mix_sources(docs: DataFrame, source: str = "source", key: str = "doc_id", seed: int = SEED, weights: DataFrame | None = None, temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled, with n_copies, copy and shuffle_key."""
    made = {"n_copies", "copy", "shuffle_key", "__cdf", "__source", "__salt"}
    cols = [c for c in docs.columns if c.lower() not in made]
    tables = cut(poisson_tables(source_rates(docs, source, weights, temperature, total)), "source-rates")
    tables = tables.select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf"))
    rows = docs.select(*(f"`{c}`" for c in cols))
    if (tables.agg(F.sum(F.size("__cdf"))).first()[0] or 0) <= BROADCAST_STEPS:
        rows = rows.join(F.broadcast(tables), rows[source].eqNullSafe(F.col("__source")))
    else:
        dealt = tables.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        rows = salted.join(dealt, salted[source].eqNullSafe(dealt["__source"]) & (F.col("__at") == F.col("__salt")))
    u = uniform(seed, key)
    rows = rows.withColumn("n_copies", F.size(F.filter("__cdf", lambda c: c <= u)))
    rows = rows.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    shuffle_key = F.md5(F.concat_ws("|", F.lit(f"{seed}|shuffle"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    rows = rows.select(*(f"`{c}`" for c in cols), "n_copies", "copy", shuffle_key.alias("shuffle_key"))
    # the key is a hash: its values spread evenly, and sorting by it mixes the rows of a partition
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def resample(docs: DataFrame, source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The copies with the documents' own columns only, in shuffled order."""
    made, names = own_columns(docs, "__doc")
    own = {c: k for k, c in names.items()}
    return mix_sources(made, own[source], own[key], **how).select(*(F.col(k).alias(c) for k, c in names.items()))


def op9_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source and text of every copy, with n_copies, copy and shuffle_key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs)


OP9_SQL = """
with counts as (select source, count(*) as n from documents group by source),
rates as (select source, pow(n, 0.5) / sum(pow(n, 0.5)) over () * sum(n) over () / n as rate from counts),
steps as (select source, rate, unnest(range(0, cast(ceil(rate + 10 * sqrt(rate)) as bigint) + 31)) as k from rates),
logs as (select source, rate, k, sum(case when k > 0 then ln(k) else 0 end) over (partition by source order by k) as lf from steps),
cdf as (select source, k, sum(exp(k * ln(rate) - rate - lf)) over (partition by source order by k) as c from logs),
drawn as (
  select doc_id, source, text,
         cast('0x' || substr(md5('20|' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) / 4503599627370496.0 as u
  from documents),
counted as (
  select d.doc_id, d.source, d.text, cast(count(*) as integer) as n_copies
  from drawn d join cdf on d.source is not distinct from cdf.source and cdf.c <= d.u
  group by d.doc_id, d.source, d.text, d.u)
select doc_id, source, text, n_copies, cast(copy as integer) as copy,
       md5('20|shuffle|' || coalesce(cast(doc_id as varchar), 'null') || '|' || copy) as shuffle_key
from (select *, unnest(range(1, n_copies + 1)) as copy from counted)
"""
