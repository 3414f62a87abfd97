"""Operator 8: exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into ``SEGMENTS`` segments of 16 bits. Two codes within distance ``m * (r + 1) - 1``
agree in some segment within ``r`` bits, so after every segment was probed at all values within
``r`` bits, every code up to that distance has been verified. The radius grows for the queries
whose k-th verified distance isn't covered yet; the search ends when all are, which makes it exact.

Equal codes are searched once: vectors collapse to distinct codes (with their k lowest ids, more
can't be among k results) before they are indexed, and so do the queries. A pair of codes is taken
in the round of its nearest segment and from the first such segment only, so no pair comes twice,
and only if it is no further than the k-th nearest so far.
Ties are in order of vec_id. A query finds itself at distance 0.

A bucket (segment and value) of more than ``BUCKET_ROWS`` codes is dealt over several salts, and its
probes are copied to each: buckets that a third of all codes share are many tasks' work. There are at
most 4 * 2 ** 16 buckets, which bounds the table of salts that is broadcast.

Nulls: a null vector, or one of another length, has no code: it is neither found nor answers. A
null component counts as not positive. A null vec_id is never a query and comes last in ties.
With fewer than k vectors all of them are returned. Repeated rows are separate results; an empty
table gives an empty result. Only the key and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

DIMS, BITS = 64, 16
SEGMENTS = DIMS // BITS
K = 10
EVERY = 50
#: Codes of a bucket that one task probes.
BUCKET_ROWS = 50_000


def sign_codes(df: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and code: a long of the components' signs (1: positive), the first as highest bit."""
    bit = F.transform(F.col(vec), lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bit, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return df.where(F.size(vec) == DIMS).select(F.col(key).alias("vec_id"), code.alias("code"))


def segment(code, i):
    return F.shiftright(code, BITS * i).bitwiseAND(F.lit(0xFFFF)).cast("int")


def distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def segment_distances(a, b) -> list:
    x = a.bitwiseXOR(b)
    return [F.bit_count(segment(x, i)) for i in range(SEGMENTS)]


def by_segment(df: DataFrame, code: str) -> DataFrame:
    """A row for each segment of each row: seg, value."""
    cells = F.array(*(F.struct(F.lit(i).alias("seg"), segment(F.col(code), i).alias("value")) for i in range(SEGMENTS)))
    return df.withColumn("cell", F.explode(cells)).select("*", "cell.seg", "cell.value").drop("cell")


def salted(index: DataFrame, bucket_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index with a salt in each row, and seg, value, salts of the buckets with more than one."""
    sizes = index.groupBy("seg", "value").agg(F.ceil(F.count(F.lit(1)) / (bucket_rows or BUCKET_ROWS)).cast("int").alias("salts"))
    hot = cut(sizes.where("salts > 1"), "hot-buckets")  # at most SEGMENTS * 2 ** BITS rows
    dealt = index.join(F.broadcast(hot), ["seg", "value"], "left")
    return dealt.withColumn("salt", F.pmod(F.xxhash64("code"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"), hot


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, hamming: the k nearest of ``codes`` for each row of ``queries``."""
    lowest = Window.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last())
    ids = cut(codes.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k).select("code", "vec_id"), "code-ids")
    distinct = cut(ids.groupBy("code").agg(F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("rows")), "codes")
    index, hot = salted(by_segment(distinct, "code"))
    asked = cut(queries.select(F.col("code").alias("q")).distinct(), "query-codes")
    want = min(k, distinct.agg(F.sum("rows")).first()[0] or 0)
    ranked = Window.partitionBy("q").orderBy("hamming", F.col("low_id").asc_nulls_last(), "code")
    open_, best, r = asked.withColumn("bound", F.lit(DIMS)), None, 0
    while want and r <= BITS:
        masks = F.split(F.lit(",".join(str(x) for x in range(1 << BITS) if x.bit_count() == r)), ",").cast("array<int>")  # comb(16, r) values, a constant
        asking = open_.repartition(codes.sparkSession.sparkContext.defaultParallelism, "q")
        probes = by_segment(asking, "q").withColumn("flip", F.explode(masks)).select("q", "bound", "seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        probes = probes.join(F.broadcast(hot), ["seg", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        met = probes.join(index.hint("shuffle_hash"), ["seg", "value", "salt"])
        near = segment_distances(F.col("q"), F.col("code"))
        first = F.array_position(F.array(*near), r) - 1  # the first segment at this radius
        useful = distance(F.col("q"), F.col("code")) <= F.col("bound")  # no further than the k-th so far
        found = met.where((F.least(*near) == r) & (F.col("seg") == first) & useful).select("q", "code", "low_id", "rows", distance(F.col("q"), F.col("code")).alias("hamming"))
        old = best
        if old is not None:
            found = found.unionByName(old)
        best = cut(found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).drop("n"), f"best-{r}")
        sure = SEGMENTS * (r + 1) - 1
        so_far = best.groupBy("q").agg(F.sum(F.when(F.col("hamming") <= sure, F.col("rows")).otherwise(0)).alias("sure"), F.sum("rows").alias("rows"), F.max("hamming").alias("last"))
        left = asked.join(so_far, "q", "left").where(F.coalesce("sure", F.lit(0)) < want)
        open_ = left.select("q", F.when(F.col("rows") >= want, F.col("last")).otherwise(DIMS).alias("bound"))
        open_ = cut(open_, f"open-{r}") if sure < DIMS else open_.limit(0)
        if old is not None:
            drop_cut(old)
        if open_.isEmpty():
            break
        r += 1
    if best is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).alias("hamming")).limit(0)
    drop_cut(hot)
    nearest = best.select("q", "code", "hamming").join(ids, "code")
    per_code = Window.partitionBy("q").orderBy("hamming", F.col("vec_id").asc_nulls_last())
    rows = nearest.withColumn("rank", F.row_number().over(per_code)).where(F.col("rank") <= k)
    return queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).join(rows, "q").select("query_id", "rank", "vec_id", "hamming")


def probes_per_query(radius: int) -> int:
    """Buckets that a query opens up to a radius."""
    return SEGMENTS * sum(comb(BITS, i) for i in range(radius + 1))


def op8_hamming_top_k(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every row whose vec_id is divisible by 50, against all rows."""
    codes = cut(sign_codes(table(spark, sf_dir, "embeddings")), "sign-codes")
    return top_k(codes, codes.where(F.col("vec_id") % EVERY == 0))


OP8_SQL = """
with codes as (
  select vec_id, list_reduce(list_transform(embedding, lambda x: case when x > 0 then 1::hugeint else 0::hugeint end), lambda a, b: a * 2 + b) as code
  from embeddings where len(embedding) = 64),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(bit_count(xor(q.code, c.code)) as integer) as hamming
  from codes q, codes c where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by hamming, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, hamming from ranked where rank <= 10
"""
