"""The driver's tables as the engine's tables: intervals, detections, boxes, latents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK0_US, CHUNK_US, CHUNKS = 1_704_067_200_000_000, 21_600_000_000, 120
GAP_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, session, channel, event_type, score, t0_us, t1_us."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("experiment_"), (F.col("user_id") % 10).cast("string"), F.lit("/idx_"), F.lpad((F.col("user_id") % 3).cast("string"), 3, "0")).alias("session"),
        (F.col("user_id") % 2).cast("int").alias("channel"),
        "event_type",
        F.col("value").alias("score"),
        micros.alias("t0_us"),
        (micros + F.round(F.col("value") * 60000000).cast("bigint")).alias("t1_us"),
    )


def ground_truth(spark, sf_dir, name: str | None = "vox") -> DataFrame:
    iv = intervals(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup"))
    gt = iv.select("session", "event_id", "t0_us", "t1_us", F.when(F.col("event_type") == "purchase", "vox").otherwise("combined").alias("name"))
    return gt if name is None else gt.where(F.col("name") == name)


def predictions(spark, sf_dir, methods: bool = False) -> DataFrame:
    """All methods' detections, or pooled those of clicks and views."""
    iv = intervals(spark, sf_dir)
    kinds = ("click", "view", "error") if methods else ("click", "view")
    method = F.when(F.col("event_type") == "click", "m_click").when(F.col("event_type") == "view", "m_view").otherwise("m_error")
    return iv.where(F.col("event_type").isin(*kinds)).select(method.alias("method"), "session", "channel", "event_id", "t0_us", "t1_us", "score")


def label_rows(spark, sf_dir) -> DataFrame:
    label = F.when(F.col("event_type") == "purchase", " Yes").when(F.col("event_type") == "signup", "no ").otherwise("")
    return intervals(spark, sf_dir).select("session", "event_id", "t0_us", "t1_us", label.alias("is_vocalization"))


def detections(spark, sf_dir) -> DataFrame:
    label = F.when(F.col("l_linestatus") == "F", "tp").otherwise("fp")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 8).cast("int").alias("session_no"),
        F.col("l_quantity").alias("n_cols"), F.col("l_discount").alias("flatness"), F.col("l_tax").alias("sweep_frac"), F.col("l_extendedprice").alias("centroid_hz"), label.alias("label"),
    )


def scored_detections(spark, sf_dir) -> DataFrame:
    """Detections in time with features: n_cols (seconds), flatness, centroid_hz, area_frac."""
    v = F.col("event_id")
    return predictions(spark, sf_dir, methods=True).select(
        "session", "channel", "event_id", "t0_us", "t1_us", "score", F.floor((F.col("t1_us") - F.col("t0_us")) / 1_000_000).alias("n_cols"),
        (v % 97 / 97).alias("flatness"), (v * 7919 % 50000).cast("double").alias("centroid_hz"), (v % 11 / 40).alias("area_frac"),
    )


def channel_power(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("vox_idx"), F.col("l_linenumber").alias("channel"), "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("power"), F.col("l_discount").alias("snr")
    )


def boxes(spark, sf_dir) -> DataFrame:
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), "l_linenumber", "l_partkey", "l_suppkey", x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity")).alias("y2"), F.col("l_extendedprice").alias("score")
    )


def frames(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("session").orderBy("t0_us", "event_id")) - 1
    return intervals(spark, sf_dir).select("session", at.cast("long").alias("frame"), F.col("score").alias("env"))


def latents(spark, sf_dir) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("cluster_id"), ((v * 7919) % 1000).alias("confidence"), F.when(v % 2 == 0, v + 1).otherwise(v - 1).alias("paired_vec_id"))


#: The same for DuckDB, as the beginning of a WITH clause.
SQL = """
with iv as (
  select event_id, concat('experiment_', cast(user_id % 10 as varchar), '/idx_', lpad(cast(user_id % 3 as varchar), 3, '0')) as session,
         cast(user_id % 2 as int) as channel, event_type, value as score,
         epoch_us(ts) as t0_us, epoch_us(ts) + cast(round(value * 60000000) as bigint) as t1_us
  from events),
gtall as (select session, event_id, t0_us, t1_us, case when event_type = 'purchase' then 'vox' else 'combined' end as name from iv where event_type in ('purchase', 'signup')),
gt as (select * from gtall where name = 'vox'),
predm as (
  select case event_type when 'click' then 'm_click' when 'view' then 'm_view' else 'm_error' end as method, session, channel, event_id, t0_us, t1_us, score
  from iv where event_type in ('click', 'view', 'error')),
pred as (select * from predm where method <> 'm_error'),
lab as (select session, event_id, t0_us, t1_us, case event_type when 'purchase' then ' Yes' when 'signup' then 'no ' else '' end as is_vocalization from iv),
det as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_suppkey % 8 as int) as session_no, l_quantity as n_cols, l_discount as flatness, l_tax as sweep_frac,
         l_extendedprice as centroid_hz, case when l_linestatus = 'F' then 'tp' else 'fp' end as label from lineitem),
sdet as (
  select session, channel, event_id, t0_us, t1_us, score, cast(floor((t1_us - t0_us) / 1000000.0) as bigint) as n_cols,
         event_id % 97 / 97.0::double as flatness, cast(event_id * 7919 % 50000 as double) as centroid_hz, event_id % 11 / 40.0::double as area_frac from predm),
cpow as (select l_orderkey as vox_idx, l_linenumber as channel, l_suppkey, l_partkey, l_extendedprice as power, l_discount as snr from lineitem where l_linenumber <= 2),
box as (
  select l_orderkey as chunk_id, l_linenumber, l_partkey, l_suppkey, cast(l_partkey % 100 as double) as x1, cast(l_suppkey % 50 as double) as y1,
         cast(l_partkey % 100 as double) + l_quantity as x2, cast(l_suppkey % 50 as double) + l_quantity as y2, l_extendedprice as score from lineitem),
fr as (select session, row_number() over (partition by session order by t0_us, event_id) - 1 as frame, score as env from iv),
lat as (
  select vec_id, embedding, label as cluster_id, (vec_id * 7919) % 1000 as confidence, case when vec_id % 2 = 0 then vec_id + 1 else vec_id - 1 end as paired_vec_id from embeddings)
"""


def merged_sql(name: str, source: str, by: str, strict: bool = False) -> str:
    """CTEs that merge a relation's intervals: ``name`` has by, event_no, t0_us, t1_us, n_boxes."""
    new = ">=" if strict else ">"
    return f""",
{name}_a as (select *, max(t1_us) over (partition by {by} order by t0_us, t1_us rows between unbounded preceding and 1 preceding) as reach from {source}),
{name}_b as (select *, sum(case when reach is null or t0_us {new} reach then 1 else 0 end) over (partition by {by} order by t0_us, t1_us rows unbounded preceding) - 1 as event_no from {name}_a),
{name} as (select {by}, cast(event_no as bigint) as event_no, min(t0_us) as t0_us, max(t1_us) as t1_us, count(*) as n_boxes from {name}_b group by {by}, event_no)
"""


def hit_sql(a: str, b: str, by: str = "session") -> str:
    """EXISTS clause: does any row of b overlap the row of a?"""
    same = " and ".join(f"{b}.{c} = {a}.{c}" for c in by.split(", "))
    return f"exists (select 1 from {b} where {same} and {b}.t0_us < {a}.t1_us and {b}.t1_us > {a}.t0_us and {a}.t1_us > {a}.t0_us and {b}.t1_us > {b}.t0_us)"


RECURSIVE_SQL = SQL.replace("with iv", "with recursive iv", 1)


def greedy_sql(by: str, g: str, p: str) -> str:
    """CTEs after RECURSIVE_SQL: ``gm`` has the pairs of g and p, best first, taken one by one while both ends are free."""
    keys = by.split(", ")
    of = lambda t: ", ".join(f"{t}.{c}" for c in keys)
    same = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    iou = "(least(g.t1_us, p.t1_us) - greatest(g.t0_us, p.t0_us)) / (greatest(g.t1_us, p.t1_us) - least(g.t0_us, p.t0_us))::double"
    return f""", pr as (
  select {of("g")}, g.event_id as g, p.event_id as p, {iou} as iou,
         row_number() over (partition by {of("g")} order by {iou} desc, g.t0_us desc, g.t1_us desc, g.event_id desc, p.t0_us desc, p.t1_us desc, p.event_id desc) as k
  from {g} g join {p} p on {same("g", "p")} and p.t0_us < g.t1_us and p.t1_us > g.t0_us and g.t1_us > g.t0_us and p.t1_us > p.t0_us),
walk as (
  select distinct {by}, 0::bigint as k, null::bigint as g, null::bigint as p, null::double as iou, []::bigint[] as gs, []::bigint[] as ps from pr
  union all
  select {of("w")}, pr.k, case when free then pr.g end, case when free then pr.p end, pr.iou, case when free then list_append(gs, pr.g) else gs end, case when free then list_append(ps, pr.p) else ps end
  from walk w join pr on {same("pr", "w")} and pr.k = w.k + 1, lateral (select not list_contains(gs, pr.g) and not list_contains(ps, pr.p) as free)),
gm as (select {by}, g as gt_id, p as pred_id, iou from walk where g is not null)
"""


MATCHING_SQL = """coalesce(tp / nullif(tp + fp, 0)::double, 0) as "precision", coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall, case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end as f1"""

METRICS_SQL = """
  tp / nullif(tp + fn, 0)::double as recall, pred_tp / nullif(pred_tp + fp, 0)::double as "precision",
  case when tp / nullif(tp + fn, 0)::double + pred_tp / nullif(pred_tp + fp, 0)::double > 0
    then 2 * (tp / nullif(tp + fn, 0)::double) * (pred_tp / nullif(pred_tp + fp, 0)::double) / (tp / nullif(tp + fn, 0)::double + pred_tp / nullif(pred_tp + fp, 0)::double) end as f1
"""
