"""Queries: merging, scoring, bouts, coverage, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.functions.intervals import session_key
from chirpline.operators import intervals as I
from chirpline.operators import matching as M
from chirpline.operators import scoring as S
from chirpline.plans import views as V
from chirpline.plans.views import METRICS_SQL, SQL, hit_sql, merged_sql

BUCKET = I.BUCKET_US
Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


def _counts_sql(by: str = "session", gt: str = "gt", pred: str = "pred") -> str:
    """CTE cnt: counts per group of ground truth and merged events."""
    same = lambda t: ", ".join(f"{t}.{c}" for c in by.split(", "))
    return (
        merged_sql("ev", pred, by)
        + f""",
gx as (select {same(gt)}, count(*) as n_gt, count(*) filter ({hit_sql(gt, pred, by)}) as tp from {gt} group by all),
ex as (select {same("ev")}, count(*) as n_pred, sum(n_boxes) as n_boxes, count(*) filter ({hit_sql("ev", gt, by)}) as pred_tp from ev group by all),
cnt as (
  select {by}, coalesce(n_gt, 0) as n_gt, cast(coalesce(n_boxes, 0) as bigint) as n_boxes, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp, coalesce(n_gt, 0) - coalesce(tp, 0) as fn,
         coalesce(pred_tp, 0) as pred_tp, coalesce(n_pred, 0) - coalesce(pred_tp, 0) as fp
  from gx full join ex using ({by}))
"""
    )


@query(SQL + _counts_sql() + f"select *, {METRICS_SQL} from cnt")
def score_sessions(spark, d):
    return S.score_sessions(V.ground_truth(spark, d), V.predictions(spark, d), bucket_us=BUCKET)


@query(SQL + _counts_sql() + f", s as (select {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in S.COUNTS)} from cnt) select *, {METRICS_SQL} from s")
def score_overall(spark, d):
    return S.micro(S.score_sessions(V.ground_truth(spark, d), V.predictions(spark, d)))


def _by_method(spark, d):
    pred = V.predictions(spark, d, methods=True)
    methods = pred.select("method").distinct()
    gt = V.ground_truth(spark, d).join(F.broadcast(methods))  # three methods
    return S.score_sessions(gt, pred, ["method", "session"], bucket_us=BUCKET)


_METHODS = SQL + ", gtm as (select * from gt, (select distinct method from predm))" + _counts_sql("method, session", "gtm", "predm")


@query(_METHODS + f", s as (select method, session, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in S.COUNTS)}, cast(grouping(method, session) as bigint) as level from cnt group by rollup (method, session)) select *, {METRICS_SQL} from s where level <= 1")
def score_rollup(spark, d):
    return S.rollup(_by_method(spark, d))


@query(_METHODS + f", s as (select *, {METRICS_SQL} from cnt) select method, stddev_pop(recall) as recall_std, stddev_pop(\"precision\") as precision_std, stddev_pop(f1) as f1_std, count(*) as n_sessions from s group by method")
def score_spread(spark, d):
    return S.spread(_by_method(spark, d), ["method"])


@query(SQL + merged_sql("ev", "pred", "session") + "select session, event_no, t0_us, t1_us, n_boxes from ev")
def merge_events(spark, d):
    return I.merge_intervals(V.predictions(spark, d), ["session"], bucket_us=BUCKET)


@query(SQL + merged_sql("ev", "pred", "session", strict=True) + "select ev.session, ev.event_no, ev.t0_us, ev.t1_us, n_boxes, f.first_id from ev join (select session, event_no, arg_min(event_id, (t0_us, t1_us, event_id)) as first_id from ev_b group by all) f using (session, event_no)")
def merge_events_strict(spark, d):
    return I.merge_intervals(V.predictions(spark, d), ["session"], strict=True, first=["event_id"]).withColumnRenamed("event_id", "first_id")


@query(SQL + f"select session, event_id, t0_us, t1_us from gt where not {hit_sql('gt', 'pred')}")
def fn_events(spark, d):
    got = I.overlap_flag_asof(V.ground_truth(spark, d), V.predictions(spark, d), ["session"], bucket_us=BUCKET)
    return got.where(~F.col("hit")).select("session", "event_id", "t0_us", "t1_us")


@query(SQL + merged_sql("ev", "pred", "session") + f"select session, event_no, t0_us, t1_us, n_boxes from ev where not {hit_sql('ev', 'gt')}")
def fp_events(spark, d):
    ev = I.merge_intervals(V.predictions(spark, d), ["session"], bucket_us=BUCKET)
    return I.overlap_flag_asof(ev, V.ground_truth(spark, d), ["session"], bucket_us=BUCKET).where(~F.col("hit")).drop("hit")


_PAIR = "g.session = p.session and p.t0_us < g.t1_us and p.t1_us > g.t0_us and g.t1_us > g.t0_us and p.t1_us > p.t0_us"
_IOU = "(least(g.t1_us, p.t1_us) - greatest(g.t0_us, p.t0_us)) / (greatest(g.t1_us, p.t1_us) - least(g.t0_us, p.t0_us))::double"


@query(SQL + f"select g.session, g.event_id, p.event_id as pred_id, round({_IOU}, 6) as iou from gt g join pred p on {_PAIR}")
def overlap_pairs(spark, d):
    got = I.overlap_join(V.ground_truth(spark, d), V.predictions(spark, d), ["session"])
    return got.select("session", "event_id", F.col("b_event_id").alias("pred_id"), F.round(I.iou_1d("t0_us", "t1_us", "b_t0_us", "b_t1_us"), 6).alias("iou"))


@query(SQL + f"select g.session, g.event_id from gt g where exists (select 1 from pred p where {_PAIR} and {_IOU} > 0.3)")
def matched_at_iou(spark, d):
    return I.overlap_flag(V.ground_truth(spark, d), V.predictions(spark, d), ["session"], ["event_id"], iou=0.3).where("hit").select("session", "event_id")


@query(SQL + f"select method, session, channel, event_id, t0_us, t1_us, score, case when session in (select session from gt) then case when {hit_sql('pred', 'gt')} then 'tp' else 'fp' end end as label from pred")
def label_detections(spark, d):
    return S.label_detections(V.predictions(spark, d), V.ground_truth(spark, d))


@query(SQL + merged_sql("ev", "pred", "session") + f", ok as (select session, event_no, case when {hit_sql('ev', 'gt')} then 'tp' else 'fp' end as verdict from ev) select session, event_id, cast(event_no as bigint) as event_no, verdict from ev_b join ok using (session, event_no)")
def box_verdicts(spark, d):
    return S.box_verdicts(V.predictions(spark, d), V.ground_truth(spark, d)).select("session", "event_id", "event_no", "verdict")


_SPANS = ", spans as (select session, min(t0_us) as cov0_us, max(t1_us) as cov1_us from lab where lower(trim(is_vocalization)) in ('yes', 'no') group by session)"


@query(SQL + _SPANS + "select * from spans")
def coverage_spans(spark, d):
    return S.coverage_spans(V.label_rows(spark, d))


@query(SQL + _SPANS + ", pin as (select pred.* from pred join spans using (session) where (t0_us + t1_us) / 2 between cov0_us and cov1_us)" + _counts_sql(pred="pin") + f"select *, {METRICS_SQL} from cnt")
def score_in_coverage(spark, d):
    labels = V.label_rows(spark, d)
    inside = S.in_coverage(V.predictions(spark, d), S.coverage_spans(labels))
    return S.score_sessions(S.positives(labels), inside, bucket_us=BUCKET)


@query(SQL + ", cw as (select * from gtall where name = 'combined')" + f", c as (select session, count(*) as n_combined, count(*) filter ({hit_sql('cw', 'pred')}) as combined_tp from cw group by session) select *, n_combined - combined_tp as combined_fn, combined_tp / n_combined::double as combined_recall from c")
def combined_windows(spark, d):
    return S.combined_windows(V.ground_truth(spark, d, None).where("name = 'combined'"), V.predictions(spark, d))


BOUTS_SQL = f""",
ba as (select *, lag(t1_us) over (partition by session order by t0_us, t1_us, event_id) as was from gt),
bb as (select *, cast(sum(case when t0_us - was > {V.GAP_US} then 1 else 0 end) over (partition by session order by t0_us, t1_us, event_id rows unbounded preceding) as bigint) as bout_id from ba),
bc as (select *, lead(t0_us) over (partition by session, bout_id order by t0_us, t1_us, event_id) - t1_us as ici_us from bb)
"""


@query(SQL + BOUTS_SQL + "select session, event_id, bout_id, ici_us from bc")
def bouts(spark, d):
    return I.bouts(V.ground_truth(spark, d), ["session"], V.GAP_US, ["event_id"]).select("session", "event_id", "bout_id", "ici_us")


_SCORED_BOUTS = (
    BOUTS_SQL
    + """,
bs as (select session, bout_id, count(*) as n_calls, min(t0_us) as start_us, max(t1_us) as stop_us, avg(ici_us) as mean_ici_us from bc group by all),
bgt as (select session, bout_id, event_id, t0_us, t1_us from bc),
bpred as (select bs.session, bs.bout_id, p.t0_us, p.t1_us from bs join pred p on p.session = bs.session and p.t0_us < bs.stop_us and p.t1_us > bs.start_us)"""
    + _counts_sql("session, bout_id", "bgt", "bpred")
    + f""",
bo as (select bs.*, cnt.tp, cnt.fn, cnt.pred_tp, cnt.fp, stop_us - start_us as duration_us, n_pred as n_pred_events, n_pred / n_calls::double as merge_ratio, {METRICS_SQL} from bs join cnt using (session, bout_id))
"""
)


@query(SQL + _SCORED_BOUTS + "select * from bo")
def score_bouts(spark, d):
    return S.score_bouts(V.ground_truth(spark, d), V.predictions(spark, d), V.GAP_US)


@query(SQL + _SCORED_BOUTS + f""", bz as (select case when n_calls < 2 then '1' when n_calls < 4 then '2-3' when n_calls < 7 then '4-6' else '7+' end as size_bin, count(*) as n_bouts,
  {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('tp', 'fn', 'pred_tp', 'fp', 'n_calls', 'n_pred_events'))} from bo group by 1) select *, {METRICS_SQL}, n_pred_events / n_calls::double as merge_ratio from bz""")
def bouts_by_size(spark, d):
    return S.by_bout_size(S.score_bouts(V.ground_truth(spark, d), V.predictions(spark, d), V.GAP_US))


@query(SQL + _SCORED_BOUTS + "select * from bo order by recall asc nulls last, n_calls desc, session, bout_id limit 20")
def worst_bouts(spark, d):
    return S.worst_bouts(S.score_bouts(V.ground_truth(spark, d), V.predictions(spark, d), V.GAP_US))


_CHUNK = f"cast(greatest(0, least({V.CHUNKS - 1}, floor(((t0_us + t1_us) / 2 - {V.CHUNK0_US}) / {V.CHUNK_US}))) as bigint)"


@query(SQL + f"select session, event_id, {_CHUNK} as chunk from gt")
def chunk_assignment(spark, d):
    return V.ground_truth(spark, d).select("session", "event_id", I.assign_chunk((F.col("t0_us") + F.col("t1_us")) / 2, V.CHUNK0_US, V.CHUNK_US, V.CHUNKS).alias("chunk"))


@query(SQL + f""", span as (select session, event_id, greatest(0, cast(floor((t0_us - 60000000 - {V.CHUNK0_US}) / {V.CHUNK_US}::double) as bigint)) as a,
  least({V.CHUNKS - 1}, cast(ceil((t1_us + 60000000 - {V.CHUNK0_US}) / {V.CHUNK_US}::double) as bigint) - 1) as b from pred)
select session, event_id, unnest(range(a, b + 1)) as chunk from span""")
def event_chunk_overlap(spark, d):
    return I.chunks_touched(V.predictions(spark, d), V.CHUNK0_US, V.CHUNK_US, V.CHUNKS, 60_000_000).select("session", "event_id", "chunk")


@query(SQL + merged_sql("ev", "pred", "session") + f""",
m as (
  select session, {_CHUNK} as chunk, {hit_sql('gt', 'pred')} as tp, not {hit_sql('gt', 'pred')} as fn, false as fp from gt
  union all select session, {_CHUNK} as chunk, false, false, not {hit_sql('ev', 'gt')} from ev)
select session, chunk, case when bool_or(fn) then 'fn' when bool_or(tp) then 'tp' when bool_or(fp) then 'fp' end as pool from m group by session, chunk""")
def chunk_outcomes(spark, d):
    """A chunk is a miss if any call is missed, else a hit if any matched, else spurious."""
    gt, pred = V.ground_truth(spark, d), V.predictions(spark, d)
    chunk = I.assign_chunk((F.col("t0_us") + F.col("t1_us")) / 2, V.CHUNK0_US, V.CHUNK_US, V.CHUNKS).alias("chunk")
    calls = I.overlap_flag_asof(gt, pred, ["session"], bucket_us=BUCKET).select("session", chunk, F.col("hit").alias("tp"), (~F.col("hit")).alias("fn"), F.lit(False).alias("fp"))
    ev = I.overlap_flag_asof(I.merge_intervals(pred, ["session"], bucket_us=BUCKET), gt, ["session"], bucket_us=BUCKET)
    ev = ev.select("session", chunk, F.lit(False).alias("tp"), F.lit(False).alias("fn"), (~F.col("hit")).alias("fp"))
    pool = F.when(F.bool_or("fn"), "fn").when(F.bool_or("tp"), "tp").when(F.bool_or("fp"), "fp")
    return calls.unionByName(ev).groupBy("session", "chunk").agg(pool.alias("pool"))


@query("select c_custkey, c_name, row_number() over (order by regexp_extract(c_name, '\\D*(\\d+)', 1)::bigint, c_name) as place, 'experiment_' || (c_custkey % 7) || '/idx_' || lpad(cast(c_custkey % 5 as varchar), 3, '0') as session from customer")
def natural_sort(spark, d):
    """All customers by the number in their name, with a session key; of one name by their key."""
    c = M.natural_order(V.table(spark, d, "customer"), "c_name", ["c_custkey"])
    return c.select("c_custkey", "c_name", "place", session_key(F.col("c_custkey") % 7, F.col("c_custkey") % 5).alias("session"))
