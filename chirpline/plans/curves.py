"""Queries: precision-recall curves, gates, strategies, cross-validation, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.operators import curves as C
from chirpline.operators import gates as G
from chirpline.plans import views as V
from chirpline.operators.scoring import COUNTS
from chirpline.plans.scoring import BOUTS_SQL, _counts_sql
from chirpline.plans.views import MATCHING_SQL, METRICS_SQL, RECURSIVE_SQL, SQL, greedy_sql, hit_sql, merged_sql

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


LEVELS = 12
_QUANTS = ", ".join(f"quantile_cont(score, {i}/{LEVELS - 1}::double)" for i in range(LEVELS))
_CURVE = (
    SQL
    + f""",
cuts as (select method, list_sort(list_distinct(list_transform([{_QUANTS}], lambda x: round(x, 6)))) as c from predm group by method),
steps as (
  select method, 0 as seq, cast(null as double) as threshold from cuts
  union all select method, cast(i as int) as seq, c[i] as threshold from (select method, c, unnest(range(1, len(c) + 1)) as i from cuts)),
ps as (select method, seq, session, t0_us, t1_us from predm join steps using (method) where threshold is null or score >= threshold),
gs as (select method, seq, session, event_id, t0_us, t1_us from gt, steps)"""
    + merged_sql("ev", "ps", "method, seq, session")
    + f""",
r as (select method, seq, count(*) as n_gt, count(*) filter ({hit_sql("gs", "ps", "method, seq, session")}) as tp from gs group by all),
p as (select method, seq, count(*) filter ({hit_sql("ev", "gs", "method, seq, session")}) as pred_tp, count(*) filter (not {hit_sql("ev", "gs", "method, seq, session")}) as fp from ev group by all),
pts as (
  select method, seq, threshold, tp, coalesce(pred_tp, 0) as pred_tp, coalesce(fp, 0) as fp, n_gt - tp as fn, tp / n_gt::double as recall,
         coalesce(pred_tp / nullif(coalesce(pred_tp, 0) + coalesce(fp, 0), 0)::double, 1.0) as "precision"
  from steps join r using (method, seq) left join p using (method, seq))
"""
)


def _points(spark, d):
    return C.pr_curve(V.ground_truth(spark, d), V.predictions(spark, d, methods=True), levels=LEVELS)


@query(_CURVE + """select *, case when "precision" > 0 and recall > 0 then 2 * "precision" * recall / ("precision" + recall) end as f1 from pts""")
def pr_curve(spark, d):
    return _points(spark, d)


@query(_CURVE + """, st as (select method, (recall - lag(recall) over w) * ("precision" + lag("precision") over w) / 2 as s from pts window w as (partition by method order by recall, seq)) select method, sum(s) as auc from st group by method""")
def auc_pr(spark, d):
    return C.area_under_curve(_points(spark, d))


@query(_CURVE + """select method, target, max(case when recall >= target then "precision" end) as "precision" from pts, (select unnest([0.1, 0.2, 0.5]::double[]) as target) group by all""")
def precision_at_recall(spark, d):
    return C.precision_at_recall(_points(spark, d), [0.1, 0.2, 0.5])


_SIGNAL = (
    SQL
    + """,
fl as (select session, threshold, frame, env >= threshold as on_, coalesce(lead(frame) over w, frame) as nxt, coalesce(lag(env >= threshold) over w, false) as was
       from fr, (select unnest([0.2, 0.5, 0.8, 0.9]::double[]) as threshold) window w as (partition by session, threshold order by frame)),
fr2 as (select *, sum(case when on_ and not was then 1 else 0 end) over (partition by session, threshold order by frame rows unbounded preceding) as run from fl),
rn as (select session, threshold, min(frame) as t0_us, max(nxt) as t1_us from fr2 where on_ group by session, threshold, run)
"""
)


@query(_SIGNAL + "select session, threshold, t0_us, t1_us from rn where t1_us - t0_us >= 2")
def runs_above_threshold(spark, d):
    from chirpline.operators.intervals import runs

    fr = V.frames(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, [0.2, 0.5, 0.8, 0.9]))))
    return runs(fr, ["session", "threshold"], F.col("env") >= F.col("threshold"), "frame", 2)


_SWEEP = (
    _SIGNAL
    + f""",
gtf as (select session, threshold, event_id % 300 as t0_us, event_id % 300 + 2 as t1_us from gt, (select unnest([0.2, 0.5, 0.8, 0.9]::double[]) as threshold)),
sw as (select threshold, count(*) filter ({hit_sql("gtf", "rn", "session, threshold")}) / count(*)::double as recall from gtf group by threshold),
sp as (select threshold, count(*) as n_candidates, count(*) filter ({hit_sql("rn", "gtf", "session, threshold")}) / count(*)::double as "precision" from rn group by threshold)
"""
)


def _sweep(spark, d):
    gt = V.ground_truth(spark, d).select("session", (F.col("event_id") % 300).alias("t0_us"), (F.col("event_id") % 300 + 2).alias("t1_us"))
    return C.signal_sweep(V.frames(spark, d), gt, [0.2, 0.5, 0.8, 0.9])


@query(_SWEEP + """select threshold, n_candidates, recall, "precision" from sw join sp using (threshold)""")
def signal_sweep(spark, d):
    return _sweep(spark, d)


@query(_SWEEP + """, j as (select * from sw join sp using (threshold)), t as (select target, arg_min({'threshold': threshold, 'n': n_candidates, 'recall': recall}, (n_candidates, threshold)) as p from j, (select unnest([0.5, 0.7, 0.9]::double[]) as target) where recall >= target group by target) select target, p.threshold as threshold, p.n as n_candidates, p.recall as recall from t""")
def operating_points(spark, d):
    return C.operating_points(_sweep(spark, d), [0.5, 0.7, 0.9])


_F = ["n_cols", "flatness", "sweep_frac", "centroid_hz"]


@query(SQL + ", ln as (" + " union all ".join(f"select '{f}' as feature, label, {f}::double as value from det" for f in _F) + """),
c as (select feature, value, count(*) filter (label = 'tp') as tp, count(*) filter (label = 'fp') as fp from ln group by all),
u as (select *, coalesce(sum(fp) over (partition by feature order by value rows between unbounded preceding and 1 preceding), 0) as un from c),
a as (select feature, sum(tp) as n_tp, sum(fp) as n_fp, sum(tp * (un + fp / 2.0)) / (sum(tp) * sum(fp)) as x from u group by feature)
select feature, cast(n_tp as bigint) as n_tp, cast(n_fp as bigint) as n_fp, greatest(x, 1 - x) as auc, m.median_tp, m.median_fp
from a join (select feature, median(value) filter (label = 'tp') as median_tp, median(value) filter (label = 'fp') as median_fp from ln group by feature) m using (feature)""")
def feature_auc(spark, d):
    return C.feature_auc(V.detections(spark, d), _F)


@query(SQL + """, q as (select quantile_cont(centroid_hz, 0.01) as lo, quantile_cont(centroid_hz, 0.99) as hi from det),
b as (select label, cast(least(floor((centroid_hz - lo) / (hi - lo) * 20), 19) as int) as bin, lo, hi from det, q where centroid_hz between lo and hi),
n as (select label, bin, lo, hi, count(*) as n from b group by all)
select label, bin, n, n / sum(n) over (partition by label) / ((hi - lo) / 20) as density from n""")
def class_histogram(spark, d):
    return C.histogram(V.detections(spark, d), "centroid_hz", "label")


@query(SQL + merged_sql("ev", "predv", "session").replace("from predv", "from (select * from predm where method = 'm_view')") + f""",
mv as (select * from predm where method = 'm_view'), mo as (select * from predm where method <> 'm_view'),
x as (
  select case when {hit_sql('gt', 'mo')} then 'miss_others_hit' else 'miss_all' end as category from gt where not {hit_sql('gt', 'mv')}
  union all select case when {hit_sql('ev', 'mo')} then 'fp_shared' else 'fp_only' end from ev where not {hit_sql('ev', 'gt')})
select category, count(*) as n from x group by category""")
def miss_categories(spark, d):
    return C.miss_categories(V.ground_truth(spark, d), V.predictions(spark, d, methods=True), "m_view", ["m_click", "m_view", "m_error"])


_REASON = "case when n_cols < 5 then 'too_short' when sweep_frac < 0.04 then 'flat' when centroid_hz < 25000 then 'low_centroid' when flatness > 0.06 then 'high_flatness' else 'keep' end"


def _reason():
    return G.reason(max_area_frac=None, max_flatness=0.06)


@query(SQL + f"select session_no, {_REASON} as reason, count(*) as n from det group by all")
def gate_reasons(spark, d):
    return G.reason_counts(V.detections(spark, d), _reason(), ["session_no"])


@query(SQL + f", x as (select *, {_REASON} as reason from det) select session_no, l_orderkey, l_linenumber, l_partkey, l_suppkey, reason, case when reason = 'keep' then row_number() over (partition by session_no, reason = 'keep' order by l_orderkey, l_linenumber, l_partkey, l_suppkey, centroid_hz) - 1 end as new_id from x")
def refilter(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "centroid_hz"]
    return G.refilter(V.detections(spark, d), _reason(), ["session_no"], order).select("session_no", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason", F.col("new_id").cast("long").alias("new_id"))


_GATES = {
    "short": [("n_cols", ">=", 9)],
    "pitch": [("centroid_hz", ">=", 25000.0)],
    "tonal": [("flatness", "<=", 0.5)],
    "short_pitch": [("n_cols", ">=", 9), ("centroid_hz", ">=", 25000.0)],
    "all": [("n_cols", ">=", 9), ("centroid_hz", ">=", 25000.0), ("flatness", "<=", 0.5)],
}
_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in COUNTS)


def _kept_sql(named: dict[str, str], source: str = "sdet") -> str:
    """CTEs kept and calls: a strategy's detections by its condition, and all calls beside each strategy."""
    rows = " union all ".join(f"select '{n}' as strategy, session, channel, event_id, t0_us, t1_us from {source} where {c}" for n, c in named.items())
    names = ", ".join(f"('{n}')" for n in named)
    return f", kept as ({rows}), calls as (select strategy, gt.* from gt, (values {names}) as names(strategy))"


def _events_sql(named: dict[str, str]) -> str:
    """CTE cnt: event counts per strategy and session."""
    return SQL + _kept_sql(named) + _counts_sql("strategy, session", "calls", "kept")


def _pooled_sql(named: dict[str, str]) -> str:
    """CTE st: pooled counts and metrics per strategy."""
    return _events_sql(named) + f", su as (select strategy, {_SUMS} from cnt group by strategy), st as (select strategy, n_gt, n_boxes as n_kept, n_pred, tp, fn, pred_tp, fp, {METRICS_SQL} from su)"


def _where(gates) -> str:
    return " and ".join(f"{f} {o} {v}" for f, o, v in gates) or "true"


def _named():
    return {n: G.passes(g) for n, g in _GATES.items()}


def _sides(spark, d):
    return V.scored_detections(spark, d), V.ground_truth(spark, d)


_NAMED_SQL = {n: _where(g) for n, g in _GATES.items()}


@query(_pooled_sql(_NAMED_SQL) + "select * from st")
def gate_strategies(spark, d):
    return G.strategies(*_sides(spark, d), _named())


_FOLDS = (
    _events_sql(_NAMED_SQL)
    + f", fo as (select session, cast((row_number() over (order by session) - 1) % 4 as int) as fold from (select distinct session from gt)), fs as (select fold, strategy, {_SUMS} from cnt join fo using (session) group by all), m as (select *, {METRICS_SQL} from fs)"
)


@query(_FOLDS + 'select strategy, avg(recall) as recall_mean, stddev_pop(recall) as recall_std, avg("precision") as precision_mean, stddev_pop("precision") as precision_std, avg(f1) as f1_mean, stddev_pop(f1) as f1_std, count(f1) as n_folds from m group by strategy')
def grouped_cv(spark, d):
    return G.grouped_cv(*_sides(spark, d), "session", _named(), 4)


@query(_FOLDS + f""", o as (select a.fold, a.strategy, sum(b.tp) as tp, sum(b.fn) as fn, sum(b.pred_tp) as pred_tp, sum(b.fp) as fp from fs a join fs b on a.strategy = b.strategy and a.fold <> b.fold group by all),
r as (select fold, strategy, {METRICS_SQL} from o),
n as (select *, row_number() over (partition by fold order by coalesce(f1, -1) desc, strategy) as n from r) select n.fold, n.strategy, n.f1 as train_f1, m.f1 as test_f1 from n join m using (fold, strategy) where n = 1""")
def train_and_held_out(spark, d):
    return G.train_and_held_out(*_sides(spark, d), "session", _named(), 4)


_ONE = {"a5": [("n_cols", ">=", 5)], "a9": [("n_cols", ">=", 9)], "a20": [("n_cols", ">=", 20)]}
_TWO = {"b1": [("flatness", "<=", 0.3)], "b2": [("flatness", "<=", 0.8)]}
_GRID = {a: _where(g) for a, g in _ONE.items()} | {f"{a}|{b}": _where(x + y) for a, x in _ONE.items() for b, y in _TWO.items()}


@query(_pooled_sql(_GRID) + """, g as (select * from st where contains(strategy, '|')), al as (select * from st where not contains(strategy, '|')),
lean as (select strategy as a from al where recall >= (select max(recall) from al) - 0.05 order by n_kept, strategy limit 1)
(select 'joint' as plan, strategy, f1 from g order by coalesce(f1, -1) desc, strategy limit 1)
union all (select 'staged', strategy, f1 from g where split_part(strategy, '|', 1) = (select a from lean) order by coalesce(f1, -1) desc, strategy limit 1)""")
def two_stage(spark, d):
    return G.two_stage(*_sides(spark, d), {n: G.passes(g) for n, g in _ONE.items()}, {n: G.passes(g) for n, g in _TWO.items()}, 0.05)


#: Gates on the features, and on the score, which is an interval's length here: longer ones hit more calls.
_POOL = [("n_cols", ">=", v) for v in (5.0, 20.0, 60.0, 100.0, 140.0, 200.0)] + [("flatness", "<=", v) for v in (0.3, 0.8)] + [("centroid_hz", ">=", v) for v in (10000.0, 25000.0)]


def _pool_sql() -> str:
    """Every choice of at most one gate a feature, scored; then the greedy way through them."""
    names = {"n_cols": "a", "flatness": "b", "centroid_hz": "c"}
    lists = {f: ", ".join(str(v) for g, _, v in _POOL if g == f) for f in names}
    axes = ", ".join(f"(select unnest([null, {lists[f]}]::double[]) as {k}) x{k}" for f, k in names.items())
    ops = {f: o for f, o, _ in _POOL}
    keep = " and ".join(f"({k} is null or {f} {ops[f]} {k})" for f, k in names.items())
    pool = " union all ".join(f"select {i} as i, '{f}' as feature, '{o}' as op, {v}::double as threshold" for i, (f, o, v) in enumerate(_POOL))
    held = lambda s: " and ".join(f"({s}.{k} is null or {s}.{k} = f1s.{k})" for k in names.values())
    added = lambda s: "case " + " ".join(f"when {s}.{k} is null and f1s.{k} is not null then '{f}'" for f, k in names.items()) + " end"
    value = lambda s: "case " + " ".join(f"when {s}.{k} is null and f1s.{k} is not null then f1s.{k}" for k in names.values()) + " end"
    steps = [", s0 as (select a, b, c, f1 from f1s where n = 0)"]
    for k in (1, 2, 3):
        was = f"s{k - 1}"
        steps.append(
            f", s{k} as (select f1s.a, f1s.b, f1s.c, f1s.f1, p.feature, p.op, p.threshold from f1s join {was} on f1s.n = {k} and {held(was)} join pool p on p.feature = {added(was)} and p.threshold = {value(was)} "
            f"qualify row_number() over (order by coalesce(f1s.f1, -1) desc, p.i) = 1 and coalesce(f1s.f1, 0) > coalesce({was}.f1, 0) + 0.002)"
        )
    rows = " union all ".join(["select 0 as step, cast(null as varchar) as feature, cast(null as varchar) as op, cast(null as double) as threshold, coalesce(f1, 0) as f1 from s0", *(f"select {k}, feature, op, threshold, f1 from s{k}" for k in (1, 2, 3))])
    return (
        SQL
        + f""", sets as (select row_number() over () as trial, * from {axes}),
kept as (select trial, session, t0_us, t1_us from sdet, sets where {keep}), calls as (select trial, gt.* from gt, sets)"""
        + _counts_sql("trial, session", "calls", "kept")
        + f""", su as (select trial, {_SUMS} from cnt group by trial), sc as (select trial, {METRICS_SQL} from su),
f1s as (select a, b, c, (a is not null)::int + (b is not null)::int + (c is not null)::int as n, f1 from sets left join sc using (trial)), pool as ({pool})"""
        + "".join(steps)
        + " "
        + rows
    )


@query(_pool_sql())
def forward_selection(spark, d):
    """M3: step 0 is all detections, without a gate."""
    det, gt = _sides(spark, d)
    got = G.selection_steps(det, gt, _POOL)
    return spark.createDataFrame([(i, *(gate or (None, None, None)), s) for i, (gate, s) in enumerate(got)], "step int, feature string, op string, threshold double, f1 double")


_DRAW = "cast('0x' || substr(md5('7|{0}|' || trial), 1, 13) as bigint) / 4503599627370496.0"


@query(SQL + f""", cfg as (select trial, 1 + {_DRAW.format('min_cols')} * 29.0 as cfg_min_cols, 0.0 + {_DRAW.format('max_flatness')} * 1.0 as cfg_max_flatness from range(40) t(trial)),
kept as (select trial, session, t0_us, t1_us from sdet, cfg where n_cols >= cfg_min_cols and flatness <= cfg_max_flatness), calls as (select trial, gt.* from gt, cfg)""" + _counts_sql("trial, session", "calls", "kept") + f""", su as (select trial, {_SUMS} from cnt group by trial), st as (select trial, n_gt, n_boxes as n_kept, n_pred, tp, fn, pred_tp, fp, {METRICS_SQL} from su)
select st.*, cfg_min_cols, cfg_max_flatness from st join cfg using (trial) order by coalesce(f1, -1) desc, trial limit 5""")
def random_search(spark, d):
    """The five best of forty random gate settings by event F1."""
    cfg = G.random_configs(spark, 40, {"min_cols": (1, 30), "max_flatness": (0.0, 1.0)}, 7)
    trials = G.search(*_sides(spark, d), cfg, (F.col("n_cols") >= F.col("cfg_min_cols")) & (F.col("flatness") <= F.col("cfg_max_flatness")))
    return G.rank(trials, "f1", 5)


_SWEPT = {f"{v}={x}": f"{v} {o} {x}" for v, o, xs in (("n_cols", ">=", (3.0, 9.0, 40.0)), ("flatness", "<=", (0.2, 0.5))) for x in xs}


def _moved():
    return {n: G.passes([(f, o, float(x))]) for n, c in _SWEPT.items() for f, o, x in (c.split(),)}


@query(_pooled_sql(_SWEPT) + "select split_part(strategy, '=', 1) as variable, cast(split_part(strategy, '=', 2) as double) as value, st.* exclude (strategy) from st")
def one_at_a_time_sweep(spark, d):
    """M6: one variable moves at a time, the others stay open; event metrics."""
    out = G.strategies(*_sides(spark, d), _moved())
    return out.select(F.split_part("strategy", F.lit("="), F.lit(1)).alias("variable"), F.split_part("strategy", F.lit("="), F.lit(2)).cast("double").alias("value"), *(c for c in out.columns if c != "strategy"))


_SWEPT_SQL = (
    RECURSIVE_SQL
    + ", sw as ("
    + " union all ".join(f"select '{n}' as strategy, session, channel, event_id, t0_us, t1_us from sdet where {c}" for n, c in _SWEPT.items())
    + f"), sg as (select strategy, channel, gt.* from gt, (select unnest([0, 1]) as channel), (select unnest({list(_SWEPT)}) as strategy))"
    + greedy_sql("strategy, session, channel", "sg", "sw")
    + """, n as (select strategy, sum(g) as n_gt, sum(p) as n_pred, sum(m) as tp from (
  select strategy, 1 as g, 0 as p, 0 as m from sg union all select strategy, 0, 1, 0 from sw union all select strategy, 0, 0, 1 from gm) group by all),
c as (select strategy, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_gt - tp as bigint) as fn from n) select *, """
    + MATCHING_SQL
    + " from c"
)


@query(_SWEPT_SQL)
def matching_sweep(spark, d):
    """The same points by greedy one-to-one matches of each session and channel."""
    det, gt = _sides(spark, d)
    gt = gt.select("session", "event_id", "t0_us", "t1_us", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    return G.matching_sweep(det, gt, _moved())


_BOUT_CALLS = SQL + BOUTS_SQL + ", bs as (select session, bout_id, min(t0_us) as start_us, max(t1_us) as stop_us from bc group by all)"
_HIT = "p.t0_us < c.t1_us and p.t1_us > c.t0_us and c.t1_us > c.t0_us and p.t1_us > p.t0_us"


def _bouts(spark, d):
    from chirpline.operators.intervals import bouts

    calls = bouts(V.ground_truth(spark, d), ["session"], V.GAP_US, ["event_id"])
    return calls, calls.groupBy("session", "bout_id").agg(F.min("t0_us").alias("start_us"), F.max("t1_us").alias("stop_us"))


@query(_BOUT_CALLS + f"""select b.session, b.bout_id, p.event_id,
  case when exists (select 1 from bc c where c.session = p.session and c.bout_id = b.bout_id and {_HIT}) then 'in_bout'
       when exists (select 1 from bc c where c.session = p.session and c.bout_id <> b.bout_id and {_HIT}) then 'other_call' else 'fp' end as relation
from bs b join pred p on p.session = b.session and p.t1_us >= b.start_us - 600000000 and p.t0_us <= b.stop_us + 600000000""")
def bout_relation(spark, d):
    """Detections in the context of each bout, by what they hit."""
    calls, spans = _bouts(spark, d)
    return C.bout_relation(V.predictions(spark, d), spans, calls, 600_000_000)


_CROP = "cast(greatest(0, floor(x1 - 0.1 * (x2 - x1))) as int) as cx0, cast(greatest(0, floor(y1 - 0.1 * (y2 - y1))) as int) as cy0, cast(least(120, ceil(x1 + (x2 - x1) + 0.1 * (x2 - x1))) as int) as cx1, cast(least(80, ceil(y1 + (y2 - y1) + 0.1 * (y2 - y1))) as int) as cy1"


@query(SQL + f", cr as (select *, {_CROP} from box) select case when score < 10000 then 'low_score' when l_partkey % 17 = 0 then 'missing_png' when cx1 - cx0 < 8 or cy1 - cy0 < 8 then 'small_crop' else 'keep' end as reason, count(*) as n from cr group by 1")
def crop_skips(spark, d):
    """Crops counted by the reason they are skipped for."""
    from chirpline.functions.intervals import crop_box

    b = V.boxes(spark, d)
    crop = crop_box((F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(80), F.lit(120), 0.1)
    b = b.select("*", *(c.alias(n) for c, n in zip(crop, ("cx0", "cy0", "cx1", "cy1"))))
    return G.reason_counts(b, G.skip_reason(("cx0", "cy0", "cx1", "cy1"), 8, 10000.0, F.col("l_partkey") % 17 == 0))
