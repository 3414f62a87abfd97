"""Queries: matching, suppression, attribution, samples, shards, vectors, budgets, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.functions import intervals as boxes
from chirpline.operators import budget as B
from chirpline.operators import latents as L
from chirpline.operators import matching as M
from chirpline.operators import scoring as S
from chirpline.plans import views as V
from chirpline.plans.scoring import _METHODS, _by_method, _counts_sql
from chirpline.plans.views import METRICS_SQL, SQL, hit_sql, merged_sql
from chirpline.sources import readers, writers
from chirpline.sources.shared import shared_dir
from chirpline.streaming import live

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


def _per_channel(spark, d):
    gt = V.ground_truth(spark, d).select("session", "event_id", "t0_us", "t1_us", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    return gt, V.predictions(spark, d)


_IOU = "(least(g.t1_us, p.t1_us) - greatest(g.t0_us, p.t0_us)) / (greatest(g.t1_us, p.t1_us) - least(g.t0_us, p.t0_us))::double"
#: Pairs of a session and channel, best first, taken one by one while both ends are free.
_GREEDY = (
    SQL.replace("with iv", "with recursive iv", 1)
    + f""", gc as (select gt.*, channel from gt, (select unnest([0, 1]) as channel)),
pr as (
  select g.session, g.channel, g.event_id as g, p.event_id as p, {_IOU} as iou,
         row_number() over (partition by g.session, g.channel order by {_IOU} desc, g.t0_us desc, g.t1_us desc, g.event_id desc, p.t0_us desc, p.t1_us desc, p.event_id desc) as k
  from gc g join pred p on g.session = p.session and g.channel = p.channel and p.t0_us < g.t1_us and p.t1_us > g.t0_us and g.t1_us > g.t0_us and p.t1_us > p.t0_us),
walk as (
  select distinct session, channel, 0::bigint as k, null::bigint as g, null::bigint as p, null::double as iou, []::bigint[] as gs, []::bigint[] as ps from pr
  union all
  select w.session, w.channel, pr.k, case when free then pr.g end, case when free then pr.p end, pr.iou, case when free then list_append(gs, pr.g) else gs end, case when free then list_append(ps, pr.p) else ps end
  from walk w join pr on pr.session = w.session and pr.channel = w.channel and pr.k = w.k + 1, lateral (select not list_contains(gs, pr.g) and not list_contains(ps, pr.p) as free)),
gm as (select session, channel, g as gt_id, p as pred_id, iou from walk where g is not null)
"""
)


@query(_GREEDY + "select * from gm")
def greedy_matches(spark, d):
    return M.greedy_match(*_per_channel(spark, d), ["session", "channel"])


@query(_GREEDY + """, n as (select session, channel, sum(g) as n_gt, sum(p) as n_pred, sum(m) as tp from (
  select session, channel, 1 as g, 0 as p, 0 as m from gc union all select session, channel, 0, 1, 0 from pred union all select session, channel, 0, 0, 1 from gm) group by all),
c as (select session, channel, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_gt - tp as bigint) as fn from n)
select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as "precision", coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall, case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end as f1 from c""")
def matching_score(spark, d):
    return M.matching_score(*_per_channel(spark, d), ["session", "channel"])


_KEY = ["l_linenumber", "l_partkey", "l_suppkey"]


@query(SQL.replace("with iv", "with recursive iv", 1) + """, bx as (select *, row_number() over (partition by chunk_id order by score desc, l_linenumber, l_partkey, l_suppkey) as k from box),
walk as (
  select distinct chunk_id, 0::bigint as k, false as stays, []::struct(x1 double, y1 double, x2 double, y2 double)[] as kept from bx
  union all
  select w.chunk_id, b.k, free, case when free then list_append(kept, {'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}) else kept end
  from walk w join bx b on b.chunk_id = w.chunk_id and b.k = w.k + 1, lateral (select len(list_filter(kept, lambda o:
    coalesce(greatest(0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0, least(b.y2, o.y2) - greatest(b.y1, o.y1))
      / nullif((b.x2 - b.x1) * (b.y2 - b.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0, least(b.y2, o.y2) - greatest(b.y1, o.y1)), 0), 0) > 0.3)) = 0 as free))
select b.* exclude (k) from walk w join bx b using (chunk_id, k) where stays""")
def box_suppression(spark, d):
    return M.suppress(V.boxes(spark, d), ["chunk_id"], 0.3, _KEY)


@query(SQL + """select a.* from box a where not exists (
  select 1 from box b where b.chunk_id = a.chunk_id and (b.x2 - b.x1) * (b.y2 - b.y1) > (a.x2 - a.x1) * (a.y2 - a.y1) and (a.x2 - a.x1) * (a.y2 - a.y1) > 0
    and greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1)) > 0.5)""")
def box_containment(spark, d):
    return M.drop_contained(V.boxes(spark, d), ["chunk_id"], _KEY)


@query(SQL + """, g as (select vox_idx, count(*) as n, min(snr) as least, arg_max(channel, (snr, power, l_partkey, l_suppkey)) as by_snr, arg_max(channel, (power, snr, l_partkey, l_suppkey)) as by_power from cpow group by vox_idx),
r as (select *, case when n = 1 then 'single' when least = 0 then 'power' else 'snr' end as rule from g) select vox_idx, case when rule = 'power' then by_power else by_snr end as channel, rule from r""")
def channel_attribution(spark, d):
    return M.attribute_channel(V.channel_power(spark, d), "vox_idx", ["l_partkey", "l_suppkey"])


@query(SQL + "select chunk_id, l_linenumber, l_partkey, l_suppkey, score, cast(row_number() over (partition by chunk_id order by score desc, l_linenumber, l_partkey, l_suppkey) as int) as rank from box qualify rank <= 3")
def topk_candidates(spark, d):
    got = M.top_k(V.boxes(spark, d), ["chunk_id"], 3, F.col("score").desc(), _KEY)
    return got.select("chunk_id", *_KEY, "score", "rank")


@query(SQL + """, b as (select *, x2 - x1 as w, y2 - y1 as h, least(62500.0, (199 - y1) / 199.0 * 62500.0) as f_high, greatest(0.0, (199 - y2) / 199.0 * 62500.0) as f_low from box)
select chunk_id, l_linenumber, l_partkey, l_suppkey, h / greatest(w, 1) as aspect, w * h / 2 / greatest(w * h, 1) as solidity, w * h / 2 / 60000.0 as area_frac, f_low, f_high, f_high - f_low as f_band, w / 300.0 as duration from b""")
def component_features(spark, d):
    """Shape, band and length of boxes in images of 200 by 300 pixels and one second."""
    from chirpline.functions import intervals as I

    b = V.boxes(spark, d)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    got = I.component_features((F.col("x1"), F.col("y1"), w, h), w * h / 2, F.lit(200.0), F.lit(300.0), F.lit(62500.0), F.lit(0.0), F.lit(1.0))
    return b.select("chunk_id", *_KEY, *(c.alias(n) for n, c in got.items()))


@query(SQL + "select chunk_id, max({'d': x2 - x1, 's': score})['s'] as score, max({'d': x2 - x1, 's': score})['d'] as duration from box where x2 - x1 >= 5 group by chunk_id")
def best_event(spark, d):
    b = V.boxes(spark, d).select("chunk_id", "score", (F.col("x2") - F.col("x1")).alias("duration"))
    return M.best_event(b, ["chunk_id"], "duration", "score", 5.0)


@query("""with t as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place, count(*) over () as total from orders)
select o_orderkey, place, cast(floor(place / 128) as bigint) as shard from t where floor(place / 128) < floor(total / 128) or floor(total / 128) = 0""")
def equal_shards(spark, d):
    return M.equal_shards(V.table(spark, d, "orders").select("o_orderkey"), 128, ["o_orderkey"])


@query(SQL + "select event_id, event_type from (select *, row_number() over (partition by event_type order by md5('5|' || event_id), event_id) as n from iv) where event_type not in ('click', 'view') or n <= 100")
def capped_sample(spark, d):
    iv = V.intervals(spark, d).select("event_id", "event_type")
    return M.capped_sample(iv, "event_type", ["click", "view"], 100, 5, "event_id")


@query(SQL + "select session from (select distinct session from iv) order by md5('5|' || session), session limit 8")
def sampled_sessions(spark, d):
    return M.sample_rows(V.intervals(spark, d).select("session").distinct(), 8, 5, "session")


@query(SQL + """, e as (
  select 0 as place, 'n_cols_min' as why, arg_min(k, (n_cols, k)) as k from (select *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey as k from det) union all
  select 1, 'n_cols_max', arg_max(k, (n_cols, k)) from (select *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey as k from det) union all
  select 2, 'centroid_hz_min', arg_min(k, (centroid_hz, k)) from (select *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey as k from det) union all
  select 3, 'centroid_hz_max', arg_max(k, (centroid_hz, k)) from (select *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey as k from det))
select arg_min(why, place) as why, k from e group by k""")
def diverse_examples(spark, d):
    k = (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("k")
    return M.diverse_examples(V.detections(spark, d).select(k, "n_cols", "centroid_hz"), ["n_cols", "centroid_hz"], "k").select("why", "k")


# vectors

_DIM = SQL + ", z as (select vec_id, cluster_id, confidence, paired_vec_id, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double as x from lat), cd as (select cluster_id, dim, avg(x) as m, count(*) as n from z group by all)"
_OWN = ", own as (select z.vec_id, z.cluster_id, sqrt(sum((x - m) * (x - m))) as distance from z join cd using (cluster_id, dim) group by all)"


@query(_DIM + "select cluster_id, cast(dim as int) as dim, n, round(m, 9) as m from cd")
def centroids(spark, d):
    c = L.centroids(V.latents(spark, d))
    return c.select("cluster_id", "n", F.posexplode("centroid").alias("dim", "m")).withColumn("m", F.round("m", 9))


@query(_DIM + ", ds as (select z.vec_id, z.cluster_id, cd.cluster_id as c, sqrt(sum((x - m) * (x - m))) as dist from z join cd using (dim) group by all) select vec_id, cluster_id, arg_min(c, (dist, c)) as nearest, round(min(dist), 6) as distance from ds group by all")
def nearest_centroid(spark, d):
    lat = V.latents(spark, d)
    return L.nearest_centroid(lat.select("vec_id", "cluster_id", "embedding"), L.centroids(lat)).withColumn("distance", F.round("distance", 6))


@query(_DIM + _OWN + "select cluster_id, round(quantile_cont(distance, 0.95), 6) as threshold from own group by cluster_id")
def centroid_gate_threshold(spark, d):
    lat = V.latents(spark, d)
    return L.gate_threshold(lat, L.centroids(lat)).withColumn("threshold", F.round("threshold", 6))


@query(_DIM + _OWN + "select cluster_id, arg_min(vec_id, (round(distance, 9), vec_id)) as vec_id, round(min(distance), 6) as distance from own group by cluster_id")
def medoids(spark, d):
    return L.medoids(V.latents(spark, d)).withColumn("distance", F.round("distance", 6))


@query(SQL + "select vec_id, cluster_id, confidence, count(*) over (partition by cluster_id) as n from lat qualify row_number() over (partition by cluster_id order by confidence desc, vec_id) = 1")
def exemplars(spark, d):
    return L.exemplars(V.latents(spark, d).select("vec_id", "cluster_id", "confidence"))


@query(_DIM + ", p as (select a.cluster_id as a, b.cluster_id as b, sqrt(sum((a.m - b.m) * (a.m - b.m))) as dist from cd a join cd b on a.dim = b.dim and a.cluster_id <> b.cluster_id where b.cluster_id in (select cluster_id from lat where confidence < 500) group by all) select a as cluster_id, arg_min(b, (dist, b)) as other, round(min(dist), 6) as distance from p group by a")
def nearest_other_cluster(spark, d):
    lat = V.latents(spark, d)
    return L.nearest_other(L.centroids(lat), lat.where("confidence < 500")).withColumn("distance", F.round("distance", 6))


@query(SQL + "select cast(k as int) as cluster_id from range(15) t(k) where k not in (select cluster_id from lat)")
def missing_clusters(spark, d):
    return L.missing_clusters(V.latents(spark, d), 15)


_PAIRS = _DIM + ", pz as (select a.vec_id, a.dim, a.x as a, b.x as b from z a join z b on b.vec_id = a.paired_vec_id and b.dim = a.dim)"


@query(_PAIRS + "select cast(dim as int) as dim, round(corr(a, b), 6) as r, round(var_pop(a), 9) as variance from pz group by dim")
def pearson_by_dim(spark, d):
    return L.pearson_by_dim(L.paired(V.latents(spark, d))).select("dim", F.round("r", 6).alias("r"), F.round("variance", 9).alias("variance"))


@query(_PAIRS + ", v as (select dim, corr(a, b) as r, var_pop(a) as variance from pz group by dim) select round(sum(r * variance) / sum(variance), 6) as weighted_r, round(avg(r) filter (variance > 0.01), 6) as active_r, count(*) filter (variance > 0.01) as n_active from v")
def weighted_correlation(spark, d):
    got = L.weighted_r(L.pearson_by_dim(L.paired(V.latents(spark, d))))
    return got.select(F.round("weighted_r", 6).alias("weighted_r"), F.round("active_r", 6).alias("active_r"), "n_active")


@query(_PAIRS + ", w as (select vec_id, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) as cosine, sum((a - b) * (a - b)) / count(*) as mse from pz group by vec_id) select round(avg(cosine), 6) as cosine_mean, round(median(cosine), 6) as cosine_median, round(avg(mse), 6) as mse_mean, round(median(mse), 6) as mse_median from w")
def arm_agreement(spark, d):
    got = L.agreement(L.paired(V.latents(spark, d)))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query(_DIM + ", v as (select dim, var_pop(x) as variance from z group by dim), s as (select *, coalesce(sum(variance) over (order by variance desc, dim rows between unbounded preceding and 1 preceding), 0) as upto, sum(variance) over () as total from v) select cast(dim as int) as dim, round(variance, 9) as variance, variance > 0.01 as active, upto < 0.99 * total as in_set from s")
def active_dims(spark, d):
    return L.active_dims(V.latents(spark, d)).withColumn("variance", F.round("variance", 9))


@query()
def cluster_separation(spark, d):
    return L.cluster_separation(V.latents(spark, d), [4, 8, 12])


@query()
def kmeans_medoids(spark, d):
    return L.kmeans_medoids(V.latents(spark, d), 10)


@query(SQL + "select quantile_cont(n_cols, 0.02) as n_cols_lo, quantile_cont(n_cols, 0.98) as n_cols_hi, quantile_cont(centroid_hz, 0.02) as centroid_hz_lo, quantile_cont(centroid_hz, 0.98) as centroid_hz_hi from det")
def robust_range(spark, d):
    return L.robust_range(V.detections(spark, d), ["n_cols", "centroid_hz"])


@query()
def shallow_models(spark, d):
    det = V.detections(spark, d).select("session_no", "n_cols", "flatness", "sweep_frac", "centroid_hz", (F.col("label") == "tp").cast("double").alias("y"))
    return L.shallow_models(det.where("session_no % 4 <> 0"), det.where("session_no % 4 = 0"), ["n_cols", "flatness", "sweep_frac", "centroid_hz"])


# budgets and sets


@query(_METHODS + ", me as (select distinct method from cnt) select a.method as a, b.method as b from me a join me b on a.method < b.method")
def method_pairs(spark, d):
    return B.method_pairs(_by_method(spark, d))


@query(_METHODS + f", c as (select *, {METRICS_SQL} from cnt) select * from c where session in (select session from c group by session having count(distinct method) = (select count(distinct method) from c))")
def common_sessions(spark, d):
    return B.common_sessions(_by_method(spark, d))


#: Two hundred trials of 5, 10 and 20 sessions that every method has.
_TRIALS = (
    _METHODS
    + f""", com as (select session from cnt group by session having count(distinct method) = (select count(distinct method) from cnt)),
num as (select session, row_number() over (order by session) - 1 as i from com),
dr as (select size, trial, cast('0x' || substr(md5('0|' || size || '|' || trial || '|' || draw), 1, 13) as bigint) % (select count(*) from num) as i
       from (select size, trial, unnest(range(1, size + 1)) as draw from (select unnest([5, 10, 20]) as size), range(200) t(trial))),
tm as (select size, trial, session, count(*) as times from dr join num using (i) group by all),
ps as (select method, size, trial, {', '.join(f'sum({c} * times) as {c}' for c in ('tp', 'fn', 'pred_tp', 'fp'))} from cnt join tm using (session) group by all),
tr as (select *, {METRICS_SQL} from ps)
"""
)


@query(_TRIALS + "select method, size, " + ", ".join(f'quantile_cont("{m}", {q}) as {m}_{n}' for m in ("recall", "precision") for n, q in (("lo", 0.025), ("med", 0.5), ("hi", 0.975))) + " from tr group by method, size")
def bootstrap_intervals(spark, d):
    return B.bootstrap(B.common_sessions(_by_method(spark, d)), [5, 10, 20], 200)


@query(_TRIALS + """, df as (select size, trial, max(case when method = 'm_click' then f1 end) - max(case when method = 'm_view' then f1 end) as d from tr group by all),
q as (select size, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from df group by size) select *, lo > 0 or hi < 0 as excludes_zero from q""")
def bootstrap_difference(spark, d):
    return B.bootstrap_difference(B.common_sessions(_by_method(spark, d)), "m_click", "m_view", [5, 10, 20], 200)


def _totals(spark, d):
    return S.micro(_by_method(spark, d), ["method"]).select("method", *S.COUNTS)


@query()
def budget_intervals(spark, d):
    t = _totals(spark, d)
    both = [B.budget_intervals(t, [50, 200, 1000], method=m).withColumn("interval", F.lit(m)) for m in B.METHODS]
    return both[0].unionByName(both[1])


@query()
def first_stable_budget(spark, d):
    return B.first_stable(B.budget_intervals(_totals(spark, d), [50, 100, 200, 500, 1000, 2000]), 0.05)


def _sizing_sql(v: str) -> str:
    k = f"(2 * {v} / {0.05**2})"
    n = f"greatest({k}, 10.0)"
    for i in range(8):
        n = f"n{i}"
    steps = [f"s0 as (select method, {k} as k, greatest({k}, 10.0) as n from v)"] + [f"s{i} as (select method, k, k * (ln({1 / 0.05}) + 0.5 * ln(greatest(n, 1.0)) + 0.226) as n from s{i - 1})" for i in range(1, 9)]
    return ", ".join(steps) + " select method, round(n, 4) as n from s8"


@query(_METHODS + ", v as (select method, sum(tp) / sum(n_gt)::double * (1 - sum(tp) / sum(n_gt)::double) as s from cnt group by method), " + _sizing_sql("s"))
def sizing_formula(spark, d):
    r = F.col("tp") / F.col("n_gt")
    return _totals(spark, d).select("method", F.round(B.sizing(r * (1 - r), 0.05, 0.05), 4).alias("n"))


@query(SQL + "select method, session, count(*) as n from predm group by all union all select 'truth', session, count(*) from gt group by all")
def tagged_union(spark, d):
    """Channels pooled, methods and truth stacked with a tag."""
    both = V.predictions(spark, d, True).drop("channel").unionByName(V.ground_truth(spark, d).withColumn("method", F.lit("truth")), allowMissingColumns=True)
    return both.groupBy("method", "session").agg(F.count(F.lit(1)).alias("n"))


@query(SQL + "select session, 'both' as side from (select session from gt intersect select session from pred) union all select session, 'train' from (select session from pred except select session from pred where session like '%/idx_001')")
def session_sets(spark, d):
    """Sessions of both sides; all but those of a held-out fold."""
    g, p = V.ground_truth(spark, d).select("session"), V.predictions(spark, d).select("session")
    train = p.distinct().join(p.where(F.col("session").endswith("/idx_001")).distinct(), "session", "left_anti")
    return g.intersect(p).withColumn("side", F.lit("both")).unionByName(train.withColumn("side", F.lit("train")))


# provenance, splits, stacks


@query(SQL + f""", lb as (select event_id, session, score, case when session in (select session from gt) then case when {hit_sql('pred', 'gt')} then 'tp' else 'fp' end end as label from pred)
select vec_id, cluster_id, session, score, label from lat join lb on event_id = vec_id""")
def latents_with_features(spark, d):
    """Latents beside the score and verdict of the detection they were cut from."""
    labelled = S.label_detections(V.predictions(spark, d), V.ground_truth(spark, d)).select(F.col("event_id").alias("vec_id"), "session", "score", "label")
    return L.with_features(V.latents(spark, d).select("vec_id", "cluster_id"), labelled, ["vec_id"])


@query(SQL + "select source, cluster_id, count(*) as n from (select 'even' as source, cluster_id from lat where vec_id % 2 = 0 union all select 'odd', cluster_id from lat where vec_id % 2 = 1) group by all")
def stacked_latents(spark, d):
    """Two latent sets with a tag."""
    lat = V.latents(spark, d)
    return L.stacked({"even": lat.where("vec_id % 2 = 0"), "odd": lat.where("vec_id % 2 = 1")}).groupBy("source", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query(SQL + "select vec_id, case when row_number() over (order by md5('3|' || vec_id), vec_id) - 1 < greatest(1, floor(count(*) over () * 0.2)) then 'val' else 'train' end as part from lat")
def train_validation_split(spark, d):
    """M11."""
    return L.split_rows(V.latents(spark, d).select("vec_id"), 0.2, "vec_id", 3)


@query(SQL + ", s as (select sum(len(list_filter(embedding, lambda x: x > 0))) as pos, sum(len(list_filter(embedding, lambda x: not x > 0))) as neg from lat) select cast(pos as double) as pos, cast(neg as double) as neg, least(neg / greatest(pos, 1.0), 20.0) as weight from s")
def imbalance_weight(spark, d):
    """A27, with the positive components as the mask."""
    return L.imbalance_weight(V.latents(spark, d).select(F.transform("embedding", lambda x: (x > 0).cast("int")).alias("mask")), "mask")


# written and read again


@query(SQL + _counts_sql() + f"select session, n_gt, n_pred, tp, pred_tp, fp, fn, recall, \"precision\", f1, 'm' as method from (select *, {METRICS_SQL} from cnt)")
def metrics_written_and_read(spark, d):
    """Session scores as CSV."""
    path = shared_dir(spark, "metrics")
    writers.write_csv(S.score_sessions(V.ground_truth(spark, d), V.predictions(spark, d)), path)
    return readers.read_metrics(spark, path, "m").select("session", "n_gt", "n_pred", "tp", "pred_tp", "fp", "fn", "recall", "precision", "f1", "method")


@query(SQL + "select session, name, t0_us, t1_us from gtall")
def truth_written_and_read(spark, d):
    """Ground truth as CSV per session."""
    path = shared_dir(spark, "truth")
    writers.write_gt(V.ground_truth(spark, d, None), path)
    return readers.read_gt(spark, path)


def _write_documents(spark, d) -> str:
    p = V.predictions(spark, d).where("t1_us > t0_us")
    at = p.withColumn("chunk", F.floor((F.col("t0_us") - V.CHUNK0_US) / V.CHUNK_US)).withColumn("image_key", F.col("chunk").cast("string"))
    width, span = 1000, V.CHUNK_US / 1e6
    start = F.col("chunk") * span
    images = at.select("session", "channel", "image_key", F.concat(F.lit("chunk_"), "image_key", F.lit(".png")).alias("file_name"), F.lit(width).alias("width"), F.lit(80).alias("height"), start.alias("window_start_sec"), (start + span).alias("window_end_sec")).distinct()
    x = ((F.col("t0_us") - V.CHUNK0_US) / 1e6 - start) / span * width
    boxes = at.select("session", "channel", "image_key", x.alias("x"), F.lit(0.0).alias("y"), ((F.col("t1_us") - F.col("t0_us")) / 1e6 / span * width).alias("w"), F.lit(10.0).alias("h"), "score")
    path = shared_dir(spark, "documents")
    writers.write_documents(images, boxes, path)
    return path


@query(SQL + f"select session, channel, t0_us - {V.CHUNK0_US} as t0_us, t1_us - {V.CHUNK0_US} as t1_us, score from pred where t1_us > t0_us")
def documents_written_and_read(spark, d):
    """Detections as documents per session and channel, and back from boxes to times."""
    return readers.read_detections(spark, _write_documents(spark, d)).select("session", "channel", "t0_us", "t1_us", "score")


@query(SQL + f"select (t0_us - {V.CHUNK0_US}) / 1e6 as start_seconds, (t1_us - {V.CHUNK0_US}) / 1e6 as stop_seconds from pred where t1_us > t0_us")
def vox_times_read(spark, d):
    """S6."""
    return readers.vox_table(spark, _write_documents(spark, d))


@query(SQL + _counts_sql() + f", s as (select {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in S.COUNTS)} from cnt) select *, {METRICS_SQL} from s")
def summary_written_and_read(spark, d):
    """K5: the pooled scores as one JSON file."""
    path = shared_dir(spark, "summary")
    scored = S.micro(S.score_sessions(V.ground_truth(spark, d), V.predictions(spark, d)))
    writers.write_summary(scored, path)
    return spark.read.schema(scored.schema).json(path)


@query(SQL + "select vec_id, cluster_id, len(embedding) as dims from lat where vec_id % 3 = 1")
def latents_written_and_read(spark, d):
    """The latents of one cohort."""
    path = shared_dir(spark, "latents")
    V.latents(spark, d).withColumn("cohort", F.concat(F.lit("c"), F.col("vec_id") % 3)).write.parquet(path)
    return readers.read_latents(spark, path, "c1").select("vec_id", "cluster_id", F.size("embedding").cast("long").alias("dims"))


@query(SQL + "select vec_id, list_max(list_transform(embedding, lambda x: case when x > 0 then x else 0 end)) as top, cast(len(list_filter(embedding, lambda x: x > 0)) as bigint) as kept from lat")
def masked_arms(spark, d):
    """The masked arm of the latents, with the positive components as the mask."""
    arms = L.masked_arms(V.latents(spark, d).withColumn("mask", F.transform("embedding", lambda x: (x > 0).cast("int"))), "embedding")
    return arms.select("vec_id", F.array_max("masked").cast("float").alias("top"), F.size(F.filter("masked", lambda x: x != 0)).cast("long").alias("kept"))


@query(SQL + """select chunk_id, l_linenumber, l_partkey, l_suppkey, cast(10 * least(greatest(cast(trunc(x2) as int), 0), 99) as double) as at, (x1 + (x2 - x1) / 2) / 200 as cx, (y1 + (y2 - y1) / 2) / 100 as cy, (x2 - x1) / 200 as w, (y2 - y1) / 100 as h, score / 1000 as khz from box""")
def box_axes(spark, d):
    """A box's end on an axis of 100 places, its centre and size as shares, and a pitch in kHz."""
    b = V.boxes(spark, d)
    axis = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (i * 10).cast("double"))
    cx, cy, w, h = boxes.xywh_to_center(boxes.xyxy_to_xywh(("x1", "y1", "x2", "y2")), F.lit(200), F.lit(100))
    return b.select("chunk_id", *_KEY, boxes.axis_lookup(axis, "x2").alias("at"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), boxes.to_khz("score").alias("khz"))


@query(SQL + ", c as (select *, score / 100000 * (1 - (x2 - x1) / 50) as value from box) select chunk_id, l_linenumber, l_partkey, l_suppkey, value from c where value > 0 qualify row_number() over (partition by chunk_id order by value desc, l_linenumber, l_partkey, l_suppkey) = 1")
def best_candidates(spark, d):
    """The candidate of the brightest and least filled box of each chunk."""
    c = V.boxes(spark, d).withColumns({"mean_response": F.col("score") / 100000, "extent": (F.col("x2") - F.col("x1")) / 50})
    return M.best_candidate(c.withColumn("value", M.candidate_score()), ["chunk_id"], "value", _KEY).select("chunk_id", *_KEY, "value")


@query("with t as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place, count(*) over () as total from orders) select shard, count(*) as n from (select floor(place / 128) as shard from t where floor(place / 128) < floor(total / 128) or floor(total / 128) = 0) group by shard")
def shards_written_and_read(spark, d):
    """K4: shards of exactly 128 rows."""
    path = shared_dir(spark, "shards")
    writers.write_shards(V.table(spark, d, "orders").select("o_orderkey"), 128, ["o_orderkey"], path)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("double").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


# streams: the tables as a stream, each query run until its input is used up


def _streamed(spark, df, operator):
    """The complete result of a streaming operator over a table's rows."""
    source, out = shared_dir(spark, "stream-source"), shared_dir(spark, "stream-result")
    live.with_time(df).write.parquet(source)
    stream = operator(spark.readStream.schema(live.with_time(df).schema).parquet(source))
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", shared_dir(spark, "stream-state")).trigger(availableNow=True)
    run.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


@query(SQL + ", pos as (select * from pred where t1_us > t0_us)" + merged_sql("ev", "pos", "session") + "select session, t0_us, t1_us, n_boxes from ev")
def live_merged_events(spark, d):
    """L1."""
    return _streamed(spark, V.predictions(spark, d).select("session", "t0_us", "t1_us"), lambda s: live.live_merge(s, ["session"]))


@query(SQL + f"select session, t0_us // {V.CHUNK_US} * {V.CHUNK_US} as t0_us, count(*) as n from pred group by all")
def live_chunk_counts(spark, d):
    """L3."""
    return _streamed(spark, V.predictions(spark, d).select("session", "t0_us", "t1_us"), lambda s: live.live_counts(s, ["session"], "6 hours"))
