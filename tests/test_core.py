"""Operators on literal cases, against plain Python, and against each other."""

import json
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chirpline.functions import intervals as FI
from chirpline.operators import budget, curves, gates, latents, matching, scoring, signal
from chirpline.operators import intervals as I
from chirpline.sources import readers, writers
from chirpline.streaming import live

S = 1_000_000


def iv(spark, rows, session="s", **more):
    df = spark.createDataFrame([(i, int(a * S), int(b * S)) for i, (a, b) in enumerate(rows)], "event_id long, t0_us long, t1_us long")
    return df.selectExpr("*", f"'{session}' as session", *(f"{v} as {k}" for k, v in more.items()))


def one(spark, gt, pred, **k):
    return scoring.score_sessions(iv(spark, gt), iv(spark, pred, score="1.0"), **k).first()


def events(spark, rows, **k):
    return [(r.t0_us / S, r.t1_us / S) for r in I.merge_intervals(iv(spark, rows), ["session"], **k).orderBy("t0_us").collect()]


def test_merge(spark):
    assert events(spark, [(0, 1), (1, 2)]) == [(0, 2)]
    assert events(spark, [(0, 1), (1, 2)], strict=True) == [(0, 1), (1, 2)]
    assert events(spark, [(0, 10), (2, 3), (9, 12)]) == [(0, 12)]
    r = random.Random(1)
    rows = [(a := r.randrange(2000), a + r.randrange(12)) for _ in range(300)]
    want = []
    for a, b in sorted(rows):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]))
        else:
            want.append((a, b))
    assert events(spark, rows) == want == events(spark, rows[::-1], bucket_us=37 * S)
    assert events(spark, want) == want


def test_scoring_cases(spark):
    assert (lambda r: (r.tp, r.fn, r.pred_tp, r.fp))(one(spark, [(0, 1)], [(1, 2)])) == (0, 1, 0, 1)
    assert (lambda r: (r.fn, r.fp))(one(spark, [(5, 5)], [(4, 6)])) == (1, 1)
    r = one(spark, [(0, 10)], [(0, 2), (3, 5), (6, 8)])
    assert (r.tp, r.pred_tp, r.precision) == (1, 3, 1.0)
    r = one(spark, [(0, 10)], [(0, 6), (6, 10)], iou=0.7)
    assert (r.recall, r.precision) == (0.0, 1.0)
    r = one(spark, [(0, 1)], [(3, 4)])
    assert r.f1 is None and r.recall == 0
    nothing = scoring.counts(iv(spark, [(0, 1)] * 3), iv(spark, [(0, 1)]).limit(0), ["session"]).withColumns(scoring.event_metrics()).first()
    assert nothing.fn == 3 and nothing.precision is None
    scored = iv(spark, [(0, 1)], score="cast(null as double)")
    assert scoring.keep_scored(scored, 0.0).count() == 0 and scoring.keep_scored(scored, 0.5, default=1.0).count() == 1


def test_overlap_forms_agree(spark):
    r = random.Random(5)
    rows = lambda n: [(a := r.randrange(500) / 2, a + r.choice((0, 0.5, 1, 3, 40))) for _ in range(n)]
    a, b = iv(spark, rows(150)), iv(spark, rows(120))
    plain = {x.event_id for x in a.alias("a").crossJoin(b.alias("b")).where("a.t0_us < b.t1_us and a.t1_us > b.t0_us and a.t1_us > a.t0_us and b.t1_us > b.t0_us").select("a.event_id").collect()}
    asof = {x.event_id for x in I.overlap_flag_asof(a, b, ["session"]).where("hit").collect()}
    for bucket in (S, 17 * S, 10**9):
        assert {x.event_id for x in I.overlap_flag_asof(a, b, ["session"], bucket_us=bucket).where("hit").collect()} == plain
        assert {x.event_id for x in I.overlap_flag(a, b, ["session"], ["event_id"], bucket_us=bucket).where("hit").collect()} == plain == asof


def test_bouts(spark):
    calls = I.bouts(iv(spark, [(0, 10), (1, 2), (2.5, 3)]), ["session"], int(0.25 * S), ["event_id"]).orderBy("t0_us").collect()
    assert [c.bout_id for c in calls] == [0, 0, 1]
    b = scoring.score_bouts(iv(spark, [(0, 1), (2, 3)]), iv(spark, [(0, 3)], score="1.0"), S).first()
    assert (b.tp, b.n_pred_events, b.merge_ratio, b.mean_ici_us) == (2, 1, 0.5, S)
    both = scoring.score_bouts(iv(spark, [(0, 1), (10, 11)]), iv(spark, [(0, 11)], score="1.0"), S).collect()
    assert [x.tp for x in both] == [1, 1]
    n = spark.createDataFrame([(i,) for i in (1, 3, 6, 9, 0)], "n int").select(scoring.size_bin("n", [1, 2, 4, 7]).alias("b"))
    assert [x.b for x in n.collect()] == ["1", "2-3", "4-6", "7+", "1"]


def test_chunks_and_coverage(spark):
    at = lambda t: spark.range(1).select(I.assign_chunk(F.lit(t), 0, 10, 5).alias("c")).first().c
    assert (at(-3), at(0), at(10), at(49), at(500)) == (0, 0, 1, 4, 4)
    spans = spark.createDataFrame([("s", 0, 10 * S)], "session string, cov0_us long, cov1_us long")
    assert scoring.in_coverage(iv(spark, [(9, 11), (10, 12)], score="1.0"), spans).count() == 1
    w = spark.createDataFrame([("s", 0), ("s", 10), ("s", 25)], "session string, w_start_us long")
    p = spark.createDataFrame([("s", t) for t in (-5, 0, 9, 10, 99)], "session string, at long")
    assert [x.w_start_us for x in I.assign_window(p, w, ["session"], "at").orderBy("at").collect()] == [0, 0, 0, 10, 25]


def test_runs(spark):
    fr = spark.createDataFrame([("s", i, bool(f)) for i, f in enumerate((1, 1, 0, 1))], "session string, frame long, on boolean")
    got = [(r.t0_us, r.t1_us) for r in I.runs(fr, ["session"], F.col("on"), "frame").orderBy("t0_us").collect()]
    assert got == [(0, 2), (3, 3)]
    assert I.runs(fr, ["session"], F.col("on"), "frame", min_us=1).count() == 1
    assert [(r.t0_us, r.t1_us) for r in I.runs(fr, ["session"], F.col("on"), "frame", gap_us=1).collect()] == [(0, 3)]


def test_matching(spark):
    got = matching.greedy_match(iv(spark, [(0, 2), (2, 4)]), iv(spark, [(1, 3)]), ["session"]).collect()
    assert [(g.gt_id, g.pred_id) for g in got] == [(1, 0)]
    r = random.Random(3)
    rows = lambda n: [(a := r.randrange(300) / 3, a + r.randrange(1, 9)) for _ in range(n)]
    g, p = rows(40), rows(40)
    iou = lambda a, b: max(0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))
    pairs = sorted(((iou(a, b), a, b) for a in g for b in p if iou(a, b) > 0), reverse=True)
    used_g, used_p, n = [], [], 0
    for _, a, b in pairs:
        if used_g.count(a) < g.count(a) and used_p.count(b) < p.count(b):
            used_g.append(a)
            used_p.append(b)
            n += 1
    assert matching.greedy_match(iv(spark, sorted(g)), iv(spark, sorted(p)), ["session"]).count() == n
    box = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 9.0, 10.0, 0.8), (1, 2, 20.0, 0.0, 30.0, 10.0, 0.7), (2, 3, 0.0, 0.0, 9.0, 9.0, 0.5), (1, 4, 1.0, 1.0, 3.0, 3.0, 0.6)], "c int, id int, x1 double, y1 double, x2 double, y2 double, score double")
    kept = matching.suppress(box, ["c"], 0.3, ["id"])
    assert sorted(b.id for b in kept.collect()) == [0, 2, 3, 4]
    assert sorted(b.id for b in matching.drop_contained(kept, ["c"], ["id"]).collect()) == [0, 2, 3]


def test_channel_rules(spark):
    rows = [(1, 0, 5.0, 2.0), (1, 1, 9.0, 1.0), (2, 0, 5.0, 0.0), (2, 1, 9.0, 0.5), (3, 1, 1.0, 1.0)]
    got = {r.v: (r.channel, r.rule) for r in matching.attribute_channel(spark.createDataFrame(rows, "v int, channel int, power double, snr double"), "v").collect()}
    assert got == {1: (0, "snr"), 2: (1, "power"), 3: (1, "single")}


@pytest.mark.parametrize("n,shards,kept", [(300, 2, 256), (100, 1, 100), (256, 2, 256)])
def test_equal_shards(spark, n, shards, kept):
    got = matching.equal_shards(spark.range(n).repartition(7), 128, ["id"]).collect()
    assert len(got) == kept and len({r.shard for r in got}) == shards and all(r.place == r.id for r in got)


def test_gates(spark):
    d = spark.createDataFrame([(0.9, 2, 0.0, 1.0, 0.9), (0.1, 9, 0.5, None, None), (0.1, 9, 0.5, 30000.0, 0.9)], "area_frac double, n_cols int, sweep_frac double, centroid_hz double, flatness double")
    assert [r.x for r in d.select(gates.reason(max_flatness=0.2).alias("x")).collect()] == ["too_big", "keep", "high_flatness"]
    assert [r.x for r in d.select(gates.passes([("centroid_hz", ">", 1.0)]).alias("x")).collect()] == [False, False, True]
    assert d.select(gates.fate({"a": F.col("n_cols") > 5, "b": F.col("centroid_hz") > 5}).alias("x")).collect()[1].x == "b"
    comp = spark.createDataFrame([(1, 100.0), (1, 50.0), (1, 5.0), (2, 40.0)], "image int, area double")
    assert sorted(r.area for r in gates.clean_components(comp, ["image"]).collect()) == [50.0, 100.0]
    rows = [(i % 8, float(i % 10), "tp" if i % 10 > 4 else "fp") for i in range(400)]
    det = spark.createDataFrame(rows, "session_no int, v double, label string")
    # calls of 1 s every 10 s; detections with v > 4 hit one, the others lie between
    det = det.selectExpr("concat('s', session_no) as session", "v", "monotonically_increasing_id() as event_id").withColumns({"t0_us": F.row_number().over(Window.partitionBy("session").orderBy("event_id")) * 10 * S})
    det = det.withColumn("t0_us", F.col("t0_us") + F.when(F.col("v") > 4, 0).otherwise(5 * S)).withColumn("t1_us", F.col("t0_us") + S)
    gt = spark.range(0, 8 * 50).selectExpr("concat('s', id % 8) as session", f"(1 + id div 8) * {10 * S} as t0_us", "id as event_id").withColumn("t1_us", F.col("t0_us") + S)
    hit = det.where("v > 4").join(gt.withColumnRenamed("event_id", "g"), ["session", "t0_us"]).select("session", "g").distinct().count()
    chosen = gates.forward_selection(det, gt, [("v", ">=", x) for x in (2.0, 5.0, 8.0)])
    assert [g for g, _ in chosen] == [("v", ">=", 5.0)] and math.isclose(chosen[0][1], 2 * (r := hit / 400) / (1 + r))
    got = {r.strategy: r for r in gates.strategies(det, gt, {"all": F.lit(True), "none": F.lit(False)}).collect()}
    assert (got["all"].tp, got["all"].n_kept, got["none"].tp, got["none"].fn, got["none"].precision) == (hit, 400, 0, 400, None)
    trials = gates.search(det, gt, gates.random_configs(spark, 20, {"x": (0, 10)}, 1), F.col("v") >= F.col("cfg_x"))
    assert trials.count() == 20 and 4 < gates.rank(trials, n=1).first().cfg_x <= 5
    swept = {r.strategy: r for r in gates.matching_sweep(det.withColumn("channel", F.lit(0)), gt.withColumn("channel", F.lit(0)), {"all": F.lit(True), "v": F.col("v") > 4}).collect()}
    assert (swept["all"].tp, swept["all"].fp) == (hit, 400 - hit) and (swept["v"].tp, swept["v"].fp, swept["v"].fn) == (hit, 0, 400 - hit)


def test_curve_limits(spark):
    gt = iv(spark, [(0, 1), (5, 6)])
    pred = iv(spark, [(0, 1), (8, 9)], method="'m'", score="event_id * 0.5 + 0.1234567")
    pts = curves.pr_curve(gt, pred, levels=3).orderBy("seq").collect()
    assert pts[0].threshold is None and (pts[0].tp, pts[0].fp) == (1, 1)
    assert pts[-1].threshold > 0.6234567 - 1e-6 and pts[-1].tp == 0
    rec = [p.recall for p in pts]
    assert rec == sorted(rec, reverse=True)


def test_undefined_values(spark):
    flat = spark.createDataFrame([("tp", 1.0)] * 3 + [("fp", 1.0), ("fp", None)], "label string, x double")
    assert sorted((r.label, r.bin, r.n, r.density) for r in curves.histogram(flat, "x", "label").collect()) == [("fp", 0, 1, None), ("tp", 0, 3, None)]
    dims = spark.createDataFrame([(0, None, 0.0), (1, None, 0.0)], "dim int, r double, variance double")
    assert tuple(latents.weighted_r(dims).first()) == (None, None, 0)
    pts = spark.createDataFrame([("a", 0, 0.5, 1.0), ("b", 0, 0.1, 1.0), ("b", 1, 0.3, 0.5), ("b", 2, None, 1.0)], "method string, seq int, recall double, precision double")
    got = {r.method: r.auc for r in curves.area_under_curve(pts).collect()}
    assert got["a"] is None and math.isclose(got["b"], 0.15)
    rows = spark.createDataFrame([(1, 0, [0.0]), (1, 0, [0.0]), (2, 0, [9.0])], "vec_id int, cluster_id int, embedding array<float>")
    cents = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (2, [8.0])], "cluster_id int, centroid array<double>")
    assert sorted(map(tuple, latents.nearest_centroid(rows, cents).collect())) == [(1, 0, 0, 1.0), (1, 0, 0, 1.0), (2, 0, 2, 1.0)]
    t = spark.createDataFrame([("m", 0, 0, 0, 0)], "method string, n_gt long, tp long, pred_tp long, fp long")
    assert budget.budget_intervals(t, [10]).first().recall is None
    assert spark.range(1).select(FI.time_to_x(F.lit(1), F.lit(2), F.lit(2), F.lit(9)).alias("x")).count() == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_quantiles(spark, parts):
    from chirpline.operators.quantiles import quantiles

    r = random.Random(parts)
    rows = [(g, r.choice((None, float(r.randrange(40)), r.random()))) for g in "abc" for _ in range(r.randrange(1, 200))] + [("d", None)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {x.g: x for x in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "d" not in got
    for g in "abc":
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.percentile(v, [0, 37, 100]))


def test_contexts_and_splits(spark):
    spans = spark.createDataFrame([("s", 0, 10 * S, 20 * S), ("s", 1, 90 * S, 95 * S)], "session string, bout_id long, start_us long, stop_us long")
    rows = iv(spark, [(5, 8), (20, 30), (21, 22), (0, 100), (96, 97)])
    want = {(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (4, 1)}
    for bucket in (3 * S, 10**12):
        assert {(r.event_id, r.bout_id) for r in I.in_context(rows, spans, ["session"], 2 * S, bucket).collect()} == want
    parts = latents.split_rows(spark.range(100).repartition(5), 0.2, "id", 3).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"val": 20, "train": 80}
    assert {r.part for r in latents.split_rows(spark.range(2), 0.1, "id").collect()} == {"val", "train"}
    mask = spark.createDataFrame([([1, 0, 0],), ([0, 0, 0],)], "m array<int>")
    assert tuple(latents.imbalance_weight(mask, "m").first()) == (1.0, 5.0, 5.0)
    assert latents.imbalance_weight(mask.limit(0), "m").first().weight == 0.0
    crops = spark.createDataFrame([(0.1, 0, 0, 9, 9), (None, 0, 0, 9, 9), (0.9, 0, 0, 3, 9)], "score double, a int, b int, c int, d int")
    assert [r.x for r in crops.select(gates.skip_reason(("a", "b", "c", "d"), 5, 0.5).alias("x")).collect()] == ["low_score", "keep", "small_crop"]


def test_feature_auc(spark):
    r = random.Random(2)
    rows = [(r.choice(("tp", "fp")), float(r.randrange(6))) for _ in range(200)]
    got = curves.feature_auc(spark.createDataFrame(rows, "label string, x double"), ["x"]).first()
    tp, fp = [v for k, v in rows if k == "tp"], [v for k, v in rows if k == "fp"]
    auc = sum((a > b) + (a == b) / 2 for a in tp for b in fp) / len(tp) / len(fp)
    assert math.isclose(got.auc, max(auc, 1 - auc))


def test_binomial_intervals():
    def cdf(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for x, n in ((0, 10), (3, 10), (10, 10), (37, 120), (250, 1000)):
        lo, hi = (float(v[0]) for v in budget.clopper_pearson([x], [n], 0.05))
        assert x == 0 or abs(1 - cdf(x - 1, n, lo) - 0.025) < 1e-6
        assert x == n or abs(cdf(x, n, hi) - 0.025) < 1e-6
        a, b = (float(v[0]) for v in budget.confidence_sequence([x], [n], 0.05))
        assert a <= lo and hi <= b and a <= x / n <= b
    z = np.array([0.5, 1, 3.3, 50.5])
    assert np.allclose(budget._log_gamma(z), [math.lgamma(v) for v in z], atol=1e-10)


def test_bootstrap_is_stable(spark):
    c = spark.createDataFrame([(m, f"s{i}", 5 + i, 2, 6, i % 3) for m in "ab" for i in range(12)], "method string, session string, tp long, fn long, pred_tp long, fp long")
    a, b = (sorted(map(tuple, budget.bootstrap(c.repartition(k), [4, 12], 50).collect())) for k in (1, 5))
    assert a == b and all(r[2] <= r[3] <= r[4] for r in a)
    d = budget.bootstrap_difference(c, "a", "b", [12], 50).first()
    assert d.lo == d.hi == 0 and not d.excludes_zero


def test_vectors(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0], 5), (1, 0, [2.0, 0.0], 9), (2, 1, [10.0, 0.0], 1), (3, 0, [1.1, 0.0], 9)], "vec_id long, cluster_id int, embedding array<float>, confidence int")
    c = {r.cluster_id: r.centroid for r in latents.centroids(df).collect()}
    assert np.allclose(c[0], [3.1 / 3, 0]) and c[1] == [10.0, 0.0]
    assert {r.cluster_id: r.vec_id for r in latents.medoids(df).collect()} == {0: 3, 1: 2}
    assert {r.cluster_id: (r.vec_id, r.n) for r in latents.exemplars(df).collect()} == {0: (1, 3), 1: (2, 1)}
    assert sorted(r.cluster_id for r in latents.missing_clusters(df, 4).collect()) == [2, 3]


def test_expressions(spark):
    row = spark.createDataFrame([([0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0], "[ 1.2 -3.4\n 5.6]")], "p array<double>, v string")
    got = row.select(FI.polygon_area("p").alias("a"), *(c.alias(n) for c, n in zip(FI.polygon_bbox("p"), "xywh")), FI.parse_vector("v").alias("v"), FI.polygon_scale("p", 2.0, 1.0, 1.0).alias("s")).first()
    assert got.a == 12 and (got.x, got.y, got.w, got.h) == (0, 0, 4, 3) and got.v == [1.2, -3.4, 5.6] and got.s[:4] == [1.0, 0.0, 9.0, 0.0]
    keys = spark.createDataFrame([("a10",), ("a9",), ("b1",)], "k string").orderBy(FI.natural_key("k")).collect()
    assert [k.k for k in keys] == ["a9", "a10", "b1"]
    lo, hi = FI.bbox_to_band(F.lit(0.0), F.lit(50.0), F.lit(101.0), F.lit(1000.0))
    assert tuple(spark.range(1).select(lo, hi).first()) == (500.0, 1000.0)


def test_files(spark, tmp_path):
    d = tmp_path / "gt" / "experiment_3" / "idx_007"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("name,start_seconds,stop_seconds\nvox,0.5,1.5\ncombined,0,9\nvox,x,2\nvox,nan,2\n")
    gt = readers.read_gt(spark, str(tmp_path / "gt"))
    assert sorted((r.session, r.name, r.t0_us) for r in gt.collect()) == [("experiment_3/idx_007", "combined", 0), ("experiment_3/idx_007", "vox", 500_000)]
    (tmp_path / "labels.csv").write_text("experiment,idx,start_seconds,stop_seconds,is_vocalization\n3,7,1,2, Yes\n3,7,5,8,no \n3,7,0,99,\n3,x,1,2,yes\n")
    pos, spans = readers.read_labels(spark, str(tmp_path / "labels.csv"))
    assert pos.count() == 1 and tuple(spans.first()) == ("experiment_3/idx_007", 1 * S, 8 * S)

    images = spark.createDataFrame([("e/s", 1, "k2", "b.png", 100, 50, 1.0, 2.0), ("e/s", 1, "k1", "a.png", 100, 50, 0.0, 1.0)], "session string, channel int, image_key string, file_name string, width int, height int, window_start_sec double, window_end_sec double")
    ann = spark.createDataFrame([("e/s", 1, "k2", 10.0, 5.0, 20.0, 5.0, 0.7)], "session string, channel int, image_key string, x double, y double, w double, h double, score double")
    doc = writers.documents(images, ann).first()
    assert [i["id"] for i in doc["images"]] == [0, 1] and doc["annotations"][0]["image_id"] == 1
    out = tmp_path / "docs" / "e" / "s"
    out.mkdir(parents=True)
    (out / "coco_ch_1.json").write_text(json.dumps({"images": [i.asDict() for i in doc["images"]], "annotations": [a.asDict() for a in doc["annotations"]], "categories": [], "odd": 1}))
    got = readers.read_detections(spark, str(tmp_path / "docs"), [1]).first()
    assert (got.channel, got.t0_us, got.t1_us, got.score) == (1, 1_100_000, 1_300_000, 0.7)
    keys = spark.createDataFrame([("e/s", 1), ("e/s", 2)], "session string, channel int")
    assert [r.channel for r in writers.pending(keys, images).collect()] == [2] and writers.pending(keys, images, overwrite=True).count() == 2

    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "metrics_das.csv").write_text("session,tp\na,3\n")
    assert readers.resolve_metrics(spark, str(tmp_path / "r1")).endswith("metrics_das.csv")
    (tmp_path / "r1" / "metrics_gt.csv").write_text("session,tp\na,3\n")
    assert readers.resolve_metrics(spark, str(tmp_path / "r1")) is None
    assert readers.resolve_metrics(spark, str(tmp_path / "r1"), "metrics_gt.csv").endswith("metrics_gt.csv")
    files = spark.createDataFrame([("/d/experiment_1/idx_002/mic_1_x_chunk_3_t3.0-4.0.png",), ("/d/experiment_1/idx_010/mic_0_x_chunk_1_t1.0-2.0.png",), ("/d/experiment_2/idx_001/other.png",)], "path string")
    assert [(r.channel, r.chunk, r.t0_us) for r in readers.list_chunks(files, channels=[1]).collect()] == [(1, 3, 3 * S)]
    assert [r.session for r in readers.discover_sessions(files, first=2).collect()] == ["experiment_1/idx_002", "experiment_1/idx_010"]
    assert readers.discover_sessions(files, named=["experiment_2/idx_001"]).count() == 1
    sessions = readers.discover_sessions(files)
    many = sessions.crossJoin(spark.range(3)).select("session")
    assert [r.session for r in readers.qualifying_sessions(many, sessions, 3, 9).collect()] == ["experiment_1/idx_002", "experiment_2/idx_001"]
    (tmp_path / "exp1.csv").write_text("start_time_file_sec,stop_time_file_sec\n2,3\n0.5,1\nx,1\n")
    assert [(r.session, r.name, r.t0_us) for r in readers.read_calls(spark, str(tmp_path / "exp1.csv")).collect()] == [("exp1", "vox", 500_000), ("exp1", "vox", 2 * S)]
    (tmp_path / "voc.csv").write_text('odd,onset,audio_filename,offset,cohort,z_70,latent_means,prob_z_70\nx,1.0,a.wav,2.0,c1,1,"[0.5\n 1.5]","[0.1 0.9]"\nx,1.0,b.wav,2.0,c1,0,"[0.5]","[1.0]"\n')
    names = spark.createDataFrame([("a.wav",)], "audio_filename string")
    assert tuple(readers.read_vocalizations(spark, str(tmp_path / "voc.csv"), names).first()) == ("a.wav", 1.0, 2.0, "c1", 1, [0.5, 1.5], 0.9)
    (tmp_path / "m.csv").write_text("session,tp,fn,fp\na,3,1,0\n")
    m = readers.read_metrics(spark, str(tmp_path / "m.csv"), "x").first()
    assert (m.pred_tp, m.method, m.recall) == (3, "x", None)
    (tmp_path / "b.csv").write_text("session,bout_id,n_calls,recall\na,0,2,nan\n")
    b = readers.read_bouts(spark, str(tmp_path / "b.csv")).first()
    assert b.recall is None and b.n_pred_events == 0
    writers.write_csv(keys, str(tmp_path / "k"))
    assert spark.read.option("header", True).csv(str(tmp_path / "k")).count() == 2
    writers.write_shards(spark.range(300), 128, ["id"], str(tmp_path / "sh"))
    assert spark.read.parquet(str(tmp_path / "sh")).groupBy("shard").count().where("count = 128").count() == 2


@pytest.mark.parametrize("rows, want", [(128 * 150 + 5, 150), (40, 1)])
def test_shards_are_row_groups_of_few_files(spark, tmp_path, rows, want):
    import pyarrow.parquet as pq

    writers.write_shards(spark.range(rows).select((F.col("id") * 7919 % rows).alias("id")), 128, ["id"], str(tmp_path / "sh"))
    files = [pq.ParquetFile(f) for f in (tmp_path / "sh").rglob("*.parquet")]
    groups = [f.read_row_group(i).to_pydict() for f in files for i in range(f.num_row_groups)]
    assert len(files) <= 8 and len(groups) == want
    for g in groups:
        assert len(set(g["shard"])) == 1 and g["id"] == [g["shard"][0] * 128 + i for i in range(min(128, rows))]


def test_audio(spark, tmp_path):
    d = tmp_path / "experiment_1" / "idx_000"
    d.mkdir(parents=True)
    sr, n = 8000, 20_000
    tone = [math.sin(2 * math.pi * 1000 * i / sr) for i in range(n)]
    for name in ("mic_0_a.wav", "mic_0_b.wav"):
        with wave.open(str(d / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(sr)
            w.writeframes(struct.pack(f"<{n}h", *(int(v * 30000) for v in tone)))
    audio = readers.read_wav(spark, str(tmp_path), "mic")
    assert audio.count() == 1
    chunks = readers.slice_chunks(audio)
    assert sorted(c.chunk for c in chunks.select("chunk").collect()) == [0, 1]
    fr = signal.spectrogram(chunks, ["session", "channel", "chunk"])
    assert {int(np.argmax(r.power)) for r in fr.collect()} == {64}
    ev = spark.createDataFrame([(9, "experiment_1/idx_000", 0, 900_000, 1_200_000)], "event_id long, session string, channel int, t0_us long, t1_us long")
    cut = signal.attach_audio(ev, chunks, S)
    x = cut.first().samples
    assert len(x) == 2400 and np.allclose(x, np.array(tone[7200:9600]) * 30000 / 32768, atol=1e-3)
    f = signal.spectral_features(cut.withColumns({"f_low_hz": F.lit(500.0), "f_high_hz": F.lit(2000.0)}), ["event_id"]).first()
    assert abs(f.centroid_mean - 1000) < 20 and f.flatness_mean < 0.05 and abs(f.peak_freq_mean - 1000) < 1e-6
    noise = spark.createDataFrame([(0, np.random.default_rng(0).normal(size=20_000).tolist(), sr, 0.0, 4000.0), (1, [], sr, 0.0, 1.0)], "i int, samples array<double>, sr int, f_low_hz double, f_high_hz double")
    got = {r.i: r for r in signal.spectral_features(noise, ["i"]).collect()}
    assert abs(got[0].flatness_mean - 0.56) < 0.03 and got[1].flatness_mean is None and abs(got[0].zcr_mean - 0.5) < 0.03


def plain_features(x, sr, low, high, size=512, hop=128):
    """Means over frames, by loops."""
    p = [0.0] * (size // 2) + list(x) + [0.0] * (size // 2)
    out = {k: [] for k in ("centroid", "bandwidth", "rolloff", "flatness", "rms", "peak_freq")}
    for at in range(0, len(p) - size + 1, hop):
        s = np.abs(np.fft.rfft([v * (0.5 - 0.5 * math.cos(2 * math.pi * i / size)) for i, v in enumerate(p[at : at + size])])) + 1e-10
        bins = [(k * sr / size, m) for k, m in enumerate(s) if low <= k * sr / size <= high] or [min(((k * sr / size, m) for k, m in enumerate(s)), key=lambda b: abs(b[0] - (low + high) / 2))]
        whole = sum(m for _, m in bins)
        c = sum(f * m for f, m in bins) / whole
        out["centroid"].append(c)
        out["bandwidth"].append(math.sqrt(sum(m * (f - c) ** 2 for f, m in bins) / whole))
        out["rolloff"].append(next(f for i, (f, _) in enumerate(bins) if sum(m for _, m in bins[: i + 1]) >= 0.85 * whole))
        power = [max(m * m, 1e-10) for _, m in bins]
        out["flatness"].append(math.exp(sum(map(math.log, power)) / len(power)) / (sum(power) / len(power)))
        out["rms"].append(math.sqrt(2 * sum(m * m for _, m in bins)) / size)
        out["peak_freq"].append(max(bins, key=lambda b: b[1])[0])
    return {k: (np.mean(v), np.std(v)) for k, v in out.items()}


def test_features_by_loops(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=n).tolist(), 8000, lo, hi) for i, (n, lo, hi) in enumerate(((900, 500.0, 2000.0), (300, 0.0, 4000.0), (700, 1001.0, 1002.0)))]
    got = signal.spectral_features(spark.createDataFrame(rows, "i int, samples array<double>, sr int, f_low_hz double, f_high_hz double"), ["i"]).collect()
    for g in got:
        for name, (mean, spread) in plain_features(*rows[g.i][1:]).items():
            assert math.isclose(g[f"{name}_mean"], mean, rel_tol=1e-6) and math.isclose(g[f"{name}_std"], spread, rel_tol=1e-4, abs_tol=1e-6)


def test_components(spark):
    def frames(image):  # columns are frames; the response is the image itself
        rows = [(0, c, [float(v) for v in image[:, c]]) for c in range(image.shape[1])]
        return spark.createDataFrame(rows, "chunk int, frame int, power array<double>")

    image = np.full((40, 60), 1e-9)
    for c in range(10, 40):
        image[20 + c // 6, c] = 50
    got = signal.segment(frames(image), ["chunk"], 98.9, 20).collect()
    assert len(got) == 1 and got[0].n_cols == 30 and got[0].x_px == 10 and got[0].y_px == 21 and got[0].sweep_frac == 5 / 40
    plain = lambda column: column
    r = np.random.default_rng(4)
    for _ in range(3):
        image = 10.0 ** r.integers(0, 2, (9, 11))
        on = image > 1
        seen, sizes = np.zeros_like(on), []
        for y, x in zip(*np.nonzero(on)):
            todo, n = [(y, x)], 0
            while todo:
                a, b = todo.pop()
                if 0 <= a < 9 and 0 <= b < 11 and on[a, b] and not seen[a, b]:
                    seen[a, b], n = True, n + 1
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            sizes += [n] if n else []
        share = 100 * (1 - on.mean())
        assert sorted(c.area_px for c in signal.segment(frames(image), ["chunk"], share + 0.5, 1, plain).collect()) == sorted(sizes)


def test_slices_keep_their_place(spark):
    chunks = spark.createDataFrame([("s", 0, c, 10, [float(10 * c + i) for i in range(10)]) for c in (0, 2, 3)], "session string, channel int, chunk int, sr int, samples array<double>")
    ev = spark.createDataFrame([("s", 0, 800_000, 2_200_000), ("s", 0, 800_000, 2_200_000), ("s", 0, 2_500_000, 9_000_000), ("s", 0, 7_000_000, 8_000_000)], "session string, channel int, t0_us long, t1_us long")
    got = sorted(r.samples for r in signal.attach_audio(ev, chunks, S).collect())
    assert got == [[8.0, 9.0] + [0.0] * 10 + [20.0, 21.0]] * 2 + [[float(i) for i in range(25, 40)]]
    rows = spark.createDataFrame([([2.0, 2.0], [1.0], []), ([2.0], [], []), ([2.0], [0.0], [0.0])], "e array<double>, b array<double>, a array<double>")
    assert [round(r.x, 6) for r in rows.select(signal.snr("e", "b", "a").alias("x")).collect()] == [round(10 * math.log10(4), 6), 0.0, 0.0]


def test_calibration_windows(spark):
    frames = spark.createDataFrame([("s", i, [10.0 ** (i / 100)]) for i in range(100)], "session string, frame int, power array<double>")
    kept = signal.spread_windows(frames, ["session"], F.col("frame"), 5, 6)
    at = [int(k * 95 / 5) for k in range(6)]
    assert sorted(r.frame for r in kept.collect()) == sorted({i for a in at for i in range(a, a + 5)})
    assert signal.spread_windows(frames, ["session"], F.col("frame"), 500).count() == 100
    r = signal.db_range(frames, ["session"], 0.1, 0.9).first()
    assert math.isclose(r.lo, np.percentile([i / 10 for i in range(100)], 10)) and math.isclose(r.hi, np.percentile([i / 10 for i in range(100)], 90))


def test_detect_gates_on_samples(spark):
    sr, t = 8000, np.arange(4096) / 8000
    tone = lambda hz: np.sin(2 * np.pi * hz * t) * (np.abs(t - 0.25) < 0.09)
    rows = [(i, 0, x.tolist(), sr) for i, x in enumerate((tone(500), tone(3000)))]
    chunks = spark.createDataFrame(rows, "chunk int, channel int, samples array<double>, sr int")

    def reasons(min_hz=0.0, **k):
        got = signal.detect(chunks, ["chunk", "channel"], gates.reason(min_cols=10, min_sweep_frac=0.0, **k), 95.0, 10, 256, 64, min_hz).collect()
        assert got and all(r.centroid_hz is not None and r.flatness is not None for r in got)
        long = [r for r in got if r.n_cols >= 10 and r.y_px <= (16, 96)[r.chunk] < r.y_px + r.h_px]  # the tone's bin
        assert all(abs(r.centroid_hz - (500, 3000)[r.chunk]) < 400 for r in long)
        return {(r.chunk, r.reason) for r in long}

    assert reasons(min_centroid_hz=2000.0) == {(0, "low_centroid"), (1, "keep")}
    assert reasons(min_centroid_hz=None, max_flatness=1e-9) == {(0, "high_flatness"), (1, "high_flatness")}
    assert {c for c, _ in reasons(min_hz=2000.0, min_centroid_hz=None)} == {1}


def test_natural_order_places_all_rows(spark):
    df = spark.range(1500).selectExpr("id", "concat('c', id * 7 % 1500) as name").repartition(5)
    got = matching.natural_order(df, "name").collect()
    assert sorted((x.place, x.name) for x in got) == [(i + 1, f"c{i}") for i in range(1500)]


def test_natural_order_of_copies_and_long_numbers(spark, tmp_path):
    from chirpline.plans import catalog

    names = ["c9", "c09", "c10", "c1000000000001", "c2000000000000", "c99999999999999999999"]
    got = matching.natural_order(spark.createDataFrame([(n,) for n in names[::-1]], "name string"), "name").orderBy("place").collect()
    assert [x.name for x in got] == ["c09", *names[:1], *names[2:]]
    rows = [(k * 40 + i, f"Customer#{i:09d}") for k in range(6) for i in range(40)]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "c_custkey long, c_name string").repartition(5).write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.queries()["natural_sort"](spark, str(tmp_path)).orderBy("place").collect()
    assert [(x.c_name, x.c_custkey) for x in got] == sorted((n, k) for k, n in rows) and [x.place for x in got] == list(range(1, 241))


def test_matching_in_rounds(spark):
    r = random.Random(5)
    rows = lambda n: [(a := r.randrange(400) / 4, a + r.randrange(1, 30)) for _ in range(n)]
    g, p = rows(80), rows(90)
    iou = lambda a, b: (min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))
    want, used_g, used_p = set(), set(), set()
    for _, (_, i), (_, j) in sorted(((iou(a, b), (a, i), (b, j)) for i, a in enumerate(g) for j, b in enumerate(p) if iou(a, b) > 0.1), reverse=True):
        if i not in used_g and j not in used_p:
            want.add((i, j))
            used_g.add(i)
            used_p.add(j)
    got = matching.greedy_match(iv(spark, g), iv(spark, p), ["session"], 0.1)
    assert {(x.gt_id, x.pred_id) for x in got.collect()} == want and len(want) > 20
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan  # no stretch of time is one group
    assert matching.greedy_match(iv(spark, g), iv(spark, [(900, 901)]), ["session"]).count() == 0


def _stream(spark, tmp_path, batches, name):
    src = tmp_path / name
    for i, rows in enumerate(batches):
        live.with_time(iv(spark, rows)).coalesce(1).write.mode("append").parquet(str(src))
    schema = live.with_time(iv(spark, [(0, 1)])).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(0, 1), (1, 2), (5, 9), (6, 7), (20, 21), (900, 901)]
    got = _run(spark, live.live_merge(_stream(spark, tmp_path, [rows[:3], rows[3:]], "a"), ["session"]), "merged", "complete")
    assert sorted((r.t0_us / S, r.t1_us / S) for r in got) == events(spark, rows)
    got = _run(spark, live.live_bouts(_stream(spark, tmp_path, [rows[:2] + rows[4:]], "b"), ["session"], 30 * S), "bouts_live", "complete")
    assert sorted(r.n_calls for r in got) == [1, 3]
    late = _run(spark, live.live_counts(_stream(spark, tmp_path, [[(0, 1)], [(900, 901)], [(910, 911)], [(0.2, 1)], [(1800, 1801)]], "c"), ["session"]), "counts_live")
    assert {r.t0_us: r.n for r in late}[0] == 1
    g, p = _stream(spark, tmp_path, [[(100, 102), (150, 151)]], "g"), _stream(spark, tmp_path, [[(101, 103), (151, 152)]], "p")
    met = _run(spark, live.live_matches(g, p, ["session"]).select("g_event_id", "p_event_id"), "met_live")
    assert [tuple(m) for m in met] == [(0, 0)]


def test_flatness_variants(spark):
    rows = [(1, [1.0, 1.0, 1.0, 1.0], [0, 1, 1, 0], [1, 1, 1, 0]), (1, [4.0, 1.0, 1.0, 9.0], [0, 1, 1, 0], [1, 1, 1, 0])]
    got = signal.flatness_variants(spark.createDataFrame(rows, "id int, magnitude array<double>, mask array<int>, in_band array<int>"), ["id"]).first()
    assert math.isclose(got.kept, 1.0, rel_tol=1e-6) and math.isclose(got.rect, (1 + 4 ** (1 / 3) / 2) / 2, rel_tol=1e-6)
    assert got.zeroed < 0.01 and got.zeroed_full < got.zeroed
