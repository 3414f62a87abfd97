"""Threshold sweeps: precision-recall curves, areas, operating points, class separation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirpline.functions.metrics import curve_metrics, ratio
from chirpline.operators.intervals import BUCKET_US, in_context, merge_intervals, overlap_flag_asof, overlap_join
from chirpline.operators.quantiles import quantile, quantiles, ranked
from chirpline.operators.scan import EARLIER, LINE, UPTO, carried, in_bucket, on_lines
from chirpline.sources.shared import cut

LEVELS = 40


def thresholds(pred: DataFrame, by: list[str] = ("method",), levels: int = LEVELS) -> DataFrame:
    """by, seq, threshold: exact score quantiles at even levels, rounded and without repeats.

    seq 0 is the anchor that keeps everything (threshold NULL).
    """
    names = {f"q{i}": i / (levels - 1) for i in range(levels)}
    got = quantiles(pred, list(by), "score", names)
    q = got.select(*by, F.array_sort(F.array_distinct(F.array(*(F.round(n, 6) for n in names)))).alias("cuts"))
    return q.select(*by, F.posexplode(F.concat(F.array(F.lit(None).cast("double")), "cuts")).alias("seq", "threshold"))


def pr_curve(gt: DataFrame, pred: DataFrame, by: str = "method", levels: int = LEVELS, bucket_us: int = BUCKET_US) -> DataFrame:
    """by, seq, threshold, counts and metrics at each threshold, pooled over sessions.

    All thresholds come from one scan of the detections in order of time; none is copied for a
    threshold. A detection that ``k`` thresholds keep has level ``k``. The scan knows, for each level,
    the furthest end of the detections of at least that level: a structure of what covers a place, and
    down to which threshold. So it gives for each detection the range of thresholds at which
    a merged event starts with it (those it passes and that nothing before reaches it at), and for each call,
    which comes once a method, the thresholds at which it is found. An event counts as right with the
    first of its detections that overlaps a call; which that is at each threshold follows from the
    last start and the last such detection of each level. Furthest ends, starts and such
    detections are carried from bucket to bucket.
    """
    cuts = cut(thresholds(pred, [by], levels).where("seq > 0").groupBy(by).agg(F.array_sort(F.collect_list("threshold")).alias("cuts")), "cuts")  # a row per method
    top = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0
    scale = range(top + 1)
    hits = overlap_flag_asof(pred.select(by, "session", "t0_us", "t1_us", "score"), gt.select("session", "t0_us", "t1_us"), ["session"], bucket_us=bucket_us)
    level = F.size(F.filter("cuts", lambda c: F.coalesce(F.col("score") >= c, F.lit(False))))
    found = hits.join(F.broadcast(cuts), by).select(by, "session", F.col("t0_us").alias("at"), F.lit(2).alias("kind"), "t0_us", "t1_us", level.alias("level"), "hit")
    calls = gt.join(F.broadcast(cuts.select(by))).select(by, "session", F.col("t1_us").alias("at"), F.lit(1).alias("kind"), "t0_us", "t1_us", F.lit(-1).alias("level"), F.lit(False).alias("hit"))
    rows = on_lines(found.unionByName(calls), [by, "session"], F.col("at"), bucket_us)
    order = ["at", "kind", "t1_us", "level", "hit"]
    # the furthest end so far, for each level: of all detections, which events reach over, and of those that aren't points, which can find a call
    end = lambda k: F.when(F.col("level") >= k, F.col("t1_us"))
    solid = lambda k: F.when((F.col("level") >= k) & (F.col("t1_us") > F.col("t0_us")), F.col("t1_us"))
    ends = {f"e{k}": end(k) for k in scale} | {f"f{k}": solid(k) for k in scale}
    rows = carried(rows, {n: F.max(c) for n, c in ends.items()}, {f"r{n}": lambda before, after, n=n: F.max(n).over(before) for n in ends})
    earlier = in_bucket(*order, frame=EARLIER)
    reach = {n: F.greatest(F.col(f"r{n}"), F.max(c).over(earlier)) for n, c in ends.items()}
    rows = rows.select(LINE, by, *order, "t0_us", F.array(*(reach[f"e{k}"] for k in scale)).alias("reach"), F.array(*(reach[f"f{k}"] for k in scale)).alias("solid"))
    passed = lambda c, test: F.size(F.filter(c, lambda e: F.coalesce(test(e), F.lit(False)))) - 1
    call_found = F.when(F.col("t1_us") > F.col("t0_us"), passed("solid", lambda e: e > F.col("t0_us")))
    joins = passed("reach", lambda e: e >= F.col("t0_us"))  # the highest level at which something before reaches the detection
    rows = rows.withColumn("joins", F.when(F.col("kind") == 1, F.coalesce(call_found, F.lit(-1))).otherwise(joins)).drop("reach", "solid")
    # the last start and the last detection on a call so far, for each level
    is_found = F.col("kind") == 2
    start = lambda k: F.when(is_found & (F.col("joins") < k) & (F.col("level") >= k), F.col("t0_us"))
    right = lambda k: F.when(F.col("hit") & (F.col("level") >= k), F.col("t0_us"))
    last = {f"s{k}": F.max(start(k)) for k in scale} | {f"h{k}": F.max(right(k)) for k in scale}
    rows = carried(rows, last, {f"c{n}": lambda before, after, n=n: F.max(n).over(before) for n in last})
    upto = in_bucket(*order, frame=UPTO)
    first_right = [F.col("hit") & (F.col("level") >= k) & F.coalesce(F.greatest(F.col(f"ch{k}"), F.max(right(k)).over(earlier)) < F.greatest(F.col(f"cs{k}"), F.max(start(k)).over(upto)), F.greatest(F.col(f"ch{k}"), F.max(right(k)).over(earlier)).isNull()) for k in scale]
    rows = rows.select(by, "kind", "level", "joins", F.array(*first_right).alias("first_right"))
    tally = lambda test: F.array(*(F.count_if(test(k)) for k in scale))
    sums = rows.groupBy(by).agg(
        tally(lambda k: is_found & (F.col("joins") < k) & (F.col("level") >= k)).alias("events"),
        tally(lambda k: F.col("first_right")[k]).alias("right"),
        tally(lambda k: (F.col("kind") == 1) & (F.col("joins") >= k)).alias("tp"),
    )
    n_gt = gt.agg(F.count(F.lit(1)).alias("n_gt"))
    points = cuts.select(by, F.posexplode(F.concat(F.array(F.lit(None).cast("double")), "cuts")).alias("seq", "threshold")).join(F.broadcast(sums), by).join(F.broadcast(n_gt))  # rows per method and threshold
    at = lambda c: F.col(c)[F.col("seq")]
    out = points.select(by, "seq", "threshold", at("tp").alias("tp"), at("right").alias("pred_tp"), (at("events") - at("right")).alias("fp"), (F.col("n_gt") - at("tp")).alias("fn"))
    return out.withColumns(curve_metrics())


def area_under_curve(points: DataFrame, by: str = "method") -> DataFrame:
    """Trapezoids over recall; equal recalls stay in order of seq. NULL for fewer than two points."""
    line = Window.partitionBy(by).orderBy("recall", "seq")
    step = (F.col("recall") - F.lag("recall").over(line)) * (F.col("precision") + F.lag("precision").over(line)) / 2
    inner = points.where("recall is not null").withColumn("step", step).groupBy(by).agg(F.sum("step").alias("auc"))
    return points.select(by).distinct().join(inner, by, "left")


def precision_at_recall(points: DataFrame, targets: list[float], by: str = "method") -> DataFrame:
    """Best precision among the points of at least each recall; NULL where none reaches it."""
    t = points.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    return t.groupBy(by, "target").agg(F.max(F.when(F.col("recall") >= F.col("target"), F.col("precision"))).alias("precision"))


def operating_points(points: DataFrame, targets: list[float], size: str = "n_candidates") -> DataFrame:
    """The point of fewest candidates that reaches each recall."""
    t = points.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where(F.col("recall") >= F.col("target"))
    return t.groupBy("target").agg(F.min_by(F.struct("threshold", size, "recall"), F.struct(F.col(size), F.col("threshold"))).alias("p")).select("target", "p.*")


def signal_sweep(frames: DataFrame, gt: DataFrame, levels: list[float], at: str = "frame", min_us: int = 0) -> DataFrame:
    """Candidates, recall ceiling and candidate precision of runs above each signal threshold."""
    from chirpline.operators.intervals import runs

    leveled = frames.withColumn("threshold", F.explode(F.array(*map(F.lit, levels))))
    found = runs(leveled, ["session", "threshold"], F.col("env") >= F.col("threshold"), at, min_us)
    lv = gt.withColumn("threshold", F.explode(F.array(*map(F.lit, levels))))
    lines = ["session", "threshold"]
    r = overlap_flag_asof(lv.select(*lines, "t0_us", "t1_us"), found, lines).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_gt"), F.count_if("hit").alias("tp"))
    p = overlap_flag_asof(found, lv.select(*lines, "t0_us", "t1_us"), lines).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("hit").alias("pred_tp"))
    out = r.join(p, "threshold", "left").fillna(0, ["n_candidates", "pred_tp"])
    return out.select("threshold", "n_candidates", ratio("tp", "n_gt").alias("recall"), ratio("pred_tp", "n_candidates").alias("precision"))


def feature_auc(df: DataFrame, features: list[str], label: str = "label", min_rows: int = 10) -> DataFrame:
    """feature, n_tp, n_fp, auc (folded to at least one half) and class medians.

    Mann-Whitney from counts per distinct value. Ranks come from counts per range of values, so a
    continuous feature of any size is dealt over many tasks; medians come from the same ranks.
    """
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("x")).select(label, "x.*").where("value is not null")
    cell = long.groupBy("feature", "value").agg(F.count_if(F.col(label) == "tp").alias("tp"), F.count_if(F.col(label) == "fp").alias("fp"))
    rows = ranked(cell, ["feature"], "value", ["tp", "fp"])
    wins = F.sum(F.col("tp") * (F.col("under_fp") + F.col("fp") / 2))
    out = rows.groupBy("feature").agg(F.sum("tp").alias("n_tp"), F.sum("fp").alias("n_fp"), wins.alias("u"), *(F.when(F.max(f"all_{c}") > 0, quantile("value", 0.5, c)).alias(f"median_{c}") for c in ("tp", "fp")))
    auc = F.try_divide(F.col("u"), F.col("n_tp") * F.col("n_fp"))
    known = (F.col("n_tp") > 0) & (F.col("n_fp") > 0) & (F.col("n_tp") + F.col("n_fp") >= min_rows)
    return out.select("feature", "n_tp", "n_fp", F.when(known, F.greatest(auc, 1 - auc)).alias("auc"), "median_tp", "median_fp")


def histogram(df: DataFrame, feature: str, label: str, bins: int = 20, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """label, bin, n, density on the common range between two percentiles, ends clipped into it.

    A constant feature has bin 0 alone, without a density.
    """
    x = df.select(label, F.col(feature).cast("double").alias("v")).where("v is not null")
    span = quantiles(x, [], "v", {"lo": low, "hi": high})  # one row
    inside = x.join(F.broadcast(span)).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    place = F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    cells = inside.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")).groupBy(label, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(label))
    return cells.select(label, "bin", "n", F.try_divide(F.col("n") / total, (F.col("hi") - F.col("lo")) / bins).alias("density"))


def presence(gt: DataFrame, pred: DataFrame, methods: list[str], by: str = "method") -> DataFrame:
    """``gt`` with a flag per method: does any of its detections overlap?"""
    pairs = overlap_join(gt, pred, ["session"]).groupBy("session", "event_id").agg(*(F.bool_or(F.col(f"b_{by}") == m).alias(m) for m in methods))
    return gt.join(pairs, ["session", "event_id"], "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in methods})


def miss_categories(gt: DataFrame, pred: DataFrame, target: str, methods: list[str], by: str = "method") -> DataFrame:
    """category, n: calls the target misses (everyone or only it), its false events (its own or shared)."""
    others = [m for m in methods if m != target]
    any_other = lambda: F.array_max(F.array(*(F.col(m) for m in others)))
    missed = presence(gt, pred, methods, by).where(~F.col(target)).select(F.when(any_other(), "miss_others_hit").otherwise("miss_all").alias("category"))
    events = merge_intervals(pred.where(F.col(by) == target), ["session"]).withColumnRenamed("event_no", "event_id")
    false = overlap_flag_asof(events.select("session", "event_id", "t0_us", "t1_us"), gt.select("session", "t0_us", "t1_us"), ["session"]).where(~F.col("hit")).drop("hit")
    spurious = presence(false, pred, others, by).select(F.when(any_other(), "fp_shared").otherwise("fp_only").alias("category"))
    return missed.unionByName(spurious).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def bout_relation(pred: DataFrame, bout_spans: DataFrame, gt: DataFrame, pad_us: int = 0, bucket_us: int = BUCKET_US) -> DataFrame:
    """Per (bout, detection near it): does it hit the bout's calls, other calls, or none?

    ``bout_spans`` has session, bout_id, start_us, stop_us, ``gt`` the calls with their bout_id. Both
    joins are by session and bucket of time.
    """
    near = in_context(pred.select("session", "event_id", "t0_us", "t1_us"), bout_spans.select("session", "bout_id", "start_us", "stop_us"), ["session"], pad_us, bucket_us)
    calls = gt.select("session", F.col("bout_id").alias("call_bout"), "t0_us", "t1_us")
    met = overlap_join(pred.select("session", "event_id", "t0_us", "t1_us"), calls, ["session"], bucket_us).select("session", "event_id", F.col("b_call_bout").alias("call_bout")).distinct()
    both = near.join(met, ["session", "event_id"], "left")
    own, other = F.bool_or(F.coalesce(F.col("call_bout") == F.col("bout_id"), F.lit(False))), F.bool_or(F.coalesce(F.col("call_bout") != F.col("bout_id"), F.lit(False)))
    return both.groupBy("session", "bout_id", "event_id").agg(F.when(own, "in_bout").when(other, "other_call").otherwise("fp").alias("relation"))
