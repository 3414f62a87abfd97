"""Gates over detection features: filters with reasons, strategies, cross-validation, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpline.functions.metrics import event_metrics, matching_metrics
from chirpline.operators.intervals import BUCKET_US
from chirpline.operators.scoring import COUNTS, counts_by_set, micro

OPS = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v}


def stage1_ok(min_area: int = 30, max_vertical: float = 8.0, max_horizontal: float = 30.0, max_row: Column | None = None) -> Column:
    """Component gates on area_px, w_px, h_px and y_px (a row below ``max_row`` is too low in pitch)."""
    ok = (F.col("area_px") >= min_area) & (F.col("h_px") <= max_vertical * F.col("w_px")) & (F.col("w_px") <= max_horizontal * F.col("h_px"))
    return ok if max_row is None else ok & (F.col("y_px") <= max_row)


def fate(tests: dict[str, Column]) -> Column:
    """The first test that fails, by name, else ``keep``. A NULL test fails."""
    out = None
    for name, ok in tests.items():
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return F.lit("keep") if out is None else out.otherwise("keep")


def reason(max_area_frac: float | None = 0.15, min_cols: float = 5, min_sweep_frac: float = 0.04, min_centroid_hz: float | None = 25000.0, max_flatness: float | None = None) -> Column:
    """Why a detection goes, in fixed order; a spectral gate is skipped where its feature is NULL."""
    never = F.lit(False)
    return (
        F.when(F.coalesce(F.col("area_frac") > max_area_frac, never) if max_area_frac is not None else never, "too_big")
        .when(F.col("n_cols") < min_cols, "too_short")
        .when(F.col("sweep_frac") < min_sweep_frac if min_sweep_frac > 0 else never, "flat")
        .when(F.coalesce(F.col("centroid_hz") < min_centroid_hz, never) if min_centroid_hz is not None else never, "low_centroid")
        .when(F.coalesce(F.col("flatness") > max_flatness, never) if max_flatness is not None else never, "high_flatness")
        .otherwise("keep")
    )


def passes(gates: list[tuple[str, str, float]]) -> Column:
    """Conjunction of (feature, operator, threshold); a NULL feature is rejected."""
    return reduce(lambda a, g: a & F.coalesce(OPS[g[1]](F.col(g[0]), F.lit(g[2])), F.lit(False)), gates, F.lit(True))


def refilter(det: DataFrame, why: Column, by: list[str], order: list[str]) -> DataFrame:
    """``det`` with reason and, for kept rows, a fresh id from 0 in each ``by``."""
    tagged = det.withColumn("reason", why)
    fresh = F.row_number().over(Window.partitionBy(*by, F.col("reason") == "keep").orderBy(*order)) - 1
    return tagged.withColumn("new_id", F.when(F.col("reason") == "keep", fresh))


def reason_counts(det: DataFrame, why: Column, by: list[str] = ()) -> DataFrame:
    return det.groupBy(*by, why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def clean_components(comp: DataFrame, image: list[str], share: float = 0.1, min_area: float = 30, min_total: float = 60) -> DataFrame:
    """Components of at least a share of their image's largest; none of an image with too little in all."""
    of = Window.partitionBy(*image)
    return comp.withColumns({"__top": F.max("area").over(of), "__all": F.sum("area").over(of)}).where((F.col("area") >= share * F.col("__top")) & (F.col("area") >= min_area) & (F.col("__all") >= min_total)).drop("__top", "__all")


def skip_reason(box: tuple[str, str, str, str], min_px: float, min_score: float | None = None, missing: Column | None = None, score: str = "score") -> Column:
    """Why a crop (x0, y0, x1, y1 of its columns) is skipped, else ``keep``. A NULL score counts as 1."""
    x0, y0, x1, y1 = map(F.col, box)
    low = F.coalesce(F.col(score), F.lit(1.0)) < min_score if min_score is not None else F.lit(False)
    gone = F.lit(False) if missing is None else F.coalesce(missing, F.lit(False))
    small = (x1 - x0 < min_px) | (y1 - y0 < min_px)
    return F.when(low, "low_score").when(gone, "missing_png").when(small, "small_crop").otherwise("keep")


def kept_by(det: DataFrame, gt: DataFrame, named: dict[str, Column], by: list[str], more: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(calls, detections) with a strategy each: all calls, and the detections that its gates keep.

    There are as many copies as gate sets, a number that doesn't depend on the data.
    """
    each = F.array(*(F.struct(F.lit(n).alias("strategy"), F.coalesce(c, F.lit(False)).alias("keep")) for n, c in named.items()))
    kept = det.select(*by, *more, "t0_us", "t1_us", F.explode(F.filter(each, lambda s: s["keep"])).alias("s")).select("s.strategy", *by, *more, "t0_us", "t1_us")
    calls = gt.select(F.explode(F.array(*map(F.lit, named))).alias("strategy"), *by, "event_id", "t0_us", "t1_us")
    return calls, kept


def rescored(det: DataFrame, gt: DataFrame, named: dict[str, Column], by: list[str] = ("session",), bucket_us: int = BUCKET_US) -> DataFrame:
    """strategy, by and counts: the detections that each gate set keeps, merged to events and scored anew.

    Recall is over all calls of a session, also of sessions that keep nothing.
    """
    got = counts_by_set(gt, det, list(named.values()), list(by), bucket_us)
    return got.select(F.array(*map(F.lit, named))[F.col("set")].alias("strategy"), *by, *COUNTS)


def strategies(det: DataFrame, gt: DataFrame, named: dict[str, Column], by: list[str] = ("session",)) -> DataFrame:
    """Event counts and metrics of each named gate set, pooled over sessions, and the detections it keeps."""
    return micro(rescored(det, gt, named, by), ["strategy"]).withColumnRenamed("n_boxes", "n_kept")


def folds(sessions: DataFrame, key: str, k: int) -> DataFrame:
    """Fold of each session: its position in order, modulo k. A row per session."""
    names = sessions.select(key).distinct()
    return names.withColumn("fold", (F.row_number().over(Window.orderBy(key)) - 1) % k)


def by_fold(det: DataFrame, gt: DataFrame, key: str, named: dict[str, Column], k: int) -> DataFrame:
    """fold, strategy and counts, of the sessions with ground truth."""
    per = rescored(det, gt, named, [key]).join(folds(gt, key, k), key)
    return per.groupBy("fold", "strategy").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))


def grouped_cv(det: DataFrame, gt: DataFrame, key: str, named: dict[str, Column], k: int) -> DataFrame:
    """Mean and population deviation of each strategy's event metrics over folds of sessions."""
    per = by_fold(det, gt, key, named, k).withColumns(event_metrics())
    stats = [f(m).alias(f"{m}_{n}") for m in ("recall", "precision", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return per.groupBy("strategy").agg(*stats, F.count("f1").alias("n_folds"))


def train_and_held_out(det: DataFrame, gt: DataFrame, key: str, named: dict[str, Column], k: int) -> DataFrame:
    """fold, strategy: the best event F1 on the other folds (ties by name), with its F1 there and held out."""
    counted = by_fold(det, gt, key, named, k)
    total = Window.partitionBy("strategy")
    rest = counted.select("fold", "strategy", *((F.sum(c).over(total) - F.col(c)).alias(c) for c in ("tp", "fn", "pred_tp", "fp"))).withColumns(event_metrics())
    first = Window.partitionBy("fold").orderBy(F.coalesce("f1", F.lit(-1.0)).desc(), "strategy")
    best = rest.withColumn("n", F.row_number().over(first)).where("n = 1").select("fold", "strategy", F.col("f1").alias("train_f1"))
    return best.join(counted.withColumns(event_metrics()).select("fold", "strategy", F.col("f1").alias("test_f1")), ["fold", "strategy"])


def two_stage(det: DataFrame, gt: DataFrame, first: dict[str, Column], second: dict[str, Column], eps: float = 0.01) -> DataFrame:
    """plan, strategy, f1: the best (stage 1, stage 2) by event F1, and the recall-first choice: of the
    first stages within eps of the best recall the one with fewest candidates, then the second stage of
    best F1."""
    grid = strategies(det, gt, {f"{a}|{b}": x & y for a, x in first.items() for b, y in second.items()})
    alone = strategies(det, gt, first)
    best = [F.coalesce("f1", F.lit(-1.0)).desc(), F.col("strategy")]
    joint = grid.orderBy(*best).limit(1).select(F.lit("joint").alias("plan"), "strategy", "f1")
    top = alone.agg(F.max("recall").alias("top"))
    lean = alone.join(F.broadcast(top)).where(F.col("recall") >= F.col("top") - eps).orderBy("n_kept", "strategy").limit(1).select(F.col("strategy").alias("a"))
    staged = grid.join(F.broadcast(lean), F.split_part("strategy", F.lit("|"), F.lit(1)) == F.col("a")).orderBy(*best).limit(1)
    return joint.unionByName(staged.select(F.lit("staged").alias("plan"), "strategy", "f1"))


def forward_selection(det: DataFrame, gt: DataFrame, pool: list[tuple[str, str, float]], min_gain: float = 0.002) -> list[tuple[tuple[str, str, float], float]]:
    """Gates chosen greedily by event F1, one for each feature, with the F1 that each reaches."""
    return selection_steps(det, gt, pool, min_gain)[1:]


def selection_steps(det: DataFrame, gt: DataFrame, pool: list[tuple[str, str, float]], min_gain: float = 0.002) -> list[tuple[tuple[str, str, float] | None, float]]:
    """The steps of :func:`forward_selection`.

    The first entry, without a gate (None), is the F1 of all detections. A round is one job over all
    gates left, the first also over no gate; it ends where the best gains no more than ``min_gain``.
    """
    chosen: list = []
    while True:
        gates = [g for g, _ in chosen if g]
        used = {g[0] for g in gates}
        named = {str(i): passes([*gates, gate]) for i, gate in enumerate(pool) if gate[0] not in used}
        if chosen and not named:
            break
        scored = {int(r["strategy"]): r["f1"] for r in strategies(det, gt, named if chosen else {"-1": F.lit(True), **named}).collect()}  # a row for each gate
        if not chosen:
            best = scored.pop(-1, None) or 0.0
            chosen.append((None, best))
        top = max(scored, key=lambda i: (-1.0 if scored[i] is None else scored[i], -i), default=None)
        if top is None or (scored[top] or 0.0) <= best + min_gain:
            break
        best = scored[top]
        chosen.append((pool[top], best))
    return chosen


def matching_sweep(det: DataFrame, gt: DataFrame, named: dict[str, Column], by: list[str] = ("session", "channel"), iou: float = 0.0) -> DataFrame:
    """strategy, tp, fp, fn and metrics of greedy one-to-one matches within each ``by``, over all of them."""
    from chirpline.operators.matching import greedy_match

    keep = list(named.values())
    m = greedy_match(gt, det, list(by), iou, keep=keep).groupBy("set").agg(F.count(F.lit(1)).alias("tp"))
    kept = det.agg(F.array(*map(F.count_if, keep)).alias("n")).select(F.posexplode("n").alias("set", "n_pred"))
    n = kept.crossJoin(gt.agg(F.count(F.lit(1)).alias("n_gt"))).join(m, "set", "left").fillna(0, ["tp"]).where("n_gt > 0 or n_pred > 0")
    name = F.array(*map(F.lit, named))[F.col("set")].alias("strategy")
    return n.select(name, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn")).withColumns(matching_metrics())


def random_configs(spark, n: int, ranges: dict[str, tuple[float, float]], seed: int = 0) -> DataFrame:
    """trial and a value per named range, drawn by hash: the same on every run."""

    def draw(name):
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("trial").cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)

    return spark.range(n).select(F.col("id").alias("trial")).withColumns({name: F.lit(lo) + draw(name) * (hi - lo) for name, (lo, hi) in ranges.items()})


def search(det: DataFrame, gt: DataFrame, configs: DataFrame, keep: Column, by: list[str] = ("session",)) -> DataFrame:
    """Event counts and metrics of every trial. ``configs`` is a table of trials (its values are named cfg_...)."""
    cfg = configs.select("trial", *(F.col(c).alias(f"cfg_{c}") for c in configs.columns if c != "trial"))
    settings = cfg.collect()  # a few hundred trials
    named = [c for c in cfg.columns if c != "trial"]
    for i, s in enumerate(settings):
        det = det.withColumns({c: F.lit(s[c]) for c in named}).withColumn(f"__keep{i}", keep)
    per = counts_by_set(gt, det, [F.col(f"__keep{i}") for i in range(len(settings))], list(by))
    per = per.withColumn("trial", F.array(*(F.lit(s["trial"]).cast(cfg.schema["trial"].dataType) for s in settings))[F.col("set")])
    return micro(per, ["trial"]).withColumnRenamed("n_boxes", "n_kept").join(cfg, "trial")


def rank(trials: DataFrame, metric: str = "f1", n: int = 5) -> DataFrame:
    """The n best trials; an undefined metric counts as -1."""
    return trials.orderBy(F.coalesce(metric, F.lit(-1.0)).desc(), "trial").limit(n)
