"""One-to-one matching of intervals, suppression of boxes, best candidates, channel attribution."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpline.functions.intervals import box_area, box_containment, natural_key
from chirpline.functions.metrics import matching_metrics
from chirpline.sources.shared import cut, drop_cut

BOX = ("x1", "y1", "x2", "y2")
#: Least stretch of time in which a matching begins, 10 minutes, and how many mean lengths of an interval it has.
MATCH_BUCKET_US = 600_000_000
LENGTHS = 32
#: Boxes of an image from which they are dealt over a grid.
DENSE = 20_000
#: Growth of the stretches from round to round of a matching.
WIDER = 16


def greedy_match(gt: DataFrame, pred: DataFrame, by: list[str], iou: float = 0.0, key: str = "event_id", bucket_us: int | None = None, keep: list[Column] | None = None) -> DataFrame:
    """by, gt id, pred id, iou of the pairs chosen best first; ties go to the higher place in time.

    With ``keep`` each condition's detections are matched for themselves, and ``set`` (the condition's place)
    comes first; intervals are still dealt once, with the sets that they belong to.

    Intervals, never pairs, are dealt over stretches of time, to all that they touch. A stretch decides
    its pairs as one by one, as far as that can be known there: one that reaches over a border waits, and
    what it could still take waits with it. What waits goes on to the next round, over stretches ``WIDER``
    times as long with other borders, so rounds grow with the logarithm of the longest chain of intervals
    that wait for each other. Files and a task's memory grow with the intervals, not with their pairs.
    """
    line, more, match = list(by), [], _decide(by, iou)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in gt.select(*by).schema.fields]
    if keep is not None:
        line, more, kinds, match = ["set", *by], ["__keep"], ["set int", *kinds], _decide_sets(by, iou, len(keep))
        gt = gt.withColumn("__keep", F.array_repeat(F.lit(True), len(keep)))
        pred = pred.withColumn("__keep", F.array(*(F.coalesce(k, F.lit(False)) for k in keep))).where(F.array_contains("__keep", True))
    side = lambda df, n: df.where("t1_us > t0_us").select(*by, F.lit(n).alias("side"), F.col(key).cast("long").alias("id"), "t0_us", "t1_us", *more)
    left = side(gt, 0).unionByName(side(pred, 1))
    if bucket_us is None:
        mean = left.agg(F.avg(F.col("t1_us") - F.col("t0_us"))).first()[0]
        bucket_us = max(MATCH_BUCKET_US, int(LENGTHS * (mean or 0)))
    schema = ", ".join([*kinds, "side int", "id long", "t0_us long", "t1_us long", "pred_id long", "iou double"])
    chosen, width, groups = [], bucket_us, list(by)
    while True:
        first, last = (F.floor((F.col(c) + d + width // 2) / width) for c, d in (("t0_us", 0), ("t1_us", -1)))
        dealt = left.withColumns({"__first": first, "__last": last}).withColumn("__at", F.explode(F.sequence("__first", "__last"))).withColumn("__over", F.col("__first") < F.col("__last"))
        done = cut(dealt.drop("__first", "__last").groupBy(*groups, "__at").applyInArrow(match, schema), "match-round")
        chosen.append(done.where("iou is not null"))
        left, width = done.where("iou is null").select(*line, "side", "id", "t0_us", "t1_us"), width * WIDER
        if left.isEmpty():
            break
        groups, match = line, _decide(line, iou)
    return reduce(DataFrame.unionByName, chosen).select(*line, F.col("id").alias("gt_id"), "pred_id", "iou")


def _decide(by: list[str], least: float):
    """A function of a stretch's intervals: matched ones with pred_id and iou, waiting ones without.

    Intervals of one side, start and end stand together, highest id first. Calls lie in a heap by their
    best pair with a detection that has copies left, so the top is the best of all free pairs. Those of
    an interval are looked up among the detections that start before its end, never all kept.
    """

    def run(rows: pa.Table) -> pa.Table:
        order = [("side", "ascending"), ("t0_us", "ascending"), ("t1_us", "ascending"), ("id", "descending")]
        rows = rows.sort_by(order).combine_chunks()
        side, start, end = (rows.column(c).to_numpy().astype("int64") for c in ("side", "t0_us", "t1_us"))
        known, ids = rows.column("id").is_valid().to_numpy(), rows.column("id").fill_null(0).to_numpy()
        differs = lambda *cols: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        once = np.flatnonzero(differs(side, start, end, known, ids))
        side, start, end, over = side[once], start[once], end[once], rows.column("__over").to_numpy()[once]
        heads = np.flatnonzero(differs(side, start, end))
        left = np.diff([*heads, len(once)])
        n = int((side[heads] == 0).sum())
        g0, g1, p0, p1 = start[heads[:n]], end[heads[:n]], start[heads[n:]], end[heads[n:]]
        g_left, p_left, g_over, p_over = left[:n].tolist(), left[n:].copy(), over[heads[:n]], over[heads[n:]]
        g_next, p_next = heads[:n].tolist(), heads[n:].tolist()
        reach = np.maximum.accumulate(p1) if len(p1) else p1
        lows, highs = np.searchsorted(reach, g0, "right").tolist(), np.searchsorted(p0, g1, "left").tolist()
        waits, near = np.where(p_over, np.inf, -np.inf), np.zeros(len(p0), bool)
        taken, with_, share, waiting = [], [], [], []

        def pairs(i):
            """Free detections that call i overlaps, and their shared over joint length."""
            at = lows[i] + np.flatnonzero((p1[lows[i] : highs[i]] > g0[i]) & (p_left[lows[i] : highs[i]] > 0))
            both = np.minimum(p1[at], g1[i]) - np.maximum(p0[at], g0[i])
            value = both / ((g1[i] - g0[i]) + (p1[at] - p0[at]) - both)
            return (at[value > least], value[value > least]) if least > 0 else (at, value)

        def push(i):
            at, value = pairs(i)
            if len(at):
                j = len(value) - 1 - int(value[::-1].argmax())  # detections are in order of time
                heapq.heappush(heap, (-float(value[j]), -i, int(at[j])))

        def wait(i, top):
            at, value = pairs(i)
            at, value = at[value <= top], value[value <= top]
            waits[at], near[at] = np.maximum(waits[at], value), True
            waiting.append(i)

        heap = []
        for i in range(n):
            wait(i, np.inf) if g_over[i] else push(i)
        while heap:
            low, i, j = heapq.heappop(heap)
            i = -i
            if p_left[j] == 0:
                push(i)
            elif waits[j] >= -low:
                wait(i, -low)
            else:
                m = min(g_left[i], int(p_left[j]))
                taken += range(g_next[i], g_next[i] + m)
                with_ += range(p_next[j], p_next[j] + m)
                share += [-low] * m
                g_left[i] -= m
                p_left[j] -= m
                g_next[i] += m
                p_next[j] += m
                if g_left[i]:
                    push(i)
        open_ = [x for i in waiting if len(pairs(i)[0]) for x in range(g_next[i], g_next[i] + g_left[i])]
        open_ += [x for j in np.flatnonzero(near & (p_left > 0)).tolist() for x in range(p_next[j], p_next[j] + int(p_left[j]))]
        out = rows.select([*by, "side", "id", "t0_us", "t1_us"]).take(pa.array(once[np.array(taken + open_, "int64")]))
        pred_id = rows.column("id").take(pa.array(once[np.array(with_, "int64")])).combine_chunks()
        none = len(open_)
        return out.append_column("pred_id", pa.chunked_array([pred_id, pa.nulls(none, pa.int64())])).append_column("iou", pa.chunked_array([pa.array(share, pa.float64()), pa.nulls(none, pa.float64())]))

    return run


def _decide_sets(by: list[str], least: float, n: int):
    """The same for each of n sets, with its place; an interval comes once, with a flag for each set."""
    match = _decide(by, least)

    def run(rows: pa.Table) -> pa.Table:
        keep = rows.column("__keep").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        there = np.flatnonzero(keep.any(axis=0))
        rows = rows.drop_columns(["__keep"])
        each = [match(rows.filter(pa.array(keep[:, i]))) for i in there]
        return pa.concat_tables(each).add_column(0, "set", pa.array(np.repeat(there, [len(x) for x in each]), pa.int32()))

    return run


def matching_score(gt: DataFrame, pred: DataFrame, by: list[str], iou: float = 0.0) -> DataFrame:
    """Counts and metrics of greedy one-to-one matches per ``by``."""
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    m = n(greedy_match(gt, pred, by, iou), "tp")
    out = n(gt, "n_gt").join(n(pred, "n_pred"), by, "full").join(m, by, "left").fillna(0, ["n_gt", "n_pred", "tp"])
    return out.select(*by, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn")).withColumns(matching_metrics())


def suppress(boxes: DataFrame, by: list[str], iou: float = 0.3, order: list[str] = (), dense: int = DENSE) -> DataFrame:
    """Non-maximum suppression by score in each ``by`` (an image's boxes; ties by ``order``).

    An image's boxes stream through a task in order of score, and only kept boxes are remembered; those
    of images with more than ``dense`` boxes are dealt over the cells of a grid instead. Both give the same.
    """
    sizes = boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.avg(F.abs(F.col("x2") - F.col("x1"))).alias("__w"), F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("__h")).where(F.col("__n") > dense)
    crowded = cut(sizes.select(*(F.col(c).alias(f"__{c}") for c in by), "__w", "__h"), "crowded")
    if crowded.isEmpty():
        return _suppress_streamed(boxes, by, iou, order)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    big = boxes.join(crowded, same).select(*boxes.columns, "__w", "__h")
    small = boxes.join(crowded, same, "left_anti")
    return _suppress_streamed(small, by, iou, order).unionByName(_suppress_by_cells(big, by, iou, order).select(*boxes.columns))


def _suppress_by_cells(boxes: DataFrame, by: list[str], iou: float, order: list[str]) -> DataFrame:
    """Rounds over a grid with cells (__w, __h) of about a box.

    Boxes that overlap share a cell, so a box that is the best left in all its cells stays. There
    is one such box at most in a cell; what it hides there goes, and the next round begins.
    """
    left = cut(boxes.withColumn("__id", F.monotonically_increasing_id()), "boxes")
    kept = []
    rank = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("low"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col("__id").alias("id"))
    span = lambda lo, hi, size: F.sequence(F.floor(F.col(lo) / F.greatest(F.col(size), F.lit(1e-9))), F.floor(F.greatest(F.col(lo), F.col(hi)) / F.greatest(F.col(size), F.lit(1e-9))))
    line = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    while not left.isEmpty():
        at = left.select("__id", rank.alias("rank"), F.struct(*BOX).alias("box"), F.struct(*line).alias("image"), F.explode(span("x1", "x2", "__w")).alias("i"), "y1", "y2", "__h")
        at = at.select("__id", "rank", "box", "image", "i", F.explode(span("y1", "y2", "__h")).alias("j"))
        best = at.groupBy("image", "i", "j").agg(F.min("rank").alias("top"), F.min_by("box", "rank").alias("over"))
        met = cut(at.join(best, ["image", "i", "j"]).select("__id", "box", (F.col("rank") == F.col("top")).alias("first"), F.col("top.id").alias("top"), "over"), "cells")
        won = met.groupBy("__id").agg(F.bool_and("first").alias("won")).where("won").select("__id")
        over, mine = [F.col(f"over.{c}") for c in BOX], [F.col(f"box.{c}") for c in BOX]
        inter = F.greatest(F.lit(0.0), F.least(mine[2], over[2]) - F.greatest(mine[0], over[0])) * F.greatest(F.lit(0.0), F.least(mine[3], over[3]) - F.greatest(mine[1], over[1]))
        both = (mine[2] - mine[0]) * (mine[3] - mine[1]) + (over[2] - over[0]) * (over[3] - over[1])
        hides = F.when(both > inter, inter / (both - inter) > iou).otherwise(False)
        gone = met.where(~F.col("first")).join(won.select(F.col("__id").alias("top")), "top", "left_semi").where(hides).select("__id").distinct()
        kept.append(cut(left.join(won, "__id", "left_semi"), "kept"))
        rest = cut(left.join(won.unionByName(gone), "__id", "left_anti"), "boxes")
        drop_cut(left, met)
        left = rest
    return reduce(DataFrame.unionByName, kept, left)


def _suppress_streamed(boxes: DataFrame, by: list[str], iou: float, order: list[str]) -> DataFrame:
    """The same, an image's boxes through one task."""

    def run(batches):
        image, kept = None, []
        for rows in batches:
            stay = []
            for k, x1, y1, x2, y2 in zip(rows[list(by)].itertuples(index=False, name=None), rows.x1, rows.y1, rows.x2, rows.y2):
                if k != image:
                    image, kept = k, []
                area, hidden = (x2 - x1) * (y2 - y1), False
                for a1, b1, a2, b2, other in kept:
                    inter = max(0.0, min(x2, a2) - max(x1, a1)) * max(0.0, min(y2, b2) - max(y1, b1))
                    if area + other > inter and inter / (area + other - inter) > iou:
                        hidden = True
                        break
                stay.append(not hidden)
                if not hidden:
                    kept.append((x1, y1, x2, y2, area))
            yield rows[stay]

    dealt = boxes.repartition(*by).sortWithinPartitions(*by, F.col("score").desc(), *order)
    return dealt.mapInPandas(run, boxes.schema)


def drop_contained(boxes: DataFrame, by: list[str], key: list[str], share: float = 0.5) -> DataFrame:
    """Boxes of which no larger box of the same ``by`` covers more than ``share``."""
    a, b = boxes.alias("a"), boxes.select(*(F.col(c).alias(f"o_{c}") for c in (*by, *key, *BOX))).alias("b")
    mine, other = tuple(F.col(f"a.{c}") for c in BOX), tuple(F.col(f"b.o_{c}") for c in BOX)
    same = [F.col(f"a.{c}") == F.col(f"b.o_{c}") for c in by]
    hides = (box_area(other) > box_area(mine)) & (box_area(mine) > 0) & (box_containment(mine, other) > share)
    return a.join(b, [*same, hides], "left_anti")


def best_candidate(df: DataFrame, by: list[str], score: str = "score", order: list[str] = ()) -> DataFrame:
    """The best candidate of each window; only scores above 0 qualify."""
    return top_k(df.where(F.col(score) > 0), by, 1, F.col(score).desc(), order)


def candidate_score(mean_response: str = "mean_response", extent: str = "extent"):
    return F.col(mean_response) * (1 - F.col(extent))


def top_k(df: DataFrame, by: list[str], k: int, first, order: list[str] = ()) -> DataFrame:
    """The k first rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(first, *order))).where(F.col("rank") <= k)


def best_event(df: DataFrame, by: list[str], duration: str, pitch: str, min_duration: float, min_pitch: float | None = None) -> DataFrame:
    """The longest event of each window, ties by pitch, after a least duration and, where given, pitch."""
    rest = [c for c in df.columns if c not in by]
    df = df if min_pitch is None else df.where(F.col(pitch) >= min_pitch)
    return df.where(F.col(duration) >= min_duration).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(duration, pitch)).alias("e")).select(*by, "e.*")


def attribute_channel(df: DataFrame, by: str, order: list[str] = ()) -> DataFrame:
    """by, channel, rule: the only channel, else the one of larger SNR, or of larger power where an SNR is 0."""
    one = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min("snr").alias("least"),
        F.max_by("channel", F.struct("snr", "power", *order)).alias("by_snr"), F.max_by("channel", F.struct("power", "snr", *order)).alias("by_power"),
    )
    rule = F.when(F.col("n") == 1, "single").when(F.col("least") == 0, "power").otherwise("snr")
    return one.select(by, F.when(rule == "power", F.col("by_power")).otherwise(F.col("by_snr")).alias("channel"), rule.alias("rule"))


def hash_order(seed: int, *cols: str):
    """A seeded pseudo-random order that doesn't depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols)))


def capped_sample(df: DataFrame, category: str, capped: list[str], cap: int, seed: int, key: str) -> DataFrame:
    """At most ``cap`` random rows of the named categories, all rows of the others."""
    n = F.row_number().over(Window.partitionBy(category).orderBy(hash_order(seed, key), key))
    return df.withColumn("__n", n).where(~F.col(category).isin(capped) | (F.col("__n") <= cap)).drop("__n")


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def diverse_examples(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """For each feature the rows of least and greatest value; a row is taken once, for its first reason."""
    picks = df.agg(*(f(F.struct(df.columns[0], *df.columns[1:]), F.struct(F.col(c), F.col(key))).alias(f"{c}_{n}") for c in features for n, f in (("min", F.min_by), ("max", F.max_by))))
    names = [f"{c}_{n}" for c in features for n in ("min", "max")]
    each = picks.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("why"), F.col(n).alias("row")) for i, n in enumerate(names)))).alias("x")).select("x.*")
    return each.groupBy(F.col("row")).agg(F.min_by("why", "place").alias("why")).select("why", "row.*")


def equal_shards(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows with shard and place: shards of exactly n rows in order; a short last one goes unless it is the only one.

    Places come from counts per range partition plus a place within it, so no task sees all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    bases = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"), F.sum("__size").over(Window.partitionBy()).alias("__total"))
    placed = ranged.join(F.broadcast(bases), "__part").withColumn("place", F.col("__base") + F.col("__row"))
    whole = F.floor(F.col("__total") / n)
    placed = placed.withColumn("shard", F.floor(F.col("place") / n)).where((F.col("shard") < whole) | (whole == 0))
    return placed.drop("__part", "__row", "__size", "__base", "__total")


def natural_order(df: DataFrame, text: str, order: list[str] = ()) -> DataFrame:
    """All rows with their place, from 1, by the text's embedded numbers; no task sees all rows."""
    keyed = equal_shards(df.withColumn("__k", natural_key(text)), 1, ["__k", text, *order])
    return keyed.withColumn("place", (F.col("place") + 1).cast("long")).drop("__k", "shard")
