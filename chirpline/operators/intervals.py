"""Interval operators: merging, sessionising, runs, and overlap joins in three physical forms.

All take ``by``, the columns that part independent time lines (usually the session).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpline.functions.intervals import iou_1d, overlaps
from chirpline.operators.scan import EARLIER, LINE, UPTO, carried, in_bucket, on_lines, running_count

#: Default bucket of the range join: 6 hours.
BUCKET_US = 21_600_000_000
#: Frames of a bucket in which runs are looked for.
BUCKET_FRAMES = 65_536


def tag_merged(df: DataFrame, by: list[str], strict: bool = False, gap_us: int = 0, order: list[str] = (), bucket_us: int = BUCKET_US) -> DataFrame:
    """``df`` with event_no: which merged event of its time line a row falls into, from 0.

    Touching intervals merge, or with ``strict`` only overlapping ones; ``gap_us`` bridges gaps. The
    furthest end so far, then the number of events so far, is carried from bucket to bucket.
    """
    rows = _event_starts(on_lines(df, by, F.col("t0_us"), bucket_us), strict, gap_us, order)
    out = running_count(rows, "__new", "event_no", ["t0_us", "t1_us", *order])
    return out.select(*df.columns, (F.col("event_no") - 1).alias("event_no"))


def _event_starts(rows: DataFrame, strict: bool, gap_us: int, order: list[str] = ()) -> DataFrame:
    """Rows on lines with ``__new``: does a merged event start here?"""
    rows = carried(rows, {"__furthest": F.max("t1_us")}, {"__reach": lambda before, after: F.max("__furthest").over(before)})
    reach = F.greatest(F.col("__reach"), F.max("t1_us").over(in_bucket("t0_us", "t1_us", *order, frame=EARLIER))) + gap_us
    new = F.col("t0_us") >= reach if strict else F.col("t0_us") > reach
    return rows.withColumn("__new", F.coalesce(new, reach.isNull())).drop("__reach")


def merge_intervals(df: DataFrame, by: list[str], strict: bool = False, gap_us: int = 0, first: list[str] = (), bucket_us: int = BUCKET_US) -> DataFrame:
    """Disjoint events: by, event_no, t0_us, t1_us, n_boxes and the first interval's ``first`` columns.

    The intervals of a bucket that fall into one event are merged where they lie, so that only parts
    of events are numbered and, where an event reaches over buckets, put together.
    """
    rows = df.select(*by, "t0_us", "t1_us", F.struct(F.col("t0_us"), F.col("t1_us"), *first).alias("__first"))
    rows = _event_starts(on_lines(rows, by, F.col("t0_us"), bucket_us), strict, gap_us)
    rows = rows.withColumn("__no", F.sum(F.col("__new").cast("long")).over(in_bucket("t0_us", "t1_us", frame=UPTO)))
    parts = rows.groupBy(LINE, "__no").agg(*(F.first(c).alias(c) for c in by), F.min("t0_us").alias("t0_us"), F.max("t1_us").alias("t1_us"), F.count(F.lit(1)).alias("n_boxes"), F.min("__first").alias("__first"))
    parts = carried(parts, {"__n": F.max("__no")}, {"__base": lambda before, after: F.coalesce(F.sum("__n").over(before), F.lit(0))})
    out = parts.groupBy(*by, (F.col("__base") + F.col("__no") - 1).alias("event_no")).agg(F.min("t0_us").alias("t0_us"), F.max("t1_us").alias("t1_us"), F.sum("n_boxes").alias("n_boxes"), F.min("__first").alias("__first"))
    return out.select(*by, "event_no", "t0_us", "t1_us", "n_boxes", *(F.col(f"__first.{c}").alias(c) for c in first))


def bouts(df: DataFrame, by: list[str], gap_us: int, order: list[str] = (), bucket_us: int = BUCKET_US) -> DataFrame:
    """``df`` with bout_id (from 0 in each time line) and ici_us, the gap to the next call of the bout.

    The gap is measured to the end of the call before, not to the furthest end so far. The last call
    of the buckets before and the first of those after stand in for the neighbours of a bucket's ends.
    """
    key = ["t0_us", "t1_us", *order]
    place = F.struct(*key)
    rows = carried(
        on_lines(df, by, F.col("t0_us"), bucket_us),
        {"__low": F.min(place), "__high": F.max(place)},
        {"__was": lambda before, after: F.last("__high").over(before)["t1_us"], "__next": lambda before, after: F.first("__low").over(after)["t0_us"]},
    )
    line = in_bucket(*key)
    here = F.row_number().over(line)
    size = F.count(F.lit(1)).over(Window.partitionBy(LINE))
    was = F.when(here == 1, F.col("__was")).otherwise(F.lag("t1_us").over(line))
    following = F.when(here == size, F.col("__next")).otherwise(F.lead("t0_us").over(line))
    apart = lambda gap: F.coalesce(gap > gap_us, F.lit(False))
    rows = rows.withColumns({"__new": apart(F.col("t0_us") - was), "ici_us": F.when(~apart(following - F.col("t1_us")), following - F.col("t1_us"))})
    return running_count(rows, "__new", "bout_id", key).select(*df.columns, "bout_id", "ici_us")


def runs(df: DataFrame, by: list[str], flag: Column, at: str, min_us: int = 0, gap_us: int | None = None, bucket: int = BUCKET_FRAMES) -> DataFrame:
    """Runs of true flags as t0_us, t1_us: a run ends at the first frame after it, the last frame at most.

    ``gap_us`` bridges gaps between runs (a bridged run ends where the later one ends); runs
    shorter than ``min_us`` are dropped after that. Frames are dealt over buckets of ``bucket`` of ``at``.
    """
    rows = df.select(*by, F.col(at).alias("__at"), flag.alias("__on"))
    rows = carried(
        on_lines(rows, by, F.col("__at"), bucket),
        {"__low": F.min("__at"), "__high": F.max(F.struct("__at", "__on"))},
        {"__lit": lambda before, after: F.last("__high").over(before)["__on"], "__beyond": lambda before, after: F.first("__low").over(after)},
    )
    line = in_bucket("__at")
    here, size = F.row_number().over(line), F.count(F.lit(1)).over(Window.partitionBy(LINE))
    was = F.when(here == 1, F.col("__lit")).otherwise(F.lag("__on").over(line))
    end = F.coalesce(F.when(here == size, F.col("__beyond")).otherwise(F.lead("__at").over(line)), F.col("__at"))
    rows = rows.withColumns({"__end": end, "__new": F.coalesce(F.col("__on"), F.lit(False)) & ~F.coalesce(was, F.lit(False))})
    on = running_count(rows, "__new", "__run", ["__at"]).where("__on")
    out = on.groupBy(*by, "__run").agg(F.min("__at").alias("t0_us"), F.max("__end").alias("t1_us")).drop("__run")
    if gap_us is not None:
        out = bouts(out, by, gap_us, bucket_us=bucket).groupBy(*by, "bout_id").agg(F.min("t0_us").alias("t0_us"), F.max_by("t1_us", "t0_us").alias("t1_us"))
    return out.where(F.col("t1_us") - F.col("t0_us") >= min_us).select(*by, "t0_us", "t1_us")


def in_buckets(df: DataFrame, bucket_us: int, name: str = "__bucket") -> DataFrame:
    """A row for each bucket of time that an interval touches."""
    first, last = F.floor(F.col("t0_us") / bucket_us), F.floor(F.greatest("t0_us", "t1_us") / bucket_us)
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], bucket_us: int = BUCKET_US, iou: float = 0.0) -> DataFrame:
    """Pairs of overlapping rows: columns of a, and those of b with the prefix ``b_``.

    A hash join by time line and bucket of time; a pair is taken in its first common bucket only,
    so a busy time line is dealt over its buckets and no pair comes twice.
    """
    right = in_buckets(b, bucket_us).select(*(F.col(c).alias(f"b_{c}") for c in b.columns), F.col("__bucket").alias("b___bucket"))
    left = in_buckets(a, bucket_us)
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in by] + [F.col("__bucket") == F.col("b___bucket")]
    at = F.greatest(F.floor(F.col("t0_us") / bucket_us), F.floor(F.col("b_t0_us") / bucket_us))
    hit = overlaps("t0_us", "t1_us", "b_t0_us", "b_t1_us") & (F.col("__bucket") == at)
    if iou > 0:
        hit = hit & (iou_1d("t0_us", "t1_us", "b_t0_us", "b_t1_us") > iou)
    return left.join(right, on + [hit]).drop("__bucket", "b___bucket")


def overlap_flag(a: DataFrame, b: DataFrame, by: list[str], key: list[str], iou: float = 0.0, bucket_us: int = BUCKET_US, name: str = "hit") -> DataFrame:
    """``a`` with a flag whether any row of b overlaps it (by more than ``iou`` where that is set).

    ``key`` names the columns that identify a row of a.
    """
    found = overlap_join(a, b, by, bucket_us, iou).select(*(F.col(c).alias(f"__{c}") for c in key)).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return a.join(found.withColumn("__hit", F.lit(True)), on, "left").select(*a.columns, F.coalesce("__hit", F.lit(False)).alias(name))


def overlap_flag_asof(a: DataFrame, b: DataFrame, by: list[str], name: str = "hit", bucket_us: int = BUCKET_US) -> DataFrame:
    """The same flag for plain overlap, without a join of the two: one sort of both sides.

    A row is overlapped if, of the rows of b that start before its end, the one that ends last ends
    after its start. So the furthest end runs along the line; probes stand before rows of b of the same
    time, so touching ones don't match. Points match nothing.
    """
    cols = [c for c in a.columns if c not in by]
    probe = a.select(*by, F.col("t1_us").alias("__at"), F.lit(1).alias("__kind"), F.struct(*cols).alias("__row"), F.lit(None).cast("long").alias("__end"))
    no_row = F.lit(None).cast(probe.schema["__row"].dataType).alias("__row")
    event = b.where(F.col("t1_us") > F.col("t0_us")).select(*by, F.col("t0_us").alias("__at"), F.lit(2).alias("__kind"), no_row, F.col("t1_us").alias("__end"))
    both = carried(on_lines(probe.unionByName(event), by, F.col("__at"), bucket_us), {"__furthest": F.max("__end")}, {"__reach": lambda before, after: F.max("__furthest").over(before)})
    reach = F.greatest("__reach", F.max("__end").over(in_bucket("__at", "__kind", frame=UPTO)))
    out = both.withColumn("__reach", reach).where("__kind = 1").select(*by, "__row.*", "__reach")
    hit = (F.col("__reach") > F.col("t0_us")) & (F.col("t1_us") > F.col("t0_us"))
    return out.select(*a.columns, F.coalesce(hit, F.lit(False)).alias(name))


def in_context(rows: DataFrame, spans: DataFrame, by: list[str], pad_us: int = 0, bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows beside each span (start_us, stop_us and its other columns) that they touch, ends included.

    Spans are widened by ``pad_us``; both sides meet by bucket of time.
    """
    wide = spans.withColumns({"t0_us": F.col("start_us") - pad_us, "t1_us": F.col("stop_us") + pad_us})
    s = in_buckets(wide, bucket_us).withColumnsRenamed({"t0_us": "__w0", "t1_us": "__w1"})
    r = in_buckets(rows, bucket_us)
    first = F.greatest(F.floor(F.col("t0_us") / bucket_us), F.floor(F.col("__w0") / bucket_us))
    near = (F.col("t1_us") >= F.col("__w0")) & (F.col("t0_us") <= F.col("__w1")) & (F.col("__bucket") == first)
    return r.join(s, [*by, "__bucket"]).where(near).drop("__bucket", "__w0", "__w1")


def assign_chunk(mid: Column, start_us: int, length_us: int, chunks: int) -> Column:
    """Chunk of a time on a fixed grid; times past the last chunk fall into it, others before the first into 0."""
    return F.greatest(F.lit(0), F.least(F.lit(chunks - 1), F.floor((mid - start_us) / length_us))).cast("long")


def chunks_touched(df: DataFrame, start_us: int, length_us: int, chunks: int, pad_us: int = 0) -> DataFrame:
    """A row for each chunk of the grid that an interval, padded at both ends, overlaps."""
    first = F.greatest(F.lit(0), F.floor((F.col("t0_us") - pad_us - start_us) / length_us))
    last = F.least(F.lit(chunks - 1), F.ceil((F.col("t1_us") + pad_us - start_us) / length_us) - 1)
    return df.withColumn("__span", F.when(last >= first, F.sequence(first.cast("long"), last.cast("long")))).withColumn("chunk", F.explode("__span")).drop("__span")


def assign_window(points: DataFrame, windows: DataFrame, by: list[str], at: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """``points`` with w_start_us of the last window that starts at or before them, else the first window.

    For windows of any length: one sort, no join of the two. Half-open: a point at a border falls in the later.
    """
    cols = [c for c in points.columns if c not in by]
    p = points.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*cols).alias("__row"), F.lit(None).cast("long").alias("__w"))
    w = windows.select(*by, F.col("w_start_us").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.col("w_start_us").alias("__w"))
    both = carried(
        on_lines(p.unionByName(w), by, F.col("__at"), bucket_us),
        {"__high": F.max("__w"), "__low": F.min("__w")},
        {"__was": lambda before, after: F.max("__high").over(before), "__next": lambda before, after: F.min("__low").over(after)},
    )
    own = F.max("__w").over(in_bucket("__at", "__kind", frame=UPTO))
    later = F.least(F.min("__w").over(Window.partitionBy(LINE)), F.col("__next"))  # of a point before all windows
    out = both.withColumn("w_start_us", F.coalesce(own, F.col("__was"), later))
    return out.where("__kind = 1").select(*by, "__row.*", "w_start_us")
