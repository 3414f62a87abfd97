"""Operator 5: exact n-gram Jaccard join of documents by metric-space pivots.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more,
that is, when their Jaccard distance, a metric, is at most t = 0.2. Documents of one set are one
class from the start; only classes are joined.

1. **Voronoi regions.** Pivots are a bounded sample of classes, any two of them further than 4 t
   apart. Every class knows its distance to every pivot exactly. If the nearest is within 2 t, it lies
   in that pivot's region.
2. **Windows.** By the triangle inequality a class whose nearest pivot is at d may link with one in
   the region of another pivot only if it is within d + 2 t of that pivot, and within 3 t: it is
   replicated there. Classes further than t from all pivots also lie in the *outer region*, where those
   are that no pivot is within 2 t of. So two classes that link meet in a region.
3. **Recursion.** Shingle sets are sparse: unrelated documents are at distance 1 from every pivot, on
   each other's boundary, and most lie in the outer region. Every region is therefore parted by
   shingles, in an order from rare to frequent, in which classes that link share one of the first
   ``n - ceil(0.8 n) + 1`` of either, and the parts are joined by pivots of their own, in rounds: a
   part's first pivot meets all its members; a part is settled when its members are all in one
   component, or all have been pivots; else four times as many pivots follow. A member meets a pivot
   only if they are in different components, their sizes and places in the order allow a link, and
   their distances to the first pivot differ by at most t.

Parts of equal membership are joined once, and so is a pair that shares several parts. Every pair of
classes that could link is either met, in one component, or ruled out, so the components are exact.
Distances are computed from whole sets of 64-bit shingle hashes. What is exact up to hashes: two
shingles, or two sets, of one 64-bit hash count as one. Words of up to seven bytes enter a shingle's
hash as they are, longer ones by xxh3, which is not keyed: texts made to collide in it on purpose aren't
told apart.

A part of more than ``PART_ROWS`` members is dealt over several salts, to each of which its pivots are
copied; margins of very frequent shingles are salted before they are shuffled. The frequency order comes
from a sketch of fixed size that counts all shingles of all documents; its errors, and the choice of
pivots, change the cost, never the result. Text is read for the statistics, for the margins, and in each
round for the sets of the classes that meet; no group is gathered in one task or on the driver.

Nulls: a null or wordless text has the empty set and links with nothing, not even its copies. A
null doc_id takes part and never names a component, unless all its members are null. Repeated rows
and rows that repeat a doc_id are separate documents. An empty table gives an empty result. Only the
key and the text are read; :func:`keep_one` returns all columns, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, map_arrow, own_columns, table, text_bytes
from .hashing import BASE, chunk_hashes, mix

WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
SLOT_BITS = 20
SKETCH_PARTS, SKETCH_SALTS = 64, 16
#: Pivots of the Voronoi regions at most, shingles of one at most, and how many classes a task offers.
PIVOTS, PIVOT_SHINGLES, OFFERED = 2_048, 512, 32
#: Classes that a task remembers to have sent (copies sent again are harmless).
REMEMBERED = 200_000
#: Bytes of a table of classes that is broadcast to pick their texts out of all.
BROADCAST_BYTES = 32 << 20
#: Members of a part that one task joins, and rows of a shingle that one task compares.
PART_ROWS, SHINGLE_ROWS = 2_000, 20_000
#: Pivots per part and round grow by this factor.
MORE_PIVOTS = 4
_GROUP_BYTES = 500_000
_STEP = 1 << 17


def shingle_sets(texts: list[bytes], words: int = WORDS):
    """For each text its sorted array of distinct shingle hashes (int64)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t) + 1
        if size >= _GROUP_BYTES or i == len(texts) - 1:
            yield from _shingles(group, words)
            group, size = [], 0


def _shingles(texts: list[bytes], words: int):
    starts, h = chunk_hashes(b" ".join(texts).lower())
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, np.concatenate(([0], ends)))
    n = max(0, len(h) - words + 1)
    g = np.empty(n, np.uint64)
    for i in range(0, n, _STEP):
        part = np.full(min(_STEP, n - i), words, np.uint64)
        for k in range(words):
            part = mix(part * BASE + h[i + k : i + k + len(part)])
        g[i : i + len(part)] = part
    for i, j in zip(cuts, cuts[1:]):
        if j - i >= words:
            yield np.unique(g[i : j - words + 1].view(np.int64))
        elif j > i:
            x = np.full(1, j - i, np.uint64)
            for k in range(i, j):
                x = mix(x * BASE + h[k : k + 1])
            yield x.view(np.int64)
        else:
            yield np.empty(0, np.int64)


def class_id(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a shingle set: its class."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
    return x - (1 << 64) if x >= 1 << 63 else x


def _slots(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _row_key(key: str, text: str):
    """A hash of doc_id and text: only rows that repeat both share it."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


class Pivots:
    """Pivots of the Voronoi regions, by their shingles; ``reach`` is the distance of a link."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.reach = (100 - percent) / 100
        self.home = min(2 * self.reach, 0.99 - self.reach)  # so that a set within home + reach shares a shingle
        kept: list[np.ndarray] = []
        owner: dict[int, list[int]] = {}
        for s in sets:
            common: dict[int, int] = {}
            for x in s.tolist():
                for k in owner.get(x, ()):
                    common[k] = common.get(k, 0) + 1
            if all(1 - c / (len(s) + len(kept[k]) - c) > 4 * self.reach for k, c in common.items()):
                for x in s.tolist():
                    owner.setdefault(x, []).append(len(kept))
                kept.append(s)
        self.sizes = np.array([len(s) for s in kept], np.int64)
        self.keys = np.array(sorted(owner), np.int64)
        lists = [owner[k] for k in self.keys.tolist()]
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.owners = np.array([k for x in lists for k in x], np.int32)

    def regions(self, s: np.ndarray) -> list[int]:
        """The regions of a set, its own first; -1 is the outer one."""
        if not len(self.keys):
            return [-1]
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        if not len(at):
            return [-1]
        first, n = self.offsets[at], np.diff(self.offsets)[at]
        ends = np.cumsum(n)
        common = np.bincount(self.owners[np.repeat(first - ends + n, n) + np.arange(ends[-1])], minlength=len(self.sizes))
        met = np.flatnonzero(common)
        far = 1 - common[met] / (len(s) + self.sizes[met] - common[met])
        least, out = far.min(), []
        if least <= self.home:
            out = met[far <= min(least + 2 * self.reach, self.home + self.reach) + 1e-9].tolist()
        if least > self.home - self.reach - 1e-9:
            out.append(-1)
        return out


def scan(docs: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, np.ndarray, Pivots]:
    """A row per document (doc_id, rid, n, fp), how often each sketch slot's shingles occur, and pivots."""
    names = ["doc_id", "rid", "n", "fp", "part", "counts"]

    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        offered: list[tuple[int, bytes]] = []  # the classes of lowest hash, the highest first
        known: set[int] = set()
        none = lambda n, kind: pa.nulls(n, kind)

        def extra(fp, part, raw):
            k = len(part)
            return pa.RecordBatch.from_arrays([none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int32()), pa.array(fp, pa.int64()), pa.array(part, pa.int32()), pa.array(raw, pa.binary())], names)

        for b in batches:
            n, fp = [], []
            for s in shingle_sets(b.column("text").to_pylist(), words):
                n.append(len(s))
                fp.append(c := class_id(s))
                np.add.at(counts, _slots(s), 1)
                if 0 < len(s) <= PIVOT_SHINGLES and c not in known and (len(offered) < OFFERED or -c > offered[0][0]):
                    known.add(c)
                    heapq.heappush(offered, (-c, s.tobytes()))
                    if len(offered) > OFFERED:
                        known.discard(-heapq.heappop(offered)[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), none(len(n), pa.int32()), none(len(n), pa.binary())], names)
        if counts.any():
            yield extra([None] * SKETCH_PARTS, range(SKETCH_PARTS), [c.tobytes() for c in counts.reshape(SKETCH_PARTS, -1)])
            yield extra([-c for c, _ in offered], [-1] * len(offered), [s for _, s in offered])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _row_key(key, text).alias("rid"), text_bytes(text).alias("text"))
    both = cut(map_arrow(rows, run, "doc_id long, rid long, n int, fp long, part int, counts binary"), "shingle-scan")

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                totals[part] = np.minimum(totals.get(part, 0) + np.frombuffer(raw, np.uint32).astype(np.uint64), 0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in totals.values()], pa.binary())], ["part", "counts"])

    # summed in streams and at two levels: a task's share doesn't grow with the number of scan tasks
    sums = both.where("part >= 0").select("part", "counts", (F.spark_partition_id() % SKETCH_SALTS).alias("salt")).repartition("part", "salt").select("part", "counts")
    sums = map_arrow(map_arrow(sums, add, "part int, counts binary").repartition("part"), add, "part int, counts binary")
    parts = sums.orderBy("part").collect()  # SKETCH_PARTS rows of 64 KB
    sketch = np.frombuffer(b"".join(bytes(p.counts) for p in parts), np.uint32) if parts else np.zeros(1 << SLOT_BITS, np.uint32)
    offers = both.where("part = -1").select("fp", "counts").dropDuplicates(["fp"]).orderBy("fp").limit(PIVOTS).collect()
    return both.where("part is null").select("doc_id", "rid", "n", "fp"), sketch, Pivots([np.frombuffer(bytes(o.counts), np.int64) for o in offers], percent)


def margin_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def parts(docs: DataFrame, sketch: np.ndarray, pivots: Pivots, text: str, words: int, percent: int) -> DataFrame:
    """t, salts, salt, fp, n, pos: the classes in each part that at least two classes share.

    A part t is a region and a shingle; ``pos`` is the shingle's place in the class's order of shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sketch, pivots))  # of bounded size, whatever the input
    many = max(SHINGLE_ROWS, 16 * int(sketch.mean()))

    def run(batches):
        (counts, near), sent = shared.value, set()
        for b in batches:
            t, salt, fp, n, pos = [], [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), words):
                if not len(s) or (c := class_id(s)) in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(c)
                k = margin_length(len(s), percent)
                rare = counts[_slots(s)]
                first = np.lexsort((s, rare))[:k]
                hot = rare[first] // many  # an upper bound of the shingle's rows
                for region in near.regions(s):
                    x = s[first] if region < 0 else mix(s[first].view(np.uint64) ^ mix(np.full(1, region + 1, np.uint64))).view(np.int64)
                    t.append(x)
                    salt.append(np.where(hot > 0, c % (hot.astype(np.int64) + 1), -1).astype(np.int32))
                    fp.append(c)
                    n.append(len(s))
                    pos.append(np.arange(k, dtype=np.int32))
            k = np.array([len(x) for x in t], np.int64)
            flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([flat(t, np.int64), flat(salt, np.int32), pa.array(np.repeat(np.array(fp, np.int64), k)), pa.array(np.repeat(np.array(n, np.int32), k)), flat(pos, np.int32)], ["t", "salt", "fp", "n", "pos"])

    rows = map_arrow(docs.select(text_bytes(text).alias("text")), run, "t long, salt int, fp long, n int, pos int")
    same = Window.partitionBy("t", "salt")
    rows = rows.withColumns({"low": F.min("fp").over(same), "high": F.max("fp").over(same)}).where("low < high or salt >= 0")
    rows = cut(rows.select("t", "fp", "n", "pos").distinct(), "shingle-parts")
    # parts of equal membership become one, in which a member has its earliest place
    marks = rows.groupBy("t").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("fp")).alias("a"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("b")).where("size > 1")
    one = marks.withColumn("part", F.min("t").over(Window.partitionBy("size", "a", "b"))).select("t", "part", F.ceil(F.col("size") / PART_ROWS).cast("int").alias("salts"))
    merged = rows.join(one, "t").groupBy(F.col("part").alias("t"), "fp").agg(F.max("salts").alias("salts"), F.max("n").alias("n"), F.min("pos").alias("pos"))
    kept = cut(merged.withColumn("salt", F.pmod(F.xxhash64("fp"), "salts").cast("int")), "parts")
    drop_cut(rows)
    return kept


def class_rows(scanned: DataFrame, classes: DataFrame) -> DataFrame:
    """fp, rid: one document of each class."""
    return cut(scanned.join(classes, "fp", "left_semi").groupBy("fp").agg(F.min("rid").alias("rid")), "class-rows")


def with_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``wanted`` (rid, fp, tags) with shingles: the whole set of each class, made from its text.

    Only the wanted documents are cut into shingles. Up to ``BROADCAST_BYTES`` of them are found
    by a broadcast; more, by a shuffle of the texts.
    """

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_pylist()
            sets = list(shingle_sets(b.column("text").to_pylist(), words))
            # a row of another class has met the row key by chance
            stay = [i for i, s in enumerate(sets) if len(s) and class_id(s) == fp[i]]
            sets = [sets[i] for i in stay]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            at = pa.array(stay, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("fp").take(at), b.column("tags").take(at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["fp", "tags", "shingles"])

    size = wanted.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("tags")), F.lit(0)).alias("tags")).first()
    few = 40 * size["rows"] + 8 * size["tags"] <= BROADCAST_BYTES
    rows = docs.select(_row_key(key, text).alias("rid"), text_bytes(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "rid")
    return map_arrow(rows.select("fp", "tags", "text"), run, "fp long, tags array<long>, shingles array<long>")


def verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """x, p, both, all: shared and all shingles of each pair of classes.

    The members' sets travel once, to their pivots; a busy pivot's members may be split over tasks.
    """
    members = cut(pairs.groupBy(F.col("x").alias("fp")).agg(F.collect_set("p").alias("tags")).join(rows, "fp"), "wanted-members")
    pivots = cut(pairs.select(F.col("p").alias("fp")).distinct().join(rows, "fp").withColumn("tags", F.array().cast("array<long>")), "wanted-pivots")
    left = with_sets(docs, members, key, text, words).select(F.col("fp").alias("x"), F.explode("tags").alias("p"), F.col("shingles").alias("sx"))
    right = with_sets(docs, pivots, key, text, words).select(F.col("fp").alias("p"), F.col("shingles").alias("sp"))
    met = left.join(right, "p").select("x", "p", F.size(F.array_intersect("sx", "sp")).alias("both"), (F.size("sx") + F.size("sp")).alias("sum"))
    met = cut(met.select("x", "p", "both", (F.col("sum") - F.col("both")).alias("all")).distinct(), "met")
    drop_cut(members, pivots)
    return met


def components(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """fp, label: the lowest class that links reach. ``labels`` are those of the links before."""
    ends = links.select(F.col("x").alias("a"), F.col("p").alias("b"))
    if labels is not None:  # links between components
        of = lambda c: labels.select(F.col("fp").alias(c), F.col("label").alias(f"{c}_label"))
        ends = ends.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b")
    edges = cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = cut(edges.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("low")).select("fp", F.least("fp", "low").alias("label")), "labels")
    while True:
        # the lowest label among the neighbours, then the label of that label
        near = edges.join(now.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        step = now.join(near, "fp").select("fp", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = now.select(F.col("fp").alias("to"), F.col("label").alias("beyond"))
        new = cut(step.join(jump, "to", "left").select("fp", F.least("to", F.coalesce("beyond", "to")).alias("label"), "old"), "labels")
        drop_cut(now)
        now = new
        if new.where("label < old").isEmpty():
            break
    drop_cut(edges)
    now = now.select("fp", "label")
    if labels is None:
        return now
    moved = labels.join(now.select(F.col("fp").alias("label"), F.col("label").alias("to")), "label", "left").select("fp", F.coalesce("to", "label").alias("label"))
    fresh = now.join(labels.select("fp"), "fp", "left_anti").join(labels.select(F.col("label").alias("fp")).distinct(), "fp", "left_anti")
    return cut(moved.unionByName(fresh.select("fp", "label")), "components")


def in_salts(rows: DataFrame) -> DataFrame:
    """``rows`` of parts with a copy for each salt of the part."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def link_classes(members: DataFrame, meet, percent: int) -> DataFrame | None:
    """fp, label of all classes that link with another, by rounds of pivots. ``meet`` verifies pairs."""
    labels, n_pivots = None, 1
    left = members.withColumn("far", F.lit(None).cast("double"))  # distance to the part's first pivot, where it was met
    while True:
        here = left
        if labels is not None:
            here = here.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        else:
            here = here.withColumn("label", F.col("fp"))
        open_ = here.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("salts").alias("salts")).where("low < high")
        here = here.join(in_salts(open_).select("t", "salt"), ["t", "salt"], "left_semi")
        here = cut(here.select("t", "salts", "salt", "fp", "n", "pos", "far", "label"), "open-parts")
        if n_pivots > 1:
            drop_cut(left)
        if here.isEmpty():
            drop_cut(here)
            break
        # the next pivots are those of lowest hash, found in each task before the shuffle
        lowest_first = Window.partitionBy("t").orderBy("fp")
        pivots = here.withColumn("r", F.row_number().over(lowest_first)).where(F.col("r") <= n_pivots)
        pivots = cut(in_salts(pivots.select("t", "salts", *(F.col(c).alias(f"p_{c}") for c in ("fp", "n", "pos", "label", "far")))), "part-pivots")
        both = here.join(pivots.drop("salts"), ["t", "salt"]).where((F.col("fp") > F.col("p_fp")) & (F.col("label") != F.col("p_label")))
        sizes = 100 * F.least("n", "p_n").cast("long") >= percent * F.greatest("n", "p_n").cast("long")
        # in the part of their first common shingle, what follows it must suffice for the shared shingles that a link needs
        rest = F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos"))
        places = (100 + percent) * rest.cast("long") >= percent * (F.col("n") + F.col("p_n")).cast("long")
        window = F.abs(F.col("far") - F.col("p_far")) <= (100 - percent) / 100 + 1e-9
        both = both.where(sizes & places & F.coalesce(window, F.lit(True)))
        pairs = cut(both.select(F.col("fp").alias("x"), F.col("p_fp").alias("p")).distinct(), "pairs")
        met = meet(pairs)
        done = pivots.groupBy("t", "salt").agg(F.max("p_fp").alias("p"))
        left = here.join(done, ["t", "salt"]).where("fp > p")
        if n_pivots == 1:
            far = met.select(F.col("x").alias("fp"), "p", (1 - F.col("both") / F.col("all")).alias("far"))
            left = left.drop("far").join(far, ["fp", "p"], "left")
        left = cut(left.select(*members.columns, "far"), "parts-left")
        links = met.where(100 * F.col("both").cast("long") >= percent * F.col("all").cast("long"))
        if not links.isEmpty():
            old, labels = labels, components(links, labels)
            if old is not None:
                drop_cut(old)
        drop_cut(pairs, here, met, pivots)
        n_pivots *= MORE_PIVOTS
    return labels


def link_documents(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, rid, n, fp of every document, and the labels of the classes that link (None if none do)."""
    scanned, sketch, pivots = scan(docs, "doc_id", "text", words, percent)
    members = parts(docs, sketch, pivots, "text", words, percent)
    labels = None
    if not members.isEmpty():
        rows = class_rows(scanned, members.select("fp").distinct())
        labels = link_classes(members, lambda pairs: verify(pairs, docs, rows, "doc_id", "text", words), percent)
        drop_cut(rows)
    drop_cut(members)
    return scanned, labels


def lowest(scanned: DataFrame, labels: DataFrame | None, value) -> DataFrame:
    """fp, low: for each class the least ``value`` among the documents of its component."""
    classes = scanned.where("n > 0").groupBy("fp").agg(F.min(value).alias("low"))
    if labels is None:
        return classes
    classes = cut(classes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "low"), "classes")
    return classes.select("fp", "label").join(classes.groupBy("label").agg(F.min("low").alias("low")), "label").select("fp", "low")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    scanned, labels = link_documents(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words, percent)
    classes = lowest(scanned, labels, F.col("doc_id")).withColumnRenamed("low", "component_id")
    rows = scanned.join(classes, "fp", "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one of lowest doc_id, null ids last; all columns stay.

    Rows are told apart by doc_id and text, so rows that share a null or repeated doc_id are judged
    each by its own text. Wordless rows link with nothing and all stay.
    """
    made, names = own_columns(docs, "__doc")
    own = {c: k for k, c in names.items()}
    key, text = own[key], own[text]
    scanned, labels = link_documents(made.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words, percent)
    repeats = scanned.groupBy("doc_id", "rid", "n", "fp").agg(F.count(F.lit(1)).alias("copies"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "copies")
    stay = lowest(repeats, labels, first).select("low.doc_id", "low.rid", "low.copies").distinct()
    wordless = scanned.where("n = 0").select("doc_id", "rid", F.lit(1).cast("long").alias("copies")).distinct()
    stay = cut(stay.unionByName(wordless), "stay")

    def rows(of: DataFrame) -> DataFrame:
        same = (_row_key(key, text) == F.col("rid")) & F.col(key).cast("long").eqNullSafe(F.col("doc_id"))
        return made.join(of.drop("copies"), same, "left_semi")

    again = stay.where("copies > 1")
    kept = rows(stay.where("copies = 1"))
    if not again.isEmpty():
        # rows that repeat doc_id and text: the first by the other columns stays
        order = [c for c, kind in made.dtypes if c not in (key, text) and "map<" not in kind and "variant" not in kind] or [text]
        number = F.row_number().over(Window.partitionBy(key, _row_key(key, text)).orderBy(*order))
        kept = kept.unionByName(rows(again).withColumn("__n", number).where("__n = 1").drop("__n"))
    return kept.select(*(F.col(k).alias(c) for k, c in names.items()))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach as (
  select doc_id, doc_id as other from documents
  union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, r.component_id
from documents d left join sizes s on s.doc_id = d.doc_id
join (select doc_id, min(other) as component_id from reach group by doc_id) r on r.doc_id = d.doc_id
"""
