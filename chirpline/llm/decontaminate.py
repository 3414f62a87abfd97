"""Operator 2: benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are word windows of the benchmark items. They are searched in classes of like length:
within a class of least length ``m`` a table gives for each block of two words (one, where m is 1)
how far the search may jump because no pattern has the block nearer to its m-th word. Where the
jump is 0 the block's bucket holds the patterns whose m-th word ends there, and each is compared
directly with the document's words.

The tables are broadcast in parts of at most ``PART_WINDOWS`` windows each, whatever the size of
the benchmark: a larger benchmark takes more parts, each of which is one more pass over the
documents, written in between, so that a worker and the driver hold one part at a time.

Nulls: a null text has no words and is clean; an item with a null or wordless text has no window.
A null item_id is skipped, as it can't be named. Repeated rows give repeated results. An empty
benchmark hits nothing, an empty table gives an empty result. :func:`find_contamination` replaces
columns named as those it makes; :func:`decontaminate` returns the documents' own columns, whatever
their names.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, map_arrow, own_columns, table, text_bytes
from .workers import kept as kept_in_worker

WINDOW = 13
#: Windows of a part: about 50 MB in a worker.
PART_WINDOWS = 100_000
#: Class limits of pattern length: a short item must not shorten the jumps of the long windows.
CLASSES = (1, 2, 4, 8)

#: A-Z to a-z, other ASCII letters, digits and all bytes of non-ASCII characters stay, the rest is blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows(ws: list[bytes], size: int = WINDOW) -> set[tuple]:
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


class WuManber:
    """Patterns (tuples of words) of one length class with their values."""

    def __init__(self, patterns: dict[tuple, list]):
        self.m = min(map(len, patterns))
        self.b = min(2, self.m)
        self.default = self.m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, value in patterns.items():
            for end in range(self.b, self.m + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.default), self.m - end)
            self.buckets.setdefault(p[self.m - self.b : self.m], []).append((p, value))

    def search(self, ws: list[bytes]):
        """(start, stop, value) of every occurrence, by start."""
        m, b, n = self.m, self.b, len(ws)
        get, default, buckets = self.shift.get, self.default, self.buckets
        end = m
        while end <= n:
            block = (ws[end - 2], ws[end - 1]) if b == 2 else (ws[end - 1],)
            jump = get(block, default)
            if jump:
                end += jump
                continue
            at = end - m
            for p, value in buckets[block]:
                if tuple(ws[at : at + len(p)]) == p:
                    yield at, at + len(p), value
            end += 1


def _matchers(patterns: dict[tuple, list]) -> list[WuManber]:
    classes: dict[int, dict] = {}
    for p, v in patterns.items():
        classes.setdefault(max(c for c in (*CLASSES, WINDOW) if c <= max(len(p), 1)) if len(p) < WINDOW else WINDOW, {})[p] = v
    return [WuManber(c) for _, c in sorted(classes.items())]


def _tables(key: str, part) -> list[WuManber]:
    """The matchers of a broadcast part, built once in a worker; those of the part before go."""
    return kept_in_worker(("windows", key), lambda: _matchers(part.value))


def benchmark_parts(benchmark: DataFrame, size: int = WINDOW, part_windows: int | None = None):
    """Broadcast window tables, about ``part_windows`` windows in each (``PART_WINDOWS`` if None), and whether it is the last.

    Windows are made on the executors and grouped there; the driver fetches one part at a time.
    """
    spark = benchmark.sparkSession

    def cut_windows(batches):
        for b in batches:
            rows = [(str(i), b"\0".join(w)) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()) for w in windows(words(t), size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "window"])

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text"))
    grouped = map_arrow(items, cut_windows, "item_id string, window binary").groupBy("window").agg(F.collect_set("item_id").alias("items")).cache()
    n_parts = -(-grouped.count() // (part_windows or PART_WINDOWS))
    for k in range(n_parts):
        rows = grouped if n_parts == 1 else grouped.where(F.pmod(F.xxhash64("window"), F.lit(n_parts)) == k)
        once: dict = {}  # windows share their words
        found = {tuple(once.setdefault(w, w) for w in bytes(r.window).split(b"\0")): r["items"] for r in rows.toLocalIterator()}
        yield spark.sparkContext.broadcast(found), k == n_parts - 1
    if not n_parts:
        yield spark.sparkContext.broadcast({}), True
    grouped.unpersist()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted as strings) and spans (word ranges hit).

    All columns of ``docs`` are kept; a column of one of these names is replaced.
    """
    made = {"n_words", "n_hit", "item_ids", "spans", "__text"}
    rows = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in made), text_bytes(text).alias("__text"))
    before = None
    for part, last in benchmark_parts(benchmark, size):
        rows = _search(rows, part, last)
        if not last:
            rows = cut(rows, "contamination-part")
            part.destroy()
            if before is not None:
                drop_cut(before)
            before = rows
    return rows


def _search(rows: DataFrame, part, last: bool) -> DataFrame:
    """One pass: a part's hits joined with those of the passes before; the last pass drops the text."""
    key, found = uuid.uuid4().hex, ("n_words", "n_hit", "item_ids", "spans")
    again = "spans" in rows.columns
    kept = [f for f in rows.schema.fields if f.name not in found and not (last and f.name == "__text")]

    def run(batches):
        matchers = _tables(key, part)
        for b in batches:
            texts = b.column("__text").to_pylist()
            old = zip(b.column("spans").to_pylist(), b.column("item_ids").to_pylist()) if again else (((), ()) for _ in texts)
            n_words, n_hit, items, spans = [], [], [], []
            for t, (was_hit, was_seen) in zip(texts, old):
                ws = words(t)
                ranges, seen = [tuple(x) for x in was_hit], set(was_seen)
                for m in matchers:
                    for at, to, value in m.search(ws):
                        ranges.append((at, to))
                        seen.update(value)
                merged: list[list[int]] = []
                for at, to in sorted(ranges):
                    if merged and at <= merged[-1][1]:
                        merged[-1][1] = max(to, merged[-1][1])
                    else:
                        merged.append([at, to])
                n_words.append(len(ws))
                n_hit.append(sum(q - p for p, q in merged))
                items.append(sorted(seen))
                spans.append(merged)
            cols = [b.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))], [*(f.name for f in kept), *found])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return map_arrow(rows, run, schema + "n_words long, n_hit long, item_ids array<string>, spans array<array<int>>")


def is_contaminated():
    """The contamination rule: any word hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    made, names = own_columns(docs, "__doc")
    text = next(k for k, c in names.items() if c == "text")
    return find_contamination(made, benchmark, text).where(~is_contaminated()).select(*(F.col(k).alias(c) for k, c in names.items()))


def items_sha256(ids: str = "item_ids"):
    return F.sha2(F.concat_ws(",", F.col(ids)), 256)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, words hit, items and the verdict of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items_sha256().alias("items_sha256"), is_contaminated().alias("contaminated"))


OP2_SQL = """
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from documents),
bw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null),
wins as (
  select distinct item_id, least(13, len(w)) as size, array_to_string(list_slice(w, i, i + 12), ' ') as s
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as i from bw where len(w) > 0)),
sizes as (select distinct size from wins),
places as (
  select doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as s
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)),
hits as (select p.doc_id, p.i, p.size, w.item_id from places p join wins w on w.size = p.size and w.s = p.s),
covered as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + size)) as j from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(i.n_items, 0) as bigint) as n_items,
       sha256(coalesce(i.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from dw d left join covered c on c.doc_id = d.doc_id left join items i on i.doc_id = d.doc_id
"""
