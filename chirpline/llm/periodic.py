"""Operator 11: runs of repeated words, by uniting suffix classes in order of falling LCP.

The words of a batch of documents become one array of numbers, in which a number belongs to one word
of one document and each document ends in a number of its own; no match reaches over an end. Prefix
doubling orders the suffixes (only classes of two and more are looked at again) and keeps the class of
every position for 1, 2, 4, ... words, from which the LCP of neighbours in suffix order follows for
all pairs at once. Pairs are then taken by falling LCP, as Kruskal's algorithm takes edges: each unites
two classes, held as ordered sets of positions, the smaller put into the larger. Positions that become
neighbours at LCP ``l`` and lie ``q`` apart, ``q`` within ``l``, seed a run of period ``q`` and length
``l + q``; it is one if the words before both differ, and ``q`` is then its smallest period, as any
smaller one would put a position of the class between the two. Classes below the smallest LCP that
a run of the asked length can have are never united.

A run is a stretch of consecutive words with smallest period ``q`` and length at least
``max(least, times * q)`` (``times`` 2 or more) that no neighbouring word extends. Time is n log n in
the words of a document, memory a number for each word and doubling; a document is handled whole in
one task. Nulls: a null text has no words and no runs; a null key keeps its row. Repeated rows get a
row each, an empty table gives an empty result, and columns other than key and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table, text_bytes

LEAST, TIMES = 6, 4


def numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of all documents, each followed by a number of its own; where each begins."""
    parts, begins, base, at = [], [], 0, 0
    for words in documents:
        own = dict(zip(dict.fromkeys(words), count(base)))
        numbers = np.empty(len(words) + 1, np.int32)
        numbers[:-1] = np.fromiter(map(own.__getitem__, words), np.int32, len(words))
        base += len(own)
        numbers[-1] = base
        base += 1
        parts.append(numbers)
        begins.append(at)
        at += len(numbers)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.array(begins, np.int64)


def classes(w: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: each position's class by its next 2 ** k words, as the first place of the class in suffix order.

    The last of them is the place in suffix order itself.
    """
    size = np.bincount(w)
    rank = (np.cumsum(size) - size)[w].astype(np.int32)
    found = [rank]
    active = np.flatnonzero(size[w] > 1)
    step = 1
    while len(active):
        key = (rank[active].astype(np.int64) << 32) | rank[active + step]
        order = np.argsort(key, kind="stable")
        key, at = key[order], active[order]
        place = np.arange(len(at))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        outer = np.concatenate(([True], key[1:] >> 32 != key[:-1] >> 32))
        begin = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[at] += (begin - np.maximum.accumulate(np.where(outer, place, 0))).astype(np.int32)
        found.append(rank)
        active = np.sort(at[~(new & np.append(new[1:], True))])
        step *= 2
    return found


def neighbours(found: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``least`` words or more, and how many they share."""
    suffixes = np.empty(len(found[-1]), np.int64)
    suffixes[found[-1]] = np.arange(len(suffixes))
    a, b = suffixes[:-1], suffixes[1:]
    level = min(least.bit_length() - 1, len(found) - 1)
    near = found[level][a] == found[level][b] if 1 << level <= least else np.ones(len(a), bool)
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in reversed(range(len(found))):
        lcp += (found[k][a + lcp] == found[k][b + lcp]).astype(np.int64) << k
    keep = lcp >= least
    return a[keep], b[keep], lcp[keep]


def runs(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in numbers as :func:`numbered` gives them."""
    if not len(w):
        return []
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, least + 2))
    a, b, lcp = neighbours(classes(w), max(shortest, 1))
    order = np.argsort(-lcp, kind="stable")
    a, b, lcp = a[order].tolist(), b[order].tolist(), lcp[order].tolist()
    home: dict[int, list[int]] = {}
    found = []
    i = 0
    while i < len(a):
        shared, fresh = lcp[i], []
        far = shared // (times - 1)
        while i < len(a) and lcp[i] == shared:
            large = home.get(a[i]) or home.setdefault(a[i], [a[i]])
            small = home.get(b[i]) or home.setdefault(b[i], [b[i]])
            if len(large) < len(small):
                large, small = small, large
            last = -1
            for x in small:
                at = bisect_left(large, x)
                if at and large[at - 1] != last and x - large[at - 1] <= far:
                    fresh.append((large[at - 1], x))
                if at < len(large) and large[at] - x <= far:
                    fresh.append((x, large[at]))
                large.insert(at, x)
                home[x] = large
                last = x
            i += 1
        for p, x in fresh:
            if shared + x - p >= least and (not p or w[p - 1] != w[x - 1]):
                own = home[p]
                if own[bisect_right(own, p)] == x:  # nothing of this LCP came between them
                    found.append((p, shared + x - p, x - p))
    return found


def runs_of_documents(documents: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Each document's runs by start, then period."""
    w, begins = numbered(documents)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for start, length, period in sorted(runs(w, least, times)):
        at = int(np.searchsorted(begins, start, "right")) - 1
        out[at].append((start - int(begins[at]), length, period))
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, rewrite=None) -> DataFrame:
    """Per document: ``key``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text without repeats.

    Words are cut at ASCII white space and joined by single blanks. ``rewrite`` (key, words) may
    give other words than the text's.
    """
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            keys = b.column("key").to_pylist()
            documents = [t.split() for t in b.column("text").to_pylist()]
            if rewrite is not None:
                documents = [rewrite(k, words) for k, words in zip(keys, documents)]
            found = runs_of_documents(documents, least, times)
            spans = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in found], run_type)
            short = pa.array([b" ".join(collapse(words, own)) for words, own in zip(documents, found)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(map(len, documents), pa.int64()), spans, short], ["key", "n_words", "runs", "collapsed"])

    made = map_arrow(rows, run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return made.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: those of one document in ten go round from a place of their own to the end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs, the longest run and the digests of every row of ``documents``."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=echoed)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.less"), F.col("best.period")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
