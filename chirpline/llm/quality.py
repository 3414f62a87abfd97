"""Operator 6: quality scores by nearest-neighbour voting in a latent semantic space.

Texts become counts of hashed terms: words, the shapes of their tokens, and how often tokens and
lines repeat. A bounded sample of labelled documents (``REFERENCES`` rows, those of lowest hash)
gives the terms' weights and, by the eigenvectors of its term matrix, a latent space of
``DIMS`` dimensions. The sample's latent vectors are broadcast; every document's cosine with every
one of them is computed exactly, in blocks, and the labels of the ``NEIGHBOURS`` nearest vote
with weights that grow with the cosine.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 isn't 0. A score reads the text
and nothing else. Nulls: rows without a doc_id or quality teach nothing; null and empty texts have
no direction and get the share of label 1 in the sample; a null doc_id is not held out. Repeated
labels of a document count once (the lowest), and so do rows that repeat a doc_id (the text of
lowest crc32). Without any label every score is 0.5. Repeated rows
are scored alike; an empty table gives an empty result. :func:`score_documents` replaces a column
named score (in any case), :func:`keep_good` returns the documents' own columns, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own_columns, table, text_bytes

REFERENCES = 4096
DIMS = 48
NEIGHBOURS = 15
TERMS = 1024
#: Share of the hashed terms that are words; the rest are shapes and repeats.
WORD_TERMS = 512
WORD_WEIGHT = 0.35
THRESHOLD = 0.3
#: Rows whose cosines exist at once.
BLOCK = 256

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"([^\s])\1+")
_SCRIPT = re.compile(rb"[\xc3][\x80-\x9e]")  # capital letters of Latin-1


def terms(text: bytes) -> dict[int, float]:
    """Term weights of one text: relative frequencies of shapes and repeats, damped word counts."""
    shaped = _RUN.sub(rb"\1", _SCRIPT.sub(b"A", text).translate(_SHAPE)).split()
    tokens = text.split()
    n = len(tokens)
    out: dict[int, float] = {}
    if not n:
        return out
    size = TERMS - WORD_TERMS
    for s, k in Counter(shaped).items():
        at = WORD_TERMS + zlib.crc32(s) % size
        out[at] = out.get(at, 0.0) + k / n
    lines = text.split(b"\n")
    repeats = sum(map(eq, tokens, tokens[1:])) / n
    distinct = Counter(tokens)
    for name, x in ((b"\0repeat", repeats), (b"\0old", 1 - len(distinct) / n), (b"\0top", max(distinct.values()) / n), (b"\0lines", 1 - len(set(lines)) / len(lines)), (b"\0some", 0.05)):
        at = WORD_TERMS + zlib.crc32(name) % size
        out[at] = out.get(at, 0.0) + x
    for w, k in distinct.items():
        at = zlib.crc32(w) % WORD_TERMS
        out[at] = out.get(at, 0.0) + WORD_WEIGHT * k / n
    return out


def term_matrix(texts: list[bytes]) -> np.ndarray:
    x = np.zeros((len(texts), TERMS), np.float32)
    for i, t in enumerate(texts):
        got = terms(t)
        if got:
            x[i, list(got)] = list(got.values())
    return np.sqrt(x)


class LatentSpace:
    """Term weights, axes, and the labelled vectors of unit length."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = (x > 0).sum(0)
        self.weights = np.log1p(len(x) / np.maximum(seen, 1)).astype(np.float32) if len(x) else np.ones(TERMS, np.float32)
        x = x * self.weights
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64)) if len(x) else (np.zeros(1), np.zeros((TERMS, 1)))
        self.axes = (self.weights[:, None] * vectors[:, ::-1][:, :dims]).astype(np.float32)
        self.vectors = unit(x @ vectors[:, ::-1][:, :dims].astype(np.float32))
        self.labels = labels.astype(np.float32)

    def scores(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(x), self.prior, np.float64)
        k = min(neighbours, len(self.labels))
        if not k:
            return out
        for i in range(0, len(x), BLOCK):
            v = x[i : i + BLOCK] @ self.axes
            live = np.linalg.norm(v, axis=1) > 0
            cos = unit(v) @ self.vectors.T
            near = np.argpartition(cos, -k, axis=1)[:, -k:] if k < cos.shape[1] else np.tile(np.arange(k), (len(v), 1))
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 8 + 1e-9
            got = (w * self.labels[near]).sum(1) / w.sum(1)
            out[i : i + BLOCK] = np.where(live, got, self.prior)
        return np.clip(out, 0.0, 1.0)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, references: int = REFERENCES, label: str = "quality") -> LatentSpace:
    """Fit on at most ``references`` labelled rows outside the held-out fold that have a document.

    Terms are counted where the rows lie; rows of 4 KB, not texts, are put in order of their hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.min(label).alias("__label"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # a label without a document takes no place in the sample
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(references)
    rows = docs.select("doc_id", text_bytes().alias("__text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            texts = b.column("__text").to_pylist()
            x = [r.tobytes() for r in term_matrix(texts)]
            order = pa.array([zlib.crc32(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), order, b.column("__label").cast(pa.int32()), pa.array(x, pa.binary())], ["doc_id", "tie", "label", "x"])

    counted = map_arrow(rows, run, "doc_id long, tie long, label int, x binary")
    once = counted.groupBy("doc_id", "label").agg(F.min(F.struct("tie", "x"))["x"].alias("x"))
    got = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(references).collect()  # at most `references` rows of 4 KB
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), TERMS)
    return LatentSpace(x, np.array([r.label for r in got], np.float32))


def score_documents(docs: DataFrame, space: LatentSpace, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; all columns are kept, one named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for b in batches:
            texts = b.column("__text").to_pylist()
            got = np.concatenate([shared.value.scores(term_matrix(texts[i : i + BLOCK])) for i in range(0, len(texts), BLOCK)] or [np.zeros(0)])
            keep = [f.name for f in b.schema if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(got, pa.float64())], [*keep, "score"])

    rows = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in ("score", "__text")), text_bytes(text).alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, kept + "score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    made, names = own_columns(docs, "__doc")
    text = next(k for k, c in names.items() if c == "text")
    scored = score_documents(made, fit(docs, labels), text)
    return scored.where(F.col("score") >= threshold).select(*(F.col(k).alias(c) for k, c in names.items()))


def op6_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
