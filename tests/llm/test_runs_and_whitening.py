"""Operators 11 and 13 against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.llm import periodic, whitening

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            s = words[i : i + length]
            if j > i and length >= max(least, times * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_every_period_tried(least, times):
    rng = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            letters = rng.choice([1, 2, 3, 5])
            words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 50))]
            if rng.random() < 0.4:
                words += words[-rng.randint(1, 5) :] * rng.randint(1, 6)
            docs.append(periodic.echoed(rng.randrange(10**6), words))
        assert periodic.runs_of_documents(docs, least, times) == [plain_runs(d, least, times) for d in docs]


def test_long_texts_of_one_word_and_of_two():
    assert periodic.runs_of_documents([[b"a"] * 200_000, [b"a", b"b"] * 50_000]) == [[(0, 200_000, 1)], [(0, 100_000, 2)]]


def test_runs_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (3, "a a a a a a b", "x"), (None, "b b b b b b", "x"), (3, "a a a a a a b", "x")]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [
        (0, 6, [(0, 6, 1)], "b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (3, 7, [(0, 6, 1)], "a b"), (3, 7, [(0, 6, 1)], "a b"),
    ]
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op11_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words) if n <= 600 else periodic.runs_of_documents([words])[0]
        best = min(((-length, s, q) for s, length, q in found), default=None)
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == ((len(found), best[1], -best[0], best[2]) if best else (0, None, None, None))
        assert r.exponent_milli == (1000 * r.length // r.period if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def test_eigenpairs_equal_a_dense_solver():
    rng = np.random.default_rng(3)
    for trial in range(60):
        d, n = int(rng.integers(1, 66)), int(rng.integers(2, 200))
        y = rng.integers(-100, 100, (n, d)) if trial % 3 else rng.integers(-2, 3, (n, d)) * rng.integers(0, 2, d)
        if trial % 5 == 0:
            y = np.concatenate([np.eye(d, dtype=np.int64) * 5, y[:1] * 0])  # equal eigenvalues
        v = whitening.covariance(*whitening.exact_sums(np.unique(y, axis=0)))
        e, u = whitening.leading(v)
        w = np.linalg.eigvalsh(v)[::-1]
        k = min(16, int((w > 1e-12 * w.sum()).sum())) if w.sum() > 0 else 0
        assert len(e) == k
        assert np.abs(e - w[:k]).max(initial=0) <= 1e-12 * max(w[0], 1e-300)
        assert np.abs(v @ u - u * e).max(initial=0) <= 1e-11 * max(w[0], 1e-300)
        assert np.abs(u.T @ u - np.eye(k)).max(initial=0) < 1e-12


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    w = np.linalg.eigvalsh(a)
    form = whitening.tridiagonal(a)
    assert [whitening.inertia_above(form, s) for s in (w[:-1] + w[1:]) / 2] == list(range(19, 0, -1))


def test_sums_are_exact_at_any_size():
    y = np.random.default_rng(5).integers(-(2**62), 2**62, (40, 3))
    n, s, p = whitening.exact_sums(y)
    assert (n, list(s)) == (40, [sum(map(int, y[:, j])) for j in range(3)])
    assert all(p[i, j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for i in range(3) for j in range(3))
    for v in (0, 5, -5, 2**100 + 7, -(2**100) - 7):
        low, mid, high = whitening.in_pieces(v)
        assert low + (mid << whitening.PIECE) + (high << 2 * whitening.PIECE) == v


def test_op13_equals_plain(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    w, u = np.linalg.eigh(v)
    w, u = w[::-1][:16], u[:, ::-1][:, :16]
    got = {(r.vec_id, r.component): r for r in whitening.op13_embedding_whitening(spark, SF).collect()}
    assert len(got) == 16 * len(rows)
    want = (x - sums / n) @ u / np.sqrt(w)
    for c in range(16):
        here = np.array([got[r.vec_id, c + 1].whitened for r in rows])
        assert min(np.abs(here - want[:, c]).max(), np.abs(here + want[:, c]).max()) < 1e-9
    for r, v_x in zip(rows, x):
        g = got[r.vec_id, 1]
        assert g.n == n and g.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v_x, sums))
        assert abs(g.explained - w[0] / np.trace(v)) < 1e-9 and g.identity_error < 1e-9


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(a) for a in rng.standard_normal(3)], "x") for i in range(20)]
    odd = [(90, None, "x"), (91, [1.0, None, 2.0], "x"), (92, [1.0, float("nan"), 2.0], "x"), (93, [float("inf"), 0.0, 0.0], "x"), (94, [], "x"), (95, [1.0], "x")]
    schema = "vec_id long, embedding array<double>, n string"
    got = whitening.whiten(spark.createDataFrame(good + good[:5] + odd + [(None, good[0][1], "x")], schema))
    assert got.groupBy("vec_id").count().where("vec_id < 5").agg(F.min("count"), F.max("count")).first() == (6, 6)
    rows = got.collect()
    assert {r.vec_id for r in rows} == {*range(20), None} and {r.n for r in rows} == {20} and max(r.component for r in rows) == 3
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")], schema)).collect() == []  # nothing varies
    big = [(i, [float(a) * 1e9 for a in rng.standard_normal(2)], "x") for i in range(9)] + [(9, [1e300, -1e300], "x")]
    assert whitening.whiten(spark.createDataFrame(big, schema)).count() > 0
