"""Operator 12: the decoder against every path of the lattice, and held-out accuracy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.llm import toxicity as tox

SF = "/root/testdata/sf0.01"
WORDS = "idiot loser moron stupid clown the and then other notion station worthless street hello".split()


@pytest.fixture(scope="module")
def model():
    counts = np.zeros(tox.SIZE**3)
    tox.count_trigrams(WORDS, [3.0] * len(WORDS), counts)
    return tox.CharacterModel(counts)


def test_trigrams_are_counted_word_by_word():
    counts = np.zeros(tox.SIZE**3)
    tox.count_trigrams(["ab", "b"], [2.0, 1.0], counts)
    three = counts.reshape((tox.SIZE,) * 3)
    assert {tuple(map(int, at)): three[tuple(at)] for at in np.argwhere(three)} == {(0, 0, 1): 2, (0, 1, 2): 2, (1, 2, 0): 2, (0, 0, 2): 1, (0, 2, 0): 1}


def choices(token, j):
    """(what is written, or None for nothing; bits) of one character, by the docstring's rules."""
    c, out = token[j], []
    is_letter = lambda k: 0 <= k < len(token) and (token[k].isalpha() or token[k] in tox.LEET)
    again, third = j > 0 and token[j - 1] == c, j > 1 and token[j - 2] == c
    nothing = [tox.MORE_REPEAT if third else tox.FIRST_REPEAT] if again else []
    if c.isalpha():
        out.append((c, 0.0))
    else:
        out += [(x, tox.LOOKS_LIKE) for x in tox.LEET.get(c, "")]
        inside = is_letter(j - 1) and is_letter(j + 1)
        if inside and c in tox.MARKS:
            nothing.append(tox.MARK_WITHIN if is_letter(j - 2) and is_letter(j + 2) else tox.MARK)
        leet = c in tox.LEET and (inside or c not in tox.PLAIN_ENDS)
        out.append((" ", tox.SAME_AGAIN if again or c == " " else tox.BREAK if leet else tox.MARK_BREAK if inside else tox.EDGE))
    return out + ([(None, min(nothing))] if nothing else [])


def plain_decode(token, model):
    best = (math.inf, "")
    for path in itertools.product(*(choices(token, j) for j in range(len(token)))):
        words, open_, ok = [], "", True
        for x, _ in path:
            if x is None:
                ok = ok and open_ != ""  # nothing is only dropped within a word
            elif x == " ":
                words.append(open_)
                open_ = ""
            else:
                open_ += x
        if ok:
            bits = sum(b for _, b in path) + sum(model.word_bits(w) for w in [*words, open_] if w)
            best = min(best, (bits, " ".join(w for w in [*words, open_] if w)))
    return best


def test_decoder_equals_all_paths(model):
    rng = random.Random(2)
    tokens = ["1d10t", "l0ser", "st00pid", "i.d.i.o.t", "c l o w n", "mor-on", "$$$", "tt", "a", "h3ll0!!", "s*p", "1"]
    tokens += ["".join(rng.choice("iitdos10.-$! ") for _ in range(rng.randint(1, 7))).strip() or "x" for _ in range(150)]
    for t in tokens:
        assert " ".join(tox.decode(t, model)) == plain_decode(t, model)[1], t


def test_single_paths_stay(model):
    for t in ("idiot", "thndouha", "éla", "a"):
        assert tox.single_path(t) and tox.decode(t, model) == [t]


def test_obfuscation_is_undone(model):
    for said, meant in (("id1ot", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("LOOOSER", "loser"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("the idi0t, and the c-l-o-w-n!", "the idiot and the clown")):
        assert tox.restore(said, model) == meant


def test_single_characters_in_a_row():
    assert tox.tokens_of("A b c, d e\tf gg h i") == ["a", "b", "c", "d e f", "gg", "h", "i"]
    assert tox.tokens_of("x y z") == ["x y z"] and tox.tokens_of("") == [] and tox.tokens_of(" ... ") == []


def test_long_token_takes_linear_time(model):
    assert len("".join(tox.decode("1o.0" * 20_000, model))) > 0


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = tox.fit(docs, labels)
    return scorer, tox.score_documents(docs, scorer).select("doc_id", "score").join(labels, "doc_id").withColumn("held_out", tox.held_out()).collect()


def test_held_out_accuracy(scored):
    _, rows = scored
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    assert sum((r.score >= tox.THRESHOLD) == bool(r.toxic) for r in held) / len(held) > 0.95
    assert not [r for r in held if r.score >= tox.THRESHOLD and not r.toxic]


def test_obfuscated_copies_score_as_the_plain_text(scored):
    scorer, _ = scored
    plain = b"inonth idiot ththhand loser the thly moron hashly trash"
    hidden = b"inonth id1ot ththhand l.o.s.e.r the thly m0r0n hashly tr@sh"
    a, b, clean = scorer.score([plain, hidden, b"inonth ththhand the thly hashly"])
    assert a >= 0.7 and b >= 0.7 and clean < 0.1


def test_held_out_labels_change_nothing(spark, scored):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tox.fit(docs, turned, model=scored[0].model)
    assert again.weights == scored[0].weights and np.allclose(again.coefficients, scored[0].coefficients)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x " * 50_000, 0.5), (None, "idiot", 0.5), (3, "y", 0.5)], "doc_id long, text string, SCORE double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = tox.fit(docs, none)
    rows = tox.score_documents(docs, scorer).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(2, 0), (2, 0), (3, 1), (None, 1), (7, 1), (8, None)], "doc_id long, toxic int")
    rows = tox.score_documents(docs, tox.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    empty = docs.where("false")
    assert tox.score_documents(empty, tox.fit(empty, labels)).collect() == []
    assert {r.doc_id: r.restored for r in tox.restore_documents(docs.where("doc_id < 3"), scorer.model).collect()} == {1: "", 2: ""}
