"""Operator 12: toxicity of texts whose obfuscation a noisy-channel decoder has undone.

A *character language model* (trigrams, interpolated) is counted over all distinct words of all
documents; a word weighs one more than the logarithm of its count, so that what stands in many
copies doesn't become the language. A *lattice* holds what each character of a token may stand for:
itself, letters that it looks like (``1`` for i or l), nothing, where it repeats the character before
or is a mark between letters, or a break between words. Single characters in a row (``i d i o t``) are
one token in which blanks are such marks. The Viterbi path of least bits, channel and language model
together, is the restored text. A token of plain letters without a repeat has one path only.

The *score* is a logistic regression on the evidence in the restored words. The evidence of a word is
the largest log-ratio, toxic to clean, of the features it has: itself and its beginnings of ``SHORTEST``
to ``LONGEST`` letters. Features are counted over a bounded sample of labelled rows (``REFERENCES``
per label, lowest hash first, among those that have a document); a feature that says less than the one
longer feature that most of its toxic words share is dropped. Labels' true shares are put back
into the regression's constant.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 isn't 1; a score reads the text
and nothing else. Nulls: rows without a doc_id or label teach nothing; null and empty texts have no
evidence and get the score of a text without any; a null doc_id is not held out. Repeated labels of a
document count once (the lowest), and so do rows that repeat a doc_id (the text of lowest crc32).
Without labels of both kinds every score is the share of toxic ones (0.5 without any). Repeated rows
are scored alike; an empty table gives an empty result. :func:`score_documents` replaces a column named
score (in any case). Texts of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, map_arrow, table, text_bytes
from .workers import kept

#: Labelled rows that are learnt from, at most, by label.
REFERENCES = {1: 4_096, 0: 12_288}
#: Letters of a beginning that is a feature; features kept; documents with a feature at least.
SHORTEST, LONGEST, FEATURES, LEAST_DOCS = 3, 10, 2_048, 4
THRESHOLD = 0.7
#: Log-ratio from which evidence counts twice.
STRONG = 4.0
#: Tokens that a worker remembers with what they were restored to.
REMEMBERED = 200_000

# fixed values: what look-alike characters stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
# fixed values: marks that may stand between the letters of one word
MARKS = " .-_*~'·,/\\|"
#: ASCII marks that stand for no letter.
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET)
#: Look-alikes that often are just marks at the end of a token.
PLAIN_ENDS = "!(*"
#: Bits of what the channel does.
LOOKS_LIKE, BREAK, EDGE, SAME_AGAIN, FIRST_REPEAT, MORE_REPEAT = 3.0, 12.0, 1.0, 1.0, 8.0, 1.0
#: Bits of a mark that is nothing, beside a single letter and elsewhere within a word; of one that is a break there.
MARK, MARK_WITHIN, MARK_BREAK = 2.0, 7.0, 4.0
#: Letters of the model: none, a-z, the small letters of Latin-1, any other.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 2
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}


# ---- the language model and the decoder -----------------------------------------------------------


class CharacterModel:
    """Bits of a letter after two others; 0 is the edge of a word."""

    def __init__(self, counts: np.ndarray | None = None):
        three = np.zeros((SIZE,) * 3) if counts is None else counts.reshape((SIZE,) * 3)
        one = three.sum((0, 1)) + 1.0
        p = np.broadcast_to(one / one.sum(), (SIZE, SIZE))
        two = three.sum(0)
        p = (two + 4 * p) / (two.sum(1, keepdims=True) + 4)
        p = (three + 4 * p[None]) / (three.sum(2, keepdims=True) + 4)
        self.bits = (-np.log2(p)).astype(np.float32).ravel().tolist()

    def word_bits(self, word: str) -> float:
        a = b = 0
        out = 0.0
        for x in [*(_INDEX.get(c, SIZE - 1) for c in word), 0]:
            out += self.bits[(a * SIZE + b) * SIZE + x]
            a, b = b, x
        return out


def count_trigrams(words: list[str], weights: list[float], into: np.ndarray) -> None:
    codes = np.array([x for w in words for x in (0, 0, *(_INDEX.get(c, SIZE - 1) for c in w), 0)], np.int64)
    if len(codes):
        sizes = np.array([len(w) + 3 for w in words])
        at = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
        inside = np.ones(len(codes), bool)
        ends = np.cumsum(sizes)
        inside[ends - 1] = inside[ends - 2] = False  # trigrams that reach into the next word
        np.add.at(into, at[inside[:-2]], np.repeat(weights, sizes)[:-2][inside[:-2]])


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    """Counted over all distinct words of all texts; SIZE ** 3 sums at most come to the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    distinct = words.groupBy("w").agg((1 + F.log2(F.count(F.lit(1)).cast("double"))).alias("weight"))

    def run(batches):
        sums = np.zeros(SIZE**3)
        for b in batches:
            count_trigrams(b.column("w").to_pylist(), b.column("weight").to_pylist(), sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["at", "weight"])

    got = map_arrow(distinct, run, "at long, weight double").groupBy("at").agg(F.sum("weight").alias("weight")).collect()
    counts = np.zeros(SIZE**3)
    for r in got:
        counts[r["at"]] = r["weight"]
    return CharacterModel(counts)


def single_path(token: str) -> bool:
    """Whether a token's lattice has one path only: letters, none twice in a row."""
    return token.isalpha() and not any(map(eq, token, token[1:]))


def decode(token: str, model: CharacterModel) -> list[str]:
    """The words on the path of least bits through the lattice of a token in lower case.

    A state is the last two letters of the open word; it keeps its bits and what was written.
    """
    bits, n = model.bits, len(token)
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    before = before2 = ""
    for j, c in enumerate(token):
        new: dict[int, tuple[float, tuple | None]] = {}
        if c.isalpha():
            code = _INDEX.get(c, SIZE - 1)
            repeat = 0.0 if c != before else MORE_REPEAT if c == before2 else FIRST_REPEAT
            for state, (cost, written) in states.items():
                to, total = state % SIZE * SIZE + code, cost + bits[state * SIZE + code]
                if to not in new or total < new[to][0]:
                    new[to] = (total, (written, c))
                if repeat and state and (state not in new or cost + repeat < new[state][0]):
                    new[state] = (cost + repeat, written)
        else:
            may = LEET.get(c, "")
            inside = 0 < j < n - 1 and _lettered(before) and _lettered(token[j + 1])
            mark = math.inf
            if c in MARKS and inside:
                alone = j < 2 or not _lettered(before2) or j > n - 3 or not _lettered(token[j + 2])
                mark = MARK if alone else MARK_WITHIN
            if c == before:
                mark = min(mark, MORE_REPEAT if c == before2 else FIRST_REPEAT)
            apart = SAME_AGAIN if c == before or c == " " else BREAK if may and (inside or c not in PLAIN_ENDS) else MARK_BREAK if inside else EDGE
            for state, (cost, written) in states.items():
                for x in may:
                    code = _INDEX[x]
                    to, total = state % SIZE * SIZE + code, cost + bits[state * SIZE + code] + LOOKS_LIKE
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (written, x))
                if state and (state not in new or cost + mark < new[state][0]):
                    new[state] = (cost + mark, written)
                total = cost + apart + (bits[state * SIZE] if state else 0.0)
                if 0 not in new or total < new[0][0]:
                    new[0] = (total, (written, " "))
        states, before2, before = new, before, c
    written = min(((cost + (bits[state * SIZE] if state else 0.0), state, written) for state, (cost, written) in states.items()), key=itemgetter(0, 1))[2]
    out = []
    while written:
        written, x = written
        out.append(x)
    return "".join(reversed(out)).split()


def _lettered(c: str) -> bool:
    return c.isalpha() or c in LEET


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; three or more single characters in a row are one, joined by blanks.

    What can only be a break at a token's ends (``EDGES``) is gone.
    """
    tokens = text.lower().split()
    lengths = list(map(len, tokens))
    if 1 in lengths:
        out, at = [], 0
        while at < len(tokens):
            try:
                first = lengths.index(1, at)
            except ValueError:
                break
            stop = first + 1
            while stop < len(tokens) and lengths[stop] == 1:
                stop += 1
            out += tokens[at:first]
            out += [" ".join(tokens[first:stop])] if stop - first > 2 else tokens[first:stop]
            at = stop
        tokens = out + tokens[at:]
    return [t for x in tokens if (t := x.strip(EDGES))]


def restore(text: str, model: CharacterModel) -> str:
    """The text as the decoder reads it, words joined by blanks."""
    return " ".join(w for t in tokens_of(text) for w in ([t] if single_path(t) else decode(t, model)))


# ---- evidence and score ---------------------------------------------------------------------------


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class Scorer:
    """Restores texts, weighs their words and scores them."""

    def __init__(self, model: CharacterModel, weights: dict[str, float]):
        self.model, self.weights = model, weights
        self.starts = {f[1 : SHORTEST + 1] for f in weights if f[0] == "^"}
        self.known: dict[str, tuple] = {}
        self.coefficients: np.ndarray | None = None
        self.prior = 0.5

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def words(self, token: str) -> tuple[str, ...]:
        return (token,) if single_path(token) else tuple(decode(token, self.model))

    def weighed(self, token: str) -> tuple:
        """How many more words than one the token is restored to, and (word, evidence) of those that have any; () for neither."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        words = self.words(token)
        found = tuple((w, e) for w in words if (e := self.evidence(w)) > 0)
        got = self.known[token] = (len(words) - 1, found) if found or len(words) != 1 else ()
        return got

    def evidence(self, word: str) -> float:
        """The largest log-ratio of the word's features, 0 at least."""
        weight = self.weights.get
        if word[:SHORTEST] not in self.starts:
            return weight("=" + word, 0.0)
        return max(weight(f, 0.0) for f in features(word))

    def row(self, text: bytes) -> list[float]:
        """What the regression reads: how strong the evidence is, how much there is, how dense."""
        distinct = set(tokens_of(text.decode("utf-8", "replace")))
        n, found, known = len(distinct), {}, self.known.get
        for t in distinct:
            got = known(t)
            if got is None:
                got = self.weighed(t)
            if got:
                n += got[0]
                found.update(got[1])
        if not found:
            return [0.0] * 7 + [1.0]
        e = sorted(found.values(), reverse=True) + [0.0, 0.0]
        return [e[0], max(e[0] - STRONG, 0.0), e[1], e[2], math.log1p(sum(found.values())), math.log1p(50 * len(found) / (n + 20)), math.log(n + 20), 1.0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(texts), self.prior)
        x = np.array([self.row(t) for t in texts], np.float64).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton's method with a ridge on scaled columns; the last column is the constant."""
    scale = np.append(np.maximum(x[:, :-1].std(0), 1e-6), 1.0)
    x = x / scale
    w = np.zeros(x.shape[1])
    ridge = penalty * np.append(np.ones(len(w) - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, references: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """label and text of at most ``references`` labelled documents a label; how many of each there are."""
    have = docs.select("doc_id").where("doc_id is not null").distinct()
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    known = cut(known.where(F.col("label").isin(0, 1)).join(have, "doc_id", "left_semi"), "known-labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value, most in references.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")  # a row of two numbers for each of the sample
    once = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.crc32("text").alias("crc"), "text"))["text"].alias("text"))
    got = cut(once.select("label", "text"), "toxicity-sample")
    drop_cut(known)
    return got, counts


def informative(chosen: DataFrame, model: CharacterModel, n_features: int = FEATURES) -> dict[str, float]:
    """Features with their log-ratio, those of the greatest difference in means first."""
    shared = chosen.sparkSession.sparkContext.broadcast(Scorer(model, {}))

    def run(batches):
        scorer = shared.value
        sums: dict[tuple[str, int], list[float]] = {}
        for b in batches:
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                words = {w for t in set(tokens_of(text.decode("utf-8", "replace"))) for w in scorer.words(t)}
                counts = Counter(f for w in words for f in features(w))
                counts[""] = len(words)
                for f, k in counts.items():
                    x = math.log1p(k)
                    got = sums.setdefault((f, label), [0, 0.0, 0.0, 0.0])
                    got[0] += 1
                    got[1] += k
                    got[2] += x
                    got[3] += x * x
        if sums:
            keys, values = zip(*sums.items())
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*keys)), *(pa.array(c, pa.float64()) for c in zip(*values))], ["feature", "label", "docs", "words", "x", "xx"])

    parts = map_arrow(chosen, run, "feature string, label long, docs double, words double, x double, xx double")
    of = lambda c, label: F.sum(F.when(F.col("label") == label, F.col(c)).otherwise(0.0)).alias(f"{c}{label}")
    table_ = cut(parts.groupBy("feature").agg(*(of(c, k) for c in ("docs", "words", "x", "xx") for k in (0, 1))), "toxicity-features")
    total = table_.where("feature = ''").first()
    if total is None or not total.docs0 or not total.docs1:
        drop_cut(table_)
        return {}
    m1, m0 = F.col("x1") / total.docs1, F.col("x0") / total.docs0
    spread = (F.col("xx1") + F.col("xx0") - F.col("x1") * m1 - F.col("x0") * m0) / (total.docs1 + total.docs0)
    apart = (m1 - m0) / F.sqrt(F.greatest(spread, F.lit(0.0)) * (1 / total.docs1 + 1 / total.docs0) + 1e-9)
    ratio = F.log((F.col("words1") + 0.5) / (total.words1 + 1)) - F.log((F.col("words0") + 0.5) / (total.words0 + 1))
    rows = table_.where((F.col("feature") != "") & (F.col("docs1") >= LEAST_DOCS)).select("feature", "words1", ratio.alias("ratio"), apart.alias("apart"))
    rows = rows.where("ratio > 1 and apart > 4").orderBy(F.col("apart").desc(), F.length("feature").desc(), "feature").limit(n_features).collect()  # n_features rows
    drop_cut(table_)
    own = {r.feature: r for r in rows}
    weights = {}
    for f, r in own.items():
        longer = [own[c] for c in own if c != f and f[0] == "^" and c[1:].startswith(f[1:]) and (len(c) > len(f) or c[0] == "=")]
        if not any(c.words1 >= 0.8 * r.words1 and c.ratio > r.ratio + 0.7 for c in longer):
            weights[f] = r.ratio
    return weights


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", references: dict[int, int] | None = None, model: CharacterModel | None = None) -> Scorer:
    chosen, counts = sample(docs, labels, label, references or REFERENCES)
    model = model or character_model(docs)
    scorer = Scorer(model, informative(chosen, model))
    total = sum(counts.values())
    scorer.prior = counts.get(1, 0) / total if total else 0.5
    if counts.get(0) and counts.get(1):
        shared = docs.sparkSession.sparkContext.broadcast(scorer)

        def run(batches):
            for b in batches:
                x = [np.array(shared.value.row(t)).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int64()), pa.array(x, pa.binary())], ["label", "x"])

        got = map_arrow(chosen, run, "label long, x binary").collect()  # a few numbers for each row of the sample
        y = np.array([r.label for r in got], np.float64)
        w = logistic(np.frombuffer(b"".join(bytes(r.x) for r in got)).reshape(len(got), -1), y)
        w[-1] += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
        scorer.coefficients = w
    drop_cut(chosen)
    return scorer


def score_documents(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; all columns are kept, one named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    tag = zlib.crc32(repr(sorted(scorer.weights.items())).encode())

    def run(batches):
        own = kept(("toxicity", tag), lambda: shared.value)
        for b in batches:
            keep = [f.name for f in b.schema if f.name != "__text"]
            got = own.score(b.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(got, pa.float64())], [*keep, "score"])

    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "__text")), text_bytes(text).alias("__text"))
    named = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, named + "score double")


def restore_documents(docs: DataFrame, model: CharacterModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``restored``, the decoder's reading of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(key).schema.fields[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [restore(t.decode("utf-8", "replace"), shared.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(got, pa.string())], ["key", "restored"])

    return map_arrow(docs.select(F.col(key).alias("key"), text_bytes(text).alias("text")), run, f"key {kind}, restored string").withColumnRenamed("key", key)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
