"""Operator 4: secret scans by password guess cost.

Base patterns find assignments, access keys and hex keys. Beyond them, values that stand in a
credential context (``pwd is ...``, ``Bearer ...``, ``user:value@host``, assignments) are priced:
a dynamic programme finds the cheapest way to guess the value as a sequence of words, dates,
repeats, keyboard walks and brute-force characters. A value that costs at least ``GUESS_BITS`` bits
is a span of kind ``guess``. Base spans stay whatever their values cost. Values that end at one place (as
those of keywords within another's value do) are priced together, by one pass from their common end
backwards, so a text costs a number of steps that grows with its length alone.

Words are common password words, then the ``DICTIONARY`` words that most of the documents hold, by
rank: what a corpus says everywhere is no secret. A word of fewer than ``LEAST_DOCUMENTS`` documents,
of a smaller share than ``LEAST_SHARE``, or of one text only, however often it is copied, is not common.

Spans are ``kind:start:stop`` in code points, in order of start, then kind as listed. Words are
counted by one aggregation; the scan is one pass over the rows, no shuffle; whole texts are
searched. Nulls: a null text is empty and has no span. Repeated rows give repeated results, an empty
table an empty one. Only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, map_arrow, table, text_bytes

KINDS = ("assign", "access", "hex", "guess")
GUESS_BITS = 40.0
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_GUESS = 8, 16, 32, 6

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # a run of [0-9a-f]+ always starts a match, so short runs fail alone
# a lookahead: a keyword that stands where another's value would be starts a match of its own
CONTEXT = re.compile(
    rb"""(?=(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|passcode|pass|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|authorization|bearer|login)"""
    rb"""["']?(?:[\x20\t]+(?:is|was)[\x20\t]+|[\x20\t]*(?::=|=>|[:=])[\x20\t]*|(?<=bearer)[\x20\t]+)["']?(?:(?:basic|bearer|digest|apikey)[\x20\t]+)?["']?([^\s"'<>,;]))""",
    re.I,
)
STOP = re.compile(rb"""[\s"'<>,;]""")  # ends a value whose first character CONTEXT has found
URL = re.compile(rb"://[^\s/:@]*:([^\s/@]+)@")
ASSIGN_HINTS = (b"pass", b"secret", b"token", b"key")
CONTEXT_HINTS = (*ASSIGN_HINTS, b"pwd", b"credential", b"bearer", b"login", b"authoriz")

# fixed values: common words of passwords and placeholders, most common first
WORDS = """
password pass admin user root login welcome letmein master secret qwerty dragon monkey football baseball shadow
sunshine princess iloveyou love hello freedom whatever trust super test testing example sample changeme change me
default guest public private key token api access auth value string none null true false your my the and here
placeholder dummy fake secure security system server database data base local host localhost home house work office
summer winter spring autumn monday friday january october december red blue green black white orange apple cat dog
horse tiger eagle hunter ranger soccer hockey batman superman computer internet google windows linux oracle mysql
spring star war king queen girl boy baby angel money magic power cheese pepper cookie flower coffee correct battery
staple temp demo foo bar baz abc xyz one two three four five new old
""".split()
# fixed values: rows of keys and runs of characters that walks follow
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qazwsxedcrfvtgbyhnujm", "1qaz2wsx3edc4rfv5tgb")
DATES = ((10, 16.2), (9, 16.2), (8, 16.2), (4, 6.9))  # lengths of dates with their bits
LEET = str.maketrans("0134578@$!", "oieastbasi")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")

_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
#: Most frequent words of the documents that count as words of a value, and their lengths.
DICTIONARY, SHORTEST, LONGEST = 10_000, 3, 24
LEAST_DOCUMENTS, LEAST_SHARE = 20, 1e-4
#: Longest period of a repeat.
PERIODS = 8
WALK_BITS = 5.6  # where a walk begins, and its way
PART_BITS = 1.0  # that a segment ends here


class Words:
    """Bits of each word by its rank."""

    def __init__(self, more: list[str] = ()):
        self.bits: dict[str, float] = {}
        for i, w in enumerate([*WORDS, *more]):
            self.bits.setdefault(w, math.log2(i + 2))
        self.starts = {w[:k] for w in self.bits for k in range(1, len(w) + 1)}


def common_words(docs: DataFrame, text: str = "text", n: int = DICTIONARY) -> Words:
    """The fixed words and the ``n`` words of the most documents (ties by the word).

    Words are first thinned by the size of their count, so that about ``n`` of them are put in order.
    """
    words = docs.select(F.xxhash64(text).alias("h"), F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))).alias("w")).where(F.length("w").between(SHORTEST, LONGEST))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    enough = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * docs.count()))
    counted = counted.where((F.col("n") >= enough) & (F.col("low") < F.col("high")))
    counted = cut(counted.select("w", "n", F.floor(8 * F.log2("n")).cast("int").alias("size")), "word-counts")
    least, seen = 0, 0
    for r in counted.groupBy("size").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("size").desc()).collect():  # 8 rows for each doubling
        least, seen = r["size"], seen + r.words
        if seen >= n:
            break
    top = counted.where(F.col("size") >= least).orderBy(F.col("n").desc(), "w").limit(n)
    found = Words([r.w for r in top.collect()])  # n short words
    drop_cut(counted)
    return found


def _alphabet(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.islower() and c.isascii() else 26 if c.isupper() and c.isascii() else 33 if c.isascii() else 1000)


def word_cost(value: str, low: str, plain: str, i: int, j: int, bits: dict[str, float]) -> float | None:
    """Bits of value[i:j] as a word, in another case or with look-alike characters; None if it is none."""
    word, part = low[i:j], value[i:j]
    cost = bits.get(word)
    if cost is None and (cost := bits.get(plain[i:j])) is not None:
        cost += 2
    if cost is None:
        return None
    return cost + (0 if part == word else 1 if part.istitle() or part.isupper() else min(len(word), 4))


def lower_forms(value: str) -> tuple[str, str]:
    """The value in lower case, and with look-alike characters as letters; both as long as the value."""
    low = value.lower()
    if len(low) != len(value):
        low = "".join(c.lower()[:1] or c for c in value)
    return low, low.translate(LEET)


def suffix_costs(value: str, words: Words | None = None, enough: float = math.inf) -> list[float]:
    """Bits of the cheapest guess of value[i:] for every i: the minimum over all segmentations of the sum of their costs.

    A repeat costs its block, a walk ``WALK_BITS``, and either log2(len(value)) for its length; so
    the best end of one is a running minimum over the run, and all costs together take len(value)
    steps. The search ends once every way on costs ``enough``; beginnings further left cost that too.
    """
    words = words or _fixed_words()
    n, (low, plain) = len(value), lower_forms(value)
    bits, begins = words.bits, words.starts
    alphabet = [_alphabet(c) for c in value]
    best, costs = [math.inf] * n + [0.0], [enough] * n
    any_length = math.log2(n) if n else 0.0
    runs, ends = [0] * (PERIODS + 1), [math.inf] * (PERIODS + 1)  # for period p: characters that repeat p further on; cheapest end
    walk, walk_end = 0, math.inf
    for i in range(n - 1, -1, -1):
        c = value[i]
        cost = math.inf
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if low[i:j] not in begins and plain[i:j] not in begins:
                break
            if j > i + 1 and (got := word_cost(value, low, plain, i, j, bits)) is not None:
                cost = min(cost, best[j] + got + PART_BITS)
        if c.isdigit():
            for size, got in DATES:
                if i + size <= n and value[i + size - 1].isdigit() and DATE.fullmatch(low, i, i + size):
                    cost = min(cost, best[i + size] + got + PART_BITS)
        for p in range(1, PERIODS + 1):
            if i + p < n and value[i + p] == c:
                runs[p] += 1
                if runs[p] >= max(2, p):
                    ends[p] = min(ends[p], best[i + max(3, 2 * p)])
                    cost = min(cost, ends[p] + sum(alphabet[i : i + p]) + any_length + PART_BITS)
            else:
                runs[p], ends[p] = 0, math.inf
        if i + 1 < n and (low[i], low[i + 1]) in _NEXT:
            walk += 1
            if walk >= 2:
                walk_end = min(walk_end, best[i + 3])
                cost = min(cost, walk_end + WALK_BITS + any_length + PART_BITS)
        else:
            walk, walk_end = 0, math.inf
        brute = best[i + 1] + alphabet[i]
        best[i], costs[i] = min(cost, brute), min(cost, brute + PART_BITS)
        if best[i] >= enough and min(*best[i : i + _REACH + 1], *ends, walk_end) >= enough:
            break
    return costs


def guess_cost(value: str, words: Words | None = None, enough: float = math.inf) -> float:
    """Bits of the cheapest guess of a value, or a number of at least ``enough``."""
    return suffix_costs(value, words, enough)[0] if value else 0.0


#: How far on a segment may end that is no repeat or walk under way.
_REACH = max(LONGEST, DATES[0][0], 2 * PERIODS, 3)


_fixed: list[Words] = []


def _fixed_words() -> Words:
    if not _fixed:
        _fixed.append(Words())
    return _fixed[0]


def spans(text: bytes, words: Words | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, stop) of all spans, in bytes, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    values: dict[int, set[int]] = {}  # where values end: where they begin
    if any(h in low for h in CONTEXT_HINTS):
        begins = [m.start(1) for m in CONTEXT.finditer(text)]
        stops = [m.start() for m in STOP.finditer(text)] if begins else []
        for a in begins:
            at = bisect_left(stops, a)
            values.setdefault(stops[at] if at < len(stops) else len(text), set()).add(a)
        for m in ASSIGN.finditer(text):
            values.setdefault(m.end(2), set()).add(m.start(2))
    if b"://" in text:
        for m in URL.finditer(text):
            values.setdefault(m.end(1), set()).add(m.start(1))
    for end, begins in values.items():
        ordered = sorted(begins)
        pieces = [text[a:b].decode("utf-8", "replace") for a, b in zip(ordered, [*ordered[1:], end])]
        costs = suffix_costs("".join(pieces), words, GUESS_BITS)
        at = 0
        for a, piece in zip(ordered, pieces):
            if len(costs) - at >= MIN_GUESS and costs[at] >= GUESS_BITS:
                found.append((a, "guess", end))
            at += len(piece)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def in_code_points(text: bytes, found: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The spans with byte places turned into code points, in one walk over the text."""
    place, at, n = {}, 0, 0
    for x in sorted({p for a, _, b in found for p in (a, b)}):
        n += len(text[at:x].decode("utf-8", "replace"))
        place[x], at = n, x
    return [(place[a], kind, place[b]) for a, kind, b in found]


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", words: Words | None = None) -> DataFrame:
    """Per row the key and ``secrets``, an array of (start, kind, stop) in code points.

    ``words`` price the values; without them only the fixed words do.
    """
    shared = df.sparkSession.sparkContext.broadcast(words or Words())  # at most DICTIONARY short words

    def run(batches):
        for b in batches:
            rows = [[{"start": s, "kind": k, "stop": e} for s, k, e in in_code_points(t, spans(t, shared.value))] for t in b.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(rows, kind)], [key, "secrets"])

    rows = df.select(df[key].alias("key"), text_bytes(text).alias("text"))
    return map_arrow(rows, run, f"`{key}` {dict(df.dtypes)[key]}, secrets array<struct<start:bigint,kind:string,stop:bigint>>")


def digest(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def sha256_of(found) -> str:
    return hashlib.sha256(digest(found).encode()).hexdigest()


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest and all spans of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    got = find_secrets(docs, words=common_words(docs))

    def joined(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), count("guess"), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"))
