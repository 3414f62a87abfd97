"""Operator 7: exact token counts of every prefix of a text, by dynamic programming over prefixes.

``count(prefix) = count(whole chunks before it) + count(whole pieces of the started chunk) +
count(beginning of the started piece)``: tokens never span white space (see
:mod:`chirpline.llm.tokens`) nor the tokenizer's piece borders. One left-to-right pass adds these up.

Within a piece the programme keeps, for the symbols before each place, the last token of their
encoding and how many tokens it has (:class:`Merges`). The encoding of one symbol more ends in a
token whose pair with the last token before it is an encoding of its own: in byte-pair encoding the
encodings are the sequences all of whose neighbours are such pairs, so there is one such token. A
beginning that is a piece by itself ends in a token of word ends, found in the same way. So a piece costs
a number of steps that grows with its length alone, and nothing is encoded twice.

The table of a text answers for *every* prefix, so truncation and budget questions need no encoding:

* ``steps``: a signed byte for each byte of the text: by how much the count changes when the prefix
  grows by this byte (0 within a character). The count of a prefix is the sum of its steps.
* ``block_tokens``: the count at every ``BLOCK`` bytes and at the end, so that at most ``BLOCK``
  steps are summed.
* ``long_ends``, ``long_tokens``: changes that no signed byte holds, and the ends of open pieces. A piece
  is open if it is longer than ``PIECE`` characters and holds combining marks, Hangul parts or other
  characters that normalise together: how such a beginning normalises follows from no shorter one. Its
  steps are ``OPEN``, and a cut inside it needs the text, to encode its beginning.

Nulls: a null text is empty (0 bytes, 0 tokens, an empty table). Repeated rows give repeated
results. An empty table gives an empty result. Other columns, whatever their names, are read only
if they are kept; a kept column of the name of a made one (in any case) is replaced by it.
"""

from __future__ import annotations

import json
from array import array
from unicodedata import category, is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, text_bytes
from .hashing import _BLANK, BASE
from .tokens import TAIL, ChunkEncoder, Library, tokenizer_path
from .workers import kept

COUNTS = "n_bytes long, n_tokens long"
TABLE = "steps binary, block_tokens array<int>, long_ends array<int>, long_tokens array<int>"
BLOCK = 1024
#: Characters of the longest piece whose beginnings are encoded where no programme holds.
PIECE = 128
#: Beginnings of pieces that a worker remembers with their states (about 150 bytes each), and their longest.
BEGINNINGS, REMEMBERED = 200_000, 16
#: Pairs of tokens that a worker remembers to be encodings or not (about 200 bytes each).
PAIRS = 100_000
#: Whole letter runs that a worker remembers (about 200 bytes each), and their longest.
RUNS, RUN = 100_000, 64
#: Slots of the table in which edges of the vocabulary's trie are looked up first.
SLOT_BITS = 19
#: Slots of pairs that are remembered to stay apart or not (9 bytes each).
PAIR_BITS = 21
OPEN = -128
_NEVER = 1 << 60
_UNKNOWN = np.uint32(0xFFFFFFFF)
#: Bytes of steps to an Arrow batch.
_BATCH_BYTES = 4 << 20
# fixed values: the vocabulary's special strings
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def piece_borders(chunk: str, tok) -> tuple[list[int], list[int]]:
    """Characters of a chunk where a piece begins, and the tokens before each; the last is its end.

    Only borders that stay whatever follows them: none before a special string (its beginning
    alone joins the piece before it) or a combining mark.
    """
    e = tok.encode(chunk, add_special_tokens=False)
    at, before, offsets, words = [], [], e.offsets, e.word_ids
    for i in range(1, len(words)):
        begin = offsets[i][0]
        if words[i] != words[i - 1] and begin >= offsets[i - 1][1] and not chunk.startswith(SPECIAL, begin) and category(chunk[begin])[0] != "M":
            at.append(begin)
            before.append(i)
    return [*at, len(chunk)], [*before, len(e.ids)]


class Merges:
    """Counts of all beginnings of a piece, from the vocabulary's merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model["end_of_word_suffix"]
        self.symbols = {t for t in model["vocab"] if len(t) == 1}
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.made = {a + b: (i, a, b) for i, (a, b) in enumerate(pairs)}
        # ends of tokens, so that a search from a place backwards knows when to stop
        self.tails = {t[k:] for a, b in pairs for t in (a + b,) for k in range(len(t) - (len(self.end) if t.endswith(self.end) else 0))}
        self.spines: tuple[dict, dict] = ({}, {})  # of tokens, so no more than the vocabulary has
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, int, str]] = {}

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The token, its outermost part on a side, that one's, ...; each with the rank of the merge that takes it."""
        spines = self.spines[side]
        if token not in spines:
            parts = self.made.get(token)
            spines[token] = [(token, _NEVER)] + ([(t, min(rank, parts[0])) for t, rank in self._spine(parts[1 + side], side)] if parts else [])
        return spines[token]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether the encoding of both together is the two: no merge across happens before both sides' own."""
        got = self.apart.get((left, right))
        if got is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            got = self.apart[left, right] = self._tried(left, right)
        return got

    def _tried(self, left: str, right: str) -> bool:
        rank, right_side = self.rank.get, self._spine(right, 0)
        for a, a_taken in self._spine(left, 1):
            for b, b_taken in right_side:
                merge = rank((a, b))
                if merge is not None and merge < a_taken and merge <= b_taken:  # of equal merges the left one is first
                    return False
        return True

    def counts(self, symbols: str) -> array:
        """For each beginning of the symbols, as a piece of its own, its tokens."""
        out, last, before = array("I"), [""], [0]
        known, made, tails, end, apart = self.known, self.made, self.tails, self.end, self.stay_apart
        if len(known) > BEGINNINGS:
            known.clear()
        for j in range(1, len(symbols) + 1):
            begun = symbols[:j] if j <= REMEMBERED else None
            state = known.get(begun)
            if state is None:
                whole, token, within = 0, "", 0
                first = j - 1
                while first and (symbols[first - 1 : j] in tails or symbols[first - 1 : j] + end in tails):
                    first -= 1
                for i in range(first, j):  # the longest first, as it mostly is the one
                    part = symbols[i:j]
                    if not token and (part in made or i == j - 1) and (not i or apart(last[i], part)):
                        token, within = part, before[i] + 1
                    if not whole and ((closed := part + end) in made or i == j - 1) and (not i or apart(last[i], closed)):
                        whole = before[i] + 1
                    if token and whole:
                        break
                state = (whole, within, token)
                if begun:
                    known[begun] = state
            out.append(state[0])
            before.append(state[1])
            last.append(state[2])
        return out


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(np.uint64) * BASE >> np.uint64(64 - bits)).astype(np.int64)


class ManyMerges(Merges):
    """The same programme for many short pieces at once, place by place, in numpy.

    Tokens are numbers here: a piece's substrings walk a trie of the vocabulary together, which gives
    all tokens that end at each place; those of one place of all pieces are then tried together.
    """

    def __init__(self, path: str):
        super().__init__(path)
        closed = len(self.end)
        self.names: list[str] = []
        edges: dict[int, int] = {}
        plain, close = [-1], [-1]
        for token in self.symbols | set(self.made):
            for t in (token, token + self.end) if len(token) == 1 else (token,):
                ends, node = t.endswith(self.end) and t != self.end, 0
                for c in t[:-closed] if ends else t:
                    edge = node << 9 | ord(c)
                    if edge not in edges:
                        edges[edge] = len(plain)
                        plain.append(-1)
                        close.append(-1)
                    node = edges[edge]
                (close if ends else plain)[node] = len(self.names)
                self.names.append(t)
        self.edges = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.slots, self.slot_to = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, np.int64)
        self.slots[_slot(self.edges, SLOT_BITS)], self.slot_to[_slot(self.edges, SLOT_BITS)] = self.edges, self.to
        self.plain, self.close = np.array(plain, np.int64), np.array(close, np.int64)
        self.pairs, self.pair_apart = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's nodes one symbol on, -1 where it has none."""
        edge = node << 9 | code
        slot = _slot(edge, SLOT_BITS)
        held = self.slots[slot]
        out = np.where(held == edge, self.slot_to[slot], -1)
        other = np.flatnonzero((held != edge) & (held >= 0))  # another edge has the slot
        if len(other):
            at = np.minimum(np.searchsorted(self.edges, edge[other]), len(self.edges) - 1)
            out[other] = np.where(self.edges[at] == edge[other], self.to[at], -1)
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`stay_apart` of many pairs; each has a slot, where it is found if no other took it since."""
        pair = left * len(self.names) + right
        slot = _slot(pair, PAIR_BITS)
        out = self.pair_apart[slot]
        miss = np.flatnonzero(self.pairs[slot] != pair)
        if len(miss):
            new, inverse = np.unique(pair[miss], return_inverse=True)
            names, many = self.names, len(self.names)
            value = np.fromiter((self._tried(names[k // many], names[k % many]) for k in new.tolist()), bool, len(new))
            out[miss] = value[inverse]
            slot = _slot(new, PAIR_BITS)
            self.pairs[slot] = -1
            self.pairs[slot], self.pair_apart[slot] = new, value  # of two of one slot the last stays, in both
        return out

    def many(self, pieces: list[str]) -> list[bytes]:
        """:meth:`counts` of each of the pieces (not empty, of characters as the model spells them), as little-endian u32."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not len(sizes):
            return []
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.int64)
        stop = np.repeat(np.cumsum(sizes), sizes)
        begin = stop - np.repeat(sizes, sizes)
        start, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        length = 0
        while len(start):
            node = self._step(node, codes[start + length])
            length += 1
            alive = node >= 0
            start, node = start[alive], node[alive]
            found.append((start, np.full(len(start), start.dtype.type(length)), self.plain[node], self.close[node]))
            more = start + length < stop[start]
            start, node = start[more], node[more]
        start, length, plain, close = (np.concatenate(x) for x in zip(*found))
        some = (plain >= 0) | (close >= 0)
        start, length, plain, close = start[some], length[some], plain[some], close[some]
        place = start + length - begin[start]  # in the piece
        order = np.argsort(place, kind="stable")
        start, length, plain, close = start[order], length[order], plain[order], close[order]
        borders = np.searchsorted(place[order], np.arange(1, int(sizes.max()) + 2))
        whole, within, last = (np.zeros(len(codes), np.int64) for _ in range(3))
        for i, j in zip(borders.tolist(), borders[1:].tolist()):
            s, end = start[i:j], start[i:j] + length[i:j] - 1
            first = s == begin[s]
            before = np.where(first, 0, within[s - 1])
            left = last[s - 1]
            for token, count, is_inner in ((plain[i:j], within, True), (close[i:j], whole, False)):
                ok = token >= 0
                ask = ok & ~first
                ok[ask] = self._apart(left[ask], token[ask])
                count[end[ok]] = before[ok] + 1
                if is_inner:
                    last[end[ok]] = token[ok]
        raw, ends = whole.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]


def _together(piece: str) -> bool:
    """Whether characters of a piece may normalise together."""
    return any(category(c)[0] == "M" or "\u1100" <= c <= "\u11ff" or "\ua960" <= c <= "\ua97f" or "\ud7b0" <= c <= "\ud7ff" for c in piece) or not is_normalized("NFC", piece)


class Prefixes(Library):
    """For each new chunk the tokens of each of its prefixes: a number for each byte."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers.pre_tokenizers import ByteLevel

        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges = ManyMerges(path)
        self.runs_seen: dict[str, array] = {}
        self.spelt: dict[str, str] = {}
        self.tail_counts: dict[str, array] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spell(self, char: str) -> str:
        """A character as the model spells it: its bytes as byte-level characters."""
        if char not in self.spelt:
            self.spelt[char] = "".join(x for x, _ in self.byte_level.pre_tokenize_str(char))
        return self.spelt[char]

    def _piece_counts(self, piece: str) -> array:
        """Counts at the characters of a normalised piece of one kind: each beginning is one piece of its own."""
        if piece.isascii():
            return self.merges.counts(piece)
        spelt = [self._spell(c) for c in piece]
        counts, out, at = self.merges.counts("".join(spelt)), array("I"), 0
        for s in spelt:
            at += len(s)
            out.append(counts[at - 1])
        return out

    def _tail(self, tail: str) -> array:
        if tail not in self.tail_counts:
            if len(self.tail_counts) > 10_000 or len(tail) > RUN:
                self.tail_counts.clear()
            self.tail_counts[tail] = self.merges.counts(tail)
        return self.tail_counts[tail]

    def _odd(self, chunk: str) -> list:
        """Counts at the characters of any chunk; None within an open piece."""
        stops, upto = piece_borders(chunk, self.tok)
        pieces = list(zip([0, *stops], stops))
        plain = [self._plain(chunk[i:j]) for i, j in pieces]
        lengths = iter(self._lengths([chunk[i : k + 1] for (i, j), p in zip(pieces, plain) if p is None and j - i <= PIECE for k in range(i, j - 1)]))
        out: list = []
        for (i, j), p, before, after in zip(pieces, plain, [0, *upto], upto):
            if p is not None:
                out += [before + n for n in self._piece_counts(p)]
            else:
                out += [before + next(lengths) if j - i <= PIECE else None for _ in range(i, j - 1)]
                out.append(after)
        return out

    def _plain(self, piece: str) -> str | None:
        """The normalised piece, where each beginning of it is one piece that normalises as here; else None."""
        if piece.isascii():
            low = piece.lower()
            return low if low.isalpha() or not any(c.isalnum() or c.isspace() or c < " " for c in low) else None
        if _together(piece):
            return None
        low = "".join(x if len(x := c.lower()) == 1 else "\0" for c in piece)
        if "\0" in low or low != self.tok.normalizer.normalize_str(piece):
            return None
        return low if low.isalpha() or not any(category(c)[0] in "LNZC" for c in low) else None

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """For each chunk the counts at its bytes, as little-endian u32 (``_UNKNOWN`` where not counted)."""
        runs, rows, fresh = self.runs_seen, [], {}
        if len(runs) > RUNS:
            runs.clear()
        for c in chunks:
            s = c.decode("utf-8", "replace")
            run = s.rstrip(TAIL)
            if run.isascii() and run.isalpha():
                low = run.lower()
            else:
                low = self._normal(run) if run else None
            rows.append((s, len(run), low))
            if low is not None and len(low) <= RUN and low not in runs and low not in fresh:
                fresh[low] = low if low.isascii() else "".join(map(self._spell, low))
        for (low, spelt), counts in zip(fresh.items(), self.merges.many(list(fresh.values()))):
            if len(spelt) > len(low):
                counts = np.frombuffer(counts, "<u4")[np.cumsum([len(self._spell(x)) for x in low]) - 1].tobytes()
            runs[low] = counts
        out: list = []
        wide = []
        for i, (c, (s, size, low)) in enumerate(zip(chunks, rows)):
            if low is None:
                out.append(self._bytes(c, s, self._odd(s)))
                continue
            counts = runs[low] if len(low) <= RUN else self._piece_counts(low).tobytes()
            if size < len(s):
                last = int.from_bytes(counts[-4:], "little")
                counts += b"".join([(last + n).to_bytes(4, "little") for n in self._tail(s[size:])])
            if len(c) > len(s):
                wide.append(i)
            out.append(counts)
        for i, counts in zip(wide, _spread([chunks[i] for i in wide], [out[i] for i in wide])):
            out[i] = counts
        return out

    def _normal(self, run: str) -> str | None:
        """The run as the normaliser makes it, where it is letters, one by one as they were; else None."""
        if "\ufffd" in run:  # perhaps bytes that aren't UTF-8
            return None
        low = self.tok.normalizer.normalize_str(run)
        same = len(low) == len(run) and low.isalpha() and all(x == y or normalize("NFC", x).lower() == y for x, y in zip(run, low))
        return low if same else None

    @staticmethod
    def _bytes(raw: bytes, s: str, counts: list) -> bytes:
        if len(raw) == len(s):
            return np.array([_UNKNOWN if n is None else n for n in counts], "<u4").tobytes()
        sizes = [len(x.encode()) for x in s]
        if sum(sizes) != len(raw):  # bytes that aren't UTF-8: only the end is sure
            return np.array([_UNKNOWN] * (len(raw) - 1) + [counts[-1]], "<u4").tobytes()
        out, before = [], 0
        for size, n in zip(sizes, counts):
            out += [before] * (size - 1) + [_UNKNOWN if n is None else n]
            before = _UNKNOWN if n is None else n
        return np.array(out, "<u4").tobytes()


def _spread(chunks: list[bytes], counts: list[bytes]) -> list[bytes]:
    """Counts at the characters of chunks as counts at their bytes: within a character that of the one before."""
    if not chunks:
        return []
    raw = np.frombuffer(b"".join(chunks), np.uint8)
    value = np.frombuffer(b"".join(counts), "<u4")
    begins = (raw & 0xC0) != 0x80
    char = np.cumsum(begins) - 1
    first = np.zeros(len(value), bool)
    first[np.cumsum([0] + [len(x) // 4 for x in counts[:-1]])] = True
    before = np.where(first[char], 0, value[char - 1])
    out = np.where(np.append(begins[1:], True), value[char], before).astype("<u4").tobytes()
    ends = (4 * np.cumsum([len(c) for c in chunks])).tolist()
    return [out[i:j] for i, j in zip([0, *ends], ends)]


def prefix_encoder(path: str) -> ChunkEncoder:
    return kept(("prefixes", path), lambda: ChunkEncoder(path, library=Prefixes(path)))


def text_table(text: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """steps, block_tokens, long_ends, long_tokens of a text from the counts at its chunks' bytes."""
    n = len(text)
    steps = np.zeros(n, np.int64)
    word = ~_BLANK[np.frombuffer(text, np.uint8)]
    first = np.flatnonzero(word & np.concatenate(([True], ~word[:-1]))) if n else np.empty(0, np.int64)
    long_ends = long_tokens = np.empty(0, np.int64)
    if len(counts):
        places = np.flatnonzero(word)
        begins = np.zeros(len(places), bool)
        begins[np.searchsorted(places, first)] = True
        known = counts != _UNKNOWN
        value = counts.astype(np.int64)
        # the count that was known last, within the chunk
        last = np.maximum.accumulate(np.where(known | begins, np.arange(len(places)), 0))
        before = np.concatenate(([0], last[:-1]))
        was = np.where(begins, 0, np.where(known[before], value[before], 0))
        change = np.where(known, value - was, OPEN)
        closes = known & (np.concatenate(([False], ~known[:-1])) & ~begins | (abs(value - was) >= -OPEN))
        long_ends, long_tokens = places[closes] + 1, change[closes]
        change[closes] = 0
        steps[places] = change
    sums = np.cumsum(np.where(steps == OPEN, 0, steps))
    sums += np.cumsum(np.bincount(long_ends - 1, long_tokens, n).astype(np.int64)) if len(long_ends) else 0
    blocks = np.concatenate(([0], sums[BLOCK - 1 : n - 1 : BLOCK], sums[-1:])) if n else np.empty(0, np.int64)
    return steps.astype(np.int8), blocks, long_ends, long_tokens


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def prefix_tokens(df: DataFrame, text: str = "text", keep: list[str] = (), path: str | None = None) -> DataFrame:
    """Per row ``keep``, n_bytes, n_tokens and the prefix table.

    One pass over the rows, no shuffle; memory is bounded by an Arrow batch, the longest text and
    the worker's chunk table.
    """
    path = path or tokenizer_path()
    made_names = {"n_bytes", "n_tokens", *(x.split()[0] for x in TABLE.split(", "))}
    keep = [c for c in keep if c.lower() not in made_names]
    names = [*keep, "n_bytes", "n_tokens", *(x.split()[0] for x in TABLE.split(", "))]

    def run(batches):
        enc = prefix_encoder(path)
        for b in batches:
            texts = b.column("__text").to_pylist()
            cols = [b.column(k) for k in keep]
            first, size, rows = 0, 0, []
            for i, counts in enumerate(enc.payloads(texts)):
                rows.append(text_table(texts[i], np.frombuffer(counts, "<u4")))
                size += len(texts[i])
                if size >= _BATCH_BYTES or i == len(texts) - 1:
                    steps, *lists = zip(*rows)
                    sizes = pa.array([len(s) for s in steps], pa.int64())
                    total = pa.array([int(x[-1]) if len(x) else 0 for x in lists[0]], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(rows)) for c in cols), sizes, total, pa.array([s.tobytes() for s in steps], pa.binary()), *map(_lists, lists)], names)
                    first, size, rows = i + 1, 0, []

    rows = df.select(*keep, text_bytes(text).alias("__text"))
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, ", ".join(x for x in (kept_schema, COUNTS, TABLE) if x))


def _counts(row, first: int, last: int) -> np.ndarray:
    """Counts of the prefixes that end at bytes first + 1 .. last, from a row's table; -1 inside a long piece."""
    low = first // BLOCK
    steps = np.frombuffer(row["steps"], np.int8, last - low * BLOCK, low * BLOCK).astype(np.int64)
    open_ = steps == OPEN
    steps[open_] = 0
    for end, n in zip(row["long_ends"], row["long_tokens"]):
        if low * BLOCK < end <= last:
            steps[end - 1 - low * BLOCK] += n
    sums = row["block_tokens"][low] + np.cumsum(steps)
    sums[open_] = -1
    return sums[first - low * BLOCK :]


def tokens_upto(row, at: int, text: bytes | None = None, path: str | None = None) -> int:
    """Tokens of the first ``at`` bytes (at a character's edge), from a row of the table.

    ``text`` is needed only for a cut inside an open piece (see the module).
    """
    if at <= 0:
        return 0
    n = int(_counts(row, at - 1, at)[0])
    if n >= 0:
        return n
    if text is None:
        raise ValueError("the prefix ends within an open piece: its count needs the text")
    steps = np.frombuffer(row["steps"], np.int8, at)
    shut = np.flatnonzero(steps != OPEN)
    start = int(shut[-1]) + 1 if len(shut) else 0
    while text[start] & 0xC0 == 0x80:  # bytes within the piece's first character have steps
        start -= 1
    tok = prefix_encoder(path or tokenizer_path()).library.tok
    return tokens_upto(row, start) + len(tok.encode(text[start:at].decode("utf-8", "replace"), add_special_tokens=False).ids)


def truncate(row, text: bytes, budget: int, path: str | None = None) -> bytes:
    """The longest beginning of a text, in whole characters, that has at most ``budget`` tokens.

    Read from the table: a longer beginning may have fewer tokens, so the last that fits is taken.
    Within an open piece (see the module) it ends at one of that piece's tokens. Blanks at its end go.
    """
    if not text:
        return text
    counts = _counts(row, 0, len(text))
    edge = np.concatenate(((np.frombuffer(text, np.uint8)[1:] & 0xC0) != 0x80, [True]))
    fit = np.flatnonzero(edge & (counts >= 0) & (counts <= budget))
    at = int(fit[-1]) + 1 if len(fit) else 0
    next_edge = at + int(np.argmax(edge[at:])) if at < len(text) else None
    if next_edge is not None and counts[next_edge] < 0:  # a long piece begins here
        shut = np.flatnonzero(edge[at:] & (counts[at:] >= 0))
        piece = text[at : at + int(shut[0]) + 1 if len(shut) else len(text)].decode("utf-8", "replace")
        left = budget - tokens_upto(row, at)
        tok = prefix_encoder(path or tokenizer_path()).library.tok
        stops = [o[1] for o in tok.encode(piece, add_special_tokens=False).offsets]
        for k in reversed(stops[: max(0, left)]):
            if len(tok.encode(piece[:k], add_special_tokens=False).ids) <= left:
                at += len(piece[:k].encode())
                break
    return text[:at].rstrip(b" \t\n\r\x0b\x0c")


def fits(block_tokens: str = "block_tokens", budget: int = 2048):
    """Column: do all tokens fit the budget?"""
    return total_tokens(block_tokens) <= budget


def total_tokens(block_tokens: str = "block_tokens"):
    """Column: all tokens of a text, from its table."""
    return F.coalesce(F.try_element_at(F.col(block_tokens), F.lit(-1)), F.lit(0)).cast("long")


def op7_prefix_token_counts(spark, sf_dir: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text of ``documents``, from its stored prefixes."""
    stored = cut(prefix_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"]), "prefix-table", compression="zstd")
    return stored.select("doc_id", "n_bytes", total_tokens().alias("n_tokens"), (~fits(budget=limit)).alias("over_limit"))
