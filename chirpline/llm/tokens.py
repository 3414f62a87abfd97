"""Token ids of texts by the ``tokenizers`` library, one white-space chunk at a time.

The vocabulary file's pipeline never joins characters across white space: its normaliser maps
every run of white space to one blank and its split pattern takes no white space into a piece,
and special strings hold none. So the ids of a text are the ids of its chunks in order, and a
chunk seen before need not be encoded again. Chunks are cut at ASCII white space only; other
white space stays inside a chunk and is left to the library.

Chunks are told apart by their bytes: those of up to seven, packed with their length into a number,
for all of a group of texts at once, so that they never become Python objects unless they are new;
longer ones by a dictionary.
"""

from __future__ import annotations

import os
from unicodedata import normalize

import numpy as np

from .hashing import PACKED, chunk_edges, packed
from .workers import kept

#: Chunks and letter runs that a worker's tables hold (about 120 bytes each; twice 200 bytes each).
CACHE_CHUNKS, CACHE_RUNS = 300_000, 150_000
#: ASCII punctuation that starts a piece of its own after a letter (all but the apostrophe).
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes that are looked up at once; a longer text is looked up part by part.
_GROUP_BYTES = 500_000
_BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Generations:
    """A table of bounded size in two generations.

    When the young one is full it becomes the old one; what is used again moves back.
    """

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are in neither generation; the rest are in the young one afterwards."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        new, young, old = [], self.young, self.old
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is None:
                    new.append(k)
                else:
                    young[k] = v
        return new


class Library:
    """Ids of new chunks.

    A chunk of letters followed by ASCII punctuation is the letters' ids, then the punctuation's:
    the split pattern always cuts there (the letters must stay letters when normalised). Letter runs are encoded many to a call and told apart by
    the word-end tokens; if a run gives more than one piece (a letter whose lower case holds a
    mark) the runs of that call are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.runs, self.tails = Generations(CACHE_RUNS), Generations(10_000)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _runs(self, runs: list[str]) -> None:
        """Encode letter runs, a few hundred to a text."""
        parts = [runs[i : i + 400] for i in range(0, len(runs), 400)]
        table = self.runs.young
        for part, e in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                table.update(zip(part, self._each(part)))
                continue
            raw, at = ids.tobytes(), (stops * 4).tolist()
            table.update((r, raw[i:j]) for r, i, j in zip(part, [0, *at], at))

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """For each chunk its ids as little-endian u32 bytes."""
        out: list = [b""] * len(chunks)
        split, odd = [], []
        for i, c in enumerate(chunks):
            s = c.lower().decode("utf-8", "replace")
            run = s.rstrip(TAIL)
            if run.isascii() and run.isalpha() or normalize("NFC", run).lower().isalpha():
                split.append((i, run, s[len(run) :]))
            else:
                odd.append(i)
        if split:
            self._runs(self.runs.missing({x[1] for x in split}))
            tails = self.tails.missing({x[2] for x in split})
            self.tails.young.update(zip(tails, self._each(tails)))
            runs, tails = self.runs.young, self.tails.young
            for i, r, t in split:
                out[i] = runs[r] + tails[t]
        for i, x in zip(odd, self._each([chunks[i].decode("utf-8", "replace") for i in odd])):
            out[i] = x
        return out


class ChunkEncoder:
    """Encodes groups of texts by a table of chunks of bounded size.

    ``at`` and ``count`` say where the ids of each row of the table stand in ``flat``. Short chunks
    find their row by their packed bytes in a sorted array, long ones in a dictionary.
    """

    def __init__(self, path: str, limit: int | None = None, library: Library | None = None):
        self.library, self.limit, self.clock = library or Library(path), limit or CACHE_CHUNKS, 0
        self.keys, self.key_rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.long: dict[bytes, int] = {}
        self.at, self.count, self.used = (np.empty(0, np.int64) for _ in range(3))
        self.flat = np.empty(0, "<u4")

    def vocab_size(self) -> int:
        return len(self.library.ends)

    def ids(self, texts: list[bytes]):
        """For each text the ids as little-endian u32 bytes."""
        return self._whole(texts)

    #: The same for a library that gives other numbers than ids.
    payloads = ids

    def _whole(self, texts: list[bytes]):
        """The ids of each text, joined over the parts of a long one."""
        waiting = []
        for group, ends in _groups(texts):
            for got, end in zip(self._group_ids(group), ends):
                waiting.append(got)
                if end:
                    yield waiting[0] if len(waiting) == 1 else b"".join(waiting)
                    waiting = []

    def _group_ids(self, group: list[bytes]):
        cuts, rows, inverse = self._look_up(group)
        counts = self.count[rows][inverse]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.at[rows][inverse] - (ends - counts), counts) + np.arange(total)
        raw = memoryview(self.flat[source].tobytes())
        places = np.concatenate(([0], ends))[cuts] * 4
        for i, j in zip(places.tolist(), places[1:].tolist()):
            yield bytes(raw[i:j])

    def _look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the texts' chunks begin and end, the table rows of the distinct chunks, and each chunk's place among those."""
        joined = b" ".join(texts)
        starts, stops = chunk_edges(joined)
        lengths = stops - starts
        cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        short = lengths <= PACKED
        at = np.flatnonzero(short)
        keys, first, inverse_short = np.unique(packed(joined, starts[at], lengths[at]), return_index=True, return_inverse=True)
        first = at[first]
        own: dict[bytes, int] = {}
        long = np.flatnonzero(~short)
        inverse = np.empty(len(starts), np.int64)
        inverse[at] = inverse_short
        inverse[long] = len(keys) + np.fromiter((own.setdefault(joined[i:j], len(own)) for i, j in zip(starts[long].tolist(), stops[long].tolist())), np.int64, len(long))
        self.clock += 1
        if len(self.at) > self.limit:
            self._forget()
        rows = np.concatenate((self._find(keys), np.fromiter((self.long.get(c, -1) for c in own), np.int64, len(own))))
        new_short = np.flatnonzero(rows[: len(keys)] < 0)
        new_long = [c for c, row in zip(own, rows[len(keys) :].tolist()) if row < 0]
        if len(new_short) or new_long:
            where = first[new_short]
            got = self.library.ids([joined[i:j] for i, j in zip(starts[where].tolist(), stops[where].tolist())] + new_long)
            sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
            made = np.arange(len(self.at), len(self.at) + len(got))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(sizes) - sizes))
            self.count = np.concatenate((self.count, sizes))
            self.used = np.concatenate((self.used, np.zeros(len(got), np.int64)))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(got), "<u4")))
            into = np.searchsorted(self.keys, keys[new_short])
            self.keys = np.insert(self.keys, into, keys[new_short])
            self.key_rows = np.insert(self.key_rows, into, made[: len(new_short)])
            self.long.update(zip(new_long, made[len(new_short) :].tolist()))
            rows[rows < 0] = made
        self.used[rows] = self.clock
        return cuts, rows, inverse

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of packed chunks, -1 where the table has none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.key_rows[place], -1)

    def _forget(self) -> None:
        """Keep the half of the table that was used last."""
        stay = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        moved = np.cumsum(stay) - 1
        at, count = self.at[stay], self.count[stay]
        ends = np.cumsum(count)
        source = np.repeat(at - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        self.flat, self.at, self.count, self.used = self.flat[source], ends - count, count, self.used[stay]
        kept_keys = stay[self.key_rows]
        self.keys, self.key_rows = self.keys[kept_keys], moved[self.key_rows[kept_keys]]
        self.long = {c: int(moved[row]) for c, row in self.long.items() if stay[row]}


def _parts(text: bytes, limit: int):
    """A text cut at blanks into parts of about ``limit`` bytes; a longer chunk stays whole."""
    at = 0
    while len(text) - at > limit:
        to = max(text.rfind(c, at + 1, at + limit) for c in _BLANKS)
        if to < 0:
            to = min((i for c in _BLANKS if (i := text.find(c, at + limit)) >= 0), default=len(text))
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def _groups(texts: list[bytes], limit: int | None = None):
    """Groups of texts of about ``limit`` bytes (``_GROUP_BYTES`` if None), and which of them end their text."""
    limit, group, ends, size = limit or _GROUP_BYTES, [], [], 0
    for t in texts:
        parts = [t] if len(t) <= limit else list(_parts(t, limit))
        for i, part in enumerate(parts):
            group.append(part)
            ends.append(i == len(parts) - 1)
            size += len(part)
            if size >= limit:
                yield group, ends
                group, ends, size = [], [], 0
    if group:
        yield group, ends


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file (kept between the tasks of a worker)."""
    return kept(("encoder", path), lambda: ChunkEncoder(path))
