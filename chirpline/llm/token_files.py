"""Operator 1: token ids in binary shards of fixed-width packed blocks.

A shard holds ids in the fewest bits that the vocabulary needs (16 for 49,408 ids), in blocks of
``BLOCK_IDS`` ids, so id ``i`` lies in block ``i // BLOCK_IDS`` and any block unpacks alone with
numpy. Layout::

    magic "CHIRPTOK"
    blocks, each ceil(n * bits / 8) bytes, little end first
    block offsets (u64 each), document keys (i64), document starts (u64, one more than documents)
    trailer: bits, block ids, blocks, documents, ids, null-key flag count (u64 each), magic

Documents are dealt by range of ``doc_id`` (ties by text, then by row), each task writes its range
as one shard under a name of its own, and a manifest written by Spark names the shards that count:
a task that runs twice or is lost leaves a file that the manifest doesn't name. The number of ids
before a shard comes from sums over the manifest, which has a row per shard.

Shards are written with ``pyarrow.fs`` to the folder the session shares (local, HDFS, S3, GCS).

Nulls: a null text is empty and has the end id only; a null doc_id is kept and comes first.
Repeated doc_ids are separate documents, in order of text. Empty tables give an empty manifest.
A text of any length is encoded part by part. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, shared_dir, table, text_bytes
from .tokens import encoder, tokenizer_path

MAGIC = b"CHIRPTOK"
BLOCK_IDS = 1 << 16
#: Ids that a reader unpacks at once.
READ_IDS = 1 << 20


def bits_for(vocab: int) -> int:
    return max(1, math.ceil(math.log2(max(2, vocab))))


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(raw[:, :bits], bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def file_system(path: str):
    """The pyarrow file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes blocks as they fill; keeps only the documents' keys and starts in memory."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.parts, self.waiting = out, bits, [], 0
        self.at, self.blocks, self.keys, self.starts, self.nulls = len(MAGIC), [], [], [0], 0
        out.write(MAGIC)

    def add(self, key, ids: bytes) -> None:
        self.nulls += key is None
        self.keys.append(0 if key is None else key)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.parts.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= BLOCK_IDS:
            ids = np.frombuffer(b"".join(self.parts), "<u4")
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self._block(ids[i : i + BLOCK_IDS])
            self.parts, self.waiting = [ids[whole:].tobytes()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.waiting:
            self._block(np.frombuffer(b"".join(self.parts), "<u4"))
        for x, kind in ((self.blocks, "<u8"), (self.keys, "<i8"), (self.starts, "<u8")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(np.array([self.bits, BLOCK_IDS, len(self.blocks), len(self.keys), self.starts[-1], self.nulls], "<u8").tobytes() + MAGIC)


class ShardReader:
    """Random access to a shard: the tables at its end, then any range of ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if self._bytes(0, 8) != MAGIC or self._bytes(size - 8, 8) != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block, blocks, docs, self.n_ids, nulls = np.frombuffer(self._bytes(size - 56, 48), "<u8").tolist()
        at = size - 56 - 8 * (blocks + docs + docs + 1)
        raw = self._bytes(at, size - 56 - at)
        self.offsets = np.frombuffer(raw, "<u8", blocks)
        keys = np.frombuffer(raw, "<i8", docs, 8 * blocks).tolist()
        self.keys = [None] * nulls + keys[nulls:]
        self.starts = np.frombuffer(raw, "<u8", docs + 1, 8 * (blocks + docs)).astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reading only the blocks they lie in."""
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        size = (last - first) * (self.block * self.bits // 8) + math.ceil((n - (last - first) * self.block) * self.bits / 8)
        got = unpack(self._bytes(int(self.offsets[first]), size), n, self.bits)
        return got[start - first * self.block : stop - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_shards(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = 1, out_dir: str | None = None) -> DataFrame:
    """Encode and write every text; returns the manifest: shard, path, n_docs, n_ids, id_start, doc_start.

    Only the key and the text are read and shuffled, once.
    """
    path, out_dir = path or tokenizer_path(), out_dir or shared_dir(df.sparkSession, "token-shards")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, writer, shard = encoder(path), None, TaskContext.get().partitionId()
        for b in batches:
            if writer is None and len(b):
                name = f"{out_dir}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
                system, inner = file_system(name)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(inner)
                writer = ShardWriter(out, bits_for(enc.vocab_size()))
            for k, ids in zip(b.column("key").to_pylist(), enc.ids(b.column("text").to_pylist())):
                writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [len(writer.keys)], "n_ids": [writer.starts[-1]]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # the row number parts even repeated rows, so no value can fill a range alone
    rows = df.select(F.col(key).cast("long").alias("key"), text_bytes(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("key", "tie", "row").sortWithinPartitions("key", "tie", "row").select("key", "text")
    manifest = cut(map_arrow(rows, run, "shard int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumns({f"{n}_start": F.coalesce(F.sum(f"n_{n}s").over(before), F.lit(0)) for n in ("id", "doc")})


def read_token_shards(manifest: DataFrame, summary: bool = False) -> DataFrame:
    """The documents of the shards: doc_id, start, n_tokens and ids (with ``summary``: ids_crc32)."""

    def run(batches):
        for b in batches:
            for name, base in zip(b.column("path").to_pylist(), b.column("id_start").to_pylist()):
                system, inner = file_system(name)
                with system.open_input_file(inner) as source:
                    r = ShardReader(source)
                    i = 0
                    while i < len(r.keys):
                        j = max(i + 1, int(np.searchsorted(r.starts, r.starts[i] + READ_IDS, "right")) - 1)
                        ids, cuts = r.ids(int(r.starts[i]), int(r.starts[j])), r.starts[i : j + 1] - r.starts[i]
                        if summary:
                            raw = memoryview(ids.tobytes())
                            last = pa.array([zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(cuts, cuts[1:])], pa.int64())
                        else:
                            last = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(r.keys[i:j], pa.int64()), pa.array(base + r.starts[i:j]), pa.array(np.diff(cuts)), last], ["doc_id", "start", "n_tokens", "ids_crc32" if summary else "ids"])
                        i = j

    n = max(1, manifest.count())
    shards = manifest.select("path", "id_start").repartition(n)
    return map_arrow(shards, run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if summary else "ids array<int>"))


def token_files(docs: DataFrame) -> DataFrame:
    """Write the documents' ids, read the files back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_shards(write_token_shards(docs), summary=True)


def op1_token_id_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every text of ``documents``, read back from its shards."""
    return token_files(table(spark, sf_dir, "documents"))
