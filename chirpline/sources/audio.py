"""Audio files read by ranges of bytes: a recording of any length is dealt over many tasks.

Files are listed by Spark, headers are read where the list lies, and the whole chunks of every file are
dealt out in stretches of about ``STRETCH_BYTES``; a task opens a file, reads its stretch and gives
a row for each chunk. No file is ever held whole.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.functions.intervals import micros, session_of_path

#: Bytes of a file that a task reads at once.
STRETCH_BYTES = 8 << 20
# fixed values: format tags of plain PCM and of the extensible header
PCM, EXTENSIBLE = 1, 0xFFFE


def open_file(path: str):
    """A path or URI as a random-access file."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def read_header(f) -> tuple[int, int, int, int, int]:
    """sr, channels, bytes of a sample, where samples begin, and frames there are, of a RIFF or RF64 file.

    A data chunk that states no size, or more than there is, ends where the file ends. ValueError for
    what isn't PCM.
    """
    size = f.size()

    def part(at, n):
        f.seek(at)
        return f.read(n)

    top = part(0, 12)
    if len(top) < 12 or top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", part(at, 8))
        if name == b"ds64":
            long_size = struct.unpack("<Q", part(at + 16, 8))[0]
        elif name == b"fmt ":
            tag, channels, sr, _, _, bits = struct.unpack("<HHIIHH", part(at + 8, 16))
            form = (tag, channels, sr, (bits + 7) // 8)
        elif name == b"data":
            if form is None or form[0] not in (PCM, EXTENSIBLE) or not form[1] or form[3] not in (1, 2, 3, 4):
                raise ValueError("not plain PCM")
            n = long_size if n == 0xFFFFFFFF and long_size is not None else n
            return form[2], form[1], form[3], at + 8, min(n, size - at - 8) // (form[1] * form[3])
        at += 8 + n + n % 2
    raise ValueError("no samples")


def samples_of(raw: bytes, channels: int, width: int) -> np.ndarray:
    """The first channel of PCM frames as numbers in [-1, 1)."""
    if width == 3:  # as the high bytes of four
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.reshape(-1, channels * 4)[:, :4].copy().view("<i4").ravel() / float(1 << 31)).astype(np.float32)
    data = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).reshape(-1, channels)[:, 0]
    return ((data.astype(np.float32) - 128) / 128 if width == 1 else data / float(1 << (8 * width - 1))).astype(np.float32)


def wav_files(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """path, session, channel: the first file in order of name of each session and channel; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}_*.wav").load(path)
    files = files.select("path", session_of_path(F.col("path")).alias("session"), F.regexp_extract("path", rf"{prefix}_(\d+)_[^/]*\.wav$", 1).try_cast("int").alias("channel"))
    return files.groupBy("session", "channel").agg(F.min("path").alias("path"))


def wav_headers(files: DataFrame) -> DataFrame:
    """``files`` with sr, channels, width, begin and frames; a file that isn't PCM has NULLs and an ``error``."""
    kinds = {"sr": pa.int32(), "channels": pa.int32(), "width": pa.int32(), "begin": pa.int64(), "frames": pa.int64()}

    def run(batches):
        for b in batches:
            got, errors = [], []
            for p in b.column("path").to_pylist():
                try:
                    with open_file(p) as f:
                        got.append(read_header(f))
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    got.append((None,) * len(kinds))
                    errors.append(str(e))
            columns = zip(*got) if got else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds.values())), pa.array(errors, pa.string())], [*b.schema.names, *kinds, "error"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, schema + ", sr int, channels int, width int, begin long, frames long, error string")


def read_wav_chunks(spark: SparkSession, path: str, prefix: str, seconds: float = 1.0, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """session, channel, chunk, sr, t0_us, t1_us, samples: a row per whole chunk; a short tail is dropped.

    Of several files of a session and channel the first by name counts. Files that aren't PCM, and
    recordings shorter than a chunk, give no rows.
    """
    heads = wav_headers(wav_files(spark, path, prefix)).where("error is null")
    size = F.floor(F.col("sr") * seconds).cast("long")
    chunks = F.when(size > 0, F.floor(F.col("frames") / size)).otherwise(0).cast("long")
    each = F.greatest(F.lit(1), F.floor(F.lit(stretch_bytes) / (size * F.col("channels") * F.col("width")))).cast("long")
    rows = heads.select("session", "channel", "path", "sr", "channels", "width", "begin", size.alias("size"), chunks.alias("chunks"), each.alias("each")).where("chunks > 0")
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1, F.col("each"))))
    rows = rows.withColumn("n", F.least(F.col("each"), F.col("chunks") - F.col("first"))).repartition("path", "first")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                frame = r["channels"] * r["width"]
                with open_file(r["path"]) as f:
                    f.seek(r["begin"] + r["first"] * r["size"] * frame)
                    x = samples_of(f.read(r["n"] * r["size"] * frame), r["channels"], r["width"])
                n = r["n"]
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * r["size"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["session"]] * n, pa.string()), pa.array([r["channel"]] * n, pa.int32()), pa.array(np.arange(r["first"], r["first"] + n), pa.int32()), pa.array([r["sr"]] * n, pa.int32()), pa.array([r["size"]] * n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x))],
                    ["session", "channel", "chunk", "sr", "size", "samples"],
                )

    got = rows.mapInArrow(run, "session string, channel int, chunk int, sr int, size long, samples array<float>")
    at = lambda k: micros((F.col("chunk") + k) * F.col("size") / F.col("sr"))
    return got.select("session", "channel", "chunk", "sr", at(0).alias("t0_us"), at(1).alias("t1_us"), "samples")
