"""Readers: ground-truth tables, detection documents, audio, metrics and latent tables.

All schemas are given, rows that can't be parsed are dropped rather than failing the read, and
paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirpline.functions.intervals import bbox_to_time, micros, natural_key, parse_vector, session_key, session_of_path
from chirpline.sources.audio import samples_of

GT = "name string, start_seconds string, stop_seconds string"
LABELS = "experiment string, idx string, start_seconds string, stop_seconds string, is_vocalization string"
CALLS = "start_time_file_sec string, stop_time_file_sec string"
DOCUMENT = (
    "info map<string,string>, categories array<struct<id int,name string>>, "
    "images array<struct<id int,file_name string,width int,height int,window_start_sec double,window_end_sec double,das_events array<struct<vox_idx int,start_sec double,stop_sec double>>>>, "
    "annotations array<struct<id int,image_id int,category_id int,bbox array<double>,area double,iscrowd int,segmentation array<array<double>>,score double,centroid_hz double,flatness double,reject_reason string>>"
)
METRICS = "session string, channel string, n_gt bigint, n_pred bigint, tp bigint, pred_tp bigint, fp bigint, fn bigint, recall double, precision double, f1 double, n_combined bigint, combined_tp bigint, combined_fn bigint, combined_recall double"
BOUTS = "session string, bout_id int, n_calls int, start double, stop double, duration double, mean_ici string, tp int, fn int, pred_tp int, fp int, recall string, precision string, f1 string, n_pred_events int, merge_ratio string"


def number(c) -> Column:
    """A double, NULL where it isn't a number."""
    v = F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(v), v)


def _times(df: DataFrame, start: str, stop: str) -> DataFrame:
    df = df.withColumns({"t0_us": micros(number(start)), "t1_us": micros(number(stop))})
    return df.where("t0_us is not null and t1_us is not null").drop(start, stop)


def read_gt(spark: SparkSession, path: str, names: tuple[str, ...] = ("vox", "combined"), positive: bool = False) -> DataFrame:
    """Per-recording ground-truth CSV files: session (of the path), name, t0_us, t1_us."""
    rows = spark.read.schema(GT).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    out = _times(rows.withColumn("session", session_of_path(F.col("_metadata.file_path"))), "start_seconds", "stop_seconds").where(F.col("name").isin(*names))
    return out.where("t1_us > t0_us") if positive else out


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The global label CSV: (ground truth, coverage spans)."""
    from chirpline.operators.scoring import coverage_spans, positives

    rows = spark.read.schema(LABELS).option("header", True).csv(path)
    rows = rows.where(number("experiment").isNotNull() & number("idx").isNotNull()).withColumn("session", session_key(number("experiment"), number("idx")))
    rows = _times(rows, "start_seconds", "stop_seconds").drop("experiment", "idx")
    return positives(rows).select("session", "t0_us", "t1_us"), coverage_spans(rows)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Per-experiment call CSV files as ground truth, named vox, in order of time."""
    rows = spark.read.schema(CALLS).option("header", True).csv(path).withColumn("session", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))
    return _times(rows, "start_time_file_sec", "stop_time_file_sec").withColumn("name", F.lit("vox")).orderBy("session", "t0_us", "t1_us")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Detection documents, one row each: session, channel, images, annotations."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    at = F.col("_metadata.file_path")
    return rows.select(at.alias("file"), session_of_path(at).alias("session"), F.coalesce(F.regexp_extract(at, r"_ch_(\d+)\.json$", 1).try_cast("int"), F.regexp_extract(at, r"/channel=(\d+)/", 1).try_cast("int")).alias("channel"), "images", "annotations")


def read_detections(spark: SparkSession, path: str, channels: list[int] | None = None) -> DataFrame:
    """Annotations joined to their images: a row per detection with times from its box."""
    docs = read_documents(spark, path)
    if channels is not None:
        docs = docs.where(F.col("channel").isin(*channels))
    a = docs.select("file", "session", "channel", F.explode("annotations").alias("a"))
    i = docs.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.col("i").alias("image"))
    both = a.withColumn("image_id", F.col("a.image_id")).join(i, ["file", "image_id"])
    t0, t1 = bbox_to_time(F.col("a.bbox")[0], F.col("a.bbox")[2], F.col("image.window_start_sec"), F.col("image.window_end_sec"), F.col("image.width"))
    return both.select("session", "channel", "file", "image_id", F.col("a.id").alias("id"), F.col("image.file_name").alias("file_name"), F.col("a.bbox").alias("bbox"), F.col("a.area").alias("area"), F.col("a.score").alias("score"), micros(t0).alias("t0_us"), micros(t1).alias("t1_us"))


def vox_table(spark: SparkSession, path: str) -> DataFrame:
    """start and stop seconds of all detections, by start."""
    return read_detections(spark, path).select((F.col("t0_us") / 1e6).alias("start_seconds"), (F.col("t1_us") / 1e6).alias("stop_seconds")).orderBy("start_seconds", "stop_seconds")


def read_wav(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """session, channel, sr, samples: the first file in order of name of each session and channel.

    A file is a row here; :func:`chirpline.sources.audio.read_wav_chunks` reads long ones by ranges.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}_*.wav").load(path)
    files = files.select("path", "content", session_of_path(F.col("path")).alias("session"), F.regexp_extract("path", rf"{prefix}_(\d+)_[^/]*\.wav$", 1).try_cast("int").alias("channel"))
    first = files.groupBy("session", "channel").agg(F.min("path").alias("path"))

    def decode(batches):
        for rows in batches:
            got = [pcm(bytes(c)) for c in rows.content]
            yield pd.DataFrame({"session": rows.session, "channel": rows.channel, "sr": [g[0] for g in got], "samples": [g[1] for g in got]})

    return files.join(first, ["session", "channel", "path"], "left_semi").select("session", "channel", "content").mapInPandas(decode, "session string, channel int, sr int, samples array<float>")


def pcm(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and the first channel of a PCM file as numbers in [-1, 1)."""
    with wave.open(io.BytesIO(raw)) as w:
        return w.getframerate(), samples_of(w.readframes(w.getnframes()), w.getnchannels(), w.getsampwidth())


def slice_chunks(audio: DataFrame, seconds: float = 1.0) -> DataFrame:
    """A row per whole chunk: session, channel, chunk, sr, t0_us, t1_us, samples. A short tail is dropped."""
    size = F.floor(F.col("sr") * seconds).cast("int")
    n = F.floor(F.size("samples") / size).cast("int")
    rows = audio.withColumn("chunk", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    at = micros(F.col("chunk") * size / F.col("sr"))
    return rows.select("session", "channel", "chunk", "sr", at.alias("t0_us"), micros((F.col("chunk") + 1) * size / F.col("sr")).alias("t1_us"), F.slice("samples", F.col("chunk") * size + 1, size).alias("samples"))


def list_chunks(files: DataFrame, path: str = "path", channels: list[int] | None = None) -> DataFrame:
    """channel, chunk, t0_us, t1_us from names like prefix_<ch>_..._chunk_<i>_t<a>-<b>.png."""
    pattern = r"_(\d+)_[^/]*_chunk_(\d+)_t([0-9.]+)-([0-9.]+)\.\w+$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    out = files.where(F.col(path).rlike(pattern)).select(path, part(1).cast("int").alias("channel"), part(2).cast("int").alias("chunk"), micros(part(3).cast("double")).alias("t0_us"), micros(part(4).cast("double")).alias("t1_us"))
    return out if channels is None else out.where(F.col("channel").isin(*channels))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path")


def discover_sessions(files: DataFrame, first: int | None = None, named: list[str] | None = None) -> DataFrame:
    """Sessions that the files lie in, nested or flat; all, the first n in natural order, or those named."""
    s = files.select(session_of_path("path").alias("session")).distinct()
    if named is not None:
        return s.where(F.col("session").isin(*named))
    return s if first is None else s.orderBy(natural_key("session"), "session").limit(first)


def qualifying_sessions(gt: DataFrame, audio: DataFrame, min_vox: int, n: int) -> DataFrame:
    """One session per experiment that has audio and at least ``min_vox`` calls, n at most."""
    parts = [F.regexp_extract("session", r"experiment_(\d+)", 1).cast("int").alias("experiment"), F.regexp_extract("session", r"idx_(\d+)", 1).cast("int").alias("idx")]
    ok = gt.groupBy("session").agg(F.count(F.lit(1)).alias("n_vox")).where(F.col("n_vox") >= min_vox).join(audio.select("session").distinct(), "session", "left_semi").select("session", "n_vox", *parts)
    one = ok.withColumn("r", F.row_number().over(Window.partitionBy("experiment").orderBy("idx"))).where("r = 1").drop("r")
    return one.orderBy("experiment").limit(n)


def read_vocalizations(spark: SparkSession, path: str, names: DataFrame, labels: int = 70) -> DataFrame:
    """The large call table: only the columns in use, only the named files; vectors parsed."""
    z = f"z_{labels}"
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select("audio_filename", number("onset").alias("onset"), number("offset").alias("offset"), "cohort", F.col(z).try_cast("int").alias(z), "latent_means", f"prob_{z}")
    rows = rows.join(names.select("audio_filename").distinct(), "audio_filename", "left_semi")
    return rows.select("audio_filename", "onset", "offset", "cohort", z, parse_vector("latent_means").alias("embedding"), F.element_at(parse_vector(f"prob_{z}"), F.col(z) + 1).alias("confidence"))


def read_metrics(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A metrics CSV with its method; files without pred_tp count tp there."""
    return named_csv(spark, path, METRICS).withColumn("pred_tp", F.coalesce("pred_tp", "tp")).withColumn("method", F.lit(method))


def resolve_metrics(spark: SparkSession, folder: str, name: str = "metrics.csv") -> str | None:
    """The named metrics file of a folder, else its only metrics*.csv; None where there are several or none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "metrics*.csv").load(folder).select("path")
    paths = sorted(r.path for r in files.collect())  # the files of one method's folder
    exact = [p for p in paths if p.rsplit("/", 1)[-1] == name]
    return exact[0] if exact else paths[0] if len(paths) == 1 else None


def named_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header whose columns may be in any order or missing."""
    from pyspark.sql.types import StructType

    raw = spark.read.option("header", True).csv(path)
    return raw.select(*((F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(schema)))


def read_bouts(spark: SparkSession, path: str) -> DataFrame:
    """A bout CSV; undefined metrics are NULL, missing event counts 0."""
    rows = named_csv(spark, path, BOUTS)
    return rows.withColumns({c: number(c) for c in ("mean_ici", "recall", "precision", "f1", "merge_ratio")} | {"n_pred_events": F.coalesce("n_pred_events", F.lit(0))})


def read_latents(spark: SparkSession, path: str, cohort: str | None = None) -> DataFrame:
    """Latent tables: Parquet with an embedding column."""
    rows = spark.read.parquet(path)
    return rows if cohort is None else rows.where(F.col("cohort") == cohort)
