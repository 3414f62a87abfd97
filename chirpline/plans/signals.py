"""Queries: framed signals made from the sessions' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.operators import gates as G
from chirpline.operators import signal as X
from chirpline.plans import views as V

Q, O = {}, {}
CHUNK, SR = 256, 1000


def query(f):
    Q[f.__name__] = f
    return f


def _chunks(spark, d):
    """Each session's values in order, as chunks of samples."""
    fr = V.frames(spark, d).withColumn("chunk", F.floor(F.col("frame") / CHUNK).cast("int"))
    rows = fr.groupBy("session", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "env"))), lambda x: x["env"].cast("float")).alias("samples"))
    return rows.where(F.size("samples") == CHUNK).select("session", F.lit(0).alias("channel"), "chunk", "samples", F.lit(SR).alias("sr"))


@query
def spectrogram_peaks(spark, d):
    fr = X.spectrogram(_chunks(spark, d), ["session", "chunk"], 64, 32)
    top = F.array_position("power", F.array_max("power")) - 1
    return fr.select("session", "chunk", "frame", top.cast("int").alias("peak_bin"), F.round(F.array_max("power"), 9).alias("peak"))


@query
def band_envelope(spark, d):
    fr = X.spectrogram(_chunks(spark, d), ["session", "chunk"], 64, 32)
    return X.band_envelope(fr, ["session", "chunk"], 4, 16)


@query
def db_calibration(spark, d):
    frames = X.spectrogram(_chunks(spark, d), ["session", "chunk"], 64, 32)
    at = F.col("chunk") * (CHUNK // 32 - 1) + F.col("frame")
    return X.db_range(X.spread_windows(frames, ["session"], at, 20), ["session"])


@query
def spectral_features(spark, d):
    ev = _chunks(spark, d).withColumns({"f_low_hz": F.lit(50.0), "f_high_hz": F.lit(400.0)})
    return X.spectral_features(ev, ["session", "chunk"])


@query
def ridge_detections(spark, d):
    # the gates' frequencies are for 125 kHz audio: the same shares of this signal's rate
    gates = G.reason(min_cols=3, min_sweep_frac=0.0, min_centroid_hz=25000.0 * SR / 125000)
    return X.detect(_chunks(spark, d), ["session", "chunk"], gates, 90.0, 4, 64, 16, min_hz=20000.0 * SR / 125000, max_vertical=5.0, max_horizontal=5.0)


@query
def labelled_features(spark, d):
    """Spans of the signal with their label by the true ones and the features of their band."""
    span = CHUNK * 1_000_000 // SR
    chunks = _chunks(spark, d)
    at = F.col("chunk").cast("long") * span
    found = chunks.select("session", "channel", F.col("chunk").cast("long").alias("event_id"), (at + span // 10).alias("t0_us"), (at + span // 2).alias("t1_us"), F.lit(50.0).alias("f_low_hz"), F.lit(400.0).alias("f_high_hz"))
    truth = chunks.where(F.col("chunk") % 3 == 0).select("session", F.col("chunk").cast("long").alias("event_id"), at.alias("t0_us"), (at + span // 4).alias("t1_us"))
    return X.feature_table(found, truth, chunks, span)
