"""Framed-signal jobs: rows of chunks in, rows of frames, components or features out.

Framing, scaling, bands, features, runs and components are column expressions, joins and groups;
numpy transforms frames (``spectra``) and slices (``band_pass``) only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpline.operators.graph import components
from chirpline.operators.quantiles import quantiles
from chirpline.sources.shared import cut

FEATURES = ["centroid", "bandwidth", "rolloff", "flatness", "rms", "zcr", "peak_freq"]
EPS = 1e-10
DB_EPS = 1e-12


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    """Periodic Tukey window."""
    x = np.arange(n) / n
    w = np.ones(n)
    edge = x < share / 2
    w[edge] = 0.5 * (1 + np.cos(2 * np.pi / share * (x[edge] - share / 2)))
    edge = x >= 1 - share / 2
    w[edge] = 0.5 * (1 + np.cos(2 * np.pi / share * (x[edge] - 1 + share / 2)))
    return w


def total(values, of=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def constants(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def framed(samples: Column, size, hop: int) -> Column:
    """The frames of an array of samples, in order; none if it is shorter than a frame."""
    n = F.floor((F.size(samples) - size) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(samples, i * hop + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def spectrum(frame: Column) -> Column:
    """Magnitudes of the real transform of a frame; all frames of a job have one length."""

    @F.pandas_udf("array<double>")
    def run(frames: pd.Series) -> pd.Series:
        return pd.Series(list(np.abs(np.fft.rfft(np.stack(frames.to_numpy()))))) if len(frames) else pd.Series([], dtype=object)

    return run(frame)


def spectra(frames: Column) -> Column:
    """The same for each frame of a row's array of frames."""

    @F.pandas_udf("array<array<double>>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([list(np.abs(np.fft.rfft(np.stack(r)))) if r is not None and len(r) else [] for r in rows], dtype=object)

    return run(frames)


def band_pass(samples: Column, sr: Column, low: Column, high: Column) -> Column:
    """The samples without what lies outside the band."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series, sr: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for x, rate, lo, hi in zip(samples, sr, low, high):
            z, at = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
            out.append(np.fft.irfft(np.where((at >= lo) & (at <= hi), z, 0), n=len(x)))
        return pd.Series(out, dtype=object)

    return run(samples, sr.cast("double"), low.cast("double"), high.cast("double"))


def spectrogram(chunks: DataFrame, keep: list[str], size: int = 512, hop: int = 256) -> DataFrame:
    """keep, frame, power: a row per frame of each chunk (columns ``samples`` and ``sr``).

    One-sided density: Tukey window, mean removed, no padding.
    """
    w = tukey(size)
    window, sum_squares = constants(w), float((w**2).sum())
    frames = F.transform(framed(F.col("__x"), size, hop), lambda f: F.zip_with(f, window, lambda v, k: (v - total(f) / size) * k))
    rows = chunks.select(*keep, "sr", F.transform("samples", lambda v: v.cast("double")).alias("__x"))
    rows = rows.select(*keep, "sr", F.posexplode(frames).alias("frame", "__f")).select(*keep, "sr", "frame", spectrum(F.col("__f")).alias("__m"))
    single = [0] if size % 2 else [0, size // 2]
    power = F.transform("__m", lambda m, i: m * m / (F.col("sr") * sum_squares) * F.when(i.isin(single), 1.0).otherwise(2.0))
    return rows.select(*keep, "frame", power.alias("power"))


def band_envelope(frames: DataFrame, by: list[str], low_bin: int, high_bin: int) -> DataFrame:
    """by, frame, env: band energy in dB, the largest over what ``by`` leaves out (channels)."""
    db = 10 * F.log10(total(F.slice("power", low_bin + 1, high_bin - low_bin + 1)) + EPS)
    return frames.groupBy(*by, "frame").agg(F.max(db).alias("env"))


def spread_windows(frames: DataFrame, by: list[str], at: Column, length: int, windows: int = 6) -> DataFrame:
    """The frames of each ``by`` that lie in windows of ``length`` frames, spread evenly from first to last.

    ``at`` is a frame's place, from 0. A recording shorter than a window is taken whole.
    """
    last = frames.groupBy(*by).agg(F.max(at).alias("__last"))
    room = F.greatest(F.col("__last") + 1 - length, F.lit(0))
    start = lambda i: F.floor(i * room / max(1, windows - 1))
    inside = F.exists(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: (at >= start(i)) & (at < start(i) + length))
    return frames.join(last, by).where(inside).drop("__last")


def db_range(frames: DataFrame, by: list[str], low: float = 0.01, high: float = 0.999) -> DataFrame:
    """by, lo, hi: exact dB percentiles of all bins of the frames."""
    db = frames.select(*by, F.explode(F.transform("power", lambda p: 10 * F.log10(p + DB_EPS))).alias("db"))
    return quantiles(db, by, "db", {"lo": low, "hi": high})


def frame_features(bins: Column, size: int) -> dict[str, Column]:
    """Features of a frame from the bins (f, m) of its band."""
    m, f = (lambda b: b["m"]), (lambda b: b["f"])
    whole = total(bins, m)
    centroid = total(bins, lambda b: f(b) * m(b)) / whole
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def climb(acc, b):
        up = acc["sum"] + m(b)
        return F.struct(up.alias("sum"), F.coalesce(acc["at"], F.when(up >= 0.85 * whole, f(b))).alias("at"))

    power = lambda b: F.greatest(m(b) * m(b), F.lit(EPS))
    n = F.size(bins)
    return {
        "centroid": centroid,
        "bandwidth": F.sqrt(total(bins, lambda b: m(b) * F.pow(f(b) - centroid, F.lit(2))) / whole),
        "rolloff": F.aggregate(bins, start, climb)["at"],
        "flatness": F.exp(total(bins, lambda b: F.log(power(b))) / n) / (total(bins, power) / n),
        "rms": F.sqrt(2 * total(bins, lambda b: m(b) * m(b))) / size,
        "peak_freq": -F.array_max(F.transform(bins, lambda b: F.struct(m(b).alias("m"), (-f(b)).alias("f"))))["f"],
    }


def crossings(frame: Column, size: Column) -> Column:
    """Share of a frame's samples that differ in sign from the one before."""
    below = F.transform(frame, lambda v: v < -EPS)
    change = F.zip_with(F.slice(below, 2, size - 1), F.slice(below, 1, size - 1), lambda a, b: a != b)
    return F.size(F.filter(change, lambda c: c)) / size


def _field(name: str):
    return lambda v: v[name]


def spectral_features(events: DataFrame, keep: list[str], features: list[str] = FEATURES, size: int = 512, hop: int = 128) -> DataFrame:
    """keep and each feature's mean and deviation over frames, NULL without samples.

    Rows have samples, sr, f_low_hz and f_high_hz; each stays one row, none is shuffled. Frames are
    centred (zeros beyond the ends, Hann window); a band without a bin takes the nearest one.
    """
    rate, low, high = F.col("sr"), F.col("f_low_hz"), F.col("f_high_hz")
    rows = events.select(*keep, "sr", "f_low_hz", "f_high_hz", F.transform("samples", lambda v: v.cast("double")).alias("__x"))
    rows = rows.withColumn("__some", F.coalesce(F.size("__x") > 0, F.lit(False)))
    edge = F.array_repeat(F.lit(0.0), size // 2)
    hann = constants(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size))
    rows = rows.withColumn("__p", F.when(F.col("__some"), F.concat(edge, "__x", edge)).otherwise(F.array().cast("array<double>")))
    rows = rows.withColumn("__f", F.transform(framed(F.col("__p"), size, hop), lambda f: F.zip_with(f, hann, lambda v, w: v * w)))
    rows = rows.withColumn("__s", spectra(F.col("__f"))).drop("__p", "__f")
    near = F.greatest(F.lit(0), F.least(F.lit(size // 2), F.ceil((low + high) / 2 * size / rate - 0.5))).cast("int")

    def band(spectrum):
        every = F.transform(spectrum, lambda m, k: F.struct((k * rate / size).alias("f"), (m + EPS).alias("m")))
        inside = F.filter(every, lambda b: (b["f"] >= low) & (b["f"] <= high))
        return F.when(F.size(inside) > 0, inside).otherwise(F.slice(every, near + 1, 1))

    rows = rows.withColumn("__b", F.transform("__s", band)).drop("__s")
    named = [f for f in features if f != "zcr"]
    rows = rows.withColumn("__v", F.transform("__b", lambda b: F.struct(*(c.alias(n) for n, c in frame_features(b, size).items() if n in named)))) if named else rows
    values = {n: F.transform("__v", _field(n)) for n in named}
    if "zcr" in features:
        rows = rows.withColumn("__y", band_pass(F.when(F.col("__some"), F.col("__x")).otherwise(F.array(F.lit(0.0))), rate, low, high))
        n = F.least(F.lit(size), F.greatest(F.lit(2), F.size("__y")))
        half = F.floor(n / 2).cast("int")
        ends = F.concat(F.array_repeat(F.element_at("__y", 1), half), "__y", F.array_repeat(F.element_at("__y", -1), half))
        rows = rows.withColumns({"__n": n, "__e": ends})
        values["zcr"] = F.transform(framed(F.col("__e"), F.col("__n"), hop), lambda f: crossings(f, F.col("__n")))

    def stats(name):
        mean = F.try_divide(total(values[name]), F.size(values[name]))
        spread = F.sqrt(F.try_divide(total(values[name], lambda v: F.pow(v - mean, F.lit(2))), F.size(values[name])))
        return [F.when(F.col("__some"), c).alias(f"{name}_{s}") for c, s in ((mean, "mean"), (spread, "std"))]

    return rows.select(*keep, *(c for name in features for c in stats(name)))


def attach_audio(events: DataFrame, chunks: DataFrame, chunk_us: int, pad_us: int = 0) -> DataFrame:
    """``events`` with sr and the samples they span, padded by ``pad_us``: chunks meet by number, each cut first.

    An event touches the chunks of its span only. Audio that is missing at an end shortens the slice;
    a missing chunk between others counts as silence, so that what follows keeps its place. Every row
    stays a row, repeated ones too; events without any audio go.
    """
    a, b = F.greatest(F.lit(0), F.col("t0_us") - pad_us), F.col("t1_us") + pad_us
    numbered = events.withColumns({"__row": F.monotonically_increasing_id(), "__a": a, "__b": b})
    touched = numbered.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__a") / chunk_us).cast("int"), F.floor(F.col("__b") / chunk_us).cast("int"))))
    met = touched.join(chunks.select("session", "channel", "chunk", "sr", F.col("samples").alias("__s")), ["session", "channel", "chunk"])
    first = F.round(F.col("__a") * F.col("sr") / 1e6).cast("long")
    begin = F.round(F.col("chunk").cast("long") * chunk_us * F.col("sr") / 1e6).cast("long")
    after = F.round((F.col("chunk").cast("long") + 1) * chunk_us * F.col("sr") / 1e6).cast("long")
    stop = first + F.round((F.col("__b") - F.col("__a")) * F.col("sr") / 1e6).cast("long")
    low, high = F.greatest(first, begin), F.least(stop, after)
    part = F.struct(low.alias("low"), F.slice("__s", (low - begin + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("x"))
    rows = met.withColumn("__part", part).groupBy("__row", *events.columns, "sr").agg(F.array_sort(F.collect_list("__part")).alias("__parts"))
    none = F.array().cast(chunks.schema["samples"].dataType)
    zero = F.lit(0).cast(chunks.schema["samples"].dataType.elementType)
    start = F.struct(F.element_at("__parts", 1)["low"].alias("at"), none.alias("x"))

    def join(acc, p):
        gap = F.greatest(p["low"] - acc["at"], F.lit(0)).cast("int")
        return F.struct((p["low"] + F.size(p["x"])).alias("at"), F.concat(acc["x"], F.array_repeat(zero, gap), p["x"]).alias("x"))

    return rows.select(*events.columns, "sr", F.aggregate("__parts", start, join)["x"].alias("samples"))


def context_window(events: DataFrame, chunks: DataFrame, chunk_us: int, before_us: int, after_us: int, length: int | None = None) -> DataFrame:
    """``events`` with sr and ``samples``: all samples from ``before_us`` before their start to ``after_us`` after their end.

    A window has one length always: what lies outside a recording, and any chunk that is missing, is
    silence. With ``length`` the windows have so many samples, from the same first one. Every row stays,
    repeated ones too, but rows of recordings without any chunk go.
    """
    rate = chunks.groupBy("session", "channel").agg(F.max("sr").alias("sr"))
    rows = events.withColumn("__row", F.monotonically_increasing_id()).join(rate, ["session", "channel"])
    at = lambda us: F.round(us * F.col("sr") / 1e6).cast("long")
    first = at(F.col("t0_us") - before_us)
    size = F.lit(length).cast("long") if length is not None else F.greatest(F.lit(0), F.round((F.col("t1_us") - F.col("t0_us") + before_us + after_us) * F.col("sr") / 1e6)).cast("long")
    rows = cut(rows.withColumns({"__first": first, "__size": size}), "windows")
    begin, end = F.col("__first") * 1e6 / F.col("sr"), (F.col("__first") + F.col("__size")) * 1e6 / F.col("sr")
    touched = rows.select("session", "channel", "__row", "__first", "__size", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(begin / chunk_us)).cast("int"), F.greatest(F.lit(0), F.floor(end / chunk_us)).cast("int"))).alias("chunk"))
    met = touched.join(chunks.select("session", "channel", "chunk", "sr", F.col("samples").alias("__s")), ["session", "channel", "chunk"])
    start = at(F.col("chunk").cast("long") * chunk_us)
    low, high = F.greatest(F.col("__first"), start), F.least(F.col("__first") + F.col("__size"), start + F.size("__s"))
    part = F.struct(low.alias("low"), F.slice("__s", (low - start + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("x"))
    parts = met.where(high > low).groupBy("__row").agg(F.array_sort(F.collect_list(part)).alias("__parts"))  # the chunks of one window
    kind = chunks.schema["samples"].dataType
    zeros = lambda n: F.array_repeat(F.lit(0).cast(kind.elementType), F.greatest(n, F.lit(0)).cast("int"))
    begun = F.struct(F.col("__first").alias("at"), F.array().cast(kind).alias("x"))
    join = lambda acc, p: F.struct((p["low"] + F.size(p["x"])).alias("at"), F.concat(acc["x"], zeros(p["low"] - acc["at"]), p["x"]).alias("x"))
    none = F.array().cast("array<struct<low:bigint,x:%s>>" % kind.simpleString())
    out = rows.join(parts, "__row", "left").withColumn("__all", F.aggregate(F.coalesce("__parts", none), begun, join))
    return out.select(*events.columns, "sr", F.concat("__all.x", zeros(F.col("__first") + F.col("__size") - F.col("__all.at"))).alias("samples"))


#: Samples on either side of an event that are its noise, and least samples of an event.
NOISE_SAMPLES, LEAST_SAMPLES = 2_000, 257


def band_power(rows: DataFrame, event: str = "event", before: str = "before", after: str = "after") -> DataFrame:
    """``rows`` with power and snr of the event's samples within its band (sr, f_low_hz, f_high_hz).

    The event alone is band-passed; the noise is all of ``before`` and ``after``. An event whose band is
    empty or open at an end (0) is taken unfiltered; one of fewer than ``LEAST_SAMPLES`` has neither.
    """
    whole = (F.col("f_low_hz") >= F.col("f_high_hz")) | (F.col("f_low_hz") == 0) | (F.col("f_high_hz") == 0)
    x = F.transform(event, lambda v: v.cast("double"))
    long_enough = F.coalesce(F.size(event) >= LEAST_SAMPLES, F.lit(False))
    some = F.when(long_enough, x).otherwise(F.array(F.lit(0.0)))  # never an empty array
    banded = rows.withColumn("__y", band_pass(some, F.col("sr"), F.coalesce(F.when(whole, 0.0).otherwise(F.col("f_low_hz")), F.lit(0.0)), F.coalesce(F.when(whole, F.col("sr") / 2).otherwise(F.col("f_high_hz")), F.col("sr") / 2)))
    return banded.withColumns({"power": F.when(long_enough, mean_power("__y")), "snr": F.when(long_enough, snr("__y", before, after))}).drop("__y")


def mean_power(samples) -> Column:
    """Mean square of samples, NULL without any."""
    x = F.col(samples) if isinstance(samples, str) else samples
    return F.try_divide(total(x, lambda v: v.cast("double") * v), F.size(x))


def snr(event: str, before: str, after: str) -> Column:
    """Power of an event against that of all samples around it, in dB; 0 without noise."""
    noise = F.coalesce(mean_power(F.concat(F.coalesce(before, F.array().cast("array<double>")), F.coalesce(after, F.array().cast("array<double>")))), F.lit(0.0))
    return F.when(noise > 0, 10 * F.log10(mean_power(event) / noise)).otherwise(0.0)


def ridge_response(column: Column, widths: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Brightness of thin lines in a frame's dB: the largest negative second difference along bins."""
    last = F.size(column) - 1

    def at(v, i):
        return F.greatest(F.lit(0.0), *(v - (F.get(column, F.greatest(i - k, F.lit(0))) + F.get(column, F.least(i + k, last))) / 2 for k in widths))

    return F.transform(column, at)


COMPONENT = ["area_px", "x_px", "y_px", "w_px", "h_px", "n_cols", "sweep_frac", "area_frac", "mean_response"]


def ellipse(width: int, height: int) -> list[tuple[int, int]]:
    """(frame, bin) offsets of an elliptic kernel: in each row of bins the pixels within the ellipse."""
    rx, ry = width // 2, height // 2
    half = lambda y: round(rx * np.sqrt((ry * ry - y * y) / (ry * ry))) if ry else rx
    return [(x, y) for y in range(-ry, ry + 1) for x in range(-int(half(y)), int(half(y)) + 1)]


def close_pixels(pixels: DataFrame, keep: list[str], kernel: list[tuple[int, int]]) -> DataFrame:
    """Morphological closing of a chunk's pixels (keep, frame, bin, __frames, __bins): dilation, then erosion.

    Places outside the image neither grow nor hinder. Pixels are rows, dealt by chunk and place.
    """
    offsets = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in kernel))
    inside = lambda o: (F.col("frame") + o["x"]).between(0, F.col("__frames") - 1) & (F.col("bin") + o["y"]).between(0, F.col("__bins") - 1)
    spread = lambda df: df.select(*keep, "__frames", "__bins", F.explode(F.transform(F.filter(offsets, inside), lambda o: F.struct((F.col("frame") + o["x"]).alias("frame"), (F.col("bin") + o["y"]).alias("bin")))).alias("to")).select(*keep, "__frames", "__bins", "to.*")
    grown = spread(pixels).distinct()
    # a place stays if all places of the kernel around it that lie in the image are grown
    met = spread(grown).groupBy(*keep, "__frames", "__bins", "frame", "bin").agg(F.count(F.lit(1)).alias("__met"))
    return met.where(F.col("__met") == F.size(F.filter(offsets, inside))).drop("__met")


def _labelled(on: DataFrame, keep: list[str]) -> DataFrame:
    """Runs of bright bins within frames with the label of their 8-connected component."""
    line = Window.partitionBy(*keep, "frame").orderBy("bin")
    runs = on.withColumn("__run", F.col("bin") - F.row_number().over(line)).groupBy(*keep, "frame", "__run").agg(
        F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("r").alias("r"), F.max("__pixels").alias("__pixels"), F.max("__bins").alias("__bins"), F.max("__frames").alias("__frames")
    )
    runs = cut(runs.withColumn("id", F.col("frame").cast("long") * (1 << 20) + F.col("lo")), "runs")
    a = runs.select(*keep, (F.col("frame") + 1).alias("frame"), F.col("id").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    touch = (F.col("lo") <= F.col("a_hi") + 1) & (F.col("hi") >= F.col("a_lo") - 1)
    edges = runs.select(*keep, "frame", F.col("id").alias("b"), "lo", "hi").join(a, [*keep, "frame"]).where(touch)
    return runs.join(components(runs, edges, keep), [*keep, "id"])


def _boxes(labelled: DataFrame, keep: list[str]) -> DataFrame:
    return labelled.groupBy(*keep, "label").agg(
        F.sum(F.col("hi") - F.col("lo") + 1).cast("int").alias("area_px"), F.min("frame").alias("x_px"), F.min("lo").alias("y_px"), (F.max("frame") - F.min("frame") + 1).alias("w_px"),
        (F.max("hi") - F.min("lo") + 1).alias("h_px"), F.sum("r").alias("__r"), F.max("__pixels").alias("__pixels"), F.max("__bins").alias("__bins"),
    )


def segment(frames: DataFrame, keep: list[str], percentile: float = 95.0, min_area: int = 30, response=ridge_response, gate: Column | None = None, closing: tuple[int, int] | None = None) -> DataFrame:
    """keep and a row per 8-connected component of a chunk's image (frames by bins) above a percentile.

    Bright bins become runs within frames, runs of neighbouring frames that touch become edges, and
    edges components; every step is rows of chunks, dealt over tasks. ``gate`` (over a component's
    measures) drops components; with ``closing``, the frames and bins of an elliptic kernel, what passes
    is closed, and components are taken, and gated, again.
    """
    db = frames.select(*keep, "frame", F.transform("power", lambda p: 10 * F.log10(p + EPS)).alias("__db"))
    bright = db.select(*keep, "frame", F.posexplode(response(F.col("__db"))).alias("bin", "r"))
    cut_at = bright.groupBy(*keep).agg(F.percentile("r", percentile / 100).alias("__cut"), F.count(F.lit(1)).alias("__pixels"), (F.max("bin") + 1).alias("__bins"), (F.max("frame") + 1).alias("__frames"))  # a chunk's pixels
    labelled = _labelled(bright.join(cut_at, keep).where(F.col("r") >= F.col("__cut")), keep)
    passing = (F.col("area_px") >= min_area) if gate is None else (F.col("area_px") >= min_area) & gate
    if closing is not None:
        stay = _boxes(labelled, keep).where(passing).select(*keep, "label")
        pixels = labelled.join(stay, [*keep, "label"], "left_semi").select(*keep, "frame", F.explode(F.sequence("lo", "hi")).alias("bin"), "__frames", "__bins")
        closed = close_pixels(pixels, keep, ellipse(*closing)).select(*keep, "frame", "bin")
        labelled = _labelled(bright.join(closed, [*keep, "frame", "bin"], "left_semi").join(cut_at.drop("__cut"), keep), keep)
    # the middle of a component in each of its frames
    middle = labelled.select(*keep, "label", "frame", F.explode(F.sequence("lo", "hi")).alias("bin")).groupBy(*keep, "label", "frame").agg(F.percentile("bin", 0.5).alias("mid"))
    sweep = middle.groupBy(*keep, "label").agg((F.max("mid") - F.min("mid")).alias("__sweep"), F.count(F.lit(1)).cast("int").alias("n_cols"))
    whole = _boxes(labelled, keep).where(passing)
    out = whole.join(sweep, [*keep, "label"]).withColumns({"sweep_frac": F.col("__sweep") / F.col("__bins"), "area_frac": F.col("area_px") / F.col("__pixels"), "mean_response": F.col("__r") / F.col("area_px")})
    return out.select(*keep, *COMPONENT)


#: The kernel that closes masks in the detection job.
CLOSING = (7, 3)


def detect(chunks: DataFrame, keep: list[str], gates, percentile: float = 95.0, min_area: int = 30, size: int = 512, hop: int = 256, min_hz: float = 20000.0, closing: tuple[int, int] | None = CLOSING, max_vertical: float = 8.0, max_horizontal: float = 30.0) -> DataFrame:
    """Components with the reason of the gates (``keep`` or why not): the whole detection job.

    ``keep`` identifies a chunk (columns ``samples`` and ``sr``, which is one rate). Components that fail the stage-1
    gates (aspect, or no bin above ``min_hz``) are none, before masks are closed and after; the others
    get the centroid and flatness of their band and span of samples, on which the spectral gates act.
    """
    from chirpline.operators.gates import stage1_ok

    rates = [r.sr for r in chunks.select("sr").distinct().limit(2).collect()]
    if len(rates) > 1:
        raise ValueError("chunks of one rate only: split them by sr")
    bin_of = size // 2 - math.floor(size // 2 - min_hz * size / rates[0]) if rates else 0
    # stage1_ok counts rows from the highest bin, components from the lowest: the top bin must reach that of min_hz
    in_pitch = F.col("y_px") + F.col("h_px") - 1 >= bin_of
    found = segment(spectrogram(chunks, keep, size, hop), keep, percentile, min_area, gate=stage1_ok(min_area, max_vertical, max_horizontal) & in_pitch, closing=closing)
    columns = found.columns
    met = found.join(chunks.select(*(F.col(k).alias(f"__{k}") for k in keep), "samples", "sr"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keep])
    top, bin_hz = F.col("y_px") + F.col("h_px") - 1, F.col("sr") / size
    span = F.slice("samples", F.col("x_px") * hop + 1, (F.col("w_px") - 1) * hop + size)
    met = met.select(*columns, span.alias("samples"), "sr", ((F.col("y_px") - 1) * bin_hz).alias("f_low_hz"), (top * bin_hz).alias("f_high_hz"))
    got = spectral_features(met, columns, ["centroid", "flatness"])
    return got.select(*columns, F.col("centroid_mean").alias("centroid_hz"), F.col("flatness_mean").alias("flatness")).withColumn("reason", gates)


def feature_table(detections: DataFrame, gt: DataFrame, chunks: DataFrame, chunk_us: int) -> DataFrame:
    """Detections with their TP/FP label and the band's spectral features (columns f_low_hz, f_high_hz)."""
    from chirpline.operators.scoring import label_detections

    labelled = label_detections(detections, gt)
    return spectral_features(attach_audio(labelled, chunks, chunk_us), labelled.columns)


def flatness_variants(frames: DataFrame, keep: list[str], magnitude: str = "magnitude", mask: str = "mask") -> DataFrame:
    """keep and flatness of magnitudes, averaged over frames, four ways.

    ``rect``: all bins of the band (``in_band``); ``kept``: the mask's bins only; ``zeroed``: bins
    outside the mask set to the least value, over the band; ``zeroed_full``: the same over all bins.
    """

    def flat(values):
        logs = F.aggregate(F.transform(values, lambda v: F.log(v + EPS)), F.lit(0.0), lambda s, v: s + v) / F.size(values)
        mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v + EPS) / F.size(values)
        return F.when(F.size(values) > 0, F.exp(logs) / mean)

    bins = F.arrays_zip(F.col(magnitude).alias("m"), F.col(mask).alias("k"), F.col("in_band").alias("b"))
    pick = lambda test, value: F.transform(F.filter(bins, test), value)
    inside = lambda x: F.when(x["k"] == 1, x["m"]).otherwise(0.0)
    ways = {
        "rect": pick(lambda x: x["b"] == 1, lambda x: x["m"]),
        "kept": pick(lambda x: x["k"] == 1, lambda x: x["m"]),
        "zeroed": pick(lambda x: x["b"] == 1, inside),
        "zeroed_full": F.transform(bins, inside),
    }
    return frames.select(*keep, *(flat(v).alias(n) for n, v in ways.items())).groupBy(*keep).agg(*(F.avg(n).alias(n) for n in ways))
