"""Statistics of annotation budgets: bootstrap over sessions, binomial intervals, sizing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpline.functions.metrics import event_metrics


def common_sessions(counts: DataFrame, by: str = "method", session: str = "session") -> DataFrame:
    """Rows of the sessions that every method has."""
    n = counts.select(by).distinct().agg(F.count(F.lit(1)).alias("__all"))
    full = counts.groupBy(session).agg(F.count_distinct(by).alias("__n")).join(F.broadcast(n)).where(F.col("__n") == F.col("__all")).select(session)
    return counts.join(full, session, "left_semi")


def method_pairs(counts: DataFrame, by: str = "method") -> DataFrame:
    """Each pair of methods once."""
    m = counts.select(F.col(by).alias("a")).distinct()
    return m.join(m.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def bootstrap_draws(sessions: DataFrame, sizes: list[int], trials: int, seed: int, key: str = "session") -> DataFrame:
    """size, trial, session, times: sessions drawn with replacement, by hash, the same for all methods.

    A trial is a vector of counts: draws are summed to a multiplicity per session before anything is
    joined to them. The hash (md5 of seed, size, trial and draw) is one that SQL has too.
    """
    numbered = sessions.select(key).distinct().withColumn("__i", F.row_number().over(Window.orderBy(key)) - 1)  # a row per session
    n = numbered.agg(F.count(F.lit(1)).alias("__sessions"))
    grid = sessions.sparkSession.range(trials).select(F.col("id").alias("trial"), F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("size").cast("string"), F.col("trial").cast("string"), F.col("draw").cast("string"))
    at = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % F.col("__sessions")
    draws = grid.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("size")))).join(F.broadcast(n.where("__sessions > 0"))).withColumn("__i", at.cast("int"))  # one row
    return draws.groupBy("size", "trial", "__i").agg(F.count(F.lit(1)).alias("times")).join(numbered, "__i").drop("__i")


def bootstrap(counts: DataFrame, sizes: list[int], trials: int = 200, alpha: float = 0.05, seed: int = 0, by: str = "method") -> DataFrame:
    """method, size: median and percentile interval of recall and precision over the trials."""
    per = bootstrap_trials(counts, sizes, trials, seed, by)
    stats = [F.percentile(m, q).alias(f"{m}_{n}") for m in ("recall", "precision") for n, q in (("lo", alpha / 2), ("med", 0.5), ("hi", 1 - alpha / 2))]
    return per.groupBy(by, "size").agg(*stats)


def bootstrap_trials(counts: DataFrame, sizes: list[int], trials: int, seed: int, by: str = "method") -> DataFrame:
    drawn = bootstrap_draws(counts, sizes, trials, seed)
    total = [F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fn", "pred_tp", "fp")]
    return counts.join(drawn, "session").groupBy(by, "size", "trial").agg(*total).withColumns(event_metrics())


def bootstrap_difference(counts: DataFrame, a: str, b: str, sizes: list[int], trials: int = 200, alpha: float = 0.05, seed: int = 0, by: str = "method") -> DataFrame:
    """size: interval of the paired difference of F1, and whether it excludes zero."""
    per = bootstrap_trials(counts, sizes, trials, seed, by)
    f = per.groupBy("size", "trial").agg(*(F.max(F.when(F.col(by) == m, F.col("f1"))).alias(n) for m, n in ((a, "fa"), (b, "fb"))))
    d = f.withColumn("d", F.col("fa") - F.col("fb")).groupBy("size").agg(F.percentile("d", alpha / 2).alias("lo"), F.percentile("d", 1 - alpha / 2).alias("hi"))
    return d.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument to 8 or more."""
    z = np.asarray(z, float).copy()
    shift = np.zeros_like(z)
    while (small := z < 8).any():
        shift[small] += np.log(z[small])
        z[small] += 1
    r = 1 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _beta_cdf(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    flip = p > (a + 1) / (a + b + 2)
    x, u, v = np.where(flip, 1 - p, p), np.where(flip, b, a), np.where(flip, a, b)
    x = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(u * np.log(x) + v * np.log1p(-x) - (_log_gamma(u) + _log_gamma(v) - _log_gamma(u + v))) / u
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (u + v) * x / (u + 1)) < tiny, tiny, 1 - (u + v) * x / (u + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (v - m) * x / ((u + 2 * m - 1) * (u + 2 * m)), -(u + m) * (u + v + m) * x / ((u + 2 * m) * (u + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
    return np.where(flip, 1 - front * h, front * h)


def _bisect(f, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where an increasing f crosses 0."""
    for _ in range(60):
        mid = (lo + hi) / 2
        up = f(mid) < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def clopper_pearson(x: np.ndarray, n: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    x, n = np.asarray(x, float), np.asarray(n, float)
    zero, one = np.zeros_like(x), np.ones_like(x)
    lo = _bisect(lambda p: _beta_cdf(p, np.maximum(x, 0.5), n - x + 1) - alpha / 2, zero, one)
    hi = _bisect(lambda p: _beta_cdf(p, x + 1, np.maximum(n - x, 0.5)) - (1 - alpha / 2), zero, one)
    return np.where(x <= 0, 0.0, lo), np.where(x >= n, 1.0, hi)


def confidence_sequence(x: np.ndarray, n: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Anytime-valid interval from the regret of the add-one-half forecaster."""
    x, n = np.asarray(x, float), np.asarray(n, float)
    safe = np.maximum(n, 1)
    rate = x / safe

    def xlogy(a, b):
        return np.where(a > 0, a * np.log(np.maximum(b, 1e-300)), 0.0)

    best = xlogy(x, rate) + xlogy(safe - x, 1 - rate)
    forecast = _log_gamma(x + 0.5) + _log_gamma(safe - x + 0.5) - _log_gamma(safe + 1) - np.log(np.pi)
    limit = (np.log(1 / alpha) + best - forecast) / safe

    def kl(p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return xlogy(rate, rate / p) + xlogy(1 - rate, (1 - rate) / (1 - p))

    lo = _bisect(lambda p: limit - kl(p), np.full_like(rate, 1e-12), rate)
    hi = _bisect(lambda p: kl(p) - limit, rate, np.full_like(rate, 1 - 1e-12))
    lo, hi = np.where(x <= 0, 0.0, lo), np.where(x >= n, 1.0, hi)
    return np.where(n <= 0, 0.0, lo), np.where(n <= 0, 1.0, hi)


METHODS = {"clopper_pearson": clopper_pearson, "confidence_sequence": confidence_sequence}


def interval(x: Column, n: Column, alpha: float = 0.05, method: str = "clopper_pearson") -> Column:
    """struct<lo, hi> of a binomial rate."""
    f = METHODS[method]

    @F.pandas_udf("lo double, hi double")
    def run(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        lo, hi = f(x.to_numpy(), n.to_numpy(), alpha)
        return pd.DataFrame({"lo": lo, "hi": hi})

    return run(x.cast("double"), n.cast("double"))


def budget_intervals(totals: DataFrame, budgets: list[int], alpha: float = 0.05, method: str = "clopper_pearson", by: str = "method") -> DataFrame:
    """by, n: interval of recall at n annotated calls, and of precision on the detections that go with them."""
    t = totals.withColumn("n", F.explode(F.array(*map(F.lit, budgets))))
    accepted = F.col("pred_tp") + F.col("fp")
    m = F.greatest(F.lit(1), F.round(F.try_divide(accepted * F.col("n"), F.col("n_gt")))).cast("long")
    t = t.withColumns({"m": m, "recall": F.try_divide("tp", "n_gt"), "precision": F.try_divide("pred_tp", accepted)})
    t = t.withColumns({"__r": interval(F.round(F.col("recall") * F.col("n")), F.col("n"), alpha, method), "__p": interval(F.round(F.col("precision") * F.col("m")), F.col("m"), alpha, method)})
    return t.select(by, "n", "m", "recall", "precision", *(F.col(f"__{k}.{e}").alias(f"{name}_{e}") for k, name in (("r", "recall"), ("p", "precision")) for e in ("lo", "hi")))


def first_stable(intervals: DataFrame, tolerance: float, by: str = "method") -> DataFrame:
    """The least n from which both half-widths are within the tolerance; NULL where none is."""
    ok = F.greatest(F.col("recall_hi") - F.col("recall_lo"), F.col("precision_hi") - F.col("precision_lo")) / 2 <= tolerance
    return intervals.groupBy(by).agg(F.min(F.when(ok, F.col("n"))).alias("n"))


def sizing(variance: Column, half_width: float, alpha: float, comparisons: int = 1, rounds: int = 8) -> Column:
    """Trials that an anytime-valid interval of a half-width needs: a fixed point, by iteration."""
    k = 2 * variance / half_width**2
    step = lambda n, _: k * (F.log(F.lit(comparisons / alpha)) + 0.5 * F.log(F.greatest(n, F.lit(1.0))) + 0.226)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.greatest(k, F.lit(10.0)).cast("double"), step)
