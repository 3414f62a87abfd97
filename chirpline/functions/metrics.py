"""Precision, recall and F1 from counts, in the three flavours in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def f1(p: Column, r: Column) -> Column:
    """NULL where either is undefined or both are 0."""
    return F.when(p + r > 0, 2 * p * r / (p + r))


def event_metrics(tp="tp", fn="fn", pred_tp="pred_tp", fp="fp") -> dict[str, Column]:
    """recall over ground truth, precision over merged events."""
    r, p = ratio(F.col(tp), F.col(tp) + F.col(fn)), ratio(F.col(pred_tp), F.col(pred_tp) + F.col(fp))
    return {"recall": r, "precision": p, "f1": f1(p, r)}


def curve_metrics(tp="tp", fn="fn", pred_tp="pred_tp", fp="fp") -> dict[str, Column]:
    """As on a curve: precision without predictions is 1, F1 undefined where either is 0."""
    r = ratio(F.col(tp), F.col(tp) + F.col(fn))
    p = F.coalesce(ratio(F.col(pred_tp), F.col(pred_tp) + F.col(fp)), F.lit(1.0))
    return {"recall": r, "precision": p, "f1": F.when((p > 0) & (r > 0), 2 * p * r / (p + r))}


def matching_metrics(tp="tp", fp="fp", fn="fn") -> dict[str, Column]:
    """Of one-to-one matches; 0 where undefined."""
    p, r = F.coalesce(ratio(F.col(tp), F.col(tp) + F.col(fp)), F.lit(0.0)), F.coalesce(ratio(F.col(tp), F.col(tp) + F.col(fn)), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(f1(p, r), F.lit(0.0))}
