"""Expressions over time intervals and boxes.

Times are microseconds as BIGINT. Undefined values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: F.col(x) if isinstance(x, str) else x


def overlaps(a0, a1, b0, b1) -> Column:
    """Strict overlap of two intervals of positive length: touching ones and points don't match."""
    a0, a1, b0, b1 = map(_c, (a0, a1, b0, b1))
    return (a0 < b1) & (a1 > b0) & (a1 > a0) & (b1 > b0)


def iou_1d(a0, a1, b0, b1) -> Column:
    """Shared length over joint length; 0 where either is empty."""
    a0, a1, b0, b1 = map(_c, (a0, a1, b0, b1))
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def box_intersection(a: tuple, b: tuple) -> Column:
    """Area shared by two boxes given as (x1, y1, x2, y2)."""
    a, b = [_c(x) for x in a], [_c(x) for x in b]
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def box_area(a: tuple) -> Column:
    a = [_c(x) for x in a]
    return (a[2] - a[0]) * (a[3] - a[1])


def box_iou(a: tuple, b: tuple) -> Column:
    inter = box_intersection(a, b)
    return F.try_divide(inter, box_area(a) + box_area(b) - inter)


def box_containment(a: tuple, b: tuple) -> Column:
    """Share of box a that lies in box b."""
    return F.try_divide(box_intersection(a, b), box_area(a))


def bbox_to_time(x, w, start, stop, width) -> tuple[Column, Column]:
    """Pixel columns of a box in a window's image to the window's times."""
    x, w, start, stop, width = map(_c, (x, w, start, stop, width))
    span = stop - start
    return start + x / width * span, start + (x + w) / width * span


def bbox_to_band(y, h, height, nyquist, clip: bool = True) -> tuple[Column, Column]:
    """Pixel rows of a box (row 0 is the Nyquist frequency) to a frequency band, low end first."""
    y, h, height, nyquist = map(_c, (y, h, height, nyquist))
    high, low = ((height - 1 - v) / (height - 1) * nyquist for v in (y, y + h))
    if clip:
        high, low = F.least(nyquist, high), F.greatest(F.lit(0.0), low)
    return F.least(low, high), F.greatest(low, high)


def component_features(box: tuple, area, height, width, nyquist, start, stop) -> dict[str, Column]:
    """Shape, band and length of a component from its box (x, y, w, h) and area in pixels."""
    x, y, w, h = map(_c, box)
    area, height, width, nyquist, start, stop = map(_c, (area, height, width, nyquist, start, stop))
    low, high = bbox_to_band(y, h, height, nyquist)
    t0, t1 = bbox_to_time(x, w, start, stop, width)
    return {
        "aspect": h / F.greatest(w, F.lit(1)),
        "solidity": area / F.greatest(w * h, F.lit(1)),
        "area_frac": area / (height * width),
        "f_low": low,
        "f_high": high,
        "f_band": high - low,
        "duration": t1 - t0,
    }


def axis_lookup(axis, index) -> Column:
    """The axis value at an index, clamped to the axis."""
    axis, index = _c(axis), _c(index)
    return F.element_at(axis, F.greatest(F.lit(0), F.least(index.cast("int"), F.size(axis) - 1)) + 1)


def xyxy_to_xywh(b: tuple) -> tuple:
    b = [_c(x) for x in b]
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def xywh_to_xyxy(b: tuple) -> tuple:
    b = [_c(x) for x in b]
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def xywh_to_center(b: tuple, width, height) -> tuple:
    """Box to its centre and size, as shares of the image."""
    b, width, height = [_c(x) for x in b], _c(width), _c(height)
    return (b[0] + b[2] / 2) / width, (b[1] + b[3] / 2) / height, b[2] / width, b[3] / height


def crop_box(b: tuple, height, width, pad: float) -> tuple:
    """Box (x, y, w, h) with a margin of ``pad`` of its size, clipped to whole pixels."""
    x, y, w, h = [_c(v) for v in b]
    height, width = _c(height), _c(width)
    whole = lambda v: v.cast("int")
    return (
        whole(F.greatest(F.lit(0), F.floor(x - pad * w))),
        whole(F.greatest(F.lit(0), F.floor(y - pad * h))),
        whole(F.least(width, F.ceil(x + w + pad * w))),
        whole(F.least(height, F.ceil(y + h + pad * h))),
    )


def time_to_x(t, start, stop, width) -> Column:
    """A time's column in a window's image, clamped to the image."""
    t, start, stop, width = map(_c, (t, start, stop, width))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(t - start, stop - start))) * width


# polygons: flat arrays [x0, y0, x1, y1, ...]


def polygon_axis(p, axis: int) -> Column:
    return F.filter(_c(p), lambda v, i: i % 2 == axis)


def polygon_bbox(p) -> tuple:
    """x, y, w, h of a polygon."""
    xs, ys = polygon_axis(p, 0), polygon_axis(p, 1)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)


def polygon_area(p) -> Column:
    """Shoelace area."""
    xs, ys = polygon_axis(p, 0), polygon_axis(p, 1)
    turn = lambda a: F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.abs(total(F.zip_with(xs, turn(ys), lambda a, b: a * b)) - total(F.zip_with(ys, turn(xs), lambda a, b: a * b))) / 2


def polygon_scale(p, sx, sy, dx=0.0, dy=0.0) -> Column:
    """Scaled, then shifted."""
    sx, sy, dx, dy = (F.lit(v) if not isinstance(v, Column) else v for v in (sx, sy, dx, dy))
    return F.transform(_c(p), lambda v, i: F.when(i % 2 == 0, v * sx + dx).otherwise(v * sy + dy))


# keys, vectors, units


def session_key(experiment, idx) -> Column:
    return F.format_string("experiment_%d/idx_%03d", _c(experiment).cast("int"), _c(idx).cast("int"))


def session_of_path(path) -> Column:
    """The session in a path: a folder session=..., experiment_<e>/idx_<i>, else the file's folder."""
    named = F.regexp_replace(F.regexp_extract(_c(path), r"/session=([^/]+)/", 1), "%(25)?2F", "/")
    nested = F.regexp_extract(_c(path), r"(experiment_\d+/idx_\d+)", 1)
    return F.when(named != "", named).when(nested != "", nested).otherwise(F.regexp_extract(_c(path), r"([^/]+)/[^/]+$", 1))


def natural_key(text, width: int = 12) -> Column:
    """Sort key in which embedded numbers order by value, whatever their length: it goes before the digits."""
    parts = F.regexp_extract_all(_c(text), F.lit(r"(\d+|\D+)"), 1)
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), width, "0"), digits(x))).otherwise(x)), "")


def parse_vector(text) -> Column:
    """'[ 1.2 -3.4\\n 5.6]' to an array of doubles."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"[\[\],]", " "), r"\s+", " "))
    return F.transform(F.split(inner, " "), lambda x: x.try_cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def to_khz(hz) -> Column:
    return _c(hz) / 1000


def to_ms(us) -> Column:
    return _c(us) / 1000


def power_to_db_byte(power, lo: float, hi: float) -> Column:
    """Power frames to dB, clipped to [lo, hi] and cut down to whole numbers 0-255."""
    return F.transform(_c(power), lambda p: F.floor((F.greatest(F.lit(lo), F.least(F.lit(hi), 10 * F.log10(p + 1e-12))) - lo) / (hi - lo) * 255).cast("int"))


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("bigint")
