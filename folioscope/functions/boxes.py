"""Rectangle arithmetic on INT columns x0, y0, x1, y1."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.settings import MAX_VIEW_SIDE

CORNERS = ("x0", "y0", "x1", "y1")
Box = tuple[Column, Column, Column, Column]


def corners(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in CORNERS)


def named(box: Box, prefix: str = "") -> list[Column]:
    return [value.alias(prefix + c) for value, c in zip(box, CORNERS)]


def half_even(value: Column) -> Column:
    return F.rint(value).cast("int")


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")


def y_overlap(a: Box, b: Box) -> Column:
    """Shared height over the smaller height."""
    shared = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return shared / F.greatest(F.lit(1), F.least(a[3] - a[1], b[3] - b[1]))


def x_overlap(a: Box, b: Box) -> Column:
    """Signed shared width in pixels."""
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0])


def clamp_box(box: Box, width: Column, height: Column, min_size: int = 2, rounding=half_even) -> Box:
    """A box inside the page, at least `min_size` wide and high; all corners null where one is (least and greatest skip nulls)."""
    whole = F.lit(True)
    for value in box:
        whole = whole & value.isNotNull()
    x0, y0, x1, y1 = (F.when(whole, rounding(value)) for value in box)
    return tuple(F.when(whole, value) for value in _clamped(x0, y0, x1, y1, width, height, min_size))


def _clamped(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, min_size: int) -> Box:
    x0 = F.greatest(F.lit(0), F.least(width - min_size, x0))
    y0 = F.greatest(F.lit(0), F.least(height - min_size, y0))
    return x0, y0, F.greatest(x0 + min_size, F.least(width, x1)), F.greatest(y0 + min_size, F.least(height, y1))


def _factor(scale: Column) -> Column:
    return F.when(scale > 0, scale.cast("double")).otherwise(F.lit(1.0))


def to_original_box(box: Box, origin: Column, scale: Column) -> Box:
    """View to original coordinates."""
    factor = _factor(scale)
    ox = F.coalesce(F.get(origin, F.lit(0)), F.lit(0)).cast("double")
    oy = F.coalesce(F.get(origin, F.lit(1)), F.lit(0)).cast("double")
    return ox + box[0] / factor, oy + box[1] / factor, ox + box[2] / factor, oy + box[3] / factor


def to_view_box(box: Box, origin_x: Column, origin_y: Column, scale: Column, width: Column, height: Column) -> Box:
    """Original to view coordinates, kept inside the view with at least one pixel."""
    factor = F.when(scale.isNull() | (scale == 0), F.lit(1.0)).otherwise(scale.cast("double"))
    x0, x1 = (half_even((value - origin_x) * factor) for value in (box[0], box[2]))
    y0, y1 = (half_even((value - origin_y) * factor) for value in (box[1], box[3]))
    x0 = F.least(F.greatest(x0, F.lit(0)), F.greatest(F.lit(0), width - 1))
    y0 = F.least(F.greatest(y0, F.lit(0)), F.greatest(F.lit(0), height - 1))
    return x0, y0, F.least(F.greatest(x1, x0 + 1), width), F.least(F.greatest(y1, y0 + 1), height)


def reading_scale(height: Column, width: Column) -> Column:
    longest = F.greatest(height, width, F.lit(1))
    return F.when(longest * 3 <= MAX_VIEW_SIDE, 3).when(longest * 2 <= MAX_VIEW_SIDE, 2).otherwise(1)


def limit_box(box: Box, gutter_start: Column, gutter_end: Column) -> Box:
    """The wider side of a box that crosses the gutter; the box itself when too little is left."""
    x0, y0, x1, y1 = box
    outside = gutter_start.isNull() | (x1 <= gutter_start) | (x0 >= gutter_end)
    on_left = F.greatest(F.lit(0), F.least(x1, gutter_start) - x0)
    on_right = F.greatest(F.lit(0), x1 - F.greatest(x0, gutter_end))
    keep_left = on_left >= on_right
    cut_x0 = F.when(keep_left, x0).otherwise(F.greatest(x0, gutter_end))
    cut_x1 = F.when(keep_left, F.least(x1, gutter_start)).otherwise(x1)
    whole = outside | (cut_x1 - cut_x0 < 24)
    return F.when(whole, x0).otherwise(cut_x0), y0, F.when(whole, x1).otherwise(cut_x1), y1


def vertical_band(box: Box, previous: Box, following: Box) -> tuple[Column, Column]:
    """Top and bottom cut half-way to neighbours that share at least 24 pixels of width."""
    y0, y1 = box[1], box[3]
    middle = (y0 + y1) / 2

    def half_way(other: Box) -> Column:
        return half_even(((other[1] + other[3]) / 2 + middle) / 2)

    top = F.when(x_overlap(box, previous) >= 24, F.greatest(y0, half_way(previous))).otherwise(y0)
    bottom = F.when(x_overlap(box, following) >= 24, F.least(y1, half_way(following))).otherwise(y1)
    thin = bottom - top < 14
    return F.when(thin, y0).otherwise(top), F.when(thin, y1).otherwise(bottom)


def segment_box(boundary: Column, baseline: Column, width: Column, height: Column) -> Column:
    """Padded and clipped box around a polygon, or around the baseline where there is none; null when unusable."""

    def points(raw: Column) -> Column:
        return F.filter(F.coalesce(raw, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)

    polygon = points(boundary)
    from_baseline = F.size(polygon) < 2
    used = F.when(from_baseline, points(baseline)).otherwise(polygon)
    xs = F.transform(used, lambda p: p[0])
    ys = F.transform(used, lambda p: p[1])
    low, high = F.array_min(ys), F.array_max(ys)
    pad = from_baseline | (high - low < 18)
    low, high = F.when(pad, low - 16).otherwise(low), F.when(pad, high + 10).otherwise(high)

    def clip(value: Column, lower: Column, upper: Column) -> Column:
        return F.least(F.greatest(value, lower.cast("double")), upper.cast("double")).cast("int")

    left = clip(F.array_min(xs) - 6, F.lit(0), width - 1)
    right = clip(F.array_max(xs) + 6, left + 1, width)
    top = clip(low, F.lit(0), height - 1)
    bottom = clip(high, top + 1, height)
    usable = (
        (F.size(used) >= 2) & (right - left >= 24) & (bottom - top >= 8) & (bottom - top <= height * F.lit(0.22))
    )
    return F.when(usable, F.struct(left.alias("x0"), top.alias("y0"), right.alias("x1"), bottom.alias("y1")))
