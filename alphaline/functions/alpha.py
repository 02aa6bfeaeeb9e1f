"""Alpha-map expressions over arrays of 8-bit values (0-255), all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(value: Column) -> Column:
    """0-1 to 8 bits, half to even."""
    return F.bround(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def truncate8(value: Column) -> Column:
    """0-1 to 8 bits, cut off rather than rounded."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def abs_error(pred: Column, truth: Column) -> Column:
    """Sum of absolute differences of two equally long arrays (8-bit units)."""
    return F.aggregate(F.zip_with(pred, truth, lambda p, g: F.abs(p - g)), F.lit(0).cast("long"), lambda s, x: s + x)


def squared_error(pred: Column, truth: Column) -> Column:
    return F.aggregate(F.zip_with(pred, truth, lambda p, g: (p - g) * (p - g)), F.lit(0).cast("long"), lambda s, x: s + x)


def count_where(alpha: Column, test) -> Column:
    """How many values pass a test."""
    return F.size(F.filter(alpha, test)).cast("long")


def soft(value: Column) -> Column:
    """Strictly between 5 % and 95 % of full opacity (8-bit)."""
    return (value * 100 > 5 * 255) & (value * 100 < 95 * 255)


def binarise(alpha: Column, threshold: int = 128) -> Column:
    return F.transform(alpha, lambda a: F.when(a >= threshold, 255).otherwise(0))


def invert(alpha: Column) -> Column:
    return F.transform(alpha, lambda a: 255 - a)


def long_form(df, alpha: str, side: int, *keep: str):
    """One row per pixel: ``keep``, pos, y, x, a."""
    spread = df.select(*keep, F.posexplode(alpha).alias("pos", "a"))
    return spread.select(*keep, "pos", F.floor(F.col("pos") / side).cast("int").alias("y"), (F.col("pos") % side).alias("x"), "a")


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def share_where(alpha: Column, test) -> Column:
    """The share of values that pass a test."""
    return F.size(F.filter(alpha, test)) / F.size(alpha)


def bokeh_source(alpha: Column) -> Column:
    """Solid pixels (over 90 %) are at least 5 % and exact background at least 15 % of a map."""
    return (share_where(alpha, lambda a: a * 10 > 9 * 255) >= 0.05) & (share_where(alpha, lambda a: a == 0) >= 0.15)


def mixed_opacity(alpha: Column) -> Column:
    """Solid pixels (over 90 %) and soft ones are each at least 8 % of a map."""
    return (share_where(alpha, lambda a: a * 10 > 9 * 255) >= 0.08) & (share_where(alpha, soft) >= 0.08)


def usable_template(elements: Column, width: Column, height: Column) -> Column:
    """At least four elements, sides of 200 and an aspect of at most 2.6."""
    return (elements >= 4) & (F.least(width, height) >= 200) & (F.greatest(width, height) / F.least(width, height) <= 2.6)


def acceptable_render(cover: Column, preview_difference: Column) -> Column:
    """Foreground on 8 to 92 % of the canvas, and a mean difference from the preview of at most 25 (8-bit)."""
    return cover.between(0.08, 0.92) & (preview_difference <= 25)


def bounding_box(alpha: Column, width: int, threshold: int) -> Column:
    """The half-open box of the pixels above a threshold; null without any. No pixel becomes a row."""
    places = F.filter(F.transform(alpha, lambda a, i: F.when(a > threshold, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(places, lambda i: i % width), F.transform(places, lambda i: F.floor(i / width).cast("int"))
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), (F.array_max(xs) + 1).alias("x1"), (F.array_max(ys) + 1).alias("y1"))
    return F.when(F.size(places) > 0, box)


def gaussian_weight(distance: Column, sigma: Column) -> Column:
    return F.exp(-distance * distance / (2 * sigma * sigma))


def compact_fade(distance: Column, radius: Column) -> Column:
    """One at the centre, zero from the radius on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / radius))
