"""Scalar expressions of the training schedule and crop geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_rate(base: Column, batch: Column, accumulate: Column, override: Column | None = None) -> Column:
    """The base learning rate scaled with the root of the effective batch over four."""
    scaled = base * F.sqrt(batch * accumulate / 4)
    return scaled if override is None else F.coalesce(override, scaled)


def decay(epoch: Column, factor: float = 0.9) -> Column:
    """Decay by absolute epoch."""
    return F.pow(F.lit(factor), epoch)


def reweight(epoch: Column, total: Column, last: Column) -> Column:
    """Whether an epoch lies in the final ``last`` epochs of a run; never in runs that are not longer."""
    return F.when((last == 0) | (total <= last), False).otherwise(epoch > total - last)


def cut_bounds(low: Column, high: Column, length: Column, least: Column, side: str) -> Column:
    """``(begin, end)``, the pixels that a cut may take from the subject's box ``[low, high)`` on one axis.

    A cut takes 20-60 % of the box, leaves ``least`` pixels of the image and some of the box; null
    where no cut does. ``side`` is the end of the axis that goes: "lo" or "hi".
    """
    box = high - low
    kept = length - least - low if side == "lo" else high - least
    begin = F.greatest(F.lit(1), F.ceil(0.2 * box)).cast("int")
    end = F.least(F.floor(0.6 * box).cast("int"), kept, box - 1).cast("int")
    return F.when(end >= begin, F.struct(begin.alias("begin"), end.alias("end")))


def copies_for(target: Column, sources: Column, average: Column) -> Column:
    """Copies of each source so that all come near a target; at least one."""
    return F.greatest(F.lit(1), F.bround(target / (sources * average))).cast("long")


def epoch_length(asked: Column, available: Column) -> Column:
    """The samples of an epoch: what was asked, else all; not positive raises."""
    n = F.coalesce(asked, available)
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("an epoch needs samples")))
