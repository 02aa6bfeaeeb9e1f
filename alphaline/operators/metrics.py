"""Metric operators: alpha benchmark, aggregation, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaline.functions import alpha as al


def score(pairs: DataFrame, *keep: str, pred: str = "pred", truth: str = "gt") -> DataFrame:
    """Absolute and squared error sums (8-bit units) and pixel counts of prediction and truth."""
    guard = F.assert_true(F.size(pred) == F.size(truth), F.lit("prediction and truth differ in size"))
    return pairs.where(guard.isNull()).select(*keep, F.size(pred).alias("pixels"), al.abs_error(F.col(pred), F.col(truth)).alias("sad_i"), al.squared_error(F.col(pred), F.col(truth)).alias("sq_i"))


def benchmark(scored: DataFrame, model: str, category: str) -> DataFrame:
    """Sums and the mean absolute error by (model, category) and overall by model.

    Overall is the mean over images, not over categories; its category is null.
    """
    cells = scored.select(model, category, "sad_i", "sq_i", "pixels").cube(model, category)
    sums = cells.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("sad_i").alias("sad_i"), F.sum("sq_i").alias("sq_i"), F.sum("pixels").alias("pixels"))
    return sums.where("g IN (0, 1)").select(model, category, "n", "sad_i", "sq_i", F.round(F.col("sad_i") / (F.col("pixels") * 255), 6).alias("mae"))


def nan_mean(value: Column) -> Column:
    """The mean without NaN; null if nothing is left."""
    return F.avg(F.when(~F.isnan(value), value))


def leaders(results: DataFrame, category: str, value: str) -> DataFrame:
    """The rows with the least value of each category; ties stay."""
    place = Window.partitionBy(category).orderBy(value)
    return results.withColumn("rk", F.rank().over(place)).where("rk = 1").drop("rk")


def deltas(results: DataFrame, baseline: str, category: str, model: str, value: str) -> DataFrame:
    """Each model's value beside the baseline's; less is better; a zero baseline has no delta."""
    base = results.where(F.col(model) == baseline).select(category, F.col(value).alias("base"))
    joined = results.join(base, category, "left")
    delta = F.try_divide(100 * (F.col(value) - F.col("base")), F.col("base"))
    verdict = F.when(F.col("base").isNull(), "n/a").when(F.col(value) < F.col("base"), "better").when(F.col(value) > F.col("base"), "worse").otherwise("same")
    return joined.select(category, model, F.col(value).alias("value"), "base", F.round(delta, 4).alias("delta_pct"), verdict.alias("verdict"))


def union_alpha(layers: DataFrame, *position: str, value: str) -> DataFrame:
    """``1 - product(1 - a)`` of the layers at each position."""
    return layers.groupBy(*position).agg((1 - F.product(1 - F.col(value))).alias("union_a"))


def union_log(layers: DataFrame, *position: str, value: str) -> DataFrame:
    """The logarithm of ``product(1 - a)``, which no number of layers rounds to zero."""
    return layers.groupBy(*position).agg(F.sum(F.ln(1 - F.col(value))).alias("log_clear"))


def screen_fold(layers: Column) -> Column:
    """``1 - product(1 - a)`` of an array of values."""
    return 1 - F.aggregate(layers, F.lit(1.0), lambda clear, a: clear * (1 - a))


def over_fold(layers: Column) -> Column:
    """Source-over of an ordered array of ``(z, value, alpha)`` structs, lowest z first."""
    return F.aggregate(F.array_sort(layers), F.lit(0.0), lambda below, top: top["alpha"] * top["value"] + (1 - top["alpha"]) * below)


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean of batch means, each weighted with its size."""
    return F.sum(value * weight) / F.sum(weight)


def subset_mean(scored: DataFrame, subset: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the mean over the subset's rows that have a score; null if none has."""
    return scored.join(subset.select(key).distinct(), key, "left_semi").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
