"""Draws of items with replacement: an epoch of a fixed number of samples.

A draw picks a category by its share and then an item of the category, all alike. Both picks are
equi-joins: categories are cut along ``CELLS`` equal cells of the unit interval, so that a draw
meets the few bands of its own cell, and items are numbered inside their category. The numbers
follow the items' hash; a category is numbered in parts of about ``PART_ROWS`` rows by the first
digits of that hash, so no task holds a category, however large. The hash order makes the same
draws for any partitioning and input order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaline.operators.sampling import hash_order, uniform

CELLS = 1024
#: Rows that one task numbers, about.
PART_ROWS = 100_000
#: Shares are whole parts of this.
UNIT = 1_000_000_000


def numbered_within(rows: DataFrame, key: str, category: str, seed: int = 42) -> DataFrame:
    """``rows`` with ``at``: their number, from 0, inside their category in hash order of the key.

    Rows without a key or category are left out. Rows that repeat a key have numbers of their own.
    """
    digits, n = 0, rows.count()
    while n > PART_ROWS * 16**digits:
        digits += 1
    hashed = rows.where(F.col(key).isNotNull() & F.col(category).isNotNull()).withColumn("__h", hash_order(F.col(key), seed))
    dealt = hashed.withColumn("__part", F.substring("__h", 1, digits))
    sizes = dealt.groupBy(category, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(category).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(category, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(category, "__part").orderBy("__h", key)) - 1
    return dealt.withColumn("__local", local).join(offsets, [category, "__part"]).withColumn("at", F.col("__before") + F.col("__local")).drop("__h", "__part", "__local", "__before")


def bands(shares: DataFrame, category: str, share: str) -> DataFrame:
    """``(category, low, high, total)``: each category's stretch of whole parts, one after the other by name.

    One row a category; categories whose share rounds to nothing have no stretch.
    """
    parts = shares.where(F.col(category).isNotNull()).select(category, F.round(F.col(share) * UNIT).cast("long").alias("__parts")).where("__parts > 0")
    every = Window.partitionBy(F.lit(1))
    upto = F.sum("__parts").over(every.orderBy(category).rowsBetween(Window.unboundedPreceding, 0))
    return parts.select(category, (upto - F.col("__parts")).alias("low"), upto.alias("high"), F.sum("__parts").over(every).alias("total"))


def category_draws(spark: SparkSession, stretches: DataFrame, category: str, draws: int, seed: int = 42) -> DataFrame:
    """``(draw, category)`` of ``draws`` draws over ``bands``."""
    total = stretches.agg(F.max("total")).first()[0]
    if total is None:
        return spark.createDataFrame([], "draw long").join(stretches.select(category), F.lit(False))
    cell = lambda at: F.floor(at * CELLS / total)
    spread = stretches.select(category, "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    picks = spark.range(draws).select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), seed) * total).alias("pick")).withColumn("cell", cell(F.col("pick")))
    return picks.join(spread, "cell").where("pick >= low AND pick < high").select("draw", category)


def item_draws(rows: DataFrame, key: str, category: str, shares: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """``(draw, category, key)``: exactly ``draws`` items, by category share and evenly inside a category.

    ``shares(category, share)`` has a row for each category; those without an item take no part.
    """
    spark = rows.sparkSession
    numbered = numbered_within(rows.select(key, category), key, category, seed)
    sizes = rows.where(F.col(key).isNotNull() & F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    stretches = bands(shares.join(sizes.select(category), category, "left_semi"), category, "share")
    drawn = category_draws(spark, stretches, category, draws, seed + 1).join(sizes, category)
    placed = drawn.select("draw", category, F.floor(uniform(F.col("draw"), seed + 2) * F.col("__n")).alias("at"))
    return placed.join(numbered, [category, "at"]).select("draw", category, key)
