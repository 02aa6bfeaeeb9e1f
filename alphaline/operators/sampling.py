"""Sampling operators: shares, quotas, splits, draws, shards and retention.

Random orders are orders of SHA-256 over ``seed:key``: they depend on nothing but the key, so
they are the same for any partitioning and input order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaline.functions import text as tx


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def uniform(key: Column, seed: int = 42) -> Column:
    """A uniform number in [0, 1) from the first 52 hash bits."""
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement; a top-n, not a full sort."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``(key, split)``: ``max(1, round_half_even(n * share))`` validation rows by hash order."""
    n = rows.count()
    n_val = max(1, round(n * share)) if n else 0
    hashed = rows.select(key, hash_order(F.col(key), seed).alias("__h"))
    return global_rank(hashed, "__h").select(key, F.when(F.col("rank") < n_val, "val").otherwise("train").alias("split"))


def persistent_split(rows: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Validation rows are the saved keys still present; all others train."""
    kept = saved.select(key).distinct().withColumn("__v", F.lit(True))
    return rows.select(key).join(kept, key, "left").select(key, F.when(F.col("__v"), "val").otherwise("train").alias("split"))


def share_weights(rows: DataFrame, category: str, targets: dict[str, float]) -> DataFrame:
    """``(category, n, weight, share)``: per-row weights that give categories their target shares.

    Targets of absent categories are ignored; categories without a target share the rest evenly
    by row. Targets that exceed one together raise.
    """
    if sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares exceed one")
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    aim = F.lit(None).cast("double")
    for name, share in targets.items():
        aim = F.when(F.col(category) == name, share).otherwise(aim)
    every = Window.partitionBy(F.lit(1))
    aimed = counts.withColumn("aim", aim)
    rest = F.lit(1.0) - F.lit(float(sum(targets.values())))
    others = F.sum(F.when(F.col("aim").isNull(), F.col("n")).otherwise(0)).over(every)
    weight = F.when(F.col("aim").isNotNull(), F.col("aim") / F.col("n")).otherwise(rest / others)
    weighed = aimed.withColumn("weight", weight)
    total = F.sum(F.col("weight") * F.col("n")).over(every)
    return weighed.select(category, "n", F.round("weight", 9).alias("weight"), F.round(F.col("weight") * F.col("n") / total, 9).alias("share"))


def quotas(counts: DataFrame, category: str, total: int) -> DataFrame:
    """Largest-remainder quotas of ``total`` by size, capped at the group sizes.

    ``counts`` has one row per category; ties of remainders go to the smaller name. What caps
    leave over goes to the first categories with room, by name.
    """
    every = Window.partitionBy(F.lit(1))
    whole = counts.withColumn("__all", F.sum("n").over(every))
    based = whole.withColumn("base", F.floor(F.col("n") * total / F.col("__all")).cast("long")).withColumn("rest", (F.col("n") * F.lit(total)) % F.col("__all"))
    short = F.lit(total) - F.sum("base").over(every)
    ranked = based.withColumn("short", short).withColumn("rn", F.row_number().over(every.orderBy(F.desc("rest"), category)))
    first = ranked.withColumn("quota", F.least(F.col("base") + (F.col("rn") <= F.col("short")).cast("long"), F.col("n")))
    room = first.withColumn("left", F.least(F.lit(total), F.col("__all")) - F.sum("quota").over(every)).withColumn("room", F.col("n") - F.col("quota"))
    before = F.coalesce(F.sum("room").over(every.orderBy(category).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("room"), F.col("left") - before))
    return room.select(category, "n", (F.col("quota") + extra).cast("long").alias("quota"))


def take_quota(rows: DataFrame, quota: DataFrame, category: str, *order: Column) -> DataFrame:
    """The first ``quota`` rows of each category by ``order``."""
    place = Window.partitionBy(category).orderBy(*order)
    return rows.join(F.broadcast(quota.select(category, "quota")), category).withColumn("rn", F.row_number().over(place)).where("rn <= quota")


def first_n(rows: DataFrame, eligible: Column, n: int, *order: str) -> DataFrame:
    """The first ``n`` eligible rows: filter, then top-n."""
    return rows.where(eligible).orderBy(*order).limit(n)


#: Keys sampled (by hash, in expectation) to cut a table into ranges: at least so many, and so many for each range.
RANGE_SAMPLE = 4000
RANGE_KEYS = 20


def _below(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most a value; looks at about twice the root of their number."""
    step = max(1, math.isqrt(len(bounds)))
    count = lambda some: F.size(F.filter(some, lambda b: b <= value))
    whole = F.greatest(count(F.array(*map(F.lit, bounds[::step]))) - 1, F.lit(0)) * step
    return whole + count(F.slice(F.array(*map(F.lit, bounds)), whole + 1, step))


def range_bounds(rows: DataFrame, key: str) -> list:
    """Keys that cut a table into about equal ranges: as many as shuffle partitions, or as distinct keys in a hash sample where these are fewer."""
    n, width = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = int((1 << 40) * min(1.0, max(RANGE_SAMPLE, RANGE_KEYS * width) / max(n, 1))) + 1
    picked = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < share).select(key).where(F.col(key).isNotNull()).collect()
    known = sorted({r[0] for r in picked})
    width = min(width, len(known))
    return [known[i * len(known) // width] for i in range(1, width)]


def global_rank(rows: DataFrame, key: str) -> DataFrame:
    """``rank`` from 0 by ``key`` over the whole table, without sorting it in one task.

    Range bounds come from a hash sample of the keys, once, so every evaluation deals the same
    rows to the same range; ranges are numbered apart and shifted by the counts before them.
    """
    bounds = range_bounds(rows, key)
    bucket = _below(F.col(key), bounds) if bounds else F.lit(0)
    dealt = rows.withColumn("__p", F.when(F.col(key).isNull(), -1).otherwise(bucket))
    local = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(key)))
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return local.join(F.broadcast(offsets), "__p").withColumn("rank", F.col("__o") + F.col("__r") - 1).drop("__p", "__r", "__o")


def shards(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``(shard_name, pairs, min_key, max_key)``: contiguous shards of sorted keys; the last is short."""
    placed = global_rank(rows.select(key), key).withColumn("shard", F.floor(F.col("rank") / size).cast("int"))
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("pairs"), F.min(key).alias("min_key"), F.max(key).alias("max_key")).select(tx.shard_name(F.col("shard")).alias("shard_name"), "pairs", "min_key", "max_key")


def retain(names: DataFrame, name: str, keep: int) -> DataFrame:
    """``(name, epoch, keep)`` of checkpoint names: the latest ``keep`` by number stay."""
    numbered = names.select(F.col(name).alias("name"), tx.epoch_of(F.col(name)).alias("epoch")).where("epoch IS NOT NULL")
    least = numbered.select("epoch").distinct().orderBy(F.desc("epoch")).limit(keep).agg(F.min("epoch").alias("least"))
    return numbered.join(F.broadcast(least), F.col("epoch") >= F.col("least"), "left").select("name", "epoch", F.col("least").isNotNull().alias("keep"))


def spread_copies(rows: DataFrame, key: str, total: int) -> DataFrame:
    """``(key, n_copies)``: ``total`` copies dealt evenly; the first rows by key get one more."""
    n = rows.count()
    placed = global_rank(rows.select(key), key)
    base, rest = divmod(total, max(n, 1))
    return placed.select(key, (F.lit(base) + (F.col("rank") < rest).cast("int")).alias("n_copies"))


def weighted_draws(spark: SparkSession, weights: DataFrame, category: str, draws: int, seed: int = 42) -> DataFrame:
    """``(category, n_draws)`` of ``draws`` draws with replacement by total category share.

    ``weights(category, share)`` holds one row per category; draws fall between cumulative shares.
    """
    place = Window.partitionBy(F.lit(1)).orderBy(category)
    upto = F.sum("share").over(place)
    bands = weights.select(category, (upto - F.col("share")).alias("low"), upto.alias("high"))
    u = spark.range(draws).select(uniform(F.col("id"), seed).alias("u"))
    hit = u.join(F.broadcast(bands), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return hit.groupBy(category).agg(F.count(F.lit(1)).alias("n_draws"))


def expected_shares(rows: DataFrame, category: str, weight: str) -> DataFrame:
    """Each category's part of the summed weights; without weight, nothing."""
    sums = rows.groupBy(category).agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(Window.partitionBy(F.lit(1)))
    return sums.withColumn("t", total).where("t > 0").select(category, (F.col("w") / F.col("t")).alias("share"))


def sample_in_order(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` random rows, back in the order of their keys."""
    return sample_n(rows, key, n, seed).orderBy(key)


def budget_copies(rows: DataFrame, key: str, each: int, total: int) -> DataFrame:
    """``(key, n_copies)``: up to ``each`` copies of each row by key until ``total`` are dealt."""
    left = F.lit(total) - F.col("rank") * each
    return global_rank(rows.select(key), key).select(key, F.least(F.greatest(left, F.lit(0)), F.lit(each)).cast("int").alias("n_copies")).where("n_copies > 0")
