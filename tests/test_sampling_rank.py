import bisect

from pyspark.sql import functions as F

from alphaline.operators import sampling


def test_bounds_below_a_value(spark):
    for n in (1, 2, 3, 10, 50):
        bounds = [3 * k for k in range(n)]
        rows = spark.range(-2, 3 * n + 3).select("id", sampling._below(F.col("id"), bounds).alias("b")).collect()
        assert all(r.b == bisect.bisect_right(bounds, r.id) for r in rows)


def test_ranks_are_a_numbering(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 1000).alias("k"))
    found = sampling.global_rank(rows, "k").collect()
    assert [r.k for r in sorted(found, key=lambda r: r["rank"])] == sorted(r.k for r in found)
    assert sorted(r["rank"] for r in found) == list(range(500))


def test_shards_from_the_hundredth_on_keep_their_numbers(spark):
    found = sampling.shards(spark.range(205).withColumnRenamed("id", "k"), "k", 2).collect()
    assert {r.shard_name: (r.pairs, r.min_key) for r in found} == {f"TRAIN_shard_{s:02d}.tar": (min(2, 205 - 2 * s), 2 * s) for s in range(103)}
