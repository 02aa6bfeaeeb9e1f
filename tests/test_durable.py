import os

import pytest
from pyspark.sql import functions as F

from alphaline.sources import durable
from alphaline.streaming import upserts


def rows(spark, *triples):
    return spark.createDataFrame(list(triples), "side string, k long, v long")


def both(spark, keys, v=0, sides=("im", "gt", "manifest")):
    return rows(spark, *[(s, k, v) for s in sides for k in keys])


def held(spark, base):
    return sorted((r.side, r.k, r.v) for r in durable.read(spark, base).collect())


def data_folders(base):
    return len(os.listdir(f"{base[7:]}/data"))


def test_a_refused_merge_keeps_the_version(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    durable.merge(spark, base, both(spark, range(5)), "k", "replace", {"im": 5, "gt": 5, "manifest": 5})
    before = held(spark, base)
    cases = [
        ("replace", both(spark, range(4)), {"expected": {"im": 5}}, "im: 4 of 5"),
        ("replace", both(spark, range(4)), {}, "needs the expected"),
        ("add", both(spark, range(4, 7)), {}, "im: 1 overwritten"),
        ("add", rows(spark, ("im", 9, 0), ("gt", 9, 0)), {}, "growth differs: im 1, gt 1, manifest 0"),
        ("sides", rows(spark, ("im", 9, 0)), {}, "im 6 and gt 5 differ"),
        ("overwrite", both(spark, [1, 8]), {"allowed": both(spark, [1, 2])}, "3 keys outside"),
    ]
    for rule, new, more, why in cases:
        with pytest.raises(durable.Refused, match=why):
            durable.merge(spark, base, new, "k", rule, **more)
        assert held(spark, base) == before and data_folders(base) == 1 and durable.pointers(spark, base) == [1]
    with pytest.raises(ValueError, match="no rule"):
        durable.merge(spark, base, both(spark, [1]), "k", "other")


def test_accepted_merges_and_the_way_back(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    assert durable.read(spark, base) is None
    with pytest.raises(durable.Refused, match="nothing to go back"):
        durable.rollback(spark, base)
    durable.merge(spark, base, both(spark, range(3)), "k", "add")
    sides = durable.merge(spark, base, both(spark, [2, 3], 7, ("im", "gt")), "k", "sides")
    assert sides["im"] == {"before": 3, "after": 4, "added": 1, "overwritten": 1, "expected": 1, "lost": 0} and sides["manifest"]["after"] == 3
    assert ("im", 2, 7) in held(spark, base) and ("manifest", 2, 0) in held(spark, base)
    durable.merge(spark, base, both(spark, [0], 9, ("im", "gt")), "k", "overwrite", allowed=both(spark, [0]))
    assert ("gt", 0, 9) in held(spark, base)
    durable.rollback(spark, base)
    assert ("gt", 0, 0) in held(spark, base) and ("gt", 3, 7) in held(spark, base) and durable.pointers(spark, base) == [1, 2, 3, 4]
    durable.rollback(spark, base)
    assert held(spark, base) == sorted((s, k, 0) for s in ("im", "gt", "manifest") for k in range(3))
    with pytest.raises(durable.Refused, match="nothing to go back"):
        durable.rollback(spark, base)


def test_two_writers_do_not_both_publish(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    durable.merge(spark, base, both(spark, range(3)), "k", "add")
    durable.publish(spark, base, 1, {"path": durable.state(spark, base)["path"]})
    with pytest.raises(durable.Refused, match="another writer"):
        durable.publish(spark, base, 1, {"path": "x"})
    assert durable.pointers(spark, base) == [1, 2] and not [f for f in os.listdir(f"{base[7:]}/pointers") if f.startswith(".") and not f.endswith(".crc")]


def test_a_small_batch_writes_few_buckets(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    frame = lambda ids, v: spark.createDataFrame([(k, v, f"x{v}") for k in ids], "k long, v int, s string")
    assert upserts.upsert(spark, base, frame(range(2000), 1), 0, "k", "v", buckets=32)
    first = durable.state(spark, base)
    assert upserts.upsert(spark, base, frame([5, 1999, 5000], 2), 1, "k", "v", buckets=8)
    second = durable.state(spark, base)
    moved = [b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)]
    assert len(first["buckets"]) == 32 and 1 <= len(moved) <= 3 and second["count"] == 32
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path[7:]) for f in fs)
    assert size(second["buckets"][moved[0]].rsplit("/", 1)[0]) < size(first["buckets"][moved[0]].rsplit("/", 1)[0]) / 5
    expected = {k: 1 for k in range(2000)} | {5: 2, 1999: 2, 5000: 2}
    assert {r.k: r.v for r in upserts.read_table(spark, base).collect()} == expected
    for replay in (0, 1):
        assert not upserts.upsert(spark, base, frame(range(10), 9), replay, "k", "v")
    assert durable.state(spark, base) == second and data_folders(base) == 2
    assert upserts.upsert(spark, base, frame([5], 0).union(frame([6, 6], 1)).unionByName(spark.createDataFrame([(None, 3, "n")], "k long, v int, s string")), 2, "k", "v")
    assert {r.k: r.v for r in upserts.read_table(spark, base).collect()} == expected
    upserts.vacuum(spark, base)
    assert {r.k: r.v for r in upserts.read_table(spark, base).collect()} == expected


def test_stream_of_files_equals_one_run(spark, tmp_path):
    for part in range(4):
        spark.range(50).select((F.col("id") % 20).alias("k"), (F.col("id") + 100 * ((part * 7) % 4)).cast("int").alias("v")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    base = f"file://{tmp_path}/t"
    for _ in range(2):
        upserts.upsert_stream(spark, f"{tmp_path}/in", "k long, v int", "k", "v", base, f"{tmp_path}/mark", buckets=4, files=1)
    newest = spark.read.parquet(f"{tmp_path}/in").groupBy("k").agg(F.max("v").alias("v"))
    assert sorted(map(tuple, upserts.read_table(spark, base).select("k", "v").collect())) == sorted(map(tuple, newest.collect()))
    assert durable.state(spark, base)["batch"] == 3
