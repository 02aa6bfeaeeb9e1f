import pytest
from pyspark.sql import functions as F

from alphaline.functions import alpha as al
from alphaline.functions import schedule
from alphaline.functions import text as tx
from alphaline.operators import manifest
from alphaline.streaming import jobs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_merges_that_end_unequal_raise(spark):
    old = frame(spark, [("im", 1), ("gt", 1)], "side string, k int")
    good = frame(spark, [("im", 1), ("im", 2), ("gt", 2), ("gt", 2)], "side string, k int")
    found = {r.side: (r.before, r.growth, r.overwritten, r.after) for r in manifest.merge_audit(old, good, "k", "im", "gt").collect()}
    assert found == {"im": (1, 1, 1, 2), "gt": (1, 1, 0, 2)}
    with pytest.raises(Exception, match="sides differ"):
        manifest.merge_audit(old, good.where("side = 'im'"), "k", "im", "gt").collect()


def test_partial_entries_override_final_ones(spark):
    kind = "name string, pairs int, bytes long"
    wanted = frame(spark, [("a", 3), ("b", 3), ("c", 3), ("d", 3)], "name string, pairs int")
    final = frame(spark, [("a", 3, 10), ("b", 2, 10), ("c", 3, 10)], kind)
    partial = frame(spark, [("b", 3, 20), ("c", 1, 10)], kind)
    files = frame(spark, [("a", 0, 10), ("b", 0, 20), ("c", 0, 10), ("d", 0, 5)], kind)
    assert {r.name: r.state for r in manifest.skippable_shards(wanted, final, partial, files).collect()} == {"a": "skip", "b": "skip", "c": "pack", "d": "pack"}


def test_instances_come_before_a_flat_mask(spark):
    images = frame(spark, [("a",), ("b",), ("c",)], "k string")
    instances = frame(spark, [("a", [1, 5, 0]), ("a", [3, 2, 0])], "k string, m array<int>")
    flats = frame(spark, [("a", [9, 9, 9]), ("b", [7, 7, 7])], "k string, m array<int>")
    assert {r.k: (r.m, r.origin) for r in manifest.instance_or_flat(images, instances, flats, "k", "m").collect()} == {"a": ([3, 5, 0], "instances"), "b": ([7, 7, 7], "flat")}


def test_markers_accumulate(spark):
    a, b = frame(spark, [("x",), ("y",)], "k string"), frame(spark, [("y",), ("z",)], "k string")
    assert sorted(r.k for r in manifest.refresh_marker(a, b, "k").collect()) == ["x", "y", "z"]
    assert sorted(r.k for r in manifest.refresh_marker(None, b, "k").collect()) == ["y", "z"]


def test_a_full_pool_takes_nothing(spark):
    rows = spark.range(10)
    assert manifest.pool_fill(rows, rows, "id", 10).count() == 0
    assert [r.number for r in manifest.pool_fill(rows, rows, "id", 12).orderBy("id").collect()] == [10, 11]


def test_patches_want_a_match_and_change_the_first_only(spark):
    rows = frame(spark, [("x = 1\nx = 2",)], "t string")
    once = tx.patched(F.col("t"), (r"x = \d+", "x = 9"))
    assert rows.select(once).first()[0] == "x = 9\nx = 2"
    assert rows.select(tx.patched(once, (r"x = \d+", "x = 9"))).first()[0] == "x = 9\nx = 2"
    with pytest.raises(Exception, match="nothing to patch"):
        rows.select(tx.patched(F.col("t"), ("y", "z"))).collect()


@pytest.mark.parametrize("bad", ["edge=x", "edge=", "other=1", "edge"])
def test_bad_counts_raise(spark, bad):
    with pytest.raises(Exception, match="bad counts"):
        frame(spark, [(bad,)], "t string").select(tx.parse_counts(F.col("t"), ("edge",))).collect()
    assert frame(spark, [("",)], "t string").select(tx.parse_counts(F.col("t"), ("edge",))).first()[0] == {"edge": 0}


def test_reweight_truth_table(spark):
    cases = [(140, 150, 10, False), (141, 150, 10, True), (150, 150, 10, True), (5, 6, 10, False), (10, 10, 10, False), (2, 11, 10, True), (1, 11, 10, False), (149, 150, 0, False), (151, 150, 10, True)]
    rows = frame(spark, [c[:3] for c in cases], "e int, t int, f int").select(schedule.reweight(F.col("e"), F.col("t"), F.col("f")))
    assert [r[0] for r in rows.collect()] == [c[3] for c in cases]


def test_cut_bounds(spark):
    rows = frame(spark, [(25, 75, 100, 50, 0), (25, 75, 100, 70, 0), (0, 3, 100, 50, 0), (0, 1, 100, 50, 0)], "lo int, hi int, n int, least int, x int")
    lo = rows.select(schedule.cut_bounds(F.col("lo"), F.col("hi"), F.col("n"), F.col("least"), "lo").alias("c")).collect()
    hi = rows.select(schedule.cut_bounds(F.col("lo"), F.col("hi"), F.col("n"), F.col("least"), "hi").alias("c")).collect()
    assert [r.c and tuple(r.c) for r in lo] == [(10, 25), None, (1, 1), None]
    assert [r.c and tuple(r.c) for r in hi] == [(10, 25), None, None, None]


def test_boxes_are_half_open_or_null(spark):
    rows = frame(spark, [([0, 0, 0, 0, 9, 9, 0, 0, 0],), ([0] * 9,)], "a array<int>").select(al.bounding_box(F.col("a"), 3, 5).alias("b"))
    assert [r.b and tuple(r.b) for r in rows.collect()] == [(1, 1, 3, 2), None]


def test_a_stall_needs_patience(spark):
    polls = [("a", k, v) for k, v in enumerate([1, 2, 2, 2, 3, 3, 3, 3])] + [("b", k, k) for k in range(8)]
    found = {r.kind: (r.polls, r.stalled_at) for r in jobs.first_stall(frame(spark, polls, "kind string, at int, n int"), "kind", ["at"], "n", 3).collect()}
    assert found == {"a": (8, 8), "b": (8, None)}


def test_class_names_are_those_of_the_contract(spark):
    rows = frame(spark, [("Umbrella",), ("BASKETBALLHOOP",), ("Desk",), (None,)], "t string").select(tx.thin_or_complex(F.col("t")))
    assert [r[0] for r in rows.collect()] == ["thin", "thin", "complex", "complex"] and len(set(tx.THIN_CLASSES)) == 32
