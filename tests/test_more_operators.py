import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaline.functions import tables
from alphaline.operators import layouts, manifest, morphology, scans
from alphaline.streaming import jobs, monitor


def brute_layout(files, least, best):
    sides = defaultdict(set)
    for side, folder, stem in files:
        sides[side, folder].add(stem)
    found = []
    for (a, i), x in sides.items():
        for (b, g), y in sides.items():
            if a == "im" and b == "gt" and i != g and min(len(x), len(y)) >= least and x & y:
                name = lambda d: d.rsplit("/", 1)[-1].lower()
                found.append((-len(x & y), -(2 * ("image" in name(i)) + 2 * ("gt" in name(g)) + ("train" in i.lower())), i, g))
    found.sort()
    ambiguous = len(found) > 1 and found[0][:2] == found[1][:2]
    return [(k, i, g, -o, -s, ambiguous) for k, (o, s, i, g) in enumerate(found[:best], 1)]


def test_layouts_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    for case, (crowd, proposed, sketch) in enumerate([(100, 50, 64), (2, 3, 4), (0, 5, 8)]):
        monkeypatch.setattr(layouts, "CROWD", crowd)
        monkeypatch.setattr(layouts, "PROPOSED", proposed)
        monkeypatch.setattr(layouts, "SKETCH", sketch)
        files = []
        for k in range(9):
            for side in ("im", "gt"):
                folder = f"r/{rng.choice(['Image', 'x', 'train'])}{k}/{rng.choice(['image', 'gt', 'mask'])}"
                files += [(side, folder, f"{n:04d}") for n in range(6)]  # stems that are everywhere
                files += [(side, folder, f"s{rng.randrange(20 * (1 + k // 3))}") for _ in range(rng.randint(2, 40))]
        if case == 1:
            files += [("im", "a/image", f"q{n}") for n in range(50)] * 2 + [("gt", d, f"q{n}") for d in ("a/gt", "b/gt", "a/image") for n in range(50)]
        frame = spark.createDataFrame([*files, ("im", None, "x"), (None, "d", "x")], "side string, folder string, stem string").repartition(3)
        assert [tuple(r) for r in layouts.discover(frame).orderBy("rank").collect()] == brute_layout(files, 10, 5)
    assert layouts.discover(frame.limit(0)).collect() == []


def test_stems_that_are_everywhere_make_no_pairs(spark):
    """Sixty folders share twenty stems; only the two that share fifty more are candidates."""
    files = [(side, f"d{k}", f"{n:04d}") for side in ("im", "gt") for k in range(60) for n in range(20)]
    files += [("im", "d1", f"own{n}") for n in range(50)] + [("gt", "d2", f"own{n}") for n in range(50)]
    frame = spark.createDataFrame(files, "side string, folder string, stem string")
    assert layouts.candidate_pairs(frame, 70).collect() == [("d1", "d2")]


def test_files_have_sides_and_depths(spark):
    paths = ["a/x.JPG", "a/y.jpeg", "a/b/c/z.png", "a/b/c/d/e/deep.png", "a/n.txt", "top.png"]
    found = layouts.folder_files(spark.createDataFrame([(p,) for p in paths], "path string"), "path", 4)
    assert sorted(map(tuple, found.collect())) == [("gt", "", "top"), ("gt", "a/b/c", "z"), ("im", "a", "x"), ("im", "a", "y")]


@pytest.mark.parametrize("width", range(1, 13))
def test_boxes_equal_brute_force(width):
    rng = np.random.default_rng(width)
    for shape in ((1, 1), (5, 9), (13, 4), (1, 20)):
        for image in (rng.integers(0, 256, shape).astype(np.int32), rng.random(shape)):
            large, small = np.empty_like(image), np.empty_like(image)
            for y in range(shape[0]):
                for x in range(shape[1]):
                    box = image[max(0, y - width // 2) : y - width // 2 + width, max(0, x - width // 2) : x - width // 2 + width]
                    large[y, x], small[y, x] = box.max(), box.min()
            assert (morphology.dilate(image, width) == large).all() and (morphology.erode(image, width) == small).all()
            assert (morphology.background(image, width) == (large == 0)).all()


def test_time_does_not_grow_with_the_box():
    image = np.random.default_rng(1).integers(0, 256, (600, 600)).astype(np.int32)

    def took(width):
        times = []
        for _ in range(5):
            began = time.perf_counter()
            morphology.dilate(image, width)
            times.append(time.perf_counter() - began)
        return min(times)

    assert took(101) < 4 * took(5) + 0.01


def test_plan_of_copies_equals_expansion(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(f"i{k}", "ab"[k % 2], k % 4, ["i4_v00", "i5_o00"] if k in (4, 5) else None) for k in range(12)] + [(None, "a", 3, None), ("n", "b", None, [])], "id string, category string, n_copies int, done array<string>")
    found = spark.sql("SELECT * FROM plan_copies(TABLE(SELECT * FROM {rows}) PARTITION BY category ORDER BY id)", rows=rows).collect()
    expected = manifest.expand_copies(rows.where("id IS NOT NULL").fillna({"n_copies": 0}), "id", F.col("n_copies")).select("copy_id", "kind").collect()
    assert sorted((r.copy_id, r.kind) for r in found) == sorted((r.copy_id, r.kind) for r in expected if r.copy_id not in ("i4_v00", "i5_o00"))
    for category in "ab":
        own = sorted((r.number, r.id) for r in found if r.category == category)
        assert [n for n, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)
    with pytest.raises(Exception, match="no column done"):
        spark.sql("SELECT * FROM plan_copies(TABLE(SELECT 1 AS id, 2 AS n_copies))").collect()


def test_a_costly_test_runs_on_few_rows(spark, tmp_path):
    judged = spark.sparkContext.accumulator(0)

    def judge(rows):
        def run(frames):
            for frame in frames:
                judged.add(len(frame))
                yield frame[frame["id"] % 2 == 0]

        return rows.mapInPandas(run, rows.schema)

    def store(rows):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    rows = spark.range(20_000).select("id")
    found = [r.id for r in scans.accepted_in_order(rows, "id", 30, judge, store).collect()]
    assert judged.value < 10 * 30
    whole = [r.id for r in rows.where("id % 2 = 0").orderBy(scans.uniform(F.col("id"))).limit(30).collect()]
    assert found == whole == [r.id for r in scans.accepted_in_order(rows.repartition(7), "id", 30, judge, store).collect()]
    assert [r.id for r in scans.accepted_in_order(rows.where("id < 9"), "id", 30, judge, store).orderBy("id").collect()] == [0, 2, 4, 6, 8]
    assert scans.accepted_in_order(rows.limit(0), "id", 3, judge, store).collect() == []


def test_monitor_equals_first_stall(spark, tmp_path):
    rng = random.Random(8)
    polls, at = [], 0
    for part in range(3):
        rows = []
        for _ in range(60):
            kind = rng.choice("abc")
            at += 1
            rows.append((kind, at, None if kind == "c" and rng.random() < 0.2 else float(rng.randrange(40) + (at // 4 if kind == "a" else 0))))
        spark.createDataFrame(rows, "k string, at long, n double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        polls += rows
    told = monitor.watch(spark.readStream.schema("k string, at long, n double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", ["at"], "n")
    seen = {}
    running = told.writeStream.foreachBatch(lambda batch, no: seen.update({r.kind: r for r in batch.collect()})).outputMode("update").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    running.awaitTermination()
    batch = jobs.first_stall(spark.createDataFrame(polls, "k string, at long, n double").fillna({"n": -1.0}), "k", ["at"], "n")
    assert {k: (r.polls, r.stalled_at) for k, r in seen.items()} == {r.k: (r.polls, r.stalled_at) for r in batch.collect()}
    assert Counter(k for k, *_ in polls) == {k: r.polls for k, r in seen.items()}
    assert all((r.status == "stalled") == (r.stalled_at is not None) for r in seen.values())
