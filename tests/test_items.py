import bisect
import io
import json
import math
import os
import re
import tarfile
import zipfile
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from alphaline.operators import draws, sampling
from alphaline.sources import archives, pairs, tarsink


def uniform(seed, x):
    return int(sha256(f"{seed}:{x}".encode()).hexdigest()[:13], 16) / 2**52


def brute_draws(rows, shares, n, seed=42):
    items = defaultdict(list)
    for key, category in rows:
        if key is not None and category is not None:
            items[category].append(key)
    order = {c: sorted(keys, key=lambda k: sha256(f"{seed}:{k}".encode()).hexdigest()) for c, keys in items.items()}
    names = [c for c in sorted(shares) if c in order and round(shares[c] * 1e9) > 0]
    total, out = sum(round(shares[c] * 1e9) for c in names), []
    for draw in range(n):
        pick, low = math.floor(uniform(seed + 1, draw) * total), 0
        for c in names:
            if pick < low + round(shares[c] * 1e9):
                break
            low += round(shares[c] * 1e9)
        out.append((draw, c, order[c][math.floor(uniform(seed + 2, draw) * len(order[c]))]))
    return out


def test_item_draws_equal_brute_force(spark, monkeypatch):
    rows = [(k, "big" if k % 3 else "small" if k % 2 else "odd") for k in range(900)] + [(None, "big"), (5000, None), (77, "big"), (77, "big")]
    shares = {"big": 0.2, "small": 0.5, "odd": 0.3 - 1e-6, "none": 1e-6, "absent": 0.4}
    frame, given = spark.createDataFrame(rows, "k long, c string").repartition(7), spark.createDataFrame(list(shares.items()), "c string, share double")
    expected = brute_draws(rows, shares, 3000)
    for part in (100_000, 50):
        monkeypatch.setattr(draws, "PART_ROWS", part)
        found = sorted(tuple(r) for r in draws.item_draws(frame, "k", "c", given, 3000).collect())
        assert found == expected
    counts = Counter(c for _, c, _ in expected)
    assert abs(counts["small"] / 3000 - 0.5) < 0.05 and set(counts) == {"big", "small", "odd"}


def test_no_task_numbers_a_whole_category(spark, monkeypatch):
    monkeypatch.setattr(draws, "PART_ROWS", 200)
    rows = spark.range(20_000).select("id", F.lit("one").alias("c"))
    numbered = draws.numbered_within(rows, "id", "c")
    assert sorted(r.at for r in numbered.select("at").collect()) == list(range(20_000))
    assert re.search(r"windowspecdefinition\(c#\d+, __part#\d+, __h", numbered._jdf.queryExecution().toString())
    sizes = rows.groupBy(F.substring(sampling.hash_order(F.col("id")), 1, 2)).count().collect()
    assert len(sizes) == 256 and max(r["count"] for r in sizes) < 200


def test_no_draws_without_items(spark):
    empty, given = spark.createDataFrame([], "k long, c string"), spark.createDataFrame([("a", 1.0)], "c string, share double")
    assert draws.item_draws(empty, "k", "c", given, 10).collect() == []


def test_ranks_at_wide_shuffles(spark):
    """More partitions than a fixed sample had keys: as many ranges, and none holds much more than its part."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(150_000).select((F.col("id") * 7919 % 1_000_003).alias("k"))
    keys = sorted(r.k for r in rows.collect())
    try:
        for width, most in ((5000, 3.5), (8, 1.2)):
            spark.conf.set("spark.sql.shuffle.partitions", str(width))
            bounds = sampling.range_bounds(rows, "k")
            sizes = Counter(bisect.bisect_right(bounds, k) for k in keys)
            assert len(sizes) == width and max(sizes.values()) < most * len(keys) / width
        assert sampling.range_bounds(rows.limit(3), "k") and sampling.range_bounds(rows.limit(0), "k") == []
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        ranked = sampling.global_rank(rows, "k")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        found = ranked.toPandas().sort_values("k")
        assert found["rank"].tolist() == list(range(150_000)) and found["k"].tolist() == keys
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- ordered pairs


def write_pairs(spark, path, first, n, **more):
    rows = spark.range(first, first + n).select(F.encode(F.concat(F.lit("im"), "id"), "UTF-8").alias("image"), F.struct(F.encode(F.concat(F.lit("gt"), "id"), "UTF-8").alias("bytes")).alias("mask"), *[v.alias(k) for k, v in more.items()])
    rows.coalesce(1).write.mode("append").parquet(str(path))


def test_pairs_are_numbered_through_files(spark, tmp_path):
    for k in range(5):
        write_pairs(spark, tmp_path / "one" / f"f{k}", 10 * k, 10)
    write_pairs(spark, tmp_path / "two", 50, 3)
    found = pairs.ordered_pairs(spark, "s", [f"{tmp_path}/one/*", f"{tmp_path}/two"], expected=58).collect()
    assert sorted((r.number, r.stem, r.image.decode(), r.truth.decode()) for r in found) == [(k, f"s_{k:06d}", f"im{k}", f"gt{k}") for k in range(53)]


def test_a_short_source_raises_before_it_is_read(spark, tmp_path):
    write_pairs(spark, tmp_path / "a", 0, 8)
    with pytest.raises(ValueError, match="8 pairs of 9"):
        pairs.ordered_pairs(spark, "s", [f"{tmp_path}/a"], expected=9)
    with pytest.raises(ValueError, match="no column alpha"):
        pairs.ordered_pairs(spark, "s", [f"{tmp_path}/a"], truth="alpha")
    assert pairs.ordered_pairs(spark, "s", [f"{tmp_path}/a"], expected=8).count() == 8


def test_named_pairs_collide_and_fall_back(spark, tmp_path):
    write_pairs(spark, tmp_path / "a", 0, 4, image_name=F.concat(F.lit("dir/na me "), (F.col("id") / 2).cast("int"), F.lit(".x.jpg")))
    write_pairs(spark, tmp_path / "b", 4, 2)
    files = [f"{tmp_path}/a", f"{tmp_path}/b"]
    found = pairs.ordered_pairs(spark, "s", files, expected=4).collect()
    assert sorted((r.number, r.stem, r.image.decode()) for r in found) == [(0, "s_na_me_0.x", "im0"), (2, "s_na_me_1.x", "im2"), (4, "s_000004", "im4"), (5, "s_000005", "im5")]
    with pytest.raises(ValueError, match="4 pairs of 6"):
        pairs.ordered_pairs(spark, "s", files, expected=6)


def test_numbers_need_no_sort_of_rows(spark, tmp_path):
    write_pairs(spark, tmp_path / "a", 0, 4)
    plan = pairs.ordered_pairs(spark, "s", [f"{tmp_path}/a"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert all("image" not in line for line in plan.split("\n") if "Sort [" in line or "Exchange" in line)


# --- archives


def tar_bytes(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    return out.getvalue()


def zip_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members:
            archive.writestr(name, content)
    return out.getvalue()


MEMBERS = [(f"g{k % 2}/{side}/{k:03d}.png", bytes([k, side == "im"]) * 3000) for k in range(60) for side in ("im", "gt")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.tar").write_bytes(tar_bytes(MEMBERS))
    (tmp_path / "b.zip").write_bytes(zip_bytes([(f"z/{n}", c) for n, c in MEMBERS]))
    (tmp_path / "c.tar.gz").write_bytes(tar_bytes(MEMBERS[:5], "w:gz"))
    (tmp_path / "broken.zip").write_bytes(b"PK no archive" * 9)
    (tmp_path / "short.tar").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("no archive")
    return f"file://{tmp_path}"


def test_one_archive_is_read_by_many_tasks(spark, folder):
    whole = archives.archive_members(spark, f"{folder}/a.tar")
    cut = archives.archive_members(spark, f"{folder}/a.tar", split_bytes=40_000)
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() > 5
    rows = lambda frame: sorted((r.member, r.folder, r.name, r.stem, bytes(r.content)) for r in frame.collect())
    assert rows(cut) == rows(whole) == sorted((n, n.rpartition("/")[0], n.rpartition("/")[2], n[-7:-4], c) for n, c in MEMBERS)
    zipped = archives.archive_members(spark, f"{folder}/b.zip", split_bytes=200)
    assert zipped.rdd.getNumPartitions() > 5 and len(rows(zipped)) == len(MEMBERS)
    with tarfile.open(f"{folder[7:]}/a.tar") as opened:
        assert [i.name for i in opened] == [m for m, _, _ in archives.index(f"{folder}/a.tar", "tar")]


def test_a_folder_of_archives_with_a_broken_one(spark, folder):
    found = archives.archive_members(spark, folder).collect()
    counts = Counter(os.path.basename(r.archive) for r in found)
    assert counts == {"a.tar": 120, "b.zip": 120, "c.tar.gz": 5, "broken.zip": 1, "short.tar": 1}
    assert sorted(r.error.split(":")[0] for r in found if r.error) == ["BadZipFile", "ReadError"]
    with pytest.raises(Exception, match="BadZipFile|ReadError"):
        archives.archive_members(spark, folder, onError="raise").collect()


def test_a_pattern_reaches_the_planning(spark, folder):
    source = archives.archive_members(spark, f"{folder}/a.tar", split_bytes=40_000)
    some = archives.archive_members(spark, f"{folder}/a.tar", pattern="^g0/im/(?!000)", split_bytes=40_000)
    assert sorted(r.member for r in some.collect()) == sorted(n for n, _ in MEMBERS if n.startswith("g0/im/") and "000" not in n)
    assert 0 < some.rdd.getNumPartitions() < source.rdd.getNumPartitions() / 2
    assert archives.archive_members(spark, f"{folder}/a.tar", pattern="nowhere", split_bytes=40_000).collect() == []
    assert source.where("member = 'g1/gt/001.png'").count() == 1 and source.count() == len(MEMBERS)


def test_pairs_are_made_inside_a_folder(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(tar_bytes([("g1/im/x.png", b"1"), ("g1/gt/x.png", b"2"), ("g2/im/x.jpg", b"3"), ("g1/im/._x.png", b"0"), ("g1/im/y.png", b"4")]))
    (tmp_path / "b.tar").write_bytes(tar_bytes([("g2/gt/x.png", b"5"), ("g2/gt/x.webp", b"6"), ("g2/an/x.png", b"7"), ("g3/gt/y.png", b"8")]))
    found = archives.folder_pairs(archives.archive_members(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.stem, bytes(r.image), bytes(r.truth)) for r in found) == [("g1_x", b"1", b"2"), ("g2_x", b"3", b"6")]


# --- shards with a commit


def members_of(spark, n, shards=3, fail=False):
    content = F.when((F.col("id") == n - 1) & F.lit(fail), F.raise_error(F.lit("lost"))).otherwise(F.encode(F.repeat(F.lit("c"), F.col("id").cast("int") + 1), "UTF-8"))
    rows = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % shards, F.lit(".tar")).alias("shard"), F.explode(F.array(F.lit("im/"), F.lit("gt/"))).alias("side"), "id")
    return rows.select("shard", F.concat("side", "id").alias("member"), content.cast("binary").alias("content"))


def files(folder):
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    folder = f"{tmp_path}/out"
    with pytest.raises(Exception, match="lost"):
        tarsink.write_shards(members_of(spark, 30, fail=True), f"file://{folder}", 30)
    assert files(folder) == [] and tarsink.read_manifest_file(f"file://{folder}") == {}
    tarsink.write_shards(members_of(spark, 30), f"file://{folder}", 30)
    assert files(folder) == ["_manifest.json", "s0.tar", "s1.tar", "s2.tar"]
    told = json.load(open(f"{folder}/_manifest.json"))
    assert told["total_pairs"] == 30 and all(e["bytes"] == os.path.getsize(f"{folder}/{e['name']}") and e["files"] == 20 for e in told["shards"])
    with tarfile.open(f"{folder}/s1.tar") as archive:
        assert [i.name for i in archive] == sorted(f"{side}/{k}" for side in ("im", "gt") for k in range(1, 30, 3))
    with pytest.raises(Exception, match="lost"):
        tarsink.write_shards(members_of(spark, 60, fail=True), f"file://{folder}", 60)
    assert json.load(open(f"{folder}/_manifest.json")) == told and len(files(folder)) == 4


def test_totals_have_to_agree(spark, tmp_path):
    with pytest.raises(Exception, match="not whole"):
        tarsink.write_shards(members_of(spark, 12), f"file://{tmp_path}/out", 13)
    assert files(f"{tmp_path}/out") == []
    odd = members_of(spark, 6).where("member <> 'gt/3'")
    with pytest.raises(Exception, match="pairs have two"):
        tarsink.write_shards(odd, f"file://{tmp_path}/out")
    assert files(f"{tmp_path}/out") == []


def test_whole_shards_are_not_written_again(spark, tmp_path):
    folder = f"{tmp_path}/out"
    tarsink.write_shards(members_of(spark, 30), f"file://{folder}", 30)
    before = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in files(folder)}
    with open(f"{folder}/s2.tar", "ab") as file:
        file.write(b"x")
    tarsink.write_shards(members_of(spark, 30), f"file://{folder}", 30)
    after = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in files(folder)}
    assert [f for f in before if before[f] != after[f]] == ["_manifest.json", "s2.tar"]
    assert os.path.getsize(f"{folder}/s2.tar") == {e["name"]: e["bytes"] for e in tarsink.read_manifest_file(f"file://{folder}")["shards"]}["s2.tar"]
