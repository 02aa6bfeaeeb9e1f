import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from alphaline.functions import text as tx
from alphaline.operators import manifest, metrics, sampling
from alphaline.plans import benchmark
from alphaline.sources import manifests


def write(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
    return str(path)


ROW = {"id": "a1", "image": "hair/é.png", "category": "hair", "gt_alpha": "g.png"}


def test_strict_manifest(spark, tmp_path):
    good = manifests.read_manifest(spark, write(tmp_path / "m.jsonl", [ROW, ROW | {"id": "b2", "gt_alpha": None}]))
    assert {r.id: r.image for r in good.collect()} == {"a1": "hair/é.png", "b2": "hair/é.png"}
    for k, bad in enumerate(([ROW | {"category": "no"}], [ROW, ROW], [{"id": "x", "category": "hair"}])):
        with pytest.raises(Exception, match="invalid manifest row"):
            manifests.read_manifest(spark, write(tmp_path / f"bad{k}.jsonl", bad)).collect()


def test_lenient_scan_keeps_the_last(spark, tmp_path):
    path = write(tmp_path / "l.jsonl", [ROW, ROW | {"category": "thin"}])
    assert manifests.read_categories(spark, path).collect() == [("a1", "thin")]


def test_missing_output_has_no_ids(spark, tmp_path):
    assert manifests.read_ids(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_append_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ü.png", "hair", None)], manifests.SCHEMA)
    manifests.append_manifest(rows, str(tmp_path / "out"))
    assert manifests.read_manifest(spark, str(tmp_path / "out")).collect() == rows.collect()


def test_archives_and_listing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("train/im/1.jpg", b"x")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "a.zip", "inner/a.zip")
    assert [(r.member, bytes(r.content)) for r in manifests.read_archives(spark, str(tmp_path / "a.zip"), "zip").collect()] == [("train/im/1.jpg", b"x")]
    assert [r.member for r in manifests.read_archives(spark, str(tmp_path / "a.tar"), "tar").collect()] == ["inner/a.zip"]
    (tmp_path / "f").mkdir()
    for name in ("b.x.JPG", "._b.jpg", "c.txt"):
        (tmp_path / "f" / name).write_bytes(b"1")
    assert [r.stem for r in manifests.list_files(spark, str(tmp_path / "f")).collect()] == ["b.x"]


def test_shards_are_verified(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") % 2).alias("shard"), "id")
    manifests.write_shards(rows, str(tmp_path / "s"))
    wanted = spark.createDataFrame([(0, 5), (1, 6)], "shard int, pairs long")
    assert manifests.verify_shards(spark, str(tmp_path / "s"), wanted).collect() == [(1, 6, 5)]


def test_resume_equals_a_full_run(spark):
    rows = spark.range(20).withColumnRenamed("id", "k")
    rest = manifest.not_yet_done(rows, rows.where("k < 7"), "k")
    assert sorted(r.k for r in rest.union(rows.where("k < 7")).collect()) == list(range(20))


def test_reconcile_states(spark):
    ids = [spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "b", "c"], ["a", "b"], ["a"])]
    assert dict(manifest.reconcile(*ids, "k").collect()) == {"a": "skip", "b": "add_row", "c": "pending"}


def test_pairs_by_stem(spark):
    images = spark.createDataFrame([("i/foo.jpg",), ("i/bar.v.jpg",)], "path string")
    truths = spark.createDataFrame([("g/foo_matte.png",), ("g/none.png",)], "path string")
    assert [r.stem for r in manifest.pair_by_stem(images, truths, "_matte").collect()] == ["foo"]


def test_no_copies_is_no_copies(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 2)], "id string, n int")
    assert sorted(r.copy_id for r in manifest.expand_copies(rows, "id", F.col("n")).collect()) == ["a_o00", "b_o00", "b_v00", "b_v01"]


def test_layout_ties_and_self(spark):
    files = spark.createDataFrame([("im", "1"), ("im", "1"), ("gt", "1"), ("x", "2")], "d string, s string")
    assert manifest.layout_overlaps(files, "d", "s").collect() == [("gt", "im", 1)]


def test_class_token(spark):
    stems = ["11_Furniture_7_Desk_x", "q_17_Non-motor_Vehicle_1_BabyCarriage_9", "none", "1_a_2"]
    rows = spark.createDataFrame([(s,) for s in stems], "s string").select(tx.class_token(F.col("s")))
    assert [r[0] for r in rows.collect()] == ["Desk", "BabyCarriage", None, None]


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.sanitise(F.lit("a#b c(d).jpg-stem")),
        tx.sanitise(F.lit("x## ##y")),
        tx.html_escape(F.lit("<a & \"b\">")),
        tx.parse_counts(F.lit("edge=3, mixed=4"), ("edge", "mixed", "bokeh")),
        tx.strip_key_prefix(F.create_map(F.lit("_orig_mod.w"), F.lit(1), F.lit("b"), F.lit(2))),
        tx.variant_of(F.lit("m+refine")),
    ).first()
    assert tuple(row) == ("a_b_c_d_.jpg-stem", "x_y", "&lt;a &amp; &quot;b&quot;&gt;", {"edge": 3, "mixed": 4, "bokeh": 0}, {"w": 1, "b": 2}, "refine")


def test_retention_is_numeric(spark):
    names = spark.createDataFrame([(f"epoch_{n}.pth",) for n in (3, 10, 1)] + [("garbage.txt",), ("epoch_x.pth",)], "name string")
    assert {r.name: r.keep for r in sampling.retain(names, "name", 1).collect()} == {"epoch_3.pth": False, "epoch_10.pth": True, "epoch_1.pth": False}


def test_shard_sizes(spark):
    stems = spark.range(52_882).select(F.format_string("%06d", "id").alias("k"))
    found = sampling.shards(stems, "k", 7000).orderBy("shard_name").collect()
    assert [r.pairs for r in found] == [7000] * 7 + [3882]
    assert found[0].shard_name == "TRAIN_shard_00.tar" and found[-1].max_key == "052881"


def test_target_shares(spark):
    counts = {"transparent": 50, "camouflage": 80, "hair": 900, "general": 300}
    rows = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "category string")
    found = {r.category: r.share for r in sampling.share_weights(rows, "category", {"transparent": 0.2, "camouflage": 0.1, "absent": 0.05}).collect()}
    assert found["transparent"] / found["camouflage"] == pytest.approx(2, abs=1e-7)
    assert sum(found.values()) == pytest.approx(1, abs=1e-7)
    with pytest.raises(ValueError):
        sampling.share_weights(rows, "category", {"hair": 1.1})


def test_quota_is_capped_and_spread(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 10), ("c", 10)], "category string, n long")
    assert {r.category: r.quota for r in sampling.quotas(counts, "category", 15).collect()} == {"a": 1, "b": 7, "c": 7}
    assert sum(r.quota for r in sampling.quotas(counts, "category", 99).collect()) == 21


def test_split_depends_on_keys_only(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a = sorted(sampling.split(rows, "k", 0.02).collect())
    b = sorted(sampling.split(rows.repartition(7), "k", 0.02).collect())
    assert a == b and sum(s == "val" for _, s in a) == 10
    assert sampling.split(rows.where("k < 0"), "k", 0.1).count() == 0


def test_benchmark_overall_is_over_images(spark):
    pairs = spark.createDataFrame([("m", "a", [255], [0]), ("m", "b", [0], [0]), ("m", "b", [0], [0]), ("m", "b", [0], None)], "model string, category string, pred array<int>, gt array<int>")
    found = benchmark.run(pairs)
    assert {r.category: r.mae for r in found.collect()} == {"a": 1.0, "b": 0.0, None: 0.333333}
    assert "| m |" in benchmark.markdown(found)


def test_rerun_replaces_its_model_only(spark):
    old = spark.createDataFrame([("x", 1), ("y", 2)], "model string, v int")
    new = spark.createDataFrame([("x", 5)], "model string, v int")
    assert sorted((r.model, r.v) for r in manifest.merge_by_model(old, new).collect()) == [("x", 5), ("y", 2)]


def test_deltas(spark):
    rows = spark.createDataFrame([("c", "base", 0.0), ("c", "m", 0.1), ("d", "m", 0.2)], "category string, model string, v double")
    found = {(r.category, r.model): (r.delta_pct, r.verdict) for r in metrics.deltas(rows, "base", "category", "model", "v").collect()}
    assert found == {("c", "base"): (None, "same"), ("c", "m"): (None, "worse"), ("d", "m"): (None, "n/a")}


def test_source_over_is_ordered(spark):
    layers = F.array(F.struct(F.lit(2).alias("z"), F.lit(0.0).alias("value"), F.lit(0.5).alias("alpha")), F.struct(F.lit(1).alias("z"), F.lit(1.0).alias("value"), F.lit(1.0).alias("alpha")))
    assert spark.range(1).select(metrics.over_fold(layers)).first()[0] == 0.5
