import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaline import __main__ as command
from alphaline.sources import export, images, manifests


def test_png_round_trip_through_the_image_source(spark, tmp_path):
    rng = np.random.default_rng(0)
    grey, colour, four = (rng.integers(0, 256, (5, 7, *c)).astype(np.uint8) for c in ((), (3,), (4,)))
    for name, image in (("a", grey), ("b", colour), ("c", four)):
        (tmp_path / f"{name}.png").write_bytes(export.encode_png(image))
    found = {r.path[-5]: r for r in images.read_alphas(spark, str(tmp_path)).collect()}
    assert (found["a"].height, found["a"].width) == (5, 7)
    assert found["a"].a8 == grey.ravel().tolist() and found["c"].a8 == four[..., 3].ravel().tolist()
    row = spark.read.format("image").load(str(tmp_path / "b.png")).select("image.*").first()
    assert (images.channels(row.height, row.width, row.nChannels, row.data) * 255).round().astype(int).tolist() == colour.tolist()


def test_pairs_are_scaled_together_and_keep_plain_modes():
    image, alpha = export.downscale_pair(np.ones((40, 20, 3)), np.ones((40, 20)), 10)
    assert image.shape == (10, 5, 3) and alpha.shape == (10, 5)
    assert export.downscale_pair(image, alpha, 10)[1] is alpha
    assert export.plain_modes(np.zeros((2, 2, 4))).shape == (2, 2, 3) and export.plain_modes(np.zeros((2, 2, 2))).shape == (2, 2)


def test_exports_do_not_write_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1] * 12, [9] * 4, 2), (2, [1] * 12, None, 2), (3, [1] * 12, [0] * 4, 2)], "id long, rgb array<int>, a array<int>, w int")
    pairs = export.encoded_pairs(rows, "id", "rgb", "a", "w")
    for _ in range(2):
        export.export_split(pairs, "id", str(tmp_path), "TRAIN")
    found = spark.read.parquet(str(tmp_path)).collect()
    assert sorted((r.id, r.split) for r in found) == [(1, "TRAIN"), (3, "TRAIN")] and bytes(found[0].im)[:4] == b"\x89PNG"


def test_tars_stream_and_tell_broken_ones(spark, tmp_path):
    members = spark.createDataFrame([("t0.tar", f"im/{k}", bytes([k]) * 3000) for k in range(4)] + [("t1.tar", "gt/é", b"")], "shard string, member string, content binary")
    folder = f"file://{tmp_path}/tars"
    entries = {r.name: r.pairs for r in manifests.write_tars(members, folder).collect()}
    assert entries == {"t0.tar": 2, "t1.tar": 0}
    assert tarfile.open(tmp_path / "tars/t0.tar").getnames() == [f"im/{k}" for k in range(4)]
    (tmp_path / "tars/bad.tar").write_bytes(b"no tar at all" * 100)
    found = manifests.read_archives(spark, folder, "tar", "^(im|gt)/").collect()
    assert sorted(r.member for r in found if r.content is not None) == ["gt/é", "im/0", "im/1", "im/2", "im/3"]
    broken = manifests.read_archives(spark, f"{folder}/bad.tar", "tar").collect()
    assert len(broken) == 1 and broken[0].content is None and "ReadError" in broken[0].member


def test_fonts_are_told_by_their_first_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ttf").write_bytes(bytes.fromhex("00010000") + b"x")
    (tmp_path / "b.ttf").write_bytes(b"<html>")
    assert [(r.path[-5:], r.few) for r in manifests.font_files(spark, str(tmp_path)).collect()] == [("a.ttf", True)]
    (tmp_path / "in/a.ttf").write_bytes(b"")
    with pytest.raises(ValueError, match="no fonts"):
        manifests.font_files(spark, str(tmp_path))


def test_listing_takes_globs_and_missing_folders(spark, tmp_path):
    for name in ("a_1.jpg", "b_1.jpg", "a.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert [r.stem for r in manifests.list_files(spark, str(tmp_path), pattern="a*").collect()] == ["a_1"]
    assert manifests.list_files(spark, str(tmp_path / "none")).count() == 0


def test_work_is_repeated_after_passing_errors():
    calls = []

    def work(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x

    assert export.retried(work, wait=0)(5) == 5 and calls == [5, 5, 5]
    with pytest.raises(KeyError):
        export.retried(lambda: {}["x"], wait=0)()


def test_strict_manifest_wants_all_four_keys_and_twelve_categories(spark, tmp_path):
    assert set(manifests.CATEGORIES) == {"hair", "transparent", "thin", "product", "complex", "illustration", "general", "camouflage", "text", "fx", "design", "design_real"}
    rows = [f'{{"id": "{c}", "image": "i", "category": "{c}", "gt_alpha": null}}' for c in manifests.CATEGORIES]
    (tmp_path / "m.jsonl").write_text("\n\n  \n".join(rows))
    assert manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 12
    for k, bad in enumerate(('{"id": "a", "image": "i", "category": "hair"}', "[1]", "{broken", '{"id": "a", "image": "i", "category": "hair", "gt_alpha": "g"} x')):
        (tmp_path / f"bad{k}.jsonl").write_text(bad)
        with pytest.raises(Exception, match="invalid manifest row"):
            manifests.read_manifest(spark, str(tmp_path / f"bad{k}.jsonl")).collect()


def test_commands(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("a", "hair", [0, 255], [0, 255]), ("b", "hair", [0, 100], [0, 255]), ("c", "thin", [9, 9], None)], "id string, category string, alpha array<int>, gt array<int>")
    rows.write.parquet(str(tmp_path / "images"))
    for names in ("raw,binary", "binary"):
        assert command.main(["benchmark", "--models", names, "--images", str(tmp_path / "images"), "--out", str(tmp_path / "results")]) == 0
    assert command.main(["compare", "--results", str(tmp_path / "results")]) == 0
    printed = capsys.readouterr().out
    assert "| hair |" in printed and "binary" in printed and "raw" in printed
    found = export.read_results(spark, str(tmp_path / "results"))
    assert {(r.model, r.category, r.n) for r in found.collect()} == {(m, c, 2) for m in ("raw", "binary") for c in ("hair", None)}
    rows.select("id", "category", F.lit("x.png").alias("image")).write.parquet(str(tmp_path / "rows"))
    command.main(["gallery", "--rows", str(tmp_path / "rows"), "--out", str(tmp_path / "gallery")])
    assert spark.read.parquet(str(tmp_path / "gallery")).count() == 2


def test_an_empty_member_is_a_member(tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as archive:
        archive.addfile(tarfile.TarInfo("e"), io.BytesIO(b""))
    with open(tmp_path / "x.tar", "rb") as stream:
        assert [(name, read()) for name, read in manifests._tar_members(stream)] == [("e", b"")]


def test_command_tells_of_failures(spark, tmp_path, capsys):
    rows = [(k, "hair", [k * 10 + j for j in range(9)], [0] * 9) for k in range(4)] + [(9, "thin", [1, 2, 3], [0, 0, 0])]
    spark.createDataFrame(rows, "id long, category string, alpha array<int>, gt array<int>").write.parquet(str(tmp_path / "images"))
    arguments = ["benchmark", "--models", "raw+smooth", "--images", str(tmp_path / "images"), "--out", str(tmp_path / "results")]
    assert command.main([*arguments, "--width", "9"]) == 1
    assert "raw+smooth: 1 images failed (ValueError: 3 pixels are no rows of 9)" in capsys.readouterr().err
    categories = lambda: {r.category for r in spark.read.parquet(str(tmp_path / "results")).collect() if r.category}
    assert categories() == {"hair"}
    assert command.main(arguments) == 0 and categories() == {"hair", "thin"}
    assert "failed" not in capsys.readouterr().err
