"""Which folders of images and truths belong together: exact overlaps without all pairs.

Two folders fit if they share stems. Pairs are ranked by the number of shared stems and then by a
bonus of their names. Stems such as ``0001`` may be in every folder, so pairs are not made from
whole stem lists:

1. Bottom-k sketches (the ``SKETCH`` smallest stem hashes of a folder) propose a few pairs, whose
   exact overlaps give a floor: the best pairs share at least so many stems.
2. Two folders that share ``floor`` stems share one among the rarest ``size - floor + 1`` of each, in
   one order of rarity for all. Only pairs that meet there are candidates, so stems that are
   everywhere are joined by no folder that has enough others.
3. The candidates' overlaps are counted exactly.

The floor only saves work: whatever the sketches propose, the best pairs are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaline.functions import text as tx

SKETCH = 64
#: Pairs that sketches propose; folders with a sketch hash in common with more than ``CROWD`` others are not proposed by it.
PROPOSED = 50
CROWD = 100


def folder_files(files: DataFrame, path: str, depth: int | None = None) -> DataFrame:
    """``(side, folder, stem)`` of image files (jpg, jpeg: side ``im``) and truths (png: side ``gt``), at most ``depth`` folders deep."""
    at = F.col(path)
    end = F.lower(F.regexp_extract(at, r"\.([^./]+)$", 1))
    side = F.when(end.isin("jpg", "jpeg"), "im").when(end == "png", "gt")
    named = files.select(side.alias("side"), F.regexp_extract(at, "^(.*)/[^/]*$", 1).alias("folder"), tx.stem(at).alias("stem")).where("side IS NOT NULL")
    return named if depth is None else named.where(F.size(F.split("folder", "/")) <= depth)


def overlaps(stems: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(img_dir, gt_dir, overlap)``: stems that the pairs' folders share."""
    images = stems.where("side = 'im'").select(F.col("folder").alias("img_dir"), "stem")
    truths = stems.where("side = 'gt'").select(F.col("folder").alias("gt_dir"), "stem")
    return pairs.join(images, "img_dir").join(truths, ["gt_dir", "stem"]).groupBy("img_dir", "gt_dir").agg(F.count(F.lit(1)).alias("overlap"))


def proposed_pairs(stems: DataFrame) -> DataFrame:
    """The ``PROPOSED`` pairs whose sketches share most."""
    smallest = Window.partitionBy("side", "folder").orderBy("h", "stem")
    sketch = stems.select("side", "folder", "stem", F.xxhash64("stem").alias("h")).withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= SKETCH)
    few = sketch.groupBy("stem").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") <= CROWD)
    chosen = sketch.join(few.select("stem"), "stem", "left_semi")
    images, truths = (chosen.where(F.col("side") == side).select(F.col("folder").alias(name), "stem") for side, name in (("im", "img_dir"), ("gt", "gt_dir")))
    met = images.join(truths, "stem").where("img_dir <> gt_dir").groupBy("img_dir", "gt_dir").agg(F.count(F.lit(1)).alias("n"))
    return met.orderBy(F.desc("n"), "img_dir", "gt_dir").limit(PROPOSED).select("img_dir", "gt_dir")


def candidate_pairs(stems: DataFrame, floor: int) -> DataFrame:
    """All pairs that can share ``floor`` stems or more."""
    rarity = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("held"))
    sizes = stems.groupBy("side", "folder").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= floor)
    rare = Window.partitionBy("side", "folder").orderBy("held", "stem")
    ranked = stems.join(rarity, "stem").join(sizes, ["side", "folder"]).withColumn("nth", F.row_number().over(rare))
    prefix = ranked.where(F.col("nth") <= F.col("size") - floor + 1)
    images, truths = (prefix.where(F.col("side") == side).select(F.col("folder").alias(name), "stem") for side, name in (("im", "img_dir"), ("gt", "gt_dir")))
    return images.join(truths, "stem").where("img_dir <> gt_dir").select("img_dir", "gt_dir").distinct()


def name_bonus(image_folder, truth_folder):
    """Two for an image folder whose own name says so, two for a truth folder, one for a path with ``train``."""
    own = lambda folder: F.lower(F.regexp_extract(folder, "([^/]*)$", 1))
    points = lambda test, n: F.when(test, n).otherwise(0)
    return points(own(image_folder).contains("image"), 2) + points(own(truth_folder).contains("gt"), 2) + points(F.lower(image_folder).contains("train"), 1)


def discover(files: DataFrame, least: int = 10, best: int = 5) -> DataFrame:
    """``(rank, img_dir, gt_dir, overlap, bonus, ambiguous)``: the best pairs of ``files(side, folder, stem)``.

    Folders with fewer than ``least`` files of their side take no part; pairs are of different folders
    and share a stem at least. ``ambiguous`` tells that the first two are equal in overlap and bonus;
    equal pairs go by their names.
    """
    distinct = files.where("side IS NOT NULL AND folder IS NOT NULL AND stem IS NOT NULL").distinct()
    sizes = distinct.groupBy("side", "folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    stems = distinct.join(sizes.select("side", "folder"), ["side", "folder"], "left_semi")
    seeds = overlaps(stems, proposed_pairs(stems)).orderBy(F.desc("overlap")).limit(best).agg(F.count(F.lit(1)), F.min("overlap")).first()
    floor = seeds[1] if seeds[0] == best else 1
    found = overlaps(stems, candidate_pairs(stems, floor)).where(F.col("overlap") >= floor)
    scored = found.withColumn("bonus", name_bonus(F.col("img_dir"), F.col("gt_dir")))
    order = (F.desc("overlap"), F.desc("bonus"), F.asc("img_dir"), F.asc("gt_dir"))
    first = scored.orderBy(*order).limit(best)
    place = Window.partitionBy(F.lit(1)).orderBy(*order)  # at most ``best`` rows
    every = Window.partitionBy(F.lit(1))
    ranked = first.withColumn("rank", F.row_number().over(place)).withColumn("__s", F.struct("overlap", "bonus"))
    alike = F.max(F.when(F.col("rank") == 1, F.col("__s"))).over(every).eqNullSafe(F.max(F.when(F.col("rank") == 2, F.col("__s"))).over(every))
    return ranked.select("rank", "img_dir", "gt_dir", "overlap", "bonus", alike.alias("ambiguous"))
