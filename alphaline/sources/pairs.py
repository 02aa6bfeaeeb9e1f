"""Image and truth pairs of ordered Parquet files, numbered through without a sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaline.functions import text as tx

#: A source with fewer pairs than this part of what is expected is incomplete.
COMPLETE = 0.9
#: Files whose starts (a path and a number each) are broadcast; those of more are joined by a shuffle.
BROADCAST_FILES = 100_000


def cell(rows: DataFrame, name: str):
    """The bytes of a column that is binary or ``struct<bytes, path>``."""
    return F.col(f"{name}.bytes") if dict(rows.dtypes)[name].startswith("struct") else F.col(name)


def numbered_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """All rows of the patterns' files with ``number``: pattern by pattern, file by file, row by row.

    Row numbers inside a file come from the reader, the rows before a file from the row counts in
    the footers; one row a file is summed up and, up to ``BROADCAST_FILES`` of them, broadcast, so
    rows are neither sorted nor shuffled. Columns that some files lack are null there.
    """
    parts = [spark.read.option("mergeSchema", "true").parquet(pattern).select("*", F.lit(no).alias("__pattern"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")) for no, pattern in enumerate(patterns)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sizes = rows.groupBy("__pattern", "__file").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("__pattern", "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__pattern", "__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    if len(rows.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    placed = rows.join(starts, ["__pattern", "__file"])
    return placed.withColumn("number", F.col("__start") + F.col("__row")).drop("__pattern", "__file", "__row", "__start")


def ordered_pairs(spark: SparkSession, source: str, patterns: list[str], image: str = "image", truth: str = "mask", name: str = "image_name", expected: int | None = None) -> DataFrame:
    """``(number, stem, image, truth)`` of a source's pairs.

    A stem is the source and the pair's own name where the files have that column and the row a
    value, else the source and the running number. A stem that comes again is left out: the
    first by number counts. With fewer than ``COMPLETE`` of the expected stems it raises, before
    any pair is read.
    """
    rows = numbered_files(spark, patterns)
    for column in (image, truth):
        if column not in rows.columns:
            raise ValueError(f"{source}: no column {column} among {rows.columns}")
    counted = F.format_string("%06d", "number")
    named = name in rows.columns
    own = F.coalesce(tx.sanitise_stem(tx.stem(F.col(name))), counted) if named else counted
    stems = rows.select("number", F.concat_ws("_", F.lit(source), own).alias("stem"), cell(rows, image).alias("image"), cell(rows, truth).alias("truth"))
    if named:
        firsts = stems.groupBy("stem").agg(F.min("number").alias("number"))
        stems = stems.join(firsts.select("number"), "number", "left_semi").select("number", "stem", "image", "truth")
        found = firsts.count() if expected is not None else 0
    else:
        found = rows.count() if expected is not None else 0
    if expected is not None and found < COMPLETE * expected:
        raise ValueError(f"{source}: {found} pairs of {expected}; a colliding stem, a missing file or another schema")
    return stems
