"""Command line: ``python -m alphaline benchmark|compare|gallery|export-stats ...`` over Parquet folders."""

from __future__ import annotations

import argparse
import math
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaline.operators import kernels
from alphaline.plans import benchmark
from alphaline.sources import export


def shaped(load: Callable, width: int | None) -> Callable:
    """A model's loader whose model takes flat images: rows of ``width`` pixels; without it a square, or else one row."""

    def loaded() -> Callable[[np.ndarray], np.ndarray]:
        inner = load()

        def run(flat: np.ndarray) -> np.ndarray:
            side = math.isqrt(flat.size)
            columns = width or (side if side * side == flat.size else flat.size)
            if not columns or flat.size % columns:
                raise ValueError(f"{flat.size} pixels are no rows of {columns}")
            return inner(flat.reshape(-1, columns))

        return run

    return loaded


def report_failures(name: str, found: DataFrame) -> int:
    """Tell on stderr how many images a model failed on, and one of the errors; their number."""
    failed = found.where("error IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("first")).first()
    if failed["n"]:
        print(f"{name}: {failed['n']} images failed ({failed['first']})", file=sys.stderr)
    return failed["n"]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="alphaline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("benchmark", help="score models on images (id, category, alpha, gt: 8-bit arrays)")
    run.add_argument("--models", required=True, help="names, joined by commas; name+variant is allowed")
    run.add_argument("--images", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--width", type=int, help="pixels in a row of the images; without it they are square, or else one row")
    compare = commands.add_parser("compare", help="a Markdown table of results written by benchmark")
    compare.add_argument("--results", required=True)
    gallery = commands.add_parser("gallery", help="one page part a category")
    gallery.add_argument("--rows", required=True)
    gallery.add_argument("--out", required=True)
    stats = commands.add_parser("export-stats", help="statistics of exported pairs")
    stats.add_argument("--rows", required=True)
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("alphaline").getOrCreate()
    n_failed = 0
    if chosen.command == "benchmark":
        images = spark.read.parquet(chosen.images)
        for name in chosen.models.split(","):
            scaled = images.withColumn("x", F.transform("alpha", lambda a: a / 255.0))
            found = kernels.predict(scaled, ["id", "category", "gt"], "x", shaped(kernels.model(name), chosen.width)).persist()
            n_failed += report_failures(name, found)
            pairs = found.where("error IS NULL").select(F.lit(name).alias("model"), "category", F.transform("alpha", lambda a: F.bround(a * 255).cast("int")).alias("pred"), "gt")
            export.write_results(benchmark.run(pairs), chosen.out)
            found.unpersist()
    elif chosen.command == "compare":
        print(benchmark.markdown(export.read_results(spark, chosen.results)))
    elif chosen.command == "gallery":
        benchmark.gallery(spark.read.parquet(chosen.rows), "category", "id", "image").write.mode("overwrite").parquet(chosen.out)
    else:
        benchmark.export_statistics(spark.read.parquet(chosen.rows), "category").show(1000, truncate=False)
    return 1 if n_failed else 0


if __name__ == "__main__":
    sys.exit(main())
