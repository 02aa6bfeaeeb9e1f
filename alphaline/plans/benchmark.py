"""Benchmark plan: score models, merge with earlier results, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.functions import text as tx
from alphaline.operators import manifest, metrics


def run(pairs: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Metrics by (model, category) and model of ``pairs(model, category, pred, gt)``.

    Pairs without ground truth are not scored. Results of models that ``old`` has and
    ``pairs`` lacks are kept.
    """
    fresh = metrics.benchmark(metrics.score(pairs.where("gt IS NOT NULL"), "model", "category"), "model", "category")
    return fresh.withColumn("origin", F.lit("new")) if old is None else manifest.merge_by_model(old, fresh)


def comparison(results: DataFrame, baseline: str) -> DataFrame:
    """One row per category with each model's value, the leader and its lead over the baseline."""
    table = metrics.deltas(results.where("category IS NOT NULL").select("category", "model", "mae"), baseline, "category", "model", "mae")
    least = table.groupBy("category").agg(F.min_by("model", "value").alias("leader"), F.min("value").alias("value"), F.first("base").alias("base"))
    return least.select("category", "leader", "value", "base", F.round(F.try_divide(100 * (F.col("value") - F.col("base")), F.col("base")), 4).alias("delta_pct"))


def markdown(results: DataFrame) -> str:
    """A report table; its rows are categories, few by nature, and are collected."""
    wide = results.where("category IS NOT NULL").groupBy("category").pivot("model").agg(F.first("mae")).orderBy("category")
    head = wide.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for row in wide.collect():
        known = [v for v in row[1:] if v is not None]
        cells = ["n/a" if v is None else f"**{v:.4f}**" if v == min(known) else f"{v:.4f}" for v in row[1:]]
        lines.append("| " + " | ".join([str(row[0]), *cells]) + " |")
    return "\n".join(lines)


def gallery(rows: DataFrame, category: str, name: str, link: str, order: str | None = None) -> DataFrame:
    """``(category, html)``: one table per category, in the order of the names or of ``order``; names are escaped."""
    cell = F.format_string("<figure><img src=\"%s\"><figcaption>%s</figcaption></figure>", tx.html_escape(F.col(link)), tx.html_escape(F.col(name)))
    cells = rows.select(category, F.struct(F.col(order or name), cell.alias("cell")).alias("c"))
    return cells.groupBy(category).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["cell"]), "").alias("html"))


def export_statistics(rows: DataFrame, category: str) -> DataFrame:
    """Rows, exact percentiles of the short side and the mean soft-alpha ratio by category.

    ``rows(category, width, height, soft_ratio)``; the ratio is a mean of the images' ratios.
    """
    short = F.least("width", "height")
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("total"), *[F.round(F.percentile(short, p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)], F.round(F.avg("soft_ratio"), 6).alias("soft_ratio"))
