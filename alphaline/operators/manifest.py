"""Manifest operators: validation, pairing, merging, reconciling, leak guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaline.functions import text as tx


def violations(rows: DataFrame, key: str, category: str, known: DataFrame) -> DataFrame:
    """``(violation, n)``: missing keys, categories outside ``known``, ids found twice or more."""
    missing = rows.where(F.col(key).isNull() | F.col(category).isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("violation"), "n")
    strange = rows.where(F.col(category).isNotNull()).join(known.select(F.col(known.columns[0]).alias(category)).distinct(), category, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_category").alias("violation"), "n")
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_id").alias("violation"), "n")
    return missing.unionByName(strange).unionByName(twice)


def require_valid(rows: DataFrame, key: str, category: str, categories: list[str]) -> DataFrame:
    """``rows``; evaluating one without a key or with an unknown category raises."""
    good = F.col(key).isNotNull() & F.col(category).isin(categories)
    return rows.withColumn(key, F.when(good, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("bad manifest row: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))))


def with_truth(rows: DataFrame, truth: str) -> DataFrame:
    """Rows whose ground truth is neither null nor empty."""
    return rows.where(F.col(truth).isNotNull() & (F.col(truth) != ""))


def pair_by_stem(images: DataFrame, truths: DataFrame, suffix: str = "") -> DataFrame:
    """Images and ground truths joined on their stems; of equal truth stems the first path counts."""
    right = truths.select(F.regexp_replace(tx.stem(F.col("path")), f"{suffix}$", "").alias("stem"), F.col("path").alias("gt_path"))
    first = right.groupBy("stem").agg(F.min("gt_path").alias("gt_path"))
    return images.select(tx.stem(F.col("path")).alias("stem"), F.col("path").alias("image_path")).join(first, "stem")


def not_yet_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: rows without an output; partly done work is found before the costly map."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and the new rows whose key is new; within ``new`` the smallest row of a key counts."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return old.withColumn("origin", F.lit("old")).unionByName(fresh.withColumn("origin", F.lit("new")))


def first_occurrence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first by ``order``; an aggregate, so hot keys combine early."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__first")
    return rows.groupBy(F.col(key).alias("__key")).agg(first).select("__first.*")


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(side, n)``: keys found only left, only right, and on both sides."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def reconcile(wanted: DataFrame, files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each wanted key as skip (file and row), add_row (file only) or pending (no file)."""
    f, r = files.select(key).distinct().withColumn("f", F.lit(True)), rows.select(key).distinct().withColumn("r", F.lit(True))
    state = F.when(F.col("f").isNull(), "pending").when(F.col("r").isNull(), "add_row").otherwise("skip")
    return wanted.select(key).distinct().join(f, key, "left").join(r, key, "left").select(key, state.alias("state"))


def expand_copies(rows: DataFrame, key: str, copies: Column) -> DataFrame:
    """Each row once as the original (``_o00``) and ``copies`` times as a variant (``_v%02d``)."""
    original = rows.withColumn("copy_id", F.concat(F.col(key).cast("string"), F.lit("_o00"))).withColumn("kind", F.lit("original"))
    numbers = F.when(copies > 0, F.sequence(F.lit(0), copies.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    variant = rows.select("*", F.explode(numbers).alias("__c")).withColumn("copy_id", F.format_string("%s_v%02d", F.col(key).cast("string"), F.col("__c"))).withColumn("kind", F.lit("variant")).drop("__c")
    return original.unionByName(variant)


def guard_leaks(copies: DataFrame, held_out: DataFrame, copy_id: str) -> DataFrame:
    """Copies whose source is not the source of any held-out copy."""
    sources = held_out.select(tx.source_id(F.col(copy_id)).alias("__source")).distinct()
    return copies.withColumn("__source", tx.source_id(F.col(copy_id))).join(sources, "__source", "left_anti").drop("__source")


def layout_overlaps(files: DataFrame, folder: str, name: str, least: int = 1) -> DataFrame:
    """``(folder_a, folder_b, overlap)`` for folders sharing at least ``least`` names.

    Names are counted by folder before the join, so copies inside a folder don't multiply.
    """
    names = files.select(F.col(folder).alias("folder"), F.col(name).alias("name")).distinct()
    held = names.groupBy("name").agg(F.sort_array(F.collect_set("folder")).alias("folders")).where("size(folders) > 1")
    pairs = held.select(F.explode("folders").alias("folder_a"), "folders").select("folder_a", F.explode("folders").alias("folder_b")).where("folder_a < folder_b")
    return pairs.groupBy("folder_a", "folder_b").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)


def merge_by_model(old: DataFrame, new: DataFrame, model: str = "model") -> DataFrame:
    """Old rows of models that ``new`` lacks, and all new rows: a re-run replaces its model."""
    kept = old.join(new.select(model).distinct(), model, "left_anti").withColumn("origin", F.lit("old"))
    return kept.unionByName(new.withColumn("origin", F.lit("new")))


def relabel(rows: DataFrame, category: str, rule: Column) -> DataFrame:
    """Rows with a new category and whether it changed."""
    return rows.withColumn("new_category", rule).withColumn("changed", ~F.col("new_category").eqNullSafe(F.col(category)))


def integrity(shards: DataFrame, total: int) -> DataFrame:
    """One row: shard names unique, counts positive, and their sum as expected."""
    return shards.agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("pairs").alias("pairs"),
        (F.countDistinct("shard_name") == F.count(F.lit(1))).alias("names_unique"),
        F.coalesce(F.min("pairs") > 0, F.lit(True)).alias("counts_positive"),
        (F.coalesce(F.sum("pairs"), F.lit(0)) == F.lit(total)).alias("total_matches"),
    )


def duplicate_stems(files: DataFrame, path: str) -> DataFrame:
    """``(stem, paths)`` of the stems that several files share."""
    named = files.select(tx.stem(F.col(path)).alias("stem"), F.col(path).alias("path"))
    return named.groupBy("stem").agg(F.sort_array(F.collect_set("path")).alias("paths")).where("size(paths) > 1")


def require_counts(rows: DataFrame, least: dict[str, tuple[Column, int]]) -> DataFrame:
    """One row of counts by name; a count under its least raises when read."""
    counts = rows.agg(*[F.count_if(test).alias(name) for name, (test, _) in least.items()])
    checked = [F.when(F.col(name) >= n, F.col(name)).otherwise(F.raise_error(F.lit(f"fewer than {n} rows: {name}"))).alias(name) for name, (_, n) in least.items()]
    return counts.select(*checked)


def common_stems(images: DataFrame, truths: DataFrame, path: str = "path") -> DataFrame:
    """Stems with a ``.jpg`` image and a ``.png`` truth; leftovers named ``._*`` don't count."""

    def stems(files: DataFrame, ending: str) -> DataFrame:
        name = F.regexp_extract(path, r"([^/]+)$", 1)
        return files.where(F.lower(name).endswith(ending) & ~name.startswith("._")).select(tx.stem(F.col(path)).alias("stem")).distinct()

    return stems(images, ".jpg").join(stems(truths, ".png"), "stem", "left_semi")


def category_or_other(stems: DataFrame, categories: DataFrame, key: str, category: str, other: str = "_other") -> DataFrame:
    """Every stem with its category, ``other`` where none is known."""
    return stems.join(categories.select(key, category), key, "left").withColumn(category, F.coalesce(category, F.lit(other)))


def instance_or_flat(images: DataFrame, instances: DataFrame, flats: DataFrame, key: str, mask: str) -> DataFrame:
    """Each image's mask: the pixel-wise maximum of its instances, else its flat file; images with neither go.

    ``instances`` may have many rows for a key; their maxima combine before the shuffle.
    """
    spread = instances.select(key, F.posexplode(mask).alias("pos", "a")).groupBy(key, "pos").agg(F.max("a").alias("a"))
    merged = spread.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "a"))), lambda p: p["a"]).alias("__merged"))
    both = images.select(key).join(merged, key, "left").join(flats.select(key, F.col(mask).alias("__flat")), key, "left")
    origin = F.when(F.col("__merged").isNotNull(), "instances").otherwise("flat")
    return both.select(key, F.coalesce("__merged", "__flat").alias(mask), origin.alias("origin")).where(F.col(mask).isNotNull())


def refresh_marker(marker: DataFrame | None, regenerated: DataFrame, key: str) -> DataFrame:
    """The keys to revalidate: those marked before and those regenerated now."""
    fresh = regenerated.select(key)
    return (fresh if marker is None else marker.select(key).union(fresh)).distinct()


def fetch_plan(remote: DataFrame, local: DataFrame, marker: DataFrame, key: str) -> DataFrame:
    """``(key, action)``: fetch what is only remote, revalidate what is marked, keep the rest."""
    here = local.select(key).distinct().withColumn("__here", F.lit(True))
    marked = marker.select(key).distinct().withColumn("__marked", F.lit(True))
    action = F.when(F.col("__here").isNull(), "fetch").when(F.col("__marked"), "revalidate").otherwise("keep")
    return remote.select(key).distinct().join(here, key, "left").join(marked, key, "left").select(key, action.alias("action"))


def skippable_shards(wanted: DataFrame, final: DataFrame, partial: DataFrame, files: DataFrame) -> DataFrame:
    """``(name, pairs, state)`` of wanted shards: skip where an earlier entry agrees in pairs and its file in bytes.

    Entries are ``(name, pairs, bytes)``; those of a partial manifest override those of a final one.
    """
    entries = final.select("name", "pairs", "bytes", F.lit(0).alias("n")).unionByName(partial.select("name", "pairs", "bytes", F.lit(1).alias("n")))
    latest = entries.groupBy("name").agg(F.max_by(F.struct("pairs", "bytes"), "n").alias("e")).select("name", F.col("e.pairs").alias("__pairs"), F.col("e.bytes").alias("__bytes"))
    joined = wanted.select("name", "pairs").join(latest, "name", "left").join(files.select("name", F.col("bytes").alias("__found")), "name", "left")
    same = (F.col("pairs") == F.col("__pairs")) & (F.col("__bytes") > 0) & (F.col("__bytes") == F.col("__found"))
    return joined.select("name", "pairs", F.when(same, "skip").otherwise("pack").alias("state"))


def merge_audit(old: DataFrame, new: DataFrame, key: str, *sides: str) -> DataFrame:
    """One row for each side of a merge: files before, growth, overwrites and files after.

    ``old`` and ``new`` hold ``(side, key)``. Reading a row of two sides that end unequal raises.
    """
    a = old.select("side", key).distinct().withColumn("__old", F.lit(1))
    b = new.select("side", key).distinct().withColumn("__new", F.lit(1))
    joined = a.join(b, ["side", key], "full_outer").where(F.col("side").isin(*sides))
    counts = joined.groupBy("side").agg(F.count("__old").alias("before"), F.count_if(F.col("__old").isNull()).alias("growth"), F.count_if(F.col("__old").isNotNull() & F.col("__new").isNotNull()).alias("overwritten"), F.count(F.lit(1)).alias("after"))
    every = Window.partitionBy(F.lit(1))  # one row a side
    equal = F.when(F.min("after").over(every) == F.max("after").over(every), F.col("after")).otherwise(F.raise_error(F.lit("sides differ in size after the merge")))
    return counts.select("side", "before", "growth", "overwritten", equal.alias("after"))


def composite_audit(rows: DataFrame, files: DataFrame, category: str, multipliers: dict[str, int], default: int = 1) -> DataFrame:
    """One row: composites expected by the categories' multipliers, files found, and whether they agree."""
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    times = F.lit(default)
    for name, n in multipliers.items():
        times = F.when(F.col(category) == name, n).otherwise(times)
    expected = counts.select((F.col("n") * times).alias("expected"), F.lit(0).cast("long").alias("found"))
    found = files.agg(F.count(F.lit(1)).alias("found")).select(F.lit(0).cast("long").alias("expected"), "found")
    both = expected.unionByName(found).agg(F.sum("expected").alias("expected"), F.sum("found").alias("found"))
    return both.select("expected", "found", (F.col("expected") == F.col("found")).alias("complete"))


def excluded_by_pool(raw: DataFrame, excluded: DataFrame, pool: str, stem: str, key: str) -> DataFrame:
    """``(pool, n, n_excluded)``: raw files of each pool, and those whose id is excluded.

    An id is the pool's name and the file's sanitised stem.
    """
    named = raw.select(F.col(pool).alias("pool"), F.concat_ws("_", pool, tx.sanitise(F.col(stem))).alias(key))
    marked = named.join(excluded.select(key).distinct().withColumn("__out", F.lit(True)), key, "left")
    return marked.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.count_if("__out").alias("n_excluded"))


def archive_action(bad_exists: Column, archived_exists: Column) -> Column:
    """What to do with a bad version: archive it, nothing, or refuse where both are there."""
    return F.when(bad_exists & archived_exists, "refuse").when(archived_exists, "done").when(bad_exists, "archive").otherwise("nothing")


def widened(ids: DataFrame, listing: DataFrame, key: str, category: str, images: str, truths: str) -> DataFrame:
    """Full manifest rows of ``(key, category)`` whose files are both in ``listing(path)``."""
    full = ids.select(F.col(key).cast("string").alias("id"), F.concat(F.lit(images), key, F.lit(".jpg")).alias("image"), category, F.concat(F.lit(truths), key, F.lit(".png")).alias("gt_alpha"))
    known = listing.select("path").distinct()
    return full.join(known, full["image"] == known["path"], "left_semi").join(known, full["gt_alpha"] == known["path"], "left_semi")


def pool_fill(existing: DataFrame, candidates: DataFrame, order: str, target: int) -> DataFrame:
    """The first candidates by ``order`` that a pool still lacks, numbered on from what is there; none once it is full."""
    have = existing.count()
    chosen = candidates.orderBy(order).limit(max(0, target - have))
    return chosen.withColumn("number", F.lit(have) + F.row_number().over(Window.orderBy(order)) - 1)


def same_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, same)`` of left's pairs: both sizes are those of the copy on the right; a missing copy differs."""
    there = right.select(key, F.struct("im_bytes", "gt_bytes").alias("__there"))
    return left.join(there, key, "left").select(key, F.coalesce(F.struct("im_bytes", "gt_bytes") == F.col("__there"), F.lit(False)).alias("same"))


def keep_full_statistics(old: DataFrame, new: DataFrame, key: str, rows: str) -> DataFrame:
    """Statistics by key where a run over fewer rows does not replace one over more."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = F.max_by(F.struct(*old.columns), F.struct(rows, "__new")).alias("r")
    return both.groupBy(F.col(key).alias("__k")).agg(best).select("r.*")
