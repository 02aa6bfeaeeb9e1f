"""More registered queries: manifests on disk, audits, predicates, names, schedules and folds."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as F

from alphaline.catalog import A8, COPIES, RESULTS, SCORED, SIDE, alphas, copies, manifest_rows, query, results, scored_models
from alphaline.functions import alpha as al
from alphaline.functions import schedule
from alphaline.functions import text as tx
from alphaline.operators import generate, kernels, manifest, metrics, sampling
from alphaline.plans import benchmark, stages
from alphaline.sources import export, manifests
from alphaline.sources.scratch import scratch
from alphaline.sources.tables import table
from alphaline.streaming import jobs

CATEGORY = {"en": "hair", "fr": "thin", "de": "complex", "es": "design_real"}
CATEGORY_SQL = "CASE lang WHEN 'en' THEN 'hair' WHEN 'fr' THEN 'thin' WHEN 'de' THEN 'complex' WHEN 'es' THEN 'design_real' ELSE 'general' END"


def entries(spark, sf_dir):
    """``documents`` as manifest rows; the labelled ones have ground truth."""
    category = F.lit("general")
    for lang, name in CATEGORY.items():
        category = F.when(F.col("lang") == lang, name).otherwise(category)
    rows = manifest_rows(spark, sf_dir)
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("im/é"), "doc_id", F.lit(".jpg")).alias("image"), category.alias("category"), "gt_alpha")


def written(spark, sf_dir):
    path = scratch(spark, "manifest")
    manifests.append_manifest(entries(spark, sf_dir), path)
    return path


# --- manifests on disk


@query(f"SELECT id, image, category, gt_alpha FROM (SELECT CAST(d.doc_id AS VARCHAR) AS id, 'im/é' || d.doc_id || '.jpg' AS image, {CATEGORY_SQL} AS category, CASE WHEN l.doc_id IS NOT NULL THEN 'gt/' || d.doc_id END AS gt_alpha FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))")
def manifest_round_trip(spark, sf_dir):
    """A validated append, then a strict scan."""
    return manifests.read_manifest(spark, written(spark, sf_dir))


@query(f"SELECT category, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'product' ELSE {CATEGORY_SQL} END AS category FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY category")
def last_category_wins(spark, sf_dir):
    """A lenient scan of two files; the second names some ids again."""
    base = scratch(spark, "lenient")
    rows = entries(spark, sf_dir)
    rows.select("id", "category").write.json(f"{base}/a")
    rows.where("gt_alpha IS NOT NULL").select("id", F.lit("product").alias("category")).write.json(f"{base}/b")
    return manifests.read_categories(spark, f"{base}/*").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM (SELECT DISTINCT doc_id FROM documents)")
def output_ids(spark, sf_dir):
    """Ids of an output manifest written twice, beside one that is missing."""
    path = written(spark, sf_dir)
    manifests.append_manifest(entries(spark, sf_dir), path)
    return manifests.read_ids(spark, path).union(manifests.read_ids(spark, scratch(spark, "missing")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def excluded_ids_file(spark, sf_dir):
    """Rows whose id a text file does not list; blanks and spaces in it don't count."""
    path = scratch(spark, "excluded")
    listed = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit(" ")).alias("value"))
    listed.union(spark.createDataFrame([("",), ("   ",)], "value string")).write.text(path)
    return entries(spark, sf_dir).select("id").join(manifests.excluded_ids(spark, path), "id", "left_anti")


@query("SELECT count(*) AS pairs, count(l.doc_id) AS with_truth, count(*) FILTER (lang = 'en') AS hair FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def preflight_counts(spark, sf_dir):
    """Counts that a run needs; one under its least raises."""
    rows = entries(spark, sf_dir)
    return manifest.require_counts(rows, {"pairs": (F.lit(True), 1), "with_truth": (F.col("gt_alpha").isNotNull(), 1), "hair": (F.col("category") == "hair", 1)})


@query("WITH s AS (SELECT count(*) AS n FROM (SELECT DISTINCT (row_number() OVER (ORDER BY o_orderkey) - 1) // 7000 AS s FROM orders)) SELECT s.n AS shards, count(*) AS pairs, true AS names_unique, true AS counts_positive, true AS total_matches FROM orders, s GROUP BY s.n")
def shard_integrity(spark, sf_dir):
    """Whether a shard manifest is sound: unique names, positive counts, the expected total."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return manifest.integrity(sampling.shards(rows, "o_orderkey", 7000), rows.count())


@query("SELECT DISTINCT CAST(d.doc_id AS VARCHAR) AS id, 'im/' || d.doc_id || '.jpg' AS image, lang, 'gt/' || d.doc_id || '.png' AS gt_alpha FROM documents d JOIN labels l USING (doc_id)")
def widened_manifest(spark, sf_dir):
    """Full rows of the ids whose image and truth files are both there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    images = docs.select(F.concat(F.lit("im/"), "doc_id", F.lit(".jpg")).alias("path"))
    truths = table(spark, sf_dir, "labels").select(F.concat(F.lit("gt/"), "doc_id", F.lit(".png")).alias("path"))
    return manifest.widened(docs, images.union(truths), "doc_id", "lang", "im/", "gt/")


@query("SELECT DISTINCT 'd' || d.doc_id AS stem FROM documents d JOIN labels l USING (doc_id)")
def common_stems(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select(F.explode(F.array(F.concat(F.lit("a/d"), "doc_id", F.lit(".JPG")), F.concat(F.lit("a/._d"), "doc_id", F.lit(".jpg")))).alias("path"))
    truths = table(spark, sf_dir, "labels").select(F.explode(F.array(F.concat(F.lit("b/d"), "doc_id", F.lit(".png")), F.concat(F.lit("b/d"), "doc_id", F.lit("x.txt")))).alias("path"))
    return manifest.common_stems(images, truths)


@query("SELECT category, count(*) AS n FROM (SELECT coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, '_other') AS category FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY category ORDER BY n DESC, category")
def category_or_other(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("category"))
    placed = manifest.category_or_other(table(spark, sf_dir, "documents").select("doc_id"), known, "doc_id", "category")
    return placed.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


@query(f"""WITH m AS ({A8}), px AS (SELECT label, pos, max(a8[pos + 1]) AS a FROM m, (SELECT unnest(range(64)) AS pos) WHERE label < 5 GROUP BY ALL),
i AS (SELECT label, sum(a) AS total FROM px GROUP BY label), f AS (SELECT label, list_sum(arg_min(a8, vec_id)) AS total FROM m WHERE label < 8 GROUP BY label)
SELECT f.label, CASE WHEN i.label IS NOT NULL THEN 'instances' ELSE 'flat' END AS origin, CAST(coalesce(i.total, f.total) AS BIGINT) AS total FROM f LEFT JOIN i USING (label)""")
def instance_or_flat(spark, sf_dir):
    """Labels under 5 have instance masks, labels under 8 a flat one, the others none."""
    maps = alphas(spark, sf_dir)
    flats = maps.where("label < 8").groupBy("label").agg(F.min_by("a8", "vec_id").alias("a8"))
    found = manifest.instance_or_flat(maps.select("label").distinct(), maps.where("label < 5"), flats, "label", "a8")
    return found.select("label", "origin", F.aggregate("a8", F.lit(0).cast("long"), lambda s, a: s + a).alias("total"))


@query("WITH m AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0) SELECT action, count(*) AS n FROM (SELECT CASE WHEN d.lang = 'fr' THEN 'fetch' WHEN m.doc_id IS NOT NULL THEN 'revalidate' ELSE 'keep' END AS action FROM documents d LEFT JOIN m USING (doc_id)) GROUP BY action")
def refresh_marker(spark, sf_dir):
    """Documents in French are not here yet; toxic ones were marked before, poor ones regenerated now."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marker = manifest.refresh_marker(labels.where("toxic = 1"), labels.where("quality = 0"), "doc_id")
    return manifest.fetch_plan(docs, docs.where("lang <> 'fr'"), marker, "doc_id").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's' || p_partkey AS name, p_size AS pairs, CASE WHEN p_size > 10 AND p_size % 3 <> 0 THEN 'skip' ELSE 'pack' END AS state FROM part")
def shard_skips(spark, sf_dir):
    """A final manifest that a partial one corrects for every third size, and files only over size 10."""
    wanted = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), "p_partkey").alias("name"), F.col("p_size").alias("pairs"))
    final = wanted.select("name", "pairs", (F.col("pairs") * 100).alias("bytes"))
    partial = wanted.where("pairs % 3 = 0").select("name", (F.col("pairs") + 1).alias("pairs"), (F.col("pairs") * 100).alias("bytes"))
    return manifest.skippable_shards(wanted, final, partial, final.where("pairs > 10"))


@query("SELECT side, count(*) FILTER (l.doc_id IS NOT NULL) AS before, count(*) FILTER (l.doc_id IS NULL) AS growth, count(*) FILTER (l.doc_id IS NOT NULL) AS overwritten, count(*) AS after FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id), (SELECT unnest(['im', 'gt']) AS side) GROUP BY side")
def merge_growth(spark, sf_dir):
    """Images and truths of the labelled documents, merged with those of all documents."""
    sides = F.explode(F.array(F.lit("im"), F.lit("gt"))).alias("side")
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    known = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    return manifest.merge_audit(known.select(sides, "doc_id"), docs.select(sides, "doc_id"), "doc_id", "im", "gt")


@query(f"WITH {COPIES} SELECT e.n AS expected, f.n AS found, e.n = f.n AS complete FROM (SELECT sum(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 4 ELSE 2 END)::BIGINT AS n FROM documents) e, (SELECT count(*) AS n FROM c) f")
def composite_total(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang")
    return manifest.composite_audit(docs, copies(spark, sf_dir), "lang", {"en": 1, "fr": 4}, 2)


@query("SELECT source AS pool, count(*) AS n, count(l.doc_id) AS n_excluded FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY source")
def excluded_per_pool(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("a# "), "doc_id").alias("stem"))
    out = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select(F.concat_ws("_", "source", F.lit("a"), "doc_id").alias("id"))
    return manifest.excluded_by_pool(docs, out, "source", "stem", "id")


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' AND l.doc_id IS NOT NULL THEN 'refuse' WHEN l.doc_id IS NOT NULL THEN 'done' WHEN lang = 'en' THEN 'archive' ELSE 'nothing' END AS action FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY action")
def archive_actions(spark, sf_dir):
    rows = manifest_rows(spark, sf_dir)
    return rows.groupBy(manifest.archive_action(F.col("lang") == "en", F.col("gt_alpha").isNotNull()).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH h AS (SELECT count(DISTINCT doc_id) AS n FROM labels WHERE toxic = 1) SELECT page_id, h.n + row_number() OVER (ORDER BY page_id) - 1 AS number FROM pages, h QUALIFY row_number() OVER (ORDER BY page_id) <= greatest(0, 300 - h.n)")
def background_pool(spark, sf_dir):
    """Fill a pool up to 300 files; toxic labels stand for what is there."""
    have = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return manifest.pool_fill(have, table(spark, sf_dir, "pages").select("page_id"), "page_id", 300)


@query("SELECT same, count(*) AS n FROM (SELECT l.doc_id IS NOT NULL AND d.lang <> 'fr' AS same FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY same")
def size_equality(spark, sf_dir):
    """Pairs whose copies agree in both sizes; French truths were cut short."""
    left = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("im_bytes"), (F.col("n_chars") * 2).alias("gt_bytes"))
    right = left.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").withColumn("gt_bytes", F.when(F.col("lang") == "fr", 0).otherwise(F.col("gt_bytes")))
    return manifest.same_sizes(left, right, "doc_id").groupBy("same").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def full_statistics_stay(spark, sf_dir):
    """Statistics of a part of the rows do not replace those of all; the languages gained keep theirs."""
    docs = table(spark, sf_dir, "documents")
    stats = lambda rows: rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    part = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return manifest.keep_full_statistics(stats(docs.where("lang <> 'de'")), stats(part.where("lang <> 'de'")).unionByName(stats(docs.where("lang = 'de'"))), "lang", "n")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'no truth' ELSE 'scored' END AS state, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def layout_bridge(spark, sf_dir):
    """A ``fg``/``alpha`` layout as image and truth by stem; images without a truth stay unscored."""
    fg = table(spark, sf_dir, "documents").select(F.concat(F.lit("fg/d"), "doc_id", F.lit(".jpg")).alias("path"))
    alpha = table(spark, sf_dir, "labels").select(F.concat(F.lit("alpha/d"), "doc_id", F.lit("_matte.png")).alias("path"))
    pairs = manifest.pair_by_stem(fg, alpha, "_matte")
    every = fg.select(tx.stem(F.col("path")).alias("stem")).join(pairs, "stem", "left")
    return every.groupBy(F.when(F.col("gt_path").isNull(), "no truth").otherwise("scored").alias("state")).agg(F.count(F.lit(1)).alias("n"))


# --- predicates and names


@query(f"""WITH {COPIES}, e AS (SELECT doc_id, lang, copy_id FROM c UNION ALL SELECT doc_id, lang, doc_id || '_e00' FROM documents UNION ALL SELECT doc_id, lang, doc_id || '_k01' FROM documents)
SELECT lang, count(*) FILTER (NOT regexp_matches(copy_id, '_[emk][0-9]{{2}}$')) AS usable, count(*) FILTER (regexp_matches(copy_id, '_[emk][0-9]{{2}}$')) AS derived, count(*) FILTER (regexp_matches(copy_id, '_o[0-9]{{2}}$') OR lang = 'de') AS preferred FROM e GROUP BY lang""")
def derived_stems(spark, sf_dir):
    """No derivative of a derivative; originals and one category are preferred."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    made = docs.select("doc_id", "lang", F.explode(F.array(F.concat("doc_id", F.lit("_e00")), F.concat("doc_id", F.lit("_k01")))).alias("copy_id"))
    every = copies(spark, sf_dir).select("doc_id", "lang", "copy_id").unionByName(made)
    derived, preferred = tx.is_derived(F.col("copy_id")), F.col("copy_id").rlike(r"_o\d{2}$") | (F.col("lang") == "de")
    return every.groupBy("lang").agg(F.count_if(~derived).alias("usable"), F.count_if(derived).alias("derived"), F.count_if(preferred).alias("preferred"))


WIDE = "WITH w AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(least(greatest(0.5 + 6 * CAST(v AS DOUBLE), 0), 1) * 255) AS INTEGER)) AS a FROM embeddings)"


def wide(spark, sf_dir):
    """Embeddings as alpha maps with much exact background and solid foreground, cut off to 8 bits."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: al.truncate8(0.5 + 6 * v.cast("double"))).alias("a"))


@query(f"{WIDE} SELECT vec_id, len(list_filter(a, lambda x: x * 10 > 2295)) * 20 >= len(a) AND len(list_filter(a, lambda x: x = 0)) * 20 >= 3 * len(a) AS bokeh, len(list_filter(a, lambda x: x * 10 > 2295)) * 100 >= 8 * len(a) AND len(list_filter(a, lambda x: x * 100 > 1275 AND x * 100 < 24225)) * 100 >= 8 * len(a) AS mixed FROM w")
def solid_and_soft_sources(spark, sf_dir):
    return wide(spark, sf_dir).select("vec_id", al.bokeh_source(F.col("a")).alias("bokeh"), al.mixed_opacity(F.col("a")).alias("mixed"))


@query(f"{WIDE} SELECT vec_id FROM w WHERE len(list_filter(a, lambda x: x * 10 > 2295)) * 100 >= 8 * len(a) AND len(list_filter(a, lambda x: x * 100 > 1275 AND x * 100 < 24225)) * 100 >= 8 * len(a) ORDER BY vec_id LIMIT 50")
def first_mixed(spark, sf_dir):
    """The first mixed sources by id: half of a cap of 100."""
    return sampling.first_n(wide(spark, sf_dir), al.mixed_opacity(F.col("a")), 100 // 2, "vec_id").select("vec_id")


@query("SELECT p_partkey, p_size >= 4 AND least(p_size * 20, p_partkey % 700 + 100) >= 200 AND greatest(p_size * 20, p_partkey % 700 + 100) / least(p_size * 20, p_partkey % 700 + 100) <= 2.6 AS usable FROM part")
def usable_templates(spark, sf_dir):
    width, height = F.col("p_size") * 20, F.col("p_partkey") % 700 + 100
    return table(spark, sf_dir, "part").select("p_partkey", al.usable_template(F.col("p_size"), width, height).alias("usable"))


@query(f"WITH {SCORED} SELECT vec_id, model, len(list_filter(pred, lambda a: a > 127)) / 64 BETWEEN 0.08 AND 0.92 AND sad_i / 64 <= 25 AS acceptable FROM p JOIN s USING (vec_id, model)")
def acceptable_renders(spark, sf_dir):
    """Coverage between the limits, and near enough to the preview (here: the ground truth)."""
    cover = al.share_where(F.col("pred"), lambda a: a > 127)
    return scored_models(spark, sf_dir).select("vec_id", "model", al.acceptable_render(cover, al.abs_error(F.col("pred"), F.col("gt")) / F.size("gt")).alias("acceptable"))


STEMS = "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'raw_' ELSE 'disvd_complex_' END || '1_Group_' || p_partkey || '_' || CASE p_size % 4 WHEN 0 THEN 'Umbrella' WHEN 1 THEN 'Desk' WHEN 2 THEN 'hangGlider' ELSE 'net' END || '_' || p_size AS stem FROM part"


@query(f"""WITH k AS ({STEMS}), n AS (SELECT id, stem, split_part(regexp_replace(stem, '^(raw|disvd_complex)_1_Group_[0-9]+_', ''), '_', 1) AS token FROM k),
r AS (SELECT CASE WHEN starts_with(stem, 'disvd_') AND lower(token) IN {tx.THIN_CLASSES} THEN 'thin' ELSE 'complex' END AS new_category FROM n)
SELECT new_category, count(*) AS n, count(*) FILTER (new_category <> 'complex') AS n_changed FROM r GROUP BY new_category""")
def relabel_classes(spark, sf_dir):
    """Rows of one prefix get the category of their class token; the others keep theirs."""
    name = F.element_at(F.array(*map(F.lit, ("Umbrella", "Desk", "hangGlider", "net"))), F.col("p_size") % 4 + 1)
    prefix = F.when(F.col("p_size") % 5 == 0, "raw_").otherwise("disvd_complex_")
    stems = table(spark, sf_dir, "part").select(F.concat(prefix, F.lit("1_Group_"), "p_partkey", F.lit("_"), name, F.lit("_"), "p_size").alias("id"), F.lit("complex").alias("category"))
    rule = F.when(F.col("id").startswith("disvd_"), tx.thin_or_complex(tx.class_token(F.col("id")))).otherwise(F.col("category"))
    return manifest.relabel(stems, "category", rule).groupBy("new_category").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '_e00' END AS source_id, doc_id % 3 = 2 AS unmatched FROM documents")
def val_sources(spark, sf_dir):
    """Sources of validation stems, and which stems name no copy, so that nothing is excluded for them."""
    ending = F.element_at(F.array(F.lit("_v03"), F.lit("_o00"), F.lit("_e00")), (F.col("doc_id") % 3 + 1).cast("int"))
    stems = table(spark, sf_dir, "documents").select(F.concat("doc_id", ending).alias("stem"))
    return stems.select(tx.source_id(F.col("stem")).alias("source_id"), (tx.source_id(F.col("stem")) == F.col("stem")).alias("unmatched"))


@query("SELECT p_partkey, p_size AS edge, CAST(0 AS INTEGER) AS mixed, CAST(p_partkey AS INTEGER) AS bokeh, CASE WHEN p_size % 2 = 0 THEN 'refine' ELSE '' END AS variant, 'w' || p_size AS weight_key FROM part")
def count_specs(spark, sf_dir):
    """Counts from ``k=v`` text, a model's variant, and a weight's name without its wrapper's prefix."""
    parts = table(spark, sf_dir, "part")
    counts = tx.parse_counts(F.concat(F.lit("edge="), "p_size", F.lit(", bokeh="), "p_partkey"), ("edge", "mixed", "bokeh"))
    name = F.concat(F.lit("m"), F.when(F.col("p_size") % 2 == 0, "+refine").otherwise(""))
    weights = tx.strip_key_prefix(F.create_map(F.concat(F.when(F.col("p_size") % 3 == 0, "_orig_mod.").otherwise(""), F.lit("w"), "p_size"), F.lit(1)))
    return parts.select("p_partkey", *[counts[k].alias(k) for k in ("edge", "mixed", "bokeh")], tx.variant_of(name).alias("variant"), F.map_keys(weights)[0].alias("weight_key"))


@query("SELECT p_partkey, 'a = 1' || chr(10) || 'batch = ' || p_size || chr(10) || 'batch = 7 task[2]' AS config FROM part")
def config_patch(spark, sf_dir):
    """The first match of each pattern is replaced; a second run changes nothing."""
    text = F.concat(F.lit("a = 1\nbatch = "), F.col("p_partkey"), F.lit("\nbatch = 7 task[0]"))
    patches = lambda t: tx.patched(t, (r"task\[\d+\]", "task[2]"))
    sized = F.regexp_replace(text, r"(?s)^(.*?)batch = \d+", F.concat(F.lit("$1batch = "), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", patches(patches(sized)).alias("config"))


@query("SELECT p_partkey, list_aggregate(list_transform(range(1, p_size % 7 + 4), lambda i: chr(CAST(('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), CAST(2 * i - 1 AS BIGINT), 2)) AS INTEGER) % 26 + 97)), 'string_agg', '') AS word FROM part")
def random_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.random_word(F.col("p_partkey"), F.col("p_size") % 7 + 3).alias("word"))


@query("SELECT event_id, CASE WHEN event_type IS NULL THEN NULL WHEN contains(event_type || user_id, '401') OR contains(event_type, 'gated') THEN 'access' ELSE 'other' END AS kind, printf('%+d.0%%', user_id - 70) AS shown FROM events")
def error_kinds(spark, sf_dir):
    """Errors of access told by their text, and a signed percentage."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", tx.error_kind(F.concat("event_type", F.col("user_id"))).alias("kind"), tx.signed_percent((F.col("user_id") - 70).cast("double")).alias("shown"))


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'none') AS name, count(*) AS n FROM events GROUP BY 1")
def source_registry(spark, sf_dir):
    """Specifications from a JSON column, by name."""
    spec = F.from_json("props", "k string")
    return table(spark, sf_dir, "events").groupBy(F.coalesce(spec["k"], F.lit("none")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


# --- aggregates, folds, schedules


@query(f"WITH {RESULTS}, v AS (SELECT model, CASE WHEN label % 3 = 0 THEN 'nan'::DOUBLE WHEN label = 1 THEN NULL ELSE mae END AS v FROM r) SELECT model, round(avg(v) FILTER (NOT isnan(v)), 6) AS nan_mean, count(v) AS n FROM v GROUP BY model")
def nan_mean_by_model(spark, sf_dir):
    """Means that ignore NaN and missing values."""
    value = F.when(F.col("label") % 3 == 0, F.lit(float("nan"))).when(F.col("label") != 1, F.col("mae"))
    return results(spark, sf_dir).withColumn("v", value).groupBy("model").agg(F.round(metrics.nan_mean(F.col("v")), 6).alias("nan_mean"), F.count("v").alias("n"))


@query(f"WITH {RESULTS} SELECT 'category' AS level, CAST(label AS VARCHAR) AS key FROM r WHERE model <> 'raw' UNION SELECT 'model', model FROM r")
def result_keys(spark, sf_dir):
    """All categories and models that any model's results name."""
    found = results(spark, sf_dir)
    categories = found.where("model <> 'raw'").select(F.lit("category").alias("level"), F.col("label").cast("string").alias("key"))
    return categories.union(found.select(F.lit("model"), "model")).distinct()


@query("""WITH o AS (SELECT l_orderkey, sqrt(l_discount) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS z, sqrt(l_tax) AS v FROM lineitem),
t AS (SELECT l_orderkey, a, v, coalesce(product(1 - a) OVER (PARTITION BY l_orderkey ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS above FROM o)
SELECT l_orderkey, round(sum(v * a * above), 6) AS shown, round(1 - product(1 - a), 6) AS union_a FROM t GROUP BY l_orderkey""")
def layer_stack(spark, sf_dir):
    """Source-over of an order's lines from the first to the last, and their screened union."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    layers = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(place.alias("z"), F.sqrt("l_tax").alias("value"), F.sqrt("l_discount").alias("alpha")).alias("layer"))
    grouped = layers.groupBy("l_orderkey").agg(F.collect_list("layer").alias("layers"))
    return grouped.select("l_orderkey", F.round(metrics.over_fold(F.col("layers")), 6).alias("shown"), F.round(metrics.screen_fold(F.transform("layers", lambda x: x["alpha"])), 6).alias("union_a"))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, CAST(greatest(1, round_even(3000 / (n * CASE lang WHEN 'fr' THEN 4 ELSE 1 END)::DOUBLE, 0)) AS BIGINT) AS per_image FROM c")
def copies_per_source(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    average = F.coalesce(F.try_element_at(F.create_map(F.lit("fr"), F.lit(4)), F.col("lang")), F.lit(1))
    return counts.select("lang", "n", schedule.copies_for(F.lit(3000), F.col("n"), average).alias("per_image"))


@query("SELECT CAST(max(o_orderkey) AS INTEGER) AS epoch, 'epoch_' || max(o_orderkey) || '.pth' AS name FROM orders")
def latest_checkpoint(spark, sf_dir):
    """The checkpoint to resume from, by number and not by name."""
    named = table(spark, sf_dir, "orders").select(F.concat(F.lit("epoch_"), "o_orderkey", F.lit(".pth")).alias("name"))
    return named.select("name", tx.epoch_of(F.col("name")).alias("epoch")).agg(F.max("epoch").alias("epoch"), F.max_by("name", "epoch").alias("name"))


@query("""WITH n AS (SELECT event_type, value, row_number() OVER w AS n, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN n END) OVER (PARTITION BY event_type ORDER BY n) AS last FROM n)
SELECT event_type, count(*) AS polls, CAST(min(CASE WHEN n - last >= 6 THEN n END) AS INTEGER) AS stalled_at FROM g GROUP BY event_type""")
def stalled_polls(spark, sf_dir):
    return jobs.first_stall(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "value")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE CAST(p_partkey + 1 AS INTEGER) END AS samples FROM part")
def epoch_lengths(spark, sf_dir):
    asked = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", schedule.epoch_length(asked, (F.col("p_partkey") + 1).cast("int")).alias("samples"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256('7:' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.35 AS blurred FROM documents")
def item_choices(spark, sf_dir):
    """A choice with probability 0.35 that depends on the item only."""
    return table(spark, sf_dir, "documents").select("doc_id", (sampling.uniform(F.col("doc_id"), 7) < 0.35).alias("blurred"))


@query("""SELECT event_id, CAST(floor(least(greatest(value / 100, 0), 1) * 255) AS INTEGER) AS cut8, round(1 / (1 + exp(-value / 50)), 9) AS sig, round(0.299 * value + 0.587 * (100 - value) + 0.114 * user_id, 6) AS lum,
round(exp(-value * value / (2 * 900.0)), 9) AS bell, round(greatest(0.0, least(1.0, 1 - value / 40)), 9) AS fade FROM events""")
def alpha_scalars(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", al.truncate8(v / 100).alias("cut8"), F.round(al.sigmoid(v / 50), 9).alias("sig"), F.round(al.luminance(v, 100 - v, F.col("user_id")), 6).alias("lum"),
        F.round(al.gaussian_weight(v, F.lit(30.0)), 9).alias("bell"), F.round(al.compact_fade(v, F.lit(40.0)), 9).alias("fade"),
    )


@query("""WITH b AS (SELECT p_partkey, p_size AS low, p_size + CAST(p_partkey % 90 AS INTEGER) AS high FROM part),
c AS (SELECT p_partkey, high - low AS box, greatest(1, CAST(ceil(0.2 * (high - low)::DOUBLE) AS INTEGER)) AS begin, CAST(least(floor(0.6 * (high - low)::DOUBLE), 200 - 110 - low, high - low - 1) AS INTEGER) AS lo_end, CAST(least(floor(0.6 * (high - low)::DOUBLE), high - 30, high - low - 1) AS INTEGER) AS hi_end FROM b)
SELECT p_partkey, CASE WHEN lo_end >= begin THEN begin END AS lo_begin, CASE WHEN lo_end >= begin THEN lo_end END AS lo_end, CASE WHEN hi_end >= begin THEN begin END AS hi_begin, CASE WHEN hi_end >= begin THEN hi_end END AS hi_end FROM c""")
def cut_limits(spark, sf_dir):
    box = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("low"), (F.col("p_size") + (F.col("p_partkey") % 90).cast("int")).alias("high"))
    lo = schedule.cut_bounds(F.col("low"), F.col("high"), F.lit(200), F.lit(110), "lo")
    hi = schedule.cut_bounds(F.col("low"), F.col("high"), F.lit(200), F.lit(30), "hi")
    return box.select("p_partkey", lo["begin"].alias("lo_begin"), lo["end"].alias("lo_end"), hi["begin"].alias("hi_begin"), hi["end"].alias("hi_end"))


@query("""WITH g AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS BIGINT) AS e, CAST(CASE o_custkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 30 END AS INTEGER) AS t, CAST(CASE (o_orderkey // 40) % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 25 END AS INTEGER) AS f FROM orders)
SELECT o_orderkey, e AS epoch, t AS total, f AS last, f <> 0 AND t > f AND e > t - f AS reweight FROM g""")
def reweight_window(spark, sf_dir):
    """The window over epochs, totals and lengths taken from orders; too short runs have none."""
    key, pick = F.col("o_orderkey"), lambda at, *values: F.element_at(F.array(*map(F.lit, values)), (at % 3 + 1).cast("int"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", (key % 40).cast("long").alias("epoch"), pick(F.col("o_custkey"), 6, 20, 30).alias("total"), pick(F.floor(key / 40), 0, 10, 25).alias("last"))
    return runs.select("o_orderkey", "epoch", "total", "last", schedule.reweight(F.col("epoch"), F.col("total"), F.col("last")).alias("reweight"))


# --- generated copies


SOLID = "len(list_filter(a, lambda x: x * 10 > 2295))"


@query(f"{WIDE} SELECT vec_id || '_k00' AS copy_id, CAST(list_sum(a) AS BIGINT) AS alpha_sum FROM w WHERE {SOLID} * 20 >= len(a) AND len(list_filter(a, lambda x: x = 0)) * 20 >= 3 * len(a) AND vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) ORDER BY vec_id LIMIT 60")
def bokeh_copies(spark, sf_dir):
    """The first 60 sources with enough background, less those held out; their alpha stays as it is."""
    held_out = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    planned = generate.plan(wide(spark, sf_dir).where(al.bokeh_source(F.col("a"))), "vec_id", "bokeh", excluded=held_out)
    made = generate.make(sampling.first_n(planned, F.lit(True), 60, "vec_id"), ["copy_id"], "a", SIDE, generate.bokeh_copy)
    return made.select("copy_id", F.aggregate("a8", F.lit(0).cast("long"), lambda s, a: s + a).alias("alpha_sum"))


@query(f"{WIDE} SELECT vec_id || '_m0' || c AS copy_id, CAST(list_sum(a) AS BIGINT) AS alpha_sum FROM w, (SELECT unnest([0, 1]) AS c) WHERE {SOLID} * 100 >= 8 * len(a) AND len(list_filter(a, lambda x: x * 100 > 1275 AND x * 100 < 24225)) * 100 >= 8 * len(a) AND NOT (c = 0 AND vec_id % 2 = 0)")
def mixed_copies(spark, sf_dir):
    """Two copies of each mixed source, but for those that an earlier run left; their alpha stays as it is."""
    sources = wide(spark, sf_dir).where(al.mixed_opacity(F.col("a")))
    there = sources.where("vec_id % 2 = 0").select(F.concat("vec_id", F.lit("_m00")).alias("copy_id"))
    made = generate.make(generate.plan(sources, "vec_id", "mixed", 2, existing=there), ["copy_id"], "a", SIDE, generate.mixed_copy)
    return made.select("copy_id", F.aggregate("a8", F.lit(0).cast("long"), lambda s, a: s + a).alias("alpha_sum"))


@query(f"""{WIDE}, px AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(a) AS a FROM w),
b AS (SELECT vec_id, unnest(['x', 'y']) AS axis, unnest([min(pos % 8), min(pos // 8)]) AS lo, unnest([max(pos % 8), max(pos // 8)]) + 1 AS hi FROM px WHERE a > 127 GROUP BY vec_id),
c AS (SELECT vec_id, greatest(1, CAST(ceil(0.2 * (hi - lo)::DOUBLE) AS BIGINT)) AS first, CAST(least(floor(0.6 * (hi - lo)::DOUBLE), hi - lo - 1, greatest(8 - lo, hi) - 4) AS BIGINT) AS last FROM b)
SELECT w.vec_id || '_e00' AS copy_id, coalesce(bool_or(last >= first), false) AS cut, coalesce(bool_or(last >= first), false) AS touches FROM w LEFT JOIN c USING (vec_id) GROUP BY w.vec_id""")
def edge_copies(spark, sf_dir):
    """Copies whose border runs through the subject; sources that no cut fits have none."""
    made = generate.make(generate.plan(wide(spark, sf_dir), "vec_id", "edge"), ["copy_id"], "a", SIDE, generate.edge_copy)
    at = lambda test: F.exists(F.transform("a8", lambda a, i: (a > 127) & test(i)), lambda x: x)
    border = at(lambda i: (i % F.col("width") == 0) | (i % F.col("width") == F.col("width") - 1) | (i < F.col("width")) | (i >= F.col("width") * (F.col("height") - 1)))
    return made.select("copy_id", F.col("a8").isNotNull().alias("cut"), F.coalesce(border, F.lit(False)).alias("touches"))


@query(f"{WIDE} SELECT label, count(*) AS n, 64 * count(*) AS pixels, true AS sound FROM (SELECT label, unnest(range(CASE WHEN label < 3 THEN 3 WHEN label = 3 THEN 0 ELSE 1 END)) FROM w JOIN embeddings USING (vec_id)) GROUP BY label")
def composite_copies(spark, sf_dir):
    """Composites by the labels' multipliers, on backgrounds of the same size."""
    sources = wide(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    times = F.when(F.col("label") < 3, 3).when(F.col("label") == 3, 0).otherwise(1)
    made = generate.make(generate.plan(sources, "vec_id", "variant", times), ["copy_id", "label"], "a", SIDE, generate.composite_copy)
    sound = F.forall("a8", lambda a: (a >= 0) & (a <= 255)) & (F.size("rgb") == 3 * F.size("a8"))
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("a8")).alias("pixels"), F.min(sound).alias("sound"))


@query("SELECT vec_id || '_f00' AS copy_id, true AS kept, true AS capped FROM embeddings")
def effects_copies(spark, sf_dir):
    """Light effects: the subject's alpha never falls, light outside it stays at 90 % or less."""
    made = generate.make(generate.plan(wide(spark, sf_dir), "vec_id", "effects"), ["copy_id", "a"], "a", SIDE, generate.effects_copy)
    both = F.zip_with("a", "a8", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return made.select("copy_id", F.forall(both, lambda x: x["b"] >= x["a"]).alias("kept"), F.forall(both, lambda x: (x["b"] == x["a"]) | (x["b"] <= 230)).alias("capped"))


# --- files of pairs, results and shards


@query("""WITH c AS (SELECT d.source, count(*) AS n, count(*) FILTER (l.doc_id IS NOT NULL) AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT *, max(n) OVER () AS most FROM c)
SELECT source AS stage, CASE WHEN n * 4 < most THEN 'skipped' WHEN known = 0 THEN 'failed' ELSE 'done' END AS state, CASE WHEN n * 4 < most OR known > 0 THEN NULL ELSE 'ValueError: ' || n || ' rows, none is known' END AS detail,
  CASE WHEN n * 4 >= most AND known > 0 THEN n END AS rows FROM s""")
def staged_job(spark, sf_dir):
    """A stage for each source of the documents: small ones count as done, one without a toxic label fails, the others write their manifest."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("known", F.lit(1))
    counts = docs.join(toxic, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known")).collect()
    path, most = scratch(spark, "staged"), max((r["n"] for r in counts), default=0)

    def write(source: str, n: int, known: int):
        if not known:
            raise ValueError(f"{n} rows, none is known")
        own = docs.where(F.col("source") == source).select("doc_id", "source")
        own.write.mode("append").parquet(path)

    steps = [stages.Stage(r["source"], functools.partial(write, r["source"], r["n"], r["known"]), done=functools.partial(operator.lt, r["n"] * 4, most), tolerant=True) for r in counts]
    log = stages.stage_log(spark, stages.run_stages(steps))
    written = spark.read.schema("doc_id long, source string").option("ignoreMissingFiles", "true").parquet(path).groupBy(F.col("source").alias("stage")).agg(F.count(F.lit(1)).alias("rows"))
    return log.join(written, "stage", "left").select("stage", "state", "detail", "rows")


@query(f"WITH {RESULTS} SELECT model, label, CASE WHEN model = 'binary' THEN mae / 2 ELSE mae END AS mae FROM r WHERE model <> 'binary' OR label < 5")
def result_files(spark, sf_dir):
    """Results written by model, then one model again: its old rows go, the others stay."""
    path = scratch(spark, "results")
    old = results(spark, sf_dir)
    export.write_results(old, path)
    export.write_results(old.where("model = 'binary' AND label < 5").withColumn("mae", F.col("mae") / 2), path)
    return export.read_results(spark, path).select("model", "label", "mae")


@query(f"WITH m AS ({A8}) SELECT vec_id, 8 AS height, 8 AS width, round(len(list_filter(a8, lambda a: a * 100 > 1275 AND a * 100 < 24225)) / 64, 6) AS soft_ratio FROM m")
def export_pairs(spark, sf_dir):
    """An export in two calls, the second over all rows: what is there is not written again."""
    rows = alphas(spark, sf_dir).select("vec_id", F.flatten(F.transform("a8", lambda a: F.array(a, a, a))).alias("rgb"), "a8", F.lit(SIDE).alias("w"))
    pairs = export.encoded_pairs(rows, "vec_id", "rgb", "a8", "w")
    path = scratch(spark, "export")
    export.export_split(pairs.where("vec_id % 2 = 0"), "vec_id", path, "TRAIN")
    export.export_split(pairs, "vec_id", path, "TRAIN")
    return spark.read.parquet(path).select("vec_id", "height", "width", F.round("soft_ratio", 6).alias("soft_ratio"))


@query("SELECT 'TRAIN_shard_' || lpad(CAST(s AS VARCHAR), 2, '0') || '.tar' AS name, count(*) AS pairs, count(*) * 2 AS members FROM (SELECT (row_number() OVER (ORDER BY page_id) - 1) // 100 AS s FROM pages) GROUP BY s")
def tar_shards(spark, sf_dir):
    """Pages as pairs of tar members, shards of 100; members are counted by reading the tars again."""
    path = scratch(spark, "tars")
    placed = sampling.global_rank(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    shard = tx.shard_name(F.floor(F.col("rank") / 100).cast("int"))
    stem = F.format_string("%06d", F.col("rank"))
    pair = F.array(F.struct(F.concat(F.lit("gt/"), stem).alias("member"), F.encode("url", "UTF-8").alias("content")), F.struct(F.concat(F.lit("im/"), stem).alias("member"), F.encode("html", "UTF-8").alias("content")))
    members = placed.select(shard.alias("shard"), F.explode(pair).alias("m")).select("shard", "m.member", "m.content")
    manifests.write_tars(members, path).write.parquet(f"{path}-manifest")
    entries = spark.read.parquet(f"{path}-manifest")
    found = manifests.read_archives(spark, path, "tar").groupBy(F.regexp_extract("archive", "([^/]+)$", 1).alias("name")).agg(F.count("content").alias("members"))
    return entries.join(found, "name").select("name", "pairs", "members")


@query("SELECT name, problem FROM (SELECT 'w' || p_size AS name, 'missing' AS problem FROM part WHERE p_size % 7 = 0 UNION SELECT 'x' || p_size, 'unexpected' FROM part WHERE p_size < 5)")
def checkpoint_keys(spark, sf_dir):
    """Weights that a checkpoint lacks, and those it holds too many."""
    sizes = table(spark, sf_dir, "part").select("p_size")
    wanted = sizes.select(F.concat(F.lit("w"), "p_size").alias("name"))
    held = sizes.where("p_size % 7 <> 0").select(F.concat(F.lit("w"), "p_size").alias("name")).union(sizes.where("p_size < 5").select(F.concat(F.lit("x"), "p_size")))
    return export.key_difference(wanted, held, "name")


# --- whole plans


@query(f"WITH {SCORED}, x AS (SELECT * FROM s WHERE label < 8) SELECT model, CAST(label AS VARCHAR) AS category, count(*) AS n, round(sum(sad_i) / (sum(pixels) * 255), 6) AS mae FROM x GROUP BY ALL UNION ALL SELECT model, NULL, count(*), round(sum(sad_i) / (sum(pixels) * 255), 6) FROM x GROUP BY model")
def benchmark_run(spark, sf_dir):
    """Scoring of a run; pairs without ground truth (labels 8 and 9) are predicted but not scored."""
    pairs = scored_models(spark, sf_dir).select("model", F.col("label").cast("string").alias("category"), "pred", F.when(F.col("label") < 8, F.col("gt")).alias("gt"))
    return benchmark.run(pairs).select("model", "category", "n", "mae")


@query(f"WITH {RESULTS}, b AS (SELECT r.label, r.model, r.mae, x.mae AS base FROM r JOIN r x ON x.label = r.label AND x.model = 'raw') SELECT CAST(label AS VARCHAR) AS category, arg_min(model, mae) AS leader, min(mae) AS value, any_value(base) AS base, round(CASE WHEN any_value(base) = 0 THEN NULL ELSE 100 * (min(mae) - any_value(base)) / any_value(base) END, 4) AS delta_pct FROM b GROUP BY label")
def benchmark_comparison(spark, sf_dir):
    return benchmark.comparison(results(spark, sf_dir).select("model", F.col("label").cast("string").alias("category"), "mae"), "raw")


@query("SELECT lang AS category, '<figure><img src=\"' || arg_min(source, doc_id) || '\"><figcaption>' || min(doc_id) || '&amp;</figcaption></figure>' AS first_cell, count(*) AS cells FROM documents GROUP BY lang")
def gallery_by_category(spark, sf_dir):
    """One page part for each category; its first cell and its number of cells."""
    rows = table(spark, sf_dir, "documents").select("lang", F.format_string("%s&", "doc_id").alias("name"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("order"), "source")
    pages = benchmark.gallery(rows, "lang", "name", "source", "order")
    cells = F.split("html", "(?<=</figure>)(?=<figure>)")
    return pages.select(F.col("lang").alias("category"), cells[0].alias("first_cell"), F.size(cells).cast("long").alias("cells"))


@query(f"WITH {SCORED}, v AS (SELECT model, unnest(['sad', 'mae', 'mse']) AS metric, unnest([sad_i / 255000.0, sad_i / (255.0 * pixels), sq_i / (65025.0 * pixels)]) AS value FROM s) SELECT model, metric, round(avg(value), 6) AS mean, count(*) AS n FROM v GROUP BY ALL")
def metric_long(spark, sf_dir):
    """All metrics in long form; those that can't be measured on an image are absent for it."""
    long = kernels.all_metrics(scored_models(spark, sf_dir), ["model", "vec_id"], "pred", "gt", SIDE, 5, 1000)
    means = long.groupBy("model", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.where("metric IN ('sad', 'mae', 'mse') OR metric LIKE 'bg%'")


@query("SELECT lang AS category, count(*) AS total, round(quantile_cont(least(n_chars, doc_id + 100), 0.1), 6) AS p10, round(quantile_cont(least(n_chars, doc_id + 100), 0.5), 6) AS p50, round(quantile_cont(least(n_chars, doc_id + 100), 0.9), 6) AS p90, round(avg(l.quality / 2.0), 6) AS soft_ratio FROM documents d JOIN labels l USING (doc_id) GROUP BY lang")
def export_statistics(spark, sf_dir):
    """An export's statistics by category: rows with truth, short sides, soft-alpha ratios."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sized = rows.select(F.col("lang").alias("category"), F.col("n_chars").alias("width"), (F.col("doc_id") + 100).alias("height"), (F.col("quality") / 2.0).alias("soft_ratio"))
    return benchmark.export_statistics(sized, "category")


@query("SELECT event_type AS stage, arg_max(user_id, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY event_type")
def status_latest(spark, sf_dir):
    """The last state of each stage of a status log, and how many events it has."""
    place = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.max_by("user_id", place).alias("state"), F.count(F.lit(1)).alias("events"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'ValueError: no such text' END AS error FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 250)")
def capped_fetch(spark, sf_dir):
    """The first 250 rows through a function that may fail: an error is a column, not an end."""

    def load():
        def fetch(value):
            if int(value[0]) % 7 == 3:
                raise ValueError("no such text")
            return value

        return fetch

    rows = table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("doc_id").cast("double")).alias("image")).orderBy("doc_id").limit(250)
    return kernels.predict(rows, ["doc_id"], "image", load).select("doc_id", "error")

