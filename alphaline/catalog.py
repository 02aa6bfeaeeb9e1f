"""Registered queries of the engine's own operators and their SQL.

The tables stand for the engine's data as follows: ``embeddings`` are 8x8 alpha maps, their
labels the categories and the lowest vec_id of a label its ground truth; ``documents`` is a
manifest, ``labels`` the rows with ground truth; ``orders`` number shards and checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaline.functions import alpha as al
from alphaline.functions import schedule
from alphaline.functions import text as tx
from alphaline.operators import kernels, manifest, metrics, sampling
from alphaline.sources.tables import table
from alphaline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


SIDE = 8


def alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, a8)``: embeddings as 8-bit alpha maps."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", F.transform("embedding", lambda v: al.quantise(v.cast("double") + 0.5)).alias("a8"))


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' predictions beside their label's ground truth."""
    maps = alphas(spark, sf_dir)
    truth = maps.groupBy("label").agg(F.min_by("a8", "vec_id").alias("gt"))
    joined = maps.join(truth, "label")
    models = F.map_from_arrays(F.array(*map(F.lit, ("raw", "binary", "inverted"))), F.array(F.col("a8"), al.binarise(F.col("a8")), al.invert(F.col("a8"))))
    return joined.select("vec_id", "label", "gt", F.explode(models).alias("model", "pred"))


A8 = "SELECT vec_id, label, list_transform(embedding, lambda v: CAST(round_even(least(greatest(0.5 + CAST(v AS DOUBLE), 0), 1) * 255, 0) AS INTEGER)) AS a8 FROM embeddings"
SCORED = f"""m AS ({A8}), t AS (SELECT label, arg_min(a8, vec_id) AS gt FROM m GROUP BY label),
p AS (SELECT vec_id, label, gt, unnest(['raw', 'binary', 'inverted']) AS model,
  unnest([a8, list_transform(a8, lambda a: CASE WHEN a >= 128 THEN 255 ELSE 0 END), list_transform(a8, lambda a: 255 - a)]) AS pred FROM m JOIN t USING (label)),
s AS (SELECT vec_id, label, model, len(pred) AS pixels, CAST(list_sum(list_transform(list_zip(pred, gt), lambda z: abs(z[1] - z[2]))) AS BIGINT) AS sad_i,
  CAST(list_sum(list_transform(list_zip(pred, gt), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS sq_i FROM p)"""
RESULTS = f"{SCORED}, r AS (SELECT model, label, round(sum(sad_i) / (sum(pixels) * 255), 6) AS mae FROM s GROUP BY model, label)"
PIXELS = f"m AS ({A8}), px AS (SELECT vec_id, label, pos, pos // 8 AS y, pos % 8 AS x, a8[pos + 1] AS a FROM m, (SELECT unnest(range(64)) AS pos))"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error by model and label."""
    return metrics.benchmark(metrics.score(scored_models(spark, sf_dir), "model", "label"), "model", "label").where("label IS NOT NULL").select("model", "label", "mae")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.long_form(alphas(spark, sf_dir), "a8", SIDE, "vec_id", "label")


@query(f"WITH {SCORED} SELECT model, label, count(*) AS n, CAST(sum(sad_i) AS BIGINT) AS sad_i, CAST(sum(sq_i) AS BIGINT) AS sq_i, round(sum(sad_i) / (sum(pixels) * 255), 6) AS mae FROM s GROUP BY GROUPING SETS ((model, label), (model))")
def alpha_benchmark(spark, sf_dir):
    return metrics.benchmark(metrics.score(scored_models(spark, sf_dir), "model", "label"), "model", "label")


@query(f"""WITH {SCORED}, c AS (SELECT model, label, sum(sad_i) AS s, sum(pixels) AS p FROM s GROUP BY model, label)
SELECT model, round(sum(s) / (sum(p) * 255), 6) AS micro_mae, round(avg(s / (p * 255)), 6) AS macro_mae FROM c GROUP BY model""")
def alpha_overall_vs_macro(spark, sf_dir):
    scored = metrics.score(scored_models(spark, sf_dir), "model", "label")
    cells = scored.groupBy("model", "label").agg(F.sum("sad_i").alias("s"), F.sum("pixels").alias("p"))
    return cells.groupBy("model").agg(F.round(F.sum("s") / (F.sum("p") * 255), 6).alias("micro_mae"), F.round(F.avg(F.col("s") / (F.col("p") * 255)), 6).alias("macro_mae"))


@query(f"WITH m AS ({A8}) SELECT label, round(avg(CAST(len(list_filter(a8, lambda a: a * 100 > 1275 AND a * 100 < 24225)) AS DOUBLE) / len(a8)), 6) AS soft_ratio FROM m GROUP BY label")
def soft_alpha_ratio(spark, sf_dir):
    return alphas(spark, sf_dir).groupBy("label").agg(F.round(F.avg(al.count_where(F.col("a8"), al.soft) / F.size("a8")), 6).alias("soft_ratio"))


@query(f"WITH m AS ({A8}), c AS (SELECT vec_id, len(list_filter(a8, lambda a: a * 100 >= 12750)) AS solid, len(list_filter(a8, lambda a: a * 100 > 1275 AND a * 100 < 24225)) AS soft FROM m) SELECT * FROM c WHERE solid * 100 >= 8 * 64 AND soft * 100 >= 8 * 64")
def mixed_opacity_ids(spark, sf_dir):
    counted = alphas(spark, sf_dir).select("vec_id", al.count_where(F.col("a8"), lambda a: a * 100 >= 12750).alias("solid"), al.count_where(F.col("a8"), al.soft).alias("soft"), F.size("a8").alias("n"))
    return counted.where("solid * 100 >= 8 * n AND soft * 100 >= 8 * n").select("vec_id", "solid", "soft")


@query(f"""WITH {SCORED}, q AS (SELECT model || ':' || vec_id AS k, model, label, pos // 8 AS y, pos % 8 AS x, pred[pos + 1] AS p, CAST(gt[pos + 1] < 100 AS INT) AS b FROM p, (SELECT unnest(range(64)) AS pos)),
h AS (SELECT *, CAST(sum(b) OVER (PARTITION BY k, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 AS INT) AS hh FROM q),
e AS (SELECT *, sum(hh) OVER (PARTITION BY k, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 AS e FROM h),
i AS (SELECT k, model, label, count(*) FILTER (e) AS n, coalesce(sum(p) FILTER (e), 0) AS s, count(*) FILTER (e AND p * 100 > 1275) AS m FROM e GROUP BY ALL)
SELECT model, label, round(avg(CASE WHEN n >= 2 THEN s / (n * 255) END), 6) AS bg_mae, round(avg(CASE WHEN n >= 2 THEN m / n END), 6) AS bg_smear, count(*) FILTER (n < 2) AS n_null FROM i GROUP BY model, label""")
def bg_residue(spark, sf_dir):
    flagged = scored_models(spark, sf_dir).withColumn("dark", F.transform("gt", lambda g: g < 100))
    each = kernels.background_residue(flagged, ["model", "label"], "pred", "dark", SIDE, 1, 2)
    return each.groupBy("model", "label").agg(F.round(F.avg("bg_mae"), 6).alias("bg_mae"), F.round(F.avg("bg_smear"), 6).alias("bg_smear"), F.count_if(F.col("bg_mae").isNull()).alias("n_null"))


@query(f"""WITH {PIXELS}, q AS (SELECT *, CAST(a < 140 AS INT) AS b FROM px),
h AS (SELECT *, sum(b) OVER w = 3 AS h0, sum(b) OVER w = count(*) OVER w AS h1 FROM q WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
e AS (SELECT vec_id, sum(CAST(h0 AS INT)) OVER w = 3 AS e0, sum(CAST(h1 AS INT)) OVER w = count(*) OVER w AS e1 FROM h WINDOW w AS (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT vec_id, count(*) FILTER (e0) AS n_erode, count(*) FILTER (e1) AS n_keep FROM e GROUP BY vec_id""")
def erosion_border_modes(spark, sf_dir):
    marked = alphas(spark, sf_dir).withColumn("dark", F.transform("a8", lambda a: a < 140))
    return kernels.eroded_sizes(marked, ["vec_id"], "dark", SIDE, 1)


@query(f"""WITH {SCORED}, q AS (SELECT model || ':' || vec_id AS k, model, label, pos // 8 AS y, pos % 8 AS x, pred[pos + 1] AS p, CASE WHEN gt[pos + 1] < 100 THEN 0 ELSE gt[pos + 1] END AS g FROM p, (SELECT unnest(range(64)) AS pos)),
h AS (SELECT *, sum(CAST(g = 0 AS INT)) OVER w = count(*) OVER w AS hh FROM q WINDOW w AS (PARTITION BY k, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
e AS (SELECT *, sum(CAST(hh AS INT)) OVER w = count(*) OVER w AS e FROM h WINDOW w AS (PARTITION BY k, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
o AS (SELECT k AS ok FROM q GROUP BY k HAVING count(*) FILTER (g * 100 > 1275 AND g * 100 < 24225) / count(*) <= 0.8)
SELECT model, label, count(ok) FILTER (e) AS n_bg, round(coalesce(avg(greatest((p / 255.0 - 0.5) * 8 - ln(0.05 / 0.95), 0)) FILTER (e AND ok IS NOT NULL), 0), 6) AS loss,
round(coalesce(avg(-ln(greatest(1 - 1 / (1 + exp(-(p / 255.0 - 0.5) * 8)), 1e-7))) FILTER (e), 0), 6) AS bce FROM e LEFT JOIN o ON k = ok GROUP BY model, label""")
def bg_hinge_value(spark, sf_dir):
    """The hinge over eroded true background of the samples that pass the soft-ratio gate, and the cross-entropy over all."""
    rows = scored_models(spark, sf_dir).select("model", "label", F.transform("pred", lambda p: (p / 255.0 - 0.5) * 8).alias("logit"), F.transform("gt", lambda g: F.when(g < 100, 0).otherwise(g)).alias("truth"))
    each = kernels.background_losses(rows, ["model", "label"], "logit", "truth", SIDE, 1, 0.05, 0.8)
    mean = lambda total, n: F.round(F.coalesce(F.try_divide(F.sum(total), F.sum(n)), F.lit(0.0)), 6)
    return each.groupBy("model", "label").agg(F.sum("gated").alias("n_bg"), mean("hinge", "gated").alias("loss"), mean("bce", "n_bg").alias("bce"))


@query(f"WITH {PIXELS} SELECT label, pos, round(sum(ln(1 - a / 2550.0)), 6) AS log_clear, round(1 - exp(sum(ln(1 - a / 2550.0))), 6) AS union_a FROM px GROUP BY label, pos")
def alpha_union(spark, sf_dir):
    """The union of all layers of a label; the logarithm tells large labels apart where the union nears 1."""
    layers = pixels(spark, sf_dir).withColumn("v", F.col("a") / 2550.0)
    return metrics.union_log(layers, "label", "pos", value="v").select("label", "pos", F.round("log_clear", 6).alias("log_clear"), F.round(1 - F.exp("log_clear"), 6).alias("union_a"))


@query(f"WITH {PIXELS} SELECT label, pos, max(a) AS max_a FROM px GROUP BY label, pos")
def instance_max_merge(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("label", "pos").agg(F.max("a").alias("max_a"))


@query(f"WITH {PIXELS} SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px WHERE a > 170 GROUP BY vec_id")
def alpha_bbox(spark, sf_dir):
    boxed = alphas(spark, sf_dir).select("vec_id", al.bounding_box(F.col("a8"), SIDE, 170).alias("box"))
    return boxed.where("box IS NOT NULL").select("vec_id", "box.*")


@query(f"WITH {PIXELS} SELECT vec_id, y // 4 AS cy, x // 4 AS cx, sum(a) / count(*) AS mean_a FROM px GROUP BY ALL")
def block_mean(spark, sf_dir):
    return kernels.block_mean(alphas(spark, sf_dir), ["vec_id"], "a8", SIDE, 4)


@query(f"WITH {RESULTS} SELECT label, model, mae FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY mae) AS rk FROM r) WHERE rk = 1")
def leader_per_category(spark, sf_dir):
    return metrics.leaders(results(spark, sf_dir), "label", "mae").select("label", "model", "mae")


@query(f"""WITH {RESULTS} SELECT r.label, r.model, r.mae AS value, b.mae AS base, round(CASE WHEN b.mae = 0 THEN NULL ELSE 100 * (r.mae - b.mae) / b.mae END, 4) AS delta_pct,
CASE WHEN b.mae IS NULL THEN 'n/a' WHEN r.mae < b.mae THEN 'better' WHEN r.mae > b.mae THEN 'worse' ELSE 'same' END AS verdict FROM r LEFT JOIN r b ON b.label = r.label AND b.model = 'raw'""")
def delta_vs_baseline(spark, sf_dir):
    return metrics.deltas(results(spark, sf_dir), "raw", "label", "model", "mae")


@query(f"WITH {RESULTS} SELECT model, label, mae, 'old' AS origin FROM r WHERE model NOT IN ('binary') UNION ALL SELECT model, label, mae / 2, 'new' FROM r WHERE model = 'binary' AND label < 5")
def merge_by_model(spark, sf_dir):
    old = results(spark, sf_dir)
    new = old.where("model = 'binary' AND label < 5").withColumn("mae", F.col("mae") / 2)
    return manifest.merge_by_model(old, new)


@query(f"""WITH RECURSIVE {PIXELS}, f AS (SELECT vec_id, pos, x, y FROM px WHERE a >= 128),
r AS (SELECT vec_id, pos, pos AS other FROM f UNION SELECT r.vec_id, r.pos, g.pos FROM r JOIN f o ON o.vec_id = r.vec_id AND o.pos = r.other JOIN f g ON g.vec_id = r.vec_id AND abs(g.x - o.x) + abs(g.y - o.y) = 1),
c AS (SELECT vec_id, pos, min(other) AS root FROM r GROUP BY vec_id, pos), z AS (SELECT vec_id, root, count(*) AS n FROM c GROUP BY vec_id, root)
SELECT m.vec_id, count(z.root) AS n_comp, coalesce(max(z.n), 0) AS largest FROM m LEFT JOIN z ON z.vec_id = m.vec_id GROUP BY m.vec_id""")
def conn_components(spark, sf_dir):
    return kernels.component_sizes(alphas(spark, sf_dir), "vec_id", "a8", SIDE, 128)


NEAR = " ".join(f"least(lab[p], CASE WHEN {inside} THEN lab[{at}] ELSE 99 END)," for inside, at in (("(p - 1) % 8 > 0", "p - 1"), ("(p - 1) % 8 < 7", "p + 1"), ("p > 8", "p - 8"), ("p <= 56", "p + 8")))


@query(f"""WITH RECURSIVE {SCORED}, c AS (SELECT row_number() OVER () AS k, model, vec_id, pred, gt FROM p),
z AS (SELECT 0 AS i, k, t, list_transform(range(1, 65), lambda p: CASE WHEN least(pred[p], gt[p]) / 255.0::DOUBLE >= t * 0.1::DOUBLE THEN p ELSE 99 END) AS lab FROM c, (SELECT unnest(range(1, 11)) AS t)),
r AS (SELECT * FROM z UNION ALL SELECT i + 1, k, t, list_transform(range(1, 65), lambda p: CASE WHEN lab[p] = 99 THEN 99 ELSE least({NEAR} 99) END) FROM r WHERE i < 40),
f AS (SELECT k, t, unnest(range(1, 65)) AS p, unnest(lab) AS root FROM r WHERE i = 40),
s2 AS (SELECT k, t, root, count(*) AS n FROM f WHERE root < 99 GROUP BY ALL),
core AS (SELECT k, t, root FROM s2 QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY n DESC, root) = 1),
held AS (SELECT f.k, f.t, f.p, core.root IS NOT NULL AS inside FROM f LEFT JOIN core ON f.k = core.k AND f.t = core.t AND f.root = core.root),
lev AS (SELECT k, p, coalesce(min(t) FILTER (NOT inside) - 1, 10) * 0.1::DOUBLE AS l FROM held GROUP BY k, p),
d AS (SELECT c.k, pred[lev.p] / 255.0::DOUBLE - l AS a, gt[lev.p] / 255.0::DOUBLE - l AS b FROM c JOIN lev ON c.k = lev.k),
e AS (SELECT k, round(sum(abs(CASE WHEN a >= 0.15 THEN a ELSE 0 END - CASE WHEN b >= 0.15 THEN b ELSE 0 END)) / 1000, 9) AS conn FROM d GROUP BY k)
SELECT model, vec_id, conn FROM c JOIN e ON c.k = e.k""")
def conn_error(spark, sf_dir):
    return kernels.pair_metrics(scored_models(spark, sf_dir), ["model", "vec_id"], "pred", "gt", SIDE, ("conn",))


@query(f"""WITH {SCORED}, tap AS (SELECT x, exp(-0.5 * pow(x / 1.4::DOUBLE, 2)) AS b FROM (SELECT unnest(range(-6, 7)) AS x)),
nt AS (SELECT x, b / sum(b) OVER () AS w, b / sum(b) OVER () * x / (1.4::DOUBLE * 1.4::DOUBLE) AS dw FROM tap),
m8 AS (SELECT i, CASE WHEN i + x < 0 THEN -(i + x) - 1 WHEN i + x > 7 THEN 15 - (i + x) ELSE i + x END AS j, sum(w) AS s, sum(dw) AS d FROM nt, (SELECT unnest(range(8)) AS i) GROUP BY ALL),
q AS (SELECT model, vec_id, pos // 8 AS y, pos % 8 AS x, pred[pos + 1] / 255.0::DOUBLE AS p, gt[pos + 1] / 255.0::DOUBLE AS g FROM p, (SELECT unnest(range(64)) AS pos)),
h AS (SELECT model, vec_id, y, i AS x, sum(s * p) AS ps, sum(d * p) AS pd, sum(s * g) AS gs, sum(d * g) AS gd FROM q JOIN m8 ON x = j GROUP BY ALL),
v AS (SELECT model, vec_id, i, x, sum(d * ps) AS py, sum(s * pd) AS px, sum(d * gs) AS gy, sum(s * gd) AS gx FROM h JOIN m8 ON y = j GROUP BY ALL)
SELECT model, vec_id, round(sum(pow(sqrt(px * px + py * py) - sqrt(gx * gx + gy * gy), 2)) / 1000, 9) AS grad FROM v GROUP BY ALL""")
def grad_error(spark, sf_dir):
    return kernels.pair_metrics(scored_models(spark, sf_dir), ["model", "vec_id"], "pred", "gt", SIDE, ("grad",))


def manifest_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    truth = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("gt/"), F.col("doc_id")).alias("gt_alpha"))
    return docs.join(truth, "doc_id", "left")


@query("""SELECT 'missing' AS violation, count(*) AS n FROM documents WHERE doc_id IS NULL OR lang IS NULL UNION ALL
SELECT 'unknown_category', count(*) FROM documents WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL
SELECT 'duplicate_id', count(*) FROM (SELECT doc_id FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id HAVING count(*) > 1)""")
def manifest_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    again = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    known = spark.createDataFrame([("en",), ("fr",), ("de",)], "category string")
    found = manifest.violations(docs.unionByName(again), "doc_id", "lang", known)
    once = manifest.violations(docs, "doc_id", "lang", known)
    return found.where("violation = 'duplicate_id'").unionByName(once.where("violation <> 'duplicate_id'"))


@query("SELECT lang, count(*) AS n_total, count(l.doc_id) AS n_gt FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def manifest_gt_filter(spark, sf_dir):
    rows = manifest_rows(spark, sf_dir)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_total"))
    usable = manifest.with_truth(rows, "gt_alpha").groupBy("lang").agg(F.count(F.lit(1)).alias("n_gt"))
    return counts.join(usable, "lang", "left").select("lang", "n_total", F.coalesce("n_gt", F.lit(0)).alias("n_gt"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g') AS s1, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS s2 FROM pages")
def sanitize_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.sanitise(F.col("url")).alias("s1"), tx.sanitise_stem(F.col("url")).alias("s2"))


TOKENS = "string_split(p_partkey || '_x_' || p_size || '_' || replace(p_name, ' ', '_'), '_')"


@query(f"""WITH k AS (SELECT p_partkey AS id, {TOKENS} AS t FROM part), n AS (SELECT id, t, list_filter(range(1, len(t) + 1), lambda i: regexp_full_match(t[i], '[0-9]+')) AS d FROM k)
SELECT id, CASE WHEN len(d) >= 2 THEN t[d[2] + 1] END AS token, CASE WHEN lower(CASE WHEN len(d) >= 2 THEN t[d[2] + 1] END) IN {tx.THIN_CLASSES} THEN 'thin' ELSE 'complex' END AS category FROM n""")
def token_class(spark, sf_dir):
    stems = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("_", F.col("p_partkey").cast("string"), F.lit("x"), F.col("p_size").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("stem"))
    token = tx.class_token(F.col("stem"))
    return stems.select("id", token.alias("token"), tx.thin_or_complex(token).alias("category"))


COPIES = "c AS (SELECT doc_id, lang, doc_id || '_o00' AS copy_id, 'original' AS kind FROM documents UNION ALL SELECT doc_id, lang, doc_id || '_v' || lpad(CAST(k AS VARCHAR), 2, '0'), 'variant' FROM (SELECT doc_id, lang, unnest(range(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 3 ELSE 1 END)) AS k FROM documents))"


def copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return manifest.expand_copies(docs, "doc_id", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 3).otherwise(1))


@query(f"""WITH {COPIES}, v AS (SELECT DISTINCT doc_id FROM c WHERE kind = 'variant' AND copy_id LIKE '%\\_v00' ESCAPE '\\' AND doc_id % 7 = 0)
SELECT CAST(c.doc_id AS VARCHAR) AS source_id, count(*) AS n_copies, bool_or(v.doc_id IS NOT NULL) AS excluded FROM c LEFT JOIN v USING (doc_id) GROUP BY c.doc_id""")
def strip_suffix_guard(spark, sf_dir):
    every = copies(spark, sf_dir)
    held_out = every.where("copy_id LIKE '%\\_v00' AND doc_id % 7 = 0")
    kept = manifest.guard_leaks(every, held_out, "copy_id").select("copy_id").withColumn("__kept", F.lit(True))
    return every.join(kept, "copy_id", "left").groupBy(tx.source_id(F.col("copy_id")).alias("source_id")).agg(F.count(F.lit(1)).alias("n_copies"), F.max(F.col("__kept").isNull()).alias("excluded"))


@query(f"WITH {COPIES} SELECT lang, kind, count(*) AS n FROM c GROUP BY lang, kind")
def expand_copies(spark, sf_dir):
    return copies(spark, sf_dir).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti(spark, sf_dir):
    return manifest.not_yet_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, 'old' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest_append_merge(spark, sf_dir):
    return manifest.append_merge(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT CASE WHEN r.doc_id IS NULL THEN 'left_only' WHEN l.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM documents l FULL OUTER JOIN labels r ON l.doc_id = r.doc_id GROUP BY 1")
def pair_audit(spark, sf_dir):
    return manifest.one_sided(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN d.doc_id % 4 = 0 THEN 'pending' WHEN l.doc_id IS NULL THEN 'add_row' ELSE 'skip' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY state")
def reconcile_three_way(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return manifest.reconcile(docs, docs.where("doc_id % 4 <> 0"), table(spark, sf_dir, "labels"), "doc_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT DISTINCT source, sha256(text) AS h FROM documents) SELECT a.source AS src_a, b.source AS src_b, count(*) AS overlap FROM n a JOIN n b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2")
def overlap_discovery(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return manifest.layout_overlaps(named, "source", "h").select(F.col("folder_a").alias("src_a"), F.col("folder_b").alias("src_b"), "overlap")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS s FROM c),
b AS (SELECT source, n, CAST(n * 137 // s AS BIGINT) AS base, CAST((n * 137) % s AS BIGINT) AS rest FROM c, t),
q AS (SELECT source, base + CAST(row_number() OVER (ORDER BY rest DESC, source) <= 137 - sum(base) OVER () AS BIGINT) AS quota FROM b),
r AS (SELECT d.source, row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id IS NULL, d.doc_id) AS rn FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT q.source, q.quota, count(r.rn) AS n_selected FROM q LEFT JOIN r ON q.source = r.source AND r.rn <= q.quota GROUP BY 1, 2""")
def edge_quota(spark, sf_dir):
    rows = manifest_rows(spark, sf_dir)
    quota = sampling.quotas(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", 137)
    taken = sampling.take_quota(rows, quota, "source", F.col("gt_alpha").isNull(), F.col("doc_id"))
    return quota.join(taken.groupBy("source").agg(F.count(F.lit(1)).alias("k")), "source", "left").select("source", "quota", F.coalesce("k", F.lit(0)).alias("n_selected"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM (SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE n_chars >= 1000 ORDER BY doc_id LIMIT 50)")
def first_n_eligible(spark, sf_dir):
    some = sampling.first_n(manifest_rows(spark, sf_dir), F.col("gt_alpha").isNotNull() & (F.col("n_chars") >= 1000), 50, "doc_id")
    return some.select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("rn"))


@query("SELECT 'TRAIN_shard_' || lpad(CAST(s AS VARCHAR), 2, '0') || '.tar' AS shard_name, count(*) AS pairs, min(k) AS min_key, max(k) AS max_key FROM (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 7000 AS s FROM orders) GROUP BY s")
def shard_assign(spark, sf_dir):
    return sampling.shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7000)


@query("SELECT 'epoch_' || o_orderkey || '.pth' AS name, CAST(o_orderkey AS INT) AS epoch, row_number() OVER (ORDER BY o_orderkey DESC) <= 3 AS keep FROM orders")
def retain_latest(spark, sf_dir):
    """Every order names a checkpoint and, beside it, a file that is none."""
    shown = F.array(F.concat(F.lit("epoch_"), "o_orderkey", F.lit(".pth")), F.concat(F.lit("epoch_x"), "o_orderkey", F.lit(".pth")))
    return sampling.retain(table(spark, sf_dir, "orders").select(F.explode(shown).alias("name")), "name", 3)


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey, CAST(5000 // n + CAST(row_number() OVER (ORDER BY p_partkey) <= 5000 % n AS INT) AS INT) AS n_copies FROM part, n")
def copy_distribution(spark, sf_dir):
    return sampling.spread_copies(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 5000)


@query("""WITH o AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem)
SELECT l_orderkey, CAST(coalesce(min(rn) FILTER (l_quantity < 20) - 1, count(*)) AS BIGINT) AS n_lead FROM o GROUP BY l_orderkey""")
def leading_run(spark, sf_dir):
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    numbered = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.row_number().over(place).alias("rn"))
    return numbered.groupBy("l_orderkey").agg(F.coalesce(F.min(F.when(F.col("l_quantity") < 20, F.col("rn"))) - 1, F.count(F.lit(1))).cast("long").alias("n_lead"))


@query("SELECT lang, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents GROUP BY lang")
def percentiles_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.round(F.percentile("n_chars", p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)])


SHARES = {"fr": 0.3, "es": 0.25}


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), o AS (SELECT sum(n) AS n FROM c WHERE lang NOT IN ('fr', 'es')),
w AS (SELECT lang, c.n, CASE lang WHEN 'fr' THEN 0.3::DOUBLE / c.n WHEN 'es' THEN 0.25::DOUBLE / c.n ELSE (1 - 0.55::DOUBLE) / o.n END AS w FROM c, o)
SELECT lang, n, round(w, 9) AS weight, round(w * n / sum(w * n) OVER (), 9) AS share FROM w""")
def sample_weights(spark, sf_dir):
    return sampling.share_weights(table(spark, sf_dir, "documents").select("lang"), "lang", SHARES)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER () * 0.02, 0)) THEN 'val' ELSE 'train' END AS split FROM documents")
def val_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.02)


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'val' ELSE 'train' END AS split FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l USING (doc_id)")
def persistent_split(spark, sf_dir):
    return sampling.persistent_split(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("""WITH c AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang), b AS (SELECT lang, sum(share) OVER (ORDER BY lang) - share AS low, sum(share) OVER (ORDER BY lang) AS high FROM c),
u AS (SELECT CAST(('0x' || substr(sha256('42:' || i), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM range(2000) t(i)) SELECT lang, count(*) AS n_draws FROM u JOIN b ON u.u >= b.low AND u.u < b.high GROUP BY lang""")
def weighted_draws(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return sampling.weighted_draws(spark, counts.select("lang", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share")), "lang", 2000)


@query("""WITH p AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, max(ts) AS last_ts, count(*) AS n, count(*) FILTER (value <= before) AS stalls FROM p GROUP BY event_type""")
def status_history(spark, sf_dir):
    before = F.lag("value").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    watched = table(spark, sf_dir, "events").select("event_type", "ts", "value", before.alias("before"))
    return watched.groupBy("event_type").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") <= F.col("before")).alias("stalls"))


@query("SELECT p_partkey, CAST(least(3, 4000 - 3 * (rn - 1)) AS INT) AS n_copies FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) WHERE 4000 - 3 * (rn - 1) > 0")
def copy_budget(spark, sf_dir):
    return sampling.budget_copies(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 3, 4000)


@query(r"SELECT stem, count(DISTINCT url) AS n_paths, min(url) AS first_path FROM (SELECT url, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM pages) GROUP BY stem HAVING count(DISTINCT url) > 1")
def duplicate_stems(spark, sf_dir):
    found = manifest.duplicate_stems(table(spark, sf_dir, "pages"), "url")
    return found.select("stem", F.size("paths").cast("long").alias("n_paths"), F.col("paths")[0].alias("first_path"))


@query("SELECT o_orderkey FROM orders ORDER BY sha256('42:' || o_orderkey), o_orderkey LIMIT 100")
def sample_in_order(spark, sf_dir):
    return sampling.sample_in_order(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders")
def global_row_number(spark, sf_dir):
    return sampling.global_rank(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def first_occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("less", -F.col("n_chars"))
    return manifest.first_occurrence(rows, "source", "less", "doc_id").drop("less")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def running_weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


@query(f"WITH {SCORED}, k AS (SELECT vec_id FROM embeddings ORDER BY sha256('42:' || vec_id), vec_id LIMIT 40) SELECT round(avg(sad_i), 6) AS mean, count(*) AS n FROM s WHERE model = 'binary' AND vec_id IN (SELECT vec_id FROM k)")
def quick_eval(spark, sf_dir):
    chosen = sampling.sample_n(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 40)
    scored = metrics.score(scored_models(spark, sf_dir).where("model = 'binary'"), "vec_id")
    return metrics.subset_mean(scored, chosen, "vec_id", "sad_i").select(F.round("mean", 6).alias("mean"), "n")


@query("""SELECT p_size, round(0.0001::DOUBLE * sqrt(p_size * 2 / 4.0::DOUBLE), 12) AS rate, round(pow(0.9::DOUBLE, p_size), 9) AS decay, p_size > 40 AS reweight
FROM (SELECT DISTINCT p_size FROM part)""")
def training_schedule(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    return sizes.select("p_size", F.round(schedule.effective_rate(F.lit(0.0001), F.col("p_size"), F.lit(2)), 12).alias("rate"), F.round(schedule.decay(F.col("p_size")), 9).alias("decay"), schedule.reweight(F.col("p_size"), F.lit(50), F.lit(10)).alias("reweight"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS cell FROM pages""")
def gallery_cells(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_escape(F.col("html")).alias("cell"))


@query("""WITH w AS (SELECT lang, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS w FROM labels JOIN documents USING (doc_id))
SELECT lang, round(sum(w) / (SELECT sum(w) FROM w), 9) AS share FROM w GROUP BY lang""")
def expected_share(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("w", F.when(F.col("quality") == 1, 2).otherwise(1))
    return sampling.expected_shares(rows, "lang", "w").select("lang", F.round("share", 9).alias("share"))


@query(f"WITH {SCORED}, x AS (SELECT unnest(['binary', 'ghost']) AS model) SELECT x.model, count(s.model) AS n, count(s.model) > 0 AS present FROM x LEFT JOIN s USING (model) GROUP BY x.model")
def present_models(spark, sf_dir):
    wanted = spark.createDataFrame([("binary",), ("ghost",)], "model string")
    counts = scored_models(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("k"))
    return wanted.join(counts, "model", "left").select("model", F.coalesce("k", F.lit(0)).alias("n"), F.col("k").isNotNull().alias("present"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def status_growth(spark, sf_dir):
    return jobs.growth(table(spark, sf_dir, "events"), "ts", "event_type").select("event_type", "start", "n")
