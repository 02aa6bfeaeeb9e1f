"""More registered queries: draws, ordered pairs, archives, shards, versions, upserts, layouts, boxes, monitors."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaline.catalog import PIXELS, SHARES, SIDE, alphas, query
from alphaline.functions import tables
from alphaline.functions import text as tx
from alphaline.operators import draws, layouts, morphology, sampling, scans
from alphaline.sources import archives, durable, pairs, tarsink
from alphaline.sources.scratch import scratch
from alphaline.sources.tables import table
from alphaline.streaming import monitor, upserts

# --- an epoch's samples


def _uniform_sql(seed: int, at: str) -> str:
    return f"CAST(('0x' || substr(sha256('{seed}:' || {at}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


_EPOCH = f"""c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), o AS (SELECT sum(n) AS n FROM c WHERE lang NOT IN ('fr', 'es')),
w AS (SELECT lang, c.n, CASE lang WHEN 'fr' THEN 0.3::DOUBLE / c.n WHEN 'es' THEN 0.25::DOUBLE / c.n ELSE (1 - 0.55::DOUBLE) / o.n END AS w FROM c, o),
s AS (SELECT lang, n, CAST(round(round(w * n / sum(w * n) OVER (), 9) * 1000000000) AS BIGINT) AS parts FROM w),
b AS (SELECT lang, n, CAST(sum(parts) OVER (ORDER BY lang) AS BIGINT) - parts AS low, CAST(sum(parts) OVER (ORDER BY lang) AS BIGINT) AS high, CAST(sum(parts) OVER () AS BIGINT) AS total FROM s),
u AS (SELECT i AS draw, {_uniform_sql(43, "i")} AS u, {_uniform_sql(44, "i")} AS v FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS i)),
d AS (SELECT draw, lang, CAST(floor(v * n) AS BIGINT) AS at FROM u JOIN b ON CAST(floor(u * total) AS BIGINT) >= low AND CAST(floor(u * total) AS BIGINT) < high),
k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS at FROM documents WHERE lang IS NOT NULL)"""


def epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are documents, with the target shares of languages."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    shares = sampling.share_weights(docs.select("lang"), "lang", SHARES)
    return draws.item_draws(docs, "doc_id", "lang", shares, table(spark, sf_dir, "documents").count())


@query(f"WITH {_EPOCH} SELECT draw, d.lang, doc_id FROM d JOIN k ON d.lang = k.lang AND d.at = k.at")
def item_draws(spark, sf_dir):
    """The epoch's samples, draw by draw."""
    return epoch(spark, sf_dir)


@query(f"WITH {_EPOCH}, t AS (SELECT doc_id, count(*) AS times FROM d JOIN k ON d.lang = k.lang AND d.at = k.at GROUP BY doc_id) SELECT times, count(*) AS n_items FROM t GROUP BY times")
def draw_repeats(spark, sf_dir):
    """How many items an epoch draws once, twice, and so on."""
    return epoch(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("n_items"))


# --- ordered Parquet pairs


def _pair_files(spark: SparkSession, sf_dir: str, *columns) -> list[str]:
    """Documents as Parquet pairs in the order of their ids: two patterns, each of as many files as the session shuffles to."""
    path = scratch(spark, "pairs")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.struct(F.encode("text", "UTF-8").alias("bytes"), F.col("source").alias("path")).alias("image"), F.encode("source", "UTF-8").alias("mask"), *columns)
    middle = docs.agg(F.floor(F.avg("doc_id"))).first()[0]
    for part, chosen in (("a", F.col("doc_id") <= middle), ("b", F.col("doc_id") > middle)):
        rows.where(chosen).repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.parquet(f"{path}/{part}")
    return [f"{path}/a", f"{path}/b"]


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS number, 'docs_' || printf('%06d', row_number() OVER (ORDER BY doc_id) - 1) AS stem, strlen(text) AS image_bytes, sha256(source) AS truth FROM documents")
def ordered_pairs(spark, sf_dir):
    """Pairs numbered through the files of two patterns; none is missing."""
    files = _pair_files(spark, sf_dir)
    found = pairs.ordered_pairs(spark, "docs", files, expected=table(spark, sf_dir, "documents").count())
    return found.select("number", "stem", F.octet_length("image").cast("long").alias("image_bytes"), F.sha2("truth", 256).alias("truth"))


@query(r"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number, source || ' ' || (doc_id // 3) AS own FROM documents),
s AS (SELECT doc_id, number, 'docs_' || regexp_replace(own, '[^A-Za-z0-9_.-]+', '_', 'g') AS stem FROM d)
SELECT min(number) AS number, stem, arg_min(doc_id, number) AS doc_id FROM s GROUP BY stem""")
def named_pairs(spark, sf_dir):
    """Pairs with names of their own; of three neighbours of a source with one name the first counts."""
    name = F.concat("source", F.lit(" "), F.floor(F.col("doc_id") / 3), F.lit(".jpg")).alias("image_name")
    files = _pair_files(spark, sf_dir, name, F.col("doc_id").alias("own_id"))
    numbers = pairs.numbered_files(spark, files).select("number", F.col("own_id").alias("doc_id"))
    return pairs.ordered_pairs(spark, "docs", files).join(numbers, "number").select("number", "stem", "doc_id")


# --- archives and shards


def _shard_members(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Pages as pairs: the url is the truth, the page the image; shards of ``size`` pairs."""
    placed = sampling.global_rank(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    stem = F.format_string("%06d", F.col("page_id"))
    member = lambda folder, column: F.struct(F.concat(F.lit(f"{folder}/"), stem, F.lit(".txt")).alias("member"), F.encode(column, "UTF-8").alias("content"))
    group = F.format_string("g%d/", F.floor(F.col("rank") / size).cast("int") % 3)
    both = placed.select(tx.shard_name(F.floor(F.col("rank") / size).cast("int")).alias("shard"), group.alias("group"), F.explode(F.array(member("gt", "url"), member("im", "html"))).alias("m"))
    return both.select("shard", F.concat("group", "m.member").alias("member"), "m.content")


_SHARDED = "p AS (SELECT page_id, url, html, (row_number() OVER (ORDER BY page_id) - 1) // {size} AS s FROM pages)"


@query(f"""WITH {_SHARDED.format(size=60)}, m AS (SELECT s, unnest([strlen(url), strlen(html)]) AS n FROM p)
SELECT 'TRAIN_shard_' || printf('%02d', s) || '.tar' AS name, count(*) // 2 AS pairs, count(*) AS files, CAST((sum(512 + (n + 511) // 512 * 512) + 1024 + 10239) // 10240 * 10240 AS BIGINT) AS bytes FROM m GROUP BY s""")
def committed_shards(spark, sf_dir):
    """The manifest of tar shards, written when all of them were whole; a second run finds them so."""
    path = scratch(spark, "shards")
    members, n = _shard_members(spark, sf_dir, 60), table(spark, sf_dir, "pages").count()
    for _ in range(2):
        tarsink.write_shards(members, path, n)
    return tarsink.shard_entries(spark, path)


@query(f"WITH {_SHARDED.format(size=60)} SELECT 'g' || (s % 3) || '/im' AS folder, count(*) AS members, CAST(sum(strlen(html)) AS BIGINT) AS bytes, max(printf('%06d', page_id)) AS last_stem FROM p GROUP BY s % 3")
def archive_members(spark, sf_dir):
    """Images in tar shards, each shard read by several tasks; the pattern keeps truths out of the plan."""
    path = scratch(spark, "archives")
    tarsink.write_shards(_shard_members(spark, sf_dir, 60), path)
    found = archives.archive_members(spark, path, pattern="/im/", split_bytes=1 << 16)
    return found.where("error IS NULL").groupBy("folder").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"), F.max("stem").alias("last_stem"))


@query(f"WITH {_SHARDED.format(size=60)} SELECT 'g' || (s % 3) || '_' || printf('%06d', page_id) AS stem, sha256(html) AS image, url AS truth FROM p")
def archive_pairs(spark, sf_dir):
    """Pairs made inside the folders of tar shards, with the folder's name before the stem."""
    path = scratch(spark, "archives")
    tarsink.write_shards(_shard_members(spark, sf_dir, 60), path)
    found = archives.folder_pairs(archives.archive_members(spark, path, split_bytes=1 << 18))
    return found.select("stem", F.sha2("image", 256).alias("image"), F.decode("truth", "UTF-8").alias("truth"))


# --- versions, audits and upserts


def _merged(spark: SparkSession, sf_dir: str, rule: str, first: DataFrame, second: DataFrame, bad: DataFrame, **more) -> DataFrame:
    """Growth of the second merge, and the keys of each side in the version that is current after a bad one was refused."""
    base = scratch(spark, "durable")
    durable.merge(spark, base, first, "doc_id", "replace", {side: n for side, n in first.groupBy("side").count().collect()})
    sides = durable.merge(spark, base, second, "doc_id", rule, **more)
    try:
        durable.merge(spark, base, bad, "doc_id", rule, **more)
    except durable.Refused:
        pass
    told = spark.createDataFrame([(side, n["before"], n["added"], n["overwritten"]) for side, n in sides.items()], "side string, before long, added long, overwritten long")
    now = durable.read(spark, base).groupBy("side").agg(F.countDistinct("doc_id").alias("now"), F.sum("n_chars").alias("chars"))
    return told.join(now, "side")


def _files(spark: SparkSession, sf_dir: str, sides=("im", "gt", "manifest")) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.select(F.explode(F.array(*map(F.lit, sides))).alias("side"), "doc_id", "n_chars")


_MERGE_SQL = """WITH f AS (SELECT unnest({sides}) AS side, doc_id, n_chars FROM documents),
o AS (SELECT * FROM f WHERE {old}), n AS (SELECT side, doc_id, {chars} AS n_chars FROM f WHERE {new}),
v AS (SELECT side, doc_id, coalesce(n.n_chars, o.n_chars) AS n_chars, o.doc_id IS NOT NULL AS was, n.doc_id IS NOT NULL AS is_new FROM o FULL JOIN n USING (side, doc_id))
SELECT side, count(*) FILTER (was) AS before, count(*) FILTER (NOT was) AS added, count(*) FILTER (was AND is_new) AS overwritten, count(*) AS now, CAST(sum(n_chars) AS BIGINT) AS chars FROM v GROUP BY side"""
_ALL = "['im', 'gt', 'manifest']"


@query(_MERGE_SQL.format(sides=_ALL, old="doc_id % 3 <> 0", new="doc_id % 3 = 0", chars="n_chars"))
def merge_add_only(spark, sf_dir):
    """Rule of additions: a third of the files comes to the others; a second merge that overwrites is refused."""
    files = _files(spark, sf_dir)
    return _merged(spark, sf_dir, "add", files.where("doc_id % 3 <> 0"), files.where("doc_id % 3 = 0"), files.where("doc_id % 5 = 0"))


@query(_MERGE_SQL.format(sides="['im', 'gt']", old="doc_id % 3 <> 0", new="doc_id % 2 = 0", chars="n_chars + 1"))
def merge_by_sides(spark, sf_dir):
    """Rule of sides: half of the files, old and new; a merge that brings images without truths is refused."""
    files = _files(spark, sf_dir, ("im", "gt"))
    half = files.where("doc_id % 2 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    return _merged(spark, sf_dir, "sides", files.where("doc_id % 3 <> 0"), half, files.where("side = 'im'"))


@query(_MERGE_SQL.format(sides="['im', 'gt']", old="doc_id % 3 <> 0", new="doc_id % 4 = 1", chars="n_chars + 2"))
def merge_in_place(spark, sf_dir):
    """Rule of overwriting: a quarter of the files again; a merge of keys outside the quarter is refused."""
    files = _files(spark, sf_dir, ("im", "gt"))
    quarter = files.where("doc_id % 4 = 1").withColumn("n_chars", F.col("n_chars") + 2)
    return _merged(spark, sf_dir, "overwrite", files.where("doc_id % 3 <> 0"), quarter, files, allowed=quarter)


@query("SELECT unnest(['im', 'gt']) AS side, count(*) AS now, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 3 <> 0")
def merge_rolled_back(spark, sf_dir):
    """Rule of replacement: all files instead of two thirds, then back; one with wrong counts is refused."""
    base, files = scratch(spark, "durable"), _files(spark, sf_dir, ("im", "gt"))
    for chosen in (files.where("doc_id % 3 <> 0"), files):
        n = chosen.where("side = 'im'").count()
        durable.merge(spark, base, chosen, "doc_id", "replace", {"im": n, "gt": n})
    try:
        durable.merge(spark, base, files.where("doc_id < 10"), "doc_id", "replace", {"im": n, "gt": n})
    except durable.Refused:
        durable.rollback(spark, base)
    return durable.read(spark, base).groupBy("side").agg(F.count(F.lit(1)).alias("now"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def upsert_stream(spark, sf_dir):
    """Each user's last event, merged from a stream of about five batches into hash buckets; a repeated batch changes nothing."""
    path = scratch(spark, "upserts")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events.repartition(width, "event_id").write.parquet(f"{path}/in")
    upserts.upsert_stream(spark, f"{path}/in", "event_id long, user_id long, event_type string, value double", "user_id", "event_id", f"{path}/table", f"{path}/mark", buckets=16, files=-(-width // 5))
    upserts.upsert(spark, f"{path}/table", events.withColumn("value", F.lit(-1.0)), 0, "user_id", "event_id")
    return upserts.read_table(spark, f"{path}/table")


# --- layouts, boxes, table functions, early ends, monitors


@query("""WITH i AS (SELECT DISTINCT 'data/' || source || '/Images' AS d, doc_id FROM documents WHERE source IS NOT NULL), g AS (SELECT DISTINCT 'data/' || lang || '/gt' AS d, doc_id FROM documents WHERE lang IS NOT NULL AND doc_id % 3 <> 0),
bi AS (SELECT d FROM i GROUP BY d HAVING count(*) >= 10), bg AS (SELECT d FROM g GROUP BY d HAVING count(*) >= 10),
o AS (SELECT i.d AS img_dir, g.d AS gt_dir, count(*) AS overlap FROM i JOIN g USING (doc_id) WHERE i.d IN (FROM bi) AND g.d IN (FROM bg) GROUP BY 1, 2),
s AS (SELECT *, CAST((CASE WHEN regexp_extract(lower(img_dir), '[^/]*$') LIKE '%image%' THEN 2 ELSE 0 END) + (CASE WHEN regexp_extract(lower(gt_dir), '[^/]*$') LIKE '%gt%' THEN 2 ELSE 0 END) + (CASE WHEN lower(img_dir) LIKE '%train%' THEN 1 ELSE 0 END) AS INTEGER) AS bonus FROM o),
r AS (SELECT row_number() OVER (ORDER BY overlap DESC, bonus DESC, img_dir, gt_dir) AS rank, * FROM s)
SELECT CAST(rank AS INTEGER) AS rank, img_dir, gt_dir, overlap, bonus, coalesce((SELECT count(*) = 1 FROM (SELECT DISTINCT overlap, bonus FROM r WHERE rank <= 2)) AND (SELECT count(*) > 1 FROM r), false) AS ambiguous FROM r WHERE rank <= 5""")
def layout_candidates(spark, sf_dir):
    """Documents as images in a folder for each source and truths in one for each language."""
    docs = table(spark, sf_dir, "documents")
    image = docs.select(F.concat(F.lit("data/"), "source", F.lit("/Images/"), "doc_id", F.lit(".jpg")).alias("path"))
    truth = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("data/"), "lang", F.lit("/gt/"), "doc_id", F.lit(".png")).alias("path"))
    return layouts.discover(layouts.folder_files(image.union(truth), "path", depth=4))


@query(f"""WITH {PIXELS}, k AS (SELECT unnest([2, 3, 6]) AS box),
w AS (SELECT p.vec_id, box, p.pos, min(q.a) AS e, max(q.a) AS d FROM px p, k JOIN px q ON q.vec_id = p.vec_id AND q.y >= p.y - box // 2 AND q.y < p.y - box // 2 + box AND q.x >= p.x - box // 2 AND q.x < p.x - box // 2 + box GROUP BY 1, 2, 3)
SELECT vec_id, CAST(box AS INTEGER) AS box, CAST(sum(e) AS BIGINT) AS eroded, CAST(sum(d) AS BIGINT) AS dilated, CAST(sum(e * (pos + 1)) AS BIGINT) AS eroded_at, CAST(sum(d * (pos + 1)) AS BIGINT) AS dilated_at FROM w GROUP BY 1, 2""")
def box_extremes(spark, sf_dir):
    """Alpha maps eroded and dilated with odd and even boxes; sums, and sums weighted by the pixel's place."""
    made = morphology.box_extremes(alphas(spark, sf_dir), ["vec_id"], "a8", SIDE, (2, 3, 6))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    placed = lambda c: total(F.transform(c, lambda x, i: x.cast("long") * (i + 1)))
    return made.select("vec_id", "box", total(F.col("eroded").cast("array<long>")).alias("eroded"), total(F.col("dilated").cast("array<long>")).alias("dilated"), placed("eroded").alias("eroded_at"), placed("dilated").alias("dilated_at"))


@query("""WITH c AS (SELECT doc_id AS id, lang, unnest(range(-1, doc_id % 3)) AS k, doc_id % 5 = 0 AS fifth FROM documents),
n AS (SELECT id, lang, k, id || (CASE WHEN k < 0 THEN '_o00' ELSE '_v' || printf('%02d', k) END) AS copy_id, CASE WHEN k < 0 THEN 'original' ELSE 'variant' END AS kind FROM c WHERE NOT (fifth AND k = 0))
SELECT id, lang, copy_id, kind, CAST(row_number() OVER (PARTITION BY lang ORDER BY id, k) - 1 AS INTEGER) AS number FROM n""")
def planned_copies(spark, sf_dir):
    """A table function from SQL: copies still to be made, numbered inside a language; some are done."""
    tables.register(spark)
    docs = table(spark, sf_dir, "documents")
    done = F.when(F.col("doc_id") % 5 == 0, F.array(F.concat("doc_id", F.lit("_v00"))))
    rows = docs.select(F.col("doc_id").alias("id"), "lang", (F.col("doc_id") % 3).cast("int").alias("n_copies"), done.alias("done"))
    return spark.sql("SELECT * FROM plan_copies(TABLE(SELECT * FROM {rows}) PARTITION BY lang ORDER BY id)", rows=rows)


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE n_chars % 4 = 1 ORDER BY sha256('42:' || doc_id), doc_id LIMIT 25")
def accepted_in_order(spark, sf_dir):
    """The first 25 documents in hash order that a costly test accepts; slices of the order are judged until there are enough."""
    path = scratch(spark, "accepted")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    judge = lambda rows: rows.where("n_chars % 4 = 1").withColumn("digest", F.sha2("text", 256))

    def store(rows):
        at = f"{path}/{uuid.uuid4().hex}"
        rows.select("doc_id", "order", "digest").write.parquet(at)
        return spark.read.parquet(at)

    return scans.accepted_in_order(docs, "doc_id", 25, judge, store).select("doc_id", "digest")


@query("""WITH n AS (SELECT event_type, value, row_number() OVER w AS n, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN n END) OVER (PARTITION BY event_type ORDER BY n) AS last FROM n),
e AS (SELECT event_type, count(*) AS polls, max(value) AS best, min(CASE WHEN n - last >= 6 THEN n END) AS stalled_at, min(CASE WHEN value >= 90 THEN n END) AS reached FROM g GROUP BY event_type)
SELECT event_type AS kind, polls, best, stalled_at, CASE WHEN reached <= coalesce(stalled_at, reached) THEN 'done' WHEN stalled_at IS NOT NULL THEN 'stalled' ELSE 'growing' END AS status FROM e""")
def watched_growth(spark, sf_dir):
    """A stream of polls that is resumed three times: done at 90, stalled after six polls without growth."""
    path = scratch(spark, "polls")
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [low + (high - low + 1) * k // 4 for k in range(5)]
    keep = lambda batch, no: batch.withColumn("batch", F.lit(no)).write.mode("append").parquet(f"{path}/out") and None
    for a, b in itertools.pairwise(cuts):
        events.where((F.col("event_id") >= a) & (F.col("event_id") < b)).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        told = monitor.watch(stream, "event_type", ["ts", "event_id"], "value", target=90.0)
        told.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/mark").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("kind").agg(F.max_by(F.struct("polls", "best", "stalled_at", "status"), "batch").alias("r"))
    return last.select("kind", "r.*")
