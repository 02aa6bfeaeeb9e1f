"""Benchmark decontamination: a prefix-filtered containment join in DataFrame operations.

Every benchmark item becomes windows of ``WINDOW`` consecutive words (a shorter item is one
window). A document contains a window only if it contains the window's rarest word, so one
word per window - the necessary prefix of an exact containment, ordered by how often words
occur in the whole corpus - is joined with the document words. Positional and length bounds
drop alignments that would leave the document; the rest are verified word by word. The
documents are read twice: for the words' counts and for the hits.

Up to ``MAX_BROADCAST_PAIRS`` (window, item) pairs are broadcast and verified on the document's
own array in the map stage. More are joined by a shuffle of the anchor words' occurrences, each
with the ``2 * WINDOW - 1`` words around it, behind a bitmap of the anchor words (at most
``2**MAX_BITMAP_BITS`` bits); AQE splits an anchor that is common in spite of its rank. In both
ways the hits and one marker row for each document are then grouped by document.

Defined results: null or empty texts have no words, are not contaminated and hash the empty
item list; texts of any length are judged whole; rows that repeat a doc_id, or are equal, are
judged one by one; of words that are equally rare the first by name, then by place, is the
anchor, which changes no result; items without words or without an id are ignored; without
items or documents the result is clean or empty; of the tables' columns only ``doc_id``,
``item_id`` and ``text`` are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaline.llm.shared import cut, lower_ascii, shuffle_partitions

WINDOW = 13
MAX_BROADCAST_PAIRS = 50_000
MAX_BITMAP_BITS = 26
#: Digests of contaminated texts that are broadcast (32 bytes each); more are joined by a shuffle.
MAX_BROADCAST_TEXTS = 100_000
#: Contaminated when at least one of this many words is hit.
HIT_DIVISOR = 20

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAPS), "")


def item_windows(items: DataFrame) -> DataFrame:
    """``(window, item_ids)``: the distinct word windows of the benchmark and their items."""
    split = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    each = split.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), WINDOW).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))


def anchored_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with its rarest word over all documents and that word's place in it."""
    spread = windows.select("window", "item_ids", F.posexplode("window").alias("place", "word"))
    vocabulary = spread.select("word").distinct()
    occurring = docs.select(F.explode(words(F.col("text"))).alias("word")).join(_bounded(vocabulary), "word", "left_semi")
    counts = occurring.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = spread.join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place"))
    return ranked.groupBy("window").agg(rarest.alias("a"), F.first("item_ids").alias("item_ids")).select("window", "item_ids", F.col("a.word").alias("anchor"), F.col("a.place").alias("place"), F.col("a.n").alias("n"))


def _bounded(table: DataFrame) -> DataFrame:
    """Broadcast a window-derived table only behind a count of its rows."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_PAIRS else table


def _marked(anchors: DataFrame, markers: int) -> DataFrame:
    """The anchors that occur, and ``markers`` rows without a window for the documents' own rows.

    A document's word 0 is the marker "#k": a hash sign is in no word.
    """
    marker = anchors.sparkSession.range(markers).select(F.concat(F.lit("#"), F.col("id")).alias("anchor"))
    known = anchors.where("n > 0").select("anchor", "place", "window", "item_ids")
    return known.unionByName(marker, allowMissingColumns=True)


def _spread(docs: DataFrame, markers: int) -> DataFrame:
    marker = F.array(F.concat(F.lit("#"), F.pmod("row_id", F.lit(markers))))
    return docs.select("row_id", "key", "w", F.posexplode(F.concat(marker, F.col("w"))).alias("at", "word"))


def _found(joined: DataFrame, first: Column, held: Column) -> DataFrame:
    """The verified occurrences, and the documents' marker rows.

    ``held`` are words of the document of which ``first`` is the place of the first.
    """
    start = F.col("at") - F.col("place")
    fits = (start >= 1) & (start + F.size("window") - 1 <= F.col("n_words"))
    same = F.when(fits, F.slice(held, start - first + 1, F.size("window")) == F.col("window"))
    span = F.when(F.col("window").isNotNull(), F.struct(start.alias("s"), (start + F.size("window")).alias("e")))
    return joined.where(F.col("window").isNull() | same).select("row_id", "key", "n_words", span.alias("span"), "item_ids")


def _hits_by_broadcast(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per document row one marker row, and a row for each verified window occurrence."""
    joined = _spread(docs, 1).join(F.broadcast(_marked(anchors, 1)), F.col("word") == F.col("anchor"))
    return _found(joined.withColumn("n_words", F.size("w").cast("long")), F.lit(1), F.col("w"))


def _hits_by_shuffle(docs: DataFrame, anchors: DataFrame, pairs: int) -> DataFrame:
    """The same by a shuffle join; only words that the bitmap may hold leave the map stage."""
    markers = 4 * shuffle_partitions(docs.sparkSession)
    table = _marked(anchors, markers)
    bits = min(MAX_BITMAP_BITS, max(12, int(16 * pairs).bit_length()))
    place = lambda word: F.xxhash64(word).bitwiseAND(F.lit((1 << bits) - 1))
    cell = lambda at: F.floor(at / 64).cast("int")
    ones = table.select(place(F.col("anchor")).alias("at")).distinct().groupBy(cell(F.col("at")).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("ones"))
    every = docs.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("cell")).join(ones, "cell", "left")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("ones", F.lit(0)).alias("ones")))).alias("cells"))
    bitmap = listed.select(F.col("cells.ones")).scalar()
    at = place(F.col("word"))
    maybe = F.call_function("shiftright", F.get(bitmap, cell(at)), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    near = F.greatest(F.col("at") - (WINDOW - 1), F.lit(1))
    chosen = _spread(docs, markers).where(maybe).select("row_id", "key", F.size("w").cast("long").alias("n_words"), "at", "word", near.alias("near"), F.slice("w", near, 2 * WINDOW - 1).alias("held"))
    return _found(chosen.join(table, F.col("word") == F.col("anchor")), F.col("near"), F.col("held"))


def _measured(source: DataFrame, items: DataFrame) -> DataFrame:
    """``(key, n_words, spans, item_ids)`` for every row of ``source(key, text)``; spans are sorted."""
    anchors = cut(anchored_windows(source, item_windows(items)), "op1-anchors")
    pairs = anchors.agg(F.sum(F.size("item_ids"))).first()[0] or 0
    split = source.select(F.monotonically_increasing_id().alias("row_id"), "key", words(F.col("text")).alias("w"))
    found = _hits_by_broadcast(split, anchors) if pairs <= MAX_BROADCAST_PAIRS else _hits_by_shuffle(split, anchors, pairs)
    return found.groupBy("row_id", "key").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Words, hit words and contained items for every row of ``docs``."""
    grouped = _measured(docs.select(F.col("doc_id").alias("key"), "text"), items)
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))
    merged = F.aggregate("spans", zero, lambda acc, s: F.struct(F.greatest(acc["upto"], s["e"]).alias("upto"), (acc["total"] + F.greatest(s["e"] - F.greatest(s["s"], acc["upto"]), F.lit(0))).alias("total")))
    listed = F.sort_array(F.transform("item_ids", lambda x: x.cast("string")))
    return grouped.select(
        F.col("key").alias("doc_id"),
        "n_words",
        merged["total"].alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((merged["total"] > 0) & (HIT_DIVISOR * merged["total"] >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, however long the text.

    Rows are told apart by their text alone (SHA-256), so a null or repeated doc_id neither keeps
    a contaminated row nor drops a clean one. Null texts stay.
    """
    digest = F.unhex(F.sha2("text", 256))
    hit = _measured(docs.select(digest.alias("key"), "text"), items).where("size(spans) > 0")
    bad = cut(hit.select(F.col("key").alias("__digest")).distinct(), "op1-bad")
    small = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_TEXTS else bad
    return docs.join(small, digest == F.col("__digest"), "left_anti")


ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lens AS (SELECT DISTINCT len(win) AS l FROM win),
place AS (
  SELECT rid, i, l, list_slice(w, i, i + l - 1) AS win
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM doc, lens WHERE len(w) >= l)),
hit AS (SELECT p.rid, p.i, p.l, x.item_id FROM place p JOIN win x ON p.win = x.win),
cover AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS j FROM (SELECT DISTINCT rid, i, l FROM hit)) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN cover c USING (rid) LEFT JOIN found f USING (rid)
"""
