"""Line dedup over overlapping three-line windows.

A text's lines that hold a word are numbered; every three consecutive ones are a window,
named by the MD5 of its lines. A global aggregation finds the first occurrence of each name
that occurs twice or more (partial aggregates keep hot windows small); every later occurrence
is routed back to its document, where overlapping windows are merged and their lines removed.
Windows are judged on the input, not on what is left.

Order of occurrences: doc_id, then the text's hash, then the place in the text. Defined
results: a null text has no lines and stays null; lines without a word are kept and belong to
no window; texts with fewer than three lines with words lose nothing; rows that repeat doc_id
and text are one document and stay equal; a null id comes before all others; texts of any
length are read whole; an empty table gives an empty result; columns of the input that are named
like an inner one keep their own values.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _windows(docs: DataFrame) -> DataFrame:
    """``(id, tie, place, name)`` for every window of the texts."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    numbered = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), lines.alias("l")).where(F.size("l") >= WIDTH)
    named = F.transform(F.sequence(F.lit(1), F.size("l") - (WIDTH - 1)), lambda i: F.unhex(F.md5(F.array_join(F.slice("l", i, WIDTH), "\n"))))
    return numbered.select("id", "tie", F.posexplode(named).alias("place", "name"))


def later_windows(docs: DataFrame) -> DataFrame:
    """``(id, tie, places)``: per document, the windows that occurred earlier."""
    windows = _windows(docs)
    at = F.struct("id", "tie", "place")
    first = windows.groupBy("name").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "first")
    later = windows.join(first, "name").where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("id", "tie").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _strip(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not places:
        return text, len(lines), 0
    worded = [i for i, line in enumerate(lines) if _WORD.search(line)]
    gone = {worded[p + k] for p in places for k in range(WIDTH)}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "__places"]
        at = batch.schema.get_field_index("text")
        places = batch.column(batch.schema.get_field_index("__places"))
        found = [_strip(t.as_py(), p.as_py()) for t, p in zip(batch.column(at), places, strict=True)]
        columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
        columns["text"] = pa.array([f[0] for f in found], batch.schema.field("text").type)
        columns["__n_lines"] = pa.array([f[1] for f in found], pa.int64())
        columns["__n_removed"] = pa.array([f[2] for f in found], pa.int64())
        columns["__sha256"] = pa.array([hashlib.sha256((f[0] or "").encode()).hexdigest() for f in found], pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows' lines taken out of ``text``.

    Adds ``__n_lines``, ``__n_removed`` and ``__sha256`` (of the text that is left).
    """
    found = later_windows(docs.select("doc_id", "text")).select(F.col("id").alias("__id"), F.col("tie").alias("__found_tie"), F.col("places").alias("__places"))
    tied = docs.withColumn("__tie", F.xxhash64("text"))
    joined = tied.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__found_tie")), "left").select(*docs.columns, "__places")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_apply, f"{fields}, __n_lines bigint, __n_removed bigint, __sha256 string")


def line_report(docs: DataFrame) -> DataFrame:
    """Lines, removed lines and the digest of what is left, for each document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__sha256").alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` after line dedup; documents of which no word is left go."""
    left = dedup_lines(docs)
    return left.where((F.col("__n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


ORACLE = r"""
WITH line AS (
  SELECT doc_id, i, l, regexp_matches(l, '[^\x20\x09-\x0D]') AS worded FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
full_line AS (SELECT doc_id, i, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM line WHERE worded),
win AS (
  SELECT doc_id, k, l || chr(10) || lead(l) OVER w || chr(10) || lead(l, 2) OVER w AS win FROM full_line WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS rn FROM win WHERE win IS NOT NULL) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, k + unnest([0, 1, 2]) AS k FROM late),
kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(g.k) AS n_removed, coalesce(string_agg(n.l, chr(10) ORDER BY n.i) FILTER (WHERE g.k IS NULL), '') AS txt
  FROM line n LEFT JOIN full_line f ON n.doc_id = f.doc_id AND n.i = f.i LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.k = g.k GROUP BY n.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
