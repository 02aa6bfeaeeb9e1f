"""Repetition coverage: quality rules from duplicated n-grams and lines.

Rolling hashes of several n-gram lengths are computed in NumPy over whole texts; every
character that lies in an n-gram, or a line, found twice or more in its own text counts as
covered. A text fails when a covered share passes that length's limit. The work is one map
over the rows: no shuffle, memory bounded by the chunk size (or one text, if longer).

Defined results: a null or empty text has no words, fails the base rules and is rejected; texts
of any length are measured whole; ties cannot occur, as nothing is ranked; rows are judged one by
one, so null and repeated ids and equal rows change nothing; an empty table gives an empty
result; columns of the input named like a measure keep their own values in ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm import textcore as tc

#: n-gram length -> largest allowed share of word characters inside duplicated n-grams.
NGRAM_LIMITS = {5: 0.45, 8: 0.35, 10: 0.30}
#: Largest allowed share of word characters inside lines equal to another line.
LINE_LIMIT = 0.40
MIN_WORDS = 20
BASE_NGRAM = 8
BASE_REPEAT_PERCENT = 30

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (*(f"dup_{n}gram_share" for n in NGRAM_LIMITS), "dup_line_share")


def _repeated(keys: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each key: occurs twice or more; has an equal before it (the earlier one, if ``stable``)."""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable" if stable else None)
    ordered = keys[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    later[order[same + 1]] = True
    twice[order[same + 1]] = True
    twice[order[same]] = True
    return twice, later


def _chunk_measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    starts, ends, first = tc.word_spans(data, offsets)
    row_of_word = np.repeat(np.arange(rows), np.diff(first))
    salt = tc.mix(np.arange(1, rows + 1, dtype=np.uint64))
    hashes = tc.span_hashes(data, starts, ends)

    code_points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=code_points[1:])
    chars = code_points[ends] - code_points[starts]
    out = {"n_words": np.diff(first), "word_chars": tc.row_sums(chars, first), "n_symbols": tc.row_sums(_SYMBOLS[data], offsets)}
    total = np.maximum(out["word_chars"], 1)

    for n in NGRAM_LIMITS:
        windows = tc.window_hash(hashes, n)
        inside = tc.window_rows(first, n, len(hashes))
        twice = np.zeros(len(windows), bool)
        at = np.flatnonzero(inside)
        twice[at] = _repeated(windows[at] ^ salt[row_of_word[at]])[0]
        hit = tc.covered(twice, n, len(hashes))
        out[f"dup_{n}gram_share"] = tc.row_sums(chars * hit, first) / total
        if n == BASE_NGRAM:
            out["n_repeat_words"] = tc.row_sums(hit, first)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    line_rows = np.searchsorted(offsets[1:], line_ends, side="left")
    word_from, word_to = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    kept = np.flatnonzero(word_to > word_from)
    line_rows, line_starts, line_ends = line_rows[kept], line_starts[kept], line_ends[kept]
    twice, later = _repeated(tc.span_hashes(data, line_starts, line_ends) ^ salt[line_rows], stable=True)
    out["n_dup_lines"] = np.bincount(line_rows, later, rows).astype(np.int64)
    chars_before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = chars_before[word_to[kept]] - chars_before[word_from[kept]]
    out["dup_line_share"] = np.bincount(line_rows, line_chars * twice, rows) / total
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tc.utf8(batch.column(batch.num_columns - 1))
        for row, stop, part, local in tc.chunks(data, offsets):
            found = _chunk_measures(part, local)
            base = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > BASE_REPEAT_PERCENT * found["n_words"])
            bad = base | (found["dup_line_share"] > LINE_LIMIT)
            for n, limit in NGRAM_LIMITS.items():
                bad |= found[f"dup_{n}gram_share"] > limit
            columns = [*(batch.column(i).slice(row, stop - row) for i in range(batch.num_columns))]
            columns += [pa.array(found[k].astype(np.int64)) for k in COUNTS] + [pa.array(found[k].astype(np.float64)) for k in SHARES] + [pa.array(base), pa.array(~bad)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *COUNTS, *SHARES, "base_failed", "kept"])


def measure(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """``docs[keep]``, its text, and the measures and verdicts of the quality rules."""
    chosen = docs.select(*[F.col(k) for k in keep if k != text], F.col(text))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields] + [f"{k} bigint" for k in COUNTS] + [f"{k} double" for k in SHARES] + ["base_failed boolean", "kept boolean"])
    return chosen.mapInArrow(_measure, fields)


def quality_report(docs: DataFrame) -> DataFrame:
    """The rules' counts, shares and verdict for each document."""
    return measure(docs, keep=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept", *[F.round(k, 6).alias(k) for k in SHARES])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    if clash := {c for c in docs.columns} & {*COUNTS, *SHARES, "base_failed", "kept"}:
        back = {c: f"__own_{c}" for c in clash}
        return keep_good(docs.withColumnsRenamed(back)).withColumnsRenamed({v: k for k, v in back.items()}).select(docs.columns)
    return measure(docs, keep=docs.columns).where("kept").select(docs.columns)


def _gram_sql(n: int) -> str:
    return f"""g{n} AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM (SELECT r, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM doc WHERE len(w) >= {n}))) WHERE c > 1),
c{n} AS (SELECT r, count(*) AS words, sum(length(w[j])) AS chars FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS j FROM g{n}) JOIN doc USING (r) GROUP BY r)"""


ORACLE = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
{", ".join(map(_gram_sql, NGRAM_LIMITS))},
line AS (SELECT r, l, row_number() OVER (PARTITION BY r, l ORDER BY k) AS nth, count(*) OVER (PARTITION BY r, l) AS c FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM doc WHERE text IS NOT NULL) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, count(*) FILTER (nth > 1) AS dups, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (c > 1) AS chars FROM line GROUP BY r),
m AS (SELECT doc.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(c{BASE_NGRAM}.words, 0) AS n_repeat_words,
    {", ".join(f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_{n}gram_share" for n in NGRAM_LIMITS)}, coalesce(lines.chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_line_share
  FROM doc {" ".join(f"LEFT JOIN c{n} ON c{n}.r = doc.r" for n in NGRAM_LIMITS)} LEFT JOIN lines ON lines.r = doc.r),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND {" AND ".join(f"dup_{n}gram_share <= {limit}" for n, limit in NGRAM_LIMITS.items())} AND dup_line_share <= {LINE_LIMIT} AS kept,
  {", ".join(f"round({k}, 6) AS {k}" for k in SHARES)}
FROM b
"""
