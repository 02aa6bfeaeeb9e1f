"""Substring dedup by recompression.

A text's words become symbols; every round first names runs of one symbol and then pairs
(left, right), where one bit of a symbol's name and the round decides which side it stands
on. Names are hashes of what they stand for, so all tasks give equal strings equal names
without a table of names. Each symbol also carries the range of words that determined it: a
symbol whose range lies inside a window stands in every occurrence of that window.

1. The symbols of ``ROUNDS`` rounds are exchanged (packed); a text learns which of its
   symbols a text with another id also has.
2. A window survives if every symbol determined inside it is shared in this way.
   Survivors are named by 112 bits of two independent hashes of their words; this check
   decides. Words are hashed whole, long ones by BLAKE2, so no text made for it makes two
   different words equal (as a polynomial modulo 2**64 lets them be); for 10**13 survivors
   a false match has a chance of one in 10**8.
3. The words of the decided windows are removed.

The texts are shuffled once, by id, and the exchange is reused by steps 2 and 3.

Defined results: null and empty texts have no words; windows never cross texts, and texts of any
length are judged whole; rows that repeat a doc_id (any long) are judged one by one, told apart
by 64 bits of a hash of the text, and never remove each other's words (no smaller id); equal
rows have equal results; a null doc_id neither removes nor loses words; ties cannot occur, as
windows compare ids only; an empty table gives an empty result; other columns of the table are
not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm import packed
from alphaline.llm import textcore as tc
from alphaline.llm.shared import shuffle_partitions

WIDTH = 13
ROUNDS = 2
#: Symbols over fewer words are too common to tell texts apart and are not exchanged.
MIN_SPAN = 2

_ENDLESS = 1 << 40
_ROUND_SALT = tc.mix(np.arange(101, 101 + 64, dtype=np.uint64))


def recompress(symbols: np.ndarray, first_word: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Symbols after ``rounds`` rounds: names, first and last word, first and last determining word.

    A determining range reaches outside the text's words where the text's own border decided.
    """
    n = len(symbols)
    row = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    first = np.arange(n)
    last, low, high = first.copy(), first.copy(), first.copy()
    names = symbols
    for r in range(rounds):
        if n == 0:
            break
        # runs: a maximal run is known only with the symbols on both of its sides
        starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])]))
        stops = np.append(starts[1:], len(names)) - 1
        length = (stops - starts + 1).astype(np.uint64)
        low, high = _with_neighbours(low, high, row, starts, stops, True, True)
        run = np.where(length > 1, tc.mix(names[starts] * np.uint64(0x9E3779B97F4A7C15) + length + _ROUND_SALT[2 * r]), names[starts])
        names, first, last, row = run, first[starts], last[stops], row[starts]
        # pairs: left merges with right; a symbol that stays single is known with its neighbours
        side = (tc.mix(names ^ _ROUND_SALT[2 * r + 1]) & np.uint64(1)).astype(bool)
        merges = np.zeros(len(names), bool)
        merges[:-1] = ~side[:-1] & side[1:] & (row[1:] == row[:-1])
        second = np.concatenate([[False], merges[:-1]])
        starts = np.flatnonzero(~second)
        pair = merges[starts]
        stops = starts + pair
        # a left symbol never merges backwards, a right one never forwards
        low, high = _with_neighbours(low, high, row, starts, stops, side[starts], ~side[stops])
        joined = tc.mix(tc.mix(names[starts] + _ROUND_SALT[2 * r]) * np.uint64(3) + names[stops])
        names = np.where(pair, joined, names[starts])
        first, last, row = first[starts], last[stops], row[starts]
    return names, first, last, low, high


def _with_neighbours(low, high, row, starts, stops, left, right):
    """Determining ranges of groups of symbols, where asked with the symbol on either side.

    Where that symbol would lie beyond the text's border, the range is without end.
    """
    before, after = np.maximum(starts - 1, 0), np.minimum(stops + 1, len(row) - 1)
    has_before = (starts > 0) & (row[before] == row[starts])
    has_after = (stops < len(row) - 1) & (row[after] == row[stops])
    lows = [np.minimum.reduceat(low, starts), np.where(left, np.where(has_before, low[before], -_ENDLESS), _ENDLESS), np.where(right & has_after, low[after], _ENDLESS)]
    highs = [np.maximum.reduceat(high, starts), np.where(left & has_before, high[before], -_ENDLESS), np.where(right, np.where(has_after, high[after], _ENDLESS), -_ENDLESS)]
    return np.minimum.reduce(lows), np.maximum.reduce(highs)


def _level(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first_word = tc.word_spans(data, offsets)
    words = tc.span_hashes(data, starts, ends)
    return starts, ends, first_word, words, recompress(words, first_word)


def _send_symbols(buckets: int):
    limit = packed.FLUSH_NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packed.Packer(buckets, packed.settle_shared, "ids", "ties", limit=limit, name_bytes=packed.SYMBOL_BYTES)
        for batch in batches:
            data, offsets = tc.utf8(batch.column(2))
            ids, ties = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(2))
            for row, stop, part, local in tc.chunks(data, offsets):
                *_, first_word, _, (names, first, last, low, high) = _level(part, local)
                row_of = np.searchsorted(first_word[1:], first, side="right")
                chosen = np.flatnonzero((last - first + 1 >= MIN_SPAN) & (high - low < WIDTH))
                own = row_of[chosen]
                yield from packer.add(names[chosen], ids[row:stop][own], ties[row:stop][own])
        yield from packer.flush()

    return run


def _survivors(words, first_word, level, told) -> np.ndarray:
    """Windows in which every determined symbol is shared with another text."""
    names, first, last, low, high = level
    n = len(words) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    exchanged = np.flatnonzero((last - first + 1 >= MIN_SPAN) & (high - low < WIDTH))
    known = np.isin(packed.short(names[exchanged]), told)
    unknown = exchanged[~known]
    # a window starting at s holds the symbol if s <= low and high <= s + WIDTH - 1
    steps = np.zeros(len(words) + 2, np.int32)
    begin = np.maximum(high[unknown] - WIDTH + 1, 0)
    np.add.at(steps, begin, 1)
    np.add.at(steps, low[unknown] + 1, -1)
    ruled_out = np.cumsum(steps)[:n] > 0
    return np.flatnonzero(tc.window_rows(first_word, WIDTH, len(words)) & ~ruled_out)


def _send_windows(buckets: int):
    limit = packed.FLUSH_NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packed.Packer(buckets, packed.settle_later, "more", "most", "ids", "ties", "places", limit=limit)
        for batch in batches:
            if batch.column(0).null_count:
                batch = batch.filter(batch.column(0).is_valid())
            data, offsets = tc.utf8(batch.column(2))
            answers = batch.column(3)
            ids, ties = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(2))
            for row, stop, part, local in tc.chunks(data, offsets):
                starts, ends, first_word, words, level = _level(part, local)
                told = np.unique(np.concatenate([packed.answer(answers, r, np.uint32) for r in range(row, stop)]))
                at = _survivors(words, first_word, level, told)
                if not len(at):
                    continue
                other = tc.window_hash(tc.span_hashes(part, starts, ends, 1), WIDTH, 1)[at]
                row_of = np.searchsorted(first_word[1:], at, side="right")
                yield from packer.add(
                    tc.window_hash(words, WIDTH)[at],
                    (other >> np.uint64(32)).astype(np.uint32),
                    (other >> np.uint64(16)).astype(np.uint16),
                    ids[row:stop][row_of],
                    ties[row:stop][row_of],
                    (at - first_word[row_of]).astype(np.int32),
                )
        yield from packer.flush()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, answers = batch.column(1), batch.column(2)
        n_words, n_removed, left = [], [], []
        for i, places in enumerate(answers.to_pylist()):
            words = (texts[i].as_py() or "").encode().split()
            gone = np.zeros(len(words), bool)
            if places is not None and len(words) >= WIDTH:
                flags = np.zeros(len(words) - WIDTH + 1, bool)
                at = np.frombuffer(places, np.int32)
                flags[at[at < len(flags)]] = True
                gone = tc.covered(flags, WIDTH, len(words))
            if gone.any():
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            n_words.append(len(gone))
            n_removed.append(int(gone.sum()))
            left.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` for every row of ``docs(doc_id long, text)``."""
    width = shuffle_partitions(docs.sparkSession)
    source = _tied(docs)
    known_texts = source.where("doc_id IS NOT NULL AND text IS NOT NULL")
    symbols = known_texts.mapInArrow(_send_symbols(width), packed.schema("ids", "ties"))
    known = packed.shared_names(symbols)
    texts = source.repartition(width, "doc_id")

    def answered(told: DataFrame) -> DataFrame:
        own = (texts["doc_id"] == told["id"]) & (texts["tie"] == told["tie"])
        return texts.join(told.hint("shuffle_hash"), own, "left").select("doc_id", texts["tie"], "text", "payload")

    windows = answered(known).mapInArrow(_send_windows(width), packed.schema("more", "most", "ids", "ties", "places"))
    decided = packed.later_places(windows)
    return answered(decided).select("doc_id", "text", "payload").mapInArrow(_remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def _tied(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, text)``: the tie tells the rows of one doc_id apart; zero as long as no id repeats."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = source.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return source.select("doc_id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("tie"), "text")


def substring_report(docs: DataFrame) -> DataFrame:
    """Words, removed words and the digest of the words left, for each document."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
place AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lowest FROM place) WHERE doc_id > lowest),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
word AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM doc),
kept AS (
  SELECT word.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(t, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL), '') AS txt
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM doc d LEFT JOIN kept USING (doc_id)
"""
