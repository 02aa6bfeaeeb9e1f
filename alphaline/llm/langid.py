"""Language identification by Bayesian evidence fusion.

Each text's likelihood under character-trigram models is combined with the language that its
markup declares and with a prior of its host. Priors are hierarchical: a host's counts are
smoothed towards its address suffix, the suffix towards the whole table; all counts, and the
reliability of declared languages, are grouped aggregations of the texts' own posteriors over
all rows. The trigram models are fitted on labelled documents chosen by a hash of doc_id,
about ``MAX_LABELLED`` of them; everything else covers every row and whole texts.

Documents use their source as the host (it has no suffix); pages use their url and html.

Every label among the chosen documents is a language. A model is one packed row of log-probabilities;
texts are scored by ``BLOCK_LANGUAGES`` models at a time, so a worker's tables are bounded, and more
languages take more passes over a written table. Scores, posteriors and priors are arrays by language, sums
by host are long rows, so the plan does not depend on how many languages there are.

Defined results: null and empty texts are decided by the priors; ties go to the first
language by name; rows without a host use the suffix's or the global prior; rows that repeat
an id, or are equal, are judged one by one; texts of any length are scored whole; without
labelled documents every language is ``und``; an empty table of documents leaves nothing to
learn from, so pages are ``und``; without either there are no rows; other columns of the tables
are not read, so they may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm import textcore as tc
from alphaline.llm.shared import cut, drop_cut
from alphaline.llm.urls import host_of

MAX_LABELLED = 20_000
#: Models (128 KB each) that a worker scores with at a time.
BLOCK_LANGUAGES = 1024
FEATURE_BITS = 15
#: Trigrams overlap, so a text's summed log-likelihood counts with this weight.
EVIDENCE = 0.3
HOST_STRENGTH = 5.0
SUFFIX_STRENGTH = 50.0
DECLARED_STRENGTH = 2.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SCRIPT = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>")
_DECLARED = re.compile(rb"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})")


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased bytes, and each row's first one."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data].astype(np.uint32)
    codes = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    codes = (codes * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    before = np.concatenate([[0], np.cumsum(inside)])
    return codes[inside].astype(np.int64), before[np.minimum(offsets, len(inside))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, batch by batch."""
    for batch in batches:
        data, offsets = tc.utf8(batch.column(1))
        labels = batch.column(0).dictionary_encode()
        own = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for row, stop, part, local in tc.chunks(data, offsets):
            codes, first = trigrams(part, local)
            keys, n = np.unique((np.repeat(own[row:stop], np.diff(first)) << FEATURE_BITS) | codes, return_counts=True)
            langs = labels.dictionary.take(pa.array(keys >> FEATURE_BITS))
            yield pa.RecordBatch.from_arrays([langs, pa.array((keys & ((1 << FEATURE_BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "feature", "n"])


def _model(table: pa.Table) -> pa.Table:
    """One language's log-probabilities of the trigrams."""
    counts = np.full(1 << FEATURE_BITS, 0.5)
    counts[table.column("feature").to_numpy()] += table.column("n").to_numpy()
    model = np.log(counts / counts.sum()).astype(np.float32)
    return pa.table({"lang": table.column("lang").slice(0, 1), "model": pa.array([model.tobytes()], pa.binary())})


def fit(docs: DataFrame) -> DataFrame:
    """``(lang, model)``: a packed row of log-probabilities for each language."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    n = labelled.count()
    share = int((1 << 40) * min(1.0, MAX_LABELLED / max(n, 1))) + 1
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    return cut(counts.groupBy("lang").applyInArrow(_model, "lang string, model binary"), "op5-models")


def table_of(models: DataFrame, langs: list[str]) -> np.ndarray:
    """The models of some languages, in their order."""
    rows = dict(models.where(F.col("lang").isin(langs)).collect())
    return np.stack([np.frombuffer(rows[lang], np.float32) for lang in langs])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what a page's markup declares, its text without markup, and an empty list of scores."""
    for batch in batches:
        kinds, texts = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1)
        raw = [(t or "").encode() for t in texts.to_pylist()]
        found = [_DECLARED.search(t) if kind == "page" else None for kind, t in zip(kinds, raw, strict=True)]
        bodies = [_SCRIPT.sub(b" ", t) if kind == "page" else t for kind, t in zip(kinds, raw, strict=True)]
        declared = pa.array([m[1].decode().lower() if m else None for m in found], pa.string())
        scores = pa.array([[]] * len(raw), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], declared, scores, pa.array(bodies, pa.binary())], names=[*batch.schema.names[:-1], "declared", "scores", "body"])


def _append(table: np.ndarray, last: bool):
    """Adds each text's log-likelihoods under a block of models; the last block drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.array(batch.column(batch.num_columns - 2).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            data, offsets = tc.utf8(batch.column(batch.num_columns - 1))
            for row, stop, part, local in tc.chunks(data, offsets):
                codes, first = trigrams(part, local)
                scores = np.zeros((stop - row, len(table)))
                for k in range(len(table)):
                    sums = np.concatenate([[0.0], np.cumsum(table[k][codes], dtype=np.float64)])
                    scores[:, k] = EVIDENCE * (sums[first[1:]] - sums[first[:-1]])
                whole = np.hstack([before[row:stop], scores])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(stop - row + 1, dtype=np.int32) * whole.shape[1], pa.int32()), pa.array(whole.ravel()))
                kept = [batch.column(i).slice(row, stop - row) for i in range(batch.num_columns)]
                columns, names = [*kept[:-2], listed, kept[-1]], batch.schema.names
                yield pa.RecordBatch.from_arrays(columns[:-1] if last else columns, names=names[:-1] if last else names)

    return run


EVIDENCE_COLUMNS = "kind string, doc_id bigint, page_id bigint, host string, suffix string, declared string, scores array<double>"


def evidence(docs: DataFrame, pages: DataFrame, langs: list[str], models: DataFrame) -> DataFrame:
    """Per row of both tables: ids, host, suffix, declared language and log-likelihoods by language."""
    none = F.lit(None)
    own = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), none.cast("long").alias("page_id"), F.concat(F.lit("source:"), F.col("source")).alias("host"), none.cast("string").alias("suffix"), "text")
    host = F.nullif(host_of(F.col("url")), F.lit(""))
    web = pages.select(F.lit("page").alias("kind"), none.cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"), F.col("html").alias("text"))
    rows, prepare = own.union(web), _prepare
    for at in range(0, len(langs), BLOCK_LANGUAGES):
        last = at + BLOCK_LANGUAGES >= len(langs)
        append = _append(table_of(models, langs[at : at + BLOCK_LANGUAGES]), last)
        work = (lambda batches, append=append: append(_prepare(batches))) if prepare else append
        before, rows, prepare = rows, cut(rows.mapInArrow(work, EVIDENCE_COLUMNS + ("" if last else ", body binary")), "op5-evidence"), None
        drop_cut(before)
    return rows


def _matrix(column: pa.Array, default: np.ndarray) -> np.ndarray:
    """A column of arrays by language as a matrix, with a default row where it is null."""
    out = np.tile(default, (len(column), 1))
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    if there.any():
        out[there] = np.array(column.flatten()).reshape(int(there.sum()), -1)
    return out


def _posterior(logs: np.ndarray) -> np.ndarray:
    """Normalised powers of rows of log scores."""
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posteriors of a batch summed by host, declared language, and altogether."""
    for batch in batches:
        if not batch.num_rows:
            continue
        q = _posterior(np.array(batch.column(3).flatten()).reshape(batch.num_rows, -1))
        yield _summed("all", pa.array([""]), pa.nulls(1, pa.string()), q.sum(axis=0)[None, :])
        for what, column in (("host", 0), ("declared", 2)):
            keys = batch.column(column).dictionary_encode()
            own = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            totals = np.zeros((len(keys.dictionary), q.shape[1]))
            np.add.at(totals, own[own >= 0], q[own >= 0])
            suffixes = np.full(len(keys.dictionary), None, object)
            suffixes[own[own >= 0]] = np.array(batch.column(1).to_pylist(), object)[own >= 0]
            yield _summed(what, keys.dictionary, pa.array(suffixes.tolist() if what == "host" else [None] * len(suffixes), pa.string()), totals)


def _summed(what: str, keys: pa.Array, suffixes: pa.Array, totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([what] * len(keys), pa.string()), keys, suffixes, pa.array(list(totals), pa.list_(pa.float64()))], names=["what", "key", "suffix", "sums"])


def _by_key(sums: DataFrame, *keys: str) -> DataFrame:
    """Arrays ``sums`` added up by key, in long rows."""
    long = sums.select(*keys, F.posexplode("sums").alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("s")).select(*keys, F.col("s.v").alias("sums"))


def _smoothed(base: np.ndarray, strength: float):
    """``(key, prior)`` of rows ``(key, sums, parent)``: sums smoothed towards the parent, or the whole where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, parent = _matrix(batch.column(1), base), _matrix(batch.column(2), base)
            prior = (sums + strength * parent) / (sums.sum(axis=1, keepdims=True) + strength)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(prior), pa.list_(pa.float64()))], names=["key", "prior"])

    return run


def _reliability(whole: np.ndarray):
    """How likely a declared language is under each language: as often as it was found with it; unseen pairs share the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _matrix(batch.column(1), whole)
            likely = (sums + DECLARED_STRENGTH * sums.sum(axis=1, keepdims=True) / whole.sum()) / (whole + DECLARED_STRENGTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(likely), pa.list_(pa.float64()))], names=["key", "likely"])

    return run


def _judged(langs: list[str], base: np.ndarray):
    names = pa.array(langs, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _matrix(batch.column(3), base)
            final = _posterior(scores + np.log(_matrix(batch.column(4), base)) + np.log(_matrix(batch.column(5), np.ones_like(base))))
            best, text = names.take(pa.array(final.argmax(axis=1))), names.take(pa.array(_posterior(scores).argmax(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], best, pa.array(final.max(axis=1)), text], names=[*batch.schema.names[:3], "lang", "confidence", "text_lang"])

    return run


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``(kind, doc_id, page_id, lang, confidence, text_lang)`` for every row of both tables."""
    models = fit(docs)
    langs = sorted(r["lang"] for r in models.select("lang").collect())
    if not langs:
        ids = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"))
        ids = ids.union(pages.select(F.lit("page"), F.lit(None).cast("long"), F.col("page_id").cast("long")))
        return ids.select("*", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"))
    rows = evidence(docs, pages, langs, models)
    drop_cut(models)
    parts = rows.select("host", "suffix", "declared", "scores").mapInArrow(_sums, "what string, key string, suffix string, sums array<double>")
    sums = cut(_by_key(parts, "what", "key", "suffix"), "op5-sums")
    seen = sums.where("what = 'all'").select("sums").collect()
    whole = (np.array(seen[0][0]) if seen else np.zeros(len(langs))) + 1.0
    base, priors = whole / whole.sum(), "key string, prior array<double>"
    hosts = sums.where("what = 'host'").select("key", "suffix", "sums")
    suffixes = _by_key(hosts.where("suffix IS NOT NULL").select("suffix", "sums"), "suffix").select("suffix", "sums", F.lit(None).cast("array<double>").alias("parent"))
    parents = suffixes.mapInArrow(_smoothed(base, SUFFIX_STRENGTH), priors).select(F.col("key").alias("suffix"), F.col("prior").alias("parent"))
    host_priors = hosts.join(parents, "suffix", "left").select("key", "sums", "parent").mapInArrow(_smoothed(base, HOST_STRENGTH), priors).withColumnRenamed("key", "host")
    tags = sums.where("what = 'declared'").select("key", "sums").mapInArrow(_reliability(whole), "key string, likely array<double>").withColumnRenamed("key", "declared")
    joined = rows.join(host_priors, "host", "left").join(tags, "declared", "left").select("kind", "doc_id", "page_id", "scores", "prior", "likely")
    judged = joined.mapInArrow(_judged(langs, base), "kind string, doc_id bigint, page_id bigint, lang string, confidence double, text_lang string")
    return judged.withColumn("confidence", F.round("confidence", 6))
