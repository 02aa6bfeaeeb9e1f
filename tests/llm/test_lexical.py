import math
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from alphaline.llm import lexical
from tests.llm.cases import documents, texts

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, items, top=10):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, all_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def items():
    base = texts()[0][1]
    return [(0, base[:400]), (1, None), (2, ""), (3, "same SAME tie"), (3, "same SAME tie"), (4, "nowhere"), (None, "tie three short"), (5, texts()[15][1][:5000]), (6, "日本語 Ñandú straße x")]


def found(spark, docs, wanted):
    frame = spark.createDataFrame(wanted, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("key", F.lit(1))
    return sorted((tuple(r) for r in lexical.search(docs, frame).collect()), key=str)


def test_search_equals_brute_force(spark):
    assert found(spark, documents(spark), items()) == brute(texts(), items())


def test_ties_null_ids_and_repeats(spark):
    rows = [(i % 40 if i % 7 else None, f"same words here {'more ' * (i % 3)}") for i in range(120)] + [(5, "alone unlike")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    wanted = [(1, "same words"), (2, "alone"), (3, "more of the same")]
    assert found(spark, docs, wanted) == brute(rows, wanted)


def test_queries_in_blocks(spark, monkeypatch):
    whole = found(spark, documents(spark), items())
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    assert found(spark, documents(spark), items()) == whole


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(spark, empty, items()) == []
    assert lexical.search(documents(spark), spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_processing_stops_early_and_loses_none():
    """Random postings: the candidates always hold the best, and mostly are far from all documents."""
    rng = np.random.default_rng(9)
    stopped = 0
    for _ in range(60):
        n_docs, n_terms = int(rng.integers(30, 400)), int(rng.integers(2, 12))
        vocabulary = [f"t{k}".encode() for k in range(n_terms)]
        chances = rng.random(n_terms) ** 3
        bodies = [" ".join(f"t{k} " * int(rng.integers(1, 9)) for k in range(n_terms) if rng.random() < chances[k]) + " pad" * int(rng.integers(0, 60)) for _ in range(n_docs)]
        index = lexical.build_index(bodies, {t: k for k, t in enumerate(vocabulary)}, n_docs, sum(len(b.split()) for b in bodies) or 1)
        weights, query = rng.integers(1, 9000, n_terms), np.arange(n_terms)
        every = lexical.complete(index, np.arange(n_docs), query, weights)
        floor = int(rng.integers(1, every.max() + 2))
        chosen = lexical.candidates(index, query, weights, floor)
        best = sorted((x for x in every if x >= floor), reverse=True)[: lexical.TOP]
        wanted = {k for k in range(n_docs) if best and every[k] >= max(best[-1], floor)}
        assert wanted <= set(chosen.tolist())
        stopped += len(chosen) < (every > 0).sum()
    assert stopped > 20
