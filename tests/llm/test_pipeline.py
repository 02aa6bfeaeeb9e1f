from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline
from alphaline.llm import decontam, quality
from tests.conftest import DATA
from tests.llm.cases import words
from tests.llm.test_nearcopies import firsts
from tests.llm.test_operators import LOWER, SPACED, WORDS


def good(text):
    w, lines = SPACED.findall(text or ""), [x for x in (text or "").split("\n") if SPACED.search(x)]
    chars = max(1, sum(map(len, w)))

    def inside(n):
        grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}

    if len(w) < 20 or 100 * len(inside(8)) > 30 * len(w):
        return False
    if any(sum(len(w[j]) for j in inside(n)) / chars > limit for n, limit in quality.NGRAM_LIMITS.items()):
        return False
    twice = Counter(lines)
    return sum(sum(map(len, SPACED.findall(x))) for x in lines if twice[x] > 1) / chars <= quality.LINE_LIMIT


def without_repeated_lines(docs):
    seen, left = set(), []
    for i, t in sorted(docs):
        parts = t.split("\n")
        worded = [n for n, x in enumerate(parts) if SPACED.search(x)]
        gone = set()
        for k in range(len(worded) - 2):
            window = tuple(parts[n] for n in worded[k : k + 3])
            if window in seen:
                gone |= set(worded[k : k + 3])
            seen.add(window)
        kept = "\n".join(x for n, x in enumerate(parts) if n not in gone)
        if not gone or SPACED.search(kept):
            left.append((i, kept))
    return left


def uncontaminated(docs, items):
    windows = set()
    for t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    left = []
    for i, t in docs:
        w, hit = WORDS.findall(t.translate(LOWER)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit:
            left.append((i, t))
    return left


def test_pipeline_equals_brute_force(spark):
    table = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    expected = [(r["doc_id"], r["text"]) for r in table if good(r["text"])]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    items = pq.read_table(f"{DATA}/benchmark.parquet").column("text").to_pylist()
    steps = (lambda x: x, without_repeated_lines, firsts, lambda x: uncontaminated(x, items))
    for (name, stage), brute in zip(corpus_pipeline.STAGES, steps, strict=False):
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        expected = brute(expected)
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(expected), name
    final = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.text) for r in final) == sorted(expected)
    assert set(columns) < set(final[0].asDict())
    assert all(r.rate >= 0 for r in final)


def test_decontamination_judges_rows_and_any_share(spark):
    passage, long, clean = words(50, 14), words(51, 386), " ".join(words(52, 60))
    dirty = " ".join(long[:200] + passage + long[200:])
    rows = [(1, dirty), (1, clean), (None, dirty), (None, clean), (2, None), (3, ""), (3, clean), (4, " ".join(passage[:12])), (5, " ".join(passage))]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, key int").repartition(3)
    items = spark.createDataFrame([(9, " ".join(passage)), (None, clean)], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, clean), (None, clean), (2, None), (3, ""), (3, clean), (4, " ".join(passage[:12]))], key=str)
