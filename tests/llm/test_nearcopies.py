import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from alphaline.llm import nearcopies
from alphaline.llm import textcore as tc
from tests.conftest import DATA


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)}


def similar(a, b):
    return a == b or (a | b and 5 * len(a & b) >= 4 * len(a | b))


def firsts(docs):
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    lowest = {}
    for k, doc in enumerate(docs):
        lowest[find(k)] = min(lowest.get(find(k), doc), doc)
    return sorted(lowest.values())


def edited(words, edits, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_stage_links_five_word_jaccard(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)] + [edited(base, k, rng) for k in (1, 2, 3, 4, 5, 6, 7, 8, 12, 20)] + ["", " ", "a b", "a B"]
    docs = list(enumerate(texts))
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), DATA).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == firsts(docs)
    assert len(kept) < len(docs) - 3


def test_stage_equals_brute_force_on_documents(spark):
    table = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    kept = nearcopies.keep_first_of_group(spark.read.parquet(f"{DATA}/documents.parquet").withColumn("node", F.lit(7))).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == firsts([(r["doc_id"], r["text"]) for r in table])
    assert not {145, 177} & {r.doc_id for r in kept}  # 0.83 like 6 and 1


def test_null_and_repeated_ids_keep_one_row_a_group(spark):
    rng = random.Random(5)
    one, two, three = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(None, one), (None, one), (7, two), (7, three), (7, three), (9, two), (None, three), (None, None)]
    kept = nearcopies.keep_first_of_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(None, one), (7, two), (7, three), (None, None)])


def test_links_beside_the_hub_are_not_lost(spark):
    # chains: each text is like its neighbours only, so a band's smallest node is unlike most of the others
    rng = random.Random(11)
    rows, at = [], 0
    for chain in range(6):
        text = [f"c{chain}w{k}" for k in range(120)]
        for _ in range(25):
            rows.append((at, " ".join(text)))
            at += 1
            for k in rng.sample(range(120), 2):
                text[k] = f"n{rng.randrange(10**9)}"
    docs = [*rows, *((1000 + k, edited([f"big{n}" for n in range(200)], 1, rng)) for k in range(60))]
    kept = nearcopies.keep_first_of_group(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == firsts(docs)
    assert 7 <= len(kept) < 40


def test_settled_classes_tie_from_the_start():
    sets = [nearcopies.shingles(t.encode()) for t in ("a b c d e f", "u v w x y z", "a b c d e f")]
    assert nearcopies.linked(sets) == [0, 1, 0] and nearcopies.linked(sets, [7, 7, 9]) == [0, 0, 0]


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(*nearcopies.fingerprints([a, b]).tolist(), strict=True))


def test_fingerprints_are_the_majority_of_the_shingles_bits():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 5, 254, 255, 256, 700)]
    for found, hashes in zip(nearcopies.fingerprints(sets).tolist(), sets, strict=True):
        for word, column in zip(found, (hashes, tc.mix(hashes ^ nearcopies._SALT)), strict=True):
            assert {k for k in range(64) if word >> k & 1} == {k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in column) > len(column)}


def test_radius_lies_between_near_copies_and_others():
    rng = np.random.default_rng(6)
    for common, more, less in [(4, 1, 0), (8, 1, 1), (8, 2, 0), (16, 4, 0), (40, 5, 5), (400, 50, 50), (400, 100, 0)] * 60:
        pool = rng.integers(0, 2**64, common + more + less, dtype=np.uint64)
        a, b = np.unique(pool[: common + more]), np.unique(np.concatenate([pool[:common], pool[common + more :]]))
        assert nearcopies.similar(common, len(a), len(b)) and apart(a, b) <= nearcopies.RADIUS
    far = [apart(*rng.integers(0, 2**64, (2, 300), dtype=np.uint64)) for _ in range(200)]
    assert sum(x <= nearcopies.RADIUS for x in far) < 10


def test_links_come_from_the_trees_of_the_shards(monkeypatch):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    sets = [nearcopies.shingles(edited(base, k % 3, rng).encode()) for k in range(30)]
    assert nearcopies.linked(sets) == [0] * 30
    monkeypatch.setattr(nearcopies, "RADIUS", -1)  # no fingerprint is that near, so no tree finds a candidate
    assert nearcopies.linked(sets) == list(range(30))
    assert nearcopies.linked(sets, [k % 2 for k in range(30)]) == [k % 2 for k in range(30)]


def test_roots_are_compared_by_fingerprint(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, edited([f"w{n}" for n in range(200)], 1, rng)) for k in range(12)], "doc_id long, text string")
    held = []
    monkeypatch.setattr(nearcopies, "cut", lambda df, label, real=nearcopies.cut: held.append((label, out := real(df, label))) or out)
    monkeypatch.setattr(nearcopies, "RADIUS", -1)
    nearcopies.near_copy_classes(docs)
    named = dict(reversed(held))
    assert named["near-edges"].count() >= 11 and named["near-links"].count() == 0


def test_every_shard_is_a_tree_that_its_nodes_search(spark, monkeypatch):
    rng = np.random.default_rng(13)

    def flip(value, bits):
        return value ^ sum(1 << int(k) for k in rng.choice(128, bits, replace=False))

    root, other = (int.from_bytes(rng.bytes(16)) for _ in range(2))
    # node 1 is far from the root, 2 to 22 are near node 1 and far from the root, 23 is near the root
    prints = [root, other, *(flip(other, 9) for _ in range(20)), other, flip(root, 5)]
    rows = [(7, k, *np.array([p >> 64, p & nearcopies._WORD], np.uint64).view(np.int64).tolist()) for k, p in enumerate(prints)]
    spread = spark.createDataFrame([*rows, (8, *rows[3][1:])], "key long, node long, fp0 long, fp1 long").repartition(3)

    def edges():
        found = nearcopies._trees(spread).repartition("key", "part").sortWithinPartitions("key", "part", "node")
        return {r.node: (r.hub, r.far) for r in found.mapInArrow(nearcopies._search, "node bigint, hub bigint, far bigint").collect()}

    found = edges()
    assert len(found) == len(prints) - 1 and found[1] == (0, (root ^ other).bit_count()) and found[22] == (1, 0) and found[23] == (0, 5)
    assert all(1 <= found[k][0] < k and found[k][1] == (prints[k] ^ prints[found[k][0]]).bit_count() <= 18 for k in range(2, 22))
    monkeypatch.setattr(nearcopies, "TREE_NODES", 4)
    assert nearcopies._trees(spread).where("node = 0").count() == 6 == nearcopies._trees(spread).select("part").distinct().count()
    parts = edges()
    assert set(parts) == set(found) and all(parts[k][0] < k for k in parts) and parts[23] == (0, 5)
