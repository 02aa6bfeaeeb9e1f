"""Texts that are made to fool a hash."""

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa

from alphaline.llm import packed, quality, recompress
from alphaline.llm import textcore as tc


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_equal_modulo_powers_of_two_are_told_apart(spark):
    for size in (1024, 4096):
        one, other = thue_morse(size)
        docs = spark.createDataFrame([(1, " ".join([*(f"w{k}" for k in range(6)), one, *(f"w{k}" for k in range(6, 12))])), (2, " ".join([*(f"w{k}" for k in range(6)), other, *(f"w{k}" for k in range(6, 12))])), (3, f"{one} x\n{other} x\n{one} x")], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in recompress.substring_report(docs).collect()} == {1: 0, 2: 0, 3: 0}
        assert {r.doc_id: r.n_dup_lines for r in quality.quality_report(docs).collect()} == {1: 0, 2: 0, 3: 1}


def test_spans_hash_by_their_bytes_alone():
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in [*rng.integers(0, 20, 400), 63, 64, 65, 200, 64, 65]]
    pieces += pieces[:50] + [bytes(p) for p in product(b"ab", repeat=7)]
    data = np.frombuffer(b" ".join(pieces), np.uint8)
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    ends = starts + np.array([len(p) for p in pieces])
    for family in (0, 1):
        named = tc.span_hashes(data, starts, ends, family)
        assert len(set(named.tolist())) == len(set(pieces)) == len(set(zip(named.tolist(), pieces, strict=True)))
    assert not set(tc.span_hashes(data, starts, ends, 0).tolist()) & set(tc.span_hashes(data, starts, ends, 1).tolist())


def test_short_names_make_the_round_trip():
    names = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little") for k in range(9)], np.uint64)
    packer = packed.Packer(1, packed.settle_shared, "ids", "ties", limit=100, name_bytes=packed.SYMBOL_BYTES)
    (batch,) = [*packer.add(names, np.arange(9), np.zeros(9, np.int64)), *packer.flush()]
    back, ids, _ = packed.unpack(pa.Table.from_batches([batch]), packed.SYMBOL_BYTES, ids=np.int64, ties=np.int64)
    assert back.tolist() == (names[ids] >> np.uint64(16) << np.uint64(16)).tolist()
    assert packed.short(back).tolist() == packed.short(names[ids]).tolist()
