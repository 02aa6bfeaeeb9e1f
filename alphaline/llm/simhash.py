"""SimHash near-dedup: fingerprints, BK-trees in shards, connected components.

Whole texts give 64-bit fingerprints (one map). Distinct fingerprints are then linked where
at most ``RADIUS`` bits differ. Two such fingerprints agree on at least ``blocks - RADIUS`` of
``blocks`` equal parts, so each fingerprint goes to one shard for every choice of that many
parts; the number of parts follows the count of fingerprints, so that a shard stays small at
any size. Within a shard a BK-tree (children keyed by their Hamming distance to the parent)
is searched along the edges within the radius. A shard reports a spanning forest of its
links, never all pairs of a group. Shards are dealt out by a shuffle rather than broadcast:
their total grows with the corpus, so no bound for a broadcast could be proven.

Defined results: null, empty and wordless texts have fingerprint zero and link like any
other; texts of any length are read whole; a bit that half of the hashes have set is zero;
equal fingerprints are one node; rows that repeat a doc_id, or are equal, keep their own
fingerprints and get the smallest id their fingerprint reaches; a null id names no component; an
empty table gives none; other columns of the table are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm import textcore as tc
from alphaline.llm.components import connected_components
from alphaline.llm.shared import cut

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Expected fingerprints a shard may hold by chance before more parts are used.
SHARD_ROWS = 32


def fingerprint_chunk(texts: list[bytes]) -> np.ndarray:
    """Majority fingerprints (uint64) of UTF-8 texts."""
    digest, blocks, counts = xxhash.xxh64_digest, [], []
    for text in texts:
        words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
        if not words:
            counts.append(0)
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        width = min(SHINGLE, len(words))
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        blocks.append(b"".join([digest(line[s:e], SEED) for s, e in spans]))
        counts.append(len(words) - width + 1)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 8), axis=1)
        firsts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1).view(">u8").ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tc.utf8(batch.column(1))
        for row, stop, part, local in tc.chunks(data, offsets, tc.CHUNK_BYTES // 2):
            raw = part.tobytes()
            found = fingerprint_chunk([raw[a:b] for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def parts_for(count: int) -> int:
    """The fewest parts for which chance puts at most ``SHARD_ROWS`` fingerprints in a shard."""
    parts = RADIUS + 1
    while parts < 16 and count / 2.0 ** ((parts - RADIUS) * (64 // parts)) > SHARD_ROWS:
        parts += 1
    return parts


def shard_keys(parts: int):
    """SQL columns naming the shards of a fingerprint: one for each choice of equal parts."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(parts), parts - RADIUS)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*keys)


class BKTree:
    """Fingerprints in a tree whose edges are labelled with integer Hamming distances."""

    def __init__(self, root: int) -> None:
        self.values = [root]
        self.children: list[dict[int, int]] = [{}]

    def search(self, value: int, radius: int) -> Iterator[int]:
        """Indices of the stored values within ``radius`` bits, one by one, the root's first."""
        stack = [0]
        while stack:
            at = stack.pop()
            far = (self.values[at] ^ value).bit_count()
            if far <= radius:
                yield at
            stack += [child for edge, child in self.children[at].items() if far - radius <= edge <= far + radius]

    def near(self, value: int, radius: int) -> list[int]:
        """Indices of the stored values within ``radius`` bits."""
        return list(self.search(value, radius))

    def add(self, value: int) -> int:
        """Store a new value; its index."""
        at = 0
        while True:
            far = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(far)
            if child is None:
                self.children[at][far] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = child


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values: (member, its group's first)."""
    if len(values) == 2:
        return [(values[1], values[0])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent = BKTree(values[0]), [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values[1:]:
        near = {find(i) for i in tree.near(value, radius)}
        at = tree.add(value)
        parent.append(at)
        for root in near:
            top, other = find(at), root
            parent[max(top, other)] = min(top, other)
    return [(values[i], values[find(i)]) for i in range(1, len(values)) if find(i) != i]


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard may span batches."""
    held, name = [], None

    def flush() -> list[tuple[int, int]]:
        return shard_links(held) if len(held) > 1 else []

    for batch in batches:
        links: list[tuple[int, int]] = []
        for choice, value, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (choice, value) != name:
                links += flush()
                held, name = [], (choice, value)
            held.append(fp & 0xFFFFFFFFFFFFFFFF)
        yield _link_batch(links)
    yield _link_batch(flush())


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    prints = cut(fingerprints(docs), "op3-prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "op3-distinct")
    dealt = distinct.select("fp", F.explode(shard_keys(parts_for(distinct.count()))).alias("k")).select("k.choice", "k.value", "fp")
    crowded = dealt.repartition("choice", "value").sortWithinPartitions("choice", "value", "fp")
    links = crowded.mapInArrow(_search_shards, "a bigint, b bigint")
    grouped = connected_components(links)
    named = distinct.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    lowest = named.groupBy("class").agg(F.min("first_id").alias("component_id"))
    classes = named.join(lowest, "class").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each document."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
