"""Near copies by SimHash fingerprints, BK-trees in shards, exact Jaccard similarity and components.

Two texts are near copies where the sets of their ``WIDTH``-word shingles have a Jaccard
similarity of at least 4/5. Each distinct shingle set is one node with a fingerprint of 128
bits, the majority of its shingles' hashes. Fingerprints of near copies differ in 15 % of the
bits on average and 19 % at most (five shingles against four), others in half of them: ``RADIUS``
lies between. So wide a radius leaves no equal parts to shard by as op3 does; a shard is an equal
band of ``ROWS`` min-hashes instead (a pair at the limit has no equal band once in 10**7), and the
root of its tree is its smallest node, so candidates grow with the texts.

1. Every shard is a BK-tree, which each of its nodes searches for one that lies within the radius;
   a shard of more than ``TREE_NODES`` nodes is dealt into trees with the same root. Such pairs are
   compared exactly, and components of the links that hold are classes. A large group of near
   copies is one class now, without having met in any task.
2. Shards whose nodes are of one class are settled. The nodes of the others meet by component in
   one worker, which deals them out again by their rarest shingles (near copies share one) and
   keeps a BK-tree for each class there. A node searches the trees of the other classes; what
   lies within the radius is compared exactly until a link holds.

The components of both kinds of links are the result.

Defined results: words are split and lower-cased as in ``simhash``; a text of fewer than
``WIDTH`` words is one shingle; null, empty and wordless texts are equal to each other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm import textcore as tc
from alphaline.llm.components import connected_components
from alphaline.llm.shared import cut
from alphaline.llm.simhash import BKTree

WIDTH = 5
SEED = 42
BANDS, ROWS = 24, 3
#: Bits of 128 in which the fingerprints of candidates differ at most.
RADIUS = 48
#: Nodes that one tree of a shard holds, about; the trees of a larger shard have its root in common.
TREE_NODES = 1000

_FACTORS, _SHIFTS = tc.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1)
_FACTORS = _FACTORS | np.uint64(1)
_WORD = (1 << 64) - 1
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: A byte's bits in eight lanes of a byte each, and how many of them a lane can add up.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_LANE_MAX = 255


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes (uint64) of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in spans]), ">u8").astype(np.uint64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprints (two uint64 a set) of nonempty sets; a bit that half of the hashes have set is zero."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    parts = -(-sizes // _LANE_MAX)
    first_part = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + _LANE_MAX * (np.arange(parts.sum()) - np.repeat(first_part, parts))
    sums = np.empty((len(starts), 16), np.uint64)
    for half, word in enumerate((flat, tc.mix(flat ^ _SALT))):
        for k, column in enumerate(word.view(np.uint8).reshape(-1, 8).T, 8 * half):
            sums[:, k] = np.add.reduceat(_LANES[column], starts)
    ones = np.add.reduceat(sums.view(np.uint8), first_part, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The bands' keys (uint64, one row a set) of nonempty sets."""
    flat = np.concatenate(sets)
    firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = tc.mix(key ^ np.minimum.reduceat(flat * _FACTORS[k] + _SHIFTS[k], firsts))
        keys[:, band] = key
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tc.utf8(batch.column(2))
        for row, stop, part, local in tc.chunks(data, offsets, tc.CHUNK_BYTES // 2):
            raw = part.tobytes()
            sets = [shingles(raw[a:b]) for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            full = [s for s in sets if len(s)]
            keys = band_keys(full).view(np.int64).ravel() if full else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            prints = np.zeros((len(sets), 2), np.int64)
            if full:
                prints[[len(s) > 0 for s in sets]] = fingerprints(full).view(np.int64)
            columns = [batch.column(0).slice(row, stop - row), batch.column(1).slice(row, stop - row), pa.array(nodes), bands]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["doc_id", "h", "node", "bands", "fp0", "fp1"])


def similar(common: int, a: int, b: int) -> bool:
    """Whether sets of ``a`` and ``b`` shingles with ``common`` ones are near copies."""
    return 9 * common >= 4 * (a + b)


class _Class:
    """A class's nodes with one rare shingle: a BK-tree of their distinct fingerprints."""

    def __init__(self, value: int, node: int) -> None:
        self.tree, self.places, self.nodes = BKTree(value), {value: 0}, [[node]]

    def add(self, value: int, node: int) -> None:
        at = self.places.get(value)
        if at is None:
            self.places[value] = self.tree.add(value)
            self.nodes.append([node])
        else:
            self.nodes[at].append(node)

    def near(self, value: int) -> Iterator[int]:
        for at in self.tree.search(value, RADIUS):
            yield from self.nodes[at]


def linked(sets: list[np.ndarray], classes: list[int] | None = None) -> list[int]:
    """For each set the smallest index of its group: sets tied by similarities of 4/5 or more.

    Sets of equal ``classes`` are tied from the start.
    """
    held = [set(s.tolist()) for s in sets]
    seen_in = Counter(t for s in held for t in s)
    first: dict[int, int] = {}
    parent = [i if classes is None else first.setdefault(classes[i], i) for i in range(len(sets))]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    prints = [high << 64 | low for high, low in fingerprints(sets).tolist()]
    shards: dict[int, dict[int, list[_Class]]] = {}
    for x in sorted(range(len(sets)), key=lambda i: len(held[i])):
        mine, size = held[x], len(held[x])
        rarest = sorted(mine, key=lambda t: (seen_in[t], t))[: size + 1 + -4 * size // 5]
        rarest = [t for t in rarest if seen_in[t] > 1]  # no other set has the rest
        tried = set()
        for token in rarest:
            groups = shards.setdefault(token, {})
            for root in list(groups):
                for group in groups[root]:
                    if find(root) == find(x):
                        break
                    for y in group.near(prints[x]):
                        if y in tried or 5 * len(held[y]) < 4 * size:
                            continue
                        tried.add(y)
                        if similar(len(mine & held[y]), size, len(held[y])):
                            a, b = find(x), find(y)
                            parent[max(a, b)] = min(a, b)
                            break
                top = find(root)
                if top != root:
                    groups.setdefault(top, []).extend(groups.pop(root))
        for token in rarest:
            own = shards[token].setdefault(find(x), [])
            if own:
                own[0].add(prints[x], x)
            else:
                own.append(_Class(prints[x], x))
    return [find(i) for i in range(len(sets))]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, part, node, fp0, fp1)`` come sorted by tree and node, the root first; a tree may span batches.

    Every other node gets one edge ``(node, hub, far)``, ``far`` bits long: to an equal fingerprint in its
    tree, else to the first one within the radius, else to the root.
    """
    name, tree, nodes, places = None, None, [], {}
    for batch in batches:
        edges = []
        for key, part, node, high, low in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            value = (high & _WORD) << 64 | low & _WORD
            if (key, part) != name:
                name, tree, nodes, places = (key, part), BKTree(value), [node], {value: 0}
                continue
            at = places.get(value)
            if at is None:
                at = next(tree.search(value, RADIUS), 0)
                places[value] = tree.add(value)
                nodes.append(node)
            edges.append((node, nodes[at], (value ^ tree.values[at]).bit_count()))
        found = np.array(edges, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], names=["node", "hub", "far"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges ``(node, hub, text, hub_text)`` whose sets are near copies; a hub's set is kept while it repeats."""
    hub, other = None, None
    for batch in batches:
        links = []
        for node, now, text, hub_text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now != hub:
                hub, other = now, shingles((hub_text or "").encode())
            own = shingles((text or "").encode())
            if similar(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)):
                links.append((node, hub))
        yield _link_batch(links)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(component, node, class, text)`` come sorted by component; a component may span batches."""
    name, nodes, classes, sets = None, [], [], []

    def flush() -> list[tuple[int, int]]:
        return [(nodes[i], nodes[root]) for i, root in enumerate(linked(sets, classes)) if root != i] if len(nodes) > 1 else []

    for batch in batches:
        links: list[tuple[int, int]] = []
        for component, node, own, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if component != name:
                links += flush()
                name, nodes, classes, sets = component, [], [], []
            nodes.append(node)
            classes.append(own)
            sets.append(shingles((text or "").encode()))
        yield _link_batch(links)
    yield _link_batch(flush())


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _stars(spread: DataFrame, value: str) -> DataFrame:
    """``(key, hub)``: the smallest node of the bands whose nodes differ in ``value``."""
    ends = spread.groupBy("key").agg(F.min("node").alias("hub"), F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.where("low <> high").select("key", "hub")


def _trees(spread: DataFrame) -> DataFrame:
    """``(key, part, node, fp0, fp1)``: the nodes of every tree of the shards of two or more; the root is in all trees of its shard."""
    shards = spread.groupBy("key").agg(F.min("node").alias("hub"), F.ceil(F.count(F.lit(1)) / TREE_NODES).alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1")
    part = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), "parts")))
    return spread.join(shards, "key").select("key", F.explode(part).alias("part"), "node", "fp0", "fp1")


def near_copy_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, class)`` for every row of ``docs``; ``h`` is the text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = cut(hashed.mapInArrow(_sketch, f"doc_id {kind}, h bigint, node bigint, bands array<bigint>, fp0 bigint, fp1 bigint"), "near-rows")
    keys = cut(rows.groupBy("node").agg(F.min("h").alias("h"), *(F.first(c).alias(c) for c in ("bands", "fp0", "fp1"))), "near-nodes")
    spread = keys.select("node", F.explode("bands").alias("key"), "fp0", "fp1")
    dealt = _trees(spread).repartition("key", "part").sortWithinPartitions("key", "part", "node")
    edges = cut(dealt.mapInArrow(_search, "node bigint, hub bigint, far bigint").distinct(), "near-edges")
    ends = edges.select("node").union(edges.select("hub")).distinct()
    texts = cut(hashed.select("h", "text").join(keys.join(ends, "node").select("node", "h"), "h").dropDuplicates(["h"]).select("node", "text"), "near-texts")

    hub_texts = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text"))
    near = edges.where(f"far <= {RADIUS}").select("node", "hub")
    pairs = near.join(texts, "node").join(hub_texts, "hub").select("node", "hub", "text", "hub_text")
    links = cut(pairs.mapInArrow(_compare, "a bigint, b bigint"), "near-links")
    classes = connected_components(links).select("node", F.col("component").alias("class"))

    placed = spread.join(classes, "node", "left").select("node", "key", F.coalesce("class", "node").alias("class"))
    open_bands = cut(placed.join(_stars(placed, "class"), "key"), "near-open")
    groups = connected_components(open_bands.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    waiting = groups.join(open_bands.select("node", "class").distinct(), "node").join(texts, "node").select("component", "node", "class", "text")
    more = waiting.repartition("component").sortWithinPartitions("component", "node").mapInArrow(_verify, "a bigint, b bigint")
    final = connected_components(cut(links.union(more), "near-links"))
    return rows.select("doc_id", "h", "node").join(final, "node", "left").select("doc_id", "h", F.coalesce("component", "node").alias("class"))


def keep_first_of_group(docs: DataFrame) -> DataFrame:
    """One row of each group: of its smallest id (null ids last), the text with the least hash."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    first = near_copy_classes(docs).groupBy("class").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.h").alias("__h"))
    hashed = docs.withColumn("__text", F.xxhash64("text"))
    kept = hashed.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text"]).drop("__text")
