"""Exact removal of repeated 400-byte strings by external induced sorting.

Suffixes are sharded by a minimiser: of the ``GRAM``-byte strings in a 400-byte window the one
with the smallest hash (the first of equals) is its anchor, so equal windows have equal
anchors at equal offsets. Windows next to each other share their anchor; together they form a
segment: the bytes left and right of the anchor.

1. The anchors' names are exchanged (packed); a text learns which occur twice or more.
2. Segments of repeated anchors go to the anchor's shard. There Spark's disk-backed sorter
   (spilled runs merged by a priority queue) puts the suffixes that start at anchors in order,
   equal segments next to each other, and each suffix's common prefix with its predecessor is
   taken from the stream.
3. All other suffixes are induced from right to left: the suffix one byte further left is
   ordered by that byte and then by the rank of the suffix it extends; the common-prefix value
   is one more than the smallest value between the two ranks. Queues of suffix tuples beyond
   ``MEMORY_BYTES`` live in a temporary file, so that a shard may exceed memory.
4. Suffixes whose common prefix with a neighbour reaches 400 bytes mark their windows; the
   marked spans go back to their texts and are cut out.

Defined results: null texts are empty; matches never cross texts; rows that repeat a doc_id, or
have none, are texts of their own, told apart by 128 bits of a hash of the text (equal rows have
equal results); texts under 400 bytes lose nothing, longer ones of any length are searched
whole; of equal hashes in a window the first is the anchor, which changes no result; an empty
table gives an empty result; other columns of the table are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm import packed
from alphaline.llm import textcore as tc
from alphaline.llm.shared import shuffle_partitions

WIDTH = 400
GRAM = 32
#: Bytes of suffix tuples that an induction holds in memory, and that make it start.
MEMORY_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
SEND_BYTES = 8 << 20

OWNER = np.dtype([("id", "<i8"), ("tie", "V16"), ("start", "<i4")])
SPAN = np.dtype([("tie", "V16"), ("begin", "<i4"), ("end", "<i4")])


def _tie(text: bytes) -> bytes:
    """128 bits that tell texts of one key apart."""
    return hashlib.blake2b(text, digest_size=16).digest()


def anchored_segments(data: np.ndarray, offsets: np.ndarray):
    """Anchor names, anchor positions, first and last window starts, and rows of the segments."""
    none = np.zeros(0, np.int64)
    n = len(data) - WIDTH + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none, none
    prefix = tc.prefix_hash(data)
    _, inverse = tc.powers(len(prefix))
    grams = len(data) - GRAM + 1
    names = tc.mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:grams])
    least = (names & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    span, step = WIDTH - GRAM + 1, 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: n], least[span - step : span - step + n])
    anchor = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= WIDTH)
    inside = np.zeros(n + 1, np.int8)
    inside[offsets[long]] += 1
    stops = offsets[long + 1] - WIDTH + 1
    inside[stops] -= 1
    valid = np.cumsum(inside[:n]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(ends)
    at = anchor[first]
    return names[at], at, first, last, np.searchsorted(offsets, first, side="right") - 1


def _send_anchors(buckets: int):
    limit = packed.FLUSH_NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packed.Packer(buckets, packed.settle_repeated, "ids", "ties", limit=limit)
        for batch in batches:
            data, offsets = tc.utf8(batch.column(1))
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for row, stop, part, local in tc.chunks(data, offsets):
                names, _, _, _, rows = anchored_segments(part, local)
                yield from packer.add(names, ids[row:stop][rows], np.zeros(len(rows), np.int64))
        yield from packer.flush()

    return run


def _segment_rows(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.array([k[0] for k in held], np.uint64).view(np.int64)),
            pa.array([k[1] for k in held], pa.binary()),
            pa.array([k[2] for k in held], pa.binary()),
            pa.array([b"".join(v) for v in held.values()], pa.binary()),
        ],
        names=["name", "right", "left", "owners"],
    )


def _send_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of repeated anchors; equal ones of a task are sent once with all their owners."""
    held: dict[tuple[int, bytes, bytes], list[bytes]] = {}
    size = 0
    for batch in batches:
        data, offsets = tc.utf8(batch.column(1))
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        answers = batch.column(2)
        for row, stop, part, local in tc.chunks(data, offsets):
            told = [packed.answer(answers, r) for r in range(row, stop)]
            repeated = np.unique(np.concatenate(told))
            if not len(repeated):
                continue
            names, at, first, last, rows = anchored_segments(part, local)
            chosen = np.flatnonzero(np.isin(names, repeated))
            if not len(chosen):
                continue
            names, at, first, last, rows = (x[chosen] for x in (names, at, first, last, rows))
            raw = part.tobytes()
            ties = {int(r): _tie(raw[local[r] : local[r + 1]]) for r in np.unique(rows)}
            owners = np.zeros(len(rows), OWNER)
            owners["id"], owners["start"] = ids[row:stop][rows], first - local[rows]
            owners["tie"] = np.array([ties[r] for r in rows.tolist()], "V16")
            for k, name, a, s, e in zip(range(len(at)), names.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
                key = (name, raw[a : e + WIDTH], raw[s:a])
                if key not in held:
                    held[key] = []
                    size += e + WIDTH - s
                held[key].append(owners[k : k + 1].tobytes())
                size += OWNER.itemsize
            if size >= SEND_BYTES:
                yield _segment_rows(held)
                held, size = {}, 0
    if held:
        yield _segment_rows(held)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class SuffixQueue:
    """Anchor suffixes in order, with common prefixes and left contexts; spills to a file."""

    def __init__(self) -> None:
        self.lefts, self.lcp, self.o_max, self.o_min, self.owners = [], [], [], [], []
        self.size, self.file, self.last = 0, None, None

    def push(self, name: int, right: bytes, left: bytes, owners: bytes) -> None:
        if self.last == (name, right, left):
            self.owners[-1].append(owners)
            return
        self.lcp.append(common_prefix(self.last[1], right) if self.last and self.last[0] == name else 0)
        self.last = (name, right, left)
        self.lefts.append(left)
        self.size += len(left)
        self.o_max.append(len(left))
        self.o_min.append(WIDTH - len(right))
        self.owners.append([owners])
        if self.size - (self.file.tell() if self.file else 0) > MEMORY_BYTES:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.write(b"".join(self.lefts))
        self.lefts = []

    def left_bytes(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.lefts), np.uint8)
        self._spill()
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r", shape=(self.size,))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def induce(left: np.ndarray, o_max: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per distance from the anchor: the order of its suffixes and their common prefixes.

    ``lcp[i]`` belongs to element i and its predecessor; a suffix that has no byte at a
    distance leaves the queue.
    """
    left_end = np.cumsum(o_max)
    order, distance = np.arange(len(o_max)), 0
    while len(order):
        yield distance, order, lcp
        distance += 1
        at = np.flatnonzero(o_max[order] >= distance)
        if not len(at):
            return
        bytes_left = left[left_end[order[at]] - distance]
        rank = np.argsort(bytes_left, kind="stable")
        came, bytes_left = at[rank], bytes_left[rank]
        fresh = np.zeros(len(came), lcp.dtype)
        if len(came) > 1:
            edges = np.empty(2 * (len(came) - 1), np.int64)
            edges[0::2], edges[1::2] = came[:-1] + 1, came[1:] + 1
            between = np.minimum.reduceat(np.append(lcp, 0), edges)[0::2]
            fresh[1:] = np.where(bytes_left[1:] == bytes_left[:-1], between + 1, 0)
        order, lcp = order[came], fresh


def _queue_spans(queue: SuffixQueue) -> tuple[np.ndarray, np.ndarray]:
    """Owners' ids and the byte spans (SPAN) that repeat."""
    o_max, o_min = np.array(queue.o_max, np.int64), np.array(queue.o_min, np.int64)
    owners = [np.frombuffer(b"".join(x), OWNER) for x in queue.owners]
    several = np.array([len(x) > 1 for x in owners])
    owners = [np.unique(x) if len(x) > 1 else x for x in owners]  # equal rows need one answer
    elements, distances = [], []
    for distance, order, lcp in induce(queue.left_bytes(), o_max, np.array(queue.lcp, np.int32)):
        equal = np.flatnonzero(lcp >= WIDTH)
        if len(equal):
            found = np.unique(np.concatenate([order[equal], order[equal - 1]]))
            found = found[~several[found]]
            if len(found):
                elements.append(found)
                distances.append(np.full(len(found), distance))
    whole = np.flatnonzero(several)
    element, low, high = whole, o_min[whole], o_max[whole]
    if elements:
        e, d = np.concatenate(elements), np.concatenate(distances)
        rank = np.lexsort((d, e))
        e, d = e[rank], d[rank]
        begin = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (d[1:] != d[:-1] + 1)]))
        stop = np.append(begin[1:], len(e)) - 1
        element, low, high = np.append(element, e[begin]), np.append(low, d[begin]), np.append(high, d[stop])
    if not len(element):
        return np.zeros(0, np.int64), np.zeros(0, SPAN)
    counts = np.array([len(owners[i]) for i in element])
    owner = np.concatenate([owners[i] for i in element])
    spans = np.zeros(len(owner), SPAN)
    spans["tie"] = owner["tie"]
    spans["begin"] = owner["start"] + np.repeat(o_max[element] - high, counts)
    spans["end"] = owner["start"] + np.repeat(o_max[element] - low + WIDTH, counts)
    return owner["id"].copy(), spans


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, right and left context; an anchor may span batches."""
    queue, size, name = SuffixQueue(), 0, None
    for batch in batches:
        for now, right, left, owners in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now != name and size >= BATCH_BYTES:
                yield from packed.by_id(*_queue_spans(queue)).to_batches()
                queue.close()
                queue, size = SuffixQueue(), 0
            name = now
            queue.push(now, right, left, owners)
            size += len(right) + len(left) + len(owners)
    if size:
        yield from packed.by_id(*_queue_spans(queue)).to_batches()
    queue.close()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tc.utf8(batch.column(2))
        n_bytes, n_removed, n_spans, left = [], [], [], []
        for i, found in enumerate(batch.column(3).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]]
            kept, removed, runs = raw, 0, 0
            if found:
                spans = np.frombuffer(b"".join(found), SPAN)
                spans = spans[spans["tie"] == np.void(_tie(raw.tobytes()))]
                steps = np.zeros(len(raw) + 1, np.int32)
                np.add.at(steps, spans["begin"], 1)
                np.add.at(steps, spans["end"], -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed = int(gone.sum())
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
                kept = raw[~gone]
            n_bytes.append(len(raw))
            n_removed.append(removed)
            n_spans.append(runs)
            left.append(kept.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(left, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every row of ``docs``; kept is binary."""
    width = shuffle_partitions(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    source = docs.select(F.coalesce(doc_id, F.xxhash64("text")).alias("key"), doc_id.alias("doc_id"), "text")
    anchors = source.select("key", "text").mapInArrow(_send_anchors(width), packed.schema("ids", "ties"))
    repeated = packed.repeated_names(anchors)
    texts = source.repartition(width, "key")
    asked = texts.join(repeated.hint("shuffle_hash"), texts["key"] == repeated["id"], "left").select("key", "text", "payload", "doc_id")  # the same columns as below: one exchange
    segments = asked.mapInArrow(_send_segments, "name bigint, right binary, left binary, owners binary")
    shards = segments.repartition(width, "name").sortWithinPartitions("name", "right", "left")
    spans = shards.mapInArrow(_search_shards, "id bigint, payload binary").groupBy("id").agg(F.collect_list("payload").alias("spans"))
    joined = texts.join(spans.hint("shuffle_hash"), texts["key"] == spans["id"], "left").select("key", "doc_id", "text", "spans")
    return joined.mapInArrow(_cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and spans, and the digest of the bytes left, for each document."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
