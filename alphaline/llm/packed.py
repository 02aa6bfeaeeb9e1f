"""Packed exchange of 64-bit names: which names of a text are shared with other texts.

Names (hashes of symbols or passages) leave the map side packed by bucket - one row per
bucket and flush, holding NumPy arrays - so that a name costs about eight bytes of shuffle
instead of a row. Buckets follow ``spark.sql.shuffle.partitions``. The bucket side answers with
packed names for each text that has to know.

What a flush can tell by itself it settles: of a name that many of its texts hold, one or two
representatives go to the bucket, which need not answer the others; their answers go straight to
their homes, which are dealt out by the texts' ids. So a name that any share of all texts
holds reaches its bucket at most twice from a flush of ``FLUSH_NAMES`` names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alphaline.llm import textcore as tc
from alphaline.llm.shared import shuffle_partitions

#: Names held by a map task before it sends them.
FLUSH_NAMES = 1 << 21
#: Bytes of a symbol's name that ``shared_names`` compares: it only rules texts out.
SYMBOL_BYTES = 6


class Packer:
    """Collects names, with columns of equal length, and turns them into rows for buckets and homes.

    ``settle(names, *columns)`` gives a mask of what has to go to the buckets, and the ids, ties
    and answers of the rest. Of each name the upper ``name_bytes`` are sent.
    """

    def __init__(self, places: int, settle, *columns: str, limit: int, name_bytes: int = 8) -> None:
        self.places, self.settle, self.columns, self.limit, self.name_bytes = places, settle, ("names", *columns), limit, name_bytes
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *parts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(parts[0]):
            self.parts.append(parts)
            self.held += len(parts[0])
        if self.held >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.held = [], 0
        open_, *told = self.settle(*columns)
        columns = [c[open_] for c in columns]
        bucket = ((columns[0] >> np.uint64(32)) * np.uint64(self.places)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.places + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        edges = np.append(cuts[full], len(order))
        pieces = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        rest = [pa.array([_planes(c[order[a:b]]) for a, b in pieces], pa.binary()) for c in columns[1:]]
        names = [*("place", *self.columns), "found"]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), _name_rows(columns[0][order], edges, self.name_bytes), *rest, pa.nulls(len(full), pa.binary())], names=names)
        if len(told[0]):
            home, *answers = _homeward(*told, self.places)
            sent = {"place": pa.array(home + self.places, pa.int32()), **dict(zip(("ids", "ties", "found"), answers, strict=True))}
            yield pa.RecordBatch.from_arrays([sent.get(n, pa.nulls(len(home), pa.binary())) for n in names], names=names)


def schema(*columns: str) -> str:
    """The Spark schema of a packer's rows: buckets come first among the places, homes after them."""
    return "place int, names binary" + "".join(f", {c} binary" for c in columns) + ", found binary"


def _homeward(ids: np.ndarray, ties: np.ndarray, found: np.ndarray, homes: int) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Answers packed by home, a hash of the text's id: homes, ids, ties and what was found."""
    home = tc.mix(ids.view(np.uint64)) % np.uint64(homes)
    order = np.lexsort((ids, home))
    ids, ties, found, home = ids[order], ties[order], found[order], home[order]
    firsts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
    cuts = np.append(firsts, len(home))
    pieces = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    packed = [pa.array([_planes(c[a:b]) for a, b in pieces], pa.binary()) for c in (ids, ties)]
    return home[firsts].astype(np.int32), *packed, tc.binary_rows(found, cuts)


def _name_rows(names: np.ndarray, edges: np.ndarray, width: int) -> pa.Array:
    if width == 8:
        return tc.binary_rows(names, edges)
    upper = np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, 8 - width :]).view(f"V{width}").ravel()
    return tc.binary_rows(upper, edges)


def _planes(values: np.ndarray) -> bytes:
    """Differences of neighbours, byte plane by byte plane: what the shuffle's codec packs well."""
    steps = values.copy()
    steps[1:] -= values[:-1]
    return steps.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    steps = np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def unpack(table: pa.Table, name_bytes: int = 8, **kinds: type) -> list[np.ndarray]:
    """The names (with zeros for what was not sent) and further columns of one bucket's rows."""
    upper = tc.utf8(table.column("names"))[0].reshape(-1, name_bytes)
    whole = np.zeros((len(upper), 8), np.uint8)
    whole[:, 8 - name_bytes :] = upper
    names = whole.view(np.uint64).ravel()
    return [names, *(np.concatenate([_from_planes(raw, kind) for raw in table.column(c).to_pylist()]) for c, kind in kinds.items())]


def by_id(ids: np.ndarray, found: np.ndarray, ties: np.ndarray | None = None) -> pa.Table:
    """Rows ``(id, payload)``, or ``(id, tie, payload)``: what was found for each text, packed."""
    order = np.argsort(ids, kind="stable") if ties is None else np.lexsort((ties, ids))
    ids, found = ids[order], found[order]
    new = ids[1:] != ids[:-1]
    if ties is not None:
        ties = ties[order]
        new |= ties[1:] != ties[:-1]
    firsts = np.flatnonzero(np.concatenate([[True], new])) if len(ids) else np.zeros(0, np.int64)
    tie = {} if ties is None else {"tie": pa.array(ties[firsts], pa.int64())}
    return pa.table({"id": pa.array(ids[firsts], pa.int64()), **tie, "payload": tc.binary_rows(found, np.append(firsts, len(ids)))})


def short(names: np.ndarray) -> np.ndarray:
    """32 of the upper 48 bits of each name, enough to tell the names of one text apart in an answer."""
    return ((names >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows with equal keys side by side, and the firsts of its groups; the first key is the most telling."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, np.flatnonzero(new)


def _back(order: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Flags of ordered rows as flags of the rows as they came."""
    out = np.zeros(len(order), bool)
    out[order[flags]] = True
    return out


def _shared(names: np.ndarray, ids: np.ndarray, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose name has another id too; of these, rows beside a first one of the least and of the largest id."""
    order, firsts = _groups(names)
    own = ids[order]
    group = np.cumsum(np.isin(np.arange(len(order)), firsts)) - 1
    least, most = np.minimum.reduceat(own, firsts), np.maximum.reduceat(own, firsts)
    several = (least < most)[group]
    if not first_only:
        return _back(order, several), np.zeros(len(order), bool)
    stays = np.zeros(len(order), bool)
    for end in (least, most):
        at = np.flatnonzero(own == end[group])
        stays[at[np.unique(group[at], return_index=True)[1]]] = True
    return _back(order, several), _back(order, several & ~stays)


def settle_shared(names: np.ndarray, ids: np.ndarray, ties: np.ndarray):
    """For ``shared_names``: a name that two ids of a flush hold is shared."""
    _, known = _shared(names, ids, True)
    return ~known, ids[known], ties[known], short(names[known])


def settle_repeated(names: np.ndarray, ids: np.ndarray, ties: np.ndarray):
    """For ``repeated_names``: from the third occurrence in a flush on, a name is repeated."""
    order, firsts = _groups(names)
    nth = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
    known = _back(order, nth >= 2)
    return ~known, ids[known], ties[known], names[known]


def settle_later(names, more, most, ids, ties, places):
    """For ``later_places``: a place is later if its name has a smaller id in the flush."""
    known = _later(names, more, most, ids)
    return ~known, ids[known], ties[known], places[known]


def _later(names: np.ndarray, more: np.ndarray, most: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order, firsts = _groups(names, more, most)
    own = ids[order]
    lowest = np.repeat(np.minimum.reduceat(own, firsts), np.diff(np.append(firsts, len(order))))
    return _back(order, own > lowest)


def _in_several_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, ids, ties = unpack(table, SYMBOL_BYTES, ids=np.int64, ties=np.int64)
    shared, _ = _shared(names, ids, False)
    return ids[shared], ties[shared], short(names[shared])


def _occurring_twice(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, ids, ties = unpack(table, ids=np.int64, ties=np.int64)
    order, firsts = _groups(names)
    counts = np.diff(np.append(firsts, len(names)))
    twice = _back(order, np.repeat(counts > 1, counts))
    return ids[twice], ties[twice], names[twice]


def _in_a_smaller_id(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, more, most, ids, ties, places = unpack(table, more=np.uint32, most=np.uint16, ids=np.int64, ties=np.int64, places=np.int32)
    later = _later(names, more, most, ids)
    return ids[later], ties[later], places[later]


def later_places(packed: DataFrame) -> DataFrame:
    """``(id, tie, payload)``: the places (int32) of names that a text with a smaller id also has.

    The rows also carry 48 further bits of each name (``more`` and ``most``), ``ids``, ``ties`` and ``places``.
    """
    return _answers(packed, _in_a_smaller_id, np.int32)


def shared_names(packed: DataFrame) -> DataFrame:
    """``(id, tie, payload)``: the short names of each text that a text with another id also has."""
    return _answers(packed, _in_several_texts, np.uint32)


def repeated_names(packed: DataFrame) -> DataFrame:
    """``(id, payload)``: the names of each text that occur twice or more anywhere."""
    return _answers(packed, _occurring_twice, np.uint64).drop("tie")


def _answers(packed: DataFrame, judge, kind: type) -> DataFrame:
    """Judge every bucket and send what it says home, packed by home first, so that a bucket makes a
    row for each home and not for each text, then one row a text. What flushes settled passes by."""
    places = shuffle_partitions(packed.sparkSession)

    def tell(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        if place >= places:
            return pa.table({"home": pa.array([place - places] * len(table), pa.int32()), **{c: table.column(c) for c in ("ids", "ties", "found")}})
        home, *answers = _homeward(*judge(table), places)
        return pa.table({"home": pa.array(home), **dict(zip(("ids", "ties", "found"), answers, strict=True))})

    def gather(table: pa.Table) -> pa.Table:
        ids, ties = (np.concatenate([_from_planes(raw, np.int64) for raw in table.column(c).to_pylist()]) for c in ("ids", "ties"))
        return by_id(ids, np.frombuffer(tc.utf8(table.column("found"))[0].tobytes(), kind), ties)

    told = packed.groupBy("place").applyInArrow(tell, "home int, ids binary, ties binary, found binary")
    return told.groupBy("home").applyInArrow(gather, "id bigint, tie bigint, payload binary")


def answer(column: pa.Array, row: int, kind: type = np.uint64) -> np.ndarray:
    """What an answer's row holds; nothing for null."""
    raw = column[row].as_py()
    return np.frombuffer(raw, kind) if raw else np.zeros(0, kind)
