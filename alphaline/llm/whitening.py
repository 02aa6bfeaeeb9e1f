"""Embedding whitening from an exact scatter matrix in residue numbers.

A vector's entries become whole numbers x = floor(256 c). The model is fitted on the distinct
vectors of a length: n of them, with sums S.

1. The distinct vectors are found by one exchange of packed rows (one to eight bytes an entry) and
   written once.
2. Each task sums entries; Spark adds the sums up. m = floor(S / n) is the shift of a dimension and
   s = S - n m what it leaves.
3. Modulo each of several primes a task multiplies the residues of x - m with themselves (a double
   GEMM over so few rows that no sum passes 2**53). Spark adds the cells up, prime by prime.
4. As many primes are taken as the largest possible cell n max|x - m|**2 needs, so Chinese
   remaindering gives the scatter Z of x - m exactly. The covariance is (n Z - s s') / n**2, rounded once.
5. ``eigh`` in doubles gives the components; the first ``COMPONENTS`` whiten all rows. A last pass
   over the distinct vectors measures the covariance of what it made of them.

Vectors of different lengths are fitted by themselves, length by length; lengths are taken in blocks
of at most ``BLOCK_CELLS`` matrix cells together. A length's matrix must fit into a worker.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are left out; an
empty vector has no component, so it gives no row; entries beyond a long take its nearest value;
equal vectors have equal results and count once in the model; rows with null or repeated ids are
whitened one by one; of equal eigenvalues the order is eigh's, and a component's entry of largest
size (the first, on a tie) is positive; a component without variance (at most one part in 2**40 of
the largest eigenvalue) has a null ``whitened``, is left out of ``identity_error`` and, where
nothing varies, both and ``explained`` are null; a deviation beyond a long is null; an empty table
gives none; other columns are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.llm.shared import cut, drop_cut

COMPONENTS = 4
SCALE = 256.0
#: Matrix cells of the lengths that are fitted together.
BLOCK_CELLS = 8 << 20
#: Residues lie within half a prime of zero, so this many rows keep a GEMM's sums below 2**53.
GEMM_ROWS = 2048
#: A component with a smaller part of the largest eigenvalue has no variance.
RANK_TOLERANCE = 2.0**-40

_LONG = np.iinfo(np.int64)


def primes_below(limit: int) -> Iterator[int]:
    """Odd primes from ``limit`` downwards."""
    for n in range(limit - 1 | 1, 3, -2):
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            yield n


def primes_for(bound: int) -> list[int]:
    """Primes below 2**22 whose product tells all whole numbers from -bound to bound apart."""
    chosen, product = [], 1
    for p in primes_below(1 << 22):
        if product > 2 * bound + 1:
            return chosen
        chosen.append(p)
        product *= p
    raise AssertionError("no bound of 64-bit entries takes all primes")


def remaindered(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers around zero with these residues, as Python integers."""
    product = int(np.prod(np.array(primes, object)))
    total = np.zeros(len(residues[0]), object)
    for r, p in zip(residues, primes, strict=True):
        rest = product // p
        total += r.astype(object) * (rest * pow(rest, -1, p))
    total %= product
    return np.where(total > product // 2, total - product, total)


class Fit(NamedTuple):
    """What the distinct vectors of one length have in common."""

    n: int
    sums: list[int]
    shift: np.ndarray
    left: np.ndarray
    primes: list[int]


class Model(NamedTuple):
    """A fit with its components (rows), their eigenvalues, the trace and, later, the identity error."""

    fit: Fit
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    def live(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > RANK_TOLERANCE * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(256 c), kept within a long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * entries)
    inside = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    inside[scaled >= 2.0**63] = _LONG.max
    return inside


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, matrix of whole numbers)`` of the sound vectors of a batch, a length at a time."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten()
    entries = pc.cast(flat, pa.float64()).fill_null(np.nan).to_numpy()
    stops = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    sound = (lengths > 0) & (bad[stops] == bad[stops - lengths])
    for length in np.unique(lengths[sound]):
        rows = np.flatnonzero(sound & (lengths == length))
        yield rows, whole_numbers(entries[(stops[rows] - length)[:, None] + np.arange(length)])


def packed_rows(matrix: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry that hold it; equal rows have equal bytes."""
    out: list[bytes] = [b""] * len(matrix)
    least, most = matrix.min(axis=1), matrix.max(axis=1)
    left = np.ones(len(matrix), bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        info = np.iinfo(kind)
        fits = left & (least >= info.min) & (most <= info.max)
        left &= ~fits
        for row, raw in zip(np.flatnonzero(fits).tolist(), matrix[fits].astype(kind), strict=True):
            out[row] = raw.tobytes()
    return out


def unpacked(dims: pa.Array, packed: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, matrix)`` of a batch of the fit list."""
    sizes = pc.binary_length(packed).to_numpy().astype(np.int64)
    lengths = dims.to_numpy().astype(np.int64)
    for length in np.unique(lengths):
        parts = []
        for width in np.unique(sizes[lengths == length]) // length:
            chosen = packed.filter(pa.array((lengths == length) & (sizes == width * length)))
            parts.append(np.frombuffer(b"".join(chosen.to_pylist()), f"i{width}").reshape(-1, length).astype(np.int64))
        yield int(length), np.concatenate(parts)


def _fit_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, matrix in vectors_of(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(matrix), matrix.shape[1], np.int32)), pa.array(packed_rows(matrix), pa.binary())], names=["dims", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length, matrix in unpacked(batch.column(0), batch.column(1)):
            columns = [np.full(length, length, np.int32), np.arange(length, dtype=np.int32), np.full(length, len(matrix)), matrix.min(axis=0), matrix.max(axis=0), (matrix >> 32).sum(axis=0), (matrix & 0xFFFFFFFF).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dims", "at", "n", "least", "most", "high", "low"])


def fits(vectors: DataFrame) -> dict[int, Fit]:
    """The fit of each length of a fit list."""
    whole = "decimal(38,0)"
    parts = vectors.mapInArrow(_moments, "dims int, at int, n bigint, least bigint, most bigint, high bigint, low bigint")
    rows = parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low")).collect()
    by_length: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["dims"], r["at"])):
        by_length.setdefault(row["dims"], []).append(row)
    found = {}
    for length, entries in by_length.items():
        n = entries[0]["n"]
        sums = [(int(r["high"]) << 32) + int(r["low"]) for r in entries]
        shift = [total // n for total in sums]
        reach = max(max(r["most"] - m, m - r["least"]) for r, m in zip(entries, shift, strict=True))
        left = np.array([total - n * m for total, m in zip(sums, shift, strict=True)], np.int64)
        found[length] = Fit(n, sums, np.array(shift, np.int64), left, primes_for(n * reach * reach))
    return found


def residue_scatter(matrix: np.ndarray, shift: np.ndarray, p: int) -> np.ndarray:
    """Scatter of the shifted rows modulo ``p``."""
    total = np.zeros((matrix.shape[1],) * 2, np.int64)
    for a in range(0, len(matrix), GEMM_ROWS):
        r = (matrix[a : a + GEMM_ROWS] % p - shift % p) % p
        r[r > p // 2] -= p
        r = r.astype(np.float64)
        total += (r.T @ r).astype(np.int64) % p
    return total % p


def _residues(known: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for length, matrix in unpacked(batch.column(0), batch.column(1)):
                for no, p in enumerate(known[length].primes):
                    totals[length, no] = (totals.get((length, no), 0) + residue_scatter(matrix, known[length].shift, p)) % p
        for (length, no), total in totals.items():
            cells = pa.array([total[i, i:] for i in range(length)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([length] * length, pa.int32()), pa.array([no] * length, pa.int32()), pa.array(range(length), pa.int32()), cells], names=["dims", "prime", "i", "cells"])

    return run


def _covariances(known: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, i, j = (batch.column(k).to_numpy() for k in range(3))
            values = np.zeros(len(lengths))
            exact = np.zeros(len(lengths), object)
            for length in np.unique(lengths):
                fit, rows = known[int(length)], np.flatnonzero(lengths == length)
                residues = np.array(batch.column(3).take(pa.array(rows)).to_pylist(), np.int64).reshape(len(rows), len(fit.primes))
                z = remaindered([residues[:, k] % p for k, p in enumerate(fit.primes)], fit.primes)
                left = fit.left.astype(object)
                exact[rows] = fit.n * z - left[i[rows]] * left[j[rows]]
                values[rows] = [x / fit.n**2 for x in exact[rows]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([str(x) for x in exact]), pa.array(values)], names=["dims", "i", "j", "exact", "value"])

    return run


def covariance(vectors: DataFrame, known: dict[int, Fit]) -> DataFrame:
    """``(dims, i, j, exact, value)`` for i <= j: n**2 times the covariance as a whole number, and the covariance."""
    cells = vectors.mapInArrow(_residues(known), "dims int, prime int, i int, cells array<bigint>").select("dims", "prime", "i", F.posexplode("cells").alias("above", "r"))
    summed = cells.groupBy("dims", "i", "above", "prime").agg(F.sum("r").alias("r"))
    together = summed.groupBy("dims", "i", "above").agg(F.sort_array(F.collect_list(F.struct("prime", "r"))).alias("sums"))
    return together.select("dims", "i", (F.col("i") + F.col("above")).alias("j"), F.col("sums.r").alias("r")).mapInArrow(_covariances(known), "dims int, i int, j int, exact string, value double")


def _solve(table: pa.Table) -> pa.Table:
    length = table.column("dims")[0].as_py()
    i, j, value = (table.column(c).to_numpy() for c in ("i", "j", "value"))
    matrix = np.zeros((length, length))
    matrix[i, j] = matrix[j, i] = value
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:COMPONENTS], vectors.T[::-1][:COMPONENTS]
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    n = len(values)
    return pa.table({"dims": pa.array([length] * n, pa.int32()), "component": pa.array(range(n), pa.int32()), "value": values, "trace": [float(np.trace(matrix))] * n, "vector": pa.array(list(vectors), pa.list_(pa.float64()))})


def shifted(matrix: np.ndarray, fit: Fit) -> np.ndarray:
    """x - S / n in doubles: the whole part exactly, then the rest."""
    differ = matrix - fit.shift
    far = (matrix ^ fit.shift) & (matrix ^ differ) < 0
    whole = np.where(far, matrix.astype(np.float64) - fit.shift.astype(np.float64), differ.astype(np.float64))
    return whole - fit.left / fit.n


def whitened(matrix: np.ndarray, model: Model) -> np.ndarray:
    """The rows on the components with variance, each with variance one."""
    live = model.live()
    return shifted(matrix, model.fit) @ model.vectors[live].T / np.sqrt(model.values[live])


def deviations(matrix: np.ndarray, fit: Fit) -> list[int | None]:
    """Sums of (n x - S)**2, exact; None beyond a long.

    Sums modulo 2**64 are right wherever the true one fits; doubles tell where that is certain.
    """
    about = ((shifted(matrix, fit) * fit.n) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        moved = (matrix - fit.shift) * np.int64(fit.n) - fit.left
        wrapped = (moved * moved).sum(axis=1)
    out: list[int | None] = wrapped.tolist()
    for row in np.flatnonzero(about > 2.0**62).tolist():
        exact = sum((fit.n * x - total) ** 2 for x, total in zip(matrix[row].tolist(), fit.sums, strict=True)) if about[row] < 2.0**64 else _LONG.max + 1
        out[row] = exact if exact <= _LONG.max else None
    return out


def _products(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, matrix in unpacked(batch.column(0), batch.column(1)):
                w = whitened(matrix, models[length])
                w = np.hstack([w, np.ones((len(w), 1))])
                a, b = np.triu_indices(w.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), length, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array((w.T @ w)[a, b])], names=["dims", "a", "b", "total"])

    return run


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry by which the whitened fit list's covariance differs from the identity, by length."""
    rows = vectors.mapInArrow(_products(models), "dims int, a int, b int, total double").groupBy("dims", "a", "b").agg(F.sum("total")).collect()
    totals = {(length, a, b): total for length, a, b, total in rows}
    worst = {}
    for length, model in models.items():
        k, n = int(model.live().sum()), model.fit.n
        mean = [totals[length, a, k] / n for a in range(k)]
        errors = [abs(totals[length, a, b] / n - mean[a] * mean[b] - (a == b)) for a in range(k) for b in range(a, k)]
        if errors:
            worst[length] = max(errors)
    return worst


def fit_models(vectors: DataFrame) -> dict[int, Model]:
    """Fit, components and identity error of each length of a fit list of bounded matrix cells."""
    known = fits(vectors)
    solved = covariance(vectors, known).groupBy("dims").applyInArrow(_solve, "dims int, component int, value double, trace double, vector array<double>").collect()
    models = {}
    for length, fit in known.items():
        own = sorted((r for r in solved if r["dims"] == length), key=lambda r: r["component"])
        models[length] = Model(fit, np.array([r["vector"] for r in own]), np.array([r["value"] for r in own]), own[0]["trace"], None)
    errors = identity_errors(vectors, models)
    return {length: model._replace(identity_error=errors.get(length)) for length, model in models.items()}


def _apply(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in vectors_of(batch.column(1)):
                model = models.get(matrix.shape[1])
                if model is None:
                    continue
                k, live = len(model.values), model.live()
                values = np.full((len(rows), k), np.nan)
                values[:, live] = whitened(matrix, model)
                explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
                each = np.repeat(np.arange(len(rows)), k)
                columns = [
                    batch.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), model.fit.n)),
                    pa.array(deviations(matrix, model.fit), pa.int64()).take(pa.array(each)), pa.array(values.ravel(), from_pandas=True), pa.array(np.tile(explained, len(rows)), from_pandas=True), pa.array([model.identity_error] * len(each), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def blocks_of(lengths: list[int], cells: int) -> list[list[int]]:
    """Lengths in blocks of at most so many matrix cells (one length at least)."""
    blocks: list[list[int]] = []
    held = 0
    for length in sorted(lengths):
        if not blocks or held + length**2 > cells:
            blocks.append([])
            held = 0
        blocks[-1].append(length)
        held += length**2
    return blocks


def whiten(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` for every sound row of ``table``."""
    rows = table.select(F.col(key), F.col(vector).cast("array<double>").alias("__vector"))
    vectors = cut(rows.select("__vector").mapInArrow(_fit_list, "dims int, x binary").distinct(), "op11-fit")
    blocks = blocks_of([r["dims"] for r in vectors.select("dims").distinct().collect()], BLOCK_CELLS)
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = [rows.mapInArrow(_apply(fit_models(vectors if len(blocks) == 1 else vectors.where(F.col("dims").isin(block)))), schema) for block in blocks]
    drop_cut(vectors)
    result = found[0] if found else rows.mapInArrow(_apply({}), schema)
    for more in found[1:]:
        result = result.unionByName(more)
    return result
