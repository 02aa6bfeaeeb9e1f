import math

import numpy as np
from pyspark.sql import functions as F

from alphaline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """By length: kept rows, then n, deviations, eigenvalues and whitened values up to a sign."""
    kept = [(i, tuple(int(math.floor(256 * c)) for c in v)) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for length in {len(x) for _, x in kept}:
        own = [(i, np.array(x)) for i, x in kept if len(x) == length]
        fit = np.array(sorted({tuple(x) for _, x in own}))
        n, total = len(fit), fit.sum(axis=0)
        centred = fit - total / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1][:4], vectors.T[::-1][:4]
        with np.errstate(all="ignore"):
            out[length] = [(i, n, int(((n * x - total) ** 2).sum()), np.abs((x - total / n) @ vectors.T / np.sqrt(values)), values / np.trace(centred.T @ centred / n)) for i, x in own]
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.3, (120, 6)) * [9, 5, 2, 1, 0.4, 0.1]
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(k + 200, base[3].tolist()) for k in range(60)] + [(3, base[4].tolist()), (None, base[5].tolist())]
    rows += [(500, None), (501, []), (502, [0.1, None, 1.0, 1.0, 1.0, 1.0]), (503, [math.nan] * 6), (504, [math.inf] + [0.0] * 5)]
    rows += [(600 + k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (30, 3)))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("dims", F.lit("x")).withColumn("component", F.lit(1))
    found = {}
    for r in whitening.whiten(frame).collect():
        found.setdefault(r.vec_id, []).append(r)
    expected = brute(rows)
    assert set(found) == {i for own in expected.values() for i, *_ in own}
    assert len(found[3]) == 8 and len(found[600]) == 3
    for own in expected.values():
        for i, n, deviation, values, explained in own:
            mine = [r for r in sorted(found[i], key=lambda r: r.component) if r.deviation == deviation][: len(values)] if i != 3 else None
            if mine is None:
                continue
            assert [r.component for r in mine] == list(range(1, len(values) + 1)) and {r.n for r in mine} == {n}
            assert np.allclose([abs(r.whitened) for r in mine], values, atol=1e-9)
            assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
            assert all(r.identity_error < 1e-9 for r in mine)


def test_signs_are_the_same_for_all_rows(spark):
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.random.default_rng(5).normal(0, 1, (300, 5)))], SCHEMA)
    table = whitening.whiten(frame).groupBy("vec_id").pivot("component").agg(F.first("whitened")).toPandas().drop(columns="vec_id").to_numpy()
    assert np.allclose(table.T @ table / len(table), np.eye(4), atol=1e-9)


def test_without_variance_and_beyond_a_long(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0])]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 0, None, None, None)}
    flat = [(k, [float(k), 2.0]) for k in range(5)]
    found = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.whitened is None for r in found if r.component == 2} == {True} and {r.whitened is None for r in found if r.component == 1} == {False}
    assert all(r.identity_error < 1e-12 for r in found)
    far = [(1, [1e300, 0.0]), (2, [-1e300, 0.5]), (3, [1e9, 0.0]), (4, [0.0, 0.0])]
    found = whitening.whiten(spark.createDataFrame(far, SCHEMA)).collect()
    assert len(found) == 8 and all(r.deviation is None for r in found if r.vec_id in (1, 2))
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lengths_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(k, rng.normal(0, 1, 1 + k % 4).tolist()) for k in range(80)], SCHEMA)
    key = lambda r: (r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9))
    whole = sorted(map(key, whitening.whiten(frame).collect()))
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 5)
    assert whitening.blocks_of([4, 1, 2, 3], 5) == [[1, 2], [3], [4]]
    assert sorted(map(key, whitening.whiten(frame).collect())) == whole


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(7)
    matrix = rng.integers(-(2**60), 2**60, (40, 3)) + np.array([0, 2**62, 5])
    packed = [(3, bytearray(x)) for x in whitening.packed_rows(matrix)]
    frame = spark.createDataFrame(packed, "dims int, x binary").repartition(3)
    wide = matrix.astype(object)
    total = wide.sum(axis=0)
    scatter = 40 * (wide.T @ wide) - np.outer(total, total)
    for r in whitening.covariance(frame, whitening.fits(frame)).collect():
        assert int(r.exact) == scatter[r.i, r.j] and r.value == scatter[r.i, r.j] / 1600


def test_remainders_and_residues():
    primes = whitening.primes_for(10**30)
    product = math.prod(primes)
    assert product > 2 * 10**30 and all(p < 1 << 22 for p in primes) and len(set(primes)) == len(primes)
    numbers = [0, 1, -1, 10**30, -(10**30), 123456789123456789]
    assert whitening.remaindered([np.array([x % p for x in numbers]) for p in primes], primes).tolist() == numbers
    rows = np.random.default_rng(8).integers(-(2**63), 2**63 - 1, (5000, 4))
    shift = np.array([2**63 - 1, -(2**63), 0, 7])
    p = primes[0]
    moved = (rows.astype(object) - shift) % p
    assert (whitening.residue_scatter(rows, shift, p) == (moved.T @ moved) % p).all()
