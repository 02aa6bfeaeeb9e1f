"""Pairs, results and logs as files: PNG cells, exports by split, results by model, retries."""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from alphaline.operators import pixels as px


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grey (h, w), RGB (h, w, 3) or RGBA (h, w, 4) array as PNG."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[image.shape[2] if image.ndim == 3 else 1]
    rows = np.zeros((h, 1 + image.size // h), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def plain_modes(image: np.ndarray) -> np.ndarray:
    """An image as grey or RGB: palettes are resolved by the decoder, alpha is dropped here."""
    if image.ndim == 3 and image.shape[2] in (2, 4):
        image = image[..., : image.shape[2] - 1]
    return image[..., 0] if image.ndim == 3 and image.shape[2] == 1 else image


def downscale_pair(image: np.ndarray, alpha: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """An image and its alpha scaled together, so that the long side is at most ``cap``."""
    scale = cap / max(alpha.shape)
    if scale >= 1:
        return image, alpha
    h, w = (max(1, round(n * scale)) for n in alpha.shape)
    return px.resize(image, h, w), np.clip(px.resize(alpha, h, w), 0, 1)


def encoded_pairs(rows: DataFrame, key: str, rgb: str, alpha: str, width: str, cap: int = 2048) -> DataFrame:
    """``(key, im, gt, height, width, soft_ratio)``: PNG cells of the rows that have a truth."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, colour, matte, w in frame.itertuples(index=False):
                a = np.asarray(matte, float).reshape(-1, int(w)) / 255
                image, a = downscale_pair(np.asarray(colour, float).reshape(*a.shape, 3) / 255, a, cap)
                cells = [encode_png(np.rint(x * 255)) for x in (image, a)]
                out.append((name, *cells, *a.shape, float(((a > 0.05) & (a < 0.95)).mean())))
            yield pd.DataFrame(out, columns=[key, "im", "gt", "height", "width", "soft_ratio"])

    with_truth = rows.where(F.col(alpha).isNotNull()).select(key, rgb, alpha, width)
    return with_truth.mapInPandas(run, f"`{key}` {kind}, im binary, gt binary, height int, width int, soft_ratio double")


def export_split(pairs: DataFrame, key: str, path: str, split: str) -> None:
    """Add pairs to a split's folder; those that it already holds are not written again."""
    folder = f"{path}/split={split}"
    try:
        there = pairs.sparkSession.read.parquet(folder).select(key)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        pairs.write.parquet(folder)
        return
    pairs.join(there, key, "left_anti").write.mode("append").parquet(folder)


def write_results(results: DataFrame, path: str, model: str = "model") -> None:
    """Results by model: a model that is written again loses its old rows, all others keep theirs."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(model).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retried(work: Callable, attempts: int = 4, wait: float = 0.5, transient: tuple[type[BaseException], ...] = (OSError,)) -> Callable:
    """``work`` repeated after errors that may pass, with growing pauses; the last error is raised."""

    def run(*args):
        for n in range(attempts):
            try:
                return work(*args)
            except transient:
                if n == attempts - 1:
                    raise
                time.sleep(wait * 2**n)

    return run


def key_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``(key, problem)``: weights that a checkpoint lacks (``missing``) or holds beside those expected (``unexpected``)."""
    lacking = expected.select(key).distinct().join(found.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = found.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return lacking.unionByName(extra)
