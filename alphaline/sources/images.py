"""Image files as pixel arrays, decoded by Spark's own image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaline.operators import pixels as px


def channels(height: int, width: int, n: int, data: bytes) -> np.ndarray:
    """(h, w, n) values in [0, 1], colours in RGB order (the source stores BGR)."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, n) / 255
    return image[..., [2, 1, 0, *range(3, n)]] if n >= 3 else image


def alpha_of(image: np.ndarray) -> np.ndarray:
    """The alpha channel of RGBA, else luminance."""
    if image.shape[2] == 4:
        return image[..., 3]
    return image[..., 0] if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])


def read_alphas(spark: SparkSession, path: str, cap: int = 2048) -> DataFrame:
    """``(path, height, width, a8)``: alpha maps, scaled down to at most ``cap`` on the long side.

    Files that are no images have a null map.
    """
    files = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for origin, height, width, n, data in frame.itertuples(index=False):
                if height <= 0:
                    rows.append((origin, None, None, None))
                    continue
                alpha = alpha_of(channels(height, width, n, data))
                scale = min(1.0, cap / max(alpha.shape))
                if scale < 1:
                    alpha = px.resize(alpha, max(1, round(height * scale)), max(1, round(width * scale)))
                rows.append((origin, *alpha.shape, np.rint(alpha.clip(0, 1) * 255).astype(int).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "a8"]).astype({"height": "Int32", "width": "Int32"})

    return files.mapInPandas(run, "path string, height int, width int, a8 array<int>")


def status_event(spark: SparkSession, path: str, stage: str, state: str, detail: str = "") -> None:
    """Append one event to a status log."""
    row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(stage).alias("stage"), F.lit(state).alias("state"), F.lit(detail).alias("detail"))
    row.coalesce(1).write.mode("append").json(path)
