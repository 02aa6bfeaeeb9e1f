"""Erosion and dilation with any box, odd or even, in time that does not grow with the box.

Running extremes by van Herk and Gil-Werman: a row is cut into blocks as wide as the box, extremes are
accumulated forwards and backwards inside each block, and every window is the extreme of one backward
and one forward value. A box is applied along both axes, one after the other.

A window of width k around pixel i reaches from i - k // 2 over k pixels, so an even box reaches one
further to the left, as max-pooling with half the kernel as padding does after its last row and column
are cut off. Beyond the border there is nothing: windows are of the pixels that exist.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from alphaline.operators.kernels import per_image


def running_max(values: np.ndarray, width: int, axis: int) -> np.ndarray:
    """The largest value of each window along an axis."""
    if width < 1:
        raise ValueError("a box has one pixel at least")
    moved = np.moveaxis(values, axis, -1)
    n = moved.shape[-1]
    if width == 1 or n == 0:
        return values.copy()
    left = width // 2
    total = -(-(n + width - 1) // width) * width
    lowest = -np.inf if np.issubdtype(moved.dtype, np.floating) else np.iinfo(moved.dtype).min
    padded = np.full((*moved.shape[:-1], total), lowest, moved.dtype)
    padded[..., left : left + n] = moved
    blocks = padded.reshape(*moved.shape[:-1], -1, width)
    forward = np.maximum.accumulate(blocks, axis=-1).reshape(padded.shape)
    backward = np.maximum.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(np.maximum(backward[..., :n], forward[..., width - 1 : width - 1 + n]), -1, axis)


def dilate(image: np.ndarray, width: int) -> np.ndarray:
    """Each pixel's largest neighbour in a box of ``width`` x ``width``."""
    return running_max(running_max(image, width, 0), width, 1)


def erode(image: np.ndarray, width: int) -> np.ndarray:
    """Each pixel's smallest neighbour in a box."""
    flipped = ~image if image.dtype.kind in "iu" else -image
    out = dilate(flipped, width)
    return ~out if image.dtype.kind in "iu" else -out


def box_extremes(maps: DataFrame, keys: list[str], alpha: str, side: int, widths: tuple[int, ...]) -> DataFrame:
    """``(*keys, box, eroded, dilated)``: the 8-bit maps after both operations, for each box; rows without a map have none."""

    def work(flat: np.ndarray) -> list[tuple]:
        image = flat.astype(np.int32).reshape(-1, side)
        return [(w, erode(image, w).ravel().tolist(), dilate(image, w).ravel().tolist()) for w in widths]

    return per_image(maps.where(f"`{alpha}` IS NOT NULL"), keys, [alpha], work, "box int, eroded array<int>, dilated array<int>")


def background(truth: np.ndarray, width: int) -> np.ndarray:
    """Where the whole box around a pixel is background (zero truth); a pixel's box ends at the border."""
    return dilate((truth > 0).astype(np.int8), width) == 0
