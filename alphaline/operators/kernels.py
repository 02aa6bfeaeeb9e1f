"""Pixel kernels as Arrow-batched maps over rows; no shuffle, one image or one stack of small images in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.operators import pixels as px


#: Pixels that a stack of images may have; a larger image is a stack of its own.
STACK_PIXELS = 1 << 15


def _schema(df: DataFrame, keys: list[str], extra: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [extra])


def per_image(maps: DataFrame, keys: list[str], inputs: list[str], work: Callable[..., list[tuple]], fields: str) -> DataFrame:
    """``keys`` and the fields of the rows that ``work(*arrays)`` makes of each row's arrays."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [work(*map(np.asarray, row)) for row in zip(*(frame[c] for c in inputs), strict=True)]
            out = frame[keys].loc[frame.index.repeat([len(m) for m in made])].reset_index(drop=True)
            yield out.join(pd.DataFrame([r for m in made for r in m], columns=names, dtype=object))

    return maps.select(*keys, *inputs).mapInPandas(run, _schema(maps, keys, fields))


def per_stack(maps: DataFrame, keys: list[str], inputs: list[str], width: int, work: Callable[..., list[np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """``keys`` and the doubles ``names``, a row for each row, that ``work(*stacks)`` makes of a stack (h, w, n) of images.

    Images of a stack have one shape. NaN becomes null; a row with a null or empty image has nulls,
    one whose images differ in size raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(keys) + k) for k in range(len(inputs))]
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
            sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            starts, size = [np.cumsum(s) - s for s in sizes], np.minimum.reduce(sizes)
            if any((s != size)[size > 0].any() for s in sizes):
                raise ValueError("a row's images differ in size")
            out = np.full((len(names), batch.num_rows), np.nan)
            for pixels in np.unique(size[size > 0]).tolist():
                rows, step = np.flatnonzero(size == pixels), max(1, STACK_PIXELS // pixels)
                for some in (rows[k : k + step] for k in range(0, len(rows), step)):
                    stacks = [f[s[some] + np.arange(pixels)[:, None]].reshape(-1, width, len(some)) for f, s in zip(flat, starts, strict=True)]
                    out[:, some] = work(*stacks)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(pa.array(o, from_pandas=True) for o in out)], names=[*keys, *names])

    return maps.select(*keys, *inputs).mapInArrow(run, _schema(maps, keys, ", ".join(f"{n} double" for n in names)))


def pair_metrics(pairs: DataFrame, keys: list[str], pred: str, truth: str, width: int, names: tuple[str, ...] = ("grad", "conn")) -> DataFrame:
    """``keys`` and the metrics ``names`` (``grad``, ``conn``) of 8-bit prediction and truth arrays; null without both arrays."""

    def work(p: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        a, b = p / 255, g / 255
        return [np.round(getattr(px, f"{name}_error")(a, b), 9) for name in names]

    return per_stack(pairs, keys, [pred, truth], width, work, names)


def background_residue(pairs: DataFrame, keys: list[str], pred: str, background: str, width: int, radius: int, min_pixels: int) -> DataFrame:
    """Mean alpha and share of smeared pixels (> 5 %) over the eroded background of each image.

    ``background`` is an array of flags; null where fewer than ``min_pixels`` are left.
    """

    def work(p: np.ndarray, flags: np.ndarray) -> list[tuple]:
        rest = p[px.erode(flags.astype(bool).reshape(-1, width), radius, False).ravel()]
        if len(rest) < min_pixels:
            return [(len(rest), None, None)]
        return [(len(rest), float(rest.sum() / (len(rest) * 255)), float((rest * 100 > 5 * 255).mean()))]

    return per_image(pairs, keys, [pred, background], work, "n bigint, bg_mae double, bg_smear double")


def eroded_sizes(maps: DataFrame, keys: list[str], flags: str, width: int, radius: int) -> DataFrame:
    """How many pixels of a mask survive erosion, with a clear and with a set outside."""

    def work(mask: np.ndarray) -> list[tuple]:
        shaped = mask.astype(bool).reshape(-1, width)
        return [tuple(int(px.erode(shaped, radius, outside).sum()) for outside in (False, True))]

    return per_image(maps, keys, [flags], work, "n_erode bigint, n_keep bigint")


def block_mean(maps: DataFrame, keys: list[str], alpha: str, width: int, side: int) -> DataFrame:
    """The mean of each ``side`` x ``side`` cell; borders repeat the last pixel."""

    def work(a: np.ndarray) -> list[tuple]:
        means = px.block_means(a.reshape(-1, width), side)
        return [(y, x, float(means[y, x])) for y in range(means.shape[0]) for x in range(means.shape[1])]

    return per_image(maps, keys, [alpha], work, "cy int, cx int, mean_a double")


def background_losses(pairs: DataFrame, keys: list[str], logit: str, truth: str, width: int, radius: int, tau: float, max_soft_ratio: float, eps: float = 1e-7) -> DataFrame:
    """Background pixels and summed losses of each image, over eroded exact background.

    ``hinge`` (over the logit of ``tau``) exempts images whose 8-bit truth is softer than
    ``max_soft_ratio`` (``gated`` pixels count for it); ``bce`` is the cross-entropy against zero.
    """
    limit = float(np.log(tau / (1 - tau)))

    def work(z: np.ndarray, g: np.ndarray) -> list[tuple]:
        used = z[px.erode((g == 0).reshape(-1, width), radius, True).ravel()]
        soft = ((g * 100 > 5 * 255) & (g * 100 < 95 * 255)).mean()
        hinge = float(np.maximum(used - limit, 0).sum()) if soft <= max_soft_ratio else 0.0
        bce = float(-np.log(np.maximum(1 - 1 / (1 + np.exp(-used)), eps)).sum())
        return [(len(used), len(used) if soft <= max_soft_ratio else 0, hinge, bce)]

    return per_image(pairs, keys, [logit, truth], work, "n_bg bigint, gated bigint, hinge double, bce double")


def all_metrics(pairs: DataFrame, keys: list[str], pred: str, truth: str, width: int, radius: int, min_pixels: int) -> DataFrame:
    """Long form ``(keys, metric, value)`` of every metric of 8-bit arrays; what can't be measured is absent."""
    names = ("sad", "mae", "mse", "grad", "conn", "bg_mae", "bg_smear")

    def work(p: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        a, b = p / 255, g / 255
        off, rest = np.abs(a - b), px.erode(b == 0, radius, False)
        n = rest.sum(axis=(0, 1))
        left = np.where(n >= max(min_pixels, 1), n, np.nan)
        background = [np.where(rest, v, 0).sum(axis=(0, 1)) / left for v in (a, a > 0.05)]
        return [off.sum(axis=(0, 1)) / 1000, off.mean(axis=(0, 1)), (off**2).mean(axis=(0, 1)), px.grad_error(a, b), px.conn_error(a, b), *background]

    return per_stack(pairs, keys, [pred, truth], width, work, names).unpivot(keys, list(names), "metric", "value").where("value IS NOT NULL")


def component_sizes(maps: DataFrame, key: str, alpha: str, width: int, threshold: int) -> DataFrame:
    """``key``, ``n_comp`` and ``largest`` of the 4-connected regions at or above a threshold."""
    found = per_stack(maps, [key], [alpha], width, lambda a: [*px.count_and_largest(a >= threshold)], ("n_comp", "largest"))
    return found.select(key, *(F.col(name).cast("long").alias(name) for name in ("n_comp", "largest")))


def predict(images: DataFrame, keys: list[str], image: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """A model over images: ``load`` runs once in each task; errors become a column, not a failure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            alphas, errors = [], []
            for raw in frame[image]:
                try:
                    alphas.append(np.asarray(model(np.asarray(raw)), float).ravel().tolist())
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  one bad image must not stop the batch
                    alphas.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            out = frame[keys].copy()
            out["alpha"], out["error"] = alphas, errors
            yield out

    return images.select(*keys, image).mapInPandas(run, _schema(images, keys, "alpha array<double>, error string"))


def cut_out(load: Callable[[], Callable[[np.ndarray], np.ndarray]], refine: bool = False) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader of a model that maps an RGB image to RGBA: its alpha, asked again at soft regions on request."""

    def loaded() -> Callable[[np.ndarray], np.ndarray]:
        predict_alpha = load()

        def process(image: np.ndarray) -> np.ndarray:
            alpha = np.clip(predict_alpha(image), 0, 1)
            return px.decontaminated(image, px.refine(image, alpha, predict_alpha) if refine else alpha)

        return process

    return loaded


MODELS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {
    "raw": lambda: lambda a: a,
    "binary": lambda: lambda a: (a >= 0.5).astype(float),
    "inverted": lambda: lambda a: 1 - a,
}


def model(name: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model's loader by name, or by ``name+variant``; unknown parts raise ``KeyError``."""
    base, _, variant = name.partition("+")
    load = MODELS[base]
    return load if not variant else VARIANTS[variant](load)


VARIANTS = {"smooth": lambda load: lambda: (lambda inner: lambda a: px.gaussian(inner(a), 1.0))(load())}
