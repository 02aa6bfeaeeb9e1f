"""Generated copies: which to make, and making them image by image.

A plan is a DataFrame of copy ids; what exists already, what is excluded and what is itself a
derivative is left out before any pixel is touched, so a resumed run makes the missing copies
only and ends with the rows of a full one. Every copy's random stream depends on its id alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaline.functions import text as tx
from alphaline.operators import pixels as px

#: The letter of a copy's suffix.
LETTERS = {"variant": "v", "edge": "e", "mixed": "m", "bokeh": "k", "effects": "f"}


def plan(sources: DataFrame, key: str, kind: str, copies: Column | int = 1, existing: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """``sources`` with ``copy_id`` for each copy still to be made; ``existing(copy_id)``, ``excluded(key)``."""
    named = F.col(key).cast("string")
    rows = sources.where(~tx.is_derived(named))
    if excluded is not None:
        rows = rows.join(excluded.select(key).distinct(), key, "left_anti")
    wanted = copies if isinstance(copies, Column) else F.lit(copies)
    numbers = F.when(wanted > 0, F.sequence(F.lit(0), wanted.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    every = rows.select("*", F.explode(numbers).alias("__n")).withColumn("copy_id", F.format_string(f"%s_{LETTERS[kind]}%02d", named, F.col("__n"))).drop("__n")
    return every if existing is None else every.join(existing.select("copy_id").distinct(), "copy_id", "left_anti")


Kernel = Callable[[np.ndarray, np.ndarray, np.random.Generator], "tuple[np.ndarray, np.ndarray] | None"]


def make(planned: DataFrame, keep: list[str], alpha: str, width: int, kernel: Kernel, image: str | None = None) -> DataFrame:
    """``keep``, ``height``, ``width``, ``rgb`` and ``a8`` of every planned copy; nulls where the kernel finds none.

    ``alpha`` is an 8-bit array; ``image`` one of ``3 * pixels`` values, or none for the alpha itself as grey.
    """
    kinds = {f.name: f.dataType.simpleString() for f in planned.schema.fields}
    columns = ["copy_id", *(k for k in keep if k != "copy_id")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for at, (name, values) in enumerate(zip(frame["copy_id"], frame[alpha], strict=True)):
                a = np.asarray(values, float).reshape(-1, width) / 255
                rgb = np.repeat(a[..., None], 3, 2) if image is None else np.asarray(frame[image].iloc[at], float).reshape(*a.shape, 3) / 255
                found = kernel(rgb, a, px.stream(name))
                if found is None:
                    made.append((None, None, None, None))
                else:
                    colour, matte = (np.rint(np.clip(x, 0, 1) * 255).astype(int) for x in found)
                    made.append((*matte.shape, colour.ravel().tolist(), matte.ravel().tolist()))
            out = frame[columns].reset_index(drop=True)
            yield out.join(pd.DataFrame(made, columns=["height", "width", "rgb", "a8"], dtype=object))

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", height int, width int, rgb array<int>, a8 array<int>"
    return planned.select(*dict.fromkeys([*columns, alpha, *([image] if image else [])])).mapInPandas(run, fields)


def edge_copy(image: np.ndarray, alpha: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """The part of an image whose border runs through the subject."""
    window = px.cut_window(alpha, rng)
    if window is None:
        return None
    top, left, bottom, right = window
    return image[top:bottom, left:right], alpha[top:bottom, left:right]


def mixed_copy(image: np.ndarray, alpha: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Other brightness, contrast and colour; alpha unchanged."""
    return px.jitter(image, alpha, rng, flips=False)


def bokeh_copy(image: np.ndarray, alpha: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A blurred background behind an unchanged subject and alpha."""
    return px.defocus(image, alpha, max(0.5, rng.uniform(0.01, 0.04) * max(alpha.shape))), alpha


def composite_copy(image: np.ndarray, alpha: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The subject on a made background at a random size and place."""
    below = px.gradient(alpha.shape, rng) if rng.random() < 0.5 else px.paper(alpha.shape, rng)
    return px.compose(px.foreground(image, alpha), alpha, below, rng)


def effects_copy(image: np.ndarray, alpha: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Light around the subject, spots and streaks."""
    return px.light_effects(image, alpha, rng)


KERNELS: dict[str, Kernel] = {"edge": edge_copy, "mixed": mixed_copy, "bokeh": bokeh_copy, "variant": composite_copy, "effects": effects_copy}
