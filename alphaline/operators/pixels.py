"""NumPy pixel kernels: filters, components, compositing, generators.

Images are float arrays in [0, 1]: alpha (h, w), colour (h, w, 3). Random choices take a
generator from ``stream``, which depends on a key only, never on the order of work.
"""

from __future__ import annotations

import hashlib

import numpy as np


def stream(key: str, seed: int = 42) -> np.random.Generator:
    """An independent random stream for each key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return np.random.default_rng(np.frombuffer(digest[:16], np.uint32))


def _kernel(sigma: float, order: int) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    bell = np.exp(-0.5 * (x / sigma) ** 2)
    bell /= bell.sum()
    return bell if order == 0 else bell * x / sigma**2


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    reach = len(kernel) // 2
    pads = [(0, 0)] * image.ndim
    pads[axis] = (reach, reach)
    wide = np.pad(image, pads, mode="symmetric")
    n = image.shape[axis]
    whole = (slice(None),) * axis
    return sum(k * wide[(*whole, slice(i, i + n))] for i, k in enumerate(kernel))


def gaussian(image: np.ndarray, sigma: float, orders: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Separable Gaussian (or its first derivatives), mirrored borders, cut at four sigma."""
    image = np.asarray(image, float)
    if sigma <= 0:
        return image
    return _along(_along(image, _kernel(sigma, orders[0]), 0), _kernel(sigma, orders[1]), 1)


def luminance(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114])


def gradient_magnitude(alpha: np.ndarray, sigma: float = 1.4) -> np.ndarray:
    return np.hypot(gaussian(alpha, sigma, (1, 0)), gaussian(alpha, sigma, (0, 1)))


def grad_error(pred: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Summed squared difference of gradient magnitudes, in thousands; one value for each image of a stack (h, w, n)."""
    return ((gradient_magnitude(pred) - gradient_magnitude(truth)) ** 2).sum(axis=(0, 1)) / 1000


def _regions(mask: np.ndarray) -> np.ndarray:
    """The smallest cell number of each cell's 4-connected region, the mask's size outside; images may be stacked (h, w, n).

    Labels shrink to it by sweeping neighbours and jumping along the labels.
    """
    big = mask.size
    label = np.where(mask, np.arange(big).reshape(mask.shape), big)
    while True:
        best = label.copy()
        for to, at in ((best[1:], label[:-1]), (best[:-1], label[1:]), (best[:, 1:], label[:, :-1]), (best[:, :-1], label[:, 1:])):
            np.minimum(to, at, out=to)
        best[~mask] = big
        best = np.append(best.ravel(), big)[best]
        if (best == label).all():
            return label
        label = best


def components(mask: np.ndarray) -> np.ndarray:
    """4-connected component labels from 1 in raster order; 0 outside the mask."""
    mask = np.asarray(mask, bool)
    out = np.zeros(mask.shape, int)
    out[mask] = np.unique(_regions(mask)[mask], return_inverse=True)[1] + 1
    return out


def sizes(mask: np.ndarray) -> np.ndarray:
    """Sizes of the components by label."""
    return np.bincount(components(mask).ravel())[1:]


def _region_sizes(label: np.ndarray) -> np.ndarray:
    """``(cells, images)``: the size of the region that has a cell for its smallest one, else zero."""
    return np.bincount(label.ravel(), minlength=label.size)[: label.size].reshape(label.shape[0] * label.shape[1], -1)


def count_and_largest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of components of each mask of a stack (h, w, n), and the size of its largest one."""
    counts = _region_sizes(_regions(mask))
    return (counts > 0).sum(axis=0), counts.max(axis=0)


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest component (of equals the first) of a mask or of each one of a stack (h, w, n); an empty mask stays empty."""
    mask = np.asarray(mask, bool)
    if not mask.size:
        return mask
    label = _regions(mask)
    counts = _region_sizes(label)
    images = counts.shape[1]
    first = counts.argmax(axis=0) * images + np.arange(images)
    return mask & (label == first.reshape(mask.shape[2:]))


def conn_error(pred: np.ndarray, truth: np.ndarray, grades: int = 10, tolerance: float = 0.15) -> np.ndarray:
    """Connectivity error, in thousands; one value for each image of a stack (h, w, n).

    At each grade of opacity the core is the largest region where both maps reach it. A pixel is
    connected up to the last grade of the unbroken row of cores that hold it; opacity beyond that
    grade by ``tolerance`` or more is disconnected, and its difference counts.
    """
    heights = np.arange(grades + 1) * (1 / grades)
    both = np.minimum(pred, truth)
    cores = np.array([largest_component(both >= height) for height in heights[1:]])
    connected = heights[np.logical_and.accumulate(cores, axis=0).sum(axis=0)]
    loose = [np.where(alpha - connected >= tolerance, alpha - connected, 0.0) for alpha in (pred, truth)]
    return np.abs(loose[0] - loose[1]).sum(axis=(0, 1)) / 1000


def erode(mask: np.ndarray, radius: int, outside: bool) -> np.ndarray:
    """Where the whole box of a radius is set, images may be stacked (h, w, n); ``outside`` tells whether the pixels beyond the border are."""
    size = 2 * radius + 1
    for axis in range(2):
        pads = [(0, 0)] * mask.ndim
        pads[axis] = (radius, radius)
        mask = np.lib.stride_tricks.sliding_window_view(np.pad(mask, pads, constant_values=outside), size, axis).all(axis=-1)
    return mask


def block_means(alpha: np.ndarray, side: int) -> np.ndarray:
    """The mean of each cell; the last pixels are repeated to whole cells."""
    h, w = alpha.shape
    padded = np.pad(alpha, ((0, -h % side), (0, -w % side)), mode="edge")
    return padded.reshape(padded.shape[0] // side, side, -1, side).mean(axis=(1, 3))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    if image.ndim == 3:
        fy, fx = fy[:, None, None], fx[None, :, None]
    else:
        fy, fx = fy[:, None], fx[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def cover(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Scale to cover a size, then cut the middle."""
    scale = max(height / image.shape[0], width / image.shape[1])
    h, w = max(height, round(image.shape[0] * scale)), max(width, round(image.shape[1] * scale))
    big = resize(image, h, w)
    top, left = (h - height) // 2, (w - width) // 2
    return big[top : top + height, left : left + width]


def over(top: np.ndarray, alpha: np.ndarray, below: np.ndarray) -> np.ndarray:
    return alpha[..., None] * top + (1 - alpha[..., None]) * below


def compose(fg: np.ndarray, alpha: np.ndarray, bg: np.ndarray, rng: np.random.Generator, scales: tuple[float, float] = (0.6, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """A subject at a random size and place on a background; alpha is zero elsewhere."""
    if bg.shape[0] < fg.shape[0] or bg.shape[1] < fg.shape[1]:
        bg = cover(bg, max(bg.shape[0], fg.shape[0]), max(bg.shape[1], fg.shape[1]))
    fit = min(bg.shape[0] / fg.shape[0], bg.shape[1] / fg.shape[1])
    scale = min(rng.uniform(*scales), fit)
    h, w = max(1, int(fg.shape[0] * scale)), max(1, int(fg.shape[1] * scale))
    top, left = int(rng.integers(0, bg.shape[0] - h + 1)), int(rng.integers(0, bg.shape[1] - w + 1))
    out, mask = bg.copy(), np.zeros(bg.shape[:2])
    small = np.clip(resize(alpha, h, w), 0, 1)
    mask[top : top + h, left : left + w] = small
    out[top : top + h, left : left + w] = over(resize(fg, h, w), small, bg[top : top + h, left : left + w])
    return out, mask


def jitter(image: np.ndarray, alpha: np.ndarray, rng: np.random.Generator, flips: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Brightness, contrast, saturation and blur of the colour; a flip is all that alpha may get."""
    out = image * rng.uniform(0.85, 1.15)
    out = (out - out.mean()) * rng.uniform(0.85, 1.15) + out.mean()
    grey = luminance(out)[..., None]
    out = grey + (out - grey) * rng.uniform(0.85, 1.15)
    if rng.random() < 0.3:
        out = gaussian(out, rng.uniform(0.3, 1.2))
    if flips and rng.random() < 0.5:
        out, alpha = out[:, ::-1], alpha[:, ::-1]
    return np.clip(out, 0, 1), alpha.copy()


def foreground(image: np.ndarray, alpha: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """Smooth foreground colour: blurred premultiplied colour over blurred alpha."""
    weight = gaussian(alpha, sigma)
    colour = gaussian(image * alpha[..., None], sigma) / np.maximum(weight, 1e-6)[..., None]
    return np.where(alpha[..., None] >= 1, image, np.clip(colour, 0, 1))


def decontaminated(image: np.ndarray, alpha: np.ndarray, sigmas: tuple[float, ...] = (16.0, 6.0, 2.0, 0.8)) -> np.ndarray:
    """RGBA with the subject's own colour under soft edges, from wide to narrow surroundings.

    Each level takes what the finer one knows with the weight of the solid pixels near it.
    """
    solid = alpha**8
    colour = np.broadcast_to((image * solid[..., None]).sum((0, 1)) / max(solid.sum(), 1e-6), image.shape)
    for sigma in sigmas:
        weight = gaussian(solid, sigma)[..., None]
        near = gaussian(image * solid[..., None], sigma) / np.maximum(weight, 1e-6)
        trust = np.clip(weight * 4, 0, 1)
        colour = trust * near + (1 - trust) * colour
    own = np.where(alpha[..., None] >= 1, image, np.clip(colour, 0, 1))
    return np.concatenate([own, alpha[..., None]], axis=2)


def defocus(image: np.ndarray, alpha: np.ndarray, sigma: float) -> np.ndarray:
    """Blur the background alone (normalised by its own weight) behind an unchanged subject."""
    behind = 1 - alpha
    weight = gaussian(behind, sigma)
    blurred = gaussian(image * behind[..., None], sigma) / np.maximum(weight, 1e-6)[..., None]
    return over(foreground(image, alpha), alpha, np.clip(blurred, 0, 1))


def cut_window(alpha: np.ndarray, rng: np.random.Generator, least: float = 0.5, second: float = 0.35) -> tuple[int, int, int, int] | None:
    """A window ``(top, left, bottom, right)`` whose border runs through the subject, or None.

    One edge is cut, sometimes also a perpendicular one; at least ``least`` of the area stays.
    """
    window = np.array([[0, alpha.shape[0]], [0, alpha.shape[1]]])

    def cut(axis: int, end: int, keep: float) -> bool:
        (y0, y1), (x0, x1) = window
        inside = np.flatnonzero((alpha[y0:y1, x0:x1] > 0.5).any(axis=1 - axis))
        if not len(inside):
            return False
        low, high = window[axis, 0] + inside[0], window[axis, 0] + inside[-1] + 1
        room = (high if end else alpha.shape[axis] - low) - int(np.ceil(keep * alpha.shape[axis]))
        first, last = max(1, int(np.ceil(0.2 * (high - low)))), min(int(0.6 * (high - low)), room, high - low - 1)
        if last < first:
            return False
        taken = int(rng.integers(first, last + 1))
        window[axis, end] = high - taken if end else low + taken
        return True

    for edge in rng.permutation(4):
        axis = int(edge) // 2
        if cut(axis, int(edge) % 2, least):
            if rng.random() < second:
                share = np.ptp(window[axis]) / alpha.shape[axis]
                any(cut(1 - axis, int(end), least / share) for end in rng.permutation(2))
            return tuple(int(v) for v in window.T.ravel())
    return None


def value_noise(shape: tuple[int, int], cell: int, rng: np.random.Generator) -> np.ndarray:
    """Random values on a coarse grid, interpolated."""
    grid = rng.random((shape[0] // cell + 2, shape[1] // cell + 2))
    return resize(grid, *shape)


def octaves(shape: tuple[int, int], cell: int, rng: np.random.Generator) -> np.ndarray:
    """Two octaves of noise, weighed 0.65 and 0.35, stretched to [0, 1]."""
    noise = 0.65 * value_noise(shape, cell, rng) + 0.35 * value_noise(shape, max(cell // 2, 1), rng)
    low, high = noise.min(), noise.max()
    return (noise - low) / (high - low) if high > low else np.zeros(shape)


def paper(shape: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
    """A light, grained background."""
    tint = rng.uniform(0.85, 0.98, 3)
    grain = (octaves(shape, 12, rng) - 0.5) * 0.08 + rng.normal(0, 0.01, shape)
    return np.clip(tint + grain[..., None], 0, 1)


def gradient(shape: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
    """A linear blend of two colours in a random direction."""
    angle = rng.uniform(0, 2 * np.pi)
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    t = np.cos(angle) * x + np.sin(angle) * y
    t = (t - t.min()) / max(np.ptp(t), 1e-9)
    a, b = rng.random(3), rng.random(3)
    return a + (b - a) * t[..., None]


def spot(shape: tuple[int, int], centre: tuple[float, float], radius: float, arms: int = 0) -> np.ndarray:
    """A soft round spot, or a star with ``arms``."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    dy, dx = y - centre[0], x - centre[1]
    reach = np.hypot(dy, dx)
    if arms:
        reach = reach * (1.6 + np.cos(arms * np.arctan2(dy, dx)))
    return np.exp(-0.5 * (reach / radius) ** 2)


def compact_glow(shape: tuple[int, int], centre: tuple[float, float], radius: float) -> np.ndarray:
    """A glow that is exactly zero beyond its radius."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    return np.clip(1 - np.hypot(y - centre[0], x - centre[1]) / radius, 0, 1) ** 2


def streak(shape: tuple[int, int], centre: tuple[float, float], angle: float, length: float, width: float) -> np.ndarray:
    """A soft line of light: long along its angle, thin across."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    dy, dx = y - centre[0], x - centre[1]
    along, across = np.cos(angle) * dx + np.sin(angle) * dy, np.cos(angle) * dy - np.sin(angle) * dx
    return np.exp(-0.5 * ((along / length) ** 2 + (across / width) ** 2))


def sunburst(shape: tuple[int, int], centre: tuple[float, float], radius: float, rays: int) -> np.ndarray:
    """Rays that fade out to exactly zero at the radius."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    turn = np.arctan2(y - centre[0], x - centre[1])
    return (np.cos(rays * turn) > 0) * compact_glow(shape, centre, radius)


def ring(shape: tuple[int, int], centre: tuple[float, float], radius: float, thickness: float) -> np.ndarray:
    """A circle's outline with soft edges."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    return np.clip(thickness / 2 + 0.5 - np.abs(np.hypot(y - centre[0], x - centre[1]) - radius), 0, 1)


def fit(image: np.ndarray, alpha: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A pair scaled to lie inside a box, with its own aspect."""
    scale = min(height / alpha.shape[0], width / alpha.shape[1])
    h, w = max(1, int(alpha.shape[0] * scale)), max(1, int(alpha.shape[1] * scale))
    return resize(image, h, w), np.clip(resize(alpha, h, w), 0, 1)


def paste(layer: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], top: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """A layer on an empty canvas; what lies outside is lost."""
    colour, alpha = layer
    out, mask = np.zeros((*shape, 3)), np.zeros(shape)
    y0, x0, y1, x1 = max(top, 0), max(left, 0), min(top + alpha.shape[0], shape[0]), min(left + alpha.shape[1], shape[1])
    if y1 > y0 and x1 > x0:
        part = np.s_[y0 - top : y1 - top, x0 - left : x1 - left]
        out[y0:y1, x0:x1], mask[y0:y1, x0:x1] = colour[part], alpha[part]
    return out, mask


def clear_rectangles(alpha: np.ndarray, *boxes: tuple[int, int, int, int]) -> np.ndarray:
    """Alpha without what lies in half-open boxes ``(top, left, bottom, right)``."""
    out = alpha.copy()
    for top, left, bottom, right in boxes:
        out[max(top, 0) : max(bottom, 0), max(left, 0) : max(right, 0)] = 0
    return out


def subject_layer(image: np.ndarray, alpha: np.ndarray, name: str, size: int, pad: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The subject cut to its box, filtered, scaled to ``size`` and padded; None without a subject."""
    ys, xs = np.nonzero(alpha > 0.05)
    if not len(ys):
        return None
    box = np.s_[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    colour, mask = fit(FILTERS[name](image[box]), alpha[box], size, size)
    return np.pad(colour, ((pad, pad), (pad, pad), (0, 0))), np.pad(mask, pad)


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """An image turned about its centre, zero where nothing comes from; bilinear."""
    h, w = image.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    cy, cx, turn = (h - 1) / 2, (w - 1) / 2, np.deg2rad(degrees)
    sy, sx = cy + np.cos(turn) * (y - cy) - np.sin(turn) * (x - cx), cx + np.sin(turn) * (y - cy) + np.cos(turn) * (x - cx)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - y0, sx - x0
    wide = np.pad(image, ((1, 1), (1, 1)) + ((0, 0),) * (image.ndim - 2))
    out = 0
    for oy, wy in ((0, 1 - fy), (1, fy)):
        for ox, wx in ((0, 1 - fx), (1, fx)):
            at = wide[np.clip(y0 + oy + 1, 0, h + 1), np.clip(x0 + ox + 1, 0, w + 1)]
            inside = ((y0 + oy >= 0) & (y0 + oy < h) & (x0 + ox >= 0) & (x0 + ox < w)) * wy * wx
            out = out + at * (inside if image.ndim == 2 else inside[..., None])
    return out


def render_template(canvas: tuple[int, int], elements: list[dict], cover: tuple[float, float] = (0.08, 0.92), whole: float = 0.95) -> tuple[np.ndarray, np.ndarray] | None:
    """Composite and truth of ordered elements, or None where the template is of no use.

    An element has ``rgb``, ``alpha``, ``top``, ``left``, ``height``, ``width``, ``angle`` and
    ``opacity``. The leading ones that cover the canvas are background; the truth is the union of
    the others, and has to cover a share within ``cover``.
    """
    height, width = canvas
    if len(elements) < 4 or min(canvas) < 200 or max(canvas) / min(canvas) > 2.6:
        return None
    full = [e["width"] >= whole * width and e["height"] >= whole * height for e in elements]
    first = full.index(False) if False in full else len(full)
    if first == len(elements):
        return None
    layers = []
    for e in elements:
        h, w = max(1, round(e["height"])), max(1, round(e["width"]))
        placed = paste((resize(e["rgb"], h, w), resize(e["alpha"], h, w)), canvas, round(e["top"]), round(e["left"]))
        if e.get("angle"):
            placed = tuple(rotated(x, e["angle"]) for x in placed)
        layers.append((placed[0], np.clip(placed[1] * e.get("opacity", 1.0), 0, 1)))
    shown, _ = stack(layers, np.ones((*canvas, 3)))
    truth = stack(layers[first:], np.zeros((*canvas, 3)))[1]
    return (shown, truth) if cover[0] <= (truth > 0.5).mean() <= cover[1] else None


def design_sample(subjects: list[tuple[np.ndarray, np.ndarray]], shape: tuple[int, int], rng: np.random.Generator, margin: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """A made design: paper, decorations and filtered subjects in order; alpha is their union, zero on the margin."""
    h, w = shape
    layers = []
    if rng.random() < 0.7:
        burst = sunburst(shape, (h / 2, w / 2), 0.45 * min(shape), int(rng.integers(6, 17)))
        layers.append((np.broadcast_to(rng.random(3), (h, w, 3)), rng.uniform(0.3, 0.9) * burst))
    if rng.random() < 0.5:
        circle = ring(shape, (h / 2, w / 2), rng.uniform(0.25, 0.4) * min(shape), rng.uniform(1, 4))
        layers.append((np.broadcast_to(rng.random(3), (h, w, 3)), circle))
    for image, alpha in subjects:
        made = subject_layer(image, alpha, str(rng.choice(sorted(FILTERS))), int(rng.uniform(0.3, 0.6) * min(shape)), 2)
        if made is not None:
            room_y, room_x = (max(1, shape[k] - made[1].shape[k] + 1) for k in range(2))
            layers.append(paste(made, shape, int(rng.integers(0, room_y)), int(rng.integers(0, room_x))))
    edge = [(0, 0, margin, w), (h - margin, 0, h, w), (0, 0, h, margin), (0, w - margin, h, w)]
    layers = [(colour, clear_rectangles(alpha, *edge)) for colour, alpha in layers]
    return stack(layers, paper(shape, rng))


def screen(below: np.ndarray, light: np.ndarray) -> np.ndarray:
    return 1 - (1 - below) * (1 - light)


def light_effects(image: np.ndarray, alpha: np.ndarray, rng: np.random.Generator, count: int = 4, cap: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Halo, streaks and spots of light: colours are screened, alphas united below a cap outside the subject."""
    shape = alpha.shape
    layers = [0.5 * gaussian(alpha, max(shape) / 20)]
    layers += [rng.uniform(0.2, 0.6) * streak(shape, (rng.uniform(0, shape[0]), rng.uniform(0, shape[1])), rng.uniform(0, np.pi), max(shape) / 4, max(0.5, max(shape) / 80)) for _ in range(count // 2)]
    layers += [rng.uniform(0.3, 0.9) * spot(shape, (rng.uniform(0, shape[0]), rng.uniform(0, shape[1])), rng.uniform(1, max(2, max(shape) / 12)), int(rng.choice([0, 4]))) for _ in range(count)]
    light = 1 - np.prod([1 - x for x in layers], axis=0)
    colour = rng.uniform(0.6, 1.0, 3)
    return np.clip(screen(image, light[..., None] * colour), 0, 1), np.maximum(alpha, np.minimum(light, cap) * (alpha < 1))


def smoke(alpha: np.ndarray, rng: np.random.Generator, low: float = 0.1, high: float = 0.5) -> np.ndarray:
    """Smoke beside the subject: alpha between ``low`` and ``high`` where noise is strong."""
    noise = octaves(alpha.shape, max(4, min(alpha.shape) // 6), rng)
    wisps = np.where(noise > 0.55, low + (high - low) * (noise - 0.55) / 0.45, 0)
    return np.where(alpha > 0, alpha, wisps)


def halftone(image: np.ndarray, cell: int = 6, ink_colour=(0.0, 0.0, 0.0), paper_colour=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Dots of ink on paper whose area follows each cell's darkness; borders repeat the last pixel."""
    mean = block_means(luminance(image), cell)
    h, w = image.shape[:2]
    radius = np.repeat(np.repeat(np.sqrt((1 - mean) / np.pi) * cell, cell, 0), cell, 1)[:h, :w]
    y, x = np.mgrid[0:h, 0:w] % cell - (cell - 1) / 2
    return np.where((np.hypot(y, x) > radius)[..., None], np.array(paper_colour), np.array(ink_colour))


def posterise(image: np.ndarray, levels: int = 4, saturation: float = 1.0) -> np.ndarray:
    grey = luminance(image)[..., None]
    return np.round(np.clip(grey + saturation * (image - grey), 0, 1) * (levels - 1)) / (levels - 1)


def ink(image: np.ndarray, threshold: float = 0.35, edge: float = 0.15, ink_colour=(0.0, 0.0, 0.0), paper_colour=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Ink where dark or at strong edges, else paper."""
    grey = luminance(image)
    dark = (grey < threshold) | (gradient_magnitude(grey, 1.0) > edge)
    return np.where(dark[..., None], np.array(ink_colour), np.array(paper_colour))


FILTERS = {"none": lambda x: x, "halftone": halftone, "posterise": posterise, "ink": ink}


def filtered(image: np.ndarray, alpha: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A colour filter; alpha stays as it is, bit by bit."""
    return FILTERS[name](image), alpha


def shadow(alpha: np.ndarray, shift: tuple[int, int], sigma: float, strength: float = 0.6) -> np.ndarray:
    """A soft shadow's alpha; whatever the strength, some of it is half transparent."""
    moved = np.zeros_like(alpha)
    h, w = alpha.shape
    dy, dx = shift
    moved[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = alpha[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return np.clip(gaussian(moved, sigma) * np.clip(strength, 0.2, 0.8), 0, 0.9)


def stack(layers: list[tuple[np.ndarray, np.ndarray]], below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Layers over a background in order; alpha is their union."""
    clear = np.ones(below.shape[:2])
    for colour, alpha in layers:
        below = over(colour, alpha, below)
        clear = clear * (1 - alpha)
    return below, 1 - clear


def uncertain_regions(alpha: np.ndarray, least: int = 256, most: int = 6, grow: int = 4) -> list[np.ndarray]:
    """Masks of the largest regions around half-transparent pixels, biggest first."""
    band = (alpha > 0.05) & (alpha < 0.95)
    for _ in range(grow):
        wide = np.pad(band, 1)
        band = band | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:]
    label = components(band)
    counts = np.bincount(label.ravel())[1:]
    order = np.argsort(-counts, kind="stable")[:most]
    return [label == i + 1 for i in order if counts[i] >= least]


def refine(image: np.ndarray, alpha: np.ndarray, model, pad: int = 16, feather: float = 2.0) -> np.ndarray:
    """Ask ``model(image) -> alpha`` again around uncertain regions and blend inside them only."""
    out = alpha.copy()
    for region in uncertain_regions(alpha):
        ys, xs = np.nonzero(region)
        y0, y1 = max(ys.min() - pad, 0), min(ys.max() + 1 + pad, alpha.shape[0])
        x0, x1 = max(xs.min() - pad, 0), min(xs.max() + 1 + pad, alpha.shape[1])
        again = model(image[y0:y1, x0:x1])
        blend = np.clip(gaussian(region[y0:y1, x0:x1].astype(float), feather), 0, 1) * region[y0:y1, x0:x1]
        out[y0:y1, x0:x1] = blend * again + (1 - blend) * out[y0:y1, x0:x1]
    return out
