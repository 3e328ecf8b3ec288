"""Image kernels in numpy, and the Arrow functions that run them over columns of raw grey rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the profiles, cells a side and orientations of the gradient histogram, side of its raster.
PROFILE, CELLS, ORIENTATIONS, SIDE = 16, 4, 8, 24
INK_BELOW = 240
#: Pixels of rasters of one size that are handled at once.
STACK = 1 << 20
#: Bytes of rasters that a Python worker takes out of a batch, or gathers for one, at a time.
HELD = 4 << 20


def raster(px: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(px, np.uint8, width * height).reshape(height, width)


def ink_box(img: np.ndarray, below: int = INK_BELOW) -> tuple[slice, slice] | None:
    ys, xs = np.nonzero(img < below)
    return (slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1)) if len(ys) else None


def moved(masks: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The masks' values (n, h, w) at (y + dy, x + dx), False outside."""
    out = np.zeros_like(masks)
    h, w = masks.shape[1:]
    out[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = masks[:, max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def spread(seed: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Cells of ``within`` (n, h, w) that are 4-connected to the seed through it."""
    now = seed & within
    while True:
        grown = now | within & (moved(now, 1, 0) | moved(now, -1, 0) | moved(now, 0, 1) | moved(now, 0, -1))
        if (grown == now).all():
            return now
        now = grown


def parts(masks: np.ndarray) -> np.ndarray:
    """Number of 4-connected parts of each mask: the cells that are the smallest of theirs."""
    own = np.arange(1, masks[0].size + 1, dtype=np.int32).reshape(masks.shape[1:])
    far = np.int32(masks[0].size + 1)
    label = np.where(masks, own, far)
    while True:
        p = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=far)
        low = np.where(masks, np.minimum.reduce([label, p[:, 2:, 1:-1], p[:, :-2, 1:-1], p[:, 1:-1, 2:], p[:, 1:-1, :-2]]), far)
        if (low == label).all():
            return ((label == own) & masks).sum(axis=(1, 2))
        label = low


def runs_of(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, length) of the True stretches of each line."""
    edge = np.diff(np.pad(lines.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    line, start = np.nonzero(edge == 1)
    return line, np.nonzero(edge == -1)[1] - start


def ink_runs(imgs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raster, length) of the ink stretches of 2 or more along rows and columns, by raster, then length."""
    ink = imgs < INK_BELOW
    n, h, w = ink.shape
    (a, x), (b, y) = runs_of(ink.reshape(n * h, w)), runs_of(ink.transpose(0, 2, 1).reshape(n * w, h))
    which, length = np.r_[a // h, b // w], np.r_[x, y]
    which, length = which[length >= 2], length[length >= 2]
    order = np.lexsort((length, which))
    return which[order], length[order]


def stretched(imgs: np.ndarray) -> np.ndarray:
    """Grey values (n, h, w) from the first to the last hundredth of the pixels over the whole range; flat rasters as they are."""
    n, size = len(imgs), imgs[0].size
    flat = np.sort(imgs.reshape(n, size), axis=1)
    at = lambda k: flat[:, k - 1] if k else np.zeros(n, np.uint8)
    low, high = at(size // 100).astype(np.float32), at(size * 99 // 100).astype(np.float32)
    ok = (low < high)[:, None, None]
    span = np.where(low < high, high - low, 1)[:, None, None]
    new = np.floor((imgs.astype(np.float32) - low[:, None, None]) * np.float32(255) / span + np.float32(0.5))
    return np.where(ok, np.clip(new, 0, 255), imgs).astype(np.uint8)


def thin(masks: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Zhang-Suen skeletons; only ``inner`` cells are ever taken away."""
    now = masks.copy()
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = now
        for step in (0, 1):
            p = [moved(now, *d) for d in around]
            n = sum(x.astype(np.int8) for x in p)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(p, p[1:] + p[:1], strict=True))
            up, right, down, left = p[0], p[2], p[4], p[6]
            clear = ~(up & right & down) & ~(right & down & left) if step == 0 else ~(up & right & left) & ~(up & down & left)
            now = now & ~(inner & (n >= 2) & (n <= 6) & (turns == 1) & clear)
        if (now == before).all():
            return now


def resampled(values: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation of the first size[k] of each row at n evenly spaced places."""
    place = np.arange(n)[None, :] * ((size - 1) / (n - 1))[:, None]
    low = np.floor(place).astype(np.int64)
    high, part = np.minimum(low + 1, size[:, None] - 1), place - low
    take = lambda k: np.take_along_axis(values, k, axis=1)
    return take(low) * (1 - part) + take(high) * part


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) != 0)


#: The direction a terminal points, away from its only neighbour at (dy, dx): up, right, down, left. Fixed values.
POINTS = {(1, 0): 0, (1, 1): 0, (0, -1): 1, (1, -1): 1, (-1, 0): 2, (-1, -1): 2, (0, 1): 3, (-1, 1): 3}


def descriptors(imgs: np.ndarray, normalised: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 63 shape features of rasters (n, h, w) of one size, and which have ink at all (the others' rows are zeros).

    In order: column profile (16), aspect, density, vertical centre, horizontal balance, serifs, stroke contrast, counters (4), terminals
    (4), boundary (2), crossings (4), row profile (16), holes, symmetry (2), skeleton (2), corners, quadrants (4), stroke width. All
    rasters are handled at once: their ink boxes are moved to the upper left corner, and what lies outside them is masked.
    """
    imgs = imgs if normalised else stretched(imgs)
    every, full_h, full_w = imgs.shape
    some = np.flatnonzero((imgs < INK_BELOW).any(axis=(1, 2)))
    out = np.zeros((every, 63), np.float32)
    has = np.zeros(every, bool)
    has[some] = True
    if not len(some):
        return out, has
    img = imgs[some]
    ink = img < INK_BELOW
    n = len(img)
    rows, cols = ink.any(axis=2), ink.any(axis=1)
    y0, x0 = rows.argmax(axis=1), cols.argmax(axis=1)
    h, w = full_h - rows[:, ::-1].argmax(axis=1) - y0, full_w - cols[:, ::-1].argmax(axis=1) - x0
    ys, xs = np.arange(full_h), np.arange(full_w)
    corner = lambda a: np.take_along_axis(np.take_along_axis(a, ((ys + y0[:, None]) % full_h)[:, :, None], axis=1), ((xs + x0[:, None]) % full_w)[:, None, :], axis=2)
    valid = (ys < h[:, None])[:, :, None] & (xs < w[:, None])[:, None, :]
    mask = corner(ink) & valid
    dark = np.where(mask, 255.0 - corner(img), 0.0)
    area, pixels, total = h * w, mask.sum(axis=(1, 2)), dark.sum(axis=(1, 2))
    column, row = dark.sum(axis=1), dark.sum(axis=2)
    three = (h >= 3) & (w >= 3)

    centre = ((ys + y0[:, None]) * row).sum(axis=1) / total / full_h
    left = np.where(xs <= ((w - 1) // 2)[:, None], column, 0).sum(axis=1) / total
    per_row = mask.sum(axis=2)
    ends = np.clip(h // 8, 2, 4)
    mean = lambda a, b: share(np.where((ys >= a[:, None]) & (ys < b[:, None]), per_row, 0).sum(axis=1), np.maximum(b - a, 1))
    middle = mean(h // 3, 2 * h // 3)
    serif = np.where((h >= 8) & (full_w >= 3) & (middle >= 1), np.clip((share(mean(0 * h, ends), middle) + share(mean(h - ends, h), middle)) / 2 - 1, 0, 1), 0)

    contrast, stroke = np.ones(n), np.zeros(n)
    if full_w >= 4 and full_h >= 4:
        which, length = ink_runs(img)
        count = np.bincount(which, minlength=n)
        first = np.cumsum(count) - count
        at = lambda tenths: np.maximum(length[np.minimum(first + count * tenths // 10, max(len(length) - 1, 0))], 1) if len(length) else np.ones(n)
        contrast = np.where(count >= 4, 1 - at(1) / at(9), 1.0)
        stroke = share(np.bincount(which, length, n), count) / full_h

    white = valid & ~mask
    edge = (ys[None, :, None] == 0) | (ys[None, :, None] == (h - 1)[:, None, None]) | (xs[None, None, :] == 0) | (xs[None, None, :] == (w - 1)[:, None, None])
    hole = white & ~spread(white & edge, white)
    holes = hole.sum(axis=(1, 2))
    hy, hx = hole.any(axis=2), hole.any(axis=1)
    extent = lambda a: a.shape[1] - a[:, ::-1].argmax(axis=1) - a.argmax(axis=1)
    counter = [share(holes, area), share((hole * xs).sum(axis=(1, 2)), holes) / w, share((hole * ys[:, None]).sum(axis=(1, 2)), holes) / h, np.where(holes > 0, extent(hx) / extent(hy), 0)]

    eight = {(dy, dx): moved(mask, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
    end = mask & (sum(x.astype(np.int8) for x in eight.values()) == 1)
    ways = np.zeros((n, 4))
    for d, k in POINTS.items():
        ways[:, k] += (end & eight[d]).sum(axis=(1, 2))
    terminals = share(ways, np.where(three, ways.sum(axis=1), 0)[:, None])

    up, right, down, left_of = eight[-1, 0], eight[0, 1], eight[1, 0], eight[0, -1]
    boundary = (mask & ~(up & right & down & left_of)).sum(axis=(1, 2))
    bounds = [np.minimum(1, boundary / np.sqrt(pixels) / 10), 4 * np.pi * pixels / boundary**2]

    change = (mask[:, :, 1:] != mask[:, :, :-1]) & valid[:, :, 1:]
    crossings = [np.minimum(1, np.take_along_axis(change.sum(axis=2), np.minimum((k + 1) * h // 5, h - 1)[:, None], axis=1)[:, 0] / 20) for k in range(4)]

    two = (h >= 2) & (w >= 2)
    across = np.take_along_axis(mask, np.clip(w[:, None] - 1 - xs, 0, None)[:, None, :], axis=2) == mask
    along = np.take_along_axis(mask, np.clip(h[:, None] - 1 - ys, 0, None)[:, :, None], axis=1) == mask
    half_x, half_y = valid & (xs < (w // 2)[:, None])[:, None, :], valid & (ys < (h // 2)[:, None])[:, :, None]
    symmetry = [np.where(two, share((a & b).sum(axis=(1, 2)), b.sum(axis=(1, 2))), 0) for a, b in ((across, half_x), (along, half_y))]

    inner = valid & ~edge
    bones = thin(mask, inner)
    degree = sum(moved(bones, *d).astype(np.int8) for d in eight)
    skeleton = [np.where(three, np.minimum(1, (bones & inner & c).sum(axis=(1, 2)) / 10), 0) for c in (degree >= 3, degree == 1)]

    both = mask & inner & (up.astype(np.int8) + right + down + left_of == 2)
    bend = sum((both & a & b & ~eight[d]).sum(axis=(1, 2)) for a, b, d in ((up, right, (-1, 1)), (right, down, (1, 1)), (down, left_of, (1, -1)), (left_of, up, (-1, -1))))
    corners = np.where(three & (boundary >= 5), np.minimum(1, bend / 20), 0)

    top, near = (ys < (h // 2)[:, None])[:, :, None], (xs < (w // 2)[:, None])[:, None, :]
    quarters = [share((mask & q).sum(axis=(1, 2)), (valid & q).sum(axis=(1, 2))) for q in (top & near, top & ~near, ~top & near, ~top & ~near)]

    profile = lambda a, size: resampled(a / a.max(axis=1, keepdims=True), size, PROFILE)
    out[some] = np.column_stack([
        profile(column, w), w / h, pixels / area, centre, left, serif, contrast, *counter, terminals, *bounds, *crossings, profile(row, h),
        np.minimum(1, parts(hole) / 4), *symmetry, *skeleton, corners, *quarters, stroke,
    ])
    return out, has


def descriptor(img: np.ndarray) -> np.ndarray | None:
    """The features of one raster; None without ink."""
    found, has = descriptors(img[None])
    return found[0] if has[0] else None


def lanczos(size: int, new: int) -> np.ndarray:
    """Weights (new, size) of Lanczos resampling with three lobes, widened where it shrinks."""
    ratio = size / new
    wide = max(ratio, 1.0)
    middle = (np.arange(new) + 0.5) * ratio
    low = np.clip(np.floor(middle - 3 * wide), 0, size - 1).astype(int)
    high = np.clip(np.ceil(middle + 3 * wide), low + 1, size).astype(int)
    at = np.arange(size)[None, :]
    t = (at - (middle[:, None] - 0.5)) / wide
    k = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0) * ((at >= low[:, None]) & (at < high[:, None]))
    return k / k.sum(axis=1, keepdims=True)


def gradient_histograms(imgs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orientation histograms of 4 x 4 cells with one norm of rasters (n, h, w) of one size, and whether they are large enough (3 px).

    Rasters are first scaled, up or down, until they fit a square, and centred on white.
    """
    n, h, w = imgs.shape
    if min(h, w) < 3:
        return np.zeros((n, CELLS * CELLS * ORIENTATIONS), np.float32), np.zeros(n, bool)
    scale = np.float32(min(SIDE / np.float32(w), SIDE / np.float32(h)))
    to = lambda k: max(1, int(np.floor(np.float32(k) * scale + np.float32(0.5))))
    if (to(h), to(w)) != (h, w):
        imgs = np.floor(np.clip(lanczos(h, to(h)) @ imgs.astype(float) @ lanczos(w, to(w)).T, 0, 255) + 0.5)
        h, w = imgs.shape[1:]
    sq = np.full((n, SIDE, SIDE), 255.0)
    oy, ox = (SIDE - h) // 2, (SIDE - w) // 2
    sq[:, oy : oy + h, ox : ox + w] = imgs
    gy, gx = np.gradient(sq, axis=(1, 2))
    size = np.hypot(gx, gy)
    place = np.mod(np.arctan2(gy, gx), np.pi) / (np.pi / ORIENTATIONS)
    low = np.floor(place).astype(int)
    part, low = place - low, low % ORIENTATIONS
    cell = np.arange(SIDE) * CELLS // SIDE
    bins = CELLS * CELLS * ORIENTATIONS
    base = np.arange(n)[:, None, None] * bins + (cell[:, None] * CELLS + cell[None, :]) * ORIENTATIONS
    out = np.bincount((base + low).ravel(), (size * (1 - part)).ravel(), n * bins) + np.bincount((base + (low + 1) % ORIENTATIONS).ravel(), (size * part).ravel(), n * bins)
    out = out.reshape(n, bins)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), out).astype(np.float32), np.ones(n, bool)


def gradient_histogram(img: np.ndarray) -> np.ndarray | None:
    """The histograms of one raster; None below 3 px."""
    found, ok = gradient_histograms(img[None])
    return found[0] if ok[0] else None


def seam(energy: np.ndarray) -> np.ndarray:
    """Column of the cheapest top-to-bottom path at each row; a step moves one column at most, the leftmost of equal ones wins."""
    h, w = energy.shape
    cost, back = energy[0].astype(float), np.zeros((h, w), np.int64)
    for y in range(1, h):
        p = np.pad(cost, 1, constant_values=np.inf)
        options = np.stack([p[:-2], p[1:-1], p[2:]])
        choice = options.argmin(axis=0)
        back[y] = choice - 1 + np.arange(w)
        cost = energy[y] + options[choice, np.arange(w)]
    path = np.empty(h, np.int64)
    path[-1] = cost.argmin()
    for y in range(h - 1, 0, -1):
        path[y - 1] = back[y, path[y]]
    return path


def cuts(img: np.ndarray, needed: int, below: int = 128) -> list[int]:
    """Columns that part a word's raster into ``needed`` characters: middles of inkless stretches, the most balanced first if there are too many, else the cheapest seams."""
    box = ink_box(img, below)
    if box is None or needed < 2:
        return []
    img = img[:, box[1]]
    blank = ~(img < below).any(axis=0)
    edge = np.diff(np.concatenate([[0], blank.astype(np.int8), [0]]))
    gaps = [(a + b) // 2 for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    chosen: list[int] = []
    energy = (255 - img).astype(float)
    while len(chosen) < needed - 1:
        bounds = [0, *sorted(chosen), img.shape[1]]
        a, b = max(zip(bounds, bounds[1:], strict=False), key=lambda x: x[1] - x[0])
        inside = [g for g in gaps if a < g < b and g not in chosen]
        if inside:
            chosen.append(int(min(inside, key=lambda g: (abs(g - (a + b) / 2), g))))
        elif b - a >= 4:
            third = max(1, (b - a) // 4)
            path = seam(energy[:, a + third : b - third])
            chosen.append(int(a + third + np.median(path)))
        else:
            break
    return [int(box[1].start + c) for c in sorted(set(chosen))]


def windowed_ssim(a: np.ndarray, b: np.ndarray, dy: int = 0, side: int = 11, step: int = 4, sigma: float = 1.5) -> float:
    """Mean structural similarity over Gaussian windows with 3 or more pixels that aren't white; b is moved down by dy and white outside."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    x, y = np.full((h, w), 255.0), np.full((h, w), 255.0)
    x[: a.shape[0], : a.shape[1]] = a
    src = b[max(0, -dy) : b.shape[0] - max(0, dy) if dy > 0 else b.shape[0]]
    y[max(0, dy) : max(0, dy) + len(src), : b.shape[1]] = src
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    if min(h, w) >= side:
        k = gaussian(side, sigma)
        view = lambda m: np.lib.stride_tricks.sliding_window_view(m, (side, side))[::step, ::step]
        p, q = view(x), view(y)
        some = ((p < 255).sum(axis=(2, 3)) >= 3) | ((q < 255).sum(axis=(2, 3)) >= 3)
        if some.any():
            p, q = p[some], q[some]
            mean = lambda m: (m * k).sum(axis=(1, 2))
            mp, mq = mean(p), mean(q)
            vp, vq, cov = mean(p * p) - mp * mp, mean(q * q) - mq * mq, mean(p * q) - mp * mq
            return float(np.clip((((2 * mp * mq + c1) * (2 * cov + c2)) / ((mp**2 + mq**2 + c1) * (vp + vq + c2))).mean(), 0, 1))
    mp, mq = x.mean(), y.mean()
    cov = ((x - mp) * (y - mq)).mean()
    return float(np.clip(((2 * mp * mq + c1) * (2 * cov + c2)) / ((mp**2 + mq**2 + c1) * (x.var() + y.var() + c2)), 0, 1))


def best_shift(a: np.ndarray, b: np.ndarray, most: int = 3, enough: float = 0.92) -> tuple[float, int]:
    """Greatest similarity over vertical shifts 0, -1, 1, -2, 2 ...; the first of equal ones, and none after one that is ``enough``."""
    best = (-1.0, 0)
    for dy in [0, *[s * k for k in range(1, most + 1) for s in (-1, 1)]]:
        value = windowed_ssim(a, b, dy)
        if value > best[0]:
            best = (value, dy)
        if value >= enough:
            break
    return best


def blurred(img: np.ndarray) -> np.ndarray:
    """A 3 x 3 blur by (1, 2, 1) / 4 along rows, then columns, edges repeated, rounded after each; rasters below 3 px stay."""
    if min(img.shape) < 3:
        return img
    for axis in (1, 0):
        p = np.pad(img.astype(np.int32), [(0, 0) if k != axis else (1, 1) for k in (0, 1)], mode="edge")
        take = lambda a, b: p[a : p.shape[0] + b] if axis == 0 else p[:, a : p.shape[1] + b]
        img = ((take(0, -2) + 2 * take(1, -1) + take(2, p.shape[axis]) + 2) // 4).astype(np.uint8)
    return img


def gaussian(side: int = 11, sigma: float = 1.5) -> np.ndarray:
    """Square Gaussian weights that add up to 1."""
    k = np.exp(-((np.arange(side) - side // 2) ** 2) / (2 * sigma**2))
    return np.outer(k, k) / k.sum() ** 2


def trimmed(img: np.ndarray, below: int = 230, least: float = 0.01) -> np.ndarray:
    """The raster without the outer rows and columns of which a hundredth or less is ink; as it is below 6 rows, without such rows, or where under 4 px would be left."""
    h, w = img.shape
    if not w or h < 6:
        return img
    ink = img < below
    rows, cols = np.flatnonzero(ink.mean(axis=1) > least), np.flatnonzero(ink.mean(axis=0) > least)
    if not len(rows):
        return img
    x0, x1 = (cols[0], cols[-1]) if len(cols) else (0, w - 1)
    return img if rows[-1] - rows[0] < 3 or x1 - x0 < 3 else img[rows[0] : rows[-1] + 1, x0 : x1 + 1]


def ink_cropped(img: np.ndarray) -> np.ndarray:
    """The raster within its ink box, or as it is without ink."""
    box = ink_box(img) if img.size else None
    return img if box is None else img[box]


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.floor(np.clip(lanczos(img.shape[0], height) @ img.astype(float) @ lanczos(img.shape[1], width).T, 0, 255) + 0.5).astype(np.uint8)


def global_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity from whole-raster sums, the smaller one filled with white, within 0 and 1."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    if not h or not w:
        return 0.0
    x, y = np.full((h, w), 255.0), np.full((h, w), 255.0)
    x[: a.shape[0], : a.shape[1]], y[: b.shape[0], : b.shape[1]] = a, b
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = x.mean(), y.mean()
    den = (mx * mx + my * my + c1) * ((x * x).mean() - mx * mx + (y * y).mean() - my * my + c2)
    return 0.0 if den < 1e-10 else float(np.clip((2 * mx * my + c1) * (2 * ((x * y).mean() - mx * my) + c2) / den, 0, 1))


def trimmed_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two rasters trimmed and brought to the larger sides; 0 for an empty one."""
    a, b = trimmed(a), trimmed(b)
    if not a.size or not b.size:
        return 0.0
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    return global_ssim(resized(a, h, w), resized(b, h, w))


def correlation(a: np.ndarray, b: np.ndarray, dy: int = 0, bail: float | None = None) -> float:
    """Correlation of a with b read dy rows further down, white outside; 0 below 4 pixels, 1 where either is flat.

    With bail, the running bound (what is summed, and the most that the rest can add) is looked at every so many pixels, and
    the first one below ends the sum.
    """
    h, w = a.shape
    x, y = a.astype(float), np.full((h, w), 255.0)
    lo, hi, wide = max(0, -dy), min(h, b.shape[0] - dy), min(w, b.shape[1])
    if hi > lo:
        y[lo:hi, :wide] = b[lo + dy : hi + dy, :wide]
    n = x.size
    if n < 4:
        return 0.0
    x, y = x.ravel(), y.ravel()
    va, vb = (v @ v - v.sum() ** 2 / n for v in (x, y))
    den = np.sqrt(max(va * vb, 0.0))
    if den < 1e-10:
        return 1.0
    x, y = x - x.mean(), y - y.mean()
    if bail is not None:
        step = max(1, min(200, n // 4))
        at = np.arange(step, n, step) - 1
        bound = (np.cumsum(x * y)[at] + np.sqrt(np.maximum(va - np.cumsum(x * x)[at], 0) * np.maximum(vb - np.cumsum(y * y)[at], 0))) / den
        if (low := np.flatnonzero(bound < bail)).size:
            return float(np.clip(bound[low[0]], -1, 1))
    return float(np.clip(x @ y / den, -1, 1))


def best_correlation(a: np.ndarray, b: np.ndarray, most: int = 3, bail: float | None = None, enough: float = 0.96) -> tuple[float, int]:
    """(value within 0 and 1, shift): the greatest correlation over shifts 0, -1, 1, -2, 2 ..., the first of equal ones; none after one that is ``enough``."""
    best = (-1.0, 0)
    for dy in [0, *[s * k for k in range(1, most + 1) for s in (-1, 1)]]:
        value = correlation(a, b, dy, None if bail is None else 2 * bail - 1)
        if value > best[0]:
            best = (value, dy)
            if value >= enough:
                break
    return (min(1.0, max(-1.0, best[0])) + 1) / 2, best[1]


def painted(img: np.ndarray, boxes: list[tuple[int, int, int, int]], colour, margin: int = 0) -> np.ndarray:
    """The raster with (x, y, width, height) boxes and a margin around them in one colour."""
    out = img.copy()
    for x, y, w, h in boxes:
        out[max(0, y - margin) : max(0, y + h + margin), max(0, x - margin) : max(0, x + w + margin)] = colour
    return out


#: Ink of the first raster alone, of the second alone, and the rest; what counts as ink.
FIRST_ONLY, SECOND_ONLY, ALIKE, DIFFERENCE_INK = (220, 30, 30), (30, 80, 220), (255, 255, 255), 180


def coloured_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where only one of two rasters has ink, in colour; the second is brought to the first one's size."""
    b = b if a.shape == b.shape else resized(b, *a.shape)
    one, other = a < DIFFERENCE_INK, b < DIFFERENCE_INK
    out = np.full((*a.shape, 3), ALIKE, np.uint8)
    out[one & ~other], out[other & ~one] = FIRST_ONLY, SECOND_ONLY
    return out


def ink_normalised(img: np.ndarray, height: int = SIDE, below: int = INK_BELOW) -> np.ndarray | None:
    """The ink box with a white pixel around it, scaled to a height; None without ink or below 2 px of width."""
    box = ink_box(img, below) if img.size else None
    if box is None:
        return None
    canvas = np.pad(img[box], 1, constant_values=255)
    h, w = canvas.shape
    wide = int(np.ceil(np.float32(w) * np.float32(height) / np.float32(h)))
    return canvas if h == height else None if wide < 2 else resized(canvas, height, wide)


def ink_middle(img: np.ndarray) -> tuple[float, float] | None:
    """Middle (x, y) of the first and last inked column and row; None without ink."""
    box = ink_box(img) if img.size else None
    return None if box is None else ((box[1].start + box[1].stop - 1) / 2, (box[0].start + box[0].stop - 1) / 2)


def seam_limit(img: np.ndarray, seam: list[tuple[int, int]], row: int) -> int | None:
    """Where a seam (row, column) parts a row: after it if its left neighbour is as dark as the right one or darker, else before it; None where it doesn't pass."""
    cols = [c for r, c in seam if r == row]
    if not cols:
        return None
    low, high = min(cols), max(cols)
    left = img[row, low - 1] if low > 0 else 255
    right = img[row, high + 1] if high + 1 < img.shape[1] else 255
    return high + 1 if left <= right else low


def seam_crop(img: np.ndarray, left: int, right: int, left_seam=None, right_seam=None, height: int | None = None, least: int = 2) -> tuple[np.ndarray, int] | None:
    """(raster, x): what lies between two cuts, white beyond their seams; it reaches as far as the seams wind. None if it is narrower than ``least``."""
    w = img.shape[1]
    height = img.shape[0] if height is None else min(height, img.shape[0])
    x0 = min(min([c for _, c in left_seam or []] + [left]), w)
    x1 = min(max([c for _, c in right_seam] + [right]) + 1 if right_seam is not None else right, w)
    if x1 <= x0 or x1 - x0 < least:
        return None
    out = img[:height, x0:x1].copy()
    for y in range(height):
        a = seam_limit(img, left_seam or [], y)
        a = x0 if a is None else min(max(a, x0), x1)
        b = seam_limit(img, right_seam or [], y)
        b = x1 if b is None else max(min(max(b, x0), x1), a)
        out[y, : a - x0] = 255
        out[y, b - x0 :] = 255
    return out, x0


def sequence_crop(img: np.ndarray, i: int, n: int, bounds: list[int], seams: dict, height: int | None = None) -> np.ndarray | None:
    """n characters from the i-th on, between their cuts and seams, scaled by their ink; None beyond the last cut."""
    if i + n >= len(bounds):
        return None
    found = seam_crop(img, bounds[i], bounds[i + n], seams.get(bounds[i]), seams.get(bounds[i + n]), height, 2 * n)
    return None if found is None else ink_normalised(found[0])


#: Fixed value: what counts as ink for a character's box.
BOX_INK = 200


def character_metrics(img: np.ndarray, i: int, bounds: list[int], seams: dict, height: int | None = None) -> tuple[int, int, int, int, float, float] | None:
    """(x_min, x_max, y_min, y_max, cx, cy) of a character's ink in its word; the middle is that of its fractional edges."""
    from scanlake.operators.wordink import fractional_edges

    found = seam_crop(img, bounds[i], bounds[i + 1], seams.get(bounds[i]), seams.get(bounds[i + 1]), height) if i + 1 < len(bounds) else None
    box = None if found is None else ink_box(found[0], BOX_INK)
    if box is None:
        return None
    dark, x0 = 255 - found[0].astype(int), found[1]
    (fl, fr), (ft, fb) = (fractional_edges(dark.max(axis=k), 255 - INK_BELOW) for k in (0, 1))
    return x0 + box[1].start, x0 + box[1].stop - 1, box[0].start, box[0].stop - 1, x0 + (fl + fr) / 2, (ft + fb) / 2


def png(img: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) raster as a PNG file."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = img.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def data_uri(img: np.ndarray) -> str:
    import base64

    return "data:image/png;base64," + base64.b64encode(png(img)).decode()


def skew_edges(img: np.ndarray) -> np.ndarray:
    """Horizontal edges at 600 pixels width at most: a vertical Sobel gradient above a fifth of the greatest."""
    h, w = img.shape
    scale = np.float32(600) / np.float32(w) if w > 600 else np.float32(1)
    sh, sw = max(1, int(np.float32(h) * scale)), max(1, int(np.float32(w) * scale))
    if h < 3 or w < 3:
        return np.zeros((sh, sw), bool)
    g = img.astype(np.int32)
    rows = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    sobel = np.zeros((h, w), np.int32)
    sobel[1:-1, 1:-1] = np.abs(rows[2:] - rows[:-2])
    back = np.float32(1) / scale
    sy, sx = (np.minimum((np.arange(k, dtype=np.float32) * back).astype(int), m - 1) for k, m in ((sh, h), (sw, w)))
    grad = sobel[np.ix_(sy, sx)]
    grad[[0, -1]], grad[:, [0, -1]] = 0, 0
    return grad > int(np.float32(grad.max()) * np.float32(0.2))


def skew_degrees(img: np.ndarray, most: float = 5.0, step: float = 0.05, sure: bool = True) -> float:
    """Angle of the text lines by votes of near-horizontal lines; 0 unless the peak is clear (sure=False: the best angle anyway).

    Votes from 0.3 of the greatest count. The best angle must have twice the mean votes and 1.5 times those of any other but its
    neighbours, stand out from these, and have two bands of lines 20 px apart; it is refined by a parabola.
    """
    ys, xs = np.nonzero(skew_edges(img))
    if not len(ys):
        return 0.0
    sh, sw = skew_edges(img).shape
    far = int(np.ceil(np.hypot(sh, sw)))
    degrees = np.float32(90 - most) + np.arange(round(2 * most / step) + 1, dtype=np.float32) * np.float32(step)
    votes = np.empty((len(degrees), 2 * far + 1), np.int64)
    for k, t in enumerate(np.radians(degrees)):
        rho = xs.astype(np.float32) * np.cos(t) + ys.astype(np.float32) * np.sin(t)
        votes[k] = np.bincount((np.copysign(np.floor(np.abs(rho) + np.float32(0.5)), rho)).astype(int) + far, minlength=2 * far + 1)
    if votes.max() < 10:
        return 0.0
    strong = votes >= int(np.float32(votes.max()) * np.float32(0.3))
    sums = np.where(strong, votes, 0).sum(axis=1)
    best = len(sums) - 1 - int(sums[::-1].argmax())
    apart = np.abs(np.arange(len(sums)) - best) > 1
    if not sure:
        return float(degrees[best] - 90)
    if best in (0, len(sums) - 1) or sums[best] < 2 * sums.mean() or sums[best] < 1.5 * sums[apart].max():
        return 0.0
    bend = float(2 * sums[best] - sums[best - 1] - sums[best + 1])
    lines = np.flatnonzero(strong[best])
    if bend <= 0.05 * sums[best] or 1 + int((np.diff(lines) > 20).sum()) < 2:
        return 0.0
    return float(degrees[best] - 90 + (sums[best + 1] - sums[best - 1]) / (2 * bend) * step)


def rotated(img: np.ndarray, degrees: float) -> np.ndarray:
    """The raster turned about its middle, bilinear; white where one of the four pixels lies outside."""
    h, w = img.shape
    t = np.radians(np.float32(degrees))
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    y, x = y - np.float32(h / 2), x - np.float32(w / 2)
    sx, sy = np.cos(t) * x + (np.sin(t) * y + np.float32(w / 2)), -np.sin(t) * x + (np.cos(t) * y + np.float32(h / 2))
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    ok = (fx >= 0) & (fy >= 0) & (fx + 1 < w) & (fy + 1 < h)
    ax, ay = sx - fx, sy - fy
    at = lambda dy, dx: img[np.where(ok, fy + dy, 0), np.where(ok, fx + dx, 0)].astype(np.float32)
    out = at(0, 0) * (1 - ax) * (1 - ay) + at(0, 1) * ax * (1 - ay) + at(1, 0) * (1 - ax) * ay + at(1, 1) * ax * ay
    return np.where(ok, np.floor(out + np.float32(0.5)), 255).astype(np.uint8)


def slices(batch: pa.RecordBatch, column: str = "px", most: int = HELD):
    """The batch in views of about ``most`` bytes of its binary column each, a row at least, so that what is made of them stays small whatever the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = [0, *(np.flatnonzero(np.diff(sizes.cumsum() // most)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


def map_rasters(rasters: DataFrame, kernel, kind: str, name: str, keep: tuple = ("id",)) -> DataFrame:
    """Adds ``kernel(raster)`` as column ``name`` (an array or number, null for None) to rows of id, width, height, px, HELD bytes at a time."""
    kinds = dict(rasters.dtypes)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = [None if px is None else kernel(raster(px, w, h)) for px, w, h in zip(*(batch.column(c).to_pylist() for c in ("px", "width", "height")), strict=True)]
            values = [x.tolist() if isinstance(x, np.ndarray) else x for x in found]
            types = {"array<float>": pa.list_(pa.float32()), "array<int>": pa.list_(pa.int32()), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(values, types[kind])], [*keep, name])

    return rasters.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], f"{name} {kind}"]))


def map_batches(rasters: DataFrame, kernel, name: str, keep: tuple = ("id",), partitions: int | None = None) -> DataFrame:
    """Adds ``kernel(rasters of one size)`` as array column ``name``, null where the kernel says so, to rows of id, width, height, px.

    Rasters are dealt over the partitions, as one small file can hold many, and those of one size among HELD bytes
    are handled at once, STACK pixels at a time.
    """
    kinds = dict(rasters.dtypes)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            px, w, h = (batch.column(c).to_pylist() for c in ("px", "width", "height"))
            found: list = [None] * len(px)
            sizes: dict = {}
            for k, p in enumerate(px):
                if p is not None:
                    sizes.setdefault((h[k], w[k]), []).append(k)
            for (hh, ww), own in sizes.items():
                step = max(1, STACK // max(1, hh * ww))
                for a in range(0, len(own), step):
                    some = own[a : a + step]
                    values, ok = kernel(np.stack([raster(px[k], ww, hh) for k in some]))
                    for k, v, good in zip(some, values, ok, strict=True):
                        found[k] = v if good else None
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.list_(pa.float32()))], [*keep, name])

    dealt = rasters.repartition(partitions or rasters.sparkSession.sparkContext.defaultParallelism, *keep)
    return dealt.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], f"{name} array<float>"]))


def memoized(rasters: DataFrame, kernel, kind: str, name: str, id_: str = "id") -> DataFrame:
    """The kernel once per distinct raster, joined back to all that have it."""
    hashed = rasters.withColumn("h_", F.sha2(F.concat_ws(":", F.hex("px"), F.col("width").cast("string")), 256))
    once = hashed.groupBy("h_").agg(F.first("px").alias("px"), F.first("width").alias("width"), F.first("height").alias("height"))
    return hashed.select(id_, "h_").join(map_rasters(once, kernel, kind, name, ("h_",)), "h_").drop("h_")
