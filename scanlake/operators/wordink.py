"""Word boxes refined by the ink of their page: grown to it, parted at white space, trimmed to it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from scanlake.operators.kernels import raster


@dataclass
class Box:
    """A word's box in whole pixels."""

    x: int
    y: int
    width: int
    height: int

    @property
    def right(self) -> int:
        return self.x + self.width

    @property
    def bottom(self) -> int:
        return self.y + self.height


def walk(dark: np.ndarray, start: int, limit: int, forward: bool) -> int:
    """How far from start the unbroken dark stretch goes, up to limit; dark says of each place whether it has ink."""
    if forward:
        stretch = dark[start : max(start, min(limit, len(dark)))]
        return start + (len(stretch) if stretch.all() else int(stretch.argmin()))
    stretch = dark[np.minimum(np.arange(limit, max(limit, start)), len(dark) - 1)][::-1]
    return start - (len(stretch) if stretch.all() else int(stretch.argmin()))


def fractional_edges(darkness: np.ndarray, least: int) -> tuple[float, float] | None:
    """First and last place of at least so much darkness, each moved inward by what its darkness lacks to the greatest; None without one."""
    at = np.flatnonzero(darkness >= least)
    if not len(at):
        return None
    top = float(darkness.max())
    part = lambda k: darkness[k] / top if top > 0 else 1.0
    return at[0] + 1.0 - part(at[0]), at[-1] + part(at[-1])


def extent(img: np.ndarray, across: tuple[int, int], along: tuple[int, int], below: int, vertical: bool = False) -> tuple[float, float]:
    """Fractional ends of the ink within a band; the start of the search twice without any. across is the band, along the search."""
    if vertical:
        img = img.T
    h, w = img.shape
    lo, hi = (across[0] if vertical else min(across[0], h - 1)), min(across[1], h)
    a, b = min(along[0], w), min(along[1], w)
    if a >= b or lo >= hi:
        return float(a), float(a)
    found = fractional_edges(255 - img[lo:hi, a:b].min(axis=0).astype(int), 256 - below)
    return (a + found[0], a + found[1]) if found else (float(a), float(a))


def expand(boxes: list[Box], img: np.ndarray, below: int, blur: int, margin: int) -> None:
    """Grows the words of one line, in their order, to the ink at their sides; neighbours give up white space for it."""
    h, w = img.shape
    ink = lambda x0, x1, y0, y1, limit=below: (img[y0:y1, np.minimum(np.arange(x0, max(x0, x1)), w - 1)] < limit).any(axis=0)
    for i, own in enumerate(boxes):
        limit = boxes[i + 1].x if i + 1 < len(boxes) else min(own.right + margin, w)
        if own.right < limit and own.right < w and ink(max(0, own.right - 1), max(0, own.right - 1) + 1, own.y, own.bottom).any():
            own.width = max(own.width, walk(ink(0, w, own.y, own.bottom, blur), own.right, limit, True) - own.x)
        limit = max(0, own.x - margin)
        if i:
            before = boxes[i - 1]
            limit, columns = before.right, ink(before.x, before.right, before.y, before.bottom)
            inked = np.flatnonzero(columns)
            shrink = before.x + int(inked[-1]) + 1 if len(inked) else before.x
            if shrink < before.right:
                before.width, limit = max(0, shrink - before.x), shrink
            elif own.x <= before.right:
                top, bottom = min(before.y, own.y), max(before.bottom, own.bottom)
                left = max(max(0, before.right - before.y), before.x)
                white = np.flatnonzero(~ink(left, own.x, top, bottom)) if own.x > left else []
                if len(white):
                    limit = left + int(white[-1])
                    before.width = max(0, limit - before.x)
        if own.x > limit and (ink(limit, own.x, own.y, own.bottom).any() or ink(own.x, own.x + 1, own.y, own.bottom).any()):
            left = walk(ink(0, w, own.y, own.bottom, blur), own.x, limit, False)
            own.x, own.width = left, own.width + own.x - left
        right = min(own.right, w)
        rows = (img[:, own.x : right] < blur).any(axis=1)
        top = walk(rows, own.y, max(0, own.y - margin), False)
        bottom = walk(rows, own.bottom, min(own.bottom + margin, h), True)
        if top < own.y or bottom > own.bottom:
            own.y, own.height = top, bottom - top


def part(boxes: list[Box], img: np.ndarray, below: int) -> None:
    """Parts words of one line that overlap at the white stretch between their middles that is nearest to the overlap; without one the left word ends where the right one starts."""
    h, w = img.shape
    for a, b in zip(boxes, boxes[1:], strict=False):
        if a.right <= b.x:
            continue
        lo = max(min(a.x + a.width // 2, max(0, w - 1)), min(a.x, b.x))
        hi = min(b.x + b.width // 2, w, max(a.right, b.right))
        top, bottom = min(a.y, b.y), min(max(a.bottom, b.bottom), h)
        done = False
        if lo < hi and top < bottom:
            edge = np.diff(np.concatenate([[0], (~(img[top:bottom, lo:hi] < below).any(axis=0)).astype(np.int8), [0]]))
            runs = [(lo + int(s), lo + int(e) - 1) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            if runs:
                middle = (a.right + b.x) // 2
                start, end = min(runs, key=lambda r: (abs((r[0] + r[1]) // 2 - middle), r[0] - r[1]))
                if start > a.x and end + 1 < b.right and end + 1 > a.x:
                    a.width, b.width, b.x = start - a.x, b.right - end - 1, end + 1
                    done = True
        if not done and b.x > a.x:
            a.width = b.x - a.x


def trim(boxes: list[Box], img: np.ndarray, below: int) -> None:
    """Cuts white space off the sides of words over 2 pixels wide and high; words without ink stay."""
    h, w = img.shape
    for own in boxes:
        if own.width <= 2 or own.height <= 2:
            continue
        x, y = min(own.x, max(0, w - 1)), min(own.y, max(0, h - 1))
        right, bottom = min(x + min(own.width, w - x), w), y + min(own.height, h - y)
        left, end = extent(img, (y, bottom), (x, right), below)
        if end > left:
            own.x = int(np.floor(left))
            own.width = int(np.ceil(end)) - own.x


def word_widths(img: np.ndarray, boxes: list[Box], x: int, y: int, below: int = 240) -> list[float]:
    """The ink width of each word within a crop that starts at (x, y) of the page, fractional; the box's width where there is less than a pixel."""
    h, w = img.shape
    out = []
    for own in boxes:
        left, top = max(0, own.x - x), max(0, own.y - y)
        wide, high = min(own.width, w - left), min(own.height, h - top)
        ends = extent(img, (top, top + high), (left, left + wide), below) if left < w and top < h and wide >= 1 and high >= 1 else (0.0, 0.0)
        out.append(ends[1] - ends[0] if ends[1] - ends[0] >= 1 else float(own.width))
    return out


def refine(boxes: list[Box], img: np.ndarray, below: int = 240, blur: int = 250, margin: int = 5) -> None:
    expand(boxes, img, below, blur, margin)
    part(boxes, img, below)
    trim(boxes, img, below)


def refined(words: DataFrame, pages: DataFrame, page: str, line: str, order: str, below: int = 240, blur: int = 250, margin: int = 5) -> DataFrame:
    """The words with boxes refined by their page's raster (pages: page, width, height, px), a page at a time; pages without a raster are left out.

    A page's words are few next to its pixels, which one task has to hold in any case.
    """
    kinds = dict(words.dtypes)

    def one(key: tuple, own: pd.DataFrame, sheet: pd.DataFrame) -> pd.DataFrame:
        if not len(sheet) or not len(own):
            return own.iloc[:0]
        img = raster(sheet["px"].iloc[0], int(sheet["width"].iloc[0]), int(sheet["height"].iloc[0]))
        own = own.sort_values([line, order], ignore_index=True)
        for _, rows in own.groupby(line):
            boxes = [Box(*map(int, r)) for r in rows[["x", "y", "width", "height"]].itertuples(index=False)]
            refine(boxes, img, below, blur, margin)
            own.loc[rows.index, ["x", "y", "width", "height"]] = [(b.x, b.y, b.width, b.height) for b in boxes]
        return own

    return words.groupBy(page).cogroup(pages.groupBy(page)).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in words.columns))
