"""Kernels of operator 1: anchors of a block of text and the blockwise sorting of its suffixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes of an anchor, which is what a text's suffixes are bucketed by.
K = 16
#: Bits of an anchor's hash; the other 20 bits of a sort key hold a place within a step.
HASH_BITS = 44
STEP = 1 << 19
#: The cover sample: places whose residue mod PERIOD is in COVER. For every two residues there is a shift below PERIOD that
#: takes both into COVER, the numbers of SHIFT.
PERIOD, COVER = 7, (0, 1, 3)
SHIFT = [[next(d for d in range(PERIOD) if (x + d) % PERIOD in COVER and (y + d) % PERIOD in COVER) for y in range(PERIOD)] for x in range(PERIOD)]
#: Suffixes of a bucket by leading bytes, about, which is sorted at a time.
SUFFIXES = 1 << 17

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, dtype=np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
    return up, down


_UP, _DOWN = _powers(STEP + 256)


def words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as numbers; data has 8 more bytes at least."""
    out, raw = np.empty(n, dtype=np.uint64), data.tobytes()
    for r in range(min(8, n)):
        m = (n - r + 7) // 8
        out[r::8] = np.frombuffer(raw, dtype="<u8", count=m, offset=r)
    return out


def finish(x: np.ndarray, length) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ (np.asarray(length, dtype=np.uint64) * _M2)) * _M3
    return x ^ (x >> np.uint64(29))


def evened(h: np.ndarray) -> np.ndarray:
    """A permutation of the hashes that spreads the small ones, which anchors have as the least of many, over the range."""
    mask = np.uint64((1 << HASH_BITS) - 1)
    with np.errstate(over="ignore"):
        for m in (_M1, _M2):
            h = (h * m) & mask
            h ^= h >> np.uint64(HASH_BITS // 2)
    return h


class Block:
    """Runs of windows of some documents' bytes laid end to end.

    A window is ``depth`` bytes within a document. Its anchor is the K bytes in it with the least hash (the first of
    equal ones), so that equal windows have equal anchors at the same place in them. A run is a stretch of windows
    with one anchor. For each run: p, the place of the anchor; a and b, its first and last window; h, the anchor's
    hash; doc, its document's number; c, a hash of its bytes. Other text never changes what a window yields.
    """

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, self.span = depth, depth - K + 1
        self.left = self.span - 1
        self.sizes = np.array([len(x) for x in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.n = int(self.ends[-1]) if len(texts) else 0
        self.data = np.frombuffer(b"".join(texts) + bytes(depth + 64), dtype=np.uint8)
        parts = [self._step(x, min(x + STEP, self.n)) for x in range(0, self.n, STEP)]
        self.p, self.a, self.b, self.h, self.doc, self.c = (np.concatenate([x[k] for x in parts]) if parts else np.empty(0, np.uint64 if k in (3, 5) else np.int64) for k in range(6))

    def _step(self, x: int, y: int):
        n, span = y - x, self.span
        w = words_at(self.data[x : y + span + K + 16], n + span + 8)
        with np.errstate(over="ignore"):
            key = w[: n + span] * _M1 + w[8 : n + span + 8] * _M2
            key ^= key >> np.uint64(29)
            key *= _M3
        key = (key & ~_PLACE) | np.arange(n + span, dtype=np.uint64)
        low, width = key, 1
        while 2 * width <= span:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        low = np.minimum(low[:n], low[span - width : span - width + n])
        doc = np.searchsorted(self.ends, np.arange(x, y, 4096), side="right")
        first, last = int(doc[0]), int(np.searchsorted(self.ends, y - 1, side="right"))
        own = np.arange(first, last + 1)
        lo, hi = np.maximum(self.starts[own], x) - x, np.minimum(self.ends[own] - self.depth + 1, y) - x
        ok = hi > lo
        own, lo, hi = own[ok], lo[ok], hi[ok]
        if not len(own):
            return (*[np.empty(0, np.int64)] * 3, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64))
        new = np.zeros(n + 1, dtype=bool)
        new[1:n] = low[1:] != low[:-1]
        new[lo] = True
        new[hi] = True
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[lo] += 1
        np.subtract.at(inside, hi, 1)
        inside = np.cumsum(inside, dtype=np.int8)[:n].astype(bool)
        a = np.flatnonzero(new[:n] & inside)
        after = np.flatnonzero(new)
        b = after[np.searchsorted(after, a, side="right")] if after[-1] > a[-1] else np.r_[after[np.searchsorted(after, a[:-1], side="right")], n]
        b = b - 1
        p = (low[a] & _PLACE).astype(np.int64)
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum(self.data[x : y + self.depth].astype(np.uint64) * _UP[: n + self.depth])]
            c = finish((total[b + self.depth] - total[a]) * _DOWN[a], b - a + self.depth)
        return p + x, a + x, b + x, evened(low[a] >> np.uint64(64 - HASH_BITS)), own[np.searchsorted(lo, a, side="right") - 1], c

    def singles(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, h: np.ndarray, doc: np.ndarray):
        """Runs as one run a window: s, p, doc and a hash of the window's bytes."""
        n = b - a + 1
        s = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        c, view = np.empty(len(s), dtype=np.uint64), np.lib.stride_tricks.sliding_window_view(self.data, self.depth)
        with np.errstate(over="ignore"):
            for k in range(0, len(s), 65536):
                c[k : k + 65536] = finish((view[s[k : k + 65536]].astype(np.uint64) * _UP[: self.depth]).sum(axis=1, dtype=np.uint64), self.depth)
        return s, np.repeat(p, n), np.repeat(doc, n), c

    def contexts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bytes of runs one after the other."""
        size = b - a + self.depth
        ends = np.cumsum(size)
        return self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(a - ends + size, size)]


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of numbers, equal ones alike."""
    order = np.argsort(keys)
    new = np.zeros(len(order), dtype=np.int64)
    s = keys[order]
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


class Cover:
    """Ranks of the suffixes at the places of the difference cover, by their first ``depth`` bytes or more.

    Ranks by 16 bytes come from two words; those of twice the length and more from pairs of ranks, as a sampled place and
    the one a multiple of PERIOD further are both in the sample.
    """

    def __init__(self, words: np.ndarray, n: int, depth: int):
        periods = -(-n // PERIOD)
        self.slot = np.full(PERIOD, -1)
        self.slot[list(COVER)] = np.arange(len(COVER))
        at = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        at = np.minimum(at, n)
        first = dense(words[at])
        rank, reach = dense(first << 32 | dense(words[np.minimum(at + 8, len(words) - 1)])), 16
        while reach < depth:
            step = reach // PERIOD
            ahead = np.zeros(len(rank), dtype=np.int64)
            ahead[: -step * len(COVER) or None] = rank[step * len(COVER) :] + 1
            rank, reach = dense(rank << 32 | ahead), step * PERIOD + reach
        self.rank = rank

    def __call__(self, places: np.ndarray) -> np.ndarray:
        """The ranks of sampled places."""
        return self.rank[places // PERIOD * len(COVER) + self.slot[places % PERIOD]]


def in_order(places: np.ndarray, group: np.ndarray, cover: Cover) -> np.ndarray:
    """The order of suffixes whose first bytes (PERIOD of them at least) are alike within a group; groups are numbered in order.

    Two suffixes compare by the ranks at the shift that takes both into the sample, which depends on their residues only.
    So a suffix's place is found residue by residue: how many suffixes of its group with that residue have a smaller rank
    at their common shift.
    """
    residue, less = places % PERIOD, np.zeros(len(places), dtype=np.int64)
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    for x in range(PERIOD):
        for y in range(PERIOD):
            own, other = members[x], members[y]
            if len(own) and len(other):
                shift = SHIFT[x][y]
                keys = np.sort(group[other] << 32 | cover(places[other] + shift))
                less[own] += np.searchsorted(keys, group[own] << 32 | cover(places[own] + shift)) - np.searchsorted(keys, group[own] << 32)
    return np.argsort(group << 32 | less)


def tied(keys: np.ndarray) -> np.ndarray:
    """Which of sorted numbers equal a neighbour."""
    same = keys[1:] == keys[:-1]
    return np.r_[False, same] | np.r_[same, False]


def least_of_windows(text: np.ndarray, size: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """For each window of ``depth`` bytes in texts laid end to end the least value of a text with that window.

    size: bytes of each text, value: its number. The suffixes that start a window are sorted one bucket by leading bytes
    at a time: by their first 8 bytes, ties by the next 8, and the ties left, mostly long ones, by the ranks of the
    cover sample, computed beforehand. Neighbours in that order that share ``depth`` bytes are equal windows. So beyond
    the text the working set is the sample's ranks and one bucket.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 2 * PERIOD + 24, np.uint8)])
    words = words_at(padded, n + depth + PERIOD).byteswap()
    count = size - depth + 1
    owner = np.repeat(np.arange(len(size)), count)
    start = np.cumsum(size) - size
    places = np.arange(len(owner)) + np.repeat(start - np.cumsum(count) + count, count)
    least = value[owner]
    lead = (words[places] >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(lead, kind="stable")
    ends = np.cumsum(np.bincount(lead, minlength=1 << 16))
    cover, a = None, 0
    while a < len(order):
        z = int(ends[max(int(lead[order[a]]), int(np.searchsorted(ends, a + SUFFIXES, side="right")) - 1)])
        own, a = order[a:z], z
        first = words[places[own]]
        by = np.argsort(first)
        own, first = own[by], first[by]
        keep = tied(first)
        own, first = own[keep], dense(first[keep])
        if not len(own):
            continue
        second = dense(words[places[own] + 8])
        both = first << 32 | second
        by = np.argsort(both)
        own, both = own[by], both[by]
        keep = tied(both)
        own, group = own[keep], dense(both[keep])
        if not len(own):
            continue
        cover = cover or Cover(words, n, depth)
        own = own[in_order(places[own], group, cover)]
        p = places[own]
        same = np.ones(len(p) - 1, dtype=bool)
        for k in (*range(0, depth - 8, 8), depth - 8):
            w = words[p + k]
            same &= w[1:] == w[:-1]
        window = np.cumsum(np.r_[0, ~same])
        low = np.full(int(window[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, window, least[own])
        least[own] = low[window]
    return least
