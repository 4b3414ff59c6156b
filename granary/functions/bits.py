"""Pairs of 64-bit hashes within a radius that is too wide for a join on bands: how to look for them, and the comparison of two blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil, comb, log2
from typing import NamedTuple

import numpy as np

BITS = 64
#: Rows of a block at most, and of the least that is split for more tasks.
MOST, LEAST = 1 << 20, 1 << 12
#: Comparisons made at once, a multiple of 8, and pairs given at once, about.
TILE, FOUND = 1 << 16, 1 << 16
#: Seconds, about, of a comparison, a bucket, each bucket near it, each row there, a row that is sent to a task, and a task.
PAIR, BUCKET, NEAR, ROW, SENT, TASK = 2.5e-9, 6e-5, 1e-8, 1e-8, 2e-7, 0.05


class Band(NamedTuple):
    """`width` bits from `lo` on, of which `most` may differ; rows lie in buckets by the upper `bits` of them."""

    lo: int
    width: int
    most: int
    bits: int

    def upper(self, h: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(h), np.uint64)
        return (h >> np.uint64(self.lo + self.width - self.bits)) & np.uint64((1 << self.bits) - 1)


def share(bits: int, most: int) -> float:
    """Share of random pairs that differ in `most` of so many bits, or fewer."""
    return sum(comb(bits, k) for k in range(min(bits, most) + 1)) / 2**bits


def cost(n: int, blocks: int, most: int, bits: int) -> float:
    """Seconds, about, to compare n rows with those in buckets near theirs."""
    buckets = 2**bits * min(1.0, n / blocks / 2**bits) * blocks * (blocks + 1) / 2
    return share(bits, most) * n * n / 2 * PAIR + buckets * (BUCKET + share(bits, most) * (2**bits * NEAR + n / blocks * ROW))


def plan(n: int, radius: int) -> tuple[list[Band], int]:
    """Bands, and the number of blocks, for n rows.

    Hashes within the radius differ in `most` bits or fewer in one band at least, as all `most` + 1 add up to radius + 1.
    Of the numbers of bands the cheapest is taken: one band compares all with all, more of them compare a part and send
    rows more often. At a radius of 16 about a third of random pairs is compared at 100,000 rows, a fifth at 500,000 and
    7 % at 2,600,000.
    """
    blocks = max(1, min(4, ceil(n / LEAST)), ceil(n / MOST))
    ways = []
    for m in range(1, min(radius + 1, BITS) + 1):
        edges = [BITS * i // m for i in range(m + 1)]
        each, more = divmod(radius + 1 - m, m)
        wide = sorted(range(m), key=lambda i: (edges[i] - edges[i + 1], i))[:more]
        bands = []
        for i, (lo, hi) in enumerate(pairwise(edges)):
            most = each + (i in wide)
            bits = min(range(min(hi - lo, int(log2(max(n, 1))) + 1) + 1), key=lambda b: cost(n, blocks, most, b))
            bands.append(Band(lo, hi - lo, most, bits))
        ways.append((sum(cost(n, blocks, b.most, b.bits) for b in bands) + m * blocks * (n * SENT + (blocks + 1) / 2 * TASK), bands))
    return min(ways)[1], blocks


def near_places(left: np.ndarray, right: np.ndarray | None, bands: list[Band], at: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in left and right (None: left, each pair once) and distances of pairs within the radius that the band numbered `at` is the first to show."""
    band, alone = bands[at], right is None
    top = 1 << band.bits
    flips = np.arange(top)
    flips = flips[np.bitwise_count(flips) <= band.most]

    def dealt(h):
        key = band.upper(h)
        order = np.argsort(key, kind="stable")
        return order, h[order], np.searchsorted(key[order], np.arange(top + 1, dtype=np.uint64))

    places, a, begins = dealt(left)
    others, b, starts = (places, a, begins) if alone else dealt(right)
    sizes, row = np.diff(starts), np.arange(len(b))
    xor, count, fit = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, bool)
    found, n = [], 0

    def first():
        i, j, x = (np.concatenate(y) for y in zip(*found, strict=True))
        new = j > i if alone else np.ones(len(i), bool)
        for e in bands[:at]:  # what its buckets have shown
            new &= np.bitwise_count(e.upper(x)) > e.most
        return places[i[new]], others[j[new]], np.bitwise_count(x[new])

    for u in np.flatnonzero(np.diff(begins)):
        v = u ^ flips
        v = v[v >= u] if alone else v
        size = sizes[v]
        end = np.cumsum(size)
        spots = np.repeat(starts[v] - end + size, size)
        spots += row[: len(spots)]
        to = b[spots]
        for p in range(0, len(to), TILE):
            cols = to[p : p + TILE]
            step, stop = TILE // len(cols), begins[u + 1]
            if alone:
                stop = min(stop, spots[p : p + TILE].max())
            for q in range(begins[u], stop, step):
                rows = a[q : min(q + step, begins[u + 1])]
                m, pad = len(rows) * len(cols), -len(rows) * len(cols) % 8
                np.bitwise_xor(rows[:, None], cols, out=xor[:m].reshape(len(rows), len(cols)))
                np.less_equal(np.bitwise_count(xor[:m], out=count[:m]), radius, out=fit[:m])
                fit[m : m + pad] = False
                eights = np.flatnonzero(fit[: m + pad].view(np.uint64) != 0)  # few fit, and eight are seen at once
                if len(eights):
                    k = (eights[:, None] * 8 + np.arange(8)).ravel()
                    k = k[fit[k]]
                    i = k // len(cols)
                    found.append((q + i, spots[p + k - i * len(cols)], xor[k]))
                    n += len(k)
            if n >= FOUND:
                yield first()
                found, n = [], 0
    if found:
        yield first()
