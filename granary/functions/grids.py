"""Grids of luma as flat arrays, row by row: area resampling, the 64-bit gradient hash, and the blur signal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.tensors import let


def resampled(grid: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """A smaller grid: each cell is the mean of the pixels it covers, by the part of each that it covers, rounded half to even."""

    def weight(low: Column, high: Column, at: Column) -> Column:
        return F.least(high, at + 1) - F.greatest(low, at)

    def covered(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low).cast("int"), F.ceil(high).cast("int") - 1)

    def mean(v: Column) -> Column:
        def row(total: Column, y: Column) -> Column:
            part = F.aggregate(covered(v["x0"], v["x1"]), F.lit(0.0), lambda s, x: s + weight(v["x0"], v["x1"], x) * F.get(grid, y * width + x))
            return total + weight(v["y0"], v["y1"], y) * part

        return F.bround(F.aggregate(covered(v["y0"], v["y1"]), F.lit(0.0), row) / ((v["x1"] - v["x0"]) * (v["y1"] - v["y0"])))

    def cell(k: Column) -> Column:
        r, c = F.floor(k / to_width), k % to_width
        return let(F.struct((c * width / to_width).alias("x0"), ((c + 1) * width / to_width).alias("x1"), (r * height / to_height).alias("y0"), ((r + 1) * height / to_height).alias("y1")), mean)

    return F.transform(F.sequence(F.lit(0), F.lit(to_width * to_height - 1)), cell)


def gradient_hash(grid: Column, width: Column, height: Column) -> Column:
    """64 bits of an image, as a BIGINT: a bit is set where a pixel of the 9 by 8 grid isn't brighter than its right
    neighbour, row by row, the highest bit first. Null for an empty or null grid."""

    def bits(small: Column) -> Column:
        def bit(k: Column) -> Column:
            at = (F.floor(k / 8) * 9 + k % 8).cast("int")
            return F.when(F.get(small, at + 1) >= F.get(small, at), F.lit(1)).otherwise(0).cast("long")

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, k: F.shiftleft(s, 1).bitwiseOR(bit(k)))

    return F.when(F.size(grid) > 0, let(resampled(grid, width, height, 9, 8), bits))


def blur(grid: Column, width: Column, height: Column) -> Column:
    """log(1 + variance of the Laplacian) of a grid of whole numbers; 0 for an empty one. Beyond an edge the grid is
    mirrored, the edge itself not repeated."""

    def mirrored(at: Column, size: Column) -> Column:
        inner = F.when(at < 0, -at).when(at >= size, 2 * size - 2 - at).otherwise(at)
        return F.greatest(F.lit(0), inner)

    def value(x: Column, y: Column) -> Column:
        return F.get(grid, (mirrored(y, height) * width + mirrored(x, width)).cast("int")).cast("long")

    def laplacian(k: Column) -> Column:
        x, y = (k % width).cast("int"), F.floor(k / width).cast("int")
        return value(x - 1, y) + value(x + 1, y) + value(x, y - 1) + value(x, y + 1) - 4 * value(x, y)

    def variance(all_: Column) -> Column:
        n = F.size(all_).cast("double")
        total = F.aggregate(all_, F.lit(0).cast("long"), lambda s, x: s + x)
        return let(total, lambda t: F.aggregate(all_, F.lit(0.0), lambda s, x: s + (x - t / n) * (x - t / n)) / n)

    spread = let(F.transform(F.sequence(F.lit(0), F.size(grid) - 1), laplacian), variance)
    return F.when(F.size(grid) > 0, F.log1p(spread)).when(grid.isNotNull(), 0.0)
