"""Windows over neighbourhoods, by tiles with a margin.

Cells go to the tile that they are in and to those whose margin they are in, so a grid is shuffled once, little larger than it
is; a tile becomes dense arrays, and a window of any kind is a few array operations on them. Cells that the grid lacks count for
nothing in a window, whatever shape the grid has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256


def tiled(cells: DataFrame, columns: list[str], margin: int, compute: Callable, fields: dict[str, str], size: int = SIZE) -> DataFrame:
    """(row, col, fields...) for each cell of `cells` (row, col, columns...).

    compute(layers, present) gets the columns as float arrays of size + 2 margin cells a side, 0 where there is no cell, and gives
    an array for each field; what it gives in the margin is not used.
    """
    side = size + 2 * margin
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / size), F.floor((F.col(c) + margin) / size)))
    dealt = cells.select("row", "col", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).withColumn("tr", reach("row")).withColumn("tc", reach("col"))
    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(key, rows):  # no type hints: Spark reads them
        top, left = key[0].as_py() * size, key[1].as_py() * size
        r, c = rows.column("row").to_numpy() - top + margin, rows.column("col").to_numpy() - left + margin
        present = np.zeros((side, side), dtype=bool)
        present[r, c] = True
        layers = []
        for i in range(len(columns)):
            layer = np.zeros((side, side))
            layer[r, c] = rows.column(f"v{i}").to_numpy()
            layers.append(layer)
        found = compute(layers, present)
        y, x = np.nonzero(present[margin : margin + size, margin : margin + size])
        out = [pa.array(y + top), pa.array(x + left)]
        out += [pa.array(found[n][y + margin, x + margin]).cast(kinds[t], safe=False) for n, t in fields.items()]
        return pa.table(out, names=["row", "col", *fields])

    return dealt.groupBy("tr", "tc").applyInArrow(run, ", ".join(["row long, col long", *[f"{n} {t}" for n, t in fields.items()]]))


def window_sum(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares, one direction after the other."""
    for axis in (0, 1):
        wide = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in (0, 1)])
        a = sum(np.take(wide, range(k, k + a.shape[axis]), axis) for k in range(2 * radius + 1))
    return a


def _mean(layer: np.ndarray, n: np.ndarray, radius: int) -> np.ndarray:
    return window_sum(layer, radius) / np.maximum(n, 1)


def box_mean(cells: DataFrame, value: str, radius: int, name: str = "mean") -> DataFrame:
    """(row, col, name): the mean of the cells in the square around each cell."""
    return tiled(cells, [value], radius, lambda v, p: {name: _mean(v[0], window_sum(p.astype(float), radius), radius)}, {name: "double"})


def texture(cells: DataFrame, value: str, radius: int, bright: float | None = None) -> DataFrame:
    """(row, col, v, mean, std, bright): mean and deviation, sqrt(max(E[x^2] - E[x]^2, 0)), and the share above `bright` around each cell."""

    def compute(layers, present):
        v, n = layers[0], window_sum(present.astype(float), radius)
        mean = _mean(v, n, radius)
        std = np.sqrt(np.maximum(_mean(v * v, n, radius) - mean * mean, 0.0))
        above = present & (v > bright) if bright is not None else np.zeros_like(present)
        return {"v": v, "mean": mean, "std": std, "bright": _mean(above.astype(float), n, radius)}

    return tiled(cells, [value], radius, compute, {"v": "double", "mean": "double", "std": "double", "bright": "double"})


def median_filter(cells: DataFrame, value: str, radius: int, strip: int = 16) -> DataFrame:
    """(row, col, median) of the square around each cell; strips of rows bound what is held."""

    def compute(layers, present):
        wide = np.pad(np.where(present, layers[0], np.nan), radius, constant_values=np.nan)
        out = np.zeros_like(layers[0])
        for lo in range(radius, out.shape[0] - radius, strip):
            hi = min(lo + strip, out.shape[0] - radius)
            near = np.lib.stride_tricks.sliding_window_view(wide[lo : hi + 2 * radius], (2 * radius + 1, 2 * radius + 1))
            some = np.nonzero(present[lo:hi])
            if len(some[0]):
                out[lo:hi][some] = np.nanmedian(near[some].reshape(len(some[0]), -1), axis=1)
        return {"median": out}

    return tiled(cells, [value], radius, compute, {"median": "double"})


def majority_filter(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """(row, col, mode): the most frequent code in the square around each cell, the lowest of equally frequent ones."""

    def compute(layers, present):
        mode, most = np.zeros_like(layers[0]), np.zeros_like(layers[0])
        for code in np.unique(layers[0][present]):
            n = window_sum((present & (layers[0] == code)).astype(float), radius)
            mode, most = np.where(n > most, code, mode), np.maximum(n, most)
        return {"mode": mode}

    return tiled(cells, [value], radius, compute, {"mode": "int"})


def gabor_kernels(frequency: float, sigma: float, angles: int) -> list[np.ndarray]:
    """Complex waves under a Gaussian of unit sum, cut at three deviations, for angles that divide a half turn."""
    r = int(np.ceil(3 * sigma))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    hill = np.exp(-(x * x + y * y) / (2 * sigma * sigma)) / (2 * np.pi * sigma * sigma)
    return [hill * np.exp(2j * np.pi * frequency * (x * np.cos(t) + y * np.sin(t))) for t in np.arange(angles) * np.pi / angles]


# A wave of four cells under a Gaussian of three, four angles, averaged over nine cells.
GABOR = {"frequency": 0.25, "sigma": 3.0, "angles": 4, "smooth": 4}


def gabor_energy(cells: DataFrame, value: str, frequency: float = GABOR["frequency"], sigma: float = GABOR["sigma"], angles: int = GABOR["angles"], smooth: int = GABOR["smooth"]) -> DataFrame:
    """(row, col, e0, e1, ...): strength of the wave of each angle around each cell, averaged over a square of radius `smooth`.

    The grid's mean is taken off first; cells that the grid lacks count as the mean. `grid.mirrored` gives a reflected margin.
    """
    kernels = gabor_kernels(frequency, sigma, angles)
    r = len(kernels[0]) // 2
    mean = cells.agg(F.avg(value)).first()[0] or 0.0

    def compute(layers, present):
        x = np.where(present, layers[0] - mean, 0.0)
        full = [x.shape[0] + 2 * r, x.shape[1] + 2 * r]
        spectrum = np.fft.fft2(x, full)
        n, out = window_sum(present.astype(float), smooth), {}
        for i, k in enumerate(kernels):
            energy = np.abs(np.fft.ifft2(spectrum * np.fft.fft2(k, full)))[r : r + x.shape[0], r : r + x.shape[1]]
            out[f"e{i}"] = _mean(np.where(present, energy, 0.0), n, smooth)
        return out

    return tiled(cells, [value], r + smooth, compute, {f"e{i}": "double" for i in range(angles)})
