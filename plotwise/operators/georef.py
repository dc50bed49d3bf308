"""Registration: polynomial and thin-plate fits of control points, leave-one-out errors, warps and map projections.

Control points are few (tens); sums for a least-squares fit of any number of rows are one aggregate, solved on the driver.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def design(u, v, order: int) -> list:
    """Terms 1, u, v (, u*u, u*v, v*v) of columns or arrays."""
    one = F.lit(1.0) if isinstance(u, Column) else np.ones_like(u)
    return [one, u, v] if order == 1 else [one, u, v, u * u, u * v, v * v]


def normal_sums(rows: DataFrame, terms: list[Column], targets: list[Column]) -> DataFrame:
    """One row: the sums of products that a least-squares fit needs."""
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a_{i}_{j}") for i, j in combinations_with_replacement(range(k), 2)]
    return rows.agg(*sums, *[F.sum(terms[i] * t).alias(f"b_{n}_{i}") for n, t in enumerate(targets) for i in range(k)])


def fit(rows: DataFrame, u: str, v: str, targets: list[str], order: int, scale: float = 1.0) -> list[np.ndarray]:
    """Coefficients of each target in u*scale, v*scale, by the normal equations."""
    terms = design(F.col(u).cast("double") * scale, F.col(v).cast("double") * scale, order)
    r = normal_sums(rows, terms, [F.col(t).cast("double") for t in targets]).first()
    k = len(terms)
    a = np.array([[r[f"a_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return [np.linalg.solve(a, np.array([r[f"b_{n}_{i}"] for i in range(k)])) for n in range(len(targets))]


def predict(u: Column, v: Column, coefficients: np.ndarray, order: int, scale: float = 1.0) -> Column:
    out = F.lit(0.0)
    for c, t in zip(coefficients, design(u.cast("double") * scale, v.cast("double") * scale, order), strict=True):
        out = out + F.lit(float(c)) * t
    return out


def solve_order(u: np.ndarray, v: np.ndarray, x: np.ndarray, order: int) -> np.ndarray:
    a = np.column_stack(design(u, v, order))
    return np.linalg.lstsq(a, x, rcond=None)[0]


def tps(u: np.ndarray, v: np.ndarray, x: np.ndarray, smooth: float = 0.0):
    """A thin-plate spline through (u, v) -> x as a function."""
    def kernel(r2):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(r2 > 0, 0.5 * r2 * np.log(r2), 0.0)

    n = len(u)
    k = kernel((u[:, None] - u) ** 2 + (v[:, None] - v) ** 2) + smooth * np.eye(n)
    p = np.column_stack([np.ones(n), u, v])
    system = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    w = np.linalg.solve(system, np.concatenate([x, np.zeros(3)]))
    return lambda a, b: kernel((a[:, None] - u) ** 2 + (b[:, None] - v) ** 2) @ w[:n] + np.column_stack([np.ones(len(a)), a, b]) @ w[n:]


def model(kind: str, u, v, x, y):
    """A fitted model (order1, order2, tps, tps:<smoothing>) as a function to (x, y)."""
    if kind.startswith("order"):
        order = int(kind[5:])
        cx, cy = (solve_order(u, v, t, order) for t in (x, y))
        return lambda a, b: (np.column_stack(design(a, b, order)) @ cx, np.column_stack(design(a, b, order)) @ cy)
    smooth = float(kind.partition(":")[2] or 0)
    fx, fy = (tps(u, v, t, smooth) for t in (x, y))
    return lambda a, b: (fx(a, b), fy(a, b))


#: The models that are compared.
MODELS = ["order1", "order2", "tps", "tps:0.0001", "tps:0.001", "tps:0.01"]


def compare_models(points: DataFrame, kinds: list[str] = MODELS, scale: float = 1e-4, checks: DataFrame | None = None) -> DataFrame:
    """(set_, kind, n, rmse, loo_rmse, loo_max, cp_rmse, cp_max) for control points (set_, u, v, x, y): tens of rows for each fit.

    rmse is that of the fit itself, loo that of points left out one at a time, cp that at `checks` (set_, u, v, x, y), points that
    no fit sees; null where a set has none.
    """
    import pandas as pd

    names = ["set_", "kind", "n", "rmse", "loo_rmse", "loo_max", "cp_rmse", "cp_max"]

    def errors(fitted, g: pd.DataFrame) -> np.ndarray:
        u, v, x, y = (g[c].to_numpy(float) * (scale if c in "uv" else 1.0) for c in "uvxy")
        px, py = fitted(u, v)
        return np.hypot(px - x, py - y)

    def fitted(kind: str, g: pd.DataFrame):
        return model(kind, *(g[c].to_numpy(float) * (scale if c in "uv" else 1.0) for c in "uvxy"))

    def run(key, g):  # no type hints: Spark reads them
        control, check = g[g["held"] == 0].sort_values(["u", "v"]).reset_index(drop=True), g[g["held"] == 1]
        whole = fitted(key[1], control)
        left_out = np.array([errors(fitted(key[1], control.drop(index=i)), control.iloc[[i]])[0] for i in range(len(control))])
        rms = lambda e: float(np.sqrt(np.mean(e**2))) if len(e) else None
        apart = errors(whole, check) if len(check) else np.zeros(0)
        return pd.DataFrame([(*key, len(control), rms(errors(whole, control)), rms(left_out), float(left_out.max()), rms(apart), float(apart.max()) if len(apart) else None)], columns=names)

    rows = points.select("set_", "u", "v", "x", "y", F.lit(0).alias("held"))
    if checks is not None:
        rows = rows.unionByName(checks.select("set_", "u", "v", "x", "y", F.lit(1).alias("held")))
    each = rows.withColumn("kind", F.explode(F.array([F.lit(k) for k in kinds])))
    return each.groupBy("set_", "kind").applyInPandas(run, "set_ string, kind string, n long, rmse double, loo_rmse double, loo_max double, cp_rmse double, cp_max double")


def check_errors(checks: DataFrame, points: DataFrame, kind: str, scale: float = 1e-4) -> DataFrame:
    """`checks` (set_, id, u, v, x, y) with `error`, the distance that the set's model misses them by. `points` as in compare_models."""
    import pandas as pd

    def run(key, g):  # no type hints: Spark reads them
        control, check = g[g["held"] == 0].sort_values(["u", "v"]), g[g["held"] == 1]
        if not len(check) or not len(control):
            return pd.DataFrame({"set_": [], "id": [], "error": []})
        u, v, x, y = (control[c].to_numpy(float) * (scale if c in "uv" else 1.0) for c in "uvxy")
        px, py = model(kind, u, v, x, y)(check["u"].to_numpy(float) * scale, check["v"].to_numpy(float) * scale)
        return pd.DataFrame({"set_": check["set_"], "id": check["id"], "error": np.hypot(px - check["x"], py - check["y"])})

    rows = points.select("set_", F.lit(None).cast("string").alias("id"), "u", "v", "x", "y", F.lit(0).alias("held"))
    both = rows.unionByName(checks.select("set_", F.col("id").cast("string").alias("id"), "u", "v", "x", "y", F.lit(1).alias("held")))
    return both.groupBy("set_").applyInPandas(run, "set_ string, id string, error double")


def displacement(points: DataFrame, first: str, second: str, scale: float = 1e-4, steps: int = 60) -> DataFrame:
    """(set_, i, j, gap): how far two models of a set's control points are apart, on a grid of steps x steps over the points' box."""
    import pandas as pd

    def run(key, g):  # no type hints: Spark reads them
        u, v, x, y = (g.sort_values(["u", "v"])[c].to_numpy(float) * (scale if c in "uv" else 1.0) for c in "uvxy")
        i, j = (k.ravel() for k in np.mgrid[0:steps, 0:steps])
        a, b = u.min() + np.ptp(u) * i / (steps - 1), v.min() + np.ptp(v) * j / (steps - 1)
        (ax, ay), (bx, by) = model(first, u, v, x, y)(a, b), model(second, u, v, x, y)(a, b)
        return pd.DataFrame({"set_": key[0], "i": i, "j": j, "gap": np.hypot(ax - bx, ay - by)})

    return points.groupBy("set_").applyInPandas(run, "set_ string, i long, j long, gap double")


def residual_summary(rows: DataFrame, error: Column, *by: str) -> DataFrame:
    e = error.alias("e")
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.select(*by, e).groupBy(*by).agg(F.count("*").alias("n"), r(F.sqrt(F.avg(F.col("e") * F.col("e"))), "rmse"), r(F.max("e"), "max_error"), r(F.avg("e"), "mean_error"), r(F.percentile("e", F.lit(0.5)), "median_error"), r(F.percentile("e", F.lit(0.95)), "p95_error"))


def warp_nearest(target: DataFrame, cells: DataFrame, to_row: Column, to_col: Column, value: str) -> DataFrame:
    """Inverse mapping: each target cell takes the value of the source cell that its place rounds to, 0 outside."""
    placed = target.withColumns({"__r": F.floor(to_row + 0.5).cast("long"), "__c": F.floor(to_col + 0.5).cast("long")})
    source = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value))
    return placed.join(source, ["__r", "__c"], "left").select(*target.columns, F.coalesce(value, F.lit(0)).alias(value))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def lambert(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float, x0: float, y0: float, unit: float = 1.0, a: float = 6378137.0, f: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """Lambert conformal conic with two standard parallels (degrees; false origin and result in `unit` metres)."""
    e = math.sqrt(2 * f - f * f)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(x) for x in (lat0, lat1, lat2))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    r0 = a * big * t(p0) ** n
    phi = F.radians(lat)
    s = F.lit(e) * F.sin(phi)
    tp = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    r = F.lit(a * big) * F.pow(tp, F.lit(n))
    angle = F.lit(n) * (F.radians(lon) - math.radians(lon0))
    return (F.lit(x0) + r * F.sin(angle) / unit), (F.lit(y0) + (F.lit(r0) - r * F.cos(angle)) / unit)


def cell_resolution(z: Column, eps: float = 1.0001) -> Column:
    """Metres of a web-map pixel at a zoom level."""
    return F.lit(156543.03) / F.pow(F.lit(2.0), z) * eps
