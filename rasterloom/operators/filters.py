"""Spatial filters on frames, and candidates for the best segmentation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.color import SPACES
from . import frames


def apply_filter(df: DataFrame, keys: Sequence[str], name: str, p: float = 1.0, q: float | None = None, rescale: bool = False, value: str = "v") -> DataFrame:
    """(keys, y, x, v) filtered; rescale stretches each frame to 0..255."""
    if name not in K.FILTERS:
        raise ValueError(f"no such filter: {name}")

    def kernel(stack, v):
        for at, a, some, where in stack.by_size(v):
            out = K.apply_filter(a, name, p, q)
            own = stack.own[some]
            yield own, stack.y[some] + stack.top[own], stack.x[some] + stack.left[own], (rescaled(out) if rescale else out)[where]

    return frames.run_stacks(df, keys, value, kernel, "y int, x int, v double")


def rescaled(a: np.ndarray) -> np.ndarray:
    """Each frame stretched to 0..255; a flat one is 0."""
    low, high = a.min((-2, -1), keepdims=True), a.max((-2, -1), keepdims=True)
    return np.rint((a - low) * 255 / np.where(high > low, high - low, np.inf))


def opened_background(df: DataFrame, keys: Sequence[str], radius: int | None = None, value: str = "v") -> DataFrame:
    """A smooth background: grey opening with a disk, half of the root of the smaller side by default."""

    def kernel(a, y0, x0):
        r = radius or max(int(np.sqrt(min(a.shape))) // 2, 1)
        shape = K.disk(r)
        steps = np.argwhere(shape) - r
        p = np.pad(a, r, mode="edge")
        low = np.min([p[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]] for dy, dx in steps], 0)
        p = np.pad(low, r, mode="edge")
        for (y, x), v in np.ndenumerate(np.max([p[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]] for dy, dx in steps], 0)):
            yield y + y0, x + x0, float(v)

    return frames.run(frames.pack(df, keys, value), keys, kernel, "y int, x int, v double")


def channel_candidates(spark: SparkSession) -> DataFrame:
    """The single-channel candidates and the plain sum: (candidate, space, weights)."""
    rows = [(0, "bgr", [1.0, 1.0, 1.0])]
    for s in SPACES:
        for i in range(3):
            rows.append((len(rows), s, [1.0 if j == i else 0.0 for j in range(3)]))
    return spark.createDataFrame(rows, "candidate int, space string, weights array<double>")


# Parameters that are tried.
SIGMAS = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 8.0, 10.0)
SIGMA_RANGES = ((0.5, 1.5), (1.0, 3.0), (1.5, 4.5), (2.0, 6.0), (2.5, 7.5), (3.0, 9.0), (4.0, 12.0), (5.0, 15.0))
CUTOFFS, ORDERS = (0.02, 0.05, 0.10, 0.20, 0.40), (1.0, 2.0, 3.0, 6.0, 8.0, 10.0)
LAPLACE_SIZES = (3.0, 4.0, 5.0, 7.0, 9.0, 11.0, 15.0, 21.0)  # of the operator's array; the stencil in it is the same


def filter_grid() -> list[tuple[str, float | None, float | None]]:
    """(name, p, q) of all filters and parameters that are tried."""
    grid: list[tuple[str, float | None, float | None]] = []
    for name in K.FILTERS:
        if name == "Gaussian":
            grid += [(name, s, None) for s in SIGMAS]
        elif name == "Butterworth":
            grid += [(name, c, o) for c in CUTOFFS for o in ORDERS]
        elif name in ("Frangi", "Sato", "Meijering", "Hessian"):
            grid += [(name, p, q) for p, q in SIGMA_RANGES]
        elif name == "Laplace":
            grid += [(name, s, None) for s in LAPLACE_SIZES]
        else:
            grid.append((name, None, None))
    return grid


def filter_candidates(spark: SparkSession) -> DataFrame:
    """The grid of filters and parameters: (candidate, name, p, q)."""
    return spark.createDataFrame([(i, *g) for i, g in enumerate(filter_grid())], "candidate int, name string, p double, q double")


def fair_candidates(features: DataFrame, least: int = 1, most: int = 10_000, least_area: float = 0.0, most_area: float | None = None) -> DataFrame:
    """Candidates with a fair number of components and a fair area."""
    ok = (F.col("components") >= least) & (F.col("components") < most) & (F.col("area") > least_area)
    return features.where(ok if most_area is None else ok & (F.col("area") < most_area))


def score_candidates(features: DataFrame, low: Sequence[str], high: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds `score`: dense ranks added up, columns in `low` the better the smaller, in `high` the better the larger."""
    out, score = features, F.lit(0)
    for i, (c, up) in enumerate([(c, False) for c in low] + [(c, True) for c in high]):
        r = F.dense_rank().over(Window.partitionBy(*keys).orderBy(c))
        out = out.withColumn(f"__r{i}", r)
        score = score + (F.col(f"__r{i}") - 1 if up else F.max(f"__r{i}").over(Window.partitionBy(*keys)) - F.col(f"__r{i}"))
    return out.withColumn("score", score).drop(*[f"__r{i}" for i in range(len(low) + len(high))])


def best_candidates(scored: DataFrame, keys: Sequence[str] = (), k: int = 20) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "candidate")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
