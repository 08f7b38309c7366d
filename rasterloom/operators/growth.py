"""Growth curves: best linear and exponential windows, rupture, first move, transitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("exp_intercept", "exp_slope", "exp_start", "exp_end", "exp_r2", "lin_intercept", "lin_slope", "lin_start", "lin_end", "lin_r2", "rupture_time", "rupture_value")


def prepare(y: np.ndarray, first_frame: int = 1) -> np.ndarray:
    """Without what is before the first frame and without a leading zero; other zeros become the smallest positive value. Nothing is left without one."""
    y = np.asarray(y, float)[first_frame - 1 :]
    y = y[1:] if len(y) and y[0] == 0 else y
    low = y[y > 0]
    return np.where(y == 0, low.min(), y) if len(low) else y[:0]


def best_window(z: np.ndarray, allowed: np.ndarray, starts: int, first_end: int, time_step: float):
    """(intercept, slope, start, end, r2) of the straight window [i, j] with the highest r2, the first of equals; allowed[i, j - first_end].

    Every window's fit follows from prefix sums, so all are tried at once.
    """
    if not allowed.any():
        return (None,) * 5
    t = np.arange(len(z)) * time_step
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (np.ones(len(z)), t, t * t, z, t * z, z * z)]
    ends = np.arange(first_end, first_end + allowed.shape[1])
    n, st, stt, sz, stz, szz = (c[ends + 1][None, :] - c[:starts][:, None] for c in sums)
    n = np.where(n > 0, n, 1.0)
    xx, xz, zz = stt - st * st / n, stz - st * sz / n, szz - sz * sz / n
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where((xx > 0) & (zz > 0), xz * xz / (xx * zz), 0.0)
        slope = np.where(xx > 0, xz / xx, 0.0)
    i, j = np.unravel_index(np.where(allowed, np.round(r2, 10), -1.0).argmax(), allowed.shape)
    return float((sz[i, j] - slope[i, j] * st[i, j]) / n[i, j]), float(slope[i, j]), int(i), int(ends[j]), float(r2[i, j])


def series_features(y: np.ndarray, time_step: float = 1.0, first_frame: int = 1, block: int = 5):
    """FEATURES of one curve and whether its end is censored; None if nothing of it is positive."""
    y = prepare(y, first_frame)
    n = len(y)
    if not n:
        return None
    up, span, y1 = y[-1] >= y[0], float(np.ptp(y)), y[min(1, n - 1)]
    beyond = lambda share: y > y1 + share * span if up else y < y1 - share * span
    first = lambda hit: int(hit.argmax()) if hit.any() else None
    means = y[: n // block * block].reshape(-1, block).mean(1)
    change, step = np.diff(means), float(np.diff(y).mean()) if n > 1 else 0.0
    turns = (np.flatnonzero(change < step if up else change > step) + 1) * block - 1
    turns = turns[beyond(0.9)[turns]]
    rupture = int(turns[0]) if len(turns) else None
    last, starts, exp_starts = n - 1 if rupture is None else rupture, first(beyond(0.1)), first(beyond(0.01))
    lin = exp = (None,) * 5
    if starts is not None and last >= starts:
        ends = np.arange(starts, last + 1)
        allowed = (np.abs(y[ends][None, :] - y[: starts + 1][:, None]) > 0.5 * span) & (ends[None, :] > np.arange(starts + 1)[:, None])
        lin = best_window(y, allowed, starts + 1, starts, time_step)
        some = min(exp_starts or 0, starts + 1)
        if some:
            exp = best_window(np.log(np.maximum(y if up else 2 * y.max() - y, 1e-12)), allowed[:some], some, starts, time_step)
    end = (None, None) if rupture is None else (rupture * time_step, float(y[rupture]))
    return *exp, *lin, *end, rupture is None


def features(df: DataFrame, keys: Sequence[str], index: str, value: str, time_step: float = 1.0, first_frame: int = 1) -> DataFrame:
    """The twelve growth features and is_censored by key; null where nothing fits, no row where nothing is positive.

    A curve has one value a frame: curves are packed by key, one shuffle in all, and fitted in Arrow batches.
    """
    point = F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v"))
    packed = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("s")).select(*keys, F.col("s.v").alias("y"))
    types = {f: "int" if f.endswith(("start", "end")) else "double" for f in FEATURES} | {"is_censored": "boolean"}
    arrow = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches):
        for batch in batches:
            got = [series_features(np.asarray(y.values), time_step, first_frame) for y in batch.column(len(keys))]
            on = pa.array([g is not None for g in got])
            rows = [g for g in got if g is not None]
            own = [c.filter(on) for c in batch.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], arrow[t]) for i, t in enumerate(types.values()))], names=[*keys, *types])

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return packed.mapInArrow(run, f"{head}, " + ", ".join(f"{n} {t}" for n, t in types.items()))


def transitions(frames: DataFrame, keys: Sequence[str], share: float = 0.9) -> DataFrame:
    """frames: keys, t, solidity, first_move. Whether growth starts isotropic and the first frame whose solidity falls below `share` of the mean before the first move."""
    before = frames.where("first_move is not null and t <= first_move").groupBy(*keys).agg(F.avg("solidity").alias("calm"))
    f = frames.join(before, list(keys), "left")
    turn = f.groupBy(*keys).agg(F.min(F.when((F.col("t") >= F.col("first_move")) & (F.col("solidity") < share * F.col("calm")), F.col("t"))).alias("iso_digi_transi"), F.max("calm").alias("calm"))
    return turn.select(*keys, "iso_digi_transi", F.when(F.col("calm").isNotNull(), F.col("iso_digi_transi").isNull().cast("int")).alias("is_growth_isotropic"))
