"""Quality classifier: naive Bayes support vectors.

A document is the set of its hashed words and word pairs. Each feature is scaled by its log-count
ratio between the two classes; a linear hinge-loss model over the scaled indicators is fitted by
dual coordinate descent and its margin is turned into a probability by a logistic fit on rows that
the model hasn't seen. Fitting takes a bounded sample of labelled rows (`sample`, the rows with the
smallest hashes of their ids) and runs in one task; the model has a fixed size of 2**BITS numbers
and is sent to all tasks, which score whole texts.

Defined results: null or empty texts have no features and get the score of the bias alone; rows
without a label, or with a null one, aren't learnt from; an id with contradicting labels takes the
larger share of them, 1 if even; of texts that repeat an id one is learnt, whichever partition it is in; if one class is missing every score is the share of class 1; no
labels give 0.5; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import CHUNK, gram_hashes, row_words, text_chunks

BITS = 18


def features(column: pa.Array):
    """Runs of rows as (first row, end row, feature ids, row bounds): each row's ids once, in order."""
    for a, b, buf, offsets in text_chunks(column, CHUNK):
        words, first = row_words(buf, offsets, lower=True)
        row = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(first))
        pairs = gram_hashes(words, 2, salt=7)
        same = row[1:] == row[:-1]
        keys = np.concatenate([row << np.uint64(BITS) | words >> np.uint64(64 - BITS), row[:-1][same] << np.uint64(BITS) | pairs[same] >> np.uint64(64 - BITS)])
        keys.sort()
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        bounds = np.searchsorted(keys, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(BITS))
        yield a, b, (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), bounds


def log_count_ratios(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed and normalised feature counts' ratio."""
    row_y = np.repeat(y, np.diff(bounds))
    p = alpha + np.bincount(ids[row_y > 0], minlength=1 << BITS)
    q = alpha + np.bincount(ids[row_y <= 0], minlength=1 << BITS)
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(ids: np.ndarray, bounds: np.ndarray, x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Minimises |w|^2/2 + sum cost_i * hinge(y_i (w.x_i + b)) over the dual, one variable at a time; b is a constant feature's weight."""
    w, b, n = np.zeros(1 << BITS), 0.0, len(y)
    a = np.zeros(n)
    rows = [(ids[bounds[i] : bounds[i + 1]], x[bounds[i] : bounds[i + 1]]) for i in range(n)]
    norm = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            k, v = rows[i]
            g = y[i] * (w[k] @ v + b) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), cost[i])
            d = new - a[i]
            if d:
                a[i] = new
                w[k] += d * y[i] * v
                b += d * y[i]
                worst = max(worst, abs(d) / cost[i])
        if worst < 1e-3:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | margin), Newton steps with light smoothing."""
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        r, h = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ margin + 1e-3 * (a - 1), r.sum()])
        m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(c)


def _fit(texts: pa.Array, y01: np.ndarray) -> dict:
    share = float(y01.mean()) if len(y01) else 0.5
    flat = {"weights": np.zeros(1 << BITS, np.float32).tobytes(), "bias": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), "slope": 1.0, "shift": 0.0}
    if len(y01) < 4 or share in (0.0, 1.0):
        return flat
    ids, sizes = [], [np.zeros(1, np.int64)]
    for _, _, f, bounds in features(texts):
        ids.append(f)
        sizes.append(np.diff(bounds))
    ids, bounds = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
    y = np.where(y01 > 0, 1.0, -1.0)
    part = np.arange(len(y)) % 4 == 3  # every fourth row sets the logistic fit, not the model

    def model(use: np.ndarray):
        keep = np.repeat(use, np.diff(bounds))
        some, cuts = ids[keep], np.concatenate([[0], np.cumsum(np.diff(bounds)[use])])
        r = log_count_ratios(some, cuts, y[use])
        norms = np.sqrt(np.maximum(1, np.add.reduceat(np.append(r[some] ** 2, 0.0), cuts[:-1]) * (np.diff(cuts) > 0)))
        x = r[some] / np.repeat(norms, np.diff(cuts))
        balance = np.where(y[use] > 0, 0.5 / max((y[use] > 0).mean(), 1e-9), 0.5 / max((y[use] < 0).mean(), 1e-9))
        w, b = dual_descent(some, cuts, x, y[use], balance)
        return r * w, r, b

    v, r, b = model(~part)
    m = margins(ids, bounds, v, r, b)
    slope, shift = logistic(m[part], y[part])
    v, r, b = model(np.ones(len(y), bool))
    return {"weights": np.concatenate([v, r]).astype(np.float32).tobytes(), "bias": float(b), "slope": slope, "shift": shift}


def margins(ids: np.ndarray, bounds: np.ndarray, v: np.ndarray, r: np.ndarray, b: float) -> np.ndarray:
    """Margins of rows whose scaled indicators have unit length."""
    some = np.diff(bounds) > 0
    add = lambda z: np.where(some, np.add.reduceat(np.append(z, 0.0), np.minimum(bounds[:-1], len(z))), 0.0)
    return add(v[ids]) / np.sqrt(np.maximum(1.0, add(r[ids] ** 2))) + b


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000, allowed=None) -> dict:
    """Learns from at most `sample` labelled rows; `allowed`: condition on column id that rows must meet to be learnt from."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    if allowed is not None:
        lab = lab.where(allowed)
    lab = lab.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id")
    # Of texts that repeat an id the one with the smallest hash is learnt, so that reruns agree.
    rows = rows.groupBy("id").agg(F.min_by(F.coalesce("text", F.lit("")), F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.min("y").alias("y"))

    def run(batches):
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y.append(batch.column(1).to_numpy(zero_copy_only=False))
        got = _fit(pa.array([t or "" for t in texts], pa.large_string()), np.concatenate(y) if y else np.zeros(0))
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in got.items()})

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "y")
    got = one.mapInArrow(run, "weights binary, bias double, slope double, shift double").first()
    return got.asDict() if got is not None else _fit(pa.array([], pa.large_string()), np.zeros(0))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, score, predicted) of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        both = np.frombuffer(m["weights"], np.float32).astype(float)
        v, r = (both[: 1 << BITS], both[1 << BITS :]) if len(both) > 1 << BITS else (both, both)
        for batch in batches:
            for a, b, ids, bounds in features(batch.column(1)):
                z = m["slope"] * margins(ids, bounds, v, r, m["bias"]) + m["shift"]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double, predicted int")


def keep_good(df: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of df that aren't rejected, with all their columns: scored in place, without a shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        m = sent.value
        both = np.frombuffer(m["weights"], np.float32).astype(float)
        v, r = (both[: 1 << BITS], both[1 << BITS :]) if len(both) > 1 << BITS else (both, both)
        for batch in batches:
            for a, b, ids, bounds in features(batch.column(at)):
                z = m["slope"] * margins(ids, bounds, v, r, m["bias"]) + m["shift"]
                good = 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
