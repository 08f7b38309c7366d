"""Frames as a stream: windowed areas with late frames dropped, and the state of each arena carried on.

An extension: batch operators see whole arenas, streams what has come so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def areas(pixels: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(arena, start, area): foreground pixels by arena and window; frames later than `late` are dropped."""
    w = pixels.withWatermark(time, late).groupBy("arena", F.window(time, window)).agg(F.count(F.lit(1)).alias("area"))
    return w.select("arena", F.col("window.start").alias("start"), "area")


def first_moves(frames: DataFrame, margin: float) -> DataFrame:
    """frames: arena string, t int, area double, each arena's frames in order. Emits (arena, first_move) once an arena's area has grown by the margin."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, done = state.get if state.exists else (None, False)
        found = []
        rows = pd.concat(list(parts)).sort_values("t")
        for t, area in zip(rows["t"], rows["area"]):
            if start is None:
                start = float(area)
            if not done and area >= start + margin:
                done = True
                found.append((key[0], int(t)))
        state.update((start, done))
        yield pd.DataFrame(found, columns=["arena", "first_move"])

    return frames.groupBy("arena").applyInPandasWithState(step, "arena string, first_move int", "start double, done boolean", "append", GroupStateTimeout.NoTimeout)
