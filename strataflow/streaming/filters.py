"""An extension beyond batch: forward filters and windowed statistics over unbounded series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "level double, rate double, n long"
OUT = "well_id long, ts timestamp, value double, level double, n long"


def exponential_filter(stream: DataFrame, alpha: float = 0.2, beta: float = 0.05) -> DataFrame:
    """Level and rate of every well, carried from batch to batch (double exponential smoothing). Rows: well_id, ts, event_id, value."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, rate, n = state.get if state.exists else (None, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t, v in zip(rows["ts"], rows["value"], strict=True):
            if level is None:
                level = float(v)
            else:
                guess = level + rate
                new = guess + alpha * (v - guess)
                rate, level = rate + beta * (new - level - rate), new
            n += 1
            out.append((key[0], t, float(v), level, n))
        state.update((level, rate, n))
        yield pd.DataFrame(out, columns=["well_id", "ts", "value", "level", "n"])

    return stream.groupBy("well_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and means by well type and window; rows later than ``late`` are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("window.start", "window.end", "event_type", "n", "mean")
