"""Recursions over wells that are longer than a task's memory: sorted chunks, a state carried from one to the next.

A well's rows are gathered into chunks of bounded size. A task streams the chunks of its wells in order and holds one of
them and the state: what the known rows have told (last level, rate, noise), then the recursion's forward message. For
results that depend on later rows too, a bounded number of chunks is held with the message before each, and run forward
again from it, then back, carrying what the chunk before needs. A message is many times a chunk, so that none is written
for wells that are held whole; of longer ones the message before each such number of chunks is, and a second pass takes
them from the last to the first. So memory does not grow with a well, and each row is computed twice, or three times.

Wells count if their known rows are a prefix of at least ten and their curve has two points, as for the packed kernels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.kernels import filters as K
from strataflow.kernels import matching as M
from strataflow.operators.decode import spread
from strataflow.sources.wells import written

#: Rows of a chunk, and chunks of a well that a task holds at once.
CHUNK, HELD = 512, 64
COLS = ("row_idx", "md", "z", "gr", "tvt_input", "filled", "hidden_gr")
LEAST_KNOWN = 10


def _filled(w: DataFrame, name: str, *keys: str) -> DataFrame:
    """``w`` with the signal, missing values by interpolation between the rows before and after of the same keys; both come by running windows."""
    here = F.when(F.col("gr").isNotNull(), F.struct(F.col("pos").cast("double").alias("t"), F.col("gr").alias("v")))
    near = lambda order: F.last(here, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    w = w.withColumns({"_b": near(F.asc("row_idx")), "_a": near(F.desc("row_idx"))})
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("pos") - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    value = F.coalesce("gr", F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).otherwise(line))
    return w.withColumn(name, value).drop("_a", "_b")


def chunked(wells: DataFrame, curves: DataFrame, value: float = 1.0, size: int = CHUNK) -> DataFrame:
    """A row for each chunk of a well that counts: arrays of its rows, and with the first one the curve; ``later`` chunks follow."""
    up, every = W.partitionBy("well_id").orderBy("row_idx"), W.partitionBy("well_id")
    w = wells.select("well_id", "curve_id", "row_idx", "md", "z", "gr", "tvt_input").withColumn("pos", F.row_number().over(up) - 1)
    known = F.when(F.col("tvt_input").isNotNull(), F.col("pos"))
    w = w.withColumns({"h": F.count("tvt_input").over(every), "n": F.count(F.lit(1)).over(every), "end": F.max(known).over(every)})
    w = w.where((F.col("h") >= LEAST_KNOWN) & (F.col("h") < F.col("n")) & (F.col("end") == F.col("h") - 1))
    w = w.withColumn("_hidden", F.col("tvt_input").isNull())
    w = _filled(_filled(w, "filled", "well_id"), "hidden_gr", "well_id", "_hidden").withColumn("chunk", F.floor(F.col("pos") / size))
    rows = w.groupBy("well_id", "curve_id", "chunk").agg(F.sort_array(F.collect_list(F.struct(*COLS))).alias("r"), F.max(F.floor((F.col("n") - 1) / size) - F.col("chunk")).alias("later"))
    rows = rows.select("well_id", "curve_id", "chunk", "later", *[F.transform(F.col(f"r.{c}"), lambda v: v.cast("double")).alias(c) for c in COLS])
    pts = curves.groupBy("curve_id").agg(F.sort_array(F.collect_list(F.struct("tvt", (F.col("gr") / value).alias("gr")))).alias("c")).where(F.size("c") > 1)
    first = F.col("chunk") == 0
    return rows.join(pts, "curve_id").withColumns({"curve_t": F.when(first, F.col("c.tvt")), "curve_g": F.when(first, F.col("c.gr"))}).drop("c", "curve_id")


@dataclass
class Known:
    """What the known rows of a well have told so far."""

    curve_t: np.ndarray
    curve_g: np.ndarray
    level: float = 0.0
    z: float = 0.0
    md: float = 0.0
    tail: list[tuple[float, float]] = field(default_factory=list)
    fits: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def add(self, rows: dict[str, np.ndarray]) -> None:
        t = rows["tvt_input"]
        self.level, self.z, self.md = float(t[-1]), float(rows["z"][-1]), float(rows["md"][-1])
        self.tail = [*self.tail, *zip((t + rows["z"])[-30:].tolist(), rows["md"][-30:].tolist(), strict=True)][-30:]
        r = rows["gr"] - K.Curve(self.curve_t, self.curve_g)(t)
        r = r[np.isfinite(r)]
        self.fits = self.fits + [len(r), r.sum(), (r * r).sum()]

    @property
    def sigma(self) -> float:
        n, s, q = self.fits
        return float(np.clip(np.sqrt(max(q / n - (s / n) ** 2, 0)), 10, 60)) if n >= 20 else 30.0

    @property
    def rate(self) -> float:
        u, m = np.array(self.tail).T
        du, dm = np.diff(u), np.diff(m)
        return float(np.median(du[dm > 0] / dm[dm > 0])) if (dm > 0).sum() >= 3 else 0.0


class States:
    """The chain of rates and levels: posterior means and deviations of the hidden levels."""

    columns = ("mean", "std")

    def __init__(self, step: float = 0.7, rates: int = 31, reach: float = 80.0):
        self.step, self.k, self.reach = step, rates, reach

    def begin(self, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """(what stays the same along the well, the first message)."""
        levels = known.level + np.arange(-self.reach, self.reach + self.step / 2, self.step)
        about = np.concatenate([[known.level, known.rate, known.sigma], K.Curve(known.curve_t, known.curve_g)(levels)])
        return about, self._chain(about).start(len(levels) // 2, known.rate)

    def _chain(self, about: np.ndarray) -> K.StateChain:
        return K.StateChain(about[1] + np.linspace(-0.1, 0.1, self.k), len(about) - 3, self.step)

    def _emit(self, about: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        gr = rows["gr"]
        r = (np.nan_to_num(gr)[:, None] - about[3:][None, :]) / about[2]
        return np.where(np.isfinite(gr)[:, None], -0.5 * np.minimum(r * r, 600.0), 0.0)

    def forward(self, about: np.ndarray, message: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        chain, emit = self._chain(about), self._emit(about, rows)
        message = message.reshape(self.k, chain.n)
        for t in range(len(emit)):
            message, _ = chain.forward(message, np.exp(emit[t] - emit[t].max()), rows["dm"][t], rows["dz"][t])
        return message

    def backward(self, about: np.ndarray, message: np.ndarray, carried: np.ndarray | None, rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        chain = self._chain(about)
        message = message.reshape(self.k, chain.n)
        post, _, carried = K.smooth_chunk(chain, self._emit(about, rows), rows["dm"], rows["dz"], message, np.ones_like(message) if carried is None else carried)
        levels = about[0] + np.arange(-self.reach, self.reach + self.step / 2, self.step)
        found = K.summary(post, levels)
        return {c: found[c] for c in self.columns}, carried


class Lattice:
    """The cheapest path over levels, paying for each cell moved."""

    columns = ("level",)

    def __init__(self, penalty: float = 0.05, reach: float = 40.0, step: float = 0.5):
        self.penalty, self.reach, self.step = penalty, reach, step

    def begin(self, known: Known) -> tuple[np.ndarray, np.ndarray]:
        levels = known.level + np.arange(-self.reach, self.reach + self.step / 2, self.step)
        about = np.concatenate([[known.level, known.rate, known.sigma], K.Curve(known.curve_t, known.curve_g)(levels)])
        return about, M.viterbi_start(len(levels), len(levels) // 2)

    def _cost(self, about: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.abs(rows["filled"][None, :] - about[3:][:, None]) / about[2]

    def forward(self, about: np.ndarray, message: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        cost = self._cost(about, rows)
        for t in range(cost.shape[1]):
            message, _ = M.viterbi_step(message, cost[:, t], self.penalty)
        return message

    def backward(self, about: np.ndarray, message: np.ndarray, carried: int | None, rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], int]:
        path, carried = M.viterbi_chunk(self._cost(about, rows), message, self.penalty, carried)
        return {"level": about[0] + (path - (len(about) - 3) // 2) * self.step}, carried


class Grid:
    """The filter on a grid of levels and rates, which needs no second pass."""

    columns = ("level",)

    def begin(self, known: Known) -> tuple[K.GridFilter, np.ndarray]:
        grid = K.GridFilter(lambda v: np.interp(v, known.curve_t, known.curve_g), known.sigma, known.level, known.rate)
        return grid, grid.first

    def filtered(self, grid: K.GridFilter, message: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        out = np.empty(len(rows["md"]))
        for t in range(len(out)):
            # a step that does not move along the well counts as one
            message, out[t] = grid.forward(message, rows["hidden_gr"][t], rows["raw_dm"][t] or 1.0, rows["dz"][t])
        return {"level": out}, message


def _stream(frames: Iterator[pd.DataFrame], kernel):
    """(well_id, chunk row, hidden rows of it, what stays, message before them) in order, with the function to send the next message to."""
    well, known, about, message, last = None, None, None, None, None
    for f in frames:
        for r in f.to_dict("records"):
            if r["well_id"] != well:
                well, about, message = r["well_id"], None, None
                known = Known(np.asarray(r["curve_t"], float), np.asarray(r["curve_g"], float))
            rows, h = _read(r)
            if h:
                known.add({c: v[:h] for c, v in rows.items()})
            if h == len(rows["md"]):
                continue
            if about is None:
                about, message = kernel.begin(known)
                last = known.z, known.md
            hidden = _steps({c: v[h:] for c, v in rows.items()}, *last)
            before = last
            last = float(hidden["z"][-1]), float(hidden["md"][-1])
            message = yield r, hidden, about, message, before


def _steps(rows: dict[str, np.ndarray], z: float, md: float) -> dict[str, np.ndarray]:
    raw = np.diff(rows["md"], prepend=md)
    return {**rows, "raw_dm": raw, "dm": np.maximum(raw, 1.0), "dz": np.diff(rows["z"], prepend=z)}


def _in_order(chunks: DataFrame, *order) -> DataFrame:
    """Each well's chunks in order, over a stated number of tasks, as few bytes are much work."""
    return spread(chunks, "well_id").sortWithinPartitions("well_id", *order)


def filter_wells(chunks: DataFrame, kernel) -> DataFrame:
    """(well_id, row_idx, the kernel's columns) of hidden rows, in one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = _stream(frames, kernel)
        item = next(stream, None)
        while item is not None:
            r, rows, about, message, _ = item
            out, message = kernel.filtered(about, message, rows)
            yield pd.DataFrame({"well_id": r["well_id"], "row_idx": rows["row_idx"].astype(np.int64), **out})
            item = _send(stream, message)

    return _in_order(chunks, "chunk").mapInPandas(run, "well_id long, row_idx long, " + ", ".join(f"{c} double" for c in kernel.columns))


def _send(stream, message):
    try:
        return stream.send(message)
    except StopIteration:
        return None


def _read(r: dict) -> tuple[dict[str, np.ndarray], int]:
    """A chunk's rows, and how many of them are known."""
    rows = {c: np.asarray(r[c], float) for c in COLS}
    return rows, int(np.isfinite(rows["tvt_input"]).sum())


def _backward(kernel, well, about: np.ndarray, items: list[tuple[dict, np.ndarray]], carried) -> tuple[pd.DataFrame, object]:
    """The results of chunks that are held with the messages before them, from the last to the first, and what the chunk before needs."""
    found = []
    for rows, message in reversed(items):
        out, carried = kernel.backward(about, message, carried, rows)
        found.append(pd.DataFrame({"well_id": well, "row_idx": rows["row_idx"].astype(np.int64), **out}))
    return pd.concat(found, ignore_index=True), carried


def smooth_wells(chunks: DataFrame, kernel, held: int = HELD) -> DataFrame:
    """(well_id, row_idx, the kernel's columns) of hidden rows, in a pass forward and one back.

    A well of at most ``held`` chunks is held with its messages, and goes forward and back in one task. Of longer ones the message
    before each ``held`` chunks is written, and a second pass takes so many at a time, the last ones first.
    """
    chunks = written(chunks, "chunks")
    last = F.col("chunk") + F.col("later")
    schema = "well_id long, row_idx long, " + ", ".join(f"{c} double" for c in kernel.columns)

    def both(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, items = _stream(frames, kernel), []
        item = next(stream, None)
        while item is not None:
            r, rows, about, message, _ = item
            items.append((rows, message))
            if r["later"]:
                item = _send(stream, kernel.forward(about, message, rows))
                continue
            yield _backward(kernel, r["well_id"], about, items, None)[0]
            items = []
            item = _send(stream, message)

    def ahead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, seen = _stream(frames, kernel), None
        item = next(stream, None)
        while item is not None:
            r, rows, about, message, before = item
            if seen != (r["well_id"], r["chunk"] // held):
                seen = r["well_id"], r["chunk"] // held
                yield pd.DataFrame({"well_id": [r["well_id"]], "chunk": [r["chunk"]], "about": [about.tolist()], "message": [message.astype("<f8").tobytes()], "before": [list(before)]})
            # nothing comes after the last chunk
            item = _send(stream, kernel.forward(about, message, rows) if r["later"] else message)

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        well, carried, items = None, None, []
        for r in (r for f in frames for r in f.to_dict("records")):
            if r["well_id"] != well:
                well, carried = r["well_id"], None
            rows, h = _read(r)
            if h == len(rows["md"]):
                continue
            if r["about"] is not None:
                about, message, before, items = np.asarray(r["about"], float), np.frombuffer(r["message"], "<f8"), tuple(r["before"]), []
            rows = _steps({c: v[h:] for c, v in rows.items()}, *before)
            before = float(rows["z"][-1]), float(rows["md"][-1])
            items.append((rows, message))
            if r["later"] and (r["chunk"] + 1) % held:
                message = kernel.forward(about, message, rows)
            else:
                found, carried = _backward(kernel, well, about, items, carried)
                yield found

    out = _in_order(chunks.where(last < held), "chunk").mapInPandas(both, schema)
    long = chunks.where(last >= held)
    if long.isEmpty():
        return out
    messages = _in_order(long, "chunk").mapInPandas(ahead, "well_id long, chunk long, about array<double>, message binary, before array<double>")
    long = long.drop("curve_t", "curve_g").join(written(messages, "messages"), ["well_id", "chunk"], "left")
    return out.unionByName(_in_order(long, F.desc(F.floor(F.col("chunk") / held)), "chunk").mapInPandas(back, schema))
