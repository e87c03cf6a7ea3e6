"""Running NumPy kernels well by well.

A well's rows are gathered into arrays (one shuffle by well), its curve's points likewise, and both meet in one
row; kernels then run batch by batch in Arrow-backed pandas. A well is a sequence that can't be split, but the
seeds of a particle filter can: ``fan`` makes a row for each seed, so one long well still fills many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.kernels import filters as K
from strataflow.kernels import matching as M
from strataflow.kernels import series as S

COLS = ("row_idx", "md", "x", "y", "z", "gr", "tvt_input")


@dataclass
class Well:
    """One well as arrays; missing values are NaN. ``h`` is where the hidden rows begin, ``extra`` what else its row holds."""

    well_id: int
    rows: dict[str, np.ndarray]
    curve_t: np.ndarray
    curve_g: np.ndarray
    seed: int = 0
    extra: dict | None = None

    def __post_init__(self):
        known = np.isfinite(self.rows["tvt_input"])
        self.h = int(known.sum())
        self.usable = 10 <= self.h < len(known) and bool(known[: self.h].all()) and len(self.curve_t) > 1
        gr = self.rows["gr"]
        have = np.isfinite(gr)
        i = np.arange(len(gr))
        self.gr = np.interp(i, i[have], gr[have]) if have.any() else np.full(len(gr), float(np.mean(self.curve_g)) if len(self.curve_g) else 0.0)

    @property
    def curve(self) -> K.Curve:
        return K.Curve(self.curve_t, self.curve_g)

    @property
    def level(self) -> float:
        return float(self.rows["tvt_input"][self.h - 1])

    @property
    def sigma(self) -> float:
        known = self.rows["tvt_input"][: self.h]
        return K.noise(self.rows["gr"][: self.h] - self.curve(known))

    @property
    def rate(self) -> float:
        """Median of the rates of level plus z over the last 30 known rows, of those that move along the well; 0 with fewer than three."""
        u = np.diff((self.rows["tvt_input"] + self.rows["z"])[: self.h][-30:])
        dm = np.diff(self.rows["md"][: self.h][-30:])
        return float(np.median(u[dm > 0] / dm[dm > 0])) if (dm > 0).sum() >= 3 else 0.0

    def hidden(self, name: str) -> np.ndarray:
        return self.rows[name][self.h :]

    @property
    def hidden_gr(self) -> np.ndarray:
        """The signal of the hidden rows, filled from these alone; as it is where all are missing."""
        gr = self.hidden("gr")
        have, i = np.isfinite(gr), np.arange(len(gr))
        return np.interp(i, i[have], gr[have]) if have.any() else gr

    @property
    def dm(self) -> np.ndarray:
        return K.steps(self.hidden("md"), self.rows["md"][self.h - 1])

    @property
    def dz(self) -> np.ndarray:
        return np.diff(self.hidden("z"), prepend=self.rows["z"][self.h - 1])


def pack(wells: DataFrame, curves: DataFrame, value: float = 1.0) -> DataFrame:
    """A row for each well with its arrays and its curve's; curve values are divided by ``value``."""
    rows = wells.groupBy("well_id", "curve_id").agg(F.sort_array(F.collect_list(F.struct(*COLS))).alias("r"))
    rows = rows.select("well_id", "curve_id", *[F.transform(F.col(f"r.{c}"), lambda v: v.cast("double")).alias(c) for c in COLS])
    pts = curves.groupBy("curve_id").agg(F.sort_array(F.collect_list(F.struct("tvt", (F.col("gr") / value).alias("gr")))).alias("c"))
    out = rows.join(pts.select("curve_id", F.col("c.tvt").alias("curve_t"), F.col("c.gr").alias("curve_g")), "curve_id")
    return spread(out, "well_id")


def spread(packed: DataFrame, *keys: str) -> DataFrame:
    """Packed wells over a stated number of tasks: they are few bytes and much work, so they must not be merged by size."""
    spark = packed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return packed.repartition(tasks, *keys)


def fan(packed: DataFrame, seeds: int) -> DataFrame:
    """A row for each well and seed (or block of seeds), spread over tasks."""
    return spread(packed.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))), "well_id", "seed")


def per_well(packed: DataFrame, kernel: Callable[[Well], dict | None], schema: str) -> DataFrame:
    """The rows that a kernel makes of each well (a dict of columns), or none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                w = _well(r)
                made = kernel(w)
                if made is not None:
                    yield pd.DataFrame({"well_id": w.well_id, **made})

    return packed.mapInPandas(run, schema)


#: Values of a frame that a task hands on.
FRAME = 200_000


def _well(r: dict) -> Well:
    rows = {c: np.asarray(r[c], float) for c in COLS}
    return Well(r["well_id"], rows, np.asarray(r["curve_t"], float), np.asarray(r["curve_g"], float), int(r.get("seed", 0)), r)


def _frames(made: Iterator[tuple[int, dict]], join: Callable[[list[dict]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of about ``FRAME`` values, as a frame for each well costs more than what is in it."""
    held, n = [], 0
    for size, row in made:
        held.append(row)
        n += size
        if n >= FRAME:
            yield join(held)
            held, n = [], 0
    if held:
        yield join(held)


def ensembles(packed: DataFrame, seeds: int, block: int, arms: list[Callable[[Well], tuple[np.ndarray, np.ndarray]]], scales: list[float], finish: Callable[[dict], dict], schema: str) -> DataFrame:
    """The rows that ``finish`` makes of each usable well's ensembles, one for each of ``arms``, which run a well's block of seeds.

    A block gives, by hidden row, the sums of its paths by evidence at each of the scales, and their mean and squared deviations,
    so that no path leaves its task however many seeds there are. ``finish`` gets row_idx, md, z and seeds, and of each arm
    the levels by scale and the paths' deviation.
    """

    def sums(w: Well) -> tuple[int, dict]:
        hidden = {c: w.hidden(c) if w.seed == 0 else None for c in ("row_idx", "md", "z")}
        row, size = {"well_id": w.well_id, "seed": w.seed, "seeds": block, **hidden}, 0
        for a, run in enumerate(arms):
            path, evidence = run(w)
            top, mean = float(evidence.max()), path.mean(axis=0)
            e = np.exp((evidence - top) / np.array(scales)[:, None])
            deviations = ((path - mean) ** 2).sum(axis=0)
            row |= {f"top{a}": top, f"mass{a}": e.sum(axis=1), f"sums{a}": (e @ path).ravel(), f"mean{a}": mean, f"dev{a}": deviations}
            size += (len(scales) + 2) * len(mean)
        return size, row

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames((sums(w) for f in frames for w in map(_well, f.to_dict("records")) if w.usable), pd.DataFrame)

    def joined(blocks: list[dict]) -> dict:
        count = np.array([b["seeds"] for b in blocks], float)[:, None]
        out = {c: np.asarray(blocks[0][c]) for c in ("row_idx", "md", "z")} | {"seeds": int(count.sum()), "arms": []}
        for a in range(len(arms)):
            top = np.array([b[f"top{a}"] for b in blocks])
            share = np.exp((top - top.max()) / np.array(scales)[:, None])
            mass = (share * np.array([b[f"mass{a}"] for b in blocks]).T).sum(axis=1)
            total = np.array([np.reshape(b[f"sums{a}"], (len(scales), -1)) for b in blocks])
            mean, dev = (np.array([b[f"{n}{a}"] for b in blocks]) for n in ("mean", "dev"))
            centre = (count * mean).sum(axis=0) / count.sum()
            spread = np.sqrt((dev + count * (mean - centre) ** 2).sum(axis=0) / count.sum())
            out["arms"].append(((share.T[:, :, None] * total).sum(axis=0) / mass[:, None], spread))
        return out

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        held: list[dict] = []
        for r in (r for f in frames for r in f.to_dict("records")):
            held.append(r)
            # a well's blocks come one after the other
            if len(held) * block == seeds:
                found = pd.DataFrame({"well_id": r["well_id"], **finish(joined(held))})
                held = []
                yield len(found), found

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(ends(frames), lambda found: pd.concat(found, ignore_index=True))

    if seeds % block:
        raise ValueError("blocks must be of one size")
    numbers = ["row_idx", "md", "z", *(f"{n}{a}" for a in range(len(arms)) for n in ("mass", "sums", "mean", "dev"))]
    fields = ["well_id long", "seed int", "seeds int", *(f"top{a} double" for a in range(len(arms))), *(f"{n} array<double>" for n in numbers)]
    blocks = fan(packed, seeds // block).mapInPandas(part, ", ".join(fields))
    return spread(blocks, "well_id").sortWithinPartitions("well_id", "seed").mapInPandas(whole, schema)


PATH = "well_id long, row_idx long, value double"


def _path(w: Well, value: np.ndarray) -> dict:
    return {"row_idx": w.hidden("row_idx").astype(np.int64), "value": value}


def paths(packed: DataFrame, decode: Callable[[Well], np.ndarray | None]) -> DataFrame:
    """A decoded level for every hidden row of each usable well that ``decode`` has a path for."""

    def kernel(w: Well) -> dict | None:
        value = decode(w) if w.usable else None
        return None if value is None else _path(w, value)

    return per_well(packed, kernel, PATH)


def beam(w: Well, preset: str = "mid") -> np.ndarray:
    """Beam search over the curve's own points, from the one nearest to the last known level."""
    width, move, scale, radius = M.BEAMS[preset]
    signal = w.hidden_gr
    signal = np.where(np.isfinite(signal), signal, float(np.mean(w.curve_g)))
    return w.curve_t[M.beam(M.smooth(signal, radius), w.curve_g, M.nearest(w.curve_t, w.level), width, move, scale)]


def templates(w: Well) -> np.ndarray | None:
    """Template matches at half-widths 8, 15 and 25, those that fit into the known rows; none if none does."""
    found = M.template_ensemble(w.gr[: w.h], w.rows["tvt_input"][: w.h], w.gr[w.h :])[0]
    return None if np.isnan(found).any() else found


def self_matches(w: Well, **options) -> dict | None:
    """Candidate paths where the hidden signal looks like the known one; the anchor stays at the last level and goes with z."""
    if not w.usable:
        return None
    anchor = w.level - (w.hidden("z") - w.rows["z"][w.h - 1]) * 0.1
    found = M.self_candidates(w.rows["tvt_input"][: w.h], w.gr[: w.h], w.hidden_gr, anchor, w.level, **options)
    if not found:
        return None
    at = w.hidden("row_idx").astype(np.int64)
    return {"candidate": np.repeat(list(found), len(at)), "row_idx": np.tile(at, len(found)), "value": np.concatenate(list(found.values()))}


def grid_filter(w: Well) -> np.ndarray | None:
    """None with fewer than five hidden rows or curve points."""
    if len(w.rows["md"]) - w.h < 5 or len(w.curve_t) < 5:
        return None
    at = lambda v: np.interp(v, w.curve_t, w.curve_g)
    sigma = K.noise(w.rows["gr"][: w.h] - at(w.rows["tvt_input"][: w.h]))
    dm = np.diff(w.hidden("md"), prepend=w.rows["md"][w.h - 1])
    return K.grid_filter(np.where(dm == 0, 1.0, dm), w.hidden("z"), w.hidden_gr, at, sigma, w.level, w.rows["z"][w.h - 1], w.rate)


def levels_of(w: Well, reach: float = 40.0, step: float = 0.5) -> np.ndarray:
    return w.level + np.arange(-reach, reach + step / 2, step)


def log_emission(w: Well, levels: np.ndarray, weight: float = 1.0) -> np.ndarray:
    gr = w.hidden("gr")
    r = (np.where(np.isfinite(gr), gr, 0.0)[:, None] - w.curve(levels)[None, :]) / w.sigma
    return np.where(np.isfinite(gr)[:, None], -0.5 * weight * np.minimum(r * r, 600.0), 0.0)


#: Presets of the smoother: step, rates, reach.
SMOOTHERS = {"fine": (0.2, 41, 150.0), "coarse": (0.7, 31, 80.0)}


def state_smoother(w: Well, preset: str = "coarse", reach: float | None = None) -> dict[str, np.ndarray]:
    step, k, wide = SMOOTHERS[preset]
    levels = levels_of(w, reach or wide, step)
    rates = w.rate + np.linspace(-0.1, 0.1, k)
    chain = K.StateChain(rates, len(levels), step)
    post, _ = K.smooth_states(chain, log_emission(w, levels), w.dm, w.dz, chain.start(len(levels) // 2, w.rate))
    return K.summary(post, levels)


def level_smoother(w: Well) -> dict[str, np.ndarray]:
    levels = levels_of(w)
    post = K.smooth_levels(log_emission(w, levels, 0.5), (w.rate * w.dm - w.dz) / 0.5, 2.0, 6, len(levels) // 2)
    return K.summary(post, levels)


def misfit_map(w: Well, levels: np.ndarray) -> np.ndarray:
    """Levels by columns: size of the misfit in deviations."""
    return (np.abs(w.gr[w.h :][None, :] - w.curve(levels)[:, None])) / w.sigma


def viterbi(w: Well, penalty: float = 0.05) -> np.ndarray:
    levels = levels_of(w)
    return levels[M.viterbi(misfit_map(w, levels), len(levels) // 2, penalty)]


def banded(w: Well) -> np.ndarray:
    levels = levels_of(w)
    return levels[M.banded_decode(misfit_map(w, levels) ** 2, (w.rate * w.dm - w.dz) / 0.5, 4, 0.05, len(levels) // 2)]


def warped(w: Well) -> np.ndarray:
    levels = levels_of(w, 20.0, 1.0)
    return levels[M.warp_path(misfit_map(w, levels))]


def dips(w: Well) -> np.ndarray:
    return M.dip_search(w.hidden("md"), w.hidden("z"), w.gr[w.h :], w.curve, w.level)


def filtered(w: Well, particles: int = 600, base: int = 42, pull: float | None = None) -> tuple[np.ndarray, float]:
    """Path and log-evidence of the filter of a well's seed."""
    rate = w.rate if pull is None else pull
    out, evidence = K.particle_filters(w.dm, w.hidden("z"), w.hidden("gr"), w.curve, w.sigma, w.level, w.rows["z"][w.h - 1], rate, [K.seed_of(w.well_id, base + w.seed)], particles)
    return out[0], float(evidence[0])


def filtered_block(w: Well, seeds: int, particles: int = 400, base: int = 42, calibrate: bool = False, pull: float = 0.0, dips: np.ndarray | None = None, fit: str = "gauss") -> tuple[np.ndarray, np.ndarray]:
    """Paths and log-evidence of the filters of a well's block of seeds, in one batch; each block draws on its own.

    With ``calibrate`` the curve is mapped to the well's signal half way, by a line through the known rows; the noise is what is left.
    """
    mine = [K.seed_of(w.well_id, base + w.seed * seeds + i) for i in range(seeds)]
    expected, seen = w.curve(w.rows["tvt_input"][: w.h]), w.rows["gr"][: w.h]
    gain = K.shrunk_affine(seen, expected) if calibrate else (1.0, 0.0)
    # a missing value of a known row counts as 0 here
    sigma = float(np.clip(np.std(np.nan_to_num(seen) - gain[0] * expected - gain[1]), 10, 60))
    return K.particle_filters(w.dm, w.hidden("z"), w.gr[w.h :], w.curve, sigma, w.level, w.rows["z"][w.h - 1], w.rate, mine, particles, spread=4.5, gain=gain, dips=dips, pull=pull, fit=K.FITS[fit])


def velocity_filter(w: Well, particles: int = 600, window: int = 5) -> np.ndarray:
    """The filter whose rate follows that of z as a regression of the known rows has it, and that sees the signal and its mean over a window."""
    slope, icpt, dev, rate = K.velocity_model(w.rows["tvt_input"][: w.h], w.rows["z"][: w.h], w.rows["md"][: w.h])
    mean = lambda x: pd.Series(x).rolling(window, center=True, min_periods=1).mean().to_numpy()
    smooth_curve = K.Curve(w.curve_t, mean(w.curve_g))
    # the first step of depth and z is one, as from a row before
    dm = np.append(1.0, np.maximum(np.diff(w.hidden("md")), 1.0))
    dz = np.append(1.0, np.diff(w.hidden("z")))
    seeds = [K.seed_of(w.well_id, "v")]
    return K.velocity_filters(dm, dz, w.hidden("gr"), mean(w.rows["gr"])[w.h :], w.curve, smooth_curve, w.sigma, w.level, rate, slope, icpt, dev, seeds, particles)


def heat_map(w: Well, bin_rows: int = 4, step: float = 2.0, filters: int = 48, particles: int = 400) -> dict | None:
    """Share of the filters' paths by bin of rows and level.

    Observations that many levels fit, or that tell little, count less; paths that follow their ups and downs count more.
    """
    if not w.usable:
        return None
    seeds = [K.seed_of(w.well_id, 42 + i) for i in range(filters)]
    gr = w.hidden("gr")
    few, told = K.curve_powers(gr, w.level, w.curve_t, w.curve_g, w.sigma)
    path, evidence = K.particle_filters(w.dm, w.hidden("z"), gr, w.curve, w.sigma, w.level, w.rows["z"][w.h - 1], w.rate, seeds, particles, power=few * told)
    weight = K.evidence_weights(evidence + [K.shape_bonus(gr, w.curve(p)) for p in path])
    b = np.broadcast_to(np.arange(path.shape[1]) // bin_rows, path.shape).ravel()
    lev = np.round(path / step).astype(np.int64).ravel()
    mass = np.repeat(weight, path.shape[1])
    t = pd.DataFrame({"bin": b, "level": lev, "m": mass}).groupby(["bin", "level"], as_index=False)["m"].sum()
    t["prob"] = t["m"] / t.groupby("bin")["m"].transform("sum")
    return {"bin": t["bin"].to_numpy(), "level": t["level"].to_numpy() * step, "prob": t["prob"].to_numpy()}


def powers(w: Well, slope: float = 0.0) -> dict | None:
    """By hidden row how far its observation counts: by how few levels fit it, and by how much it tells."""
    if not w.usable:
        return None
    few, told = K.curve_powers(w.hidden("gr"), w.level, w.curve_t, w.curve_g, w.sigma, slope=slope)
    return {"row_idx": w.hidden("row_idx").astype(np.int64), "ambiguity": few, "information": told}


def pseudo_curve(w: Well, weight: float = 0.5) -> dict | None:
    """The reference curve blended with what the known rows saw at the same levels."""
    if not w.usable:
        return None
    known, gr = w.rows["tvt_input"][: w.h], w.gr[: w.h]
    b = np.round(known * 2) / 2
    seen = pd.Series(gr).groupby(b).mean()
    own = np.interp(w.curve_t, seen.index.to_numpy(), seen.to_numpy(), left=np.nan, right=np.nan)
    out = np.where(np.isfinite(own), weight * own + (1 - weight) * w.curve_g, w.curve_g)
    return {"row_idx": np.arange(len(out)), "value": out}


def evidence_of_path(w: Well, path: np.ndarray) -> dict | None:
    """Fit of a path: rms misfit, correlation with the curve, and rms of the best warping."""
    if not w.usable:
        return None
    expected = w.curve(path)
    levels = levels_of(w, 20.0, 1.0)
    warp = misfit_map(w, levels)
    best = warp[M.warp_path(warp), np.arange(warp.shape[1])]
    r = (w.gr[w.h :] - expected) / w.sigma
    return {"rms": [float(np.sqrt(np.mean(r * r)))], "corr": [S.correlation(w.gr[w.h :], expected)], "warp_rms": [float(np.sqrt(np.mean(best * best)))]}


def replay(w: Well, share: float = 0.7, decode: Callable[[Well], np.ndarray] = viterbi) -> dict | None:
    """Hide the last known rows, decode them, and compare."""
    if not w.usable:
        return None
    cut = int(w.h * share)
    rows = {c: v[: w.h].copy() for c, v in w.rows.items()}
    truth = rows["tvt_input"][cut:].copy()
    rows["tvt_input"][cut:] = np.nan
    other = Well(w.well_id, rows, w.curve_t, w.curve_g)
    if not other.usable:
        return None
    e = decode(other) - truth
    return {"n": [len(e)], "rmse": [float(np.sqrt(np.mean(e * e)))], "persistence": [float(np.sqrt(np.mean((other.level - truth) ** 2)))]}
