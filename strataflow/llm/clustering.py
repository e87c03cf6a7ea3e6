"""Centroid clustering of integer vectors with block-norm screening.

Vectors become integers once and are written with their compressed form, the Euclidean norm of each segment
of components. By the Cauchy-Schwarz inequality the inner product of two segments is at most the product of
their norms, so the sum over segments of ``(norm of x - norm of c) ** 2`` is never more than the squared
distance. A task first takes, for each vector, the exact distance to the centroid of the least bound; then it
goes through the centroids, and only vectors whose bound does not exceed the best distance so far get an exact
integer distance. A round is one pass over the written table: tasks send one sum for each centroid and
component, which Spark adds up; the driver sees the few centroids only.

How much is screened depends on the vectors: bounds are tight where clusters differ in where their length
lies, and do nothing for vectors of equal length and random direction.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones take no
part, as do those with a component beyond ``WIDEST``; rows without vec_id are assigned like others, but are never
a first centroid; rows that repeat a vec_id are vectors of their own, ties of hashes go by the written bytes; with fewer
vectors than centroids there are as many centroids as vectors; a distance or an inertia beyond 64 bits is the
largest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm import scratch

#: Fixed by the task.
DIM, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Segments of a vector.
SEGMENTS = 8
#: Integers up to here are squared and summed in 64 bits, larger ones as Python's; sums of all rows have 38 decimal digits.
NARROW = 1 << 27
WIDEST = 2.0**84
#: Bytes of an integer of a wide vector; vectors that are compared at once.
WIDE_BYTES = 12
BLOCK = 4096
LONGEST = (1 << 63) - 1

_ROWS = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("norms", pa.binary())])
_SUMS = pa.schema([("cluster", pa.int32()), ("pos", pa.int32()), ("total", pa.decimal128(38, 0))])
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """The norm of each segment of each vector; segments differ by one component at most."""
    square = x.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(square, np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1], axis=1))


def screen(x: np.ndarray, norms: np.ndarray, c: np.ndarray, c_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the first), its squared distance, and how many exact distances that took."""
    bound = ((norms[:, None, :] - c_norms[None]) ** 2).sum(axis=2)
    # a bound is taken for less than it is by more than its rounding
    bound -= 1e-12 * (np.sqrt((norms**2).sum(axis=1))[:, None] + np.sqrt((c_norms**2).sum(axis=1))[None]) ** 2
    at = bound.argmin(axis=1)
    best = ((x - c[at]) ** 2).sum(axis=1)
    first, exact = at.copy(), len(x)
    for k in range(len(c)):
        rows = np.flatnonzero((bound[:, k] <= best.astype(np.float64)) & (first != k))
        d = ((x[rows] - c[k]) ** 2).sum(axis=1)
        exact += len(rows)
        nearer = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
        at[rows[nearer]], best[rows[nearer]] = k, d[nearer]
    return at, best, exact


def _narrow(x: np.ndarray) -> bool:
    return bool(np.abs(x).max(initial=0) < NARROW)


def _encode(scale: int, segments: int):
    """Vectors as integers, in two, four or more bytes each, and their segment norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            x = np.floor(col.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1) * scale)
            norms, top = segment_norms(x, segments), np.abs(x).max(axis=1, initial=0)
            raw = []
            for row, most in zip(x, top.tolist(), strict=True):
                if most < NARROW:
                    raw.append(row.astype("<i2" if most < 1 << 15 else "<i4").tobytes())
                else:
                    raw.append(b"".join(int(v).to_bytes(WIDE_BYTES, "little", signed=True) for v in row.tolist()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array([n.tobytes() for n in norms], pa.binary())], schema=_ROWS)

    return run


def decode(raw: bytes, dim: int) -> list[int] | np.ndarray:
    size = len(raw) // dim
    if size == WIDE_BYTES:
        return [int.from_bytes(raw[i : i + size], "little", signed=True) for i in range(0, len(raw), size)]
    return np.frombuffer(raw, f"<i{size}")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int, segments: int):
    """(ids, vectors, cluster, distance) of blocks of rows."""
    c = np.array(centroids, dtype=object)
    c_norms = segment_norms(c, segments)
    if _narrow(c):
        c = c.astype(np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            raw = part.column("x").to_pylist()
            norms = np.frombuffer(b"".join(part.column("norms").to_pylist())).reshape(len(raw), segments)
            sizes = np.array([len(r) for r in raw]) // dim
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size == WIDE_BYTES:
                    x = np.array([decode(raw[i], dim) for i in rows], dtype=object)
                else:
                    x = np.frombuffer(b"".join(raw[i] for i in rows), f"<i{size}").reshape(len(rows), dim).astype(c.dtype)
                at, d, _ = screen(x, norms[rows], c, c_norms)
                yield part.column("vec_id").take(pa.array(rows)), x, at, d


def _sums(centroids: list[list[int]], dim: int, segments: int):
    """The sum of each component over each cluster's vectors of a task; the component after the last counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dim + 1), dtype=object)
        for _, x, at, _ in _assigned(batches, centroids, dim, segments):
            for k in np.unique(at).tolist():
                total[k, :dim] += x[at == k].sum(axis=0).astype(object)
                total[k, dim] += int((at == k).sum())
        some = np.flatnonzero(total[:, dim] > 0)
        cols = np.repeat(some, dim + 1), np.tile(np.arange(dim + 1), len(some)), [Decimal(int(v)) for v in total[some].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(cols, _SUMS, strict=True)], schema=_SUMS)

    return run


def _assign(centroids: list[list[int]], dim: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, at, d in _assigned(batches, centroids, dim, segments):
            d = [min(v, LONGEST) for v in d.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(d, pa.int64())], schema=_ASSIGNED)

    return run


def encoded(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, x, norms) of the vectors that take part, as a written table."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > WIDEST / scale))
    rows = vectors.where((F.size("embedding") == dim) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return scratch.write(rows.mapInArrow(_encode(scale, segments), "vec_id long, x binary, norms binary"), "centroid-vectors")


def starts(rows: DataFrame, k: int = CLUSTERS, dim: int = DIM) -> list[list[int]]:
    """The vectors of the k least hashes of their ids, as first centroids."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    least = rows.where("vec_id is not null").select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [list(map(int, decode(bytes(r.x), dim))) for r in sorted(least, key=lambda r: (r.h, bytes(r.x)))]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """A row for each vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = encoded(vectors, dim, scale, segments)
    centroids = starts(rows, k, dim)
    if not centroids:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centroids, dim, segments), "cluster int, pos int, total decimal(38,0)")
        total = {(r.cluster, r.pos): int(r.total) for r in sums.groupBy("cluster", "pos").agg(F.sum("total").alias("total")).collect()}
        centroids = [[total[c, i] // total[c, dim] for i in range(dim)] if (c, dim) in total else old for c, old in enumerate(centroids)]
    assigned = scratch.write(rows.mapInArrow(_assign(centroids, dim, segments), "vec_id long, cluster int, distance long"), "centroid-assigned")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    everything = min(sum(inertia.values()), LONGEST)
    facts = [(c, min(inertia[c], LONGEST), everything, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each centroid
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY 1, 2 LIMIT 16))",
    ]
    for r in range(rounds + 1):
        near = f"""a{r} AS (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT n, vec_id, x, c,
  list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS d FROM (SELECT row_number() OVER () AS n, * FROM v) CROSS JOIN c{r}) GROUP BY n, vec_id, x)"""
        parts.append(near)
        if r < rounds:
            sums = f"s{r} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i)"
            means = f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c)"
            parts += [sums, means, f"c{r + 1} AS (SELECT c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (c))"]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE = _oracle()
