"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Rows go to shards by a hash of their id, so that copies of one vector are spread over all of them. Each shard
keeps one copy of equal vectors with its smallest ids and builds a graph over the rest: every node has a
random level, the nodes of level l and above form layer l, and each layer is a flat array of neighbours.
Vectors get one more component that makes their norms equal, which turns the largest inner product into the
nearest vector. A shard's index is one row of byte arrays in the shared folder. Queries meet every shard in
blocks; each (shard, block) pair is a task of bounded size, its best matches get their exact inner products
in double precision, and the shards' results are merged by query.

Building and searching work on many nodes at once: a beam of the best nodes seen is kept for each, and the
neighbours of the best unexpanded ones are scored together.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components are neither queries nor
candidates; so are rows without id; vectors of another length are no candidates; ties go to the smaller id;
rows that repeat the query's id are its own; of several vectors of one id the best counts; scores are exact in the
input's precision, graphs are in single precision; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.llm import scratch

#: Fixed by the task.
K = 20
QUERY_STEP = 20
#: Shards at least, and rows that a shard holds at most on average; queries of a block.
MIN_SHARDS = 8
SHARD_ROWS = 50_000
BLOCK_QUERIES = 65_536
#: Links of a node above layer 0 (twice as many there), beam widths, nodes expanded at once, nodes inserted at once.
LINKS = 16
BUILD_BEAM = 64
BEAM = 128
EXPAND = 4
BATCH = 512


def _sims(q: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.matmul(vectors[ids], q[:, :, None])[:, :, 0]


def beam_search(vectors: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``width`` best nodes found for each query, best first; -1 where there are fewer."""
    n, m = len(links), len(q)
    seen = np.zeros((m, n + 1), bool)
    ids = np.full((m, width), -1, np.int64)
    sims = np.full((m, width), -np.inf, np.float32)
    e = entry.shape[1]
    ids[:, :e] = entry
    sims[:, :e] = np.where(entry >= 0, _sims(q, vectors, np.maximum(entry, 0)), -np.inf)
    seen[np.arange(m)[:, None], entry] = True
    done = sims == -np.inf
    live = np.arange(m)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        top = np.argpartition(-open_sims, EXPAND - 1, axis=1)[:, :EXPAND]
        on = np.take_along_axis(open_sims, top, 1) > -np.inf
        busy = on.any(axis=1)
        live, top, on = live[busy], top[busy], on[busy]
        if not len(live):
            break
        chosen = np.where(on, ids[live[:, None], top], -1)
        done[live[:, None], top] = True
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        fresh = near >= 0
        keep = fresh.sum(axis=1).max(initial=0)
        if not keep:
            continue
        near = -np.sort(-near, axis=1)[:, :keep]
        fresh = near >= 0
        seen[live[:, None], near] = True
        seen[:, n] = False
        found = np.where(fresh, _sims(q[live], vectors, np.maximum(near, 0)), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_sims = np.concatenate([sims[live], found], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims


def _spread(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    """Of candidates, best first, up to ``count`` that are nearer to the node than to any chosen before; then the nearest others."""
    m, c = ids.shape
    x = vectors[np.maximum(ids, 0)]
    between = np.matmul(x, x.transpose(0, 2, 1))
    good = np.zeros((m, c), bool)
    for j in range(c):
        blocked = (good & (between[:, j] > sims[:, j][:, None])).any(axis=1)
        good[:, j] = (ids[:, j] >= 0) & ~blocked & (good.sum(axis=1) < count)
    # chosen first, in order; nearest others after them
    order = np.argsort(np.where(ids < 0, 3, np.where(good, 0, 1)) * (c + 1) + np.arange(c), axis=1)[:, :count]
    out = np.full((m, count), -1, np.int64)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


def _link(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Set the links of new nodes, and link back; a full node keeps its nearest."""
    links[new, : chosen.shape[1]] = chosen
    to, by = chosen.ravel(), np.repeat(new, chosen.shape[1])
    by, to = by[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    width = links.shape[1]
    extra = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
    extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(start, count)] = by
    both = np.concatenate([links[nodes], extra], axis=1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    sims = np.where(both >= 0, _sims(vectors[nodes], vectors, np.maximum(both, 0)), -np.inf)
    best = np.argsort(-sims, axis=1, kind="stable")[:, : width + LINKS]
    both, sims = np.take_along_axis(both, best, 1), np.take_along_axis(sims, best, 1)
    full = (both >= 0).sum(axis=1) > width
    both_cut = both[:, :width].copy()
    if full.any():
        for a in range(0, int(full.sum()), BATCH):
            rows = np.flatnonzero(full)[a : a + BATCH]
            both_cut[rows] = _spread(vectors, both[rows], sims[rows], width)
    links[nodes] = both_cut


class Graph:
    """Layers of neighbours over unit-norm-like vectors; nodes are numbered by falling level."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        """``levels`` fall, so that layer l holds the first nodes."""
        n = len(vectors)
        sizes = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
        layers = [np.full((s, LINKS * 2 if level == 0 else LINKS), -1, np.int64) for level, s in enumerate(sizes)]
        graph = cls(vectors, layers)
        at = 0
        while at < n:
            size = min(n - at, BATCH, max(at, 64))
            # a batch holds nodes of one level
            level = int(levels[at])
            size = min(size, sizes[level] - at)
            graph._insert(np.arange(at, at + size), level)
            at += size
        return graph

    def _insert(self, new: np.ndarray, level: int) -> None:
        at, q = int(new[0]), self.vectors[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        entry = np.zeros((len(new), 1), np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            links = self.layers[layer]
            known = min(at, len(links))
            inside = layer <= level
            if known:
                ids, sims = beam_search(self.vectors, links[:known], q, entry, BUILD_BEAM if inside else EXPAND)
                entry = ids[:, :EXPAND]
            else:
                ids, sims = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32)
            if inside:
                peers = min(LINKS, len(new) - 1)
                near = np.argsort(-own, axis=1)[:, :peers]
                ids = np.concatenate([ids, new[near]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                if ids.shape[1]:
                    _link(self.vectors, links, new, _spread(self.vectors, ids, sims, min(LINKS, ids.shape[1])))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = beam_search(self.vectors, self.layers[layer], q, entry, EXPAND)[0]
        return beam_search(self.vectors, self.layers[0], q, entry, width)


_INDEX = "dim int, shard long, ids binary, first binary, vectors binary, sizes binary, links binary"


def _build(table: pa.Table) -> pa.Table:
    """The index row of one shard."""
    ids = table.column("vec_id").to_numpy()
    dim = table.column("dim")[0].as_py()
    x = table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    # equal vectors: one node, with the smallest ids that a query can need
    key = np.ascontiguousarray(x + 0.0).view(f"V{8 * dim}").ravel()
    _, node, count = np.unique(key, return_inverse=True, return_counts=True)
    by_node = np.argsort(node, kind="stable")
    start = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(ids)) - np.repeat(start[:-1], count)
    kept = by_node[place <= K]
    ids, node = ids[kept], node[kept]
    first = np.concatenate([[0], np.cumsum(np.minimum(count, K + 1))])
    nodes = x[by_node[start[:-1]]]
    rng = np.random.default_rng(len(nodes))
    levels = np.floor(-np.log(1.0 - rng.random(len(nodes))) / np.log(LINKS)).astype(np.int64)
    by_level = np.argsort(-levels, kind="stable")
    owners = np.repeat(np.arange(len(nodes)), np.diff(first))
    rank = np.empty(len(nodes), np.int64)
    rank[by_level] = np.arange(len(nodes))
    shuffle = np.argsort(rank[owners], kind="stable")
    sizes = np.diff(first)[by_level]
    graph = Graph.build(level_norms(nodes[by_level]), levels[by_level])
    row = [
        pa.array([dim], pa.int32()),
        pa.array([table.column("shard")[0].as_py()], pa.int64()),
        *[pa.array([v.tobytes()], pa.binary()) for v in (ids[shuffle].astype("<i8"), np.concatenate([[0], np.cumsum(sizes)]).astype("<i8"), nodes[by_level].astype("<f8"), np.array([len(a) for a in graph.layers], "<i8"), np.concatenate([a.ravel() for a in graph.layers]).astype("<i4"))],
    ]
    return pa.table(row, names=["dim", "shard", "ids", "first", "vectors", "sizes", "links"])


def level_norms(x: np.ndarray) -> np.ndarray:
    """Vectors, scaled together into the range of single precision, with one more component that gives all the norm of the longest."""
    x = x / max(float(np.abs(x).max(initial=0.0)), 1e-300)
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, original vectors, ids, and where each node's ids begin."""
    x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    flat, layers, at = np.frombuffer(row["links"], "<i4").astype(np.int64), [], 0
    for level, size in enumerate(np.frombuffer(row["sizes"], "<i8").tolist()):
        width = LINKS if level else 2 * LINKS
        layers.append(flat[at : at + size * width].reshape(size, width))
        at += size * width
    return Graph(level_norms(x), layers), x, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["first"], "<i8")


def match(graph: Graph, x: np.ndarray, ids: np.ndarray, first: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int = K, width: int = BEAM):
    """Up to k (query, id, score) of one shard for each query."""
    small = q / np.maximum(np.abs(q).max(axis=1, keepdims=True), 1e-300)
    padded = np.concatenate([small, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    found, _ = graph.search(padded, min(width, max(EXPAND, len(x))))
    rows, cols = np.nonzero(found >= 0)
    node = found[rows, cols]
    score = np.einsum("ij,ij->i", q[rows].astype(np.float64), x[node].astype(np.float64))
    many = np.diff(first)[node]
    r, s = np.repeat(rows, many), np.repeat(score, many)
    spot = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
    v = ids[np.repeat(first[node], many) + spot]
    other = v != query_ids[r]
    r, s, v = r[other], s[other], v[other]
    # an id takes one place, with its best vector
    order = np.lexsort((-s, v, r))
    r, s, v = r[order], s[order], v[order]
    new = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))[: len(r)]
    r, s, v = r[new], s[new], v[new]
    order = np.lexsort((v, -s, r))
    r, s, v = r[order], s[order], v[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    keep = rank < k
    return query_ids[r[keep]], v[keep], s[keep]


def _search(index: pa.Table, queries: pa.Table) -> pa.Table:
    out = [], [], []
    if index.num_rows and queries.num_rows:
        row = index.to_pylist()[0]
        graph, x, ids, first = load(row)
        qid = queries.column("query_id").to_numpy()
        q = queries.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(qid), row["dim"])
        size = max(16, min(BATCH, (1 << 26) // max(len(x), 1)))
        for a in range(0, len(qid), size):
            for col, part in zip(out, match(graph, x, ids, first, qid[a : a + size], q[a : a + size]), strict=True):
                col.append(part)
    cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["query_id", "vec_id", "score"])


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part, repeated rows once."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & some)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"), F.size(x).alias("dim")).distinct()


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """The k nearest found for every row whose id ``step`` divides: query_id, rank, vec_id, score."""
    rows = scratch.write(valid(vectors), "hnsw-rows")
    total = rows.count()
    shards = max(MIN_SHARDS, -(-total // SHARD_ROWS))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    index = scratch.write(placed.groupBy("dim", "shard").applyInArrow(_build, _INDEX), "hnsw-index")
    queries = rows.where(F.col("vec_id") % step == 0).withColumnRenamed("vec_id", "query_id")
    blocks = max(1, -(-(total // step + 1) // BLOCK_QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ("dim", "shard", "block")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
