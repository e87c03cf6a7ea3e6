"""Near-duplicate documents by HyperMinHash: compressed registers, bands, corrected estimates, then whole sets.

A set of 3-word shingles is hashed; the lowest bits of a hash say which of 256 buckets it falls into, and the
least of the other bits in a bucket becomes a register of 16 bits, the number of leading zeros and the ten bits
after them. A bucket without shingle takes the register of another one, the first that has any in an order of its
own, so that short sets have all registers too. Five registers are a band. Sets with a Jaccard similarity of
just 0.85 miss each other in all 36 bands about once in 1e6, at 0.9 less than once in 1e10 (registers agree less
often by chance where sets are about as large as the number of buckets; that is counted in).

Sets that share a band are compared by registers first: the share of equal ones, less what unlike registers
share by collision, estimates the similarity. Six standard deviations below the limit a pair is ruled out; all other
pairs are counted on their whole sets, and these counts alone decide.

Equal sets are one node, named by the least doc_id. Nodes that bands connect are a family. Families of up to
``BLOCK`` nodes are compared in one block (small ones share blocks); larger ones are dealt into blocks, and go on
with one node for each component found as long as that joins many. What is left are bands whose nodes are in different
components: each is compared as a block of up to ``BLOCK`` nodes, a larger one as several blocks that meet. So
registers travel once for each node and once more for each such band, whole sets only for nodes with a candidate.

Defined cases: null, empty or blank texts have an empty set and link with nothing; rows with a null doc_id come back
with null component_id and kept, and make no links; equal texts are in one component; repeated rows come back as
often as they came in, all with their component; rows of one doc_id with different texts are documents of their own;
very long texts are hashed piece by piece and counted whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm import hashing, scratch
from strataflow.llm.components import components
from strataflow.llm.jaccard import _planes, _runs, _unplaned

#: Fixed by the task: words of a shingle; similarity of at least NUM / DEN.
WORDS = 3
NUM, DEN = 85, 100
#: Registers of a sketch (a power of two), mantissa bits of a register, registers of a band, bands.
REGISTERS, MANTISSA, ROWS, BANDS = 256, 10, 5, 36
#: Bytes of a token of a whole set: two sets of 400 shingles differ in a comparison by a clash once in 2e9.
WIDTH = 6
#: Standard deviations below the limit at which an estimate rules a pair out.
DEVIATIONS = 6.0
#: Nodes of a block; nodes of the small families that share one. Rounds go on while they join a share of the components.
BLOCK, SHARED = 4096, 512
GOES_ON = 0.25
#: Candidates, of some 80 bytes each, up to which their names go to all executors; more are joined by a shuffle of the texts.
BROADCAST = 500_000
_BITS = REGISTERS.bit_length() - 1

_SKETCHES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("registers", pa.binary())])
_INDEX = pa.schema([("band", pa.int64()), ("node", pa.int64())])
_WHOLE = pa.schema([("grp", pa.int64()), ("node", pa.int64()), ("key", pa.binary()), ("tokens", pa.binary())])
_LEFT = "grp long, node long, key binary, label long, n long, place int, mates binary"


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


@cache
def _donors() -> np.ndarray:
    """For each bucket, in which order others are asked for a register if it has none."""
    return np.argsort(np.random.default_rng(20240311).random((REGISTERS, REGISTERS)), axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set, of which none is empty."""
    sizes = np.array([len(s) for s in sets])
    h = hashing.mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F))
    slot = np.repeat(np.arange(len(sets)), sizes) * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64)
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, h >> np.uint64(_BITS))
    least = least.reshape(len(sets), REGISTERS)
    empty = least == np.iinfo(np.uint64).max
    # a double's exponent counts the zeros and its fraction begins with the bits after them
    fraction, exponent = np.frexp(least.astype(np.float64))
    mantissa = np.minimum(((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    zeros = np.maximum(64 - _BITS - exponent, 0)
    out = ((zeros << MANTISSA) | np.maximum(mantissa, 0)).astype(np.uint16)
    donors = _donors()
    for i in np.flatnonzero(empty.any(axis=1)).tolist():
        lack = np.flatnonzero(empty[i])
        order = donors[lack]
        out[i, lack] = out[i, order[np.arange(len(lack)), (~empty[i])[order].argmax(axis=1)]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A hash for each band of each sketch."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketch), BANDS))
    for r in range(ROWS):
        h = hashing.mix((h << np.uint64(16)) ^ (h >> np.uint64(40)) ^ sketch[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
    return h.view(np.int64)


@cache
def collisions(log_size: int) -> float:
    """The chance that registers of different shingles are equal, for sets of about 2 ** (log_size / 2) shingles."""
    load = max(2.0 ** (log_size / 2) / REGISTERS, 1.0)
    # least values are spread like the least of ``load`` uniform ones; a register is an interval of them
    zeros = np.arange(64 - _BITS)[:, None]
    lower = 2.0 ** -(zeros + 1.0) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    upper = lower + 2.0 ** -(zeros + 1.0 + MANTISSA)
    share = np.exp(load * np.log1p(-lower)) - np.exp(load * np.log1p(-np.minimum(upper, 1 - 1e-15)))
    return float((share**2).sum())


def estimates(equal: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Jaccard similarities from shares of equal registers, corrected for collisions; ``size`` is the sets' mean."""
    logs = np.round(2 * np.log2(np.maximum(size, 1))).astype(int)
    by_chance = np.array([collisions(v) for v in range(int(logs.max(initial=0)) + 1)])[logs]
    return (equal - by_chance) / (1 - by_chance)


def least_estimate(size: np.ndarray) -> np.ndarray:
    """The estimate below which pairs of about ``size`` shingles are ruled out."""
    t = NUM / DEN
    return t - DEVIATIONS * np.sqrt(t * (1 - t) * 1.5 / np.clip(size, 1, REGISTERS))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, key, registers); a set that the task has sketched before comes without registers."""
    seen: set[bytes] = set()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in _runs(texts):
            sets = hashing.shingle_sets(texts[a:b].to_pylist(), WORDS)
            keys = [_key(s) if len(s) else None for s in sets]
            new = []
            for i, k in enumerate(keys):
                if k is not None and k not in seen:
                    seen.add(k)
                    new.append(i)
            sketches: list[bytes | None] = [None] * len(sets)
            if new:
                for i, row in zip(new, registers([sets[i] for i in new]), strict=True):
                    sketches[i] = row.astype("<u2").tobytes()
            cols = ids[a:b], [len(s) for s in sets], keys, sketches
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SKETCHES, strict=True)], schema=_SKETCHES)
            if len(seen) > 1_000_000:
                seen.clear()
    hashing.release()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("registers")))
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], schema=_INDEX)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Guests with the tokens of their whole texts; a row that repeats a document's text comes once from each task."""
    seen: set[tuple[int, bytes, int]] = set()
    for batch in batches:
        texts = batch.column("text")
        for a, b in _runs(texts):
            sets = hashing.shingle_sets(texts[a:b].to_pylist(), WORDS)
            keys, part = [_key(s) for s in sets], batch.slice(a, b - a)
            on, named = [], list(zip(part.column("node").to_pylist(), keys, part.column("grp").to_pylist(), strict=True))
            for i, key in enumerate(part.column("key").to_pylist()):
                # a document's other texts have other keys
                if key == keys[i] and named[i] not in seen:
                    seen.add(named[i])
                    on.append(i)
            left = part.take(pa.array(on, pa.int64()))
            tokens = pa.array([_planes(sets[i] >> np.uint64(64 - 8 * WIDTH), WIDTH) for i in on], pa.binary())
            yield pa.RecordBatch.from_arrays([*(left.column(c) for c in _WHOLE.names[:-1]), tokens], schema=_WHOLE)
    hashing.release()


def candidates(allowed: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The allowed pairs of a block that are near enough in size and by estimate."""
    pairs = np.triu(allowed & (n[:, None] * NUM <= n[None, :] * DEN) & (n[None, :] * NUM <= n[:, None] * DEN), 1)
    for i in np.flatnonzero(pairs.any(axis=1)).tolist():
        j = np.flatnonzero(pairs[i])
        size = (n[i] + n[j]) / 2
        equal = (sketch[j] == sketch[i]).mean(axis=1)
        pairs[i, j] = estimates(equal, size) >= least_estimate(size)
    return pairs


def _filter(table: pa.Table) -> pa.Table:
    """The nodes of one block that have a candidate there, with their place in it and a bit for each place, set for candidates."""
    table = table.sort_by([("node", "ascending"), ("key", "ascending")])
    family, label, side = (table.column(x).to_numpy() for x in ("family", "label", "side"))
    allowed = (family[:, None] == family[None, :]) & (label[:, None] != label[None, :]) & ((side[:, None] | side[None, :]) == 3)
    pairs = candidates(allowed, table.column("n").to_numpy(), _matrix(table.column("registers")))
    on = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
    left = table.select(["grp", "node", "key", "label", "n"]).take(pa.array(on))
    mates = [row.tobytes() for row in np.packbits(pairs[on], axis=1)]
    return left.append_column("place", pa.array(on, pa.int32())).append_column("mates", pa.array(mates, pa.binary()))


def _verify(left: pa.Table, whole: pa.Table) -> pa.Table:
    """(label, merged) for the components that links of one block join."""
    merged: dict[int, int] = {}
    if left.num_rows:
        sets = {(n, k): t for n, k, t in zip(*(whole.column(c).to_pylist() for c in ("node", "key", "tokens")), strict=True)}
        tokens = [_unplaned(sets[n, k], WIDTH) for n, k in zip(left.column("node").to_pylist(), left.column("key").to_pylist(), strict=True)]
        mates = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in left.column("mates").to_pylist()]), axis=1)
        merged = joined(mates[:, left.column("place").to_numpy()] > 0, left.column("label").to_pylist(), tokens)
    return pa.table({"label": pa.array(list(merged), pa.int64()), "merged": pa.array(list(merged.values()), pa.int64())})


def joined(pairs: np.ndarray, labels: list[int], tokens: list[np.ndarray]) -> dict[int, int]:
    """Labels that links between candidates join, with the least of their component; pairs that are joined already are not counted."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    sizes = np.array([len(t) for t in tokens])
    for i in np.flatnonzero(pairs.any(axis=1)).tolist():
        own = find(labels[i])
        j = np.array([k for k in np.flatnonzero(pairs[i]).tolist() if find(labels[k]) != own], np.int64)
        if not len(j):
            continue
        mine = np.sort(tokens[i])
        flat = np.concatenate([tokens[k] for k in j])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.append(0, np.cumsum(sizes[j])[:-1]))
        for k in j[DEN * both >= NUM * (sizes[i] + sizes[j] - both)].tolist():
            a, b = find(labels[i]), find(labels[k])
            if a != b:
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def _compare(guests: DataFrame, docs: DataFrame, count: int) -> DataFrame:
    """(label, merged) for all groups of ``guests``: registers are compared first, then the whole sets that have a candidate."""
    first = guests.select("grp", "node", "key", "family", "label", F.col("side").cast("long").alias("side"), "n", "registers")
    left = scratch.write(first.groupBy("grp").applyInArrow(_filter, _LEFT), "hmh-candidates", count)
    # sets are made where the texts are read, and travel once
    names = left.select("grp", "node", "key")
    if left.count() <= BROADCAST:
        names = F.broadcast(names)
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(names, "node").select("grp", "node", "key", "text")
    whole = texts.mapInArrow(_whole, "grp long, node long, key binary, tokens binary")
    found = left.groupBy("grp").cogroup(whole.groupBy("grp")).applyInArrow(_verify, "label long, merged long")
    return scratch.write(found, "hmh-links", count)


def _relabel(labels: DataFrame, merged: DataFrame, count: int) -> DataFrame:
    out = labels.join(merged, "label", "left").withColumn("label", F.coalesce("merged", "label")).select(*labels.columns)
    return scratch.write(out, "hmh-labels", count)


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, node, low) for the bands of several nodes, with the least of them."""
    index = scratch.write(nodes.select("node", "registers").mapInArrow(_index, "band long, node long"), "hmh-bands")
    low = index.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return scratch.write(index.join(low.select("band", "low"), "band"), "hmh-shared")


def _families(index: DataFrame) -> DataFrame:
    """(node, family) for the nodes that share a band with another one."""
    found = components(index.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    return scratch.write(found.select(F.col("id").alias("node"), F.col("comp").alias("family")), "hmh-families")


def link_components(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, label) for the nodes (node, key, n, registers) that may link; a label is the least node of its component."""
    index = _shared_bands(nodes)
    family = _families(index)
    count = family.count()
    if not count:
        return family.withColumnRenamed("family", "label")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    placed = nodes.select("node", "key", "n", "registers").join(family.join(sizes, "family"), "node")
    placed = scratch.write(placed, "hmh-placed", count)
    shared = F.pmod(F.xxhash64("family"), F.lit(-(-count // SHARED)))
    dealt = F.xxhash64("family", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)))
    guests = placed.withColumn("grp", F.when(F.col("m") > SHARED, dealt).otherwise(shared)).withColumn("side", F.lit(3))
    merged = _compare(guests.withColumn("label", F.col("node")), docs, count)
    labels = _relabel(placed.select("node", "family", "m", F.col("node").alias("label")), merged, count)
    large = labels.where(F.col("m") > BLOCK)
    if large.isEmpty():
        return labels.select("node", "label")
    joined = _join_blocks(large.select("node", "family", "label"), placed, docs, index, count)
    return labels.where(F.col("m") <= BLOCK).select("node", "label").unionByName(joined.select("node", "label"))


def _join_blocks(large: DataFrame, placed: DataFrame, docs: DataFrame, index: DataFrame, count: int) -> DataFrame:
    """Families of several blocks (node, family, label), with the labels that links between blocks give."""
    sketches = placed.select("node", "key", "n", "registers")
    step = 0
    while True:
        step += 1
        alone = large.where("node = label")
        counts = scratch.write(alone.groupBy("family").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "hmh-counts")
        grp = F.xxhash64("family", F.pmod(F.xxhash64("node", F.lit(step)), F.ceil(F.col("k") / BLOCK)))
        guests = alone.join(counts, "family").withColumn("grp", grp).withColumn("side", F.lit(3))
        merged = _compare(guests.join(sketches, "node"), docs, count)
        large = _relabel(large, merged, count)
        if merged.count() <= GOES_ON * (counts.agg(F.sum("k")).first()[0] or 0):
            break
    merged = _compare(_mixed_bands(large, index).join(sketches, "node"), docs, count)
    if merged.isEmpty():
        return large
    joined = components(merged.select(F.col("label").alias("a"), F.col("merged").alias("b")))
    return _relabel(large, joined.select(F.col("id").alias("label"), F.col("comp").alias("merged")), count)


def _mixed_bands(large: DataFrame, index: DataFrame) -> DataFrame:
    """The nodes of each band that has several components, as guests of one group or, by blocks, of a group for each two."""
    members = scratch.write(index.select("band", "node").join(large, "node"), "hmh-members")
    mixed = members.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    blocks = F.ceil(F.col("k") / BLOCK).cast("long")
    members = members.join(mixed.select("band", blocks.alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("node", F.lit(-1)), "blocks"))
    # a block meets itself and every other one of its band
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    guests = members.withColumn("other", other)
    side = F.when(F.col("other") == F.col("block"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2)
    grp = F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))
    return guests.select("node", "family", "label", grp.alias("grp"), side.alias("side"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, key binary, registers binary"
    sketches = scratch.write(docs.mapInArrow(_sketches, schema), "hmh-docs")
    some = sketches.where("doc_id is not null and key is not null")
    facts = F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n")
    nodes = scratch.write(some.groupBy("key").agg(*facts), "hmh-nodes")
    # a set's registers come once from each task; one of them is as good as the other
    once = sketches.where("registers is not null").groupBy("key").agg(F.first("registers").alias("registers"))
    drawn = scratch.write(nodes.join(once, "key"), "hmh-sketched")
    labels = link_components(drawn, docs)
    known = nodes.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node"))
    found = known.where("copies > 1 or component_id <> node").select(F.col("key").alias("_key"), "component_id")
    out = sketches.select("doc_id", "n_shingles", "key").join(found.distinct(), F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [hash(array_to_string(w, ' '))]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(array_to_string(w[i:i + 2], ' ')))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT a, a FROM b UNION SELECT b.b, r.c FROM r JOIN b ON r.doc_id = b.a WHERE r.c < b.b),
g AS (SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.c), n.doc_id)) AS component_id
      FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM g
"""
