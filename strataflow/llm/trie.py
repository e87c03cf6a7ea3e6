"""The prefix trie of conversations, in pieces of bounded size.

Turns are digested where they are read; only digests and lengths travel. A conversation is rebuilt from the
first turns of another one and its own later turns, equal ones become one path with a count, and paths are
dealt out by the digest of their first turn. Where more turns than ``LIMIT`` share a first turn, its paths are
dealt again by the next turn in which they differ, and so on; the nodes above such a cut, a chain up to the one before
it, are upper nodes. A task puts the paths of its
first turns (or cut prefixes) into pointer tries, nodes with a dictionary of children, and sums them up in an
iterative postorder. Upper nodes, of which there are few, get the sums of their children level by level, from the
deepest up to the root.

The ids of conversations that end in one node are sorted by ranges, joined to texts of some thousand ids, and
hashed in order by a task that holds one such text at a time, so that a node in which a third of all conversations
end is read as a stream.

Defined cases: rows with null conv_id take no part; turns go by number, null first, and equal numbers by the
digest of role and text; a repeated row is a turn of its own; null roles and texts are empty ones; a conversation
without turns ends in the root; an empty table gives no rows, not even a root; other columns are ignored. A
conversation is one row of 24 bytes a turn; a single path is never cut, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm import scratch

#: Fixed by the task: conversations that share their first turns with the first of them; turns shared at most.
STEP, SHARED = 5, 9
#: Turns of a task's tries, beyond which prefixes are cut; ids of a text that is hashed at once.
LIMIT = 200_000
IDS = 2_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ENDS = pa.schema([("path_id", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("path_id", pa.string()), ("ends_sha256", pa.string())])
_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, above string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _digest(parts: Column) -> Column:
    """A name for an array of digests."""
    return F.md5(F.array_join(F.transform(parts, F.hex), ""))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path_id, path, bytes): the digests and the lengths of the rebuilt turns of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        (F.col("conv_id") - F.col("conv_id") % STEP).cast("long").alias("base"),
        F.struct("turn", digest.alias("d"), F.octet_length(text).cast("long").alias("b")).alias("t"),
    )
    # one shuffle by the shared conversation serves the grouping and the join
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = own.where("conv_id = base").select("base", F.slice("own", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    both = own.join(head, "base", "left").withColumn("h", h)
    none = F.slice("own", 1, 0)
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    out = both.withColumn("whole", whole).select("conv_id", F.transform("whole", lambda t: t["d"]).alias("path"), F.transform("whole", lambda t: t["b"]).alias("bytes"))
    return out.select("conv_id", _digest(F.col("path")).alias("path_id"), "path", "bytes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path_id, conv_id) as texts of up to ``IDS`` ids of one path."""
    path, ids = None, []
    rows: list[tuple] = []

    def flush() -> None:
        if ids:
            rows.append((path, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for p, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if p != path or len(ids) == IDS:
                flush()
                path, ids = p, []
            ids.append(c)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_ENDS.names, r, strict=True)) for r in rows], schema=_ENDS)
            rows.clear()
    flush()
    yield pa.RecordBatch.from_pylist([dict(zip(_ENDS.names, r, strict=True)) for r in rows], schema=_ENDS)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each path's ids from its texts in order."""
    path, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p == path:
                state.update(b",")
            else:
                if path is not None:
                    done.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(_HASHES.names, r, strict=True)) for r in done], schema=_HASHES)
    if path is not None:
        yield pa.RecordBatch.from_pylist([{"path_id": path, "ends_sha256": state.hexdigest()}], schema=_HASHES)


def ends(convs: DataFrame) -> DataFrame:
    """(path_id, ends_sha256): the hash of the ascending ids of each path's conversations."""
    ids = convs.select("path_id", "conv_id")
    runs = ids.repartitionByRange("path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    runs = runs.mapInArrow(_runs, "path_id string, first long, ids string")
    runs = runs.repartition("path_id").sortWithinPartitions("path_id", "first").select("path_id", "ids")
    return runs.mapInArrow(_hash_runs, "path_id string, ends_sha256 string")


class Trie:
    """A pointer trie: nodes are numbered, each with a dictionary from a turn's digest to a child."""

    def __init__(self) -> None:
        self.children: list[dict[bytes, int]] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.bytes: list[int] = []
        self.conv: list[int] = []
        self.count: list[int] = []
        self.ends: list[str] = []

    def node(self, parent: int, depth: int, length: int) -> int:
        for column, value in ((self.children, {}), (self.parent, parent), (self.depth, depth), (self.bytes, length), (self.conv, None), (self.count, 0), (self.ends, NO_ENDS)):
            column.append(value)
        return len(self.parent) - 1

    def add(self, at: int, path: list[bytes], lengths: list[int], conv: int, count: int, hashed: str) -> None:
        """Put a path below node ``at``, which stands for its first turns."""
        for depth in range(self.depth[at], len(path) + 1):
            if depth > self.depth[at]:
                child = self.children[at].get(path[depth - 1])
                if child is None:
                    child = self.children[at][path[depth - 1]] = self.node(at, depth, lengths[depth - 1])
                at = child
            self.count[at] += count
            self.conv[at] = conv if self.conv[at] is None else min(conv, self.conv[at])
        self.ends[at] = hashed

    def sums(self, top: int) -> Iterator[tuple[int, int, int]]:
        """(node, leaves, saved) of a subtree, children before parents."""
        leaves, saved, stack = {}, {}, [(top, False)]
        while stack:
            at, seen = stack.pop()
            if not seen:
                stack.append((at, True))
                stack.extend((child, False) for child in self.children[at].values())
                continue
            below = self.children[at].values()
            leaves[at] = sum(leaves.pop(c) for c in below) if below else 1
            saved[at] = sum(saved.pop(c) for c in below) + (self.count[at] - 1) * self.bytes[at]
            yield at, leaves[at], saved[at]


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes below the cuts of one task; ``above`` is the upper node that a top hangs on."""
    trie, tops = Trie(), {}
    cols = (rows[c] for c in ("key", "above", "cut", "path", "bytes", "conv", "n", "ends_sha256"))
    for key, above, cut, path, lengths, conv, n, hashed in zip(*cols, strict=True):
        if key not in tops:
            tops[key] = trie.node(-1, int(cut), int(lengths[cut - 1])), above
        trie.add(tops[key][0], list(path), [int(v) for v in lengths], int(conv), int(n), hashed)
    out = []
    for top, above in tops.values():
        for at, leaves, saved in trie.sums(top):
            parent = trie.parent[at]
            out.append((trie.conv[at], trie.depth[at], trie.conv[parent] if parent >= 0 else None, trie.count[at], len(trie.children[at]), leaves, saved, trie.ends[at], above if at == top else None))
    frame = pd.DataFrame(out, columns=[*COLUMNS, "above"])
    frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
    return frame


def _upper(rows: DataFrame) -> DataFrame:
    """Chains of upper nodes from depth ``cut`` to ``last``, with what their paths say of them; ``bottom`` is what hangs on the last."""
    own = F.when(F.col("cut") > 0, F.expr("slice(bytes, cut, last - cut + 1)")).otherwise(F.array(F.lit(0).cast("long")))
    return rows.groupBy("key").agg(
        F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("above").alias("above"), F.first("cut").alias("cut"),
        F.first(own).alias("lengths"), F.first(_digest(F.expr("slice(path, 1, last)"))).alias("bottom"),
        F.coalesce(F.max(F.when(F.size("path") == F.col("last"), F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256"),
    )


#: The turns that the least and the greatest path of a group share, and so all of its paths.
_COMMON = "aggregate(sequence(1, least(size(lo), size(hi))), 0, (k, i) -> IF(k = i - 1 AND element_at(lo, i) = element_at(hi, i), i, k))"


def _cut(paths: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(paths with the prefix they are dealt by, in several tables; upper nodes from the root down)."""
    root = paths.withColumns({"key": _digest(F.slice("path", 1, 0)), "above": F.lit(None).cast("string"), "cut": F.lit(0), "last": F.lit(0)})
    uppers, dealt = [scratch.write(_upper(root), "trie-upper")], []
    rest = root
    while True:
        rest = rest.where(F.size("path") > F.col("last")).withColumn("above", _digest(F.expr("slice(path, 1, last)"))).withColumn("cut", F.col("last") + 1)
        rest = scratch.write(rest.drop("last").withColumn("key", _digest(F.expr("slice(path, 1, cut)"))), "trie-paths")
        facts = F.sum(F.size("path")).alias("turns"), F.count(F.lit(1)).alias("k"), F.min("path").alias("lo"), F.max("path").alias("hi")
        big = rest.groupBy("key").agg(*facts).where((F.col("turns") > limit) & (F.col("k") > 1))
        big = scratch.write(big.select("key", F.expr(_COMMON).alias("last")), "trie-big")
        if big.isEmpty():
            return [*dealt, rest], uppers
        dealt.append(rest.join(big, "key", "left_anti"))
        rest = rest.join(big, "key")
        uppers.append(scratch.write(_upper(rest), "trie-upper"))


def _summed(uppers: list[DataFrame], tops: DataFrame) -> list[DataFrame]:
    """Chains of upper nodes with the sums of the children of their last one, from the deepest cut up."""
    facts = F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    below = scratch.write(tops.withColumn("n_children", F.lit(1)).groupBy("above").agg(*facts), "trie-tops")
    out = []
    for level in reversed(uppers):
        children = below
        if out:
            own = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.expr("aggregate(lengths, 0L, (a, b) -> a + b)")
            chain = out[-1].select("above", F.lit(1).alias("n_children"), "n_leaves", own.alias("saved_tokens"))
            children = below.unionByName(chain).groupBy("above").agg(*facts)
        joined = level.join(children.withColumnRenamed("above", "bottom"), "bottom", "left")
        whole = {"n_children": 0, "n_leaves": 1, "saved_tokens": 0}
        out.append(scratch.write(joined.withColumns({c: F.coalesce(c, F.lit(v)).cast("long") for c, v in whole.items()}), "trie-level"))
    return out


def _chains(upper: DataFrame) -> DataFrame:
    """A row for each node of the chains; ``above`` is set for the first ones only."""
    rows = upper.withColumn("i", F.explode(F.expr("sequence(0, size(lengths) - 1)")))
    last = F.col("i") == F.size("lengths") - 1
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.expr("aggregate(slice(lengths, i + 1, size(lengths)), 0L, (a, b) -> a + b)")
    return rows.select(
        "conv_id", (F.col("cut") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") > 0, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"), F.when(F.col("i") == 0, F.col("above")).alias("above"),
    )


def prefixes(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = scratch.write(rebuilt(conversations), "trie-convs")
    facts = F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("path").alias("path"), F.first("bytes").alias("bytes")
    paths = scratch.write(convs.groupBy("path_id").agg(*facts).join(ends(convs), "path_id"), "trie-distinct")
    dealt, uppers = _cut(paths, limit)
    turns = paths.agg(F.sum(F.size("path"))).first()[0] or 0
    tasks = max(1, -(-2 * turns // limit))
    columns = ["key", "above", "cut", "path", "bytes", "conv", "n", "ends_sha256"]
    rows = dealt[0].select(*columns)
    for more in dealt[1:]:
        rows = rows.unionByName(more.select(*columns))
    grouped = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"))
    nodes = scratch.write(grouped.applyInPandas(_tries, _NODES), "trie-nodes")
    levels = _summed(uppers, nodes.where("above is not null"))
    upper = levels[0]
    for more in levels[1:]:
        upper = upper.unionByName(more)
    parents = upper.select(F.col("bottom").alias("above"), F.col("conv_id").alias("parent"))
    every = nodes.unionByName(_chains(upper))
    hung = every.where("above is not null").drop("parent_conv_id").join(parents, "above").withColumnRenamed("parent", "parent_conv_id")
    return every.where("above is null").select(*COLUMNS).unionByName(hung.select(*COLUMNS))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(b ORDER BY turn NULLS FIRST, d) AS bs,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9 AS h
      FROM t GROUP BY conv_id),
r AS (SELECT o.conv_id, coalesce(p.ds, [])[1:o.h] || o.ds[o.h + 1:] AS ds, coalesce(p.bs, [])[1:o.h] || o.bs[o.h + 1:] AS bs FROM o LEFT JOIN o p ON p.conv_id = o.conv_id - o.conv_id % 5),
m AS (SELECT conv_id, unnest(range(0, len(ds) + 1)) AS d, ds, bs FROM r),
n AS (SELECT d, array_to_string(ds[1:d], '') AS k, array_to_string(ds[1:greatest(d - 1, 0)], '') AS pk, any_value(ds[1:d]) AS ds, min(conv_id) AS conv_id, count(*) AS n,
        coalesce(any_value(CASE WHEN d > 0 THEN bs[d] END), 0) AS b, coalesce(string_agg(CASE WHEN len(ds) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS e
      FROM m GROUP BY ALL),
c AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY pk),
f AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
s AS (SELECT k, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT array_to_string(ds[1:unnest(range(0, d + 1))], '') AS k, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n - 1) * b AS saved FROM f) GROUP BY k)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.e) AS ends_sha256
FROM f JOIN s USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.pk
"""
