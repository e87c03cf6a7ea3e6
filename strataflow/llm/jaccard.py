"""N-gram Jaccard join by prefix filters under several global token orders.

Texts become sets of hashed 5-word shingles. Two sets with a Jaccard similarity of at least t share a
token among the first ``n - ceil(t * n) + 1`` of each, under any order of all tokens. The orders used
here put rare tokens first, by three grades of document frequency and three hashes, so that passages
that many documents share are rarely in a prefix. A pair is a candidate only if its prefixes meet under
every order; then its exact overlap is counted.

Frequencies: each task sums the tokens of a chunk of documents and sends every distinct one, once, to the
task that owns its hash range, and gets back which occur in more than one document, with the count; where
else a token stands in the chunk stays with the chunk. A token that all documents have thus makes one
entry for each chunk. Tokens of one document can't be shared, so only the others are ever indexed;
documents that have none of them in their prefix are done. A token is a hash of 56 bits, all of which travel
(its part and six bytes beside it): two different shingles are taken for one in a comparison of two sets of
400 once in 4e11 comparisons.

Components: equal sets are one node. Nodes of a first-order prefix token form a bucket, and nodes that buckets
connect a family; only nodes of one family can link. Families are cut into blocks of at most ``BLOCK`` nodes
(small families share one). A block is compared in two steps: first only the prefixes of the three orders
travel, and their filters are intersected; then the whole sets of the nodes that still have a candidate
there follow, for the exact overlaps. Families of several blocks go on with one node for each component
found so far, dealt into blocks again, until nothing more joins: the number of nodes falls by up to the
size of a block each time. Last, blocks of different components that share a prefix token meet, again
prefixes first. Pairs of one component need no comparison; no link that would join two is missed. A family
that holds a third of all rows is thus many blocks in many tasks, and never all pairs.

Defined cases: null or empty texts have an empty set and link with nothing; rows with a null doc_id come back
with a null component; equal texts are in one component; repeated rows come back as often as they came in;
very long texts are hashed piece by piece and counted whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm import hashing, scratch
from strataflow.llm.components import components

#: Fixed by the task: words of a shingle; similarity of at least NUM / DEN.
WORDS = 5
NUM, DEN = 75, 100
#: Tokens that one task counts together, and that one chunk of documents sends; about 60 bytes each in memory.
TOKENS_PER_PART = 300_000
TOKENS_PER_CHUNK = 500_000
#: Bytes of a token; documents of a chunk at most; parts at least, so that what a token is beside its part fits into a byte less.
WIDTH = 7
DOCS_PER_CHUNK = 65_535
LEAST_PARTS = 256
#: Nodes of a block; rounds of components' nodes at most before blocks of different components meet.
BLOCK = 64
ROUNDS = 6
#: Columns of a block's token matrix that are multiplied at once.
COLUMNS = 16_384
ORDERS = 3
_SALTS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))

_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])
_SENT = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("more", pa.binary())])
_BACK = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("df", pa.binary())])
_DOCS = pa.schema([("node", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("heads", pa.binary()), ("tokens", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for run in _runs(texts):
            sets = hashing.shingle_sets(texts[run[0] : run[1]].to_pylist(), WORDS)
            rows = [ids[run[0] : run[1]], [len(s) for s in sets], [_node(s) if len(s) else None for s in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], schema=_SETS)
    hashing.release()


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about one piece of text each."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        held += n
        if held >= hashing.PIECE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _planes(x: np.ndarray, count: int) -> bytes:
    """Numbers below 256 ** count by their lowest bytes, then the next ones and so on, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :count].T).tobytes()


def _unplaned(raw: bytes, count: int) -> np.ndarray:
    out = np.zeros((len(raw) // count, 8), np.uint8)
    out[:, :count] = np.frombuffer(raw, np.uint8).reshape(count, -1).T
    return out.view("<u8").ravel()


def _sender(parts: int):
    """The distinct tokens of whole chunks of documents by part, with the first document of each."""
    p = np.uint64(parts)

    def messages(chunk: int, sets: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, doc = tokens[order], doc[order]
        new = np.ones(len(tokens), bool)
        np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
        # where else in the chunk a token stands goes with the chunk
        again = tokens[~new].astype("<u8").tobytes() + doc[~new].astype("<u4").tobytes()
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(tokens))
        tokens, doc = tokens[first], doc[first]
        part = tokens % p
        order = np.lexsort((doc, part))
        tokens, doc, part, count = tokens[order] // p, doc[order].astype(np.int64), part[order], count[order]
        edges = np.flatnonzero(np.diff(part, prepend=part[0] + np.uint64(1)))
        rows = [], [], [], [], []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
            many = np.flatnonzero(count[a:b] > 1)
            more = np.concatenate([many, count[a:b][many]]).astype("<u4").tobytes()
            for col, x in zip(rows, (int(part[a]), chunk, _planes(tokens[a:b], WIDTH - 1), _planes(np.diff(doc[a:b], prepend=0), 2), more), strict=True):
                col.append(x)
        # what the chunk's documents are, to be met again when the counts come back
        for col, x in zip(rows, (-1 - chunk % parts, chunk, np.array(nodes, "<i8").tobytes(), sizes.astype("<i8").tobytes(), again), strict=True):
            col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _SENT, strict=True)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, sets, nodes = TaskContext.get().partitionId() << 32, 0, [], []
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0)
            for a, b in _runs(texts):
                for s in hashing.shingle_sets(texts[a:b].to_pylist(), WORDS):
                    if not len(s) or (node := _node(s)) in seen:
                        continue
                    seen.add(node)
                    sets.append(s >> np.uint64(64 - 8 * WIDTH))
                    nodes.append(node)
                    held += len(s)
                    if held >= TOKENS_PER_CHUNK or len(sets) >= DOCS_PER_CHUNK:
                        yield from messages(chunk, sets, nodes)
                        chunk, held, sets, nodes = chunk + 1, 0, [], []
                        seen.clear()
        if sets:
            yield from messages(chunk, sets, nodes)
        del sets, nodes
        hashing.release()

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one part, the tokens that several documents have, sent back to the chunks they came from."""
    table = table.combine_chunks()
    if table.column("part")[0].as_py() < 0:
        return pa.table([table.column(x) for x in ("part", "chunk", "tokens", "docs", "more")], schema=_BACK)
    tokens = [_unplaned(x, WIDTH - 1) for x in table.column("tokens").to_pylist()]
    sizes = np.array([len(x) for x in tokens])
    ends = np.cumsum(sizes)
    count = np.ones(int(ends[-1]), np.int64)
    for start, more in zip((ends - sizes).tolist(), table.column("more").to_pylist(), strict=True):
        at, n = np.frombuffer(more, "<u4").reshape(2, -1)
        count[start + at.astype(np.int64)] = n
    tokens = np.concatenate(tokens)
    _, inverse = np.unique(tokens, return_inverse=True)
    df = np.bincount(inverse, count).astype(np.int64)[inverse]
    del inverse, count
    rows = [], [], [], [], []
    for part, chunk, docs, a, b in zip(table.column("part").to_pylist(), table.column("chunk").to_pylist(), table.column("docs").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        keep = df[a:b] > 1
        if keep.any():
            doc = np.cumsum(_unplaned(docs, 2).astype(np.int64))[keep]
            for col, x in zip(rows, (part, chunk, _planes(tokens[a:b][keep], WIDTH - 1), _planes(np.diff(doc, prepend=0), 2), _planes(df[a:b][keep], 6)), strict=True):
                col.append(x)
    return pa.table([pa.array(c, t.type) for c, t in zip(rows, _BACK, strict=True)], schema=_BACK)


def _grades(df: np.ndarray) -> tuple[np.ndarray, ...]:
    """The document frequency as each order grades it."""
    log = np.frexp(df.astype(np.float64))[1].astype(np.int64)
    return df.astype(np.int64), log, (log + 2) // 3


def _prefixes(parts: int):
    """Of one chunk, the documents with a shared token in their prefix: prefixes of all orders, then all shared tokens."""

    def run(table: pa.Table) -> pa.Table:
        nodes = sizes = again = None
        docs, tokens, df = [], [], []
        for part, t, d, f in zip(*(table.column(x).to_pylist() for x in ("part", "tokens", "docs", "df")), strict=True):
            if part < 0:
                nodes, sizes = np.frombuffer(t, "<i8"), np.frombuffer(d, "<i8")
                again = np.frombuffer(f[: len(f) // 3 * 2], "<u8"), np.frombuffer(f[len(f) // 3 * 2 :], "<u4")
            else:
                docs.append(np.cumsum(_unplaned(d, 2).astype(np.int64)))
                tokens.append(_unplaned(t, WIDTH - 1) * np.uint64(parts) + np.uint64(part))
                df.append(_unplaned(f, 6).astype(np.int64))
        rows = [], [], [], [], [], []
        chunk = table.column("chunk")[0].as_py()
        if docs:
            doc, tok, freq = np.concatenate(docs), np.concatenate(tokens), np.concatenate(df)
            order = np.argsort(tok)
            more = freq[order[np.searchsorted(tok, again[0], sorter=order)]]
            doc, tok, freq = np.concatenate([doc, again[1]]), np.concatenate([tok, again[0]]), np.concatenate([freq, more])
            order = np.lexsort((tok, doc))
            doc, tok, freq = doc[order], tok[order], freq[order]
            edges = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)], strict=True):
                n = int(sizes[doc[a]])
                ones = n - (b - a)
                first = prefix_length(n) - ones
                if first <= 0:
                    continue
                bits = np.zeros(b - a, np.uint8)
                for k, grade in enumerate(_grades(freq[a:b])):
                    bits[np.lexsort((hashing.mix(tok[a:b] ^ _SALTS[k]), grade))[:first]] |= np.uint8(1 << k)
                keys = tok[a:b][(bits & 1) > 0].view(np.int64)
                for col, x in zip(rows, (int(nodes[doc[a]]), chunk, n, keys, heads(tok[a:b], bits), _planes(tok[a:b], WIDTH)), strict=True):
                    col.append(x)
        return pa.table([pa.array(c, t.type) for c, t in zip(rows, _DOCS, strict=True)], schema=_DOCS)

    return run


def heads(tokens: np.ndarray, bits: np.ndarray) -> bytes:
    """The tokens of any order's prefix, by half of their bits, then the orders of each; enough to rule pairs out."""
    on = bits > 0
    return (tokens[on] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + bits[on].tobytes()


def _meets(owner: np.ndarray, tokens: np.ndarray, m: int) -> np.ndarray:
    """How many tokens each two of m nodes have in common; ``owner`` says whose a token is."""
    _, col, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    owner, col = owner[shared], col[shared]
    total = np.zeros((m, m))
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        width = int(col[-1]) + 1
        for lo in range(0, width, COLUMNS):
            a, b = np.searchsorted(col, (lo, lo + COLUMNS))
            part = np.zeros((m, min(COLUMNS, width - lo)), np.float32)
            part[owner[a:b], col[a:b] - lo] = 1
            total += part @ part.T
    return total


def _candidates(allowed: np.ndarray, n: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """The pairs of a block that are allowed, are near enough in size and meet in the prefixes of every order."""
    m = len(n)
    pairs = np.triu(allowed & (n[:, None] * NUM <= n[None, :] * DEN) & (n[None, :] * NUM <= n[:, None] * DEN), 1)
    if pairs.any():
        owner = np.repeat(np.arange(m), [len(x) // 5 for x in raw])
        tokens = np.concatenate([np.frombuffer(x[: len(x) // 5 * 4], "<u4") for x in raw])
        bits = np.concatenate([np.frombuffer(x[len(x) // 5 * 4 :], np.uint8) for x in raw])
        for k in range(ORDERS):
            on = (bits & (1 << k)) > 0
            pairs &= _meets(owner[on], tokens[on], m) > 0
    return pairs


def _links(pairs: np.ndarray, n: np.ndarray, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the candidate pairs whose sets are similar enough."""
    both = _meets(np.repeat(np.arange(len(n)), [len(x) for x in tokens]), np.concatenate(tokens), len(n))
    return np.nonzero(pairs & (DEN * both >= NUM * (n[:, None] + n[None, :] - both)))


def _merge(labels: list[int], links: tuple[np.ndarray, np.ndarray]) -> dict[int, int]:
    """Labels that links join, each with the least label of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for i, j in zip(*(x.tolist() for x in links), strict=True):
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def _allowed(table: pa.Table) -> np.ndarray:
    """Pairs of a block: of one family, not of one component, and of both sides."""
    family, label, side = (table.column(x).to_numpy() for x in ("family", "label", "side"))
    return (family[:, None] == family[None, :]) & (label[:, None] != label[None, :]) & ((side[:, None] | side[None, :]) == 3)


_LEFT = "grp long, node long, chunk long, label long, n long, place int, mates binary"


def _filter(table: pa.Table) -> pa.Table:
    """The guests of one block that have a candidate there, with their place in it and a bit for each place, set for candidates."""
    table = table.sort_by("node")
    pairs = _candidates(_allowed(table), table.column("n").to_numpy(), table.column("heads").to_pylist())
    on = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
    left = table.select(["grp", "node", "chunk", "label", "n"]).take(pa.array(on))
    mates = [row.tobytes() for row in np.packbits(pairs[on], axis=1)]
    return left.append_column("place", pa.array(on, pa.int32())).append_column("mates", pa.array(mates, pa.binary()))


def _verify(table: pa.Table) -> pa.Table:
    """(label, merged) for the components that links of one block join."""
    place = table.column("place").to_numpy()
    mates = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in table.column("mates").to_pylist()]), axis=1)
    tokens = [_unplaned(x, WIDTH) for x in table.column("tokens").to_pylist()]
    links = _links(mates[:, place] > 0, table.column("n").to_numpy(), tokens)
    merged = [(a, b) for a, b in _merge(table.column("label").to_pylist(), links).items() if a != b]
    return pa.table({"label": pa.array([a for a, _ in merged], pa.int64()), "merged": pa.array([b for _, b in merged], pa.int64())})


#: Narrow rows that one row with prefixes weighs as much as, for the number of files.
_HEADS = 10


def _compare(guests: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """(label, merged) for all groups of ``guests``: prefixes are sent and intersected first, then the sets that are left."""
    first = guests.select("grp", "node", "chunk", "family", "label", F.col("side").cast("long").alias("side"), "n", "heads")
    left = scratch.write(first.groupBy("grp").applyInArrow(_filter, _LEFT), "jaccard-candidates", count * _HEADS)
    whole = left.join(sets.select("node", "chunk", "tokens"), ["node", "chunk"])
    return scratch.write(whole.groupBy("grp").applyInArrow(_verify, "label long, merged long"), "jaccard-links", count * _HEADS)


def _relabel(nodes: DataFrame, merged: DataFrame, count: int) -> DataFrame:
    """``nodes`` with the labels that ``merged`` (label, merged) gives them."""
    out = nodes.join(merged, "label", "left").withColumn("label", F.coalesce("merged", "label")).select(*nodes.columns)
    return scratch.write(out, "jaccard-labels", count)


def families(index: DataFrame) -> DataFrame:
    """(node, family) for the nodes of ``index`` (token, node) that share a token with another one."""
    low = index.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    edges = index.join(low.select("token", "low"), "token").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = components(edges)
    return scratch.write(found.select(F.col("id").alias("node"), F.col("comp").alias("family")), "jaccard-families")


def link_components(sets: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``sets`` that may link; nodes are in one component if links lead from one to the other.

    A label is the least node of its component, so that a node that is its own label stands for it.
    """
    index = scratch.write(sets.select("node", F.explode("keys").alias("token")), "jaccard-index")
    family = families(index)
    count = family.count()
    if not count:
        return family.withColumnRenamed("family", "label")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    # a set that several chunks sent is taken from one of them
    chosen = sets.groupBy("node").agg(F.min("chunk").alias("chunk"))
    nodes = family.join(sizes, "family").join(chosen, "node")
    nodes = nodes.join(sets.select("node", "chunk", "n", "heads"), ["node", "chunk"])
    nodes = scratch.write(nodes.select("node", "chunk", "family", "m", "n", "heads"), "jaccard-placed", count * _HEADS)
    shared = F.pmod(F.xxhash64("family"), F.lit(-(-count // BLOCK)))
    guests = nodes.withColumn("grp", F.when(F.col("m") > BLOCK, _block("m", 0)).otherwise(shared))
    merged = _compare(guests.withColumn("label", F.col("node")).withColumn("side", F.lit(3)), sets, count)
    labels = _relabel(nodes.select("node", "family", "m", F.col("node").alias("label")), merged, count)
    large = labels.where(F.col("m") > BLOCK)
    if not large.isEmpty():
        small = labels.where(F.col("m") <= BLOCK)
        large = _join_blocks(large.select("node", "family", "label"), nodes.where(F.col("m") > BLOCK), sets, index, count)
        labels = small.select("node", "label").unionByName(large.select("node", "label"))
    return labels.select("node", "label")


def _block(size: str, salt: int) -> Column:
    """The block of a node in a family of which ``size`` nodes are dealt."""
    return F.xxhash64("family", F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col(size) / BLOCK)))


def _join_blocks(large: DataFrame, nodes: DataFrame, sets: DataFrame, index: DataFrame, count: int) -> DataFrame:
    """Families of several blocks (node, family, label), with the labels that links between blocks give."""
    prefixes = nodes.select("node", "chunk", "n", "heads")
    for step in range(ROUNDS):
        alone = large.where("node = label")
        counts = alone.groupBy("family").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        guests = alone.join(counts, "family")
        guests = guests.withColumn("grp", _block("k", step + 1)).withColumn("side", F.lit(3))
        merged = _compare(guests.join(prefixes, "node"), sets, count)
        if merged.isEmpty():
            break
        large = _relabel(large, merged, count)
    merged = _compare(_last_meetings(large, index, count).join(prefixes, "node"), sets, count)
    if merged.isEmpty():
        return large
    joined = components(merged.select(F.col("label").alias("a"), F.col("merged").alias("b")))
    return _relabel(large, joined.select(F.col("id").alias("label"), F.col("comp").alias("merged")), count)


def _last_meetings(large: DataFrame, index: DataFrame, count: int) -> DataFrame:
    """Blocks of different components that have a prefix token in common, as guests of a group for each two."""
    by_label = large.groupBy("family", "label").agg(F.count(F.lit(1)).alias("k"))
    top = by_label.groupBy("family").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.sum("k").alias("all"), F.max("k").alias("most"))
    top = top.where("all > most")
    apart = F.col("label") != F.col("top")
    deal = F.ceil(F.when(apart, F.col("all") - F.col("most")).otherwise(F.col("most")) / BLOCK).cast("long")
    nodes = large.join(top, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit(-1)), deal) * 2 + apart.cast("long"))
    nodes = scratch.write(nodes.select("node", "family", "block", "label"), "jaccard-dealt", count)
    spans = nodes.join(index, "node").groupBy("family", "token", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    spans = scratch.write(spans, "jaccard-spans")
    mixed = spans.groupBy("family", "token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("family", "token")
    spans = spans.join(mixed, ["family", "token"])
    x = spans.select("family", "token", F.col("block").alias("x"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    y = spans.select("family", "token", F.col("block").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = x.join(y, ["family", "token"]).where((F.col("x") <= F.col("y")) & (F.least("lo1", "lo2") < F.greatest("hi1", "hi2")))
    meetings = pairs.select("family", "x", "y").distinct().withColumn("grp", F.xxhash64("family", "x", "y"))
    ends = F.array(F.struct(F.col("x").alias("block"), F.lit(1).alias("side")), F.struct(F.col("y").alias("block"), F.lit(2).alias("side")))
    sides = meetings.select("grp", "family", F.explode(ends).alias("s"))
    # a block that meets itself takes part once, on both sides
    sides = sides.groupBy("grp", "family", "s.block").agg(F.sum("s.side").alias("side"))
    return nodes.join(sides, ["family", "block"])


def _shared_sets(docs: DataFrame, tokens: int) -> DataFrame:
    """Sets with a shared token in their prefix: node, chunk, n, keys, heads, tokens; a node may come from several chunks."""
    parts = max(LEAST_PARTS, -(-tokens // TOKENS_PER_PART))
    sent = docs.select("text").mapInArrow(_sender(parts), _ddl(_SENT))
    back = sent.groupBy("part").applyInArrow(_count, _ddl(_BACK))
    return scratch.write(back.groupBy("chunk").applyInArrow(_prefixes(parts), _ddl(_DOCS)), "jaccard-nodes")


def _rows_and_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of each row, and (_node, component_id) of the nodes whose component has several rows."""
    rows = scratch.write(docs.mapInArrow(_sets, _ddl(_SETS)), "jaccard-docs")
    tokens = rows.agg(F.sum("n_shingles")).first()[0] or 0
    nodes = rows.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    labels = link_components(_shared_sets(docs, tokens))
    known = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = scratch.write(known, "jaccard-known")
    least = known.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size"))
    return rows, known.join(least.where("size > 1"), "label").select(F.col("node").alias("_node"), "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id."""
    rows, found = _rows_and_components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = rows.join(found, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least doc_id, with the columns of the input; of rows that repeat it, the first text.

    Rows without words link with nothing and stay; so do rows without doc_id.
    """
    cols = docs.columns
    marks = scratch.write(near_duplicates(docs), "jaccard-marks")
    drop = marks.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    drop = scratch.write(drop, "jaccard-drop")
    kept = docs.join(drop, docs["doc_id"] == drop["_id"], "left_anti").select(*[F.col(f"`{c}`") for c in cols])
    again = marks.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    again = scratch.write(again, "jaccard-again")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["_id"], "left_anti")
    repeated = kept.join(again, kept["doc_id"] == again["_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT a, a FROM b UNION SELECT b.b, r.c FROM r JOIN b ON r.doc_id = b.a WHERE r.c < b.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.c), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
