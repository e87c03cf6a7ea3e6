"""Packing documents into training sequences by harmonic classes.

A document is its token ids and a closing id. Whole sequences are cut from its front; its rest, shorter than a
sequence, stays one piece. A piece of length n belongs to the class k = floor(capacity / n), that of the lengths
in (capacity / (k + 1), capacity / k], and a bin of class k holds exactly k such pieces, so that a bin needs
a counter and nothing else. The room that a full bin leaves, less than 1 / (k + 1) of it, is filled with a cut
from the front of one more rest, the filler, which goes on into the next bins until it is used up; the next
rest that comes then takes its place. So a document costs hardly more than one piece beside its whole
sequences. Every task fills its own bins, without looking at those of others; a sequence's id holds its task's
number. Pieces of bins that a task leaves part-filled are laid end to end and cut at sequence ends; what
remains is cut into powers of two, which need no padding.

Tasks hold one Arrow batch and at most k pieces of each class below capacity; results depend on the rows of a
task only, so a lost task is simply run again.

Defined cases: a null text is an empty one; an empty document is the closing id alone; a very long text is encoded
whole, by one task; equal rows are packed once each; an empty table gives no rows; other columns of the input are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_ID = 0

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int, padded_to int"
)


def default_paths() -> tuple[str, str]:
    """The tokenizer's file and, for speed, the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids by ``tokenizers``; texts without special tokens go through the equal but faster ranks, if given."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        import json

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.fast = None
        if ranks_path is not None:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Bins:
    """The open bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, task: int, capacity: int = CAPACITY, with_ids: bool = False):
        self.next, self.capacity, self.with_ids = task << 36, capacity, with_ids
        self.open: dict[int, list[tuple]] = {}
        #: Bins with all their pieces and room left, until a filler comes; the filler that is being used up.
        self.waiting: list[tuple[int, list[tuple]]] = []
        self.filler: tuple | None = None
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document: whole sequences, then its rest."""
        rest = len(ids) - len(ids) % self.capacity
        for start in range(0, rest, self.capacity):
            self._close(1, [(doc_id, start, ids[start : start + self.capacity].copy(), len(ids))])
        if rest == len(ids):
            return
        piece = (doc_id, rest, ids[rest:].copy(), len(ids))
        if self.waiting and self.filler is None:
            self.filler = piece
            self._fill()
            return
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.waiting.append((k, self.open.pop(k)))
            self._fill()

    def _fill(self) -> None:
        """Close waiting bins, with cuts from the filler where they have room."""
        while self.waiting:
            k, pieces = self.waiting[-1]
            room = self.capacity - sum(len(p[2]) for p in pieces)
            if room and self.filler is None:
                return
            if room:
                doc_id, start, ids, doc_tokens = self.filler
                pieces.append((doc_id, start, ids[:room], doc_tokens))
                self.filler = (doc_id, start + room, ids[room:], doc_tokens) if room < len(ids) else None
                room -= len(pieces[-1][2])
            if not room:
                self.waiting.pop()
                self._close(k, pieces)

    def _close(self, k: int, pieces: list[tuple]) -> None:
        at, full = 0, sum(len(p[2]) for p in pieces)
        padded = full if full & (full - 1) == 0 else self.capacity
        for doc_id, start, ids, doc_tokens in pieces:
            row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next, at, k, padded)
            self.rows.append(row + (ids,) if self.with_ids else row)
            at += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Lay the pieces of open bins end to end; the last, part-filled sequence goes out in powers of two."""
        held = [*self.open.values(), *(pieces for _, pieces in self.waiting), [self.filler] if self.filler else []]
        left = sorted((p for pieces in held for p in pieces), key=lambda p: -len(p[2]))
        self.open, self.waiting, self.filler = {}, [], None
        total = sum(len(p[2]) for p in left)
        whole, rest = divmod(total, self.capacity)
        sizes = [self.capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        queue = left[::-1]
        for size in sizes:
            pieces = []
            while size:
                doc_id, start, ids, doc_tokens = queue.pop()
                taken = min(size, len(ids))
                pieces.append((doc_id, start, ids[:taken], doc_tokens))
                if taken < len(ids):
                    queue.append((doc_id, start + taken, ids[taken:], doc_tokens))
                size -= taken
            self._close(0, pieces)


def pack(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``class`` is 0 where a sequence was filled from leftovers, ``ids`` comes on request."""
    if tokenizer_path is None:
        tokenizer_path, ranks_path = default_paths()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class", pa.int32()), ("padded_to", pa.int32())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    arrow = pa.schema(fields)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
        if with_ids and rows:
            cols[-1] = [x.tolist() for x in cols[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bins = None, Bins(TaskContext.get().partitionId(), with_ids=with_ids)
        for batch in batches:
            encoder = encoder or Encoder(tokenizer_path, ranks_path)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bins.add(doc_id, np.array([*encoder.ids(text.as_py() or ""), END_ID], dtype="<u4"))
                if len(bins.rows) >= 20_000:
                    yield out(bins.rows)
                    bins.rows = []
        bins.finish()
        yield out(bins.rows)

    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
