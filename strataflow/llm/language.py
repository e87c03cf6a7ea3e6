"""Language identification by a linear-chain conditional random field over the words of a text.

Every word gets a score for each language from hashed character n-grams (those at its ends are its affixes),
from its own identity and from a lexicon of words that one language has nearly for itself. Transitions
between the languages of neighbouring words are learned along with them, from sequences that splice runs of
different languages, as code-switched text does. Forward-backward gives every word's distribution over the
languages; a document's language is the one with the most words in expectation and its score that share.

The model is fitted on the driver on a bounded sample: about ``DOCS_PER_LANGUAGE`` documents of each language,
of at most ``MAX_CHARS`` characters, drawn by a hash of the id. It is a few megabytes whatever the data. All
texts are labelled whole, in one pass, a block of texts at a time; long sequences are split into stretches
whose transfer matrices are chained, which gives exactly what a walk along the sequence would.

Defined cases: null texts and texts without letters are ``und`` with score 0; so is everything if no labelled
row is left to learn from; very long texts are labelled whole, block by block, at a few dozen bytes of memory for
each byte of the longest text; ties go to the language first in code-point order; documents without id count as
id '' for the fold; repeated rows come back as often; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm import hashing

#: Fixed by the task: one fold in five is held out; what texts without letters get.
FOLDS = 5
UNKNOWN = "und"
#: Parameters of the sample and the fit.
DOCS_PER_LANGUAGE = 300
MAX_CHARS = 20_000
BITS = 17
GRAMS = (2, 3, 4)
STRETCH = 64
EPOCHS = 4
BATCH = 256
RATE = 0.5
DECAY = 1e-6
LEXICON_COUNT, LEXICON_SHARE = 5, 0.95
#: Share of its words that a document's language must hold for ``passing``; at 0 only documents without a language go.
MIN_SCORE = 0.0
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Words:
    """The distinct words of a block of texts with the bins of their n-grams."""

    def __init__(self, texts: list[str | None]):
        runs = hashing.Letters(texts)
        self.at = runs.at
        self.hash, first, self.index = np.unique(runs.hashes(), return_index=True, return_inverse=True)
        # words between marks: ^word$, one after another, with a zero byte between
        sizes = (runs.ends - runs.starts)[first]
        places = np.concatenate([[0], np.cumsum(sizes + 3)])
        self.starts, n = places[:-1], int(places[-1])
        flat = np.zeros(n + max(GRAMS), np.uint8)
        flat[self.starts], flat[self.starts + sizes + 1] = 94, 36
        offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat[np.repeat(self.starts + 1, sizes) + offset] = runs.b[np.repeat(runs.starts[first], sizes) + offset]
        self.n, self.bins = n, []
        shift = np.uint64(64 - BITS)
        wide = flat.astype(np.uint64)
        for k in GRAMS:
            g, whole = np.full(n, k, np.uint64), np.ones(n, bool)
            for j in range(k):
                part = wide[j : n + j]
                g = g << np.uint64(8) | part
                whole &= part > 0
            self.bins.append(np.where(whole, (hashing.mix(g) >> shift).astype(np.int64), 1 << BITS))
        self.own = (hashing.mix(self.hash ^ np.uint64(0xA5A5A5A5)) >> shift).astype(np.int64)
        self.scale = 1.0 / np.sqrt(sizes.astype(np.float64) + 1.0)
        self.word_of = np.repeat(np.arange(len(sizes)), sizes + 3)


class Model:
    """Weights of bins by language, lexicon and transitions."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages, self.k = languages, k
        self.grams = np.zeros(((1 << BITS) + 1, k), np.float32)
        self.own = np.zeros((1 << BITS, k), np.float32)
        self.lexicon, self.lexicon_language = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lexicon_weight = np.zeros(k)
        self.trans = np.zeros((k, k))

    def lexicon_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct words are in the lexicon, and of which language."""
        if not len(self.lexicon):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, words.hash), len(self.lexicon) - 1)
        hit = np.flatnonzero(self.lexicon[at] == words.hash)
        return hit, self.lexicon_language[at[hit]]

    def scores(self, words: Words) -> np.ndarray:
        """The emission score of every distinct word for every language."""
        if not len(words.hash):
            return np.zeros((0, self.k))
        total = sum(self.grams[b] for b in words.bins)
        out = np.add.reduceat(total, words.starts, axis=0) * words.scale[:, None] + self.own[words.own]
        hit, language = self.lexicon_of(words)
        out[hit, language] += self.lexicon_weight[language]
        return out.astype(np.float64)


def _normal(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def posteriors(emit: np.ndarray, at: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Distributions over languages by forward-backward, for the words of texts that begin at ``at``.

    ``emit`` holds a row of scores for each word. Texts are cut into stretches; the product of the matrices
    of each stretch carries messages over it, then all stretches are walked at once.
    """
    n, k = emit.shape
    sizes = np.diff(at)
    if not n:
        return np.zeros((0, k))
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    step, loose = np.exp(trans - trans.max()), np.ones((k, k))
    counts = -(-sizes // STRETCH)
    text_of = np.repeat(np.arange(len(sizes)), counts)
    rank = np.arange(len(text_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at[:-1][text_of] + rank * STRETCH
    length = np.minimum(STRETCH, at[1:][text_of] - start)
    m = len(start)
    first = rank == 0
    spot = np.minimum(start[:, None] + np.arange(STRETCH), n - 1)
    inside = np.arange(STRETCH) < length[:, None]
    x = e[spot]
    opening = np.where(first[:, None, None], loose, step)

    def matrix(t: int) -> np.ndarray:
        return opening if t == 0 else step

    prod = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(STRETCH):
        on = inside[:, t]
        if not on.any():
            break
        moved = _normal((prod @ matrix(t)) * x[:, t][:, None, :], (1, 2))
        prod = np.where(on[:, None, None], moved, prod)
    # messages at the ends of stretches, text by text
    into, out_of = np.ones((m, k)), np.ones((m, k))
    offsets = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    ranked = counts[order]
    for r in range(1, int(ranked[0]) if len(ranked) else 0):
        s = offsets[order[: np.searchsorted(-ranked, -r, side="left")]] + r
        into[s] = _normal((into[s - 1][:, None, :] @ prod[s - 1])[:, 0], (1,))
    for r in range((int(ranked[0]) if len(ranked) else 0) - 2, -1, -1):
        s = offsets[order[: np.searchsorted(-ranked, -(r + 1), side="left")]] + r
        out_of[s] = _normal((prod[s + 1] @ out_of[s + 1][:, :, None])[:, :, 0], (1,))
    alpha = np.empty((m, STRETCH, k))
    a = into
    for t in range(STRETCH):
        if not inside[:, t].any():
            break
        moved = _normal((a[:, None, :] @ matrix(t))[:, 0] * x[:, t], (1,))
        a = np.where(inside[:, t][:, None], moved, a)
        alpha[:, t] = a
    b = out_of
    result = np.zeros((n, k))
    for t in range(STRETCH - 1, -1, -1):
        on = np.flatnonzero(inside[:, t])
        if not len(on):
            continue
        result[start[on] + t] = _normal(alpha[on, t] * b[on], (1,))
        moved = _normal((matrix(t) @ (x[:, t] * b)[:, :, None])[:, :, 0] if t == 0 else (x[:, t] * b) @ step.T, (1,))
        b = np.where(inside[:, t][:, None], moved, b)
    return result


def marginals(emit: np.ndarray, at: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distributions over languages and expected transitions of short sequences, all walked at once."""
    n, k = emit.shape
    sizes = np.diff(at)
    m, longest = len(sizes), int(sizes.max(initial=0))
    p, expected = np.zeros((n, k)), np.zeros((k, k))
    if not n:
        return p, expected
    spot = np.minimum(at[:-1, None] + np.arange(longest), n - 1)
    inside = np.arange(longest) < sizes[:, None]
    x = np.exp(emit - emit.max(axis=1, keepdims=True))[spot]
    step = np.exp(trans - trans.max())
    alpha = np.empty((m, longest, k))
    alpha[:, 0] = _normal(x[:, 0], (1,))
    for t in range(1, longest):
        alpha[:, t] = _normal((alpha[:, t - 1] @ step) * x[:, t], (1,))
    beta = np.ones((m, k))
    for t in range(longest - 1, -1, -1):
        on = inside[:, t]
        p[spot[on, t]] = _normal(alpha[on, t] * beta[on], (1,))
        if t:
            after = x[on, t] * beta[on]
            expected += _normal(alpha[on, t - 1][:, :, None] * step * after[:, None, :], (1, 2)).sum(axis=0)
            beta[on] = _normal(after @ step.T, (1,))
    return p, expected


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Learn from labelled texts; the driver's part, on a bounded sample."""
    model = Model(sorted(set(labels)))
    k = model.k
    words = Words(texts)
    y = np.array([model.languages.index(x) for x in labels])
    y_word = np.repeat(y, np.diff(words.at))
    tally = np.zeros((len(words.hash), k))
    np.add.at(tally, (words.index, y_word), 1)
    total = tally.sum(axis=1)
    sure = (total >= LEXICON_COUNT) & (tally.max(axis=1) >= LEXICON_SHARE * total)
    model.lexicon, model.lexicon_language = words.hash[sure], tally[sure].argmax(axis=1)
    hit = np.full(len(words.hash), -1)
    hit[sure] = model.lexicon_language
    rng = np.random.default_rng(seed)
    # runs of one text each, spliced into sequences of a stretch, mostly of several languages
    runs = []
    for i, (a, b) in enumerate(zip(words.at[:-1], words.at[1:], strict=True)):
        while a < b:
            n = min(int(rng.integers(8, STRETCH)), b - a)
            runs.append((a, n, y[i]))
            a += n
    squares = [np.full_like(model.grams, 1e-3), np.full_like(model.own, 1e-3), np.full(k, 1e-3), np.full((k, k), 1e-3)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for lo in range(0, len(order), 2 * BATCH):
            seq_words, seq_y, bounds = [], [], [0]
            chosen = [runs[i] for i in order[lo : lo + 2 * BATCH]]
            for pair in zip(chosen[::2], chosen[1::2] or chosen[:1], strict=False):
                for a, n, language in pair:
                    seq_words.append(words.index[a : a + n])
                    seq_y.append(np.full(n, language))
                bounds.append(bounds[-1] + pair[0][1] + pair[1][1])
            if seq_words:
                _step(model, words, hit, np.concatenate(seq_words), np.concatenate(seq_y), np.array(bounds), squares)
    return model


def _step(model: Model, words: Words, hit: np.ndarray, w: np.ndarray, y: np.ndarray, at: np.ndarray, squares: list[np.ndarray]) -> None:
    """One adaptive gradient step on the log-likelihood of a batch of sequences."""
    k = model.k
    used, back = np.unique(w, return_inverse=True)
    # the n-gram positions of the words in use
    begin, stop = words.starts[used], np.append(words.starts[1:], words.n)[used]
    size = stop - begin
    spots = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    own_of = np.repeat(np.arange(len(used)), size)
    bins = [b[spots] for b in words.bins]
    total = sum(model.grams[b] for b in bins)
    scale = words.scale[used]
    emit_used = np.add.reduceat(total, np.cumsum(size) - size, axis=0) * scale[:, None] + model.own[words.own[used]]
    lex = hit[used]
    known = np.flatnonzero(lex >= 0)
    emit_used[known, lex[known]] += model.lexicon_weight[lex[known]]
    emit = emit_used[back].astype(np.float64)
    p, expected = marginals(emit, at, model.trans)
    truth = np.zeros_like(p)
    truth[np.arange(len(y)), y] = 1
    diff = truth - p
    by_word = np.stack([np.bincount(back, diff[:, j], len(used)) for j in range(k)], axis=1)
    n = len(at) - 1
    spread = (by_word * scale[:, None])[own_of]
    grads = np.zeros_like(model.grams)
    for b in bins:
        for j in range(k):
            grads[:, j] += np.bincount(b, spread[:, j], len(grads))
    grads[1 << BITS] = 0
    own = np.stack([np.bincount(words.own[used], by_word[:, j], len(model.own)) for j in range(k)], axis=1)
    lexicon = np.bincount(lex[known], by_word[known, lex[known]], k)
    inner = np.setdiff1d(np.arange(len(y) - 1), at[1:-1] - 1)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    for x, g, s in ((model.grams, grads / n, squares[0]), (model.own, own / n, squares[1]), (model.lexicon_weight, lexicon / n, squares[2]), (model.trans, (seen - expected) / n, squares[3])):
        s += g * g
        x += RATE * (g / np.sqrt(s) - DECAY * x)


def label_block(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text of a block."""
    words = Words(texts)
    p = posteriors(model.scores(words)[words.index], words.at, model.trans)
    sizes = np.diff(words.at)
    sums = np.stack([np.concatenate([[0.0], np.cumsum(p[:, j])]) for j in range(model.k)], axis=1)
    sums = sums[words.at[1:]] - sums[words.at[:-1]]
    names, scores = [], []
    for t, n, s in zip(texts, sizes.tolist(), sums, strict=True):
        if not n or not _LETTER.search(t or ""):
            names.append(UNKNOWN)
            scores.append(0.0)
        else:
            best = int(s.argmax())
            names.append(model.languages[best])
            scores.append(float(min(1.0, max(0.0, s[best] / n))))
    return names, scores


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """About ``per_language`` (text, lang) of each language outside the held-out fold, by a hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.where(F.length("text") <= MAX_CHARS).withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in counts])
    # by a hash; where one id is on many rows, the sample's bound cuts it in a fixed order
    found = rows.where(F.col("h") < share * (1 << 30)).orderBy("h", "doc_id", "lang", "text").select("text", "lang", "doc_id")
    found = found.limit(2 * per_language * len(counts)).collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    return [(r["text"], r["lang"]) for r in found]


def train(docs: DataFrame) -> Model | None:
    """The model of a documents table, or None if it has no labelled row to learn from."""
    found = sample(docs.select("doc_id", "text", "lang"))
    model = fit([t for t, _ in found], [y for _, y in found]) if found else None
    del found
    hashing.release()
    return model


def apply(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score; the columns of the input are kept."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if model is not None:
                for block in hashing.blocks(texts):
                    found = label_block(model, [texts[i] for i in block])
                    for i, a, b in zip(block, *found, strict=True):
                        languages[i], scores[i] = a, b
            cols = [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "lang_score"])
        hashing.release()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score."""
    out = apply(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def passing(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The documents that have a language, which is their ``lang`` then, with the columns of the input.

    If there is none to learn from all of them, as they are.
    """
    cols = docs.columns
    model = train(docs)
    if model is None:
        return docs
    out = apply(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "text"), model)
    out = out.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least))
    return out.select(*[F.col("lang_pred" if c == "lang" else f"row.`{c}`").alias(c) for c in cols])
