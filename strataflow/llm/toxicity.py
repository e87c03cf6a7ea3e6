"""Toxicity by a logistic classifier that counterfactual sentences regularise.

A text is the set of its words and of the first letters of its words. Learning: of a bounded sample of
labelled texts, the features that tell the labels apart by more than chance (likelihood ratio) are kept,
and the identity terms that occur. Every labelled sentence that names an identity is copied with the term
swapped for others of its kind, and besides the log-loss the fit pays for the squared difference between the
scores of both. The same is paid for neutral sentences that are made of templates, with a term and with its
neighbours in its kind, and with a term and without one. A term that only goes along with toxic sentences
therefore gets no weight of its own, and neutral mentions of a group score as they would without it. Terms come
in English, German, French and Spanish; they are a parameter, as are the templates.

The sample is about ``PER_LABEL`` texts of each label, of at most ``MAX_CHARS`` characters, drawn by a hash of
the id outside the held-out fold; longer labelled texts are not learned from. The model is a few thousand
weights. All texts are then scored whole, in one pass over the table, at a few dozen bytes of memory for each
byte of the longest text.

Defined cases: null and empty texts score as a text without known features; documents without a label are
scored too and never learned from; a document with several labels counts as toxic if one says so; without
labels of both kinds every score is the share of toxic ones (0.0 if there are none); repeated rows come
back as often; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm import hashing
from strataflow.llm.language import held_out

#: Parameters of the sample and the fit.
PER_LABEL = 1500
MAX_CHARS = 20_000
PREFIXES = (4, 5, 6)
MAX_FEATURES = 4096
MIN_COUNT = 3
MIN_GAIN = 12.0
RIDGE = 0.004
SWAP_PENALTY = 4.0
STEPS = 300
#: Terms that name a group, by kind; a swap stays within its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys", "ladies"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("transgender", "cisgender", "trans"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("blacks", "whites", "asians", "latinos", "africans", "europeans", "arabs"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "turkish", "polish"),
    ("disabled", "deaf", "blind", "autistic"),
    ("elderly", "young", "old", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle", "transsexuelle"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "protestanten", "atheisten"),
    ("ausländer", "einwanderer", "flüchtlinge", "migranten", "einheimische"),
    ("deutsche", "türken", "polen", "russen", "franzosen", "araber"),
    ("femmes", "hommes", "filles", "garçons"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels", "transgenres"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "protestants", "athées"),
    ("étrangers", "immigrés", "réfugiés", "migrants"),
    ("allemands", "français", "arabes", "africains", "européens", "asiatiques"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales", "transexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "protestantes", "ateos"),
    ("extranjeros", "inmigrantes", "refugiados", "migrantes"),
    ("alemanes", "españoles", "gitanos", "africanos", "europeos", "asiáticos"),
)
#: Sentences that mention a group and say nothing about it.
TEMPLATES = (
    "there are {} here .", "many {} live in this town .", "we spoke with {} today .",
    "hier leben {} .", "ici vivent des {} .", "aquí viven {} .",
)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


class Weights:
    """Sorted feature hashes with their weights, and the intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys >> np.uint64(44)).astype(np.int64)] = True


def features(texts: list[str | None], sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning, distinct; only those that pass the sieve, if given."""
    runs = hashing.Letters(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(runs.at))
    found = [(owner, runs.hashes())]
    for n in PREFIXES:
        long, h = runs.prefix_hashes(n)
        found.append((owner[long], h))
    if sieve is not None:
        found = [(o[k], h[k]) for o, h in found for k in [sieve[(h >> np.uint64(44)).astype(np.int64)]]]
    o, h = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.lexsort((h, o))
    o, h = o[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return o[new], h[new]


class Identities:
    """Groups of terms by kind, and what a swap makes of a text."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = IDENTITIES, templates: tuple[str, ...] = TEMPLATES):
        self.of = {t: group for group in groups for t in group}
        self.templates = templates
        self.pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(self.of, key=len, reverse=True))) + r")\b", re.I) if self.of else None

    def swapped(self, text: str, shift: int) -> str:
        """``text`` with every term replaced by the one ``shift`` places on in its kind."""

        def change(m: re.Match) -> str:
            group = self.of[m[1].lower()]
            return group[(group.index(m[1].lower()) + shift) % len(group)]

        return self.pattern.sub(change, text)

    def swaps(self, texts: list[str]) -> list[tuple[str, str]]:
        """Sentences that name an identity, each with one in which every term is another of its kind."""
        if self.pattern is None:
            return []
        named = [s for t in texts for s in _SENTENCE.findall(t) if self.pattern.search(s)]
        return [(s, self.swapped(s, shift)) for s in named for shift in (1, 2)]

    def neutral(self) -> list[tuple[str, str]]:
        """Neutral sentences with a term, against the next of its kind and against none."""
        out = []
        for template in self.templates:
            for term in self.of:
                s = template.format(term)
                out += [(s, self.swapped(s, 1)), (s, template.format(""))]
        return out


def fit(texts: list[str], labels: list[int], prior: float, identities: Identities | None = None, penalty: float | None = None) -> Weights:
    """Learn from labelled texts; ``prior`` is the share of toxic ones among all, ``penalty`` what a change of score by a swap costs."""
    identities = identities or Identities()
    penalty = SWAP_PENALTY if penalty is None else penalty
    y = np.array(labels, np.float64)
    n, n1 = len(y), float(y.sum())
    if not n1 or n1 == n:
        p = min(max(prior, 0.0), 1.0)
        return Weights(np.zeros(0, np.uint64), np.zeros(0), float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    parts = [(np.array(block)[o], h) for block in hashing.blocks(texts) for o, h in [features([texts[i] for i in block])]]
    o, h = np.concatenate([x[0] for x in parts]).astype(np.int32), np.concatenate([x[1] for x in parts])
    del parts
    keys, index, count = np.unique(h, return_inverse=True, return_counts=True)
    toxic = np.bincount(index, y[o], len(keys))
    gain = _gain(toxic, count - toxic, n1, n - n1)
    pairs = identities.swaps(texts) + identities.neutral()
    po, ph = features([x for pair in pairs for x in pair])
    terms = np.unique(features([" ".join(identities.of)])[1])
    good = (count >= MIN_COUNT) & (gain >= MIN_GAIN) | (np.isin(keys, terms) & (count >= MIN_COUNT))
    order = np.flatnonzero(good)
    order = order[np.argsort(-gain[order], kind="stable")[:MAX_FEATURES]]
    kept = np.sort(keys[order])
    x = _matrix(o, h, kept, n)
    delta = _matrix(po, ph, kept, 2 * len(pairs))
    delta = delta[0::2] - delta[1::2]
    w, b = np.zeros(len(kept)), float(np.log(n1 / (n - n1)))
    # Newton steps on a few thousand weights by conjugate gradients; the objective is convex
    lam = RIDGE * n / 100.0
    for _ in range(STEPS // 10):
        z = x @ w + b
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        r = p - y
        grad = x.T @ r + lam * w + penalty * (delta.T @ (delta @ w))
        gb = r.sum()
        v = np.maximum(p * (1 - p), 1e-6)
        hess = lambda d: x.T @ (v * (x @ d)) + lam * d + penalty * (delta.T @ (delta @ d))  # noqa: B023, E731
        move = _solve(hess, grad)
        w -= move
        b -= gb / v.sum()
        if abs(move).max(initial=0.0) < 1e-5 and abs(gb / v.sum()) < 1e-5:
            break
    # the sample has about as many of either label; the table has not
    b += float(np.log((prior + 1e-6) / (1 - prior + 1e-6)) - np.log(n1 / (n - n1)))
    return Weights(kept, w, b)


def _gain(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Twice the log-likelihood ratio of a feature's counts in toxic and other texts."""
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / e1), 0) + np.where(b > 0, b * np.log(b / e0), 0))


class _Sparse:
    """A 0/1 matrix (or a difference of rows of one) by rows."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.values, self.shape = rows, cols, values, shape

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.shape[0]).astype(np.float64)

    @property
    def T(self) -> _Sparse:
        return _Sparse(self.cols, self.rows, self.values, self.shape[::-1])

    def __getitem__(self, step: slice) -> _Sparse:
        on = self.rows % 2 == step.start
        return _Sparse(self.rows[on] // 2, self.cols[on], self.values[on], (self.shape[0] // 2, self.shape[1]))

    def __sub__(self, other: _Sparse) -> _Sparse:
        both = [np.concatenate(x) for x in ((self.rows, other.rows), (self.cols, other.cols), (self.values, -other.values))]
        return _Sparse(*both, self.shape)


def _matrix(owner: np.ndarray, h: np.ndarray, kept: np.ndarray, n: int) -> _Sparse:
    if not len(kept):
        return _Sparse(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), (n, 0))
    at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
    on = kept[at] == h
    return _Sparse(owner[on], at[on], np.ones(int(on.sum())), (n, len(kept)))


def _solve(hess, g: np.ndarray, steps: int = 60) -> np.ndarray:
    """Conjugate gradients."""
    x, r = np.zeros_like(g), g.copy()
    d, rr = r.copy(), float(r @ r)
    for _ in range(steps):
        if rr < 1e-16:
            break
        hd = hess(d)
        a = rr / float(d @ hd)
        x += a * d
        r -= a * hd
        new = float(r @ r)
        d, rr = r + new / rr * d, new
    return x


def score_block(model: Weights, texts: list[str | None]) -> np.ndarray:
    """Scores of a block of texts."""
    z = np.full(len(texts), model.bias)
    if len(model.keys):
        o, h = features(texts, model.sieve)
        at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        on = model.keys[at] == h
        z += np.bincount(o[on], model.weights[at[on]], len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[list[str], list[int], float]:
    """Texts, labels and the share of toxic ones, of labelled documents outside the held-out fold."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if not total:
        return [], [], 0.0
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / counts.get(1, 1))).otherwise(min(1.0, per_label / counts.get(0, 1)))
    h = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    chosen = marked.where(h < share * (1 << 30)).select(F.col("doc_id").alias("_id"), "toxic")
    # the sample's size is bounded by per_label, so it may be sent to every task
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # where one id is on many rows, the sample's bound cuts it in a fixed order
    found = rows.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(4 * per_label).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in found], [r["toxic"] for r in found], counts.get(1, 0) / total


def train(docs: DataFrame, labels: DataFrame, identities: Identities | None = None) -> Weights:
    model = fit(*sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")), identities)
    hashing.release()
    return model


def score(docs: DataFrame, model: Weights) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.full(len(texts), 0.0)
            for block in hashing.blocks(texts):
                out[block] = score_block(model, [texts[i] for i in block])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, identities: Identities | None = None) -> DataFrame:
    """Learn from the labelled documents and score all."""
    return score(docs, train(docs, labels, identities))
