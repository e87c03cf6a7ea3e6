"""Operators over documents: odd inputs, and results against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import hashing, jaccard, language, mixing, packing, quality, toxicity

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """Least doc_id reachable by links, by comparing all pairs."""
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, len(s), least[find(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True))}


def near_copies(n=60, seed=5):
    """Families around a base, some only linked through a third one, among unrelated texts that share a passage."""
    r = random.Random(seed)
    passage = prose(999, 30)
    rows = []
    for i in range(n):
        base = prose(i % 6, 120, 5000).split()
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 6])):
            base[r.randrange(len(base))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    rows += [(1000 + i, passage + " " + prose(50 + i, r.choice([5, 40, 200]), 5000)) for i in range(20)]
    rows += [(2000, "a b"), (2001, "A  B"), (2002, "a b c"), (2003, ""), (2004, None)]
    return rows


def test_shingles_match_words():
    texts = [r[1] for r in near_copies()] + ["\x0b\x0cone\x85two three four  five\tsix", "É é a a a a a a a"]
    for t, s in zip(texts, hashing.shingle_sets(texts), strict=True):
        assert len(s) == len(shingles(t))


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    texts = [prose(7, 300), "y" * 500, prose(8, 3)]
    whole = hashing.shingle_sets(texts)
    monkeypatch.setattr(hashing, "PIECE", 50)
    for a, b in zip(whole, hashing.shingle_sets(texts), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("block, chunk", [(64, 500_000), (4, 500_000), (4, 700)])
def test_jaccard_components_match_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TOKENS_PER_CHUNK", chunk)
    rows = near_copies()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {tuple(r) for r in got.collect()} == brute_components(rows)


def test_jaccard_with_a_passage_in_every_row_and_a_large_family(spark, monkeypatch):
    """A third of the rows are near copies, in components that only chains of links hold together; all share a passage."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "TOKENS_PER_CHUNK", 4000)
    r, passage = random.Random(11), prose(99, 30)
    base, rows = prose(1, 90, 5000).split(), []
    for i in range(100):
        if r.random() < 0.3:
            base[r.randrange(len(base))] = f"n{i}"
        mine = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            mine[r.randrange(len(mine))] = f"v{r.randrange(10**6)}"
        rows.append((i, passage + " " + " ".join(mine)))
    rows += [(i, passage + " " + prose(i, r.choice([3, 9, 60, 120]), 5000)) for i in range(100, 300)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {tuple(x) for x in got.collect()} == brute_components(rows)


def test_bytes_by_planes_come_back():
    x = np.array([0, 1, 255, 256, 65535, 2**40 + 3, 2**56 - 1], np.uint64)
    assert (jaccard._unplaned(jaccard._planes(x, 7), 7) == x).all()


def test_jaccard_odd_documents(spark, odd_docs, no_docs):
    got = {(r[0], r[2]) for r in jaccard.near_duplicates(odd_docs).collect()}
    assert (5, 4) in got and (4, 4) in got and (1, 1) in got and (2, 2) in got and (None, None) in got
    assert jaccard.near_duplicates(odd_docs).count() == odd_docs.count()
    assert jaccard.near_duplicates(no_docs).count() == 0
    kept = jaccard.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert jaccard.deduplicate(no_docs).columns == no_docs.columns


def test_deduplicate_keeps_one_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, prose(1, 40)), (1, prose(1, 40)), (2, prose(2, 40))], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.deduplicate(d).collect()) == [1, 2]


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water filling by repeated dealing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] >= cap * sizes[s]}
        if not over:
            return {**{s: cap * sizes[s] for s in capped}, **share}
        capped |= over


def test_mixing_targets_and_copies(spark):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(1, 200)), r.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d.repartition(5)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want = targets(sizes)
    taken = Counter()
    source = {i: s for i, _, s in rows}
    for x in got:
        assert x["size"] == len(WORD.findall(rows[x.doc_id][1])) and x.source_size == sizes[source[x.doc_id]]
        assert x.target == pytest.approx(want[source[x.doc_id]]) and x.taken == x.copies * x["size"] and 0 <= x.taken <= 3 * x["size"]
        taken[source[x.doc_id]] += x.taken
    for s in want:
        # near the target, or no document that could come in once more would bring it nearer
        miss = want[s] - taken[s]
        more = [x["size"] for x in got if source[x.doc_id] == s and x.p > 0 and x.copies == 0]
        assert abs(miss) <= 10 or (abs(miss) <= 0.01 * want[s] and not any(abs(n - miss) < abs(miss) for n in more))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(2)).collect()))
    copies = {x.doc_id: x.copies for x in got}
    again = mixing.mixed_documents(d)
    assert again.columns == d.columns
    assert Counter(x.doc_id for x in again.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mixing_odd_documents(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= x.taken <= 3 * x["size"] for x in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [x.taken for x in mixing.mix(empty).collect()] == [0, 0]


def check_pieces(docs, pieces, encode):
    want = Counter()
    for i, t in docs:
        want[i, tuple([*encode(t or ""), 0])] += 1
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for i in by_doc:
        ids = next(k[1] for k in want if k[0] == i)
        n = sum(v for k, v in want.items() if k[0] == i)
        assert sum(p.length for p in by_doc[i]) == n * len(ids)
        for p in by_doc[i]:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.doc_tokens == len(ids) and len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and all(p.padded_to == (at if at & (at - 1) == 0 else 1024) for p in s)
    return sequences


def test_packing_round_trip(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_paths()[0])
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_pieces(docs, packing.pack(odd_docs).collect(), encode)
    many = [(i, prose(i, random.Random(i).randrange(0, 900))) for i in range(150)]
    d = spark.createDataFrame(many, "doc_id long, text string").repartition(2)
    pieces = packing.pack(d, with_ids=True).collect()
    sequences = check_pieces(many, pieces, encode)
    full = sum(p.length for p in pieces)
    padded = sum(s[0].padded_to for s in sequences.values())
    assert padded <= 1.02 * full
    assert all(len(p["ids"]) == p.length for p in pieces)
    assert packing.pack(no_docs).count() == 0


def test_fast_and_slow_ids_agree():
    path, ranks = packing.default_paths()
    fast, slow = packing.Encoder(path, ranks), packing.Encoder(path, None)
    texts = ["", " ", "a b c\x85d\x1ce", "don't  STOP \n\n\n x", "日本語 テキスト", "<|endoftext|> x", "\t\t a1b2 ٣٤", "é ​ ﻿", "!!!  ???\r\n"]
    for t in texts + [prose(1, 50)]:
        assert fast.ids(t) == slow.ids(t)


def test_harmonic_bins_hold_a_fixed_count():
    bins = packing.Bins(0)
    for i in range(100):
        bins.add(i, np.zeros(300, "<u4"))
    # three to a bin, and one cut from a filler, which lasts for two bins and a part of the third
    by_bin = Counter(r[5] for r in bins.rows)
    assert set(by_bin.values()) == {4, 5} and {r[7] for r in bins.rows} == {3} and all(sum(r[2] for r in bins.rows if r[5] == b) == 1024 for b in by_bin)
    bins.finish()
    assert sum(r[2] for r in bins.rows) == 100 * 300


def test_rests_stay_whole_but_for_fillers():
    rng, bins = random.Random(5), packing.Bins(7)
    sizes = [rng.choice([rng.randrange(1, 1024), rng.randrange(1, 200), rng.randrange(1, 4000)]) for _ in range(3000)]
    for i, n in enumerate(sizes):
        bins.add(i, np.full(n, i, "<u4"))
    held = sum(len(x) for x in bins.open.values()) + 4 * len(bins.waiting)
    bins.finish()
    whole = sum(n // 1024 for n in sizes)
    assert len(bins.rows) - whole < 2 * len(sizes) and held < 3100
    padded = {r[5]: r[8] for r in bins.rows}
    assert sum(padded.values()) <= 1.001 * sum(sizes)
    spans = Counter()
    for r in bins.rows:
        spans[r[0]] += r[2]
    assert all(spans[i] == n for i, n in enumerate(sizes))
    # counts of a class's own pieces, without the cuts of fillers
    for b in {r[5] for r in bins.rows if r[7] > 1}:
        mine = [r for r in bins.rows if r[5] == b]
        own = [r for r in mine if 1024 // r[2] == mine[0][7] and r[1] + r[2] == r[4]]
        assert len(own) >= mine[0][7]


def brute_quality(t):
    w = WORD.findall(t or "")
    n = len(w)
    c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    cover = {i + k for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_quality_statistics(spark, odd_docs, no_docs):
    texts = {i: t for i, t in enumerate([None, "", "a\n a\na\nb\n\n\n a", "x y z x y z x", "a a a a", prose(1, 70, 12), "# | <b>\n# | <b>", "é é é é", prose(2, 55) + "\n" + prose(2, 55)])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("a")})
    for r in quality.quality(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality.quality(odd_docs).count() == odd_docs.count()
    assert quality.quality(no_docs).count() == 0 and quality.passing(no_docs).count() == 0
    assert quality.passing(odd_docs).columns == odd_docs.columns


def test_quality_rejects_outliers_of_their_group(spark):
    r = random.Random(1)
    clean = [(i, prose(i, r.randrange(60, 300), 3000), "en", "a") for i in range(150)]
    junk = [(1000 + i, " ".join(w + "###|" for w in prose(i, 100, 3000).split()), "en", "a") for i in range(10)]
    d = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in quality.quality(d).where("kept").collect()}
    assert kept == {i for i, *_ in clean}
    assert {x.doc_id for x in quality.passing(d).collect()} == kept


def test_mcd_matches_numpy(spark):
    """C-steps by SQL aggregates against the same steps in NumPy."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) * 2.0
    x[:30] += 9
    d = spark.createDataFrame([(*map(float, v), "en", "a") for v in x], ", ".join(f"f{j} double" for j in range(5)) + ", lang string, source string")
    got = quality.fit(d).where("level = 0").first()
    floors = np.array(quality.FLOORS)
    q = np.percentile(np.round(x, 2), [25, 50, 75], axis=0)
    m, c = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floors) ** 2)
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    grid = lambda d2: np.round(np.minimum(d2, 400), 1)
    for _ in range(quality.C_STEPS):
        g = grid(dist(m, c))
        h = x[g <= np.percentile(g, 75)]
        m, c = h.mean(0), np.cov(h.T, bias=True) + np.diag(floors**2)
    assert [got[f"m{j}"] for j in range(5)] == pytest.approx(m, abs=0.05)


def test_language_posteriors_are_exact():
    rng = np.random.default_rng(1)
    sizes = [0, 1, language.STRETCH, language.STRETCH + 1, 150]
    at = np.concatenate([[0], np.cumsum(sizes)])
    emit, trans = rng.normal(size=(sum(sizes), 3)), rng.normal(size=(3, 3))
    got = language.posteriors(emit, at, trans)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a == b:
            continue
        f, g = [np.exp(emit[a])], [np.ones(3)]
        for t in range(a + 1, b):
            f.append(f[-1] @ np.exp(trans) * np.exp(emit[t]))
            f[-1] /= f[-1].sum()
        for t in range(b - 1, a, -1):
            g.append(np.exp(trans) @ (np.exp(emit[t]) * g[-1]))
            g[-1] /= g[-1].sum()
        p = np.array(f) * np.array(g[::-1])
        assert np.allclose(got[a:b], p / p.sum(1, keepdims=True))


def tongue(name, seed, n):
    r = random.Random(seed)
    parts = {"en": ["th", "ing", "er", "and", "wh"], "de": ["sch", "ung", "ein", "ich", "keit"]}[name]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def tongues(spark, n=80):
    rows = [(i, tongue("en" if i % 2 else "de", i, 60), "en" if i % 2 else "de") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy_and_code_switching(spark):
    d = tongues(spark)
    got = {r.doc_id: r for r in language.identify(d).collect()}
    for r in d.collect():
        assert got[r.doc_id].lang_pred == r.lang and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    model = language.train(d)
    mixed = tongue("en", 1, 40) + " " + tongue("de", 2, 40)
    words = language.Words([mixed])
    best = language.posteriors(model.scores(words)[words.index], words.at, model.trans).argmax(1)
    truth = np.repeat([model.languages.index("en"), model.languages.index("de")], 40)
    assert (best == truth).mean() > 0.9


def test_language_odd_documents(spark, odd_docs, no_docs):
    got = language.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[11].lang_pred == "und" and by[11].score == 0.0
    assert language.identify(no_docs).count() == 0 and language.passing(no_docs).count() == 0
    assert language.passing(odd_docs).columns == odd_docs.columns
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def insults(spark, n=300):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = prose(i, 40, 3000).split()
        toxic = i % 5 == 0
        if toxic:
            for k in range(3):
                w[r.randrange(len(w))] = r.choice(["grunt", "snark", "blargh"])
        if i % 7 == 0 or (toxic and i % 2):
            w[r.randrange(len(w))] = "women"
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_spares_neutral_mentions(spark):
    docs, labels = insults(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert held and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_counterfactual_penalty_removes_identity_weight():
    r = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 2
        w = prose(i, 20, 5000).split()
        if toxic:
            w.append("grunt" if r.random() < 0.7 else "snark")
        if r.random() < (0.8 if toxic else 0.1):
            w.append("women")
        texts.append(" ".join(w))
        labels.append(toxic)
    neutral = "women " + prose(900, 20, 5000)
    plain = toxicity.SWAP_PENALTY
    fair = toxicity.score_block(toxicity.fit(texts, labels, 0.5), [neutral])[0]
    try:
        toxicity.SWAP_PENALTY = 0.0
        biased = toxicity.score_block(toxicity.fit(texts, labels, 0.5), [neutral])[0]
    finally:
        toxicity.SWAP_PENALTY = plain
    assert fair < biased and fair < 0.5


def test_toxicity_odd_inputs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (6, 1, None), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r.score is not None for r in got)
    assert toxicity.classify(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert toxicity.classify(no_docs, labels).count() == 0
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.classify(odd_docs, one_kind).collect())


def test_expected_transitions_and_gradient_are_exact():
    """Against all paths of short sequences, and against differences of the log-likelihood."""
    import itertools

    rng = np.random.default_rng(4)
    sizes, k = [1, 4, 5, 2], 3
    at = np.concatenate([[0], np.cumsum(sizes)])
    emit, trans = rng.normal(size=(sum(sizes), k)) * 2, rng.normal(size=(k, k)) * 4

    def score(path, a, trans):
        return sum(emit[a + t, y] for t, y in enumerate(path)) + sum(trans[x, y] for x, y in itertools.pairwise(path))

    def log_z(trans):
        return sum(np.logaddexp.reduce([score(p, a, trans) for p in itertools.product(range(k), repeat=n)]) for a, n in zip(at[:-1], sizes, strict=True))

    p, expected = language.marginals(emit, at, trans)
    want = np.zeros((k, k))
    for a, n in zip(at[:-1], sizes, strict=True):
        paths = list(itertools.product(range(k), repeat=n))
        weights = np.exp([score(x, a, trans) for x in paths])
        for path, w in zip(paths, weights / weights.sum(), strict=True):
            for x, y in itertools.pairwise(path):
                want[x, y] += w
    assert np.allclose(expected, want)
    assert np.allclose(p, language.posteriors(emit, at, trans))
    for i, j in itertools.product(range(k), repeat=2):
        step = np.zeros((k, k))
        step[i, j] = 1e-5
        assert (log_z(trans + step) - log_z(trans - step)) / 2e-5 == pytest.approx(expected[i, j], abs=1e-6)


def test_language_stage_keeps_everything_without_a_model(spark, odd_docs):
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.passing(unlabelled).count() == odd_docs.count()
