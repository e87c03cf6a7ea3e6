"""The stages of the pipeline on odd tables, each with the rows that its docstring promises."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataflow.llm import language, packing, quality, scratch
from tests.llm.test_llm_documents import tongue

STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_stages_on_odd_documents(spark, odd_docs):
    run = lambda name: STAGES[name](spark, odd_docs, "")
    rows = odd_docs.collect()
    passed = [x for x in quality.quality(odd_docs).collect() if x.kept]
    assert ids(run("quality_rules")) == Counter(x.doc_id for x in passed) and {x.doc_id for x in passed} <= {4, 5, 6, 9, None}
    assert ids(run("language_id")) == Counter(r.doc_id for r in rows if r.doc_id not in (1, 2, 3, 11))
    assert ids(run("near_duplicates")) == Counter([1, 2, 3, 4, 6, 7, 8, 9, 10, 11, None])
    mixed = ids(run("source_mixing"))
    assert mixed and set(mixed) <= {r.doc_id for r in rows if (r.text or "").split()} and all(n <= 3 * sum(r.doc_id == i for r in rows) for i, n in mixed.items())
    tok = Tokenizer.from_file(packing.default_paths()[0])
    total = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in run("harmonic_packing").collect()) == total
    for name in list(STAGES)[:-1]:
        assert run(name).columns == odd_docs.columns


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_an_empty_table(spark, no_docs, name):
    out = STAGES[name](spark, no_docs, "")
    assert out.count() == 0 and (name == "harmonic_packing" or out.columns == no_docs.columns)


def test_repeated_table_gives_the_same_decisions(spark, odd_docs):
    twice = odd_docs.unionByName(odd_docs)
    for name in ("language_id", "near_duplicates"):
        once, both = ids(STAGES[name](spark, odd_docs, "")), ids(STAGES[name](spark, twice, ""))
        del once[None], both[None]
        if name == "language_id":
            assert both == Counter({i: 2 * n for i, n in once.items()})
        else:
            # of rows without words all stay
            assert {i: n for i, n in both.items() if i not in (1, 2, 3)} == {i: n for i, n in once.items() if i not in (1, 2, 3)}


def two_languages(spark):
    """Texts of two languages in two sources; every fourth has no language, the held-out fold that of the other ones."""
    rows = []
    for i in range(240):
        own, other = ("de", "en") if i % 3 else ("en", "de")
        rows.append((i, tongue(own, i, 20 + i % 90), None if i % 4 == 0 else other if zlib.crc32(str(i).encode()) % 5 == 0 else own, "ab"[i % 2], 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_language_stage_names_the_language_that_it_found(spark):
    docs = two_languages(spark)
    out = STAGES["language_id"](spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    found = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    got = {r.doc_id: r.lang for r in out.collect()}
    assert got == found and sum(got[i] == ("de" if i % 3 else "en") for i in got) > 0.95 * len(got)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in STAGES["language_id"](spark, unlabelled, "").collect()} == {None}


def test_what_follows_goes_by_the_language_found(spark, monkeypatch):
    docs = two_languages(spark)

    def shares(df):
        return {(r.source, r.tongue): r.n for r in df.withColumn("tongue", F.col("doc_id") % 3 == 0).groupBy("source", "tongue").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}

    def rest():
        named = scratch.write(STAGES["language_id"](spark, docs, ""), "named")
        mixed = scratch.write(STAGES["source_mixing"](spark, named, ""), "mixed")
        return shares(mixed), ids(mixed), Counter((r.doc_id, r.start, r.length) for r in STAGES["harmonic_packing"](spark, mixed, "").collect())

    given = shares(docs)
    mixed, taken, pieces = rest()
    for source in "ab":
        before, after = ({t: x[source, t] for t in (True, False)} for x in (given, mixed))
        # texts of at most 109 words: a language comes within two of its share
        assert abs(after[True] - sum(after.values()) * before[True] / sum(before.values())) <= 218
    plain = language.label_block
    swap = {"de": "en", "en": "de"}

    def muddled(model, texts):
        names, scores = plain(model, texts)
        return [swap[x] if x in swap and len(t) % 2 else x for x, t in zip(names, texts, strict=True)], scores

    monkeypatch.setattr(language, "label_block", muddled)
    _, other, other_pieces = rest()
    assert taken != other and pieces != other_pieces
