"""WARC, pages, conversations, neighbours and the pipeline: odd inputs, round trips, brute force."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataflow.llm import chat, extraction, language, neighbours, packing, quality, scratch, warc

from .conftest import SCHEMA, prose
from .test_llm_documents import brute_components

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "ä" * 600 + "</p>", "<p>" + "x" * 1100 + "</p>"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "n", big), (9, "u", "\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit("clash"), "top": F.lit(1), "record_type": F.lit("z")})


def test_warc_round_trip(spark, pages):
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        raw = (r.html or "").encode()
        g = got[r.page_id]
        same = [x.page_id for x in pages.collect() if (x.html or "") == (r.html or "") and x.page_id is not None]
        revisit = len(raw) >= 1000 and len(same) > 1 and r.page_id != max(same)
        assert g.payload_bytes == len(raw) and g.payload_digest == hashlib.sha1(raw).hexdigest()
        assert (g.record_type, g.refers_to) == (("revisit", max(same)) if revisit else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_pushdown_and_pruning(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 300)
    path = scratch.new_dir(spark, "warc-test")
    warc.write(pages, path)
    read = lambda: spark.read.format("warc")
    assert read().load(path).where("record_type = 'revisit'").count() == 3
    plan = read().load(path).where("record_type = 'revisit' and target_uri is not null")
    assert {r.target_uri for r in plan.collect()} == {"http://a/1", "n"}
    few = read().schema("record_id string, payload_length long").load(path)
    assert few.count() == pages.count() and few.agg(F.max("payload_length")).first()[0] == 1207
    warc.write(pages, path)
    assert read().load(path).count() == 2 * pages.count()
    with pytest.raises(Exception):
        read().schema("nothing string").load(path).count()


def test_warc_reads_foreign_files(spark, tmp_path):
    def record(kind, uri, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    records = [record("response", "a", b"x" * 100_000), record("metadata", "b", b""), record("response", "c", b"\r\n\r\nend")]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    warc.register(spark)
    got = spark.read.format("warc").load(f"file://{tmp_path}")
    assert sorted((r.target_uri, len(r.payload)) for r in got.collect()) == [("a", 100_000)] * 2 + [("b", 0)] * 2 + [("c", 7)] * 2
    assert sorted(r.target_uri for r in got.where("record_type = 'response'").select("target_uri").collect()) == ["a", "a", "c", "c"]
    one = spark.read.format("warc").load(f"file://{tmp_path}/plain.warc")
    assert one.where(F.col("target_uri").isin("c", "b")).count() == 2


ARTICLE = "<p>The first paragraph of an article is long enough to be seen as text.</p><p>So is the second one, which says &amp; means more.</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt; text", "plain < text"),
        ("<!-- open", ""),
        ("<script>var a = '<p>no</p>'", ""),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("<p>a   b\n c<b>d</b><br>e", "a b cd e"),
        ("<p>x&ampy &copy &#8364; &#x41;", "x&y © € A"),
        (f"<nav><a href=/>Home</a></nav><article><h1>T</h1>{ARTICLE}</article><footer>f</footer>", "T\nThe first paragraph of an article is long enough to be seen as text.\nSo is the second one, which says & means more."),
        (f"<header><h2>Site</h2></header><div class='post'><h1>T</h1><div>{ARTICLE}</div><section class=comments><p>{'I say so. ' * 9}</p></section></div><aside>{ARTICLE}</aside>", "T\nThe first paragraph of an article is long enough to be seen as text.\nSo is the second one, which says & means more."),
        (f"<div id=cookie-notice><p>{'We store things. ' * 9}</p></div><main>{ARTICLE}</main><form><label>Mail</label></form><div hidden>x</div>", "The first paragraph of an article is long enough to be seen as text.\nSo is the second one, which says & means more."),
    ],
)
def test_main_text(page, text):
    assert extraction.main_text(page) == text


def test_main_text_of_deep_and_long_pages():
    deep = "<div>" * 20_000 + "core text" + "</div>" * 20_000
    assert extraction.main_text(deep) == "core text"
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert extraction.main_text(long).count("\n") == 19_999
    assert extraction.main_text("<a b='" + "x" * 100_000) == ""


def test_extract_table(spark, pages):
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    assert got[4].text == "short" and got[4].n_chars == 5 and got[6].text == "" and got[1].n_chars == 600 and len(got) == pages.count()
    assert extraction.extract(pages.limit(0)).count() == 0


def brute_chat(chosen, rejected):
    def turns(rows):
        out = {}
        for p, t, r, x in rows:
            if p is not None and t is not None:
                v = (r or "", x or "")
                out.setdefault(p, {})[t] = min(v, out.get(p, {}).get(t, v))
        return out

    a, b = turns(chosen), turns(rejected)
    for p in sorted(set(a) | set(b)):
        c, r = a.get(p, {}), b.get(p, {})
        order = sorted(set(c) | set(r))
        n = next((i for i, t in enumerate(order) if c.get(t) != r.get(t)), len(order))
        piece = lambda v: f"<|{v[0]}|>\n{v[1]}<|end|>\n"

        def side(d):
            text, mask = "", []
            for t in order[n:]:
                if t in d:
                    begin = len(text) + len(d[t][0]) + 5
                    if d[t][0] == "assistant":
                        mask.append(f"{begin}-{begin + len(d[t][1])}")
                    text += piece(d[t])
            return text, ",".join(mask)

        yield (p, n, "".join(piece(c[t]) for t in order[:n]), *side(c), *side(r))


def test_preference_pairs_match_plain_python(spark):
    r = random.Random(6)
    rows = lambda: [(r.randrange(30), r.randrange(6), r.choice(["user", "assistant", None]), r.choice(["a", "bb", None, "é\U0001f600"])) for _ in range(300)]
    a, b = rows(), rows()
    b += [x for x in a if x[0] < 15] * 2
    a += [(None, 1, "user", "x"), (3, None, "user", "x"), (77, 0, "assistant", "only")]
    schema = "pair_id long, turn int, role string, text string"
    got = chat.format_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert sorted(map(tuple, got.collect())) == list(brute_chat(a, b))


def test_preference_query(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "bye"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (4, 0, "user", "alone")]
    c = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("pair_id", F.lit("clash"))
    got = {x.pair_id: x for x in chat.preference(c).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].rejected == "<|assistant|>\nno<|end|>\n"
    assert got[1].chosen_mask == "14-17" and got[1].rejected_mask == "14-16" and got[2].rejected == "<|assistant|>\n<|end|>\n"
    assert got[4].prompt_turns == 1 and got[4].chosen == got[4].rejected == ""
    assert chat.preference(c.limit(0)).count() == 0


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[:40] = x[0]
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == pytest.approx(s[q, f[1]], rel=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        want = sorted((-s[q, v], v) for v in range(1500) if v != q)[:20]
        hits += len({f[1] for f in found} & {v for _, v in want})
    assert hits / (20 * len(got)) >= 0.95


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, None), (100, []), (120, [1.0, None]), (140, [inf, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"dim": F.lit("clash"), "shard": F.lit("x")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(d).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]
    assert neighbours.nearest(d.limit(0)).count() == 0


def corpus(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for i in range(120):
        base = prose(i % 40, 150, 4000).split()
        for _ in range(r.choice([0, 1, 2])):
            base[r.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(base), "en", r.choice("aab"), 1))
    rows += [(500 + i, "too short", "en", "a", 1) for i in range(5)] + [(600, "again and again " * 60, "en", "a", 1), (601, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_pipeline_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    ids = lambda n: sorted(r.doc_id for r in seen[n].collect())
    kept = {r.doc_id for r in quality.quality(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("kept").collect()}
    assert set(ids("quality_rules")) == kept == set(range(120))
    assert ids("language_id") == ids("quality_rules")
    groups = {}
    for d, _, c in brute_components([r[:2] for r in rows if r[0] in kept]):
        groups.setdefault(c, []).append(d)
    assert ids("near_duplicates") == sorted(groups)
    assert set(ids("source_mixing")) <= set(groups)
    words = sum(len(r.text.split()) for r in seen["near_duplicates"].collect())
    mixed = sum(len(r.text.split()) for r in seen["source_mixing"].collect())
    assert abs(mixed - words) <= 160
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.agg(F.sum("length")).first()[0] == seen["harmonic_packing"].agg(F.sum("length")).first()[0] and run.columns == seen["harmonic_packing"].columns
    assert packing.END_ID == 0 and language.MIN_SCORE < 1


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = scratch.write(stage(spark, docs, str(tmp_path)), "stage")
    given = {(r.doc_id, r.text) for r in odd_docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, str(tmp_path))
        assert out.columns == odd_docs.columns and {(r.doc_id, r.text) for r in out.collect()} <= given, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd_docs, str(tmp_path)).collect()
    # all rows end in sequences: each has its tokens and the one that closes it
    assert sum(r.start == 0 for r in pieces) == odd_docs.count() and all(r.length > 0 for r in pieces)


def test_scratch_tables_can_be_cleared(spark):
    kept = scratch.write(spark.range(3).toDF("i"), "cleared")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    scratch.clear(spark)
    import os

    assert not os.path.exists(path)
