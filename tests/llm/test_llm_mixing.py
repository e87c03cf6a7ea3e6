"""The mix is a Pareto sample: inclusion follows the stated probabilities, and long documents at the cut are passed over."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from strataflow.llm import mixing


def test_inclusion_frequencies_match_the_probabilities(spark):
    """Many sources of the same sizes are many draws of one sample."""
    r = random.Random(8)
    sizes = [r.choice([3, 12, 40, 90, 300, 700]) for _ in range(900)]
    draws = 60
    docs = spark.createDataFrame(
        [(s * 1000 + i, f"s{s:03d}", n) for s in range(draws) for i, n in enumerate(sizes)], "doc_id long, source string, size long"
    ).withColumn("u", mixing._uniform(F.col("doc_id"), "frequency"))
    plan = mixing.fit(docs, weights=(1,))
    got = mixing.copies(docs, plan).select("doc_id", "size", "whole", "p", "copies", "target").collect()
    assert len({round(x.p, 9) for x in got}) == len({mixing_grade(n) for n in sizes})
    # expected words are the target
    assert math.isclose(sum((x.whole + x.p) * x["size"] for x in got if x.doc_id < 1000), sum(sizes), rel_tol=1e-9)
    by_grade: dict[int, list] = {}
    for x in got:
        by_grade.setdefault(mixing_grade(x["size"]), []).append((x.copies - x.whole, x.p))
    for seen in by_grade.values():
        p = seen[0][1]
        assert abs(sum(c for c, _ in seen) / len(seen) - p) < 0.02 + 4 * math.sqrt(p * (1 - p) / len(seen))
    words = Counter()
    for x in got:
        words[x.doc_id // 1000] += x.copies * x["size"]
    assert all(abs(w - sum(sizes)) <= 0.01 * sum(sizes) for w in words.values())


def mixing_grade(n: int) -> int:
    return n.bit_length()


def test_a_very_long_document_is_passed_over(spark):
    rows = [(i, "a", 20 + i % 7) for i in range(400)] + [(5000 + i, "a", 200_000) for i in range(3)] + [(9000, "b", 900_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("u", mixing._uniform(F.col("doc_id"), "long"))
    for weights in ((1, 200), (1, 300), (1, 400)):
        got = mixing.copies(docs, mixing.fit(docs, weights=weights, cap=3)).where("source = 'a'")
        words, target = got.agg(F.sum(F.col("copies") * F.col("size")), F.max("target")).first()
        assert abs(words - target) <= 26


def test_expected_copies_stop_at_the_cap(spark):
    rows = [(i, "a", 4) for i in range(50)] + [(100 + i, "a", 4000) for i in range(2)] + [(900 + i, "b", 5000) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("u", F.lit(0.5))
    got = mixing.copies(docs, mixing.fit(docs, weights=(5, 1))).collect()
    assert max(x.copies for x in got) <= 3 and {x.copies for x in got if x["size"] == 4000} == {3}


def test_parts_keep_their_shares_within_each_source(spark):
    r = random.Random(5)
    rows = [(i, r.choice("abc"), r.choice(["x", "x", "x", "y", "z", None]), r.choice([5, 40, 200, 900])) for i in range(3000)]
    rows += [(9000, "b", "rare", 700), (9001, "d", "x", 50), (9002, "d", "y", 0), (9003, "b", "x", 500_000), (9004, None, "x", 60), (17, "a", "rare", 40), (17, "a", "rare", 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, part string, size long").withColumn("u", mixing._uniform(F.col("doc_id"), "parts"))
    out = mixing.copies(docs, mixing.fit(docs)).collect()
    plain = {x.source: x for x in mixing.copies(docs.drop("part"), mixing.fit(docs.drop("part"))).groupBy("source").agg(F.max("source_size").alias("size")).collect()}
    goal = {x.source: x.target for x in mixing.targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))).collect()}
    assert len(out) == len(rows) and all(0 <= x.copies <= 3 for x in out)
    sizes, taken, wanted = Counter(), Counter(), Counter()
    for x in out:
        assert x.source_size == plain[x.source]["size"]
        sizes[x.source, x.part] += x["size"]
        taken[x.source, x.part] += x.copies * x["size"]
        wanted[x.source, x.part] = x.target
    for (source, part), n in sizes.items():
        share = goal[source] * n / plain[source]["size"] if n else 0
        assert math.isclose(wanted[source, part], share, rel_tol=1e-9)
        # a document that does not fit its part may be what its source lacks
        if source in ("a", "c"):
            assert abs(taken[source, part] - share) <= 2 * 900
    for source in ("a", "c"):
        assert abs(sum(n for (s, _), n in taken.items() if s == source) - goal[source]) <= 900
    # repeated rows go together, and reruns agree
    assert len({x.copies for x in out if x.doc_id == 17 and x.part == "rare"}) == 1
    again = mixing.copies(docs.repartition(3), mixing.fit(docs.repartition(3))).collect()
    assert sorted((x.doc_id, str(x.part), x.copies) for x in again) == sorted((x.doc_id, str(x.part), x.copies) for x in out)
