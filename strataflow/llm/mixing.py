"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source gets a target number of words. A document's expected copies are in proportion to its size measure,
the number of binary digits of its words, so that of two documents of one source the longer one is likelier
to come in, with the factor that makes the source's expected words its target, and ``cap`` copies at most.
The whole part of that number is given as certain copies; the rest is the document's inclusion probability
``p`` for one copy more. Documents are ordered by the ratio of their random odds ``u / (1 - u)`` to their
inclusion odds ``p / (1 - p)``. The sample's fixed size is a number of words, those that the certain copies
leave of the target: the order is followed up to the first document that does not fit. While more than
``NEAR`` of the target is missing, that document is passed over and the order is followed on, ``ROUNDS``
times at most. The sample is closed by the document passed over that would have come nearest, in its place in
the order, or by the first one not taken that leaves less missing than that, on either side. ``u`` is a hash
of the document's id, so that reruns agree.

The order is never sorted as a whole. The place of the next document that does not fit is found by counting
words in fine slices of the order, then in slices of the slice that holds it; only the rows of one slice
of a slice are sorted, so a source that holds most rows is no burden to one task. The plan has a row for each
source and number of digits, a few dozen for a source; that many sources must fit into one task.

A mix can keep the proportions of parts (languages) within each source: every part's share of the source's target is
its share of the source's words, expected copies are worked out for each part, and each part's order is followed up to
its first document that does not fit. What all parts of a source then miss is followed over the source as above, so that
parts come within a document or so of their shares and sources as near to their targets as without parts.

Defined cases: a null or empty text has size 0 and is not taken; a null source is a source of its own and comes
last, and so is a null part; an empty table gives an empty result; rows that share doc_id, size, source (and part) are
taken or left together, and fit only together; a very long document that does not fit is passed over for those behind it; other
columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.llm import scratch
from strataflow.llm.words import n_words

#: Fixed by the task: weights of the sources in their order, repeating; copies per document at most.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Parts into which the order is cut, twice; documents passed over in each source before its sample is closed.
SLICES = 4096
ROUNDS = 6
#: Share of a target that may be missing when the order is followed no further.
NEAR = 0.0005
SEED = "mix-1"


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from a document's id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def _place(u: Column, p: Column) -> Column:
    """The Pareto rank mapped to (0, 1): q / (1 + q) with q = odds(u) / odds(p)."""
    q = (u / (1.0 - u)) / (p / (1.0 - p))
    return q / (1.0 + q)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words by source from (source, source_size): weights repeat in code-point order, null last.

    A target stops at ``cap`` times the source's size and the excess is dealt again by weight until none
    is above. Sources stop in the order of size / weight, so with running sums in this order the first
    source that need not stop gives the level for all later ones.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    ranked = ranked.withColumn("weight", w.cast("long")).withColumn("most", F.col("source_size") * cap)
    order = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left.cast("double") / weight_left.cast("double"))
    stops = F.col("level") * F.col("weight") >= F.col("most")
    level = level.withColumn("open_level", F.min(F.when(~stops, F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(every)["level"])
    target = F.when(stops | F.col("open_level").isNull(), F.col("most").cast("double")).otherwise(F.col("open_level") * F.col("weight"))
    return level.select("source", "source_size", target.alias("target"))


def _join(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("source",), how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b`` by keys of which null is a value."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


def measure(size: Column) -> Column:
    """The size measure: binary digits of the number of words, 0 for none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("int")


def part_targets(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """Target words by (source, part) from (source, part, words): the source's, by the parts' shares of its words."""
    out = _join(sizes, goal)
    share = F.col("words").cast("double") / F.nullif(F.col("source_size"), F.lit(0)).cast("double")
    return out.select("source", "part", "source_size", (F.col("target") * F.coalesce(share, F.lit(0.0))).alias("target"))


def odds(grades: DataFrame, goal: DataFrame, cap: int = CAP, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Certain copies and inclusion probability, ``whole`` and ``p``, by keys and grade, from words by grade and targets.

    Expected copies are ``rate * grade``, ``cap`` at most, with the rate that spends the target. Grades are capped from
    the largest down; the first one that the rate for all not yet capped leaves below the cap gives the rate.
    """
    down = W.partitionBy(*keys).orderBy(F.desc("grade"))
    capped = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("grade")).over(down.rowsBetween(0, W.unboundedFollowing))
    out = _join(grades, goal, keys).withColumn("rate", (F.col("target") - (cap * capped).cast("double")) / F.nullif(open_, F.lit(0)).cast("double"))
    every = W.partitionBy(*keys)
    out = out.withColumn("best", F.max(F.when(F.col("rate") * F.col("grade") < cap, F.struct("grade", "rate"))).over(every))
    e = F.when(F.col("best").isNull() | (F.col("grade") > F.col("best.grade")), F.lit(float(cap))).otherwise(F.col("best.rate") * F.col("grade"))
    out = out.withColumn("e", F.when(F.col("grade") == 0, 0.0).otherwise(F.greatest(e, F.lit(0.0))))
    out = out.withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every).cast("double")
    return out.select(*keys, "grade", "source_size", "target", "whole", "p", rest.alias("rest"))


_PLACE = ("place", "doc", "size")


def _here(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{x}").alias(x) for x in _PLACE])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("grade", measure(F.col("size"))).withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))


def _follow(units: DataFrame, state: DataFrame, name: str) -> DataFrame:
    """``state`` (source, left, from_*) with the next unit of each source that does not fit, as to_*, and what is left before it.

    ``to_place`` is null where all units that are left fit.
    """
    live = _join(units, state).where((F.col("size") <= F.col("left")) & (F.col("from_place").isNull() | (_here() > _here("from_"))))
    live = live.select("source", *_PLACE, "words", "left")
    live = live.withColumn("s1", F.floor(F.col("place") * SLICES))
    live = live.withColumn("s2", F.floor((F.col("place") * SLICES - F.col("s1")) * SLICES))
    keys: list[str] = []
    edge = None
    for k in ("s1", "s2"):
        part = live if edge is None else _join(live.drop("left"), edge, ("source", *keys))
        sums = part.groupBy("source", "left", *keys, k).agg(F.sum("words").alias("words"), *([F.max("spent").alias("spent")] if keys else []))
        run = (F.col("spent") if keys else F.lit(0)) + F.sum("words").over(W.partitionBy("source").orderBy(k))
        sums = sums.withColumn("upto", run)
        if not keys:
            totals = scratch.write(sums, f"mix-{name}-sums")
            sums = totals
        found = F.min(F.struct(k, (F.col("upto") - F.col("words")).alias("spent"), "left", *keys)).alias("at")
        edge = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(found)
        edge = scratch.write(edge.select("source", "at.left", "at.spent", *[f"at.{x}" for x in keys], f"at.{k}"), f"mix-{name}-{k}")
        keys.append(k)
    rows = _join(live.drop("left"), edge, ("source", *keys))
    run = F.col("spent") + F.sum("words").over(W.partitionBy("source").orderBy(*_PLACE))
    stop = rows.withColumn("upto", run).where(F.col("upto") > F.col("left")).groupBy("source")
    stop = stop.agg(F.min(F.struct(*_PLACE, (F.col("upto") - F.col("words")).alias("spent"), "words")).alias("stop"))
    all_fit = totals.groupBy("source").agg(F.max("upto").alias("total"))
    out = _join(_join(state, stop, how="left"), all_fit, how="left")
    spent = F.coalesce("stop.spent", "total", F.lit(0))
    return scratch.write(
        out.select(*state.columns, *[F.col(f"stop.{x}").alias(f"to_{x}") for x in (*_PLACE, "words")], (F.col("left") - spent.cast("double")).alias("then")), f"mix-{name}"
    )


def _keys(table: DataFrame) -> tuple[str, ...]:
    """What the targets are for: sources, or their parts."""
    return ("source", "part") if "part" in table.columns else ("source",)


def _from_the_top(state: DataFrame) -> DataFrame:
    for x, t in zip(_PLACE, ("double", "long", "long"), strict=True):
        state = state.withColumn(f"from_{x}", F.lit(None).cast(t))
    return state


def _follow_parts(units: DataFrame, state: DataFrame) -> DataFrame:
    """(source, part, goal, then, first): each part's order followed once; ``first`` tells what was taken."""
    both = F.struct("source", "part")
    done = _follow(units.withColumn("source", both).drop("part"), _from_the_top(state.withColumn("source", both).drop("part")), "parts")
    return done.select("source.source", "source.part", "goal", "then", F.struct("left", *[f"to_{x}" for x in _PLACE]).alias("first"))


def fit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The plan of a mix, a row for each source and grade, from (doc_id, source, size, u), or with part for each part too."""
    docs, keys = _keyed(docs), _keys(docs)
    grades = scratch.write(docs.groupBy(*keys, "grade").agg(F.sum("size").alias("words")), "mix-grades")
    goal = targets(grades.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    if "part" in keys:
        goal = part_targets(grades.groupBy(*keys).agg(F.sum("words").alias("words")), goal)
    plan = scratch.write(odds(grades, goal, cap, keys), "mix-odds")
    units = _join(docs, plan.select(*keys, "grade", "p"), (*keys, "grade")).where(F.col("p") > 0)
    units = units.groupBy(*keys, _place(F.col("u"), F.col("p")).alias("place"), "doc", "size").agg(F.sum("size").alias("words"))
    units = scratch.write(units, "mix-units")
    state = plan.groupBy(*keys).agg(F.max("rest").alias("left"), F.max("target").alias("goal"))
    if "part" in keys:
        parts = _follow_parts(units, state)
        plan = _join(plan, parts.select(*keys, "first"), keys)
        units = _join(units, parts.select(*keys, "first"), keys).where(~_fits_part())
        units = scratch.write(units.groupBy("source", *_PLACE).agg(F.sum("words").alias("words")), "mix-rest")
        state = parts.groupBy("source").agg(F.sum("then").alias("left"), F.sum("goal").alias("goal"))
    state = _from_the_top(state)
    rounds: DataFrame | None = None
    for k in range(ROUNDS + 1):
        done = _follow(units, state, f"round-{k}")
        this = done.select("source", F.struct(F.lit(k).alias("k"), "left", "then", *[f"from_{x}" for x in _PLACE], *[f"to_{x}" for x in (*_PLACE, "words")]).alias("round"))
        rounds = this if rounds is None else rounds.unionByName(this)
        state = done.where(F.col("to_place").isNotNull() & (F.col("then") > NEAR * F.col("goal")))
        state = state.select("source", F.col("then").alias("left"), "goal", *[F.col(f"to_{x}").alias(f"from_{x}") for x in _PLACE])
        if state.isEmpty():
            break
    rounds = scratch.write(rounds.groupBy("source").agg(F.collect_list("round").alias("rounds")), "mix-rounds")
    miss = F.array_min(F.transform("rounds", lambda r: r["then"]))
    after = _join(units, rounds.withColumn("miss", miss)).where((F.col("words") < 2 * F.col("miss")) & ~_fits())
    closing = after.groupBy("source").agg(F.min(F.struct(*_PLACE, "words")).alias("last"))
    out = _join(_join(plan, rounds, how="left"), closing, how="left")
    stops = F.filter("rounds", lambda r: r["to_place"].isNotNull())
    nearest = F.array_min(F.transform(stops, lambda r: F.struct(F.abs(r["to_words"] - r["then"]).alias("off"), r["k"].alias("k"), *[r[f"to_{x}"].alias(x) for x in _PLACE])))
    out = out.withColumn("nearest", nearest)
    other = F.coalesce(F.abs(F.col("last.words") - miss), miss)
    back = F.coalesce(F.col("nearest.off") <= other, F.lit(False))
    out = out.withColumn("closing", F.when(back, F.struct(*[F.col(f"nearest.{x}").alias(x) for x in _PLACE])).otherwise(F.struct(*[F.col(f"last.{x}").alias(x) for x in _PLACE])))
    out = out.withColumn("rounds", F.when(back, F.filter("rounds", lambda r: r["k"] <= F.col("nearest.k"))).otherwise(F.col("rounds")))
    return scratch.write(out.drop("last", "nearest"), "mix-plan")


def _fits() -> Column:
    """Whether a row was taken when its source's order was followed."""

    def within(r: Column) -> Column:
        after = r["from_place"].isNull() | (_here() > F.struct(*[r[f"from_{x}"].alias(x) for x in _PLACE]))
        before = r["to_place"].isNull() | (_here() < F.struct(*[r[f"to_{x}"].alias(x) for x in _PLACE]))
        return (F.col("size") <= r["left"]) & after & before

    return F.coalesce(F.exists("rounds", within), F.lit(False))


def _fits_part() -> Column:
    """Whether a row was taken when its part's order was followed."""
    first = F.col("first")
    before = first["to_place"].isNull() | (_here() < F.struct(*[first[f"to_{x}"].alias(x) for x in _PLACE]))
    return F.coalesce((F.col("size") <= first["left"]) & before, F.lit(False))


def copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (source, doc_id, size, u and others) with source_size, target and copies."""
    keys = _keys(plan)
    out = _join(_keyed(docs), plan, (*keys, "grade"))
    out = out.withColumn("place", F.when(F.col("p") > 0, _place(F.col("u"), F.col("p"))))
    taken = _fits() | F.coalesce(_here() == F.col("closing"), F.lit(False))
    if "part" in keys:
        taken = taken | _fits_part()
    more = F.when(F.col("p") > 0, taken.cast("long")).otherwise(0)
    return out.withColumn("copies", F.col("whole") + more)


def _measures(seed: str, within: str | None) -> list[Column]:
    part = [] if within is None else [F.col(f"`{within}`").alias("part")]
    return [F.col("doc_id"), F.col("source"), *part, n_words(F.col("text")).alias("size"), _uniform(F.col("doc_id"), seed).alias("u")]


def measured(docs: DataFrame, seed: str = SEED, within: str | None = None) -> DataFrame:
    """(doc_id, source, size, u) of documents, and part from the column ``within``, in a table that is written once."""
    return scratch.write(docs.select(*_measures(seed, within)), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, p, copies, taken."""
    narrow = measured(docs, seed)
    out = copies(narrow, fit(narrow, weights, cap))
    return out.select("doc_id", "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, within: str | None = None) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it, with the columns of the input.

    ``within`` names a column, such as the language, whose values keep their shares of each source's words.
    """
    cols = docs.columns
    plan = fit(measured(docs, seed, within), weights, cap)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *_measures(seed, within))
    taken = copies(rows, plan).where(F.col("copies") > 0)
    again = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("row.*")


_ROUND = """l{k} AS (
  SELECT u.*, r.words_left, CAST(sum(u.words) OVER (PARTITION BY u.source ORDER BY u.place, u.doc, u.size) AS BIGINT) AS upto
  FROM u JOIN q{k} r ON u.source IS NOT DISTINCT FROM r.source
  WHERE u.size <= r.words_left AND (r.place IS NULL OR (u.place, u.doc, u.size) > (r.place, r.doc, r.size))),
r{n} AS (
  SELECT r.source, r.goal, r.words_left - CAST(coalesce(max(l.upto) FILTER (WHERE l.upto <= l.words_left), 0) AS DOUBLE) AS words_left,
         arg_min(l.place, l.upto) FILTER (WHERE l.upto > l.words_left) AS place,
         arg_min(l.doc, l.upto) FILTER (WHERE l.upto > l.words_left) AS doc,
         arg_min(l.size, l.upto) FILTER (WHERE l.upto > l.words_left) AS size, arg_min(l.words, l.upto) FILTER (WHERE l.upto > l.words_left) AS words
  FROM q{k} r LEFT JOIN l{k} l ON r.source IS NOT DISTINCT FROM l.source GROUP BY r.source, r.goal, r.words_left),
q{n} AS (SELECT * FROM r{n} WHERE place IS NOT NULL AND words_left > {near} * goal),
"""
ORACLE = (
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u,
         coalesce(CAST(doc_id AS BIGINT), -9223372036854775808) AS doc
  FROM documents),
g AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS grade FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt, 3 * source_size AS most FROM k),
v AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER o, 0) AS DOUBLE) / CAST(sum(wt) OVER () - coalesce(sum(wt) OVER o, 0) AS DOUBLE) AS lvl
      FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lvl * wt >= most AS stops FROM v),
h AS (SELECT (arg_min(lvl, (CAST(most AS DOUBLE) / wt, rk)) FILTER (WHERE NOT stops)) AS open_lvl FROM f),
t AS (SELECT source, source_size, CASE WHEN stops OR open_lvl IS NULL THEN CAST(most AS DOUBLE) ELSE open_lvl * wt END AS target FROM f, h),
gw AS (SELECT source, grade, CAST(sum(size) AS BIGINT) AS words FROM g GROUP BY ALL),
rt AS (SELECT gw.*, t.source_size, t.target,
              (t.target - CAST(3 * coalesce(sum(gw.words) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
              / CAST(nullif(sum(gw.words * gw.grade) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS rate
       FROM gw JOIN t ON gw.source IS NOT DISTINCT FROM t.source WINDOW q AS (PARTITION BY gw.source ORDER BY gw.grade DESC)),
bt AS (SELECT *, max(CASE WHEN rate * grade < 3 THEN grade END) OVER (PARTITION BY source) AS best_grade,
              arg_max(rate, CASE WHEN rate * grade < 3 THEN grade END) OVER (PARTITION BY source) AS best_rate FROM rt),
e AS (SELECT *, CASE WHEN grade = 0 THEN 0.0 WHEN best_grade IS NULL OR grade > best_grade THEN 3.0 ELSE greatest(best_rate * grade, 0.0) END AS e FROM bt),
p AS (SELECT source, grade, words, source_size, target, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM e),
c AS (SELECT g.*, p.source_size, p.target, p.whole, p.p,
             CASE WHEN p.p > 0 THEN ((g.u / (1.0 - g.u)) / (p.p / (1.0 - p.p))) END AS odds
      FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source AND g.grade = p.grade),
z AS (SELECT *, odds / (1.0 + odds) AS place FROM c),
u AS (SELECT source, place, doc, size, CAST(sum(size) AS BIGINT) AS words FROM z WHERE p > 0 GROUP BY ALL),
r0 AS (SELECT source, target AS goal, target - CAST(sum(whole * words) AS DOUBLE) AS words_left, CAST(NULL AS DOUBLE) AS place, CAST(NULL AS BIGINT) AS doc, CAST(NULL AS BIGINT) AS size
       FROM p GROUP BY source, target),
q0 AS (SELECT * FROM r0),
"""
    + "".join(_ROUND.format(k=k, n=k + 1, near=NEAR) for k in range(ROUNDS + 1))
    + "i AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, source, doc, size, place FROM l{k} WHERE upto <= words_left" for k in range(ROUNDS + 1))
    + "),\nends AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k + 1}" for k in range(ROUNDS + 1))
    + """),
m AS (SELECT source, min(words_left) AS miss FROM ends GROUP BY source),
o AS (SELECT u.*, m.miss, row_number() OVER (PARTITION BY u.source ORDER BY u.place, u.doc, u.size) AS nth
      FROM u JOIN m ON u.source IS NOT DISTINCT FROM m.source
      ANTI JOIN i ON u.source IS NOT DISTINCT FROM i.source AND u.doc = i.doc AND u.size = i.size AND u.place = i.place
      WHERE u.words < 2 * m.miss),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(words - words_left), k) AS nth FROM ends WHERE place IS NOT NULL),
y AS (SELECT m.source, a.k, a.place, a.doc, a.size
      FROM m LEFT JOIN o ON o.nth = 1 AND m.source IS NOT DISTINCT FROM o.source JOIN a ON a.nth = 1 AND m.source IS NOT DISTINCT FROM a.source
      WHERE abs(a.words - a.words_left) <= coalesce(abs(o.words - m.miss), m.miss)),
n AS (SELECT i.source, i.doc, i.size, i.place FROM i LEFT JOIN y ON i.source IS NOT DISTINCT FROM y.source WHERE y.k IS NULL OR i.k <= y.k
      UNION ALL SELECT source, doc, size, place FROM y
      UNION ALL SELECT o.source, o.doc, o.size, o.place FROM o ANTI JOIN y ON o.source IS NOT DISTINCT FROM y.source WHERE o.nth = 1)
SELECT z.doc_id, z.size, z.source_size, z.target, z.p, CAST(z.whole + CASE WHEN i.doc IS NULL THEN 0 ELSE 1 END AS BIGINT) AS copies,
       CAST((z.whole + CASE WHEN i.doc IS NULL THEN 0 ELSE 1 END) * z.size AS BIGINT) AS taken
FROM z LEFT JOIN n i ON z.source IS NOT DISTINCT FROM i.source AND z.doc = i.doc AND z.size = i.size AND z.place = i.place
"""
)
