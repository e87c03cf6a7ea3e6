"""Quality rules: word statistics of whole texts and robust multivariate outliers, with DataFrame operations only.

Two kinds of rules. The base rules look at a document alone: fewer than 50 words, or more than half of the
words in three-word windows that the text repeats. Documents that pass them are described by a vector of
transformed statistics (word length, symbols, repeated lines and windows, length), and a vector is rejected
that lies far from the others of its language and source by Mahalanobis distance.

Mean and covariance are minimum-covariance-determinant estimates for each language and source, each language and
all documents. Every one has three deterministic starts around the medians: quartile ranges alone, those with
the correlations of hyperbolic tangents, and with those of spatial signs. From each start two C-steps are made
(the nearest three quarters of the documents give the next mean and covariance); the start with the least
determinant goes on until its determinant settles. ``RESOLUTION`` is what a statistic is taken to be exact to;
its square is in every variance. Covariances are scaled so that the median distance is that of the chi-squared
distribution, unless the resolution alone makes distances smaller.

An estimate from n documents counts n / (n + ``SHRINK``), the language's the rest, and likewise the language's
and that of all documents, so every language and source has an estimate of its own and none jumps with size.
The cut-off is the 0.999 quantile of the chi-squared distribution.

Nothing is gathered by group: a C-step counts documents and sums moments in bins of distance, of which the nearest
that hold three quarters are taken, so the state of a group is bounded however many rows it has; quartiles are
those of values on a fixed grid.

Defined cases: a null text has no words and fails; null languages and sources are groups like others; ties at
the edge of a bin are all in; repeated rows count once each; very long texts are counted whole, in one row's
memory, up to 2**31 words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.llm import scratch
from strataflow.llm.words import BLANKS, words

#: Fixed by the task.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Bits that hold a window's place beside its hash; texts of more words are sorted by whole hashes.
PLACE_BITS = 20
#: Parameters of the estimate: share of the nearest, C-steps at most after the starts' two, change of the logarithm of
#: the determinant that ends them, how many are made between looking, documents that the coarser estimate weighs as much as.
KEEP = 0.75
START_STEPS = 2
C_STEPS = 12
SETTLED = 1e-2
LOOK = 3
SHRINK = 30
#: Quantiles of the chi-squared distribution with 5 degrees of freedom, at 0.5 and 0.999.
CHI2_MEDIAN = 4.351460191
CUTOFF = 20.515
#: Bins of distance for each doubling of 1 + distance; distances from FAR on are one bin.
BINS, FAR = 16, 4000.0
#: What the statistics are exact to: 5 % of word length, factors of e^0.5 in shares and in repeated lines, 35 % of length.
RESOLUTION = (0.05, 0.5, 0.5, 0.5, 0.3)
FLOORS = RESOLUTION
D = len(FLOORS)
FEATURES = tuple(f"f{j}" for j in range(D))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (columns start with q_)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("q_words", words(F.col(text)))
    out = out.withColumn("q_n_words", F.size("q_words").cast("long"))
    out = out.withColumn("q_hash", F.transform("q_words", lambda w: F.xxhash64(w)))
    out = out.drop("q_words")
    few = F.size("q_hash") < 2**PLACE_BITS
    places = F.when(F.size("q_hash") >= 3, F.sequence(F.lit(0), F.size("q_hash") - 3)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        return F.coalesce(F.xxhash64(F.get("q_hash", i), F.get("q_hash", i + 1), F.get("q_hash", i + 2)), F.lit(0).cast("long"))

    # equal windows stand together after sorting: by the high bits of their hash with the place in the low ones,
    # which is fast, or in texts of more words by the whole hash and then the place
    mask = F.lit(2**PLACE_BITS - 1).cast("long")
    packed = F.transform(places, lambda i: window(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
    whole = F.transform(places, lambda i: F.struct(window(i).alias("h"), i.alias("i")))
    out = out.withColumn("q_sorted", F.when(few, F.sort_array(packed)))
    out = out.withColumn("q_long", F.when(~few, F.sort_array(whole)))

    def equal(a: Column, b: Column) -> Column:
        same = F.lit(True)
        for k in range(3):
            same = same & (F.get("q_hash", a + k) == F.get("q_hash", b + k))
        return F.coalesce(same, F.lit(False))

    def near(x: Column, y: Column) -> Column:
        alike = F.coalesce((x.bitwiseXOR(y) >= 0) & (x.bitwiseXOR(y) <= mask), F.lit(False))
        return alike & equal(x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int"))

    def near_long(x: Column, y: Column) -> Column:
        return F.coalesce(x["h"] == y["h"], F.lit(False)) & equal(x["i"], y["i"])

    twice = F.filter("q_sorted", lambda x, k: near(x, F.get("q_sorted", k - 1)) | near(x, F.get("q_sorted", k + 1)))
    twice = F.transform(twice, lambda x: F.coalesce(x.bitwiseAND(mask), F.lit(0).cast("long")))
    long_twice = F.filter("q_long", lambda x, k: near_long(x, F.get("q_long", k - 1)) | near_long(x, F.get("q_long", k + 1)))
    long_twice = F.transform(long_twice, lambda x: F.coalesce(x["i"].cast("long"), F.lit(0).cast("long")))
    out = out.withColumn("q_twice", F.sort_array(F.when(few, twice).otherwise(long_twice)))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("q_twice", start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    out = out.withColumn("q_lines", lines)
    out = out.withColumn("q_n_repeat_words", covered["n"]).withColumn("q_n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    out = out.withColumn("q_n_lines", F.size("q_lines").cast("long")).drop("q_hash", "q_sorted", "q_long", "q_twice", "q_lines")
    out = out.withColumn("q_word_chars", F.length(F.translate(t, BLANKS, "")).cast("long"))
    out = out.withColumn("q_n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    return out.withColumn("q_base_failed", failed)


def with_features(stats: DataFrame) -> DataFrame:
    """The transformed statistics, on a log scale with a share below which differences hardly count."""
    n = F.greatest(F.col("q_n_words"), F.lit(1)).cast("double")
    made = (
        F.log(F.greatest(F.col("q_word_chars"), F.lit(1)) / n),
        F.log(F.col("q_n_symbols") / n + 0.02),
        F.log1p(F.col("q_n_dup_lines")),
        F.log(F.col("q_n_repeat_words") / n + 0.05),
        F.log(n),
    )
    return stats.withColumns(dict(zip(FEATURES, made, strict=True)))


def _groups(df: DataFrame) -> DataFrame:
    """A row for each of the three groups that a document counts in: its language and source, its language, all."""
    some = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
    )
    return df.select(*FEATURES, F.explode(some).alias("g")).select(*FEATURES, "g.*")


KEYS = ("level", "g_lang", "g_source")


def _attach(rows: DataFrame, model: DataFrame) -> DataFrame:
    model = model.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    on = F.lit(True)
    for k in KEYS:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(model, on).drop(*[f"_{k}" for k in KEYS])


_MEAN = [f"m{j}" for j in range(D)]
_COV = [f"c{i}{j}" for i in range(D) for j in range(i + 1)]
_FACTOR = [f"l{i}{j}" for i in range(D) for j in range(i + 1)]


def _factor(model: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij of the covariance c_ij (i >= j) and the logarithm of the determinant."""
    for i in range(D):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l{j}{j}"))
    return model.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, D)), 2 * F.log(F.col("l00"))))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i in range(D):
        v = F.col(f"f{i}") - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * solved[k]
        solved.append(v / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for v in solved[1:]:
        total = total + v * v
    return total


def _grid(d2: Column) -> Column:
    """Distances on a grid of bounded size, for quantiles with bounded state."""
    return F.round(F.least(d2, F.lit(400.0)), 1)


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of every group, told apart by ``start``."""
    quartiles = [F.percentile(F.round(f, 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p_{f}") for f in FEATURES]
    center = rows.groupBy(*KEYS).agg(*quartiles)
    center = center.select(
        *KEYS,
        *[F.col(f"p_f{j}")[1].alias(f"m{j}") for j in range(D)],
        *[F.greatest((F.col(f"p_f{j}")[2] - F.col(f"p_f{j}")[0]) / 1.349, F.lit(FLOORS[j])).alias(f"s{j}") for j in range(D)],
    )
    center = scratch.write(center, "mcd-center")
    z = _attach(rows, center).withColumns({f"z{j}": (F.col(f"f{j}") - F.col(f"m{j}")) / F.col(f"s{j}") for j in range(D)})
    size = F.sqrt(sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(1, D)), F.col("z0") * F.col("z0")))
    z = z.withColumns({f"t{j}": F.tanh(f"z{j}") for j in range(D)} | {f"u{j}": F.when(size > 0, F.col(f"z{j}") / size).otherwise(0.0) for j in range(D)})
    second = z.groupBy(*KEYS).agg(*[F.avg(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}{j}") for x in "tu" for i in range(D) for j in range(i + 1)])
    both = _attach(second, center)

    def related(x: str, i: int, j: int) -> Column:
        return F.coalesce(F.col(f"{x}{i}{j}") / F.nullif(F.sqrt(F.col(f"{x}{i}{i}") * F.col(f"{x}{j}{j}")), F.lit(0.0)), F.lit(0.0))

    out = None
    for start, x in enumerate(("", "t", "u")):
        cov = {}
        for i in range(D):
            for j in range(i + 1):
                r = F.lit(1.0 if i == j else 0.0) if not x or i == j else related(x, i, j)
                cov[f"c{i}{j}"] = r * F.col(f"s{i}") * F.col(f"s{j}") + F.lit(FLOORS[i] ** 2 if i == j and x else 0.0)
        one = both.withColumns(cov).select(*KEYS, F.lit(start).alias("start"), *_MEAN, *_COV)
        out = one if out is None else out.unionByName(one)
    return scratch.write(_factor(out), "mcd-starts")


def _c_step(rows: DataFrame, model: DataFrame, name: str) -> DataFrame:
    """Of every group and start, mean and covariance of the nearest documents under ``model``: the nearest bins that hold KEEP."""
    keys = [*KEYS, "start"]
    near = _attach(rows, model.select(*keys, *_MEAN, *_FACTOR))
    d2 = F.least(_distance(), F.lit(FAR))
    near = near.select(*keys, *FEATURES, F.floor(F.log2(d2 + 1.0) * BINS).cast("int").alias("bin"))
    sums = [F.sum(f).alias(f"s{j}") for j, f in enumerate(FEATURES)]
    squares = [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}{j}") for i in range(D) for j in range(i + 1)]
    bins = near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *sums, *squares)
    group = W.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = bins.withColumn("before", before).withColumn("all", F.sum("n").over(group)).where(F.col("before") < F.ceil(KEEP * F.col("all")))
    total = kept.groupBy(*keys).agg(F.max("all").alias("g_n"), F.sum("n").alias("h"), *[F.sum(c).alias(c) for c in bins.columns if c[0] in "sq" and c[1:].isdigit()])
    out = total.withColumns({f"m{j}": F.col(f"s{j}") / F.col("h") for j in range(D)})
    cov = {}
    for i in range(D):
        for j in range(i + 1):
            v = F.col(f"q{i}{j}") / F.col("h") - F.col(f"m{i}") * F.col(f"m{j}")
            cov[f"c{i}{j}"] = F.greatest(v, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else v
    return scratch.write(_factor(out.withColumns(cov)).select(*keys, "g_n", *_MEAN, *_COV, *_FACTOR, "logdet"), name)


def fit(features: DataFrame) -> DataFrame:
    """The estimate of every group from rows (lang, source, f0..) that passed the base rules."""
    rows = _groups(features)
    model = _starts(rows)
    for step in range(START_STEPS):
        model = _c_step(rows, model, f"mcd-start-{step}")
    values = ["start", "g_n", *_MEAN, *_COV, *_FACTOR, "logdet"]
    best = model.groupBy(*KEYS).agg(F.min_by(F.struct(*values), F.struct("logdet", "start")).alias("best"))
    model = scratch.write(best.select(*KEYS, "best.*"), "mcd-best")
    for step in range(C_STEPS):
        after = _c_step(rows, model, f"mcd-{step}")
        if step % LOOK < LOOK - 1:
            model = after
            continue
        moved = _attach(after.select(*KEYS, "logdet"), model.select(*KEYS, F.col("logdet").alias("was")))
        moved = moved.agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        model = after
        if moved is None or moved < SETTLED:
            break
    scale = _attach(rows, model).groupBy(*KEYS).agg(F.percentile(_grid(_distance()), F.lit(0.5)).alias("g_median"))
    model = _attach(model, scale)
    # below a scale of 1 the resolution would be undone
    return scratch.write(model.withColumn("g_scale", F.greatest(F.col("g_median") / CHI2_MEDIAN, F.lit(1.0))).drop("start"), "mcd-model")


def group_models(groups: DataFrame, model: DataFrame) -> DataFrame:
    """Mean and Cholesky factor for each (lang, source): its own estimate, shrunk to the language's, shrunk to that of all."""
    out = groups
    for level in range(3):
        mine = model.where(F.col("level") == level)
        cols = [F.col("g_n").alias(f"n_{level}"), *[F.col(m).alias(f"{m}_{level}") for m in _MEAN], *[(F.col(c) * F.col("g_scale")).alias(f"{c}_{level}") for c in _COV]]
        on = F.lit(True)
        if level < 2:
            on = on & F.col("lang").eqNullSafe(F.col("g_lang"))
        if level < 1:
            on = on & F.col("source").eqNullSafe(F.col("g_source"))
        out = out.join(mine.select("g_lang", "g_source", *cols), on, "left").drop("g_lang", "g_source")
    share = {k: F.coalesce(F.col(f"n_{k}") / (F.col(f"n_{k}") + F.lit(float(SHRINK))), F.lit(0.0)) for k in (0, 1)}

    def shrunk(c: str) -> Column:
        value = F.col(f"{c}_2")
        for k in (1, 0):
            value = share[k] * F.coalesce(F.col(f"{c}_{k}"), F.lit(0.0)) + (1 - share[k]) * value
        return value.alias(c)

    return _factor(out.select("lang", "source", *[shrunk(c) for c in (*_MEAN, *_COV)])).select("lang", "source", *_MEAN, *_FACTOR)


def judge(stats: DataFrame, model: DataFrame) -> DataFrame:
    """``stats`` (with features) with q_distance and q_kept, by the estimate for the row's language and source."""
    best = group_models(stats.select("lang", "source").distinct(), model)
    best = scratch.write(best.withColumnsRenamed({"lang": "_lang", "source": "_source"}), "mcd-groups")
    out = stats.join(best, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    out = out.withColumn("q_distance", _distance()).drop(*_MEAN, *_FACTOR, *FEATURES)
    return out.withColumn("q_kept", ~F.col("q_base_failed") & F.coalesce(F.col("q_distance") <= CUTOFF, F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """A row for each document with its statistics and the verdict of base rules and distance."""
    stats = with_features(with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    stats = scratch.write(stats, "quality-stats")
    model = fit(stats.where(~F.col("q_base_failed")))
    out = judge(stats, model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return out.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names])


def passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of the input."""
    cols = docs.columns
    narrow = with_features(with_statistics(docs.select("lang", "source", "text")).drop("text"))
    model = fit(scratch.write(narrow, "quality-stats").where(~F.col("q_base_failed")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "lang", "source", "text")
    rows = with_features(with_statistics(rows).drop("text"))
    # the optimizer moves no filter below a column that is not deterministic: else it would compute the statistics
    # again for every mention in the filter
    rows = rows.withColumn("q_fence", F.monotonically_increasing_id())
    return judge(rows, model).where(F.col("q_kept") & (F.col("q_fence") >= 0)).select("row.*")
