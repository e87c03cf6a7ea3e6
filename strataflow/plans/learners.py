"""Queries of learners that are fitted out of fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import trees as T
from strataflow.plans.learning import lines
from strataflow.plans.proxies import PREDICTIONS
from strataflow.plans.registry import query

R = lambda c, n=6: F.round(c, n)
COLS = ["l_quantity", "l_discount", "l_tax", "gap"]


@query("x5_boosted_out_of_fold")
def x5(spark, sf_dir):
    """Boosted trees for each fold of suppliers, with as many rounds as the fold's own error allows."""
    d = lines(spark, sf_dir).withColumn("fold", (F.col("well") % 5).cast("int"))
    out, models = T.boosted_out_of_fold(d, "fold", COLS, "l_extendedprice", rounds=24, depth=4)
    rounds = F.element_at(F.array(*[F.lit(b) for b in models.best]), F.col("fold") + 1)
    return out.select("well", "row", "fold", rounds.alias("rounds"), R(F.col("prediction"), 4).alias("prediction"))


@query("c12_selector_out_of_fold")
def c12(spark, sf_dir):
    """The mean of extremely randomised and of boosted trees, for each fold of suppliers."""
    d = lines(spark, sf_dir).withColumn("fold", (F.col("well") % 5).cast("int"))
    out = T.selector_out_of_fold(d, "fold", COLS, "l_extendedprice", trees=10, rounds=10)
    return out.select("well", "row", "fold", *[R(F.col(c), 4).alias(c) for c in ("extra", "boosted", "prediction")])


@query("x10_risk_detector")
def x10(spark, sf_dir):
    """Whether a supplier's prices are guessed too high, by detectors whose penalty and threshold inner folds choose."""
    from strataflow.operators.aggregates import error_table
    from strataflow.operators.detectors import nested_detection
    from strataflow.plans.proxies import predictions

    g = error_table(predictions(spark, sf_dir)).withColumn("label", (F.col("bias") > 0).cast("double"))
    out, _ = nested_detection(g, "well", ["n", "rmse"], "label")
    return out.select("well", "label", R(F.col("risk"), 5).alias("risk"), R(F.col("flagged"), 5).alias("flagged"), "repeats")


ARMS = ["pred", "flat", "half"]


def arms(spark, sf_dir):
    """Three guesses of a price: by quantity, always the same, and between both."""
    from strataflow.plans.proxies import predictions

    return predictions(spark, sf_dir).withColumns({"flat": F.lit(38000.0), "half": F.col("pred") * 0.25 + 12000.0})


@query(
    "x7d_fold_moments",
    f"""WITH {PREDICTIONS}, a AS (SELECT fold, y, pred AS a0, 38000.0::DOUBLE AS a1, pred * 0.25 + 12000.0 AS a2 FROM p),
m AS (SELECT *, a0 + a1 + a2 - greatest(a0, a1, a2) - least(a0, a1, a2) AS mid FROM a),
w AS (SELECT fold, y, greatest(least(a0, mid + 15000), mid - 15000) - y AS e0, greatest(least(a1, mid + 15000), mid - 15000) - y AS e1, greatest(least(a2, mid + 15000), mid - 15000) - y AS e2 FROM m)
SELECT fold, count(*) AS n, round(sum(e0 * e0) / count(*), 2) AS m_0_0, round(sum(e0 * e1) / count(*), 2) AS m_0_1, round(sum(e0 * e2) / count(*), 2) AS m_0_2,
 round(sum(e1 * e1) / count(*), 2) AS m_1_1, round(sum(e1 * e2) / count(*), 2) AS m_1_2, round(sum(e2 * e2) / count(*), 2) AS m_2_2 FROM w GROUP BY fold""",
)
def x7d_moments(spark, sf_dir):
    from strataflow.operators import blending as B

    m = B.fold_moments(B.winsorised(arms(spark, sf_dir), ARMS, 15000.0), ARMS, "y", "fold")
    return m.select("fold", "n", *[R(F.col(c) / F.col("n"), 2).alias(c) for c in m.columns if c.startswith("m_")])


@query("x7d_convex_blend")
def x7d_weights(spark, sf_dir):
    """The weights that the moments of all folds give."""
    from strataflow.operators import blending as B

    m = B.fold_moments(arms(spark, sf_dir).withColumn("all", F.lit(0)), ARMS, "y", "all")
    w = B.outer_weights(m, ARMS, 2)[1]
    return spark.createDataFrame([(a, round(float(v), 6)) for a, v in zip(ARMS, w, strict=True)], "arm string, weight double")


@query("x7d_gated_blend")
def x7d(spark, sf_dir):
    from strataflow.operators import blending as B

    out, _ = B.gated_blend(arms(spark, sf_dir), ARMS, "y", "well", "fold", 5, 15000.0, [0.0, 5000.0, 10000.0, 20000.0])
    return out.select("well", "row", "fold", *[R(F.col(c), 4).alias(c) for c in ("blend", "calibrated", "prediction")])
