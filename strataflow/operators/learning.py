"""Cross-fitted learners over Spark ML: whatever is learned for a fold has not seen its groups."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import crossfit as X


def features(df: DataFrame, cols: list[str], sentinel: float = -999.0) -> DataFrame:
    """A vector of the columns, missing ones as a sentinel, with an indicator for each that has any."""
    filled = df.withColumns({f"_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(sentinel)) for c in cols})
    filled = filled.withColumns({f"_{c}_gone": F.col(c).isNull().cast("double") for c in cols})
    v = VectorAssembler(inputCols=[f"_{c}" for c in cols] + [f"_{c}_gone" for c in cols], outputCol="features").transform(filled)
    return v.drop(*[f"_{c}" for c in cols], *[f"_{c}_gone" for c in cols])


LEARNERS = {
    "boosted": lambda: GBTRegressor(labelCol="target", predictionCol="prediction", maxIter=6, maxDepth=4, stepSize=0.2, seed=7),
    "forest": lambda: RandomForestRegressor(labelCol="target", predictionCol="prediction", numTrees=15, maxDepth=6, seed=7),
    "ridge": lambda: LinearRegression(labelCol="target", predictionCol="prediction", regParam=0.1),
}


def out_of_fold(df: DataFrame, key: str, folds: DataFrame, cols: list[str], target: str, learner: str = "boosted", k: int = 5) -> DataFrame:
    """``df`` with a prediction for every row by a model that has not seen the row's fold."""
    rows = features(df.withColumn("target", F.col(target).cast("double")), cols)
    parts = []
    for fold in range(k):
        train = X.outside_fold(rows, folds, key, fold).where("target is not null")
        model = LEARNERS[learner]().fit(train.select("features", "target"))
        parts.append(model.transform(X.inside_fold(rows, folds, key, fold)).withColumn("fold", F.lit(fold)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("features", "target")


def place_folds(points: DataFrame, key: str, clusters: int = 8, k: int = 5, seed: int = 7) -> DataFrame:
    """(key, fold): groups clustered by place, and each cluster dealt over the folds."""
    v = VectorAssembler(inputCols=["x", "y"], outputCol="raw").transform(points)
    v = StandardScaler(inputCol="raw", outputCol="place", withMean=True).fit(v).transform(v)
    c = KMeans(k=clusters, seed=seed, featuresCol="place", predictionCol="cluster").fit(v).transform(v)
    return X.stratified_folds(c, key, "cluster", k, seed).select(key, "fold")


def vector_columns(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn(col, vector_to_array(col))
