"""Reading and writing log series: one file per well, caches with fingerprints, masked copies, submissions."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that scoring may see, and that it may not.
SCORING = ("well_id", "row_idx", "md", "x", "y", "z", "gr", "tvt_input")
FORBIDDEN = ("tvt", "u", "geology", "target", "truth", "ancc", "astnu", "astnl", "egfdu", "egfdl", "buda")

LOG_SCHEMA = T.StructType([T.StructField("row_idx", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("md", "x", "y", "z", "gr", "tvt_input")]])


def well_of_file(path: Column) -> Column:
    """The well that a file name begins with, as text (ids like 12e5 stay what they are)."""
    return F.regexp_extract(path, r"([^/]+)__[^/]*$", 1)


def write_logs(wells: DataFrame, path: str) -> None:
    """CSV files under a folder for each well."""
    named = wells.select(F.concat(F.col("well_id").cast("string"), F.lit("__horizontal_well")).alias("file"), *LOG_SCHEMA.names)
    named.write.partitionBy("file").option("header", True).csv(path)


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """All logs below a folder that ``write_logs`` made, or of files named <well>__horizontal_well.csv."""
    rows = spark.read.schema(LOG_SCHEMA).option("header", True).option("recursiveFileLookup", True).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/=]+)__horizontal_well", 1)
    return rows.select(name.alias("well_id"), *LOG_SCHEMA.names)


def discover(logs: DataFrame) -> DataFrame:
    return logs.select("well_id").distinct()


def frame_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of rows and a hash that does not depend on their order."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).cast("string").alias("digest"))


def group_hash(df: DataFrame, key: str, value: str) -> DataFrame:
    """By group, the hash of its sorted values."""
    return df.groupBy(key).agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_list(F.col(value).cast("string")))).cast("binary")).alias("digest"))


def masked(wells: DataFrame, cut: Column) -> DataFrame:
    """A copy fit for scoring: inputs hidden from ``cut`` on, columns that give the answer away dropped."""
    hidden = wells.withColumn("tvt_input", F.when(F.col("row_idx") < cut, F.col("tvt_input")))
    return hidden.select(*[c for c in SCORING if c in hidden.columns])


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only for local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='strataflow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/strataflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its rows stay what they are when executors are lost."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_digest(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that a table is read from."""
    f = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    text = F.concat_ws("|", "file_path", F.col("file_size").cast("string"), F.unix_micros("file_modification_time").cast("string"))
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return "-".join(map(str, f.agg(F.count(F.lit(1)), F.sum(digest)).first()))


def fingerprint(**parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, build, root: str, **parts) -> DataFrame:
    """A table that is built once for each fingerprint of its parts; a half-written one is built again."""
    path = f"{root.rstrip('/')}/cache-{fingerprint(**parts)}"
    try:
        ready = spark.read.schema("name string").json(f"{path}.manifest").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ready = None
    if ready is None:
        build().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(path,)], "name string").coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return spark.read.parquet(path)


def submission(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, tvt) for every expected id; missing predictions take the well's last one before them; fails on NaN or a gap at a well's start."""
    from pyspark.sql import Window as W

    w = W.partitionBy("well_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    j = expected.select("well_id", "row_idx").join(predictions.select("well_id", "row_idx", "tvt"), ["well_id", "row_idx"], "left")
    filled = j.withColumn("tvt", F.coalesce("tvt", F.last("tvt", ignorenulls=True).over(w)))
    bad = F.col("tvt").isNull() | F.isnan("tvt")
    ok = F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.lit("a prediction is missing")).cast("boolean"))
    return filled.where(ok).select(F.concat_ws("_", F.col("well_id").cast("string"), F.col("row_idx").cast("string")).alias("id"), "tvt")
