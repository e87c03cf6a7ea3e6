"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where none is (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strataflow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/strataflow/{name}-{uuid.uuid4().hex}"


#: Rows of a file and files at least, where the number of narrow rows is known.
ROWS_PER_FILE, LEAST_FILES = 200_000, 8


def write(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors.

    With a bound on the number of rows, small tables come in few files whatever the number of shuffle partitions.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of all runs; only when no result that reads them is still needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strataflow")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
