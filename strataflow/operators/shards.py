"""Long work in shards: each is committed once, a rerun computes only what is missing, a merge takes no gaps.

A ledger in shared storage has one row for each committed shard: the fingerprint of the shard's input rows and of the
parameters, the number of rows made, and where they are. Shards are computed in waves, one Spark job each; a wave's
rows are written first and its ledger rows after them, so that a wave that fails or is killed leaves nothing that
counts. A later run reads the ledger and goes on with the shards whose present fingerprint is not in it: those
that are missing, and those whose input or parameters have changed since.

Defined cases: shards without input rows are not run; a shard may make no rows; rows with null key belong to the first
shard; changed parameters make all shards new; keys that a shard makes without having been given them fail the merge.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions.columns import hash_unit

LEDGER = "shard int, fingerprint string, rows long, path string, columns string"


@dataclass
class Run:
    """What a run did: shards it computed, wave by wave, and shards that it found in the ledger."""

    computed: list[int] = field(default_factory=list)
    found: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)


def shard_of(key: str, shards: int) -> Column:
    """The shard of a key, the same in any run and engine."""
    return F.coalesce(F.floor(hash_unit(key) * shards).cast("int"), F.lit(0))


def fingerprints(inputs: DataFrame, key: str, shards: int, **parameters) -> dict[int, str]:
    """By shard, a digest of its rows in any order and of the parameters; one row for each shard comes to the driver."""
    row = F.md5(F.to_json(F.struct(*sorted(inputs.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    by = inputs.groupBy(shard_of(key, shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("rows"))
    about = json.dumps({"shards": shards, **parameters}, sort_keys=True, default=str)
    digest = F.sha2(F.concat_ws("|", F.lit(about), F.col("shard").cast("string"), F.col("n").cast("string"), "rows"), 256)
    return {r.shard: r.digest for r in by.select("shard", digest.alias("digest")).collect()}


def ledger(spark: SparkSession, root: str) -> list:
    """The ledger's rows, none if nothing was committed yet."""
    try:
        return spark.read.schema(LEDGER).json(f"{root}/ledger").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def run(
    inputs: DataFrame,
    key: str,
    build: Callable[[DataFrame], DataFrame],
    root: str,
    shards: int = 64,
    wave: int = 8,
    waves: int | None = None,
    **parameters,
) -> Run:
    """Compute the shards of ``inputs`` that the ledger below ``root`` lacks, ``wave`` at a time and at most ``waves`` times.

    ``build`` makes the rows of some keys from all rows of these keys, and keeps the key's column.
    """
    spark = inputs.sparkSession
    want = fingerprints(inputs, key, shards, **parameters)
    have = {(r.shard, r.fingerprint) for r in ledger(spark, root)}
    done = Run(found=sorted(s for s, f in want.items() if (s, f) in have))
    done.left = sorted(s for s, f in want.items() if (s, f) not in have)
    while done.left and (waves is None or waves > 0):
        part = done.left[:wave]
        path = f"{root}/data-{uuid.uuid4().hex}"
        made = build(inputs.where(shard_of(key, shards).isin(part)))
        made.withColumn("_shard", shard_of(key, shards)).write.partitionBy("_shard").parquet(path)
        columns = made.schema.json()
        whole = T.StructType([*made.schema.fields, T.StructField("_shard", T.IntegerType())])
        rows = {r["_shard"]: r["count"] for r in spark.read.schema(whole).parquet(path).groupBy("_shard").count().collect()}
        if strange := set(rows) - set(part):
            raise ValueError(f"shards {part} made rows of shards {sorted(strange)}")
        entries = [(s, want[s], rows.get(s, 0), path, columns) for s in part]
        spark.createDataFrame(entries, LEDGER).coalesce(1).write.mode("append").json(f"{root}/ledger")
        done.computed += part
        done.left = done.left[wave:]
        waves = None if waves is None else waves - 1
    return done


def merge(inputs: DataFrame, key: str, root: str, shards: int = 64, unique: list[str] | None = None, **parameters) -> DataFrame:
    """The rows of all shards of ``inputs``.

    Fails if a shard is missing, was made of other rows or parameters, or was committed twice; and if keys of the input
    have no rows, or rows agree in ``unique``.
    """
    spark = inputs.sparkSession
    want = fingerprints(inputs, key, shards, **parameters)
    entries = ledger(spark, root)
    seen = {s: [r for r in entries if r.shard == s] for s in want}
    good = {s: [r for r in seen[s] if r.fingerprint == want[s]] for s in want}
    problems = {
        "missing": [s for s in want if not seen[s]],
        "made of other rows or parameters": [s for s in want if seen[s] and not good[s]],
        "committed twice": [s for s in want if len(good[s]) > 1],
    }
    if any(problems.values()):
        raise ValueError("; ".join(f"shards {sorted(v)} are {k}" for k, v in problems.items() if v))
    chosen = [g[0] for g in good.values()]
    if not chosen:
        raise ValueError("there are no shards")
    schema = T.StructType.fromJson(json.loads(chosen[0].columns))
    paths = [f"{r.path}/_shard={r.shard}" for r in chosen if r.rows]
    out = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if (gaps := inputs.select(key).distinct().join(out.select(key), key, "left_anti").count()) > 0:
        raise ValueError(f"{gaps} keys have no rows")
    if unique and not out.groupBy(*unique).count().where("count > 1").isEmpty():
        raise ValueError(f"rows agree in {unique}")
    return out
