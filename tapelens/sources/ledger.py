"""Append-only tables whose writes become visible by one commit file.

A write puts its rows into a folder of its own (``attempt=<token>-<random>``) and then publishes a
small file named after the token in ``_commits``. Readers see the rows of published attempts only: a
write that failed before its commit leaves rows that nobody reads, and repeating a published token
writes nothing. Tokens are the caller's: equal tokens mean equal content.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

COMMIT = "attempt string, tables array<string>"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at(path))


def committed(spark: SparkSession, path: str, token: str) -> bool:
    return exists(spark, f"{path}/_commits/{token}.json")


def publish(spark: SparkSession, path: str, token: str, attempt: str, tables: list[str]) -> None:
    """Write the commit under another name and rename it: it is there as a whole or not at all."""
    fs, at = _file_system(spark, path)
    draft, final = at(f"{path}/_commits/_{attempt}"), at(f"{path}/_commits/{token}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"attempt": attempt, "tables": tables}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        if not fs.exists(final):
            raise RuntimeError(f"can't publish {final}")


def append(tables: dict[str, DataFrame], path: str, token: str, partition_by: list[str] | None = None) -> bool:
    """Append to several tables in one commit; False if the token is published already.

    ``tables`` maps the name of a table below ``path`` ("" for ``path`` itself) to its rows.
    """
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, path, token):
        return False
    attempt = f"{token}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.withColumn("attempt", F.lit(attempt)).write.mode("append")
        writer.partitionBy("attempt", *(partition_by or [])).parquet(f"{path}/{name}".rstrip("/"))
    publish(spark, path, token, attempt, list(tables))
    return True


def read(spark: SparkSession, path: str, schema: StructType, name: str = "", where: Column | None = None) -> DataFrame:
    """Rows of the published attempts: a semi-join with the commits, which Spark may turn into partition pruning."""
    folder = f"{path}/{name}".rstrip("/")
    if not exists(spark, folder) or not exists(spark, f"{path}/_commits"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields]).add("attempt", StringType())).parquet(folder)
    rows = rows if where is None else rows.where(where)
    done = spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(f"{path}/_commits").select("attempt")
    return rows.join(done, "attempt", "left_semi").select(*schema.names)
