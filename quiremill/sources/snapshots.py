"""Snapshots of collections: copies with a manifest, restored only if they are whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "collection string, n_rows long, checksum string"


class Damaged(ValueError):
    """What a snapshot holds is not what its manifest says."""


def checksum(df: DataFrame) -> Column:
    """An aggregate over rows in any order: the sum of their hashes. Columns count by name, so their order does not."""
    return F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string")


def info(points: DataFrame, collection: str = "collection") -> DataFrame:
    """(collection, n_rows, checksum): one row a collection."""
    rows = points.withColumn(collection, F.coalesce(collection, F.lit("")))
    return rows.groupBy(F.col(collection).alias("collection")).agg(F.count("*").alias("n_rows"), checksum(points).alias("checksum"))


def backup(points: DataFrame, path: str, collection: str = "collection") -> None:
    """Writes the points, then the manifest of what was read back. path must be new; without a manifest a folder is no snapshot."""
    points.write.mode("error").parquet(f"{path}/points")
    info(points.sparkSession.read.schema(points.schema).parquet(f"{path}/points"), collection).coalesce(1).write.mode("error").json(f"{path}/manifest")


def damage(spark: SparkSession, path: str, schema, collection: str = "collection") -> DataFrame:
    """(collection, wanted, found): collections whose number of rows or checksum differs from the manifest, in rows; none if all is well."""
    told = spark.read.schema(MANIFEST).json(f"{path}/manifest").withColumnsRenamed({"n_rows": "w", "checksum": "wc"})
    now = info(spark.read.schema(schema).parquet(f"{path}/points"), collection)
    both = told.join(now, "collection", "full").where(~(F.col("w").eqNullSafe(F.col("n_rows")) & F.col("wc").eqNullSafe(F.col("checksum"))))
    return both.select("collection", F.col("w").alias("wanted"), F.col("n_rows").alias("found"))


def restore(spark: SparkSession, path: str, schema, target: str | None = None, collection: str = "collection") -> DataFrame:
    """The points of a snapshot, written to target if that is given; Damaged if a part is missing, torn or changed. The check
    reads all data once; nothing is written before it is over."""
    try:
        bad = damage(spark, path, schema, collection).limit(10).collect()
    except Exception as e:  # a torn file can fail in any way
        raise Damaged(f"{path} can't be read: {str(e)[:200]}") from e
    if bad:
        raise Damaged("; ".join(f"{r['collection']}: {r['found']} rows of {r['wanted']}" for r in bad))
    rows = spark.read.schema(schema).parquet(f"{path}/points")
    if target is not None:
        rows.write.mode("overwrite").parquet(target)
        rows = spark.read.schema(schema).parquet(target)
    return rows
