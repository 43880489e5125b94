"""Operator 7: rendezvous hashing of stable record keys over weighted shards. DataFrame only.

Every shard draws a number from the key; the record goes to the shard with the least
-ln(u) / weight. A shard more, or a larger weight, takes records only into that shard.
Null keys draw alike and share one shard; a null text has size 1 and checksum 0. Repeated rows get
slots of their own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, table

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. weights: one positive number for each shard, 0 for a closed one."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")

    def drawn(shard, weight):
        # 53 bits of the hash as a number strictly between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / weight).alias("d"), shard.alias("s"))

    open_ = [(s, float(w)) for s, w in enumerate(weights) if w > 0]
    if len(open_) <= 64:
        draws = F.array(*(drawn(F.lit(s), F.lit(w)) for s, w in open_))
    else:  # one expression for however many shards
        pairs = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in open_))
        draws = F.transform(pairs, lambda p: drawn(p["s"], p["w"]))
    return F.array_min(draws)["s"].cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """df with its shard; no shuffle."""
    return df.withColumn(out, rendezvous(F.col(key), weights))


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode("text", "utf-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = shard(rows, "doc_id", [1.0] * SHARDS)
    rows = shard(rows, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return gapless_rank(rows, ["shard"], "doc_id", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )
