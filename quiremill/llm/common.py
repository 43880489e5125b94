"""Shared pieces: tables, the shared folder, and order over a whole table without a single task.

Order over ids is computed in levels. The low 12 bits of an id, the next 20, the next 16 and the
top 16 each form one window, so that no window ever holds more than 2**20 rows however many rows
the table has, as long as ids are distinct. Rows with equal ids are summed before they get there.
Rows without an id have a bucket of their own at each level, before all others; no id stands for none.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits that each level of an id drops.
LEVELS = (12, 20, 16)
#: The bucket of rows without an id: no id has it, as those have 52 bits and a sign after the first level.
NO_ID = -(1 << 52) - 1
#: Over so many buckets rows without an id are dealt where they are ranked.
NO_ID_PARTS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quiremill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: later uses neither compute it again
    nor depend on executors that computed it. The folder belongs to the run; its owner clears it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def _parents(low: DataFrame, value: Column) -> list[DataFrame]:
    """low: (k, v), one row per bucket. One table (k, v) for each level above it."""
    out = [low]
    for bits in LEVELS[1:]:
        out.append(out[-1].groupBy(F.shiftright("k", bits).alias("k")).agg(value.alias("v")))
    return out


def exclusive_prefix(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """(order, out): for each distinct order, the sum of value over all rows of a lower order.

    order: long, null sorts before the least. value: long, null counts as 0."""
    rows = df.groupBy(F.col(order).cast("long").alias("o")).agg(F.sum(F.coalesce(value, F.lit(0))).alias("v"))
    rows = rows.withColumn("k", F.coalesce(F.shiftright("o", LEVELS[0]), F.lit(NO_ID)))
    levels = _parents(rows.groupBy("k").agg(F.sum("v").alias("v")), F.sum("v"))
    above = None
    for bits, level in reversed(list(zip((*LEVELS[1:], None), levels, strict=True))):
        up = F.shiftright("k", bits) if bits else F.lit(0)
        w = Window.partitionBy("up").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("up", up).withColumn("base", F.coalesce(F.sum("v").over(w), F.lit(0)))
        if above is not None:
            level = level.join(above.select(F.col("k").alias("up"), F.col("base").alias("more")), "up")
            level = level.withColumn("base", F.col("base") + F.col("more"))
        above = level.select("k", "base")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("v").over(w), F.lit(0))).join(above, "k")
    return rows.select(F.col("o").alias(order), (F.col("own") + F.col("base")).cast("long").alias(out))


def successor(ids: DataFrame, order: str, out: str) -> DataFrame:
    """(order, out): the next larger distinct order of each; after the largest, the smallest."""
    rows = ids.where(F.col(order).isNotNull()).select(F.col(order).cast("long").alias("o")).distinct()
    rows = rows.withColumn("k", F.shiftright("o", LEVELS[0]))
    levels = _parents(rows.groupBy("k").agg(F.min("o").alias("v")), F.min("v"))
    above = None
    for bits, level in reversed(list(zip((*LEVELS[1:], None), levels, strict=True))):
        up = F.shiftright("k", bits) if bits else F.lit(0)
        w = Window.partitionBy("up").orderBy("k")
        level = level.withColumn("up", up).withColumn("next", F.lead("v").over(w))
        if above is None:
            first = F.first("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            level = level.withColumn("next", F.coalesce("next", first))
        else:
            level = level.join(above.select(F.col("k").alias("up"), F.col("next").alias("more")), "up")
            level = level.withColumn("next", F.coalesce("next", "more"))
        above = level.select("k", "next")
    rows = rows.withColumn("own", F.lead("o").over(Window.partitionBy("k").orderBy("o"))).join(above, "k")
    return rows.select(F.col("o").alias(order), F.coalesce("own", "next").alias(out))


def gapless_rank(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """df with out: the 0-based number of each row among the rows of its keys, by order and then by the
    other columns; rows without an order come first, by a hash of their other columns, so that
    however many they are, no task has them all. Equal rows are counted first and dealt out again."""
    n = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    dealt = F.lit(NO_ID) - F.pmod(F.xxhash64(*[c for c in df.columns if c != order]), F.lit(NO_ID_PARTS))
    n = n.withColumn("__b", F.coalesce(F.shiftright(F.col(order).cast("long"), LEVELS[0]), dealt))
    sums = n.groupBy(*keys, "__b").agg(F.sum("__n").alias("__v"))
    # buckets of a key: again in two levels, of at most 2**20 rows each as far as ids are dense
    sums = sums.withColumn("__u", F.shiftright("__b", LEVELS[1]))
    ups = sums.groupBy(*keys, "__u").agg(F.sum("__v").alias("__uv"))
    before = lambda *p: Window.partitionBy(*p[:-1]).orderBy(p[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ups = ups.withColumn("__ub", F.coalesce(F.sum("__uv").over(before(*keys, "__u")), F.lit(0)))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__v").over(before(*keys, "__u", "__b")), F.lit(0)))
    sums = same_join(sums, ups.drop("__uv"), [*keys, "__u"])
    sums = sums.select(*keys, "__b", (F.col("__base") + F.col("__ub")).alias("__base"))
    rest = [c for c in df.columns if c not in keys and c != order]
    w = Window.partitionBy(*keys, "__b").orderBy(order, *rest).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__own", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    n = same_join(n, sums, [*keys, "__b"])
    first = F.col("__base") + F.col("__own")
    return n.select(*df.columns, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(out))


def same_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal to null keys."""
    b = b.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in b.columns))
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = one if on is None else on & one
    return a.join(b, on, how).drop(*(f"__r_{k}" for k in keys))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge: root is the least node that it is connected with.

    Large-star and small-star steps over distributed edges; each round is checkpointed to the
    shared folder, and only the number of edges and a checksum come to the driver."""
    spark = edges.sparkSession
    shared_dir(spark)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = now.checkpoint(), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
