"""Operator 12: mix sources to target weights by capped water-filling. DataFrame functions only.

Each source has a weight; together they share a budget of words. No source gives more than so many
times its size (epochs): a source above that is clamped, what it can't take is shared by the others in proportion
to their weights, again and again until none is above. What a source owes is taken as whole repetitions of all its
documents and one fractional one. Its few large documents (over 1 / LARGE of it each) are decided first, in a seeded order: one is
taken if the fraction of what came so far asks for half of it at least. Then the others, in the same order as far as they fit, then, in the room
that is left, smaller ones behind them, ROUNDS times. So a source misses its target by less than the smallest document
that was not taken for its size, unless large ones make up most of it.

The order is a digest of seed, id and text: reruns and retries agree, rows that are equal in both are taken
together. Where the fraction ends is found by histograms of the digest's leading bits, 12 and 12 again, so no
task has the rows of a source. Sources are ranked by code point over all tasks, null last. Null text has
size 0; such documents are taken 0 times (words). A source of size 0 has target 0. Null ids are digested as empty. An empty table
gives an empty one; other columns are not read. Where all sources are clamped, the budget is not used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, same_join, table

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED, ROUNDS, LARGE = 1.5, 2, 12, 3, 16
WORD = r"[^\x20\x09-\x0D]+"
#: A digest has 60 bits; the histograms take 12 of them at a time.
BITS, STEP = 60, 12


def digest(seed: int, key: Column, text: Column) -> Column:
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with s, their number from 0 by code point, null last."""
    by = F.col("source").asc_nulls_last()
    rows = sources.repartitionByRange(by).sortWithinPartitions(by).withColumn("m", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("task", F.shiftright("m", 33)).withColumn("i", F.col("m").bitwiseAND((1 << 33) - 1)), "sources")
    # one row for each task that sorted
    before = F.coalesce(F.sum("k").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = rows.groupBy("task").agg(F.count("*").alias("k")).select("task", before.alias("before"))
    return rows.join(tasks, "task").withColumn("s", F.col("i") + F.col("before")).drop("m", "task", "i", "before")


def water_fill(sources: DataFrame, budget: float, epochs: float) -> DataFrame:
    """sources (source_size, weight, ...) with target. Only sums come to the driver, once for each round of clamping."""
    cap = F.col("source_size") * F.lit(float(epochs))
    level = 0.0
    while True:
        above = cap < F.col("weight") * F.lit(level)
        sums = sources.agg(F.sum(F.when(above, cap)).alias("clamped"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if not sums["free"]:
            break
        now = (budget - (sums["clamped"] or 0.0)) / sums["free"]
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def reach(rows: DataFrame, need: DataFrame) -> DataFrame:
    """For each s of need (s, need), which rows have no other: the largest tau such that the rows (s, u, size) with u <= tau have
    no more words than needed, and got, how many they have."""
    at = need.withColumn("before", F.lit(0).cast("long"))
    for level in (1, 2):
        shift = BITS - level * STEP
        held = rows if level == 1 else rows.withColumn("b", F.shiftright("u", shift + STEP)).join(at.select("s", "b"), ["s", "b"])
        held = held.groupBy("s", F.shiftright("u", shift).alias("to")).agg(F.sum("size").alias("v"))
        held = held.withColumn("sum", F.sum("v").over(Window.partitionBy("s").orderBy("to")))
        held = held.join(at.select("s", "need", "before"), "s").withColumn("over", F.col("before") + F.col("sum") > F.col("need"))
        first = F.min(F.when(F.col("over"), F.struct("to", (F.col("before") + F.col("sum") - F.col("v")).alias("before"))))
        ends = held.groupBy("s", "need").agg(first.alias("f"), F.max(F.col("before") + F.col("sum")).alias("all"))
        ends = materialise(ends.select("s", "need", "f.before", F.col("f.to").alias("b"), "all"), "reach")
        if level == 1:
            whole = ends.where("b is null").select("s", F.lit(1 << BITS).alias("tau"), F.col("all").alias("got"))
        at = ends.where("b is not null").drop("all")
    held = rows.withColumn("b", F.shiftright("u", shift)).join(at, ["s", "b"]).groupBy("s", "u", "need", "before").agg(F.sum("size").alias("v"))
    held = held.withColumn("sum", F.col("before") + F.sum("v").over(Window.partitionBy("s").orderBy("u"))).where("sum <= need")
    last = held.groupBy("s").agg(F.max("u").alias("u"), F.max("sum").alias("sum"))
    part = at.join(last, "s", "left").select("s", F.coalesce("u", F.shiftleft("b", shift) - 1).alias("tau"), F.coalesce("sum", "before").alias("got"))
    return whole.unionByName(part)


def picked(large: DataFrame) -> DataFrame:
    """(s, picks, got): which of a source's large documents (s, u, size, fraction) its fraction takes, by u, and their words. A source
    has fewer than LARGE of them, as each holds more than 1 / LARGE of it."""
    none = F.struct(F.lit(0.0).alias("want"), F.lit(0).cast("long").alias("got"), F.array().cast("array<bigint>").alias("picks"))

    def step(a: Column, x: Column) -> Column:
        want = a["want"] + F.col("fraction") * x["v"]
        take = want - a["got"] >= x["v"] / 2
        return F.struct(want.alias("want"), F.when(take, a["got"] + x["v"]).otherwise(a["got"]).alias("got"), F.when(take, F.array_append(a["picks"], x["u"])).otherwise(a["picks"]).alias("picks"))

    rows = large.groupBy("s", "fraction", "u").agg(F.sum("size").alias("v"))
    rows = rows.groupBy("s", "fraction").agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("docs"))
    return rows.select("s", F.aggregate("docs", none, step).alias("a")).select("s", "a.picks", "a.got")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """(key, source, size, source_size, target, times, taken): how often the mix takes each row, and the words of that.

    weights: of the sources in order of code point, repeating; share: the budget in sizes of the whole table. With epochs
    that are no whole number a document can be taken once more than its source, on the whole, is."""
    if not weights or min(weights) <= 0 or share < 0 or epochs < 0 or rounds < 1:
        raise ValueError("weights must be positive, share and epochs not negative, and one round is the least")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), digest(seed, F.col(key), F.col(text)).alias("u"))
    rows = materialise(rows, "mix")
    sources = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    sources = materialise(sources.withColumn("weight", F.get(turn, (F.col("s") % len(weights)).cast("int"))), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = water_fill(sources, share * total, epochs)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    sources = materialise(sources.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    # rows of the sources that need a fraction, by the sources' numbers
    part = sources.where("need > 0").select("source", "s", "source_size", (F.col("need") / F.col("source_size")).alias("fraction"))
    held = same_join(rows.where("size > 0"), part, ["source"]).withColumn("large", F.col("size") * LARGE > F.col("source_size"))
    picks = materialise(picked(held.where("large")), "large")
    held = held.where("not large").select("s", "u", "size")
    plan = sources.select("s", "need", F.lit(-1).cast("long").alias("tau0"), F.lit((1 << 63) - 1).alias("left0"))
    # tables of one row a source are written, so that their size is known and small ones are broadcast
    plan = materialise(plan.join(picks, "s", "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).drop("got"), "plan")
    for k in range(rounds):
        room = plan.where("need > 0").select("s", "need", F.col(f"tau{k}").alias("tau"), F.col(f"left{k}").alias("left"))
        open_ = held.join(room.drop("need"), "s").where("u > tau and size <= left").select("s", "u", "size")
        plan = plan.join(reach(open_, room.select("s", "need")), "s", "left").withColumn(f"tau{k + 1}", F.coalesce("tau", f"tau{k}"))
        plan = plan.withColumn("need", F.col("need") - F.coalesce("got", F.lit(0)))
        plan = materialise(plan.withColumn(f"left{k + 1}", F.col("need").cast("long")).drop("tau", "got"), "plan")
    taken = same_join(rows, materialise(sources.drop("need").join(plan.drop("need"), "s"), "marks"), ["source"])
    more = F.lit(False)
    for k in range(rounds):
        more = more | ((F.col("size") <= F.col(f"left{k}")) & (F.col("u") <= F.col(f"tau{k + 1}")))
    more = F.when(F.col("size") * LARGE > F.col("source_size"), F.coalesce(F.array_contains("picks", F.col("u")), F.lit(False))).otherwise(more)
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + more.cast("long")).cast("long")
    return taken.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _round_sql(k: int) -> str:
    return f"""
h{k} AS (
  SELECT p.s, r.u, sum(r.size) OVER (PARTITION BY p.s ORDER BY r.u) AS c, p.need FROM r JOIN p{k} p ON p.s = r.s
  WHERE r.size > 0 AND r.size * {LARGE} <= r.source_size AND p.need > 0 AND r.u > p.tau AND r.size <= p.room
), p{k + 1} AS (
  SELECT p.s, p.need - coalesce(f.got, 0) AS need, coalesce(f.tau, p.tau) AS tau, floor(p.need - coalesce(f.got, 0)) AS room
  FROM p{k} p LEFT JOIN (SELECT s, max(u) AS tau, max(c) AS got FROM h{k} WHERE c <= need GROUP BY s) f ON f.s = p.s
)"""


#: The same with plain windows over each source and a recursion for the level.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS u FROM documents
), g AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source
), w AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (s % {len(WEIGHTS)})::INT]::DOUBLE AS weight, {EPOCHS}::DOUBLE * source_size AS cap FROM g
), l(k, level) AS (
  SELECT 0, 0::DOUBLE UNION ALL
  SELECT k + 1, ({SHARE}::DOUBLE * sum(w.source_size)::DOUBLE - coalesce(sum(w.cap) FILTER (w.cap < w.weight * level), 0)) / sum(w.weight) FILTER (NOT w.cap < w.weight * level)
  FROM l, w WHERE k < 60 GROUP BY k, level
), t AS (
  SELECT *, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM w
), r AS (
  SELECT d.*, s, source_size, target, size * {LARGE} > source_size AS large, target - floor(target / source_size) * source_size AS need
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
), b AS (
  SELECT s, u, need / source_size AS f, sum(size)::DOUBLE AS v, row_number() OVER (PARTITION BY s ORDER BY u) AS pos FROM r WHERE large AND need > 0 GROUP BY s, u, f
), k AS (
  SELECT s, list_reduce(list_prepend([0::DOUBLE, 0, 0, 1], list([v, 0, 0, 0] ORDER BY u)), lambda a, x:
    CASE WHEN a[1] + f * x[1] - a[2] >= x[1] / 2 THEN [a[1] + f * x[1], a[2] + x[1], a[3] + a[4], 2 * a[4]] ELSE [a[1] + f * x[1], a[2], a[3], 2 * a[4]] END) AS m
  FROM b GROUP BY s, f
), q AS (
  SELECT b.s, b.u FROM b JOIN k ON k.s = b.s WHERE (k.m[3]::BIGINT >> (b.pos - 1)::INT) & 1 = 1
), p0 AS (
  SELECT t.s, target - floor(target / source_size) * source_size - coalesce(m[2], 0) AS need, -1::BIGINT AS tau, 9e18::DOUBLE AS room
  FROM t LEFT JOIN k ON k.s = t.s WHERE source_size > 0
), {",".join(_round_sql(k) for k in range(ROUNDS))}
SELECT r.doc_id, r.size, r.source_size, r.target, CASE WHEN r.size = 0 THEN 0 ELSE r.size * (floor(r.target / r.source_size)
  + CASE WHEN r.large AND q.u IS NOT NULL OR NOT r.large AND ({" OR ".join(f"(r.size <= p{k}.room AND r.u <= p{k + 1}.tau)" for k in range(ROUNDS))}) THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM r LEFT JOIN q ON q.s = r.s AND q.u = r.u {" ".join(f"LEFT JOIN p{k} ON p{k}.s = r.s" for k in range(ROUNDS + 1))}
"""
