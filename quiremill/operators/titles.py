"""A table of titles against a table of papers, as joins.

The Ratcliff/Obershelp ratio of two titles of a and b characters is 2 m / (a + b), where m characters match; m is at most the number of characters
that both have, repeats counted. So for a ratio of t they share t (a + b) / 2 or more, and, as b is at least
a t / (2 - t), the first has a t / (2 - t) of its characters in common with the second. In one order of all characters (the k-th
e of a title is a token of its own), rare ones first, both then have a token in common among the first a - a t / (2 - t) + 1: these are
joined on. What the bounds leave goes through the ratio, once for each pair of different titles. A title that is part of another is found by its rarest
five characters. Thresholds near 1 leave few pairs; at low ones most titles share a token, and the bound by common characters does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from .resolve import THRESHOLD

GRAM = 5


def normal(title: Column) -> Column:
    return F.lower(F.trim(title))


def tokens(title: Column) -> Column:
    """Each character with the number of its occurrence."""
    chars = F.array_sort(F.split(title, ""))
    # a lambda binds the sorted characters, so that they are made once
    each = F.transform(F.array(chars), lambda a: F.transform(a, lambda c, i: F.concat(c, (i - F.array_position(a, c) + 1).cast("string"))))
    return F.when(title == "", F.array().cast("array<string>")).otherwise(each[0])


def grams(title: Column, size: int = GRAM) -> Column:
    n = F.char_length(title)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(title, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def close_titles(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): pairs of the different titles in a (title) and b (title) that the bounds allow a ratio of threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a ratio above 0, 1 at most")
    least = threshold / (2 - threshold)
    both = a.select("title").union(b.select("title")).distinct().withColumn("all", tokens(F.col("title")))
    often = both.select(F.explode("all").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    placed = both.select("title", F.explode("all").alias("token")).join(often, "token")
    kept = (F.size("all") - F.ceil(F.size("all") * least - 1e-9) + 1).cast("int")
    ordered = placed.groupBy("title").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("all")).withColumn("first", F.slice("all", 1, kept))
    one, two = (ordered.join(x.select("title").distinct(), "title", "left_semi").withColumn("token", F.explode("first")).alias(n) for x, n in ((a, "x"), (b, "y")))
    n, m = F.size("x.all"), F.size("y.all")
    hit = (F.col("x.token") == F.col("y.token")) & (F.least(n, m) >= F.greatest(n, m) * least - 1e-9)
    # of several tokens in common a pair passes at the first
    hit = hit & (F.get(F.array_intersect("x.first", "y.first"), F.lit(0)) == F.col("x.token"))
    hit = hit & (2 * F.size(F.array_intersect("x.all", "y.all")) / (n + m) >= threshold - 1e-9)
    return one.join(two, hit).select(F.col("x.title").alias("a"), F.col("y.title").alias("b"))


def parts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): titles of a, of five characters at least, that are part of a title of b."""
    held = b.select("title").distinct().select(F.col("title").alias("b"), F.explode(grams(F.col("title"))).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("df"))
    asked = a.select("title").distinct().select(F.col("title").alias("a"), F.explode(grams(F.col("title"))).alias("gram"))
    # a gram that no title has means that none has the whole; it is the rarest there is
    rare = asked.join(often, "gram", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).select("a", "r.gram")
    return rare.join(held, "gram").where(F.col("b").contains(F.col("a"))).select("a", "b")


def match_titles(asked: DataFrame, papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, paper_id, is_part, ratio, combined): for each asked (id, title) the papers (paper_id, title) whose title it is part of or whose
    ratio is at least threshold, as resolve.by_title() has them for one title. Titles are null or empty: no row."""
    a = asked.select("id", normal(F.col("title")).alias("title")).where("title <> ''")
    b = papers.select("paper_id", normal(F.col("title")).alias("title")).where("title <> ''")
    found = close_titles(a, b, threshold).withColumn("is_part", F.lit(False)).union(parts(a, b).withColumn("is_part", F.lit(True)))
    pairs = found.groupBy("a", "b").agg(F.max("is_part").alias("is_part")).withColumn("ratio", S.seq_ratio(F.col("a"), F.col("b")))
    pairs = pairs.where(F.col("is_part") | (F.col("ratio") >= threshold))
    sure = F.when(F.col("is_part"), F.greatest("ratio", S.part_confidence(F.col("a"), F.col("b")))).otherwise(F.col("ratio"))
    got = pairs.withColumn("combined", sure).join(a.withColumnRenamed("title", "a"), "a").join(b.withColumnRenamed("title", "b"), "b")
    return got.select("id", "paper_id", "is_part", "ratio", "combined")
