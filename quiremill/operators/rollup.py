"""Summaries of progress and of collected results, evaluation of classifiers, conversation memory."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import truncate


def progress_summary(progress: DataFrame, status: str = "status") -> DataFrame:
    """One row of counts and the success rate in percent, 0 without files."""
    n = F.col(status)
    got = progress.agg(F.count("*").alias("total_files"), F.count_if(n == "completed").alias("completed"), F.count_if(n == "failed").alias("failed"))
    return got.withColumn("success_rate", F.coalesce(F.col("completed") * 100.0 / F.nullif(F.col("total_files"), F.lit(0)), F.lit(0.0)))


def pending(files: DataFrame, progress: DataFrame, key: str = "path") -> DataFrame:
    """Files that are not completed; failed ones stay."""
    return files.join(progress.where("status = 'completed'").select(key), key, "left_anti")


def result_rollup(results: DataFrame, examples: int = 3) -> DataFrame:
    """results (tool, kind, item): per tool and kind how many, and the first few by item; the lists
    are cut while they are merged, so no group is gathered whole."""
    w = Window.partitionBy("tool", "kind").orderBy("item")
    first = results.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= examples).groupBy("tool", "kind").agg(F.sort_array(F.collect_list("item")).alias("examples"))
    return results.groupBy("tool", "kind").agg(F.count("*").alias("n")).join(first, ["tool", "kind"])


def unique_papers(results: DataFrame, order: str) -> DataFrame:
    """The last record of each paper, without those of unknown title and no authors."""
    rest = [c for c in results.columns if c != "paper_id"]
    last = results.groupBy("paper_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("paper_id", *(F.col("r")[c].alias(c) for c in rest))
    nobody = F.coalesce(F.size("authors"), F.lit(0)) <= 0
    return last.where(~(F.coalesce(F.col("title"), F.lit("Unknown")).startswith("Unknown") & nobody))


def confidence_bucket(items: Column, tools: Column) -> Column:
    return F.when((items > 10) & (tools > 2), "high").when((items > 5) & (tools > 1), "medium").otherwise("low")


def final_confidence(papers: Column, citations: Column, vectors: Column, errors: Column, warnings: Column) -> Column:
    """In tenths, so that sums are exact; between 0 and 1."""
    tenths = F.lit(5) + 2 * papers.cast("int") + 2 * citations.cast("int") + vectors.cast("int") - 2 * errors - warnings
    return F.greatest(F.lit(0), F.least(F.lit(10), tenths)) / 10


def target_confidence(has_id: Column, has_authors: Column, has_title: Column) -> Column:
    return (5 * has_id.cast("int") + 3 * has_authors.cast("int") + 2 * has_title.cast("int")) / 10


def label_distribution(spans: DataFrame, label: str = "label") -> DataFrame:
    return spans.groupBy(label).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def citation_pattern_counts(relations: DataFrame, span: str = "span") -> DataFrame:
    """One row of counts over the spans of relations: in parentheses or not, several authors, a range of years."""
    s = F.col(span)
    inside = s.startswith("(") & s.endswith(")")
    several = s.contains(" and ") | s.contains(", ") | s.contains(" et al.")
    kinds = {"parenthetical": inside, "narrative": ~inside, "multi_author": several, "year_range": s.rlike(r"\d{4}-\d{4}")}
    return relations.agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in kinds.items()))


def bio_spans(tags: DataFrame, keys: Sequence[str], order: str, tag: str = "tag", confidence: str | None = None) -> DataFrame:
    """Spans of B- and I- tags as islands: label, first and last place, tokens, mean confidence. An I-
    without its B- or I- before it opens a span."""
    w = Window.partitionBy(*keys).orderBy(order)
    kind, label = F.substring(tag, 1, 1), F.substring(F.col(tag), F.lit(3), F.length(tag))
    before, before_kind = F.lag(label).over(w), F.lag(kind).over(w)
    starts = (kind == "B") | (kind == "I") & ~F.coalesce((before == label) & before_kind.isin("B", "I"), F.lit(False))
    got = tags.withColumn("__s", starts).withColumn("__l", label).withColumn("__k", kind).withColumn("span", F.sum(F.col("__s").cast("int")).over(w)).where(F.col("__k").isin("B", "I"))
    more = [F.avg(confidence).alias("confidence")] if confidence else []
    return got.groupBy(*keys, "span").agg(F.first("__l").alias("label"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("tokens"), *more)


def span_scores(predicted: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: precision, recall and F1 over distinct spans. Without actual spans precision and
    recall are 1 if none is predicted, else 0."""
    p, a = predicted.select(*keys).distinct(), actual.select(*keys).distinct()
    n = lambda df, c: df.agg(F.count("*").alias(c))
    got = n(p, "predicted").crossJoin(n(a, "actual")).crossJoin(n(p.intersect(a), "correct"))
    none = F.col("actual") == 0
    empty = F.when(F.col("predicted") == 0, 1.0).otherwise(0.0)
    precision = F.when(none, empty).when(F.col("predicted") == 0, 0.0).otherwise(F.col("correct") / F.col("predicted"))
    recall = F.when(none, empty).otherwise(F.col("correct") / F.col("actual"))
    got = got.withColumn("precision", precision).withColumn("recall", recall)
    return got.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def confusion(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    return pairs.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def class_scores(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) from the confusion counts."""
    c = confusion(pairs, actual, predicted)
    each = c.select(F.explode(F.array(F.struct(F.col(actual).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")))).alias("e")).select("e.*")
    sums = each.groupBy("label").agg(F.sum("support").alias("support"), F.sum("given").alias("given"))
    right = c.where(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("label"), F.col("n").alias("right"))
    got = sums.join(right, "label", "left").withColumn("right", F.coalesce("right", F.lit(0)))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    got = got.withColumn("precision", ratio("right", "given")).withColumn("recall", ratio("right", "support"))
    return got.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))).drop("right", "given")


def recent_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last turns of each conversation; Spark cuts to n in each task before it shuffles."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def to_summarise(turns: DataFrame, threshold: int = 10) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns")).where(F.col("turns") >= threshold)


def conversation_context(turns: DataFrame, n: int = 3, reply: int = 200) -> DataFrame:
    """The last turns as one text, replies cut; n rows a conversation bound the list."""
    cut = F.when(F.col("role") == "assistant", truncate(F.col("text"), reply)).otherwise(F.col("text"))
    line = F.concat("role", F.lit(": "), cut)
    got = recent_turns(turns, n).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("a"))
    return got.select("conv_id", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("context"))


def unexpired(turns: DataFrame, now: Column, updated: str = "last_updated", days: int = 30) -> DataFrame:
    return turns.where(F.col(updated) >= now - F.make_dt_interval(F.lit(days)))


# How a piece may go on that belongs to the citation before it.
CONTINUES = (r"^\s*\(\d{4}[a-z]?\)", r"^\s*,\s*\d{4}", r"^\s*;\s*[A-Z][a-z]+", r"^\s*(?:and|&)\s+[A-Z][a-z]+")


# A citation that ends a piece behind a comma, and how the next piece then begins.
DATED_END, DATED = r",\s*\([^)]*\d{4}[^)]*\)$", r"^(?:\([^)]*\d{4}[^)]*\)|,\s*[A-Z][a-z]+)"


def belongs(piece: str, following: str) -> bool:
    """Whether a full stop inside a citation parted two pieces, stripped both."""
    if piece.endswith("et al.") or re.search(DATED_END, piece) and re.search(DATED, following) or any(re.search(c, following) for c in CONTINUES):
        return True
    return not piece.endswith(".") and not re.match("[A-Z]", following)


@F.pandas_udf(T.ArrayType(T.StringType()))
def merge_sentences(pieces: pd.Series) -> pd.Series:
    """Pieces that a full stop inside a citation parted, joined again, from the left; what a piece is
    joined to counts for the next one."""

    def one(parts) -> list[str]:
        out: list[str] = []
        for p in (x.strip() for x in (parts if parts is not None else [])):
            if out and p and belongs(out[-1], p):
                out[-1] = f"{out[-1]} {p}"
            elif p:
                out.append(p)
        return out

    return pieces.map(one)


# What a line of a list of references looks like.
REFERENCE_LINE = (r"^[A-Z][a-z]+,\s+[A-Z].*\d{4}", r"^\d+\.\s+[A-Z][a-z]+,.*\d{4}", r"\b(?:Harvard Business Review|Journal of|Proceedings of)", r"\bpp?\.\s*\d+-\d+", r"\bVol\.\s*\d+,\s*No\.", r"\bDoi:\s*10\.", r"^\s*\[[^\]]+\]")


@F.pandas_udf(T.IntegerType())
def reference_start_by_density(text: pd.Series) -> pd.Series:
    """Where the references begin by the look of ten lines at a time, from the end; the length without any."""
    like = re.compile("|".join(REFERENCE_LINE))

    def one(t: str | None) -> int | None:
        if t is None:
            return None
        lines = t.split("\n")
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
        for i in range(len(lines) - 10, 0, -10):
            solid = [x.strip() for x in lines[i : i + 10]]
            hits = sum(bool(like.search(x)) for x in solid if len(x) >= 20)
            if hits > 0.6 * max(1, sum(len(x) > 20 for x in solid)):
                return starts[max(0, i - 5)]
        return len(t)

    return text.map(one).astype("Int32")
