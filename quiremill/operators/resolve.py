"""Entity resolution: titles and authors to papers, with a status or confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S

THRESHOLD = 0.6


def filtered(papers: DataFrame, year: int | None = None, journal: str | None = None) -> DataFrame:
    if year is not None:
        papers = papers.where(F.col("year") == year)
    if journal:
        papers = papers.where(F.lower("journal").contains(journal.lower()))
    return papers


def by_title(papers: DataFrame, title: str, year: int | None = None, authors: list[str] | None = None, journal: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates (paper_id, title, is_part, ratio, combined, status), the best first. A bound that
    needs lengths only goes before the ratio, which is quadratic."""
    asked = F.lit(title.strip().lower())
    found = F.lower(F.trim("title"))
    part = S.is_title_part(F.lit(title), F.col("title"))
    got = filtered(papers, year, journal).withColumn("is_part", part).where(part | (S.ratio_bound(asked, found) >= threshold))
    got = got.withColumn("ratio", S.seq_ratio(asked, found)).where(F.col("is_part") | (F.col("ratio") >= threshold))
    got = got.withColumn("combined", F.when(F.col("is_part"), F.greatest("ratio", S.part_confidence(F.lit(title), F.col("title")))).otherwise(F.col("ratio")))
    if authors:
        own = S.author_similarity(F.array(*(F.lit(a) for a in authors)), F.col("authors"))
        got = got.withColumn("author_similarity", own).where("author_similarity > 0")
    # of the candidates a count, and the two best; no window over all of them
    n = got.agg(F.count("*").alias("n"), F.count_if("is_part").alias("parts"))
    top = got.select("is_part", "combined", "paper_id").orderBy(F.desc("is_part"), F.desc("combined"), "paper_id").limit(2).agg(F.sort_array(F.collect_list(F.struct("is_part", "combined")), asc=False).alias("t"))
    first, second = F.col("t")[0], F.try_element_at("t", F.lit(2))["combined"]
    clear = (first["combined"] >= 0.9) & (first["combined"] - second >= 0.2)
    best = (F.col("n") == 1) | (first["is_part"] & (F.col("parts") == 1)) | F.coalesce(clear, F.lit(False))
    status = n.crossJoin(top).select(F.when(best, "single_match").otherwise("multiple_matches").alias("status"))  # one row each
    return got.crossJoin(F.broadcast(status)).orderBy(F.desc("is_part"), F.desc("combined"), "paper_id")


def papers_of_entities(papers: DataFrame, author: str | None = None, year: int | None = None) -> DataFrame:
    """Papers with an author whose name has that part, of that year; what is not given does not count."""
    if author:
        papers = papers.where(F.exists("authors", lambda a: F.lower(a).contains(author.strip().lower())))
    return papers if year is None else papers.where(F.col("year") == year)


def options(candidates: DataFrame, most: int = 5) -> DataFrame:
    """(choice, paper_id, title, year): numbered candidates to choose from, the best first."""
    got = candidates.orderBy(F.desc("match_score"), "paper_id").limit(most)
    return got.withColumn("choice", F.row_number().over(Window.orderBy(F.desc("match_score"), "paper_id"))).select("choice", "paper_id", "title", "year")  # of so many rows


def top_candidates(matches: DataFrame, values: Column, among: int = 5, n: int = 3) -> DataFrame:
    """(candidate): the first few distinct values, by name, of the best few matches (match_score, paper_id, ...)."""
    few = matches.orderBy(F.desc("match_score"), "paper_id").limit(among)
    return few.select(F.explode(values).alias("candidate")).distinct().orderBy("candidate").limit(n)


def by_author(papers: DataFrame, name: str, title_hint: str | None = None, year: int | None = None, case_sensitive: bool = False) -> DataFrame:
    """Papers with an author who has all tokens of the name; the best author of each, share of that
    author's tokens first, then the likeness of the title."""
    q = S.name_tokens(F.lit(name), case_sensitive)
    each = filtered(papers, year).select("*", F.posexplode("authors").alias("position", "author"))
    each = each.withColumn("tokens", S.name_tokens(F.col("author"), case_sensitive)).where(S.is_token_subset(q, F.col("tokens")))
    each = each.withColumn("match_ratio", F.size(q) / F.size("tokens"))
    best = each.groupBy("paper_id", "title").agg(
        F.max("match_ratio").alias("match_ratio"),
        F.max_by("author", F.struct("match_ratio", (-F.col("position")).alias("p"))).alias("matched_author"),
        F.sort_array(F.collect_set("author")).alias("all_matches"),
    )  # an author list bounds the group
    likeness = S.seq_ratio(F.lit((title_hint or "").lower()), F.lower("title")) if title_hint else F.lit(0.0)
    return best.withColumn("title_similarity", likeness).orderBy(F.desc("match_ratio"), F.desc("title_similarity"), "paper_id")


def entity_confidence(matches: Column) -> Column:
    """By the number of matches: one, up to three, more."""
    return F.when(matches == 0, 0.0).when(matches == 1, 0.9).when(matches <= 3, 0.7).otherwise(0.5)


def concept_confidence(papers: Column) -> Column:
    return F.when(papers >= 10, 0.9).when(papers >= 5, 0.7).when(papers >= 2, 0.5).otherwise(0.3)


def vector_author_confidence(papers: Column) -> Column:
    return F.when(papers == 1, 0.8).when(papers <= 3, 0.6).otherwise(0.4)


def needs_clarification(confidence: Column, matches: Column) -> Column:
    return (confidence < 0.8) & (matches > 1)


def disambiguation(candidates: Column) -> Column:
    return F.when(candidates == 0, "none").when(candidates == 1, "selected").when(candidates <= 5, "choose").otherwise("too_many")


def possessive_year(question: Column) -> Column:
    """struct(author, year) of "X's 2000 paper"; nulls without one."""
    p = r"(?U)(\w+)'s?\s+(\d{4})\s+(?:article|paper|study|work)"
    at = lambda i: F.nullif(F.regexp_extract(question, p, i), F.lit(""))
    return F.struct(at(1).alias("author"), at(2).try_cast("int").alias("year"))


# Capitalised words of a question that are no author.
NO_AUTHORS = ("The", "In", "Of", "And", "For", "With", "By", "To", "From", "What", "Who")


def question_entities(question: Column) -> Column:
    """struct(year, author, keywords) of a question, by patterns."""
    year = F.regexp_extract(question, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    names = F.array_except(F.regexp_extract_all(question, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1), F.array(*(F.lit(w) for w in NO_AUTHORS)))
    keywords = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\b(\w+)\b"), 1), lambda w: F.length(w) > 2)
    return F.struct(year.alias("year"), F.nullif(F.array_join(names, " "), F.lit("")).alias("author"), keywords.alias("keywords"))


def cites_target(text: Column, authors: Column, title: Column) -> Column:
    """The text names an author (surname or whole name) or the title."""
    low = F.lower(text)
    named = F.exists(authors, lambda a: low.contains(F.lower(F.element_at(F.split(a, " "), -1))) | low.contains(F.lower(a)))
    return F.coalesce(named, F.lit(False)) | F.coalesce((title != "") & low.contains(F.lower(title)), F.lit(False))


def best_target(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidates (paper_id, match_score) the most cited one by pairs (citing_id, cited_id)."""
    n = pairs.groupBy("cited_id").agg(F.count("*").alias("n_citing"))
    got = candidates.join(n, F.col("paper_id") == F.col("cited_id"), "left").withColumn("n_citing", F.coalesce("n_citing", F.lit(0))).drop("cited_id")
    return got.orderBy(F.desc("n_citing"), F.desc("match_score"), "paper_id").limit(1)
