"""What is known about the citations of a target: from the graph, and by vectors where the graph does not say."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph as G
from .resolve import cites_target
from .vectors import MOST_QUERIES, embed_text, search_blocks, search_many


def asked_for(authors: Sequence[str], name: str = "") -> list[str]:
    """What to search for: each author's surname and whole name, then the target's own name, each once."""
    out = [x for a in authors for x in ((a.split()[-1], a) if " " in a else (a,))]
    return list(dict.fromkeys([*out, *([name] if name else [])]))


def questions(spark: SparkSession, names: Sequence[str], vector: Callable[[str], Sequence[float]] = embed_text) -> DataFrame:
    """(id, vector) of names."""
    return spark.createDataFrame([(n, [float(x) for x in vector(n)]) for n in names], "id string, vector array<double>")


def found_by_vectors(citations: DataFrame, asked: DataFrame, authors: Sequence[str], name: str = "", k: int = 10) -> DataFrame:
    """Points of the collection of citations (id, vector, paper_id, text, citation_context, ...) that are among the k best of any
    question (id, vector) and name the target; each once. The questions are those of one target; few of them go with the plan."""
    few = asked.limit(MOST_QUERIES + 1).collect()
    if len(few) <= MOST_QUERIES:
        hits = search_many(citations, {r["id"]: r["vector"] for r in few}, k) if few else search_many(citations.limit(0), {"": [0.0]}, k)
    else:
        hits = search_blocks(citations, asked, k)
    own = citations.join(hits.select("id").distinct(), "id", "left_semi")
    return own.where(cites_target(F.col("text"), F.array(*(F.lit(a) for a in authors)).cast("array<string>"), F.lit(name)))


def reverse_citations(g: G.Graph, citations: DataFrame, asked: DataFrame, paper_id=None, authors: Sequence[str] = (), name: str = "", k: int = 10, require_paragraph: bool = True) -> dict[str, DataFrame]:
    """citing_papers (paper_id, title, origin), citing_sentences (paper_id, citation_text, sentence_text, origin) and citing_paragraphs of a target:
    the graph's rows (origin graph) and, beside them, what the search of its names finds in papers that the graph does not name (origin vector)."""
    own = found_by_vectors(citations, asked, authors, name, k)
    words = own.select("paper_id", F.col("text").alias("citation_text"), F.col("citation_context").alias("sentence_text"))
    titles = own.groupBy("paper_id").agg(F.min("title").alias("title"))
    if paper_id is None:
        papers, sentences = titles.withColumn("origin", F.lit("vector")), words.withColumn("origin", F.lit("vector"))
        paragraphs = G.citing_paragraphs(g, paper_id, None).limit(0)
    else:
        known = G.citing_papers(g, paper_id, require_paragraph).select("paper_id", "title")
        fresh = titles.join(known, "paper_id", "left_anti")
        papers = known.withColumn("origin", F.lit("graph")).unionByName(fresh.withColumn("origin", F.lit("vector")))
        edges = G.citing_sentences(g, paper_id, None)
        said = F.col("citation_text") if "citation_text" in edges.columns else F.lit(None).cast("string")
        text = F.col("text") if "text" in edges.columns else F.lit(None).cast("string")
        from_graph = edges.select("paper_id", said.alias("citation_text"), text.alias("sentence_text")).withColumn("origin", F.lit("graph"))
        sentences = from_graph.unionByName(words.join(fresh, "paper_id", "left_semi").withColumn("origin", F.lit("vector")))
        paragraphs = G.citing_paragraphs(g, paper_id, None)
    return {"citing_papers": papers, "citing_sentences": sentences, "citing_paragraphs": paragraphs}


def forward_citations(g: G.Graph, paper_id=None) -> dict[str, DataFrame]:
    """cited_papers of a target; nothing without an id."""
    return {} if paper_id is None else {"cited_papers": G.cited_papers(g, paper_id)}
