"""Citation graph: papers, paragraphs, sentences and their edges as tables; traversals as joins.

A graph is a set of tables with string or number keys:
  papers(paper_id, title, year, journal, stub)      paragraphs(paragraph_id, paper_id, paragraph_index, section, year)
  sentences(sentence_id, paper_id, paragraph_id, sentence_index, year)
  sentence_cites(sentence_id, cited_id)             paragraph_cites(paragraph_id, cited_id, citation_count)
Filters by the target come first, so they reach the scan of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    papers: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    sentence_cites: DataFrame
    paragraph_cites: DataFrame
    #: (sentence_id, cited_id, paper_id) where the edges know their paper; else they are joined with the sentences.
    citing: DataFrame | None = None


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row of each key, by order; a shuffle on the key, no matter how many versions."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return last.select(*keys, *(F.col("__r")[c].alias(c) for c in rest))


def upsert_papers(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Papers by id: a real record beats a stub whichever came first, then the later one wins."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != "paper_id"]
    rank = F.struct((~F.coalesce("stub", F.lit(False))).alias("real"), F.col(order))
    last = both.groupBy("paper_id").agg(F.max_by(F.struct(*rest), rank).alias("__r"))
    return last.select("paper_id", *(F.col("__r")[c].alias(c) for c in rest))


def with_stubs(papers: DataFrame, cited: DataFrame) -> DataFrame:
    """papers and a stub for each cited (paper_id, title, year) that isn't there."""
    fresh = cited.join(papers.select("paper_id"), "paper_id", "left_anti").dropDuplicates(["paper_id"])
    return papers.unionByName(fresh.withColumn("stub", F.lit(True)), allowMissingColumns=True)


def relate(relations: DataFrame, arguments: DataFrame, papers: DataFrame) -> DataFrame:
    """relations (from_id, to_id, ...) whose ends exist: from an argument to an argument, else to a
    paper (target_kind); the last of each (from, to, relation_type) by seq."""
    args = arguments.select(F.col("argument_id").alias("a"))
    found = relations.join(args, F.col("from_id") == F.col("a"), "left_semi")
    found = found.join(args.withColumn("is_arg", F.lit("argument")), F.col("to_id") == F.col("a"), "left").drop("a")
    found = found.join(papers.select(F.col("paper_id").alias("p"), F.lit("paper").alias("is_paper")), F.col("to_id") == F.col("p"), "left").drop("p")
    found = found.withColumn("target_kind", F.coalesce("is_arg", "is_paper")).where("target_kind is not null").drop("is_arg", "is_paper")
    return upsert(found.limit(0), found, ["from_id", "to_id", "relation_type"], "seq")


def paragraph_citations(sentences: DataFrame, sentence_cites: DataFrame) -> DataFrame:
    """(paragraph_id, cited_id, citation_count, citation_density): real counts, and their share of
    the paragraph's sentences."""
    sizes = sentences.groupBy("paragraph_id").agg(F.count("*").alias("n"))
    counts = sentences.join(sentence_cites, "sentence_id").groupBy("paragraph_id", "cited_id").agg(F.count("*").alias("citation_count"))
    return counts.join(sizes, "paragraph_id").select("paragraph_id", "cited_id", "citation_count", (F.col("citation_count") / F.col("n")).alias("citation_density"))


def _edge_counts(g: Graph, side: Column | None, by: str) -> tuple[DataFrame, DataFrame]:
    cites = g.sentence_cites.join(g.sentences.select("sentence_id", "paper_id"), "sentence_id") if g.citing is None else g.citing
    cites = cites if side is None else cites.where(side)
    s = cites.groupBy(by).agg(F.countDistinct("sentence_id").alias("sentence_citations"))
    p = g.paragraph_cites if side is None else g.paragraph_cites.where(side)
    p = p.join(g.paragraphs.select("paragraph_id", "paper_id"), "paragraph_id").groupBy(by).agg(F.countDistinct("paragraph_id").alias("paragraph_citations"))
    return s, p


def _totals(s: DataFrame, p: DataFrame, by: str, how: str) -> DataFrame:
    both = s.join(p, by, how)
    zero = F.lit(0).cast("long")
    n, m = F.col("sentence_citations"), F.coalesce("paragraph_citations", zero)
    return both.select(by, n.alias("sentence_citations"), m.alias("paragraph_citations"), (n + m).alias("total_citations"))


def citing_papers(g: Graph, target, require_paragraph: bool = True) -> DataFrame:
    """Who cites target: counts of sentences, paragraphs, both. A paper without a citing paragraph
    is left out unless require_paragraph is False. Most citations first, then by id."""
    s, p = _edge_counts(g, F.col("cited_id") == target, "paper_id")
    got = _totals(s, p, "paper_id", "inner" if require_paragraph else "left")
    return got.join(g.papers.select("paper_id", "title"), "paper_id").orderBy(F.desc("total_citations"), "paper_id")


def cited_papers(g: Graph, source) -> DataFrame:
    """Whom source cites, with the same counts; paragraphs are optional."""
    own = g.sentences.where(F.col("paper_id") == source).select("sentence_id")
    s = own.join(g.sentence_cites, "sentence_id").groupBy("cited_id").agg(F.countDistinct("sentence_id").alias("sentence_citations"))
    paras = g.paragraphs.where(F.col("paper_id") == source).select("paragraph_id")
    p = paras.join(g.paragraph_cites, "paragraph_id").groupBy("cited_id").agg(F.countDistinct("paragraph_id").alias("paragraph_citations"))
    return _totals(s, p, "cited_id", "left").orderBy(F.desc("total_citations"), "cited_id")


def citing_sentences(g: Graph, target, limit: int | None = 100) -> DataFrame:
    """Sentences that cite target, unknown years first, then the latest, then by place."""
    got = g.sentence_cites.where(F.col("cited_id") == target).join(g.sentences, "sentence_id")
    got = got.orderBy(F.desc_nulls_first("year"), F.asc_nulls_last("sentence_index"), "sentence_id")
    return got if limit is None or limit < 0 else got.limit(limit)


def citing_paragraphs(g: Graph, target, limit: int | None = 50, by_count: bool = False) -> DataFrame:
    """Paragraphs that cite target: by year and place, or the most citations first."""
    got = g.paragraph_cites.where(F.col("cited_id") == target).join(g.paragraphs, "paragraph_id")
    year = F.desc_nulls_first("year")
    order = [F.desc("citation_count"), year] if by_count else [year, F.asc_nulls_last("paragraph_index")]
    got = got.orderBy(*order, "paragraph_id")
    return got if limit is None or limit < 0 else got.limit(limit)


def citation_network(g: Graph, paper) -> DataFrame:
    """(direction, other_id, frequency) of what a paper cites and what cites it."""
    out = cited_papers(g, paper).select(F.lit("out").alias("direction"), F.col("cited_id").alias("other_id"), F.col("sentence_citations").alias("frequency"))
    s, _ = _edge_counts(g, F.col("cited_id") == paper, "paper_id")
    return out.unionByName(s.select(F.lit("in").alias("direction"), F.col("paper_id").alias("other_id"), F.col("sentence_citations").alias("frequency")))


def nested_network(network: DataFrame) -> DataFrame:
    """One row: sorted arrays of structs. Only of one paper's network, as its size is that paper's degree."""
    pick = lambda d: F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.struct("other_id", "frequency"))))
    return network.agg(pick("out").alias("cites"), pick("in").alias("cited_by"))


def citation_context_counts(g: Graph, target, sentences: int = 200, paragraphs: int = 100) -> DataFrame:
    """How many sentences and paragraphs a bundle for the target holds."""
    s = citing_sentences(g, target, sentences).agg(F.count("*").alias("total_sentences"))
    return s.crossJoin(citing_paragraphs(g, target, paragraphs).agg(F.count("*").alias("total_paragraphs")))  # one row each


def paper_pairs(g: Graph) -> DataFrame:
    """(citing_id, cited_id, mentions)."""
    return g.sentence_cites.join(g.sentences.select("sentence_id", "paper_id"), "sentence_id").groupBy(F.col("paper_id").alias("citing_id"), "cited_id").agg(F.count("*").alias("mentions"))


def network_overview(g: Graph) -> DataFrame:
    """One row: papers in all, uploaded, stubs; pairs of papers and mentions."""
    n = g.papers.agg(F.count("*").alias("total_papers"), F.count_if(~F.col("stub")).alias("uploaded_papers"), F.count_if("stub").alias("stub_papers"))
    pairs = paper_pairs(g).agg(F.count("*").alias("paper_relations"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("citation_instances"))
    return n.crossJoin(pairs)  # one row each


def stub_ranking(g: Graph, limit: int = 10) -> DataFrame:
    """Stubs by how many papers cite them."""
    by = paper_pairs(g).groupBy("cited_id").agg(F.count("*").alias("cited_by_count"))
    got = g.papers.where("stub").join(by, F.col("paper_id") == F.col("cited_id"), "left").select("paper_id", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))
    return got.orderBy(F.desc("cited_by_count"), "paper_id").limit(limit)


def graph_totals(g: Graph) -> DataFrame:
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    return counted(g.sentences, "sentences").crossJoin(counted(g.paragraphs, "paragraphs")).crossJoin(counted(g.papers, "papers")).crossJoin(counted(g.sentence_cites, "cites"))


def most_cited(g: Graph, kind: DataFrame, limit: int = 10) -> DataFrame:
    """The most cited papers, and how often by each relation type: kind (sentence_id, relation_type)."""
    by = g.sentence_cites.join(kind, "sentence_id").groupBy("cited_id", "relation_type").agg(F.count("*").alias("n"))
    got = by.groupBy("cited_id").agg(F.sum("n").alias("citations"), F.sort_array(F.collect_list(F.struct("relation_type", "n"))).alias("types"))
    return got.orderBy(F.desc("citations"), "cited_id").limit(limit)


#: Pairs that a task sums at the end, about, and that are made and counted together before they are dealt.
PAIRS_A_TASK, PAIRS_AT_ONCE = 1 << 20, 1 << 22


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of rows (items, firsts): each of the first so many items of a row with all after it, equal pairs of about PAIRS_AT_ONCE counted once."""

    def count(parts: list[tuple[pa.ListArray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([x.flatten() for x, _ in parts]).dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        size, firsts = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x, _ in parts]).astype(np.int64), np.concatenate([f for _, f in parts])
        end = np.cumsum(size)
        at = np.repeat(end - size - np.cumsum(firsts) + firsts, firsts) + np.arange(firsts.sum())
        after = np.repeat(end, firsts) - at - 1
        other = np.arange(after.sum()) + np.repeat(at + 1 - np.cumsum(after) + after, after)
        key, n = np.unique(np.repeat(code[at], after) * len(names) + code[other], return_counts=True)
        for i in range(0, len(key), 1 << 16):
            k = key[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(k // len(names))), names.take(pa.array(k % len(names))), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["a", "b", "n"])

    held, pairs = [], 0
    for batch in batches:
        size, firsts = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.list_value_length(batch["items"]), batch["firsts"]))
        total = np.cumsum(firsts * size - firsts * (firsts + 1) // 2)
        begin = 0
        while begin < len(size):
            made = int(total[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, made + PAIRS_AT_ONCE - pairs, "right")))
            held.append((batch["items"].slice(begin, stop - begin), firsts[begin:stop]))
            pairs, begin = pairs + int(total[stop - 1]) - made, stop
            if pairs >= PAIRS_AT_ONCE or begin < len(size):
                yield from count(held)
                held, pairs = [], 0
    if held:
        yield from count(held)


def pair_counts(links: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): in how many groups two items are together; links (group, item), each once, dealt by group already at best, read twice. The pairs are counted first,
    and dealt over as many tasks as they need, so that what a task holds doesn't grow with them. A group is the sorted array of its items; groups with near
    least items are made into pairs by one task, so that pairs that come often are one row before they are dealt."""
    kind = links.schema[item].dataType.simpleString()
    by = links.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group)
    total = by.agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    own, size = by.agg(F.sort_array(F.collect_list(item)).alias("items")), F.size("items").cast("long")
    few = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks, made = (max(min(few, 1 + total // (x >> 4)), -(-total // x)) for x in (PAIRS_A_TASK, PAIRS_AT_ONCE))
    # a long array is cut, by the items that come first in a pair
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(PAIRS_A_TASK) / size))
    cut = own.where(size > 1).select("items", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), size - 2, step)).alias("from"))
    cut = cut.select(F.slice("items", F.col("from").cast("int") + 1, F.size("items")).alias("items"), F.least("step", size - 1 - F.col("from")).alias("firsts"))
    near = cut.repartitionByRange(made, F.get("items", F.lit(0)))
    return near.mapInArrow(_counted, f"a {kind}, b {kind}, n long").repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def co_citation(g: Graph, least: int = 1) -> DataFrame:
    """(a, b, together): pairs of papers and how many papers cite both. The pairs that a citing paper
    makes are as many as the square of its own references, which its length bounds."""
    cites = g.sentence_cites.join(g.sentences.select("sentence_id", "paper_id"), "sentence_id") if g.citing is None else g.citing
    once = cites.select(F.col("paper_id").alias("citing_id"), "cited_id").repartition("citing_id").distinct()
    return pair_counts(once, "citing_id", "cited_id").withColumnRenamed("n", "together").where(F.col("together") >= least)


def influence(g: Graph, limit: int = 20) -> DataFrame:
    """Papers by the number of papers that cite them."""
    return paper_pairs(g).groupBy("cited_id").agg(F.count("*").alias("citing_papers"), F.sum("mentions").alias("mentions")).orderBy(F.desc("citing_papers"), F.desc("mentions"), "cited_id").limit(limit)


def citations_per_year(g: Graph) -> DataFrame:
    return g.sentence_cites.join(g.sentences.select("sentence_id", "year"), "sentence_id").groupBy("year").agg(F.count("*").alias("citations"))


def sentence_paths(g: Graph, target) -> DataFrame:
    """Sentence - paragraph - paper paths that reach target."""
    got = g.sentence_cites.where(F.col("cited_id") == target).join(g.sentences.select("sentence_id", "paragraph_id"), "sentence_id")
    return got.join(g.paragraphs.select("paragraph_id", "paper_id", "section"), "paragraph_id").select("sentence_id", "paragraph_id", "paper_id", "section", "cited_id")


def paper_metadata(papers: DataFrame, paper) -> DataFrame:
    return papers.where(F.col("paper_id") == paper)


def first_containing_paragraph(sentences: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(paper_id, sentence_id, paragraph_id): the first paragraph of the same paper that holds the
    text; "unknown_paragraph" if none does."""
    hit = sentences.alias("s").join(paragraphs.alias("p"), (F.col("s.paper_id") == F.col("p.paper_id")) & F.col("p.text").contains(F.col("s.text")), "left")
    return hit.groupBy("s.paper_id", "s.sentence_id").agg(F.coalesce(F.min_by("p.paragraph_id", "p.paragraph_index"), F.lit("unknown_paragraph")).alias("paragraph_id"))

