"""Questions to the text of papers: keywords in context, whole texts, chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .vectors import dot, embed, embed_text, literal


#: Hits that kwic() holds at a time.
HITS_AT_ONCE = 1024


def kwic(sections: DataFrame, query: str, window: int = 500, text: str = "text") -> DataFrame:
    """One row an occurrence: place, the stripped context, and where the query lies in the context
    before stripping. The text itself stays behind, as each of its hits would carry it. Python holds few contexts at a time."""
    rest = [c for c in sections.columns if c != text]
    kinds = [f"`{c}` {sections.schema[c].dataType.simpleString()}" for c in rest]
    q, half = query.lower(), window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, low = b.column(len(rest)), b.column(len(rest) + 1)
            at, found = [], []

            def made() -> pa.RecordBatch:
                kept = [b.column(i).take(pa.array(at, pa.int64())) for i in range(len(rest))]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
                return pa.RecordBatch.from_arrays([*kept, *columns], [*rest, "position", "highlight_start", "highlight_end", "context"])

            for i in range(len(b)):
                t, x = whole[i].as_py(), low[i].as_py()
                for place in X.places(x, q) if t is not None else ():
                    start = max(0, place - half)
                    at.append(i)
                    found.append((place, place - start, place - start + len(query), t[start : place + len(q) + half].strip(" ")))
                    if len(at) >= HITS_AT_ONCE:
                        yield made()
                        at, found = [], []
            if at:
                yield made()

    # without a query no text has a hit
    rows = sections.select(*rest, F.col(text), F.lower(text).alias("__low")) if q else sections.select(*rest, F.col(text), F.lower(text).alias("__low")).limit(0)
    return rows.mapInArrow(run, ", ".join([*kinds, "position int, highlight_start int, highlight_end int, context string"]))


def full_text(sections: DataFrame, key: str = "paper_id", order: str = "section_index") -> DataFrame:
    """Each paper's sections as "## title", blank line, text. A paper's own length bounds the row."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("text"))
    got = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, part.alias("p")))).alias("a"), F.sum(X.word_count(F.col("text"))).alias("total_word_count"))
    whole = F.array_join(F.transform("a", lambda x: x["p"]), "\n\n")
    return got.select(key, whole.alias("full_text"), X.truncate(whole, 200).alias("preview"), "total_word_count", F.size("a").alias("sections"))


def chunks(sections: DataFrame, text: str = "text") -> DataFrame:
    """Sections of up to 1000 characters whole; longer ones as stripped pieces between blank lines of over 50."""
    cut = F.when(F.length(text) <= 1000, F.array(text)).otherwise(F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 50))
    return sections.select(*(c for c in sections.columns if c != text), F.posexplode(cut).alias("chunk", "chunk_text"))


def semantic(sections: DataFrame, query: str, threshold: float = 0.5, k: int = 10, model=embed, vector=embed_text) -> DataFrame:
    """Chunks at least so similar to the query, the best k. model: embeds a column, vector the query;
    without a model, keyword hits instead."""
    if model is None:
        return kwic(sections, query)
    got = chunks(sections).withColumn("similarity", dot(model("chunk_text"), literal(vector(query)))).where(F.col("similarity") >= threshold)
    return got.orderBy(F.desc("similarity"), "chunk", "chunk_text").limit(k)


def content_of(papers: DataFrame, matches: DataFrame, sections: DataFrame, query: str, window: int = 500) -> DataFrame:
    """Keyword hits in the papers that a title or author resolved to."""
    own = sections.join(matches.select("paper_id").distinct(), "paper_id", "left_semi")
    return kwic(own, query, window).join(papers.select("paper_id", F.col("title").alias("paper_title")), "paper_id")


def word_overlap(docs: DataFrame, items: DataFrame, doc: str, item: str, share: float = 0.7, over: int = 5) -> DataFrame:
    """(doc, item, shared): pairs that share more than over different words and more than that share
    of the item's. Any such pair has one of the item's rarest words in common, of which so many are
    taken that the others alone would not be enough; only these words are joined on, so common
    words pair nothing. docs and items: (key, text)."""
    bag = lambda df, key: df.select(key, F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    a, b = bag(docs, doc), bag(items, item)
    each, asked = a.select(doc, F.explode("words").alias("w")), b.select(item, F.size("words").alias("m"), F.explode("words").alias("w"))
    known = each.join(asked.select("w").distinct(), "w", "left_semi")
    often = known.groupBy("w").agg(F.count("*").alias("df"))
    rare = asked.join(often, "w").withColumn("n", F.row_number().over(Window.partitionBy(item).orderBy("df", "w")))
    rare = rare.where(F.col("n") <= F.floor(F.col("m") * (1 - share)) + 1).select(item, "w")
    pairs = known.join(rare, "w").select(doc, item).distinct()
    both = pairs.join(a.withColumnRenamed("words", "x"), doc).join(b.withColumnRenamed("words", "y"), item)
    got = both.select(doc, item, F.size(F.array_intersect("x", "y")).alias("shared"), F.size("y").alias("m"))
    return got.where((F.col("shared") > over) & (F.col("shared") / F.col("m") > share)).drop("m")


def stripped(text):
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal(text, strip: bool = True):
    """Lower case, white space as one space, anything but words and common punctuation as a space. strip: False for what is stripped already."""
    text = stripped(text) if strip else text
    # a run of space and other characters becomes one space at once; the commonest of what stays is named first
    return F.lower(F.regexp_replace(text, r"(?U)[^a-zA-Z0-9\w()\[\],.]+", " "))


def paragraph_sentences(paragraphs: DataFrame, sentences: DataFrame, of_paragraph: Sequence[str] = (), of_sentence: Sequence[str] = (), every: bool = False) -> DataFrame:
    """(paper_id, paragraph_id, sentence_id, rule): which sentences a paragraph holds. 1: the sentence is
    part of it. Else, by the length of the sentence, 2 (over 100): it holds the middle half of a
    paragraph of over 10 words; 3 (31 to 100): it has over 5 different words, and the paragraph over
    0.7 of them. Else 4: a citation of the sentence is part of the paragraph; 5 (over 50): five of its
    words in a row are. Joined within a paper only; null texts count as empty. What a side alone decides is made before the join.
    of_paragraph, of_sentence: further columns to bring along. every: paragraphs that hold no sentence stay, with a null rule; all are dealt by paper
    as they are given, as what is made of them takes more room than they do."""
    text = F.coalesce("text", F.lit(""))
    p, s = paragraphs.select("paper_id", "paragraph_id", *of_paragraph, "text"), sentences.select("paper_id", "sentence_id", *of_sentence, "intexts", "text")
    if every:
        p, s = p.repartition("paper_id"), s.repartition("paper_id")
    p = p.withColumn("p", normal(text)) if every else p.select("paper_id", "paragraph_id", *of_paragraph, normal(text).alias("p"))
    s = s.select("paper_id", "sentence_id", *of_sentence, F.coalesce("intexts", F.array().cast("array<string>")).alias("intexts"), normal(text).alias("s"))
    # normal() leaves single spaces only
    spaced = lambda c: F.array_remove(F.split(c, " "), "")
    p = p.withColumn("pw", spaced("p"))
    n, size = F.size("pw"), F.length("s")
    first = F.floor(n / 4).cast("int")
    middle = F.array_join(F.slice("pw", first + 1, F.greatest(F.floor(n * 3 / 4).cast("int") - first, F.lit(0))), " ")
    p = p.withColumn("middle", F.when(n > 10, middle)).withColumn("middle", F.when(F.length("middle") > 30, F.col("middle")))
    s = s.withColumn("sw", F.when(size > 30, spaced("s")))
    grams = F.transform(F.sequence(F.lit(1), F.size("sw") - 4), lambda i: F.array_join(F.slice("sw", i, 5), " "))
    trimmed = F.filter(F.transform("intexts", stripped), lambda c: F.length(c) > 3)
    s = s.withColumn("sd", F.when((size > 30) & (size <= 100), F.array_distinct("sw"))).withColumn("said", F.transform(trimmed, lambda c: normal(c, strip=False)))
    s = s.withColumn("grams", F.when((size > 50) & (F.size("sw") >= 5), F.filter(grams, lambda g: F.length(g) > 20))).drop("sw", "intexts")
    shared = F.size(F.array_intersect("sd", "pw"))
    rule = (
        F.when(F.col("p").contains(F.col("s")), 1)
        .when((size > 100) & F.col("s").contains(F.col("middle")), 2)
        .when((size > 30) & (size <= 100) & (F.size("sd") > 5) & (shared / F.size("sd") > 0.7), 3)
        .when(F.exists("said", lambda c: F.col("p").contains(c)), 4)
        .when((size > 50) & F.exists("grams", lambda g: F.col("p").contains(g)), 5)
    )
    if every:
        both = p.join(s.withColumnRenamed("paper_id", "__of"), (F.col("paper_id") == F.col("__of")) & rule.isNotNull(), "left")
        return both.select("paper_id", "paragraph_id", "sentence_id", F.when(F.col("__of").isNotNull(), rule).alias("rule"), *of_paragraph, "text", *of_sentence)
    both = p.join(s, "paper_id").withColumn("rule", rule)
    return both.where("rule is not null").select("paper_id", "paragraph_id", "sentence_id", "rule", *of_paragraph, *of_sentence)


def paragraph_citation_counts(paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """(paper_id, paragraph_id, citation_count): citations of all sentences that a paragraph holds, 0 without any."""
    n = sentences.select("paper_id", "sentence_id", F.greatest(F.size(F.coalesce("intexts", F.array().cast("array<string>"))), F.lit(0)).alias("n"))
    held = paragraph_sentences(paragraphs, sentences).join(n, ["paper_id", "sentence_id"]).groupBy("paper_id", "paragraph_id").agg(F.sum("n").alias("n"))
    return paragraphs.select("paper_id", "paragraph_id").join(held, ["paper_id", "paragraph_id"], "left").select("paper_id", "paragraph_id", F.coalesce("n", F.lit(0)).cast("long").alias("citation_count"))


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_index, title, text): lines from one heading to the next; what comes first is section 0."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("section_index", F.sum(F.col("line").rlike(r"^#{1,6}\s+").cast("int")).over(w))
    got = lines.groupBy(key, "section_index").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("a"))
    body = F.transform("a", lambda x: x["line"])
    head = F.element_at(body, 1)
    is_head = head.rlike(r"^#{1,6}\s+")
    rest = F.when(is_head, F.slice(body, 2, F.size(body))).otherwise(body)
    return got.select(key, "section_index", F.when(is_head, F.trim(F.regexp_replace(head, r"^#{1,6}\s+", ""))).otherwise("").alias("title"), F.trim(F.array_join(rest, "\n")).alias("text"))


def lines_to_blocks(lines: DataFrame, keys: Sequence[str], y: str = "y", gap: float = 20.0) -> DataFrame:
    """lines with block: a new one where the distance to the line before is over gap."""
    w = Window.partitionBy(*keys).orderBy(y)
    new = F.coalesce((F.col(y) - F.lag(y).over(w) > gap).cast("int"), F.lit(0))
    return lines.withColumn("__new", new).withColumn("block", F.sum("__new").over(w)).drop("__new")


def headings_to_sections(blocks: DataFrame, keys: Sequence[str], order: str, is_heading) -> DataFrame:
    """blocks with section_index and the title of the heading before them."""
    w = Window.partitionBy(*keys).orderBy(order)
    return blocks.withColumn("__h", is_heading).withColumn("section_index", F.sum(F.col("__h").cast("int")).over(w)).withColumn("section_title", F.last(F.when(F.col("__h"), F.col("text")), ignorenulls=True).over(w)).drop("__h")
