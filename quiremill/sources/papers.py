"""Reading and writing of processed papers, metadata, and their sources.

Extraction of PDF text and calls to services are adapters: a function from bytes to fields, given
by the caller, that runs on the executors in batches; failures are rows with an error, not failed jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", content: bool = True) -> DataFrame:
    """Files below a folder: path, length, modificationTime, and content if asked for."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return got if content else got.drop("content")


def extract(files: DataFrame, engines: Sequence[tuple[str, Callable[[bytes], str]]]) -> DataFrame:
    """(path, engine, text, error): each engine's text of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                for name, engine in engines:
                    try:
                        rows.append((path, name, engine(bytes(raw)), None))
                    except Exception as e:  # an adapter may fail in any way; the row says how
                        rows.append((path, name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "engine", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, engine string, text string, error string")


def best_engine(extracted: DataFrame, bonus: dict[str, float] | None = None) -> DataFrame:
    """The text of the best quality of each file, the first engine by name among equals."""
    extra = F.coalesce(*(F.when(F.col("engine") == k, F.lit(float(v))) for k, v in (bonus or {"": 0.0}).items()), F.lit(0.0))
    scored = extracted.withColumn("quality", X.quality_score(F.coalesce("text", F.lit("")), extra))
    return scored.groupBy("path").agg(F.max_by(F.struct("engine", "text", "error", "quality"), F.struct("quality", F.col("text").isNotNull())).alias("r")).select("path", "r.*")


def from_filename(path: Column) -> Column:
    """struct(title, authors, year) by three forms: "Author - Year - Title", "Author_Year_Title", "Title (Year)"."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    dashed, under, bracket = r"^(.+?)\s+-\s+((?:19|20)\d{2})\s+-\s+(.+)$", r"^([^_]+)_((?:19|20)\d{2})_(.+)$", r"^()(?=.*\(((?:19|20)\d{2})\))(.+?)\s*\(.*$"
    pick = lambda group: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(name, p, group)), F.lit("")) for p in (dashed, under, bracket)))
    title = F.coalesce(F.translate(pick(3), "_", " "), F.translate(name, "_", " "))
    return F.struct(title.alias("title"), F.when(pick(1).isNotNull(), F.array(pick(1))).alias("authors"), pick(2).alias("year"))


def crossref(json: Column) -> Column:
    """struct(title, authors, year, journal, publisher, doi) of a CrossRef answer."""
    date = "struct<`date-parts`: array<array<int>>>"
    m = F.from_json(json, f"message struct<title: array<string>, author: array<struct<given: string, family: string>>, `container-title`: array<string>, publisher: string, DOI: string, `published-print`: {date}, `published-online`: {date}, created: {date}>")["message"]
    at = lambda c: F.try_element_at(F.try_element_at(m[c]["date-parts"], F.lit(1)), F.lit(1))
    return F.struct(
        F.try_element_at(m["title"], F.lit(1)).alias("title"),
        F.transform(m["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"),
        F.coalesce(at("published-print"), at("published-online"), at("created")).cast("string").alias("year"),
        F.try_element_at(m["container-title"], F.lit(1)).alias("journal"),
        m["publisher"].alias("publisher"), m["DOI"].alias("doi"),
    )


def tei_header(xml: Column) -> Column:
    """struct(title, authors, year) of a TEI header without name spaces."""
    x = F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', "")
    surname = F.xpath(x, F.lit("//sourceDesc//author/persName/surname/text()"))
    given = F.xpath(x, F.lit("//sourceDesc//author/persName/forename[1]/text()"))
    return F.struct(
        F.nullif(F.xpath_string(x, F.lit("//titleStmt/title")), F.lit("")).alias("title"),
        F.zip_with(given, surname, lambda g, s: F.concat_ws(" ", g, s)).alias("authors"),
        F.nullif(F.regexp_extract(F.xpath_string(x, F.lit("//publicationStmt//date/@when")), r"(\d{4})", 1), F.lit("")).alias("year"),
    )


def tei_references(xml: Column) -> Column:
    """array<struct(ref_no, title, surnames, year)> of a TEI list of references."""
    x = F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', "")
    parsed = F.from_xml(x, "text struct<back: struct<div: struct<listBibl: struct<biblStruct: array<struct<analytic: struct<title: string, author: array<struct<persName: struct<surname: string>>>>, monogr: struct<title: string, imprint: struct<date: struct<_when: string>>>>>>>>>", {"rowTag": "TEI"})
    each = parsed["text"]["back"]["div"]["listBibl"]["biblStruct"]
    return F.transform(each, lambda b, i: F.struct(i.alias("ref_no"), F.coalesce(b["analytic"]["title"], b["monogr"]["title"]).alias("title"), F.transform(b["analytic"]["author"], lambda a: a["persName"]["surname"]).alias("surnames"), F.substring(b["monogr"]["imprint"]["date"]["_when"], 1, 4).alias("year")))


def is_valid_metadata(title: Column, authors: Column, year: Column, now: Column) -> Column:
    y = schemas.year(year)
    known = F.exists(authors, lambda a: ~F.lower(F.trim(a)).isin("", "unknown", "unknown author"))
    return F.coalesce((F.length(F.trim(title)) >= 5) & known & y.between(1900, now + 1), F.lit(False))


def cascade(candidates: Sequence[tuple[str, Column]], now: Column) -> Column:
    """The first valid of named structs (title, authors, year), with extraction_method; else the last."""
    named = [F.struct(*(c[f].alias(f) for f in ("title", "authors", "year")), F.lit(n).alias("extraction_method")) for n, c in candidates]
    tested = [F.when(is_valid_metadata(c["title"], c["authors"], c["year"], now), s) for (_, c), s in zip(candidates, named, strict=True)]
    return F.coalesce(*tested, named[-1])


def read_processed(spark: SparkSession, path: str, files: str = "*.jsonl") -> DataFrame:
    """Sentence lines (JSON lines) with the paper they belong to, by their folder (<id> or <name>=<id>)."""
    got = spark.read.schema(schemas.SENTENCE_LINE).json(path, recursiveFileLookup=True, pathGlobFilter=files)
    return got.withColumn("paper_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+$", 1))


def read_metadata(spark: SparkSession, path: str, files: str = "metadata.json") -> DataFrame:
    got = spark.read.schema(schemas.METADATA).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter=files)
    return got.withColumn("paper_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+$", 1))


def read_examples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_sentences(sentences: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet with lengths and word counts; sorted by paper within files, so that statistics prune."""
    s = F.col("sentence_text")
    sentences.withColumn("char_count", X.char_count(s)).withColumn("word_count", X.word_count(s)).sortWithinPartitions("paper_id", "sentence_index").write.mode(mode).parquet(path)


def write_trace(trace: DataFrame, path: str, order: str = "at", most: int = 1000) -> None:
    """The last rows of a trace as JSON lines."""
    trace.orderBy(F.desc(order)).limit(most).write.mode("overwrite").json(path)


def import_new(documents: DataFrame, done: DataFrame, key: str = "paper_id") -> DataFrame:
    return documents.join(done.select(key), key, "left_anti")


def is_scanned(pages: DataFrame) -> DataFrame:
    """(path, is_scanned) of pages (path, page_no, text, images): of the first five, over 0.6 have less than
    100 characters and over 0.3 have pictures."""
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < 100
    got = pages.where("page_no < 5").groupBy("path").agg(F.avg(short.cast("int")).alias("low"), F.avg((F.col("images") > 0).cast("int")).alias("pictured"))
    return got.select("path", ((F.col("low") > 0.6) & (F.col("pictured") > 0.3)).alias("is_scanned"))


def quality_level(score: Column, has_references: Column) -> Column:
    return F.when((score >= 7) & has_references, "excellent").when((score >= 5) & has_references, "good").when(score >= 3, "fair").otherwise("poor")


# What to do about a document, if the test before it holds.
ADVICE = (
    ("PDF text extraction quality is low - consider manual preprocessing", lambda score, found, n, doi: score < 3),
    ("No references extracted - check GROBID service and PDF format", lambda score, found, n, doi: ~found),
    ("Few references found - document may not be a research paper", lambda score, found, n, doi: n < 5),
    ("No DOI found - metadata quality may be limited", lambda score, found, n, doi: ~doi),
)
NO_ADVICE = "Document appears suitable for citation analysis"


def recommendations(score: Column, has_references: Column, references: Column, has_doi: Column) -> Column:
    found = F.filter(F.array(*(F.when(test(score, has_references, references, has_doi), text) for text, test in ADVICE)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_ADVICE)))


def diagnose(pages: DataFrame, references: DataFrame) -> DataFrame:
    """(path, is_scanned, score, quality_level, recommendations) of pages (path, page_no, text, images) and
    references (path, n_references, has_doi); a file's own pages bound its text."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n")
    score = pages.groupBy("path").agg(whole.alias("text")).select("path", X.quality_score(F.col("text")).alias("score"))
    got = score.join(is_scanned(pages), "path", "left").join(references, "path", "left")
    n, doi = F.coalesce("n_references", F.lit(0)), F.coalesce("has_doi", F.lit(False))
    return got.select("path", "is_scanned", "score", quality_level(F.col("score"), n > 0).alias("quality_level"), recommendations(F.col("score"), n > 0, n, doi).alias("recommendations"))


#: Tables of processed papers, the column that orders a paper's rows in each, and their schemas.
STORED = {
    "sentences": ("sentence_index", schemas.SENTENCE_LINE), "metadata": ("title", schemas.METADATA),
    "paragraphs": ("paragraph_index", schemas.PARAGRAPH_LINE), "sections": ("section_index", schemas.SECTION_LINE),
}


def write_processed(path: str, **tables: DataFrame) -> None:
    """Sentences, metadata, paragraphs and sections of papers, those that are given, each as few large files sorted by paper."""
    for name, rows in tables.items():
        order, _ = STORED[name]
        rows.repartitionByRange("paper_id", order).sortWithinPartitions("paper_id", order).write.mode("append").parquet(f"{path}/{name}")


def read_stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(f"{STORED[name][1]}, paper_id string").parquet(f"{path}/{name}")


def export_folders(lines: DataFrame, metadata: DataFrame, path: str) -> None:
    """A folder a paper below sentences/ and metadata/, which read_processed() and read_metadata() read
    with files="*.json"; sentence lines in order. For few papers: each is a folder and a file."""
    body = lines.select(*(F.col(c) for c in lines.columns if c != "paper_id"), F.col("paper_id").alias("p")).repartition("p").sortWithinPartitions("p", "sentence_index")
    body.write.partitionBy("p").mode("append").json(f"{path}/sentences")
    metadata.withColumn("p", F.col("paper_id")).drop("paper_id").repartition("p").write.partitionBy("p").mode("append").json(f"{path}/metadata")
