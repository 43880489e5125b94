"""In-text citations and their match with a list of references.

A citation ends at a year. For "Names (2020)" the scanner walks back from the parenthesis, word by
word, as long as the words can belong to names: capitalised words and particles, "and" or "&",
"et al."; a comma is crossed only in a list that closes with "and". Inside parentheses and brackets
the content is cut at semicolons and after a year, introductions like "see" or "e.g." are dropped,
and what stands before the year must be names.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ANALYSIS, CITATION
from .ids import paper_id
from .text import char_count, clean_sentence, word_count

YEAR = r"\d{4}[a-z]?"
NARRATIVE = re.compile(rf"\(({YEAR})(?:\s*:[^)]*)?\)")
GROUP = re.compile(r"\(([^()]+)\)|\[([^\[\]]+)\]")
INTRO = re.compile(r"^(?:see|e\.g\.?,?|cf\.?|i\.e\.?,?|also|for example,?)\s+", re.I)
NEXT = re.compile(rf"(?<=\d)([a-z]?),\s*(?=[^\W\d_])")
DATED = re.compile(rf"^(.*?),?\s*({YEAR})(?![\w])")
JOINS = {"and", "&"}
# Words that start sentences or name things, and are no authors.
FIRST_WORDS = (
    "the", "a", "an", "by", "in", "on", "at", "of", "for", "with", "from", "to",
    "year", "data", "study", "research", "work", "paper", "article", "results", "result",
    "findings", "finding", "figure", "table", "chapter", "section", "appendix",
    "e.g", "i.e", "see", "also", "note", "equation", "fig", "tbl", "et", "al", "vs",
    "versus", "cf", "according", "recent", "and", "as", "based",
    "while", "noted", "methodology", "approach", "proposed", "developed",
)
#: A word of the same kind that the scanner, which looks at single words, needs besides.
NO_NAMES = frozenset((*FIRST_WORDS, "studies"))


def _is_name(word: str) -> bool:
    """A capitalised word, perhaps with apostrophes, hyphens, full stops."""
    bare = word.strip(".,'-’")
    if not bare or not all(unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Mn" or c in ".'-’" for c in bare):
        return False
    return unicodedata.category(bare[0]) in ("Lu", "Lt") or any(unicodedata.category(c) == "Lu" for c in bare)


def _may_open(words: list[str]) -> bool:
    return bool(words) and words[0].lower().strip(".,") not in NO_NAMES


def _valid(author: str) -> bool:
    """Names, joined by commas, "and", "&" or followed by "et al."."""
    words = author.split()
    if not _may_open(words) or author.lower().endswith(" et"):
        return False
    if not any(unicodedata.category(c)[0] == "L" for c in author) or sum(c.isdigit() for c in author) * 2 > len(author):
        return False
    upper = [c for c in author if unicodedata.category(c) == "Lu"]
    letters = [c for c in author if unicodedata.category(c)[0] == "L"]
    if len(upper) == len(letters) and len(author) > 5 and " " not in author:
        return False
    return bool(upper)


def _names_before(text: str) -> str:
    """The names that the text ends with, or nothing."""
    words = text.split()
    taken: list[str] = []
    i = len(words) - 1
    if i >= 1 and words[i].rstrip(",").lower() in ("al.", "al") and words[i - 1].lower() == "et":
        taken, i = [words[i - 1], words[i]], i - 2
    joined = False  # whether an "and" is among the words taken: then commas part names
    while i >= 0:
        w = words[i]
        if w.lower() in JOINS:
            if joined or not taken:
                break
            joined = True
        elif w.endswith(","):
            if not joined or not _is_name(w):
                break
        elif not _is_name(w) or w[-1] in ".;:!?" and len(w.strip(".")) > 2 or w.lower().strip(".") in NO_NAMES:
            break
        taken.insert(0, w)
        i -= 1
    while taken and (taken[0].lower() in JOINS or not _may_open(taken)):
        taken = taken[1:]
    author = " ".join(taken).strip(",")
    return author if author and author.lower() not in ("et al.", "et al") and _valid(author) else ""


def _within(content: str) -> list[tuple[str, str]]:
    """(author, year) of each citation inside parentheses."""
    out = []
    for piece in content.split(";"):
        for part in NEXT.sub(lambda m: m[1] + "\0", piece).split("\0"):
            part = part.strip()
            while intro := INTRO.match(part):
                part = part[intro.end() :]
            if m := DATED.match(part):
                author = " ".join(m[1].split()).rstrip(",").strip()
                if author and _valid(author):
                    out.append((author, m[2]))
    return out


def citations(sentence: str | None) -> list[str]:
    """All citations of a sentence as "(Author, YYYY)", each once, sorted."""
    found: set[tuple[str, str]] = set()
    text = sentence or ""
    for m in NARRATIVE.finditer(text):
        if author := _names_before(text[: m.start()].rstrip() if text[: m.start()].strip() else ""):
            found.add((author, m[1]))
    for m in GROUP.finditer(text):
        found.update(_within(m[1] or m[2]))
    return sorted(f"({a}, {y})" for a, y in found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_citations(s: pd.Series) -> pd.Series:
    return s.map(citations)


def intext_key(intext: Column) -> Column:
    """struct(surname, year): the last word of the first name group, and the four digits."""
    inner = F.regexp_replace(F.regexp_replace(intext, r"^[(\[]|[)\]]$", ""), r",?\s*\d{4}[a-z]?.*$", "")
    group = F.trim(F.regexp_replace(F.element_at(F.split(inner, ","), 1), r"(?i)\s+et\s+al\.?$", ""))
    surname = F.regexp_replace(F.element_at(F.split(group, r"\s+"), -1), r"(?U)[^\w\s\-']", "")
    return F.struct(surname.alias("surname"), F.regexp_extract(intext, r"(\d{4})", 1).alias("year"))


def match_references(cites: DataFrame, references: DataFrame) -> DataFrame:
    """cites (doc, intext, ...) with the first reference (doc, ref_no, authors, year, ...) of the same
    document that has the surname among its authors and exactly the year; unmatched ones go."""
    keyed = references.withColumn("author", F.explode("authors"))
    keyed = keyed.select("doc", "ref_no", F.regexp_replace(F.element_at(F.split(F.trim("author"), r"\s+"), -1), r"(?U)[^\w\s\-']", "").alias("surname"), F.col("year").alias("ref_year"))
    first = keyed.groupBy("doc", "surname", "ref_year").agg(F.min("ref_no").alias("ref_no"))
    asked = cites.withColumn("__k", intext_key(F.col("intext")))
    on = (F.col("__k.surname") == first["surname"]) & (F.col("__k.year") == first["ref_year"]) & (asked["doc"] == first["doc"])
    return asked.join(first, on).select(*(asked[c] for c in cites.columns), first["ref_no"])


def parse_document(sentences: DataFrame, references: DataFrame) -> DataFrame:
    """(doc, sentence_index, intext, ref_no): sentences (doc, sentence_index, text) without a match go."""
    each = sentences.select("doc", "sentence_index", F.explode(extract_citations("text")).alias("intext"))
    return match_references(each, references)


@F.pandas_udf(T.StructType([T.StructField("found", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def _analyzed(s: pd.Series) -> pd.DataFrame:
    rows = []
    for x in s:
        try:
            rows.append((citations(x), None))
        except Exception as e:  # a sentence that can't be read is a row that says so
            rows.append(([], f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["found", "error"])


def analyze_sentences(sentences: DataFrame, references: DataFrame) -> DataFrame:
    """Lines (paper_id, schemas.SENTENCE_LINE) of sentences (paper_id, sentence_index, text): each with the citations that match a reference
    (paper_id, ref_no, authors, title, year, journal, publisher) of the same paper, by intext. A sentence whose analysis fails has no
    citations and the error. Citations of a sentence are gathered in its row, nothing of a whole paper is."""
    rows = sentences.select("paper_id", "sentence_index", clean_sentence(F.coalesce("text", F.lit(""))).alias("sentence_text"), _analyzed(F.coalesce("text", F.lit(""))).alias("a"))
    each = rows.select(F.col("paper_id").alias("doc"), "sentence_index", F.explode("a.found").alias("intext"))
    hits = match_references(each, references.withColumnRenamed("paper_id", "doc")).join(references.withColumnRenamed("paper_id", "doc"), ["doc", "ref_no"])
    have = lambda c, kind="string": (F.col(c) if c in references.columns else F.lit(None)).cast(kind).alias(c)
    reference = F.struct(F.col("authors"), have("title"), have("year"), have("journal"), have("publisher"), have("pub_place"), have("raw_text"))
    citation = F.struct("intext", reference.alias("reference"), paper_id(F.col("title"), F.col("year")).alias("paper_id"), F.lit(1.0).alias("confidence"), F.lit(None).cast(ANALYSIS).alias("argument_analysis"))
    cited = hits.groupBy(F.col("doc").alias("paper_id"), "sentence_index").agg(F.sort_array(F.collect_list(F.struct("intext", citation.alias("c")).alias("x"))).alias("cs"))
    got = rows.join(cited.select("paper_id", "sentence_index", F.transform("cs", lambda x: x["c"]).alias("citations")), ["paper_id", "sentence_index"], "left")
    none = F.array().cast(f"array<{CITATION}>")
    return got.select("paper_id", F.col("sentence_index").cast("int").alias("sentence_index"), "sentence_text", F.coalesce(F.col("citations").cast(f"array<{CITATION}>"), none).alias("citations"), word_count(F.col("sentence_text")).alias("word_count"), char_count(F.col("sentence_text")).alias("char_count"), F.col("a.error").alias("error"), F.lit(None).cast(ANALYSIS).alias("argument_analysis"))


def distinct_by_key(cites: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by order of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return cites.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
