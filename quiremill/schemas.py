"""Explicit schemas; nothing is inferred. Years are nullable ints: 0 and "Unknown" become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "id string, title string, authors array<string>, year int, stub boolean, doi string, journal string, publisher string"
PARAGRAPH = "id string, paper_id string, paragraph_index int, section string, text string, citation_count int, sentence_count int, has_citations boolean"
SENTENCE = "id string, paper_id string, paragraph_id string, sentence_index int, text string, has_citations boolean, word_count int, char_count int"
ARGUMENT = "id string, paper_id string, text string, claim_type string, section string, version string, confidence double, custom_tags array<string>"
SENTENCE_CITES = "sentence_id string, cited_id string, citation_text string, citation_context string, confidence double, seq long"
PARAGRAPH_CITES = "paragraph_id string, cited_id string, citation_count int, citation_density double"
RELATES = "from_id string, to_id string, relation_type string, confidence double, version string, seq long"
REFERENCE = "authors array<string>, title string, year string, journal string, publisher string, pub_place string, raw_text string"
REFERENCE_STRUCT = "struct<authors: array<string>, title: string, year: string, journal: string, publisher: string, pub_place: string, raw_text: string>"
ENTITY = "struct<relation_type: string, confidence: double, entity_text: string, start_pos: int, end_pos: int>"
ANALYSIS = f"struct<has_argument_relations: boolean, entities: array<{ENTITY}>>"
CITATION = f"struct<intext: string, reference: {REFERENCE_STRUCT}, paper_id: string, confidence: double, argument_analysis: {ANALYSIS}>"
SENTENCE_LINE = f"sentence_index int, sentence_text string, citations array<{CITATION}>, word_count int, char_count int, error string, argument_analysis {ANALYSIS}"
PARAGRAPH_LINE = "paragraph_index int, paragraph_text string, section string, sentence_count int"
SECTION_LINE = "section_index int, section_title string, section_text string, section_type string, paragraph_count int"
METADATA = "title string, authors array<string>, year string, doi string, journal string, publisher string, abstract string, url string, type string, volume string, issue string, pages string, issn string, extraction_method string"
AUTHORS = "id long, name string, normalized_name string"
AUTHOR_PAPERS = "author_id long, paper_id string, author_position int"
POINT = (
    "id string, collection string, vector array<float>, paper_id string, text string, title string, authors array<string>, year string, doi string, journal string, publisher string, "
    "sentence_index int, sentence_type string, paragraph_index int, section string, citation_count int, sentence_count int, has_citations boolean, "
    "section_index int, section_title string, section_type string, paragraph_count int, citation_index int, cited_paper_id string, citation_context string, confidence double"
)
PROGRESS = "path string, status string, directory string, paper_id string, total_sentences int, total_citations int, completed_at timestamp, error string"
TURN = "conv_id long, turn long, role string, text string"

# Claim types and relation types.
CLAIM_TYPES = ("CLAIM_MAIN", "CLAIM_SUPPORTING", "EVIDENCE_EMPIRICAL", "EVIDENCE_THEORETICAL", "EVIDENCE_LITERATURE", "COUNTERARGUMENT", "REBUTTAL", "CONTEXT_LIMITATION", "METHODOLOGY", "ASSUMPTION", "QUESTION_MOTIVATION", "FUTURE_WORK", "NEUTRAL", "NON_ARGUMENT")

RELATION_TYPES = ("CITES", "SUPPORTS", "REFUTES", "ELABORATES", "QUALIFIES", "EXTENDS", "CONTRASTS", "REPEATS", "INSPIRED_BY", "USES_METHOD_OF")


def types_of(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    """Claim or relation types as rows, to be upserted by id: (id, label, is_default, is_deprecated)."""
    return spark.createDataFrame([(n, n.replace("_", " ").capitalize(), True, False) for n in names], "id string, label string, is_default boolean, is_deprecated boolean")


def year(raw: Column) -> Column:
    """A year as stored anywhere (text, number, 0, "Unknown") as a nullable int."""
    return F.nullif(F.regexp_extract(raw.cast("string"), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int"), F.lit(0))
