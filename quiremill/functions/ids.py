"""Identity of papers: a hash of the normalised title and year. Authors play no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for no title, no author.
NO_TITLE = ("unknown title", "unknown", "", "none")
NO_AUTHOR = ("unknown author", "unknown", "", "none")


def normalize_title(title: Column) -> Column:
    kept = F.regexp_replace(title, r"(?U)[^\w\s]", "")
    kept = F.lower(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")))
    missing = title.isNull() | F.lower(F.trim(title)).isin(*NO_TITLE) | (kept == "")
    return F.when(missing, "unknown_title").otherwise(kept)


def normalize_year(year: Column) -> Column:
    found = F.regexp_extract(year.cast("string"), r"(?U)\b((?:19|20)\d{2})\b", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "unknown_year").otherwise(found)


def normalize_authors(authors: Column) -> Column:
    """One string of authors, parted by , ; or "and", as an array of clean lower-case names."""
    parts = F.transform(F.split(authors, r"[,;]|and\s+"), lambda a: F.lower(F.trim(F.regexp_replace(F.regexp_replace(a, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))))
    kept = F.filter(parts, lambda a: ~a.isin(*NO_AUTHOR))
    return F.when(authors.isNull() | (F.size(kept) == 0), F.array(F.lit("unknown_author"))).otherwise(kept)


def paper_id(title: Column, year: Column) -> Column:
    return F.sha2(F.concat_ws("_", normalize_title(title), normalize_year(year)), 256)


def is_paper_id(value: Column) -> Column:
    return F.coalesce(value.rlike("(?i)^[0-9a-f]{64}$"), F.lit(False))


def same_paper(title_a: Column, year_a: Column, title_b: Column, year_b: Column) -> Column:
    return paper_id(title_a, year_a) == paper_id(title_b, year_b)


def author_key(name: Column) -> Column:
    return F.lower(F.trim(name))
