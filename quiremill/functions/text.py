"""Text rules as column expressions. All but the search for occurrences stay inside the JVM and code generation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("et al.", "vs.", "pp.", "Vol.", "No.", "Fig.", "Tab.", "Dr.", "Prof.", "Mr.", "Ms.", "Mrs.")
# Words in a heading that tell the kind of section, the first kind that fits.
SECTION_WORDS = (
    ("abstract", ("abstract",)), ("introduction", ("introduction", "background")),
    ("literature_review", ("literature", "related work", "prior")), ("methodology", ("method", "approach", "design")),
    ("results", ("result", "finding", "analysis")), ("discussion", ("discussion",)),
    ("conclusion", ("conclusion", "summary")), ("references", ("reference", "bibliography")),
)
# Pieces of text that vote for a language, in the order that decides ties.
LANGUAGES = {
    "zh": ("的", "是", "在", "了", "和", "有", "我", "你", "他", "她", "论文", "引用", "作者"),
    "fr": ("le", "la", "les", "un", "une", "de", "du", "des", "et", "ou", "qui", "que"),
    "de": ("der", "die", "das", "und", "oder", "ist", "sind", "ein", "eine", "mit", "zu"),
    "es": ("el", "la", "los", "las", "un", "una", "de", "del", "y", "o", "que", "es"),
    "it": ("il", "la", "lo", "gli", "le", "un", "una", "di", "del", "e", "o", "che"),
    "ja": ("の", "は", "が", "を", "に", "で", "と", "から", "まで", "論文", "引用"),
    "ko": ("이", "가", "을", "를", "에", "의", "는", "은", "와", "과", "논문", "인용"),
    "pt": ("o", "a", "os", "as", "um", "uma", "de", "do", "da", "e", "ou", "que"),
    "ru": ("и", "в", "на", "с", "по", "за", "от", "до", "для", "из", "при"),
}
# Patterns of running headers and footers of a sentence.
SENTENCE_FURNITURE = (r"^\d+\s*$", r"^[A-Z\s]+/Vol\.\s*\d+", r"Management Science.*\d{4}", r"Downloaded from.*\d{4}", r"For personal use only", r"^\d+\s+[A-Z][a-z]+\s+\d{4}$", r"^Figure\s+\d+", r"^Table\s+\d+", r"^\s*\d+\.\d+\s")
# Notices, as far as they can match lower-cased text; with strict also the last ones.
NOTICES = ("all rights reserved", "copyright", "downloaded from", "for personal use only", "doi:")
STRICT_NOTICES = ("issn", "isbn")
# What marks a block as a running header or footer, on lower-cased text. Page numbers:
PAGE_NUMBERS = (r"^\d+$", r"^\s*page\s+\d+\s*$")
# Rights.
RIGHTS = (r"©.*\d{4}", r"copyright.*\d{4}", "all rights reserved", "for personal use only", "downloaded from", "terms and conditions", "unauthorized reproduction")
# Publishers and volumes.
PUBLISHERS = ("published by", "publication details", "subscription information", r"vol\.\s*\d+.*no\.\s*\d+", r"volume\s+\d+.*number\s+\d+", r"issn\s*:?\s*\d{4}-\d{4}", r"doi\s*:?\s*10\.\d+")
# Addresses.
ADDRESSES = (r"https?://|www\.|\.com|\.org|\.edu",)
# How to cite.
HOW_TO_CITE = ("to cite this article", "citation format", "how to cite", "cite as:", r"^citation:\s*\w+")
# Dates and times.
DATES = (r"\d{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", r"\d{1,2}:\d{2}")
# Addresses of machines.
MACHINES = (r"\[?[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")
# Journals.
JOURNALS = (
    r"journal\s+of\s+\w+", r"\w+\s+science\s*/?\s*vol", r"\w+\s+review\s*/?\s*vol", r"proceedings\s+of", r"transactions\s+on",
    r"annals\s+of", r"\w+\s+business\s+review$", r"nature\s+\w*$", r"science\s*$",
)
# Forms of headings, and words in a short one.
HEADING_FORMS = (r"^\d+\.?\s+[A-Z]", r"^[A-Z][A-Z\s]+$", r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*$", r"^\d+\.\d+\.?\s+[A-Z]", r"^Abstract$|^Introduction$|^Conclusion$|^References$|^Methodology$")
HEADING_WORDS = ("introduction", "background", "method", "result", "conclusion", "discussion", "literature", "analysis", "findings", "summary")
# Headings that open the list of references.
REFERENCE_HEADINGS = (r"REFERENCES?", "Bibliography", "Literature Cited", "Works Cited")


# Ranges of code points that become a space: controls, odd spaces and separators.
BLANKED = ((0x1, 0x1F), (0x7F, 0x9F), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return any_of(*(text.contains(w) for w in words))


def matches_any(text: Column, patterns: Sequence[str], flags: str = "") -> Column:
    """One pass with one alternation."""
    return text.rlike(f"{flags}(?:{'|'.join(f'(?:{p})' for p in patterns)})")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def sentence_count(text: Column) -> Column:
    """Pieces between runs of . ! ?, a trailing empty one included."""
    return F.size(F.split(text, "[.!?]+"))


def naive_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def _mark(i: int) -> str:
    return chr(0xE000 + i)


def protect(text: Column) -> Column:
    """Abbreviations as private-use characters, so that their full stops are out of the way."""
    for i, a in enumerate(ABBREVIATIONS):
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(a)}", _mark(i))
    return text


def restore(text: Column) -> Column:
    for i, a in enumerate(ABBREVIATIONS):
        text = F.replace(text, F.lit(_mark(i)), F.lit(a))
    return text


def sentences(text: Column) -> Column:
    """Sentences that end in . ! or ? before white space and a capital; abbreviations end none, but may begin one."""
    capitals = "".join(_mark(i) for i, a in enumerate(ABBREVIATIONS) if a[0].isupper())
    return F.transform(F.split(protect(text), rf"(?U)(?<=[.!?])\s+(?=[\p{{Lu}}{capitals}])"), lambda s: F.trim(restore(s)))


def clean_sentence(text: Column) -> Column:
    """Joins words that a line end broke, drops control and odd space characters, collapses space."""
    text = F.regexp_replace(text, r"-\s*\n\s*", "")
    text = F.regexp_replace(text, "[" + "".join(rf"\u{a:04X}-\u{b:04X}" for a, b in BLANKED) + "]", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def token_truncate(text: Column, tokens: int) -> Column:
    """The part that surely fits: three characters a token."""
    return F.substring(text, 1, 3 * tokens)


def context(text: Column, wanted: Column, around: int = 50) -> Column:
    """The first occurrence and its surroundings; the whole text if there is none."""
    at = F.instr(text, wanted)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(text, start, at + F.length(wanted) + around - start))).otherwise(text)


def places(low: str, query: str) -> Iterator[int]:
    at = low.find(query)
    while at >= 0:
        yield at
        at = low.find(query, at + 1)


def occurrences(text: Column, query: str) -> Column:
    """0-based places of all occurrences, overlapping ones too, upper and lower case alike; linear in the text and its hits."""
    if not query:
        return F.array().cast("array<int>")
    q = query.lower()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(low: pd.Series) -> pd.Series:
        return low.map(lambda t: None if t is None else list(places(t, q)))

    return find(F.lower(text))


def contexts(text: Column, query: str, half: int) -> Column:
    """array<struct(position, context, highlight_start)>: each occurrence with so many characters on both sides of it, without outer spaces;
    the query is at highlight_start before these are taken off."""
    kind = "array<struct<position:int,context:string,highlight_start:int>>"
    if not query:
        return F.array().cast(kind)
    q = query.lower()

    @F.pandas_udf(kind)
    def cut(whole: pd.Series, low: pd.Series) -> pd.Series:
        rows = []
        for t, x in zip(whole, low, strict=True):
            places = places(x, q) if t is not None else []
            rows.append([{"position": at, "context": t[max(0, at - half) : at + len(q) + half].strip(" "), "highlight_start": at - max(0, at - half)} for at in places])
        return pd.Series(rows)

    return cut(text, F.lower(text))


def section_type(title: Column) -> Column:
    low, out = F.lower(title), None
    for kind, hints in SECTION_WORDS:
        test = contains_any(low, hints)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def is_furniture(sentence: Column) -> Column:
    return matches_any(sentence, SENTENCE_FURNITURE)


def share(part: Column, text: Column) -> Column:
    """part over the length of text; NaN for an empty text, as in SQL, which is above any bound."""
    return F.when(F.length(text) == 0, float("nan")).otherwise(part / F.length(text))


def special_ratio(text: Column) -> Column:
    """Share of characters that are no letters, digits, spaces or common punctuation. The commonest are named first, as they are tried in this order."""
    return share(F.length(F.regexp_replace(text, r"(?U)[a-zA-Z0-9\w\s.,;:!?()-]+", "")), text)


def is_noise(sentence: Column) -> Column:
    """An empty sentence is noise."""
    gaps = share(F.regexp_count(sentence, F.lit(r"(?U)\s+")), sentence)
    return (special_ratio(sentence) > 0.15) | sentence.rlike(r"H\d{6}") | (gaps > 0.5)


def is_notice(sentence: Column, strict: bool = False) -> Column:
    low = F.lower(sentence)
    plain = contains_any(low, NOTICES + (STRICT_NOTICES if strict else ()))
    return plain | low.rlike(r"© \d{4}") if strict else plain


def is_valid_sentence(sentence: Column) -> Column:
    s = F.trim(sentence)
    return (F.length(s) >= 10) & ~is_furniture(s) & ~is_noise(s) & ~is_notice(s)


def is_block_furniture(text: Column) -> Column:
    """Running headers and footers of a page, by content."""
    t = F.trim(text)
    low = F.lower(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return any_of(
        matches_any(low, (*PAGE_NUMBERS, *RIGHTS, *PUBLISHERS, *ADDRESSES, *HOW_TO_CITE, *DATES, *MACHINES, *JOURNALS)),
        (F.length(t) < 5) & ~t.rlike("^[A-Z][a-z]*$"),
        (F.length(t) > 10) & (letters / F.length(t) < 0.3),
        (F.regexp_count(t, F.lit(r"\(\d{4}[a-z]?\)")) >= 4) & (F.length(t) < 300),
        t.rlike(r"^[A-Z][a-z]+\s+et\s+al\.?\s*$"),
        t.contains("\n") & low.rlike(r"(?m)^\s*(?:page\s+)?\d+\s*$"),
    )


def is_heading(text: Column, font_size: Column | float = 12.0) -> Column:
    t = F.trim(text)
    size = font_size if isinstance(font_size, Column) else F.lit(font_size)
    lines = F.split(t, "\n")
    short = contains_any(F.lower(t), HEADING_WORDS) & (F.size(lines) <= 2) & F.forall(lines, lambda x: F.length(F.trim(x)) < 100)
    # cheap tests first: most texts have no form of a heading
    return (t != "") & (F.length(t) <= 200) & ((size > 13) | matches_any(t, HEADING_FORMS) | short) & ~is_block_furniture(t)


def reference_start(text: Column) -> Column:
    """0-based place of the first heading of references; null if there is none."""
    places = [F.nullif(F.regexp_instr(text, F.lit(rf"(?i)\n\s*{h}\s*\n")), F.lit(0)) - 1 for h in REFERENCE_HEADINGS]
    return F.least(*places)


def split_references(text: Column, fallback: Column | None = None) -> Column:
    """struct(main, references). fallback: a place to cut at where no heading is found."""
    at = F.coalesce(reference_start(text), *([fallback] if fallback is not None else []), F.length(text))
    return F.struct(F.substring(text, F.lit(1), at).alias("main"), F.substring(text, at + 1, F.length(text)).alias("references"))


def paragraphs(text: Column, least: int = 20) -> Column:
    """Pieces between blank lines of at least so many characters, white space collapsed."""
    cut = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.length(F.trim(p)) >= least)
    return F.transform(cut, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))


def strip_markdown(text: Column) -> Column:
    for pattern, with_ in (
        (r"(?s)```.*?```", ""), (r"`[^`]+`", ""), (r"(?m)^#{1,6}\s*", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"),
        (r"\|[^|\n]*\|", ""), (r"(?m)^[-|: ]+$", ""), (r"\n\s*\n", "\n\n"), (r"[ \t]+", " "),
    ):
        text = F.regexp_replace(text, pattern, with_)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def page_estimate(markdown: Column) -> Column:
    """Page marks, or one page for each 2000 characters, at least one."""
    marks = F.size(F.filter(F.split(markdown, "\n"), lambda x: F.lower(x).rlike(r"page\s*\d+") | F.trim(x).isin("---", "***")))
    return F.when(marks > 0, marks).otherwise(F.greatest(F.lit(1), F.expr("0") + F.floor(F.length(markdown) / 2000).cast("int")))


def quality_score(text: Column, bonus: Column | float = 0.0, pages_read: Column | float = 1.0) -> Column:
    """Up to 5 for length, 3 for plausible word density, 3 for the share of pages that gave text,
    bonus of the engine, less 2 for each sign of corruption; 0 at least, 0 for no text."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    length = F.length(text)
    short = F.regexp_count(text, F.lit(r"(?U)\b\w{1,2}\b"))

    def of(m: Column) -> Column:
        n, w = m["n"], m["w"]
        density = w / n * 100
        dense = F.when(density.between(10, 25), 3.0).otherwise(F.greatest(F.lit(0.0), F.lit(3.0) - F.abs(density - 17.5) / 5))
        signs = sum(F.when(F.coalesce(x, F.lit(0.0)) > 0.3, 2.0).otherwise(0.0) for x in (m["odd"], m["short"] / F.when(w > 0, w)))
        score = F.least(n / 10000, F.lit(5.0)) + dense + F.least(as_col(pages_read), F.lit(1.0)) * 3 + as_col(bonus) - signs
        return F.greatest(score, F.lit(0.0))

    # each pass over the text is made once
    measured = F.struct(length.alias("n"), word_count(text).alias("w"), special_ratio(text).alias("odd"), short.alias("short"))
    return F.when(F.coalesce(length, F.lit(0)) == 0, 0.0).otherwise(once(measured, of))


def language_votes(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {k: reduce(lambda a, b: a + b, (low.contains(p).cast("int") for p in pieces)) for k, pieces in LANGUAGES.items()}


def pick_language(votes: dict[str, Column]) -> Column:
    """Most votes; the first language of the list among equals; en without votes."""
    most = F.greatest(*votes.values())
    out = F.when(most == 0, "en")
    for k, v in votes.items():
        out = out.when(v == most, k)
    return out


def detect_language(text: Column) -> Column:
    return F.coalesce(pick_language(language_votes(text)), F.lit("en"))


def citation_direction(query: Column) -> Column:
    low = F.lower(query)
    return F.when(contains_any(low, ("cited by", "references to", "who cites")), "incoming").when(contains_any(low, ("cites", "references", "mentions")), "outgoing").otherwise("both")


def query_class(query: Column, has_author: Column) -> Column:
    cites = contains_any(F.lower(query), ("cit", "refer", "mention", "quote", "support", "refute", "extend"))
    return F.when(cites, "citation_analysis").when(has_author, "author_papers").otherwise("paper_search")


def query_confidence(has_author: Column, has_year: Column, has_title: Column, keywords: Column) -> Column:
    """In tenths first, so that sums are exact."""
    tenths = F.lit(5) + 2 * has_author.cast("int") + 2 * has_year.cast("int") + 2 * has_title.cast("int") + (keywords > 2).cast("int")
    return F.least(tenths, F.lit(10)) / 10


def reference_string(authors: Column, year: Column, title: Column, journal: Column, publisher: Column, place: Column) -> Column:
    return F.concat(F.array_join(authors, "; "), F.lit(" ("), year, F.lit("). "), F.concat_ws(". ", title, journal, F.concat_ws(", ", publisher, place)))


def fenced_json(text: Column) -> Column:
    """The JSON of a fenced block, or from the first { to the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def reference_tail(text: Column, tokens: int = 2000) -> Column:
    """Paragraphs from the first with a heading of references on, as far as so many tokens reach (four
    characters each); without a heading the last ten."""
    cut = F.split(text, r"\n\s*\n")
    places = F.filter(F.transform(cut, lambda p, i: F.when(F.lower(p).rlike("references|bibliography|works cited"), i)), lambda i: i.isNotNull())
    from_ = F.when(F.size(places) > 0, F.array_min(places)).otherwise(F.greatest(F.size(cut) - 10, F.lit(0)))
    kept = F.slice(cut, from_ + 1, F.size(cut))
    return F.substring(F.array_join(kept, "\n\n"), 1, 4 * tokens)
