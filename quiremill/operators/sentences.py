"""The sentences of whole documents, as one operator whose rows point back into their text.

In order: the list of references is cut off, the rest split at ends of sentences (an abbreviation's full stop is none), pieces that a
citation's full stop parted are joined, invalid sentences dropped, the others cleaned and numbered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .rollup import belongs, reference_start_by_density

def spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, joined) of each sentence: text[start:end] with white space between joined pieces as one space."""
    abbreviation = re.compile(r"\b(?:" + "|".join(re.escape(a) for a in X.ABBREVIATIONS) + r")\Z", re.IGNORECASE)
    longest = max(map(len, X.ABBREVIATIONS)) + 1
    pieces, at = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+", text):
        if m.end() < len(text) and text[m.end()].isupper() and not abbreviation.search(text[max(0, m.start() - longest) : m.start()]):
            pieces.append((at, m.start()))
            at = m.end()
    pieces.append((at, len(text)))
    held: list | None = None
    for a, z in pieces:
        said = text[a:z]
        a, z, said = a + len(said) - len(said.lstrip()), z - len(said) + len(said.rstrip()), said.strip()
        if not said:
            continue
        if held and belongs(held[2], said):
            held = [held[0], z, f"{held[2]} {said}"]
            continue
        if held:
            yield tuple(held)
        held = [a, z, said]
    if held:
        yield tuple(held)


#: Sentences that a task's Python holds at a time.
AT_ONCE = 1024


def exploded_spans(rows: DataFrame, text: str) -> DataFrame:
    """rows without text, one for each sentence of it, with start, end, raw and joined."""
    rest = [c for c in rows.columns if c != text]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []

            def made() -> pa.RecordBatch:
                kept = [b.column(i).take(pa.array(at, pa.int64())) for i in range(len(rest))]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]
                return pa.RecordBatch.from_arrays([*kept, *columns], [*rest, "start", "end", "raw", "joined"])

            for i, t in enumerate(b.column(len(rest))):
                t = t.as_py()
                for start, end, joined in spans(t) if t else ():
                    at.append(i)
                    found.append((start, end, t[start:end], joined))
                    if len(at) >= AT_ONCE:
                        yield made()
                        at, found = [], []
            if at:
                yield made()

    return rows.select(*rest, text).mapInArrow(run, ", ".join([*kinds, "start int, end int, raw string, joined string"]))


def parse_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", markdown: bool = False) -> DataFrame:
    """(key, sentence_index, sentence, start, end, raw): raw is the text from start to end, 0-based code points; sentence what is left of
    it after cleaning. With markdown its marks go first, and places are those of strip_markdown(text). Null texts have
    no sentences; a key's sentences are numbered in one window. Rows of one key are one document's parts: each is split by itself."""
    whole = F.coalesce(X.strip_markdown(F.col(text)) if markdown else F.col(text), F.lit(""))
    rows = docs.select(key, whole.alias("w")).withColumn("part", F.monotonically_increasing_id())
    at = F.coalesce(X.reference_start(F.col("w")), reference_start_by_density("w"))
    each = exploded_spans(rows.select(key, "part", F.substring("w", F.lit(1), at).alias("w")), "w")
    good = each.where(X.is_valid_sentence(F.col("joined"))).withColumn("sentence", X.clean_sentence(F.col("joined"))).where("sentence <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("part", "start")) - 1
    return good.select(key, number.alias("sentence_index"), "sentence", "start", "end", "raw")
