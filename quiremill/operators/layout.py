"""From placed characters to sections: two levels of islands.

Characters of one height are a line, read from left to right; lines nearer to each other than a gap are a block, read from the
top; a block that looks like a heading (its words, or the mean size of its characters) opens a section.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Decimals of a height that count; distance of lines that parts blocks; size of characters that have none.
DECIMALS, GAP, SIZE = 1, 20.0, 12.0


def chars_to_lines(chars: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """(keys, y, text, chars, sizes) of characters (keys, x, y, char, size): rounded heights part lines, x orders them, then the
    character. Lines of white space are left out. sizes is the sum of the characters' sizes; a line's characters bound the row."""
    size = F.coalesce(F.col("size").cast("double"), F.lit(SIZE))
    rows = chars.select(*keys, F.bround("y", DECIMALS).alias("y"), F.struct("x", F.coalesce("char", F.lit("")).alias("char")).alias("c"), size.alias("size"))
    lines = rows.groupBy(*keys, "y").agg(F.sort_array(F.collect_list("c")).alias("a"), F.count("*").alias("chars"), F.sum("size").alias("sizes"))
    text = F.array_join(F.transform("a", lambda c: c["char"]), "")
    return lines.select(*keys, "y", text.alias("text"), "chars", "sizes").where(text.rlike(r"(?U)\S"))


def placed_blocks(lines: DataFrame, keys: Sequence[str] = ("doc_id", "page"), gap: float = GAP) -> DataFrame:
    """(keys, block, text, font_size) of lines: from the top of each page, a new block where the distance to the line above is over gap;
    font_size is the mean over its characters."""
    w = Window.partitionBy(*keys).orderBy(F.desc("y"))
    far = F.coalesce((F.lag("y").over(w) - F.col("y") > gap).cast("int"), F.lit(0))
    rows = lines.withColumn("far", far).withColumn("block", F.sum("far").over(w))
    got = rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("y"), "text"))).alias("a"), (F.sum("sizes") / F.sum("chars")).alias("font_size"))
    return got.select(*keys, "block", F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("text"), "font_size")


def sections(blocks: DataFrame, key: str = "doc_id", page: str = "page", least: int = 20) -> DataFrame:
    """(key, section_index, section_title, section_type, page_start, text, paragraphs) of blocks in order of page and block. Running
    headers and footers are left out; what stands before the first heading is section 0 without a title. A section's
    paragraphs are the pieces of its blocks between blank lines, of at least so many characters."""
    kept = blocks.where(~X.is_block_furniture(F.col("text")))
    w = Window.partitionBy(key).orderBy(page, "block")
    rows = kept.withColumn("h", X.is_heading(F.col("text"), F.col("font_size"))).withColumn("section_index", F.sum(F.col("h").cast("int")).over(w).cast("int"))
    body = F.when(~F.col("h"), F.struct(page, "block", "text"))
    got = rows.groupBy(key, "section_index").agg(F.max(F.when(F.col("h"), F.trim("text"))).alias("title"), F.min(page).alias("page_start"), F.sort_array(F.collect_list(body)).alias("a"))
    texts, title = F.transform("a", lambda x: x["text"]), F.coalesce("title", F.lit(""))
    paragraphs = F.flatten(F.transform(texts, lambda t: X.paragraphs(t, least)))
    return got.select(key, "section_index", title.alias("section_title"), X.section_type(title).alias("section_type"), "page_start", F.array_join(texts, "\n\n").alias("text"), paragraphs.alias("paragraphs"))


def read_layout(chars: DataFrame, key: str = "doc_id", page: str = "page", gap: float = GAP) -> DataFrame:
    """The sections of documents whose characters (key, page, x, y, char, size) a layout engine has placed."""
    keys = (key, page)
    return sections(placed_blocks(chars_to_lines(chars, keys), keys, gap), key, page)
