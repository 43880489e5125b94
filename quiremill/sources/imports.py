"""Processed documents into the tables of a graph and the collections of a vector index.

Sentence lines, paragraphs and sections come from what papers.read_processed() and its like read. A document is
assembled once, as arrays of its own sentences and paragraphs; one pass over the documents explodes each
into rows of several kinds, which are written as one table partitioned by kind. Keys of paragraphs, sentences and arguments
are scoped by the paper.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import ids
from ..functions import text as X
from ..operators.content import paragraph_sentences
from ..operators.vectors import index

#: What a row of each kind may hold; a kind leaves the rest null.
TAGGED = (
    "kind string, id string, paper_id string, ref_id string, idx bigint, text string, section string, title string, authors array<string>, year int, doi string, journal string, "
    "publisher string, abstract string, volume string, issue string, pages string, issn string, url string, type string, stub boolean, n int, m int, intext string, context string, "
    "confidence double, relation_type string, claim_type string"
)
KINDS = dict(f.strip().split(" ", 1) for f in TAGGED.split(", "))
#: Fields of a paper's metadata that its node carries beside title, authors and year.
DETAILS = ("doi", "journal", "publisher", "abstract", "volume", "issue", "pages", "issn", "url", "type")
#: What the tables read of the rows of each kind.
FIELDS = {
    "papers": ("id", "title", "year", "authors", "stub", *DETAILS),
    "paragraphs": ("id", "paper_id", "idx", "text", "section", "n", "year"),
    "sentences": ("id", "paper_id", "ref_id", "idx", "year", "text", "stub", "n", "m"),
    "sentence_cites": ("id", "paper_id", "ref_id", "intext", "context", "confidence"),
    "arguments": ("id", "paper_id", "idx", "text", "claim_type"),
    "relations": ("id", "ref_id", "idx", "relation_type", "confidence"),
}
#: What a stub takes from a reference.
STUB_FIELDS = ("title", "year", "authors", "journal", "publisher")
#: Sentences of a paragraph that is made from sentence lines.
PER_PARAGRAPH = 5


def _has(struct, name: str) -> bool:
    return name in struct.names


def _part(value: Column, struct, name: str, kind: str) -> Column:
    """A field that some writers leave out."""
    return value[name].cast(kind) if _has(struct, name) else F.lit(None).cast(kind)


def structure(lines: DataFrame, per_paragraph: int = PER_PARAGRAPH) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, sections) of papers that have sentence lines only: a heading among the sentences opens a section,
    so many sentences in a row are a paragraph. Both come from one numbering of the lines; a paper's lines are one window."""
    own = Window.partitionBy("paper_id").orderBy("sentence_index")
    heading = X.is_heading(F.coalesce("sentence_text", F.lit("")))
    rows = lines.select("paper_id", "sentence_index", "sentence_text", F.coalesce(F.size("citations"), F.lit(0)).alias("c"), heading.alias("h"))
    rows = rows.withColumn("section_index", F.sum(F.col("h").cast("int")).over(own).cast("int"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("paper_id", "section_index").orderBy("sentence_index")) - F.when(F.col("section_index") > 0, 2).otherwise(1))
    body = F.when(~F.col("h"), F.struct("sentence_index", "sentence_text"))
    joined = lambda a: F.array_join(F.transform(F.sort_array(F.collect_list(a)), lambda x: x["sentence_text"]), " ")
    paragraphs = rows.where(~F.col("h")).groupBy("paper_id", "section_index", F.floor(F.col("at") / per_paragraph).alias("k"))
    paragraphs = paragraphs.agg(joined(body).alias("paragraph_text"), F.count("*").cast("int").alias("sentence_count"), F.min("sentence_index").alias("first"))
    sections = rows.groupBy("paper_id", "section_index").agg(
        F.max(F.when(F.col("h"), F.col("sentence_text"))).alias("section_title"), joined(body).alias("section_text"),
        F.ceil(F.count(F.when(~F.col("h"), 1)) / per_paragraph).cast("int").alias("paragraph_count"),
    )
    paragraphs = paragraphs.join(sections.select("paper_id", "section_index", F.col("section_title").alias("section")), ["paper_id", "section_index"])
    numbered = F.row_number().over(Window.partitionBy("paper_id").orderBy("first")) - 1
    title = F.coalesce("section_title", F.lit(""))
    return (
        paragraphs.select("paper_id", numbered.alias("paragraph_index"), "paragraph_text", F.coalesce("section", F.lit("")).alias("section"), "sentence_count"),
        sections.select("paper_id", "section_index", title.alias("section_title"), "section_text", X.section_type(title).alias("section_type"), "paragraph_count"),
    )


def assemble(lines: DataFrame, metadata: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """One row a paper: metadata, its paragraphs and sentences as ordered arrays. Papers with metadata alone or lines alone count too.
    A paper's own sentences bound the row."""
    paragraphs = structure(lines)[0] if paragraphs is None else paragraphs
    s = lines.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("sentence_index", F.struct(*(c for c in lines.columns if c != "paper_id")).alias("s")))).alias("a"))
    p = _paragraph_arrays(paragraphs)
    m = metadata.select("paper_id", F.struct(*(c for c in metadata.columns if c != "paper_id")).alias("metadata"))
    got = m.join(s.select("paper_id", F.transform("a", lambda x: x["s"]).alias("sentences")), "paper_id", "full").join(p, "paper_id", "left")
    return got.where("paper_id is not null")


def cited_id(citation: Column) -> Column:
    """The paper of a citation: as given, else from the title and year of its reference; null if it has neither."""
    given = F.nullif(F.trim(citation["paper_id"]), F.lit(""))
    title = citation["reference"]["title"]
    return F.coalesce(given, F.when(F.length(F.trim(title)) > 0, ids.paper_id(title, citation["reference"]["year"])))


def names_paper(citation: Column) -> Column:
    """Whether cited_id() is not null, without the hash."""
    return (F.trim(citation["paper_id"]) != "") | (F.length(F.trim(citation["reference"]["title"])) > 0)


def cited_lines(lines: DataFrame) -> DataFrame:
    """A row for each citation of a line that names a paper, with it: __x, struct(cited, c)."""
    c = F.col("__c")
    return lines.withColumn("__c", F.explode("citations")).where(names_paper(c)).withColumn("__x", F.struct(cited_id(c).alias("cited"), c.alias("c"))).drop("__c")


class _Rows:
    """What becomes of the parts of a document: one row TAGGED for each. A sentence is anything that gives its fields by name.
    fields: those of TAGGED that rows have, all by default. make: what a row is made of its columns, a struct by default."""

    def __init__(self, lines: T.StructType, about: T.StructType, paragraphs: T.DataType, fields: Sequence[str] | None = None, make: Callable = F.struct):
        self.line, self.about, self.paragraphs, self.make = lines, about, paragraphs, make
        self.cite = lines["citations"].dataType.elementType
        self.fields = {k: v for k, v in KINDS.items() if fields is None or k in fields}
        self.none = F.array().cast("array<struct<" + ",".join(f"{k}:{v}" for k, v in self.fields.items()) + ">>")
        self.paper = F.col("paper_id")

    def row(self, kind: str, **values: Column) -> Column:
        values["kind"] = F.lit(kind)
        return self.make(*((values[c] if c in values else F.lit(None)).cast(t).alias(c) for c, t in self.fields.items()))

    @staticmethod
    def analysed(x, of) -> Column:
        return F.coalesce(x["argument_analysis"]["has_argument_relations"], F.lit(False)) if _has(of, "argument_analysis") else F.lit(False)

    def year(self, m) -> Column:
        return schemas.year(_part(m, self.about, "year", "string"))

    def cites(self, s) -> Column:
        """Citations of a sentence that name a paper, with it."""
        named = F.transform(F.coalesce(s["citations"], F.array().cast(self.line["citations"].dataType)), lambda c: F.struct(cited_id(c).alias("cited"), c.alias("c")))
        return F.filter(named, lambda x: x["cited"].isNotNull())

    def own(self, m) -> Column:
        details = {c: _part(m, self.about, c, "string") for c in DETAILS}
        return self.row("papers", id=self.paper, title=F.coalesce(_part(m, self.about, "title", "string"), F.lit("")), authors=_part(m, self.about, "authors", "array<string>"), year=self.year(m), stub=F.lit(False), **details)

    def stub(self, x: Column) -> Column:
        ref, of = x["c"]["reference"], self.cite["reference"].dataType
        return self.row("papers", id=x["cited"], title=F.coalesce(ref["title"], F.lit("Unknown Title")), authors=_part(ref, of, "authors", "array<string>"), year=schemas.year(ref["year"]), journal=_part(ref, of, "journal", "string"), publisher=_part(ref, of, "publisher", "string"), stub=F.lit(True))

    def paragraph_id(self, p) -> Column:
        return F.concat(self.paper, F.lit("_para_"), p["paragraph_index"].cast("string"))

    def paragraph(self, p, year: Column) -> Column:
        return self.row("paragraphs", id=self.paragraph_id(p), paper_id=self.paper, idx=p["paragraph_index"], text=p["paragraph_text"], section=F.coalesce(p["section"], F.lit("Unknown")), n=p["sentence_count"], year=year)

    def sentence_id(self, s) -> Column:
        return F.concat(self.paper, F.lit("_sent_"), s["sentence_index"].cast("string"))

    def sentence(self, s, paragraphs: Column, year: Column) -> Column:
        holds = F.filter(F.coalesce(paragraphs, F.array().cast(self.paragraphs)), lambda p: p["paragraph_text"].contains(s["sentence_text"]))
        place = F.coalesce(F.get(holds, F.lit(0))["paragraph_index"].cast("string"), F.lit("unknown"))
        cited = F.coalesce(F.size(s["citations"]), F.lit(0)) > 0
        words, chars = _part(s, self.line, "word_count", "int"), _part(s, self.line, "char_count", "int")
        return self.row("sentences", id=self.sentence_id(s), paper_id=self.paper, ref_id=F.concat(self.paper, F.lit("_para_"), place), idx=s["sentence_index"], text=s["sentence_text"], stub=cited, n=F.coalesce(words, X.word_count(s["sentence_text"])), m=F.coalesce(chars, X.char_count(s["sentence_text"])), year=year)

    def edge(self, s, x: Column) -> Column:
        sure = F.coalesce(_part(x["c"], self.cite, "confidence", "double"), F.lit(1.0))
        return self.row("sentence_cites", id=self.sentence_id(s), paper_id=self.paper, ref_id=x["cited"], idx=s["sentence_index"], intext=x["c"]["intext"], context=X.context(s["sentence_text"], x["c"]["intext"]), confidence=sure)

    def argument(self, s) -> Column:
        """Of a sentence that cites."""
        claim = F.when(self.analysed(s, self.line), "CLAIM_MAIN").otherwise("NEUTRAL")
        return self.row("arguments", id=self.sentence_id(s), paper_id=self.paper, idx=s["sentence_index"], text=s["sentence_text"], claim_type=claim)

    def relations(self, s, x: Column) -> Column:
        plain = self.row("relations", id=self.sentence_id(s), paper_id=self.paper, ref_id=x["cited"], relation_type=F.lit("CITES"))
        if not _has(self.cite, "argument_analysis"):
            return F.array(plain)
        found = x["c"]["argument_analysis"]["entities"]
        entities = F.coalesce(found, F.array().cast(self.cite["argument_analysis"].dataType["entities"].dataType))
        typed = F.transform(entities, lambda e, i: self.row("relations", id=self.sentence_id(s), paper_id=self.paper, ref_id=x["cited"], idx=i, relation_type=F.coalesce(e["relation_type"], F.lit("CITES")), confidence=e["confidence"]))
        return F.when(self.analysed(x["c"], self.cite), typed).otherwise(F.array(plain))


    def typed(self, cited: DataFrame, s) -> tuple[DataFrame, Column]:
        """As relations(), of rows that cited_lines() gives: a row for each relation, and what becomes of it."""
        x = F.col("__x")
        values = {"id": self.sentence_id(s), "paper_id": self.paper, "ref_id": x["cited"]}
        if not _has(self.cite, "argument_analysis"):
            return cited, self.row("relations", **values, relation_type=F.lit("CITES"))
        found, said = x["c"]["argument_analysis"]["entities"], self.analysed(x["c"], self.cite)
        none = F.array(F.lit(None).cast(self.cite["argument_analysis"].dataType["entities"].dataType.elementType))
        each = cited.select("*", said.alias("__said"), F.posexplode(F.when(said, found).otherwise(none)).alias("__i", "__e"))
        e = F.col("__e")
        return each, self.row("relations", **values, idx=F.when(F.col("__said"), F.col("__i")), relation_type=F.coalesce(e["relation_type"], F.lit("CITES")), confidence=e["confidence"])


def exploded(docs: DataFrame) -> DataFrame:
    """Rows TAGGED of documents as assemble() gives them: papers (a stub for each citation), paragraphs, sentences,
    sentence_cites, arguments (sentences that cite) and relations (one for each entity of a citation's analysis, CITES without one)."""
    rows = _Rows(docs.schema["sentences"].dataType.elementType, docs.schema["metadata"].dataType, docs.schema["paragraphs"].dataType)
    m = F.col("metadata")
    year, held = rows.year(m), F.coalesce("paragraphs", F.array().cast(docs.schema["paragraphs"].dataType))
    sentences = F.coalesce("sentences", F.array().cast(docs.schema["sentences"].dataType))
    argument = lambda s: F.when(F.size(s["citations"]) > 0, F.array(rows.argument(s))).otherwise(rows.none)
    cites = lambda s: F.transform(rows.cites(s), lambda x: F.concat(F.array(rows.stub(x), rows.edge(s, x)), rows.relations(s, x)))
    each = lambda s: F.concat(F.array(rows.sentence(s, held, year)), argument(s), F.flatten(cites(s)))
    own = F.when(m.isNotNull(), F.array(rows.own(m))).otherwise(rows.none)
    paragraphs = F.transform(held, lambda p: rows.paragraph(p, year))
    return docs.select(F.explode(F.concat(own, paragraphs, F.flatten(F.transform(sentences, each)))).alias("r")).select("r.*")


def _paragraph_arrays(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("paragraph_index", "paragraph_text", "section", "sentence_count"))).alias("paragraphs"))


def rows_of(kind: str, lines: DataFrame, metadata: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The rows of one kind, as exploded() gives them, from what this kind needs: nothing is assembled, only sentences meet the paragraphs of their paper.
    Metadata has one row a paper."""
    fields = lambda df: {c: F.col(c) for c in df.columns if c != "paper_id"}
    lines, metadata, paragraphs = (df.where("paper_id is not null") for df in (lines, metadata, paragraphs))
    arrays = _paragraph_arrays(paragraphs)
    # columns, not structs: what nothing reads is not made
    rows = _Rows(lines.schema, metadata.schema, arrays.schema["paragraphs"].dataType, FIELDS[kind], lambda *columns: columns)
    s, flat = fields(lines), lambda df, row: df.select(*row)
    cited = lambda: cited_lines(lines)
    years = metadata.select("paper_id", rows.year(fields(metadata)).alias("__year"))
    if kind == "papers":
        # a paper is cited many times: equal references are one row before anything is made of them
        c = F.col("__x")["c"]
        ref = F.struct(*(c["reference"][f].alias(f) for f in rows.cite["reference"].dataType.names if f in STUB_FIELDS))
        return flat(metadata, rows.own(fields(metadata))).unionByName(flat(cited().select(F.struct(F.col("__x")["cited"].alias("cited"), F.struct(ref.alias("reference")).alias("c")).alias("__x")).distinct(), rows.stub(F.col("__x"))))
    if kind == "paragraphs":
        known = metadata.select("paper_id").unionByName(lines.select("paper_id"))
        return flat(paragraphs.join(known, "paper_id", "left_semi").join(years, "paper_id", "left"), rows.paragraph(fields(paragraphs), F.col("__year")))
    if kind == "sentences":
        return flat(lines.join(arrays.withColumnRenamed("paragraphs", "__p"), "paper_id", "left").join(years, "paper_id", "left"), rows.sentence(s, F.col("__p"), F.col("__year")))
    if kind == "sentence_cites":
        return flat(cited(), rows.edge(s, F.col("__x")))
    if kind == "arguments":
        return flat(lines.where(F.size("citations") > 0), rows.argument(s))
    return flat(*rows.typed(cited(), s))


def graph_tables(tagged: DataFrame) -> dict[str, DataFrame]:
    """The tables by kind, with the names that operators.graph uses, and paper_cites."""
    return _tables(lambda kind: tagged.where(F.col("kind") == kind))


def _tables(of: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    # a real record before stubs, then the least; one aggregate with a map side
    rest = ["title", "year", "authors", *DETAILS]
    papers = of("papers").groupBy(F.col("id").alias("paper_id")).agg(F.min(F.struct("stub", *rest)).alias("r")).select("paper_id", *(F.col("r")[c].alias(c) for c in ("title", "year", "journal", "stub", "authors", *(x for x in DETAILS if x != "journal"))))
    edges = of("sentence_cites")
    # one relation for each pair and type; the confidence of the last entity. Dealt by sentence alone, which what joins them needs too
    relations = of("relations").repartition("id").groupBy(F.col("id").alias("from_id"), F.col("ref_id").alias("to_id"), "relation_type").agg(F.count("*").alias("mentions"), F.max_by("confidence", F.struct("idx", "confidence")).alias("confidence"))
    return {
        "papers": papers,
        "paragraphs": of("paragraphs").select(F.col("id").alias("paragraph_id"), "paper_id", F.col("idx").alias("paragraph_index"), "section", "year", "text", F.col("n").alias("sentence_count")),
        "sentences": of("sentences").select(F.col("id").alias("sentence_id"), "paper_id", F.col("ref_id").alias("paragraph_id"), F.col("idx").alias("sentence_index"), "year", "text", F.col("stub").alias("has_citations"), F.col("n").alias("word_count"), F.col("m").alias("char_count")),
        "sentence_cites": edges.select(F.col("id").alias("sentence_id"), F.col("ref_id").alias("cited_id"), F.col("intext").alias("citation_text"), F.col("context").alias("citation_context"), "confidence"),
        # the edges of sentence_cites with their paper
        "citing": edges.select(F.col("id").alias("sentence_id"), F.col("ref_id").alias("cited_id"), "paper_id"),
        "arguments": of("arguments").select(F.col("id").alias("argument_id"), "paper_id", F.col("idx").alias("sentence_index"), "text", "claim_type"),
        "relations": relations,
        "paper_cites": edges.groupBy(F.col("paper_id").alias("citing_id"), F.col("ref_id").alias("cited_id")).agg(F.count("*").alias("citation_count")),
    }


def paragraph_cites(tables: dict[str, DataFrame]) -> DataFrame:
    """(paragraph_id, cited_id, citation_count, citation_density): citations of the sentences that a paragraph holds by the
    rules of content.paragraph_sentences(), real counts; the density is by its sentences."""
    cites = tables["sentence_cites"]
    intexts = cites.groupBy("sentence_id").agg(F.collect_set("citation_text").alias("intexts"))
    some = tables["sentences"].join(intexts, "sentence_id").select("paper_id", "sentence_id", "text", "intexts")
    held = paragraph_sentences(tables["paragraphs"], some).select("paragraph_id", "sentence_id")
    n = held.join(cites, "sentence_id").groupBy("paragraph_id", "cited_id").agg(F.count("*").alias("citation_count"))
    size = F.greatest(F.coalesce("sentence_count", F.lit(1)), F.lit(1))
    return n.join(tables["paragraphs"].select("paragraph_id", size.alias("size")), "paragraph_id").select("paragraph_id", "cited_id", "citation_count", (F.col("citation_count") / F.col("size")).alias("citation_density"))


def paragraph_cites_of(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """As paragraph_cites(), from lines and paragraphs. A line is its own sentence and brings its citations along, so a filter by the cited paper
    goes before the sentences meet the paragraphs of their paper."""
    lines, paragraphs = lines.where("paper_id is not null"), paragraphs.where("paper_id is not null")
    rows = _Rows(lines.schema, T.StructType(), T.ArrayType(T.StringType()))
    each = lines.select("paper_id", F.col("sentence_text").alias("text"), "citations", F.explode(rows.cites({"citations": F.col("citations")})).alias("x"))
    intexts = F.transform(rows.cites({"citations": F.col("citations")}), lambda x: x["c"]["intext"])
    each = each.select("paper_id", "text", intexts.alias("intexts"), F.col("x.cited").alias("cited_id"), F.lit(None).cast("string").alias("sentence_id"))
    size = F.greatest(F.coalesce("sentence_count", F.lit(1)), F.lit(1))
    named = paragraphs.select("paper_id", rows.paragraph_id({"paragraph_index": F.col("paragraph_index")}).alias("paragraph_id"), F.col("paragraph_text").alias("text"), size.alias("size"))
    held = paragraph_sentences(named, each, ["size"], ["cited_id"])
    n = held.groupBy("paragraph_id", "cited_id", "size").agg(F.count("*").alias("citation_count"))
    return n.select("paragraph_id", "cited_id", "citation_count", (F.col("citation_count") / F.col("size")).alias("citation_density"))


def import_lines(lines: DataFrame, metadata: DataFrame, paragraphs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of import_documents() without a path, each from what it needs of lines, metadata and paragraphs: no document is assembled."""
    paragraphs = structure(lines)[0] if paragraphs is None else paragraphs
    return _tables(lambda kind: rows_of(kind, lines, metadata, paragraphs)) | {"paragraph_cites": paragraph_cites_of(lines, paragraphs)}


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAGGED).parquet(f"{path}/nodes")


def import_documents(docs: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """All tables of a graph; those that operators.graph.Graph names are its arguments. With a path the documents are read once and
    their rows written below it, one folder a kind, paragraph_cites apart; without one each table computes its rows when it is asked for."""
    tagged = exploded(docs)
    if path is not None:
        tagged.write.partitionBy("kind").mode("append").parquet(f"{path}/nodes")
        tagged = read_tagged(docs.sparkSession, path)
    tables = graph_tables(tagged)
    cites = paragraph_cites(tables)
    if path is not None:
        cites.write.mode("overwrite").parquet(f"{path}/paragraph_cites")
        cites = docs.sparkSession.read.schema(cites.schema).parquet(f"{path}/paragraph_cites")
    return tables | {"paragraph_cites": cites}


def graph_of(tables: dict[str, DataFrame]):
    from ..operators.graph import Graph

    return Graph(**{k: tables[k] for k in ("papers", "paragraphs", "sentences", "sentence_cites", "paragraph_cites", "citing")})


def to_graph(lines: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """papers, arguments, relations and paper_cites of sentence lines alone."""
    no_paragraphs = lines.sparkSession.createDataFrame([], f"paper_id string, {schemas.PARAGRAPH_LINE}")
    tables = _tables(lambda kind: rows_of(kind, lines, metadata, no_paragraphs))
    return {k: tables[k] for k in ("papers", "arguments", "relations", "paper_cites")}


def point_filter(has_citations: Column, claim_type: Column) -> Column:
    """Which sentences are indexed, and as what."""
    return F.when(has_citations, F.coalesce(F.nullif(claim_type, F.lit("")), F.lit("citation"))).otherwise("content")


def _described(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows with the fields of their paper that every point carries; what is unknown says so."""
    unknown = F.lit("Unknown")
    m = metadata.select("paper_id", *((F.col(c).cast("string") if c in metadata.columns else F.lit(None).cast("string")).alias(c) for c in ("title", "year", "doi", "journal", "publisher")), (F.col("authors") if "authors" in metadata.columns else F.array().cast("array<string>")).alias("authors"))
    got = rows.join(m, "paper_id", "left")
    return got.withColumns({c: F.coalesce(c, unknown) for c in ("title", "year", "doi", "journal", "publisher")} | {"authors": F.coalesce("authors", F.array().cast("array<string>"))})


def collections(lines: DataFrame, metadata: DataFrame, paragraphs: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Points (schemas.POINT) of the four collections: sentences, paragraphs, sections, citations. Ids are hashes of
    collection, paper and place, so that upserting them again adds nothing."""
    if paragraphs is None or sections is None:
        made = structure(lines)
        paragraphs, sections = paragraphs if paragraphs is not None else made[0], sections if sections is not None else made[1]
    lines = lines.where("paper_id is not null")
    cited = F.coalesce(F.size("citations"), F.lit(0)) > 0
    # one pass in the order of each paper's lines: a line, then its citations, numbered by those of the lines before. What a point needs of a
    # citation is taken out before lines are dealt
    kind = lines.schema["citations"].dataType
    of_each = lambda f: F.transform(F.coalesce("citations", F.array().cast(kind)), f)
    sure = lambda c: F.coalesce(_part(c, kind.elementType, "confidence", "double"), F.lit(1.0))
    taken = lines.select("paper_id", *(c.alias(n) for n, c in _sentence_point(lines).items()), of_each(cited_id).alias("__ids"), of_each(lambda c: c["intext"]).alias("__intexts"), of_each(sure).alias("__sure"))
    earlier = Window.partitionBy("paper_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("__ids")).over(earlier), F.lit(0))
    each = taken.withColumn("__before", before).select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "__ids")).alias("__k", "__id"))
    of = lambda c: F.get(c, F.col("__k") - 1)
    number, intext = (F.col("__before") + F.col("__k") - 1).cast("int"), of(F.col("__intexts"))
    of_citation = {
        "collection": F.lit("citations"), "at": number.cast("long"), "text": intext, "citation_index": number, "cited_paper_id": F.col("__id"),
        "citation_context": X.context(F.col("text"), intext), "confidence": of(F.col("__sure")),
    }
    own = list(_sentence_point(lines))
    names = list(dict.fromkeys([*own, *of_citation]))
    sc = each.select("paper_id", *(F.when(F.col("__k") == 0, F.col(c) if c in own else F.lit(None)).otherwise(of_citation.get(c, F.lit(None))).alias(c) for c in names))
    # a paragraph and its sentences meet by paper, where it gets its count too; one that is given twice is one point
    in_sentences = lines.where(cited).select("paper_id", F.col("sentence_index").cast("string").alias("sentence_id"), F.col("sentence_text").alias("text"), F.col("citations")["intext"].alias("intexts"), F.size("citations").alias("n"))
    held = paragraph_sentences(paragraphs.withColumnsRenamed({"paragraph_index": "paragraph_id", "paragraph_text": "text"}), in_sentences, ["section", "sentence_count"], ["n"], every=True)
    counts = held.groupBy("paper_id", "paragraph_id", "text", "section", "sentence_count").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("citation_count"))
    p = counts.select("paper_id", F.lit("paragraphs").alias("collection"), F.col("paragraph_id").alias("at"), "text", F.col("paragraph_id").alias("paragraph_index"), F.coalesce("section", F.lit("")).alias("section"), "citation_count", "sentence_count", (F.col("citation_count") > 0).alias("has_citations"))
    t = sections.select("paper_id", F.lit("sections").alias("collection"), F.col("section_index").alias("at"), F.col("section_text").alias("text"), "section_index", "section_title", "section_type", "paragraph_count")
    # each meets the papers before the union, as the lines are dealt by paper already
    described = [_described(rows, metadata) for rows in (sc, p, t)]
    return _points(described[0].unionByName(described[1], allowMissingColumns=True).unionByName(described[2], allowMissingColumns=True))


def _sentence_point(lines: DataFrame) -> dict[str, Column]:
    """The columns of a line's own point."""
    cited = F.coalesce(F.size("citations"), F.lit(0)) > 0
    analysed = F.coalesce(F.col("argument_analysis")["has_argument_relations"], F.lit(False)) if "argument_analysis" in lines.columns else F.lit(False)
    kind = point_filter(cited, F.when(analysed, "CLAIM_MAIN"))
    return {"collection": F.lit("sentences"), "at": F.col("sentence_index").cast("long"), "text": F.col("sentence_text"), "sentence_index": F.col("sentence_index").cast("int"), "sentence_type": kind, "has_citations": cited}


def _points(rows: DataFrame) -> DataFrame:
    """rows as points with all columns of schemas.POINT, null where a collection has none."""
    got = index(rows, F.col("collection"), keys=("paper_id", "at"))
    fields = [f.strip().split(" ", 1) for f in schemas.POINT.split(", ")]
    return got.select(*((F.col(c) if c in got.columns else F.lit(None)).cast(t).alias(c) for c, t in fields))


def to_points(lines: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Points of the collection of sentences alone."""
    if metadata is None:
        metadata = lines.select("paper_id").distinct()
    lines = lines.where("paper_id is not null")
    return _points(_described(lines.select("paper_id", *(c.alias(n) for n, c in _sentence_point(lines).items())), metadata))
