from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quiremill.functions import ids
from quiremill.functions import similarity as S
from quiremill.functions import text as X
from quiremill.functions.citations import citations, extract_citations, match_references, parse_document
from quiremill.operators import rollup as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_paper_id_is_the_known_hash(spark):
    assert one(spark, ids.same_paper(F.lit(" Imitation of   Complex Strategies!"), F.lit("2000-05"), F.lit("imitation of complex strategies"), F.lit("2000")))
    assert one(spark, ids.paper_id(F.lit("Imitation of Complex Strategies"), F.lit("2000"))) == "babcd89569ffe6cb373ed21a762c1799ace907d68f5cffa189e2d6be77af0504"


@pytest.mark.parametrize(("title", "want"), [(None, "unknown_title"), ("Unknown Title", "unknown_title"), ("!!", "unknown_title"), ("Özcan:  a  Study", "özcan a study")])
def test_normalize_title(spark, title, want):
    assert one(spark, ids.normalize_title(F.lit(title).cast("string"))) == want


@pytest.mark.parametrize(("year", "want"), [("1998-05", "1998"), ("0", "unknown_year"), (None, "unknown_year"), ("21999", "unknown_year")])
def test_normalize_year(spark, year, want):
    assert one(spark, ids.normalize_year(F.lit(year).cast("string"))) == want


def test_normalize_authors(spark):
    assert one(spark, ids.normalize_authors(F.lit("Ann Lee, Unknown; Bo  Ray and Cy-Day"))) == ["ann lee", "bo ray", "cyday"]
    assert one(spark, ids.normalize_authors(F.lit(None).cast("string"))) == ["unknown_author"]


# Classes of citations, one or two sentences of our own for each.
CITATIONS = [
    ("Haugen (2015) began it.", ["(Haugen, 2015)"]),
    ("According to Ortiz (2003), it holds.", ["(Ortiz, 2003)"]),
    ("While Baker (1999) doubts it, others agree (Kim, 2001; Abe, 2002).", ["(Abe, 2002)", "(Baker, 1999)", "(Kim, 2001)"]),
    ("In the late 1990s, Reed and Moss (1997) found more.", ["(Reed and Moss, 1997)"]),
    ("Work by Park, Chen, and Diaz (2012) extends it.", ["(Park, Chen, and Diaz, 2012)"]),
    ("It holds (Park, Chen, and Diaz, 2012).", ["(Park, Chen, and Diaz, 2012)"]),
    ("Older types (Weiss and Lang 1971, Tran 1983) remain.", ["(Tran, 1983)", "(Weiss and Lang, 1971)"]),
    ("Some (e.g., Silva, 2010) and others (cf. Nowak, 2011; Horvat, 2012) differ.", ["(Horvat, 2012)", "(Nowak, 2011)", "(Silva, 2010)"]),
    ("Van Der Meer (2004) and O'Neill and MacRae (2006) agree.", ["(O'Neill and MacRae, 2006)", "(Van Der Meer, 2004)"]),
    ("See there (Ford, 2000, p. 12) and (Hall, 2001, pp. 3-9).", ["(Ford, 2000)", "(Hall, 2001)"]),
    ("New work [Jensen, 2019; Ruiz, 2020] follows.", ["(Jensen, 2019)", "(Ruiz, 2020)"]),
    ("According to International Labour Office (2009), rules changed.", ["(International Labour Office, 2009)"]),
    ("The year 2011 was warm, the table (see Table 2) says.", []),
    ("It ended in one year (2014).", []),
    ("In 2017, results were (not closed", []),
    ("Grant wrote much.", []),
    ("Studies by Çelik et al. (2016: 44) and Łuczak (2018) agree.", ["(Çelik et al., 2016)", "(Łuczak, 2018)"]),
    ("Both (Jean-Luc and Ångström, 2013; see also Ray & Fox, 1995a, for more).", ["(Jean-Luc and Ångström, 2013)", "(Ray & Fox, 1995a)"]),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CITATIONS)
def test_citations(text, want):
    assert citations(text) == sorted(want)


def test_parse_document(spark):
    s = spark.createDataFrame([("d", 0, "Lee (2001) and (Ray, 2002)."), ("d", 1, "None.")], "doc string, sentence_index int, text string")
    r = spark.createDataFrame([("d", 0, ["Ann Lee"], "2001"), ("d", 1, ["Bo Lee"], "2001"), ("d", 2, ["Cy Ray"], "2002-01")], "doc string, ref_no int, authors array<string>, year string")
    assert [tuple(x) for x in parse_document(s, r).collect()] == [("d", 0, "(Lee, 2001)", 0)]
    assert match_references(s.limit(0).select("doc", F.lit("(Lee, 2001)").alias("intext")), r).count() == 0


def test_ratio_is_not_symmetric(spark):
    rows = [("tide", "diet"), ("diet", "tide"), ("kitten", "sitting")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(S.seq_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in rows]
    assert got[:2] == [0.25, 0.5]


def test_part_confidence(spark):
    title = F.lit("competitive strategy")
    assert round(one(spark, S.part_confidence(F.lit("strategy"), title)), 6) == 0.48
    assert round(one(spark, S.part_confidence(F.lit("competitive"), title)), 6) == 0.76


def test_name_tokens(spark):
    assert one(spark, S.name_tokens(F.lit("Michael E. Porter"))) == ["michael", "e", "porter"]
    assert one(spark, S.name_tokens(F.lit("J.R.R. Tolkien"))) == ["j.r.r", "tolkien"]


def test_occurrences_overlap(spark):
    assert one(spark, X.occurrences(F.lit("aaaa"), "aa")) == [0, 1, 2]
    assert one(spark, X.occurrences(F.lit("xAaxa.a"), "a")) == [1, 2, 4, 6]
    assert one(spark, X.occurrences(F.lit("abc"), "a.c")) == []
    assert one(spark, X.occurrences(F.lit("abc"), "")) == []


def test_sentences_keep_abbreviations(spark):
    assert one(spark, X.sentences(F.lit("See Fig. 2 by Lee et al. (2001). Next one? Yes."))) == ["See Fig. 2 by Lee et al. (2001).", "Next one?", "Yes."]
    assert one(spark, X.sentence_count(F.lit("a. b. c."))) == 4


def test_merge_sentences(spark):
    rows = spark.createDataFrame([(["It was Lee et al.", "(2001) who said.", "Then", "more came."],)], "a array<string>")
    assert rows.select(U.merge_sentences("a")).first()[0] == ["It was Lee et al. (2001) who said.", "Then more came."]


def test_clean_sentence(spark):
    assert one(spark, X.clean_sentence(F.lit("bro- \n ken\x07 text\n\nhere   now "))) == "broken text here now"


def test_split_references(spark):
    got = one(spark, X.split_references(F.lit("Body.\nReferences\nA. 2001")))
    assert got["main"] == "Body." and got["references"].startswith("\nReferences")
    assert one(spark, X.split_references(F.lit("Body only")))["references"] == ""


def test_reference_density(spark):
    lines = ["Plain line of the body that is long enough."] * 20 + [f"{i}. Smith, A. Journal of Tests, 20{i:02d}." for i in range(10, 20)]
    text = "\n".join(lines)
    at = spark.createDataFrame([(text,)], "t string").select(U.reference_start_by_density("t")).first()[0]
    assert at == text.index("\n".join(lines[15:]))


def test_furniture_and_headings(spark):
    for t, want in [("12", True), ("Page 3", True), ("© Someone 2001", True), ("www.example.org", True), ("Smith et al.", True), ("A plain sentence about strategy.", False)]:
        assert one(spark, X.is_block_furniture(F.lit(t))) is want, t
    for t, size, want in [("1. Introduction", 10.0, True), ("RELATED WORK", 10.0, True), ("some words of plain text that go on", 10.0, False), ("some words of plain text that go on", 14.0, True)]:
        assert one(spark, X.is_heading(F.lit(t), size)) is want, t


def test_markdown(spark):
    assert one(spark, X.strip_markdown(F.lit("# Title\n\n**bold** and [link](http://x) `code`"))) == "Title\n\nbold and link"
    assert one(spark, X.page_estimate(F.lit("x" * 4100))) == 2
    assert one(spark, X.page_estimate(F.lit("a\n---\nb\nPage 4"))) == 2


def test_fenced_json(spark):
    assert one(spark, X.fenced_json(F.lit('so:\n```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.fenced_json(F.lit('so {"a": {"b": 2}} end'))) == '{"a": {"b": 2}}'
    assert one(spark, X.fenced_json(F.lit("none"))) is None


def test_language(spark):
    assert one(spark, X.detect_language(F.lit("这 是 论文"))) == "zh"
    assert one(spark, X.detect_language(F.lit("!!"))) == "en"


# Goldens that a query over literal rows held before.
CITED = {
    "Lindqvist (2014) set the frame.": ["(Lindqvist, 2014)"],
    "Earlier surveys (Okafor and Brandt, 2009; Ivanova 2011) differ.": ["(Ivanova, 2011)", "(Okafor and Brandt, 2009)"],
    "Work by Nguyen et al. (2018: 33) is wider.": ["(Nguyen et al., 2018)"],
    "See the appendix (Table 3) of 2016.": [],
    "Both agree [Çelik, Ó Briain, and Søndergaard, 2020].": ["(Çelik, Ó Briain, and Søndergaard, 2020)"],
}


def test_citation_goldens(spark):
    rows = spark.createDataFrame([(s,) for s in CITED], "text string")
    assert [r[0] for r in rows.select(extract_citations("text")).collect()] == list(CITED.values())


def test_reference_match(spark):
    cites = spark.createDataFrame([(1, "(Porter, 1980)"), (1, "(Miles and Snow, 1978)"), (1, "(Unknown, 1999)"), (2, "(Porter, 1980)"), (2, "(Miles and Snow, 1978)")], "doc int, intext string")
    refs = spark.createDataFrame([(1, 0, ["Michael Porter"], "1980"), (1, 1, ["A. Porter"], "1980"), (1, 2, ["Raymond Miles", "Charles Snow"], "1978"), (2, 0, ["M. Porter"], "1980"), (2, 1, ["C. Snow"], "1978-05")], "doc int, ref_no int, authors array<string>, year string")
    assert sorted(map(tuple, match_references(cites, refs).collect())) == [(1, "(Miles and Snow, 1978)", 2), (1, "(Porter, 1980)", 0), (2, "(Porter, 1980)", 0)]


def test_citation_extraction_over_whole_texts(spark):
    from quiremill.plans import star

    data = "/root/testdata/sf0.001"
    want = {r["doc_id"]: "|".join(citations(r["text"])) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r["doc_id"]: r["cites"] for r in star.QUERIES["citation_extraction"](spark, data).collect()} == want


def test_quality_reads_a_text_once(spark):
    """Each pass over the text stands once in the plan, however often its figure is used; plain words score by hand."""
    from quiremill.plans import more

    plan = more.quality_levels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f) for f in ("regexp_replace(", "regexp_extract_all(", "split(")] == [1, 1, 1]
    got = spark.createDataFrame([("alpha beta gamma delta",), ("§§§§§ abc",), ("a b c é",), ("",), (None,)], "t string").select(X.quality_score(F.col("t")).alias("q")).collect()
    # length, density of words, pages, less two for odd characters and for short words
    assert [round(r["q"], 6) for r in got] == [6.0022, 4.0009, 1.0007, 0.0, 0.0]


def test_noise_of_empty_texts_is_that_of_sql(spark, tmp_path):
    import duckdb

    from quiremill.plans import star

    spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, "a b"), (5, "§§ a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = star.SQL["noise_filter"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    got = star.noise_filter(spark, str(tmp_path)).collect()
    assert plain(got) == plain(duckdb.sql(sql).fetchall()) and {r["doc_id"]: r["is_noise"] for r in got} == {1: True, 2: None, 3: True, 4: False, 5: True}
