"""Processed documents into graph tables and vector collections."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quiremill import schemas
from quiremill.operators import graph as G
from quiremill.sources import imports as I
from quiremill.sources import papers as P


def cite(paper, title="T", intext=None, analysis=None, confidence=None, year="2001-03"):
    return {"intext": intext or f"({paper}, 2001)", "reference": {"title": title, "year": year, "authors": ["Doe"], "journal": "J"}, "paper_id": paper, "confidence": confidence, "argument_analysis": analysis}


def said(*entities):
    return {"has_argument_relations": True, "entities": [{"relation_type": k, "confidence": c, "entity_text": "x", "start_pos": 0, "end_pos": 1} for k, c in entities]}


ROWS = [
    (0, "First claim (A, 2001) holds.", [cite("A", "Ta", analysis=said(("SUPPORTS", 0.9), ("EXTENDS", 0.4))), cite("A", "Ta")], 5, 28, None, {"has_argument_relations": True, "entities": []}, "P1"),
    (1, "Nothing here at all.", [], 4, 20, None, None, "P1"),
    (2, "Another one (B, 1999).", [cite(None, "A Title of B", "(B, 1999)", year="1999"), cite(None, None, "(nobody)")], 4, 22, None, None, "P1"),
    (0, "P2 cites (P1, 2000).", [cite("P1", "Other title of P1", confidence=0.5)], 4, 20, None, None, "P2"),
    (1, None, None, None, None, "unreadable", None, "P2"),
]
META = [("P1", "First", ["Ann", "Bob"], "1999", "10.1/a", "J1", "abstract one"), ("P2", "Second", None, "Unknown", None, None, None), ("P3", "No sentences", ["C"], "0", None, None, None)]
PARAGRAPHS = [("P1", 0, "First claim (A, 2001) holds. Nothing here at all.", "Intro", 2), ("P1", 1, "Another one (B, 1999). And more.", None, 0), ("P2", 0, "P2 cites (P1, 2000).", "Intro", 1)]


@pytest.fixture(scope="module")
def given(spark):
    lines = spark.createDataFrame(ROWS, schemas.SENTENCE_LINE + ", paper_id string")
    meta = spark.createDataFrame(META, "paper_id string, title string, authors array<string>, year string, doi string, journal string, abstract string")
    return lines, meta, spark.createDataFrame(PARAGRAPHS, f"paper_id string, {schemas.PARAGRAPH_LINE}")


B = hashlib.sha256(b"a title of b_1999").hexdigest()


@pytest.mark.parametrize("written", [False, True])
def test_one_import_fills_a_graph(spark, given, tmp_path, written):
    path = str(tmp_path / "graph") if written else None
    g = I.import_documents(I.assemble(*given), path)
    papers = {r["paper_id"]: r for r in g["papers"].collect()}
    assert set(papers) == {"P1", "P2", "P3", "A", B}
    assert (papers["P1"]["title"], papers["P1"]["year"], papers["P1"]["stub"], papers["P1"]["authors"], papers["P1"]["doi"], papers["P1"]["abstract"]) == ("First", 1999, False, ["Ann", "Bob"], "10.1/a", "abstract one")
    assert (papers["A"]["title"], papers["A"]["stub"], papers["A"]["authors"], papers["A"]["journal"]) == ("Ta", True, ["Doe"], "J")
    assert (papers["P2"]["year"], papers[B]["year"]) == (None, 1999)
    # paragraphs of two papers with one number are two
    assert {r["paragraph_id"]: (r["section"], r["year"]) for r in g["paragraphs"].collect()} == {"P1_para_0": ("Intro", 1999), "P1_para_1": ("Unknown", 1999), "P2_para_0": ("Intro", None)}
    assert {r["sentence_id"]: (r["paragraph_id"], r["has_citations"]) for r in g["sentences"].collect()} == {
        "P1_sent_0": ("P1_para_0", True), "P1_sent_1": ("P1_para_0", False), "P1_sent_2": ("P1_para_1", True), "P2_sent_0": ("P2_para_0", True), "P2_sent_1": ("P2_para_unknown", False),
    }
    assert sorted((r["sentence_id"], r["cited_id"], r["citation_text"], r["confidence"]) for r in g["sentence_cites"].collect()) == [
        ("P1_sent_0", "A", "(A, 2001)", 1.0), ("P1_sent_0", "A", "(A, 2001)", 1.0), ("P1_sent_2", B, "(B, 1999)", 1.0), ("P2_sent_0", "P1", "(P1, 2001)", 0.5),
    ]
    assert {(r["paragraph_id"], r["cited_id"]): (r["citation_count"], r["citation_density"]) for r in g["paragraph_cites"].collect()} == {("P1_para_0", "A"): (2, 1.0), ("P1_para_1", B): (1, 1.0), ("P2_para_0", "P1"): (1, 1.0)}
    assert {r["argument_id"]: r["claim_type"] for r in g["arguments"].collect()} == {"P1_sent_0": "CLAIM_MAIN", "P1_sent_2": "NEUTRAL", "P2_sent_0": "NEUTRAL"}
    assert {(r["from_id"], r["to_id"], r["relation_type"]): (r["mentions"], r["confidence"]) for r in g["relations"].collect()} == {
        ("P1_sent_0", "A", "SUPPORTS"): (1, 0.9), ("P1_sent_0", "A", "EXTENDS"): (1, 0.4), ("P1_sent_0", "A", "CITES"): (1, None),
        ("P1_sent_2", B, "CITES"): (1, None), ("P2_sent_0", "P1", "CITES"): (1, None),
    }
    assert {(r["citing_id"], r["cited_id"]): r["citation_count"] for r in g["paper_cites"].collect()} == {("P1", "A"): 2, ("P1", B): 1, ("P2", "P1"): 1}
    graph = I.graph_of(g)
    assert [(r["paper_id"], r["sentence_citations"], r["paragraph_citations"]) for r in G.citing_papers(graph, "P1").collect()] == [("P2", 1, 1)]
    assert {r["paragraph_id"] for r in G.sentence_paths(graph, "A").collect()} == {"P1_para_0"}
    if written:
        assert {p.name for p in (tmp_path / "graph" / "nodes").iterdir() if p.is_dir()} == {f"kind={k}" for k in ("papers", "paragraphs", "sentences", "sentence_cites", "arguments", "relations")}
        assert I.read_tagged(spark, path).where("kind = 'sentences'").count() == 5


def test_import_of_nothing(spark, given):
    g = I.import_documents(I.assemble(*(x.limit(0) for x in given)))
    assert {k: v.count() for k, v in g.items()} == dict.fromkeys(g, 0)


def test_plain_lines_to_graph(spark):
    """Lines without analysis, metadata with three columns only."""
    lines = spark.createDataFrame([("P1", 0, "One.", [("(A)", ("Ta", "2001"), "A")])], "paper_id string, sentence_index int, sentence_text string, citations array<struct<intext:string,reference:struct<title:string,year:string>,paper_id:string>>")
    g = I.to_graph(lines, spark.createDataFrame([("P1", "First", "1999")], "paper_id string, title string, year string"))
    assert {r["paper_id"]: r["stub"] for r in g["papers"].collect()} == {"P1": False, "A": True}
    assert [r["claim_type"] for r in g["arguments"].collect()] == ["NEUTRAL"] and [r["relation_type"] for r in g["relations"].collect()] == ["CITES"]


def test_structure_from_sentence_lines(spark):
    said = ["Opening words of it.", "1. Introduction", *(f"Sentence number {i} of the body goes on." for i in range(7)), "Results", "It worked out in the end."]
    lines = spark.createDataFrame([("P", i, s, []) for i, s in enumerate(said)], f"paper_id string, sentence_index int, sentence_text string, citations array<{schemas.CITATION}>")
    paragraphs, sections = I.structure(lines)
    assert [(r["section_index"], r["section_title"], r["section_type"], r["paragraph_count"]) for r in sections.orderBy("section_index").collect()] == [(0, "", "other", 1), (1, "1. Introduction", "introduction", 2), (2, "Results", "results", 1)]
    got = paragraphs.orderBy("paragraph_index").collect()
    assert [(r["paragraph_index"], r["section"], r["sentence_count"]) for r in got] == [(0, "", 1), (1, "1. Introduction", 5), (2, "1. Introduction", 2), (3, "Results", 1)]
    assert got[1]["paragraph_text"] == " ".join(said[2:7]) and " ".join(r["paragraph_text"] for r in got) == " ".join(s for s in said if s not in ("1. Introduction", "Results"))


def test_four_collections(spark, given):
    points = I.collections(*given)
    assert points.dtypes == [(f.split(" ")[0], f.split(" ", 1)[1]) for f in schemas.POINT.split(", ")]
    rows = points.collect()
    by = lambda c: sorted((r for r in rows if r["collection"] == c), key=lambda r: (r["paper_id"], r["sentence_index"] or r["paragraph_index"] or r["section_index"] or r["citation_index"] or 0))
    assert [(r["paper_id"], r["sentence_type"]) for r in by("sentences")] == [("P1", "CLAIM_MAIN"), ("P1", "content"), ("P1", "citation"), ("P2", "citation"), ("P2", "content")]
    assert [(r["paper_id"], r["citation_count"], r["has_citations"], r["section"]) for r in by("paragraphs")] == [("P1", 2, True, "Intro"), ("P1", 2, True, ""), ("P2", 1, True, "Intro")]
    assert [(r["paper_id"], r["section_type"], r["paragraph_count"]) for r in by("sections")] == [("P1", "other", 1), ("P2", "other", 1)]
    assert [(r["citation_index"], r["text"], r["cited_paper_id"], r["confidence"]) for r in by("citations")] == [(0, "(A, 2001)", "A", 1.0), (1, "(A, 2001)", "A", 1.0), (2, "(B, 1999)", B, 1.0), (3, "(nobody)", None, 1.0), (0, "(P1, 2001)", "P1", 0.5)]
    first = by("sentences")[0]
    assert (first["title"], first["authors"], first["year"], first["doi"], first["publisher"]) == ("First", ["Ann", "Bob"], "1999", "10.1/a", "Unknown") and len(first["vector"]) == 384
    # indexing again adds nothing
    again = G.upsert(points.withColumn("seq", F.lit(1)), I.collections(*given).withColumn("seq", F.lit(2)), ["id"], "seq")
    assert again.count() == len(rows)


def test_store_and_folders(spark, given, tmp_path):
    lines, meta, paragraphs = given
    P.write_processed(str(tmp_path / "s"), sentences=lines, metadata=meta, paragraphs=paragraphs)
    assert sorted(map(str, P.read_stored(spark, str(tmp_path / "s"), "sentences").select(*lines.columns).collect())) == sorted(map(str, lines.collect()))
    assert sorted(map(str, P.read_stored(spark, str(tmp_path / "s"), "paragraphs").select(*paragraphs.columns).collect())) == sorted(map(str, paragraphs.collect()))
    P.export_folders(lines, meta, str(tmp_path / "f"))
    back, meta2 = P.read_processed(spark, str(tmp_path / "f" / "sentences"), "*.json"), P.read_metadata(spark, str(tmp_path / "f" / "metadata"), "*.json")
    assert sorted((r["paper_id"], r["sentence_index"]) for r in back.collect()) == [("P1", 0), ("P1", 1), ("P1", 2), ("P2", 0), ("P2", 1)]
    g = I.to_graph(back, meta2)
    assert {r["claim_type"] for r in g["arguments"].collect()} == {"CLAIM_MAIN", "NEUTRAL"} and g["papers"].count() == 5


def test_lines_fill_the_same_graph_unassembled(spark, given):
    """From each table what it needs: no document is assembled, a filter by the cited paper comes before paragraphs and sentences meet."""
    lines, meta, paragraphs = given
    more = paragraphs.unionByName(spark.createDataFrame([("P9", 0, "Of no paper.", "Intro", 1)], paragraphs.schema))
    whole, parts = I.import_documents(I.assemble(lines, meta, more)), I.import_lines(lines, meta, more)
    assert whole.keys() == parts.keys()
    for k, df in whole.items():
        assert sorted(map(str, parts[k].select(*df.columns).collect())) == sorted(map(str, df.collect())), k
    plan = parts["paragraph_cites"].where("cited_id = 'A'")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.index("Join") < plan.index("= A")
    far = lines.withColumn("sentence_index", F.col("sentence_index") + F.lit(1 << 40))
    assert I.import_lines(far, meta, more)["sentences"].agg(F.min("sentence_index")).first()[0] == 1 << 40


def test_lines_that_share_a_number_count_once_each(spark):
    """Two lines of one number: each adds its own citation to the paragraph, and citations are numbered through."""
    rows = [(0, "One thing (A, 2001).", [cite("A"), cite("B")], None, None, None, None, "P"), (0, "Other thing (A, 2001).", [cite("A")], None, None, None, None, "P")]
    lines = spark.createDataFrame(rows, schemas.SENTENCE_LINE + ", paper_id string")
    paragraphs = spark.createDataFrame([("P", 0, "One thing (A, 2001). Other thing (A, 2001).", "", 2)], f"paper_id string, {schemas.PARAGRAPH_LINE}")
    got = I.collections(lines, lines.select("paper_id").distinct(), paragraphs).collect()
    assert [r["citation_count"] for r in got if r["collection"] == "paragraphs"] == [3]
    assert sorted((r["citation_index"], r["sentence_index"], r["sentence_type"]) for r in got if r["collection"] == "citations") == [(i, None, None) for i in range(3)]
    assert [(r["sentence_index"], r["sentence_type"], r["citation_index"], r["confidence"]) for r in got if r["collection"] == "sentences"] == [(0, "citation", None, None)] * 2


@pytest.mark.parametrize("name", ["filed_papers", "filed_relations", "filed_sentence_cites"])
def test_citations_are_rows_before_they_are_read(spark, name):
    """No function runs interpreted over the array of a line's citations."""
    from quiremill.plans import more, star  # noqa: F401  (more adds its queries to star's)

    plan = star.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Generate" in plan


def test_points_deal_lines_by_paper_without_whole_citations(spark, given):
    """What a point needs of a citation is taken out first, and paragraphs get their counts where they meet their sentences."""
    lines, meta, paragraphs = given
    got = I.collections(lines, meta, paragraphs.unionByName(spark.createDataFrame([("P1", 2, None, None, 0)], paragraphs.schema)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert dealt and not any("paragraph_index#" in x for x in dealt)
    kept = {(r["paper_id"], r["paragraph_index"]): (r["text"], r["citation_count"], r["has_citations"]) for r in got.where("collection = 'paragraphs'").collect()}
    assert kept == {("P1", 0): (PARAGRAPHS[0][2], 2, True), ("P1", 1): (PARAGRAPHS[1][2], 2, True), ("P1", 2): (None, 0, False), ("P2", 0): (PARAGRAPHS[2][2], 1, True)}
