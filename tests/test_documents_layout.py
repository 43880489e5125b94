"""Placed characters to sections, sentences with their places, bundles of citations, routes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.operators import bundle as B
from quiremill.operators import graph as G
from quiremill.operators import layout as L
from quiremill.operators import rollup as U
from quiremill.operators import sentences as Z
from quiremill.plans import route


def page(lines):
    """lines: (y, size, text) as characters in any order."""
    out = [(x * 5.0, y, c, float(size)) for y, size, text in lines for x, c in enumerate(text)]
    random.Random(1).shuffle(out)
    return out


def test_a_page_of_characters_gives_sections(spark):
    first = [(700.0, 10, "42"), (650.0, 9, "words before any of the headings"), (600.04, 16, "Our own title"), (560.0, 10, "The body of it begins here,"), (548.96, 10, "and it goes on below."), (500.0, 10, "2. Methods"), (470.0, 10, "What was done to the data."), (440.0, 10, "   ")]
    second = [(700.0, 10, "It went on over the page."), (660.0, 10, "Conclusion"), (620.0, 10, "All of it worked as it should.")]
    rows = [("d", n, *c) for n, p in enumerate((first, second), 1) for c in page(p)] + [("e", 1, 0.0, 10.0, None, None), ("e", 1, 1.0, 10.0, "x", None)]
    chars = spark.createDataFrame(rows, "doc_id string, page int, x double, y double, char string, size double")
    lines = L.chars_to_lines(chars)
    assert [(r["y"], r["text"]) for r in lines.where("doc_id = 'd' and page = 1").orderBy(F.desc("y")).collect()] == [(round(y, 1), t) for y, _, t in first[:-1]]
    assert [(r["chars"], r["sizes"]) for r in lines.where("doc_id = 'e'").collect()] == [(2, 24.0)]
    blocks = L.placed_blocks(lines)
    assert [(r["text"], r["font_size"]) for r in blocks.where("doc_id = 'd' and page = 1").orderBy("block").collect()][3] == ("The body of it begins here,\nand it goes on below.", 10.0)
    got = L.read_layout(chars).where("doc_id = 'd'").orderBy("section_index").collect()
    assert [(r["section_index"], r["section_title"], r["section_type"], r["page_start"]) for r in got] == [(0, "", "other", 1), (1, "Our own title", "other", 1), (2, "2. Methods", "methodology", 1), (3, "Conclusion", "conclusion", 2)]
    assert got[1]["paragraphs"] == ["The body of it begins here, and it goes on below."] and got[2]["paragraphs"] == ["What was done to the data.", "It went on over the page."]
    assert L.read_layout(chars.limit(0)).count() == 0


BODY = "The first one cites Porter et al. (1985) and goes on well.  A second stands by itself here. It ends with a name, (Lee, 1999)\n(Kim, 2001) as the list continues. See Fig. 3 for more of that.\nBroken words are re-\njoined in the last sentence. All rights reserved by someone."


def test_spans_point_into_the_text():
    r = random.Random(3)
    words = ["Alpha", "beta", "et al.", "(2001)", "vs.", "gamma.", "Delta!", ", (Lee, 1999)", "ok?", "\n", "  ", "Émile", "Dr.", "x"]
    for _ in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 25)))
        found, at = list(Z.spans(text)), 0
        for a, z, joined in found:
            assert at <= a < z <= len(text) and not text[at:a].strip()
            assert text[a:z] == text[a:z].strip() and re.sub(r"\s+", "", text[a:z]) == re.sub(r"\s+", "", joined)
            at = z
        assert not text[at:].strip()
    assert [s for _, _, s in Z.spans(BODY)][:3] == ["The first one cites Porter et al. (1985) and goes on well.", "A second stands by itself here.", "It ends with a name, (Lee, 1999)\n(Kim, 2001) as the list continues."]


def test_spans_equal_the_separate_steps(spark):
    """Split, then joined, as functions.text and operators.rollup do it one after the other."""
    texts = [BODY, "One. Two! Three? four. Five", "A. b. C et al. D (1999). E", "", "no end", "Smith et al. (2001) said so. Mr. Brown did not."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    want = df.select("doc_id", U.merge_sentences(X.sentences(F.col("text"))).alias("s")).orderBy("doc_id").collect()
    for t, w in zip(texts, want, strict=True):
        assert [s for _, _, s in Z.spans(t)] == list(w["s"])


def test_parse_sentences(spark):
    text = BODY + "\nReferences\nPorter, M. (1985). A title. Journal of it."
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "# Head\n\nSome **bold** words stand in this sentence. `code` And a last one of them here.", "z")], "doc_id long, text string, start string")
    got = Z.parse_sentences(df).where("doc_id < 3").orderBy("doc_id", "sentence_index").collect()
    assert [r["sentence_index"] for r in got] == list(range(len(got)))
    assert all(text[r["start"] : r["end"]] == r["raw"] for r in got)
    assert [r["sentence"] for r in got] == [
        "The first one cites Porter et al. (1985) and goes on well.", "A second stands by itself here.",
        "It ends with a name, (Lee, 1999) (Kim, 2001) as the list continues.", "See Fig. 3 for more of that.", "Broken words are rejoined in the last sentence.",
    ]
    marked = Z.parse_sentences(df.where("doc_id = 3"), markdown=True)
    plain = df.where("doc_id = 3").select(X.strip_markdown(F.col("text")).alias("t")).first()["t"]
    rows = marked.orderBy("sentence_index").collect()
    assert [r["sentence"] for r in rows] == ["Head Some bold words stand in this sentence.", "And a last one of them here."]
    assert all(plain[r["start"] : r["end"]] == r["raw"] for r in rows)


def small_graph(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return G.Graph(
        make([("A", "Ta", 1990, "J", False), ("T", "Target", 1980, "J", False)], "paper_id string, title string, year int, journal string, stub boolean"),
        make([("p1", "A", 0, "Intro", 1990)], "paragraph_id string, paper_id string, paragraph_index int, section string, year int"),
        make([("s1", "A", "p1", 0, 1990)], "sentence_id string, paper_id string, paragraph_id string, sentence_index int, year int"),
        make([("s1", "T")], "sentence_id string, cited_id string"), make([("p1", "T", 1)], "paragraph_id string, cited_id string, citation_count int"),
    )


def test_bundle(spark):
    points = spark.createDataFrame(
        [("c1", "A", "Ta", "(Doe, 1980)", "said in A (Doe, 1980)", [1.0, 0.0]), ("c2", "B", "Tb", "(Doe & Lee, 1980)", "said in B", [0.9, 0.1]), ("c3", "C", "Tc", "(Roe, 1980)", "said in C", [0.8, 0.1]), ("c4", "D", "Td", "(Doe, 1999)", "far off", [-1.0, 0.0])],
        "id string, paper_id string, title string, text string, citation_context string, vector array<double>",
    )
    names = B.asked_for(["Jane Doe", "Cher"], "Target")
    assert names == ["Doe", "Jane Doe", "Cher", "Target"] and B.asked_for([]) == []
    asked = B.questions(spark, names, lambda n: [1.0, 0.0])
    g = small_graph(spark)
    got = B.reverse_citations(g, points, asked, "T", ["Jane Doe", "Cher"], "Target", 3)
    assert sorted(map(tuple, got["citing_papers"].collect())) == [("A", "Ta", "graph"), ("B", "Tb", "vector")]
    assert sorted((r["paper_id"], r["origin"], r["sentence_text"]) for r in got["citing_sentences"].collect()) == [("A", "graph", None), ("B", "vector", "said in B")]
    assert got["citing_paragraphs"].count() == 1
    alone = B.reverse_citations(g, points, asked, None, ["Jane Doe"], "", 3)
    assert sorted(map(tuple, alone["citing_papers"].collect())) == [("A", "Ta", "vector"), ("B", "Tb", "vector")] and alone["citing_paragraphs"].count() == 0
    assert B.reverse_citations(g, points, asked.limit(0), None)["citing_papers"].count() == 0
    assert B.forward_citations(g) == {} and B.forward_citations(g, "A")["cited_papers"].count() == 1


@pytest.mark.parametrize(
    ("asked", "target", "want"),
    [
        (("reverse_citation_analysis", "paper"), {"paper_id": "x"}, [("get_papers_citing_paper", {"paper_id": "x"}, "citing_papers", True), ("get_sentences_citing_paper", {"paper_id": "x"}, "citation_sentences", False)]),
        (("reverse_citation_analysis", "author"), {"name": "Porter"}, [("search_all_collections", {"query": "citations to Porter", "limit_per_collection": 10}, "search_results", True)]),
        (("citation_analysis", "paper"), {"paper_id": "x"}, [("get_papers_cited_by_paper", {"paper_id": "x"}, "cited_papers", True)]),
        (("citation_analysis", "paper"), {"name": "Porter"}, []),
        (("paper_search", "paper"), {"paper_id": "x", "title": "T"}, [("search_all_collections", {"query": "paper_id:x why so", "limit_per_collection": 10}, "search_results", True)]),
        (("paper_search", "paper"), {"title": "T"}, [("search_all_collections", {"query": "T", "limit_per_collection": 10}, "search_results", True)]),
        (("paper_search", "author"), {"name": "Porter"}, [("get_papers_id_by_author", {"author_name": "Porter"}, "author_papers", True)]),
        (("author_search", "author"), {"name": "Porter"}, [("get_papers_id_by_author", {"author_name": "Porter"}, "author_papers", True)]),
        (("concept_search", "concept"), {"name": "value chain"}, [("search_all_collections", {"query": "value chain", "limit_per_collection": 10}, "search_results", True)]),
        (("author_search", "paper"), {"name": "Porter"}, [("search_all_collections", {"query": "why so", "limit_per_collection": 10}, "search_results", True)]),
    ],
)
def test_routes(asked, target, want):
    assert [(s.method, s.params, s.result, s.required) for s in route.plan(*asked, target, "why so")] == want
    assert route.last_resort("why so").params == {"query": "why so", "limit_per_collection": 5}


def test_sentences_leave_python_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(Z, "AT_ONCE", 3)
    text = " ".join(f"Sentence number {i} goes on here." for i in range(10))
    df = spark.createDataFrame([(1, text), (2, None), (3, text[:31])], "doc_id int, text string")
    got = Z.exploded_spans(df, "text")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert [r["raw"] for r in got.where("doc_id = 1").orderBy("start").collect()] == [f"Sentence number {i} goes on here." for i in range(10)]
    assert Z.parse_sentences(df).groupBy("doc_id").count().orderBy("doc_id").collect()[0]["count"] == 10
