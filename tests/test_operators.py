import datetime as dt
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.operators import authors as A
from quiremill.operators import content as C
from quiremill.operators import graph as G
from quiremill.operators import resolve as R
from quiremill.operators import rollup as U
from quiremill.operators import vectors as V
from quiremill.plans import route
from quiremill.sources import papers as P


def tiny(spark):
    papers = spark.createDataFrame([("P1", "one", 2001, None, False), ("P2", "two", None, None, False), ("P3", "three", 1999, None, False), ("S1", "stub", 1980, None, True)], "paper_id string, title string, year int, journal string, stub boolean")
    paragraphs = spark.createDataFrame([("P1#0", "P1", 0, "x", 2001), ("P3#0", "P3", 0, "x", 1999)], "paragraph_id string, paper_id string, paragraph_index int, section string, year int")
    sentences = spark.createDataFrame([("s1", "P1", "P1#0", 0, 2001), ("s2", "P1", "P1#0", 1, 2001), ("s3", "P2", None, 0, None), ("s4", "P3", "P3#0", 0, 1999)], "sentence_id string, paper_id string, paragraph_id string, sentence_index int, year int")
    cites = spark.createDataFrame([("s1", "S1"), ("s2", "S1"), ("s3", "S1"), ("s4", "P1")], "sentence_id string, cited_id string")
    para = G.paragraph_citations(sentences.where("paragraph_id is not null"), cites)
    return G.Graph(papers, paragraphs, sentences, cites, para)


def test_graph_by_hand(spark):
    g = tiny(spark)
    assert [tuple(r)[:4] for r in G.citing_papers(g, "S1").collect()] == [("P1", 2, 1, 3)]
    assert [tuple(r)[:4] for r in G.citing_papers(g, "S1", require_paragraph=False).collect()] == [("P1", 2, 1, 3), ("P2", 1, 0, 1)]
    assert [tuple(r) for r in G.cited_papers(g, "P2").collect()] == [("S1", 1, 0, 1)]
    assert [r["sentence_id"] for r in G.citing_sentences(g, "S1").collect()] == ["s3", "s1", "s2"]
    assert g.paragraph_cites.where("paragraph_id = 'P1#0'").first()["citation_density"] == 1.0
    assert tuple(G.network_overview(g).first()) == (4, 3, 1, 3, 4)
    assert tuple(G.stub_ranking(g).first()) == ("S1", 2)
    assert G.citing_papers(g, "none").count() == 0
    assert tuple(G.graph_totals(g).first()) == (4, 2, 4, 4)
    n = G.nested_network(G.citation_network(g, "P1")).first()
    assert [tuple(x) for x in n["cites"]] == [("S1", 2)] and [tuple(x) for x in n["cited_by"]] == [("P3", 1)]


def test_stub_never_beats_a_record(spark):
    papers = spark.createDataFrame([("S1", "t", True, 1)], "paper_id string, title string, stub boolean, seq int")
    real = spark.createDataFrame([("S1", "real", False, 2)], papers.schema)
    again = spark.createDataFrame([("S1", "t", True, 3), ("N", "n", True, 3)], papers.schema)
    got = {r["paper_id"]: (r["title"], r["stub"]) for r in G.upsert_papers(G.upsert_papers(papers, real, "seq"), again, "seq").collect()}
    assert got == {"S1": ("real", False), "N": ("n", True)}
    assert G.with_stubs(real, again.drop("stub")).count() == 2


def test_relate(spark):
    args = spark.createDataFrame([("a",), ("b",)], "argument_id string")
    papers = spark.createDataFrame([("p",)], "paper_id string")
    rel = spark.createDataFrame([("a", "b", "X", 0.1, 1), ("a", "b", "X", 0.2, 2), ("a", "p", "Y", 0.3, 1), ("a", "q", "Y", 0.3, 1), ("z", "b", "Y", 0.3, 1)], "from_id string, to_id string, relation_type string, confidence double, seq int")
    got = {(r["from_id"], r["to_id"]): (r["confidence"], r["target_kind"]) for r in G.relate(rel, args, papers).collect()}
    assert got == {("a", "b"): (0.2, "argument"), ("a", "p"): (0.3, "paper")}


def test_sentence_to_paragraph(spark):
    s = spark.createDataFrame([("p", "s1", "bc"), ("p", "s2", "zz"), ("q", "s3", "bc")], "paper_id string, sentence_id string, text string")
    p = spark.createDataFrame([("p", "x1", 1, "abcd"), ("p", "x0", 0, "bcd")], "paper_id string, paragraph_id string, paragraph_index int, text string")
    got = {r["sentence_id"]: r["paragraph_id"] for r in G.first_containing_paragraph(s, p).collect()}
    assert got == {"s1": "x0", "s2": "unknown_paragraph", "s3": "unknown_paragraph"}


def test_author_index(spark):
    papers = spark.createDataFrame([("p1", ["Ann Lee", "Bo Ray"], 1), ("p2", ["ANN LEE "], 2)], "paper_id string, authors array<string>, seq int")
    authors, links = A.build(papers)
    assert {r["normalized_name"]: r["name"] for r in authors.collect()} == {"ann lee": "Ann Lee", "bo ray": "Bo Ray"}
    assert [r["paper_count"] for r in A.paper_counts(authors, links).collect()] == [2, 1]
    meta = spark.createDataFrame([("p1", 2001, "x", None), ("p2", 2003, "y", "/f")], "paper_id string, year int, title string, pdf_path string")
    assert [r["paper_id"] for r in A.papers_of("ann", authors, links, meta).collect()] == ["p2", "p1"]
    assert A.papers_of("ann", authors, links, meta, exact=True).count() == 0
    files = spark.createDataFrame([("/a/p1.pdf",), ("/a/some_strategy_text.pdf",)], "path string")
    want = spark.createDataFrame([("p1", "whatever"), ("p9", "Strategy of firms"), ("p8", "zzz")], "paper_id string, title string")
    assert {r["paper_id"]: r["path"] for r in A.find_path(want, files).collect()} == {"p1": "/a/p1.pdf", "p9": "/a/some_strategy_text.pdf"}


def test_resolution(spark):
    papers = spark.createDataFrame([("1", "Competitive Strategy", ["Michael E. Porter"], 1980), ("2", "Competitive Strategies", ["A. Porter", "Porter"], 1990), ("3", "Other", ["Jo Day"], 2000)], "paper_id string, title string, authors array<string>, year int")
    got = R.by_title(papers, "competitive strategy").collect()
    assert got[0]["paper_id"] == "1" and got[0]["is_part"] and got[0]["status"] == "single_match"
    assert R.by_title(papers, "competitive strategy", year=1990).first()["paper_id"] == "2"
    by = R.by_author(papers, "porter").collect()
    assert [(r["paper_id"], round(r["match_ratio"], 3)) for r in by] == [("2", 1.0), ("1", 0.333)]
    assert by[0]["all_matches"] == ["A. Porter", "Porter"]
    e = papers.select(R.question_entities(F.lit("What did Porter say about strategy in 1980?")).alias("e")).first()["e"]
    assert e["year"] == 1980 and "Porter" in e["author"]
    assert tuple(papers.select(R.possessive_year(F.lit("Teece's 2010 paper")).alias("e")).first()["e"]) == ("Teece", 2010)
    assert papers.select(R.cites_target(F.lit("as porter said"), F.col("authors"), F.col("title")).alias("x")).first()["x"]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((200, 8)).astype(np.float32)
    pts = spark.createDataFrame([(i, m[i].tolist(), str(i % 4)) for i in range(200)], "id long, vector array<float>, collection string")
    q = m[3].tolist()
    want = np.argsort(-(m.astype(float) @ m[3].astype(float)), kind="stable")[:7].tolist()
    assert [r["id"] for r in V.search(pts, q, 7, "dot").collect()] == want
    assert V.search_collections(pts, q, 2).count() == 8
    assert {r["id"] for r in V.search_many(pts, {1: q}, 7).collect()} == set(want)
    rows = spark.createDataFrame([("p", 0, "some text"), ("p", 1, "more")], "paper_id string, idx int, text string")
    i = V.index(rows, "sentences")
    assert i.select("id").distinct().count() == 2 and abs(sum(x * x for x in i.first()["vector"]) - 1) < 1e-5


def test_content(spark):
    s = spark.createDataFrame([("p", 0, "Intro", "The model. A MODEL again"), ("p", 1, "End", "nothing")], "paper_id string, section_index int, title string, text string")
    got = C.kwic(s, "model", 10).collect()
    assert [(r["position"], r["highlight_start"], r["context"]) for r in got] == [(4, 4, "The model. A M"), (13, 5, "l. A MODEL agai")]
    whole = C.full_text(s).first()
    assert whole["full_text"].startswith("## Intro\n\nThe model.") and whole["total_word_count"] == 6
    assert C.semantic(s, "nothing", 0.5).first()["similarity"] > 0.99
    long = spark.createDataFrame([("p", "a" * 600 + "\n\n" + "b" * 600 + "\n\nshort")], "paper_id string, text string")
    assert C.chunks(long).count() == 2
    md = spark.createDataFrame([(1, "pre\n# One\ntext\n## Two\nmore")], "doc_id long, text string")
    assert [(r["title"], r["text"]) for r in C.markdown_sections(md).orderBy("section_index").collect()] == [("", "pre"), ("One", "text"), ("Two", "more")]
    lines = spark.createDataFrame([("p", y) for y in (0.0, 10.0, 50.0, 55.0)], "page string, y double")
    assert [r["block"] for r in C.lines_to_blocks(lines, ["page"]).orderBy("y").collect()] == [0, 0, 1, 1]
    p = spark.createDataFrame([("p", "x", "alpha beta gamma delta epsilon zeta eta theta")], "paper_id string, paragraph_id string, text string")
    t = spark.createDataFrame([("p", "s1", "gamma delta", None), ("p", "s2", "omega", ["beta gamma"]), ("p", "s3", "none", None)], "paper_id string, sentence_id string, text string, intexts array<string>")
    assert {(r["sentence_id"], r["rule"]) for r in C.paragraph_sentences(p, t).collect()} == {("s1", 1), ("s2", 4)}


def test_rollups(spark):
    none = spark.createDataFrame([], "status string")
    assert tuple(U.progress_summary(none).first()) == (0, 0, 0, 0.0)
    tags = spark.createDataFrame([(1, i, t, 0.5) for i, t in enumerate(["O", "B-X", "I-X", "I-Y", "B-Y", "I-Y", "O", "I-X"])], "d int, i int, tag string, c double")
    got = [(r["label"], r["start"], r["end"]) for r in U.bio_spans(tags, ["d"], "i", confidence="c").orderBy("start").collect()]
    assert got == [("X", 1, 2), ("Y", 3, 3), ("Y", 4, 5), ("X", 7, 7)]
    empty = spark.createDataFrame([], "a int")
    assert U.span_scores(empty, empty, ["a"]).first()["f1"] == 1.0
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(12)], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in U.recent_turns(turns).collect()) == [9, 10, 11]
    assert U.to_summarise(turns).count() == 1
    old = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2020, 2, 20))], "k int, last_updated timestamp")
    assert [r["k"] for r in U.unexpired(old, F.lit(dt.datetime(2020, 3, 1))).collect()] == [2]
    res = spark.createDataFrame([("p", "Unknown Title", [], 1), ("q", "T", ["A"], 1), ("q", "T2", ["A"], 2)], "paper_id string, title string, authors array<string>, seq int")
    assert [r["title"] for r in U.unique_papers(res, "seq").collect()] == ["T2"]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"good text of words " * 30)
    (tmp_path / "y.pdf").write_bytes(b" ")
    files = P.discover(spark, str(tmp_path))
    assert files.count() == 2

    def fails(raw):
        raise ValueError("no")

    got = P.best_engine(P.extract(files, [("plain", lambda b: b.decode()), ("broken", fails)]))
    assert {r["path"].rsplit("/", 1)[1]: r["engine"] for r in got.collect()} == {"x.pdf": "plain", "y.pdf": "plain"}
    names = spark.createDataFrame([("/d/Ann Lee - 2004 - On Things.pdf",), ("/d/Lee_2005_Some_Title.pdf",), ("/d/A Title (2006).pdf",), ("/d/plain_name.pdf",)], "p string").select(P.from_filename(F.col("p")).alias("m")).select("m.*")
    assert [(r["title"], r["year"]) for r in names.collect()] == [("On Things", "2004"), ("Some Title", "2005"), ("A Title", "2006"), ("plain name", None)]
    j = '{"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}], "container-title": [], "published-online": {"date-parts": [[2011, 2]]}, "created": {"date-parts": [[2010]]}}}'
    c = spark.range(1).select(P.crossref(F.lit(j)).alias("m")).first()["m"]
    assert (c["title"], c["authors"], c["year"], c["journal"]) == ("T", ["A B"], "2011", None)
    tei = '<TEI xmlns="http://x"><teiHeader><fileDesc><titleStmt><title>On It</title></titleStmt><publicationStmt><date when="2012-01"/></publicationStmt><sourceDesc><author><persName><forename>A</forename><surname>B</surname></persName></author></sourceDesc></fileDesc></teiHeader><text><back><div><listBibl><biblStruct><analytic><title>R1</title><author><persName><surname>Ray</surname></persName></author></analytic><monogr><title>J</title><imprint><date when="1999-05"/></imprint></monogr></biblStruct><biblStruct><monogr><title>Book</title><imprint><date when="1980"/></imprint></monogr></biblStruct></listBibl></div></back></text></TEI>'
    h = spark.range(1).select(P.tei_header(F.lit(tei)).alias("m")).first()["m"]
    assert (h["title"], h["authors"], h["year"]) == ("On It", ["A B"], "2012")
    refs = spark.createDataFrame([(tei,)], "x string").select(P.tei_references(F.col("x")).alias("r")).first()["r"]
    assert [(r["title"], r["surnames"], r["year"]) for r in refs] == [("R1", ["Ray"], "1999"), ("Book", None, "1980")]


def test_routes():
    assert route.routes("Which papers cite Porter?", "Porter") == ["graph_analysis", "pdf_analysis"]
    assert route.routes("What is a theory of the firm") == ["vector_search"]
    assert route.routes("all work", "Porter") == ["author_collection"]
    assert route.needs_disambiguation(["pdf_analysis"], "Porter", None, None) and not route.needs_disambiguation(["pdf_analysis"], "Porter", 1980, None)
    assert route.next_route(["a", "b"], ["a"]) == "b" and route.next_route(["a"], ["a"]) == "generate_response"
    steps = route.plan("reverse_citation_analysis", "paper", {"paper_id": "x"}, "who discusses it")
    assert [s.method for s in steps] == ["get_papers_citing_paper", "get_sentences_citing_paper", "get_full_pdf_content"]
    assert [s.method for s in route.plan("reverse_citation_analysis", "paper", {})] == ["search_all_collections"]
    assert route.entity_type(" Author ") == "author" and route.entity_type("x") == "unknown"
    assert [route.reply_class(x) for x in ("more please", "Yes", "2", "MODIFY it", "3", "", "what")] == ["expand", "continue", "expand", "refine", "refine", "continue", "continue"]
    assert steps[0].fallback == "vector_search_by_author" and steps[1].fallback is None
    assert [route.after_analysis(*x) for x in ((True, "a", True), (False, "a", True), (False, None, True), (False, None, False))] == ["clarification", "disambiguate", "direct_citation", "vector_search"]
    assert [route.after_disambiguation(*x) for x in ((True, 1), (False, 1), (False, 0))] == ["clarification", "citation_analysis", "vector_search"]


def test_route_run_falls_back(spark):
    empty, full = spark.range(0), spark.range(3)
    steps = route.plan("author_search", "author", {"name": "x"})
    got = route.run(steps, {"get_papers_id_by_author": lambda author_name: empty}, {"graph_db": lambda author_name: full})
    assert got["author_papers"].count() == 3


def test_fallback_of_the_strategy_comes_first(spark):
    empty, full, other = spark.range(0), spark.range(3), spark.range(5)
    steps = route.plan("reverse_citation_analysis", "paper", {"paper_id": "x"})
    got = route.run(steps, {"get_papers_citing_paper": lambda paper_id: empty}, {"graph_db": lambda paper_id: full, "vector_search_by_author": lambda paper_id: other})
    assert got["citing_papers"].count() == 5


def test_retrieve_until_there_is_enough(spark):
    asked = []

    def source(name, n):
        return lambda: asked.append(name) or spark.range(n)

    steps = [route.Step("s", m, {}, m) for m in ("a", "b", "c")]
    got = route.retrieve(steps, {"a": source("a", 0), "b": source("b", 9), "c": source("c", 9)}, least=4)
    assert asked == ["a", "b"] and set(got) == {"a", "b"}


def literal_rules(paragraph, sentence, intexts):
    """The five strategies, one after the other, as a loop."""

    def norm(t):
        t = re.sub(r"\s+", " ", t.strip())
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s\(\)\[\],.]", " ", t)).lower()

    p, s = norm(paragraph), norm(sentence)
    pw, sw = p.split(), s.split()
    if s in p:
        return 1
    if len(s) > 100:
        middle = " ".join(pw[len(pw) // 4 : 3 * len(pw) // 4])
        if len(pw) > 10 and len(middle) > 30 and middle in s:
            return 2
    elif len(s) > 30 and len(set(sw)) > 5 and len(set(sw) & set(pw)) / len(set(sw)) > 0.7:
        return 3
    if any(len(c.strip()) > 3 and norm(c) in p for c in intexts or []):
        return 4
    if len(s) > 50 and any(len(g) > 20 and g in p for g in (" ".join(sw[i : i + 5]) for i in range(len(sw) - 4))):
        return 5
    return None


def test_paragraph_sentences_by_a_loop(spark):
    r = random.Random(3)
    words = "firm market (Lee, 2001) growth; theory of Çelik's resource-based view and its limits? strategy [2] \u00a0 x".split(" ")
    made = lambda n: " ".join(r.choice(words) for _ in range(n))
    paragraphs, sentences = [], []
    for i in range(60):
        p = made(r.choice([4, 9, 13, 14, 15, 16, 40]))
        w = p.split(" ")
        paragraphs.append(("p", f"x{i}", p))
        for s in (" ".join(w[2:7]), f"before {p} after", " ".join(w[len(w) // 4 - 1 : 3 * len(w) // 4 + 1]) + " " + made(20), " ".join(reversed(w[:9])), made(8), made(30), " ".join(w[:6]) + "!" + made(9), ""):
            sentences.append(("p", f"s{len(sentences)}", s, r.choice([None, [], ["(Lee, 2001)"], [" (x) ", "abc"], ["resource-based view"]])))
    got = {(x["paragraph_id"], x["sentence_id"]): x["rule"] for x in C.paragraph_sentences(spark.createDataFrame(paragraphs, "paper_id string, paragraph_id string, text string"), spark.createDataFrame(sentences, "paper_id string, sentence_id string, text string, intexts array<string>")).collect()}
    want = {(p[1], s[1]): k for p in paragraphs for s in sentences if (k := literal_rules(p[2], s[2], s[3]))}
    assert got == want and set(want.values()) == {1, 2, 3, 4, 5}


def test_paragraph_citation_counts(spark):
    p = spark.createDataFrame([("p", "x", "alpha beta gamma"), ("p", "y", "other")], "paper_id string, paragraph_id string, text string")
    s = spark.createDataFrame([("p", "s1", "alpha beta", ["a", "b"]), ("p", "s2", "gamma", None), ("p", "s3", "alpha", ["c"])], "paper_id string, sentence_id string, text string, intexts array<string>")
    assert {r["paragraph_id"]: r["citation_count"] for r in C.paragraph_citation_counts(p, s).collect()} == {"x": 3, "y": 0}


def test_semantic_without_a_model(spark):
    s = spark.createDataFrame([("p", 0, "Intro", "the model again")], "paper_id string, section_index int, title string, text string")
    assert [r["position"] for r in C.semantic(s, "model", model=None).collect()] == [4]
    assert V.matching() is None


def test_diagnose(spark):
    pages = spark.createDataFrame([("a", i, "x" * 99, 1) for i in range(6)] + [("b", i, "some words of a plain text " * 90, 0) for i in range(6)], "path string, page_no int, text string, images int")
    refs = spark.createDataFrame([("b", 9, True)], "path string, n_references long, has_doi boolean")
    got = {r["path"]: r for r in P.diagnose(pages, refs).collect()}
    assert got["a"]["is_scanned"] and got["a"]["quality_level"] == "fair" and len(got["a"]["recommendations"]) == 3
    assert not got["b"]["is_scanned"] and got["b"]["quality_level"] == "good" and got["b"]["recommendations"] == [P.NO_ADVICE]


@pytest.mark.parametrize("metric", ["dot", "cosine", "euclid"])
def test_search_blocks(spark, monkeypatch, metric):
    """More queries and points than a block holds, ties, missing and odd vectors; each query against all points."""
    monkeypatch.setattr(V, "POINT_ROWS", 50)
    monkeypatch.setattr(V, "QUERY_ROWS", 16)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(120, 3)), np.repeat(r.normal(size=(3, 3)), 20, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    pts = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    got = sorted((q["query"], -q["score"], q["id"]) for q in V.search_blocks(pts, pts, 4, metric=metric, slots=3).collect())
    of = {"dot": lambda a, b: a @ b, "cosine": lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), "euclid": lambda a, b: -np.sqrt(((a - b) ** 2).sum())}[metric]
    want = []
    for i, a in enumerate(x):
        want += sorted((i, -round(float(of(a, b)), 9), j) for j, b in enumerate(x))[:4]
    assert [(q, j) for q, _, j in sorted((q, round(s, 9), j) for q, s, j in got if q != 901)] == [(q, j) for q, _, j in sorted(want)]
    assert [(q, j) for q, _, j in got if q == 901] == [(901, 901)]
    assert V.search_blocks(pts, pts.limit(0), 4).count() == 0


def test_search_blocks_plan_does_not_grow(spark):
    """One scan a side and no vector in the plan, whatever the number of queries."""
    pts = spark.range(3000).select("id", F.array(*(F.sin(F.col("id") * (i + 1)) for i in range(4))).alias("vector"))
    plans = [V.search_blocks(pts, pts.where(f"id < {n}"), 2)._jdf.queryExecution().optimizedPlan().toString() for n in (100, 2000)]
    assert plans[0].count("Range (") == 2 and len(plans[1]) < len(plans[0]) + 50


def test_occurrences_are_linear(spark):
    import time

    text = "ab " * 120_000 + "end"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "no hit", "z")], "doc_id long, text string, other string")
    began = time.perf_counter()
    got = C.kwic(df, "AB", 10)
    assert got.columns == ["doc_id", "other", "position", "highlight_start", "highlight_end", "context"]
    a = got.agg(F.count("*"), F.max("position"), F.max(F.length("context"))).first()
    assert tuple(a) == (120_000, 359_997, 12)
    assert df.select(F.size(X.occurrences(F.col("text"), "ab")).alias("n")).where("n > 0").first()["n"] == 120_000
    assert time.perf_counter() - began < 30


def test_pair_counts_deal_pairs_over_as_many_tasks_as_they_need(spark, monkeypatch):
    links = spark.createDataFrame([(g, i) for g in range(40) for i in range(12) if (g + i) % 3], "g long, i long")
    want = {}
    for g in range(40):
        own = [i for i in range(12) if (g + i) % 3]
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    monkeypatch.setattr(G, "PAIRS_A_TASK", 50)
    got = G.pair_counts(links, "g", "i")
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f", {-(-sum(want.values()) // 50)}" in plan and G.pair_counts(links.limit(0), "g", "i").count() == 0
    assert A.collaboration(links.select(F.col("g").alias("paper_id"), F.col("i").alias("author_id"))).count() == len(want)


def test_equal_pairs_are_one_row_before_they_are_dealt(spark, monkeypatch):
    """What is dealt follows the different pairs of a task, not all pairs: 200 groups of the same items, and one that is cut."""
    names = [f"i{i:02d}" for i in range(30)]
    links = spark.createDataFrame([(g, i) for g in range(200) for i in names] + [(None, "i00"), (7, None)], "g long, i string")
    want = {(a, b): 200 for a in names for b in names if a < b}
    assert {(r["a"], r["b"]): r["n"] for r in G.pair_counts(links, "g", "i").collect()} == want
    monkeypatch.setattr(G, "PAIRS_A_TASK", 4000)
    assert {(r["a"], r["b"]): r["n"] for r in G.pair_counts(links, "g", "i").collect()} == want
    batch = pa.RecordBatch.from_pydict({"items": pa.array([names] * 100 + [["x", "y"]]), "firsts": pa.array([29] * 100 + [1])})
    rows = [r for out in G._counted(iter([batch, batch])) for r in out.to_pylist()]
    assert len(rows) == 436 and {(r["a"], r["b"]): r["n"] for r in rows} == want | {("x", "y"): 2}
    monkeypatch.setattr(G, "PAIRS_AT_ONCE", 1000)
    pieces = [r for out in G._counted(iter([batch, batch])) for r in out.to_pylist()]
    assert 436 < len(pieces) < 87_002 and sum(r["n"] for r in pieces) == 87_002


def test_pairs_of_the_star_schema_read_lines_once_a_pass(spark):
    """Lines are dealt by order, then by citing paper; an author's links by paper: no other exchange of them."""
    from quiremill.plans import star

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(star.collaboration(spark, "/root/testdata/sf0.001")).count("Exchange") == 3
    assert "SortMergeJoin" not in plan(star.collaboration(spark, "/root/testdata/sf0.001"))


def test_kwic_gives_its_hits_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(1, "ab " * 50, [1]), (2, None, None), (3, "no", [3]), (4, "xAB", [])], "id int, text string, tags array<int>")
    monkeypatch.setattr(C, "HITS_AT_ONCE", 7)
    got = C.kwic(df, "ab", 4)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["position"], r["tags"]) for r in got.collect()) == [*((1, 3 * i, [1]) for i in range(50)), (4, 1, [])]
    assert got.where("id = 4").select("context", "highlight_start", "highlight_end").first() == ("xAB", 1, 3)
    assert C.kwic(df, "").count() == 0
