"""Contracts of smaller operators: settings, schema nodes, stores, filters, lookups, snapshots."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quiremill import schemas, session
from quiremill.functions import citations as CI
from quiremill.functions import text as X
from quiremill.operators import content as C
from quiremill.operators import graph as G
from quiremill.operators import resolve as R
from quiremill.operators import sentences as Z
from quiremill.operators import vectors as V
from quiremill.sources import imports as I
from quiremill.sources import papers as P
from quiremill.sources import snapshots as S


def test_settings_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"llm": {"default": {"model": "m"}}, "k": 1}))
    (tmp_path / "b.yaml").write_text("llm:\n  default: {model: n}\nlist: [1, 2]\n")
    assert session.load_config(spark, str(tmp_path / "a.json"), {"llm": {"default": {"temperature": 0}, "other": 2}}) == {"llm": {"default": {"model": "m", "temperature": 0}, "other": 2}, "k": 1}
    assert session.load_config(spark, str(tmp_path / "b.yaml")) == {"llm": {"default": {"model": "n"}}, "list": [1, 2]}


def test_types_are_upserted_once(spark):
    types = schemas.types_of(spark, schemas.CLAIM_TYPES).withColumn("seq", F.lit(1))
    again = G.upsert(types, types.limit(3).withColumn("seq", F.lit(2)).withColumn("is_deprecated", F.lit(True)), ["id"], "seq")
    assert again.count() == len(schemas.CLAIM_TYPES) == 14 and again.where("is_deprecated").count() == 3
    assert {r["id"] for r in schemas.types_of(spark, schemas.RELATION_TYPES).collect()} >= {"CITES", "SUPPORTS", "REFUTES"}


def test_stored_sentences_traces_and_examples(spark, tmp_path):
    s = spark.createDataFrame([("P", 1, "two words"), ("P", 0, None)], "paper_id string, sentence_index int, sentence_text string")
    P.write_sentences(s, str(tmp_path / "s"))
    assert sorted((r["sentence_index"], r["char_count"], r["word_count"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(0, 0, 0), (1, 9, 2)]
    P.write_trace(spark.range(1500).withColumnRenamed("id", "at"), str(tmp_path / "t"))
    kept = [r["at"] for r in spark.read.json(str(tmp_path / "t")).collect()]
    assert len(kept) == 1000 and min(kept) == 500
    (tmp_path / "x.csv").write_text('text,label\n"a, ""quoted""\nline",CITES\nplain,SUPPORTS\n')
    assert sorted(map(tuple, P.read_examples(spark, str(tmp_path / "x.csv"), "text string, label string").collect())) == [('a, "quoted"\nline', "CITES"), ("plain", "SUPPORTS")]


def test_filters_by_lists(spark):
    points = spark.createDataFrame([(1, "p1", "1999", "J of A", True), (2, "p2", "2000", None, False), (3, "p3", None, "B", True)], "id int, paper_id string, year string, journal string, has_citations boolean")
    ids = lambda *a, **k: {r["id"] for r in points.where(V.matching(*a, **k)).collect()}
    assert ids(["p1", "p3"]) == {1, 3} and ids(kinds={"has_citations": [True]}) == {1, 3} and ids(["p1", "p2"], [1999, "2000"], kinds={"has_citations": [False]}) == {2}


def test_content_of_resolved_papers(spark):
    """A title or an author is resolved to papers first, then these are searched; a resolution without papers finds nothing."""
    papers = spark.createDataFrame([("A", "Competitive strategy", ["Porter"], 1980), ("B", "Other things", ["Doe"], 1990)], "paper_id string, title string, authors array<string>, year int")
    text = spark.createDataFrame([("A", "Five forces act; forces matter."), ("B", "forces too")], "paper_id string, text string")
    by_title = C.content_of(papers, R.by_title(papers, "competitive strategy"), text, "forces", 10).collect()
    assert sorted((r["paper_title"], r["position"]) for r in by_title) == [("Competitive strategy", 5), ("Competitive strategy", 17)]
    assert C.content_of(papers, R.papers_of_entities(papers, "doe"), text, "forces").count() == 1
    assert C.content_of(papers, papers.limit(0), text, "forces").count() == 0


def test_reference_tail(spark):
    tail = lambda t, n=2000: spark.createDataFrame([(t,)], "t string").select(X.reference_tail(F.col("t"), n)).first()[0]
    assert tail("Body one.\n\nBody two.\n\nReferences\n\nPorter 1980.") == "References\n\nPorter 1980."
    assert tail("\n\n".join(f"p{i}" for i in range(14))) == "\n\n".join(f"p{i}" for i in range(4, 14))
    assert tail("Bibliography " + "x" * 100, 5) == ("Bibliography " + "x" * 100)[:20]


def test_citations_of_both_kinds_are_one_set():
    assert CI.citations("Porter (1980) said so (Porter, 1980; Lee & Kim, 1999).") == ["(Lee & Kim, 1999)", "(Porter, 1980)"]


def test_text_to_graph(spark, monkeypatch):
    """From whole texts and their references to a graph: sentences, citations, tables."""
    body = "Strategy matters a lot (Porter, 1980). Nobody is cited in this one. Doe (1999) disagrees with (Porter, 1980)."
    docs = spark.createDataFrame([("P1", body)], "paper_id string, text string")
    refs = spark.createDataFrame([("P1", 0, ["Michael Porter"], "Competitive Strategy", "1980"), ("P1", 1, ["Jane Doe"], "An answer", "1999"), ("P2", 0, ["Michael Porter"], "Wrong paper", "1980")], "paper_id string, ref_no int, authors array<string>, title string, year string")
    said = Z.parse_sentences(docs, "paper_id").select("paper_id", "sentence_index", F.col("sentence").alias("text"))
    lines = CI.analyze_sentences(said, refs)
    assert set(lines.columns) == {"paper_id", *(f.name for f in spark.createDataFrame([], schemas.SENTENCE_LINE).schema)}
    got = {r["sentence_index"]: sorted((c["intext"], c["reference"]["title"]) for c in r["citations"]) for r in lines.collect()}
    assert got == {0: [("(Porter, 1980)", "Competitive Strategy")], 1: [], 2: [("(Doe, 1999)", "An answer"), ("(Porter, 1980)", "Competitive Strategy")]}
    meta = spark.createDataFrame([("P1", "Own title", "2001")], "paper_id string, title string, year string")
    g = I.import_documents(I.assemble(lines, meta))
    assert {r["title"]: r["stub"] for r in g["papers"].collect()} == {"Own title": False, "Competitive Strategy": True, "An answer": True}
    porter = g["papers"].where("title = 'Competitive Strategy'").first()["paper_id"]
    assert [(r["paper_id"], r["sentence_citations"]) for r in G.citing_papers(I.graph_of(g), porter).collect()] == [("P1", 2)]


def test_a_sentence_that_fails_is_a_row(spark):
    monkey = CI.citations.__globals__
    was = monkey["_within"]
    lines = CI._analyzed.func
    try:
        monkey["_within"] = lambda part: 1 / 0
        import pandas as pd

        out = lines(pd.Series(["plain", "cites (Porter, 1980)"]))
    finally:
        monkey["_within"] = was
    assert out["found"].tolist() == [[], []] and out["error"].tolist()[0] is None and "ZeroDivisionError" in out["error"].tolist()[1]


def test_snapshots(spark, tmp_path):
    schema = "id string, collection string, vector array<float>, text string"
    points = spark.createDataFrame([(str(i), "ab"[i % 2], [float(i)], None if i % 7 else "t") for i in range(50)], schema).repartition(4)
    S.backup(points, str(tmp_path / "s"))
    assert sorted((r["collection"], r["n_rows"]) for r in S.info(points).collect()) == [("a", 25), ("b", 25)]
    # the checksum does not follow the order of rows or columns
    assert {r["checksum"] for r in S.info(points).collect()} == {r["checksum"] for r in S.info(points.orderBy("text").select("text", "vector", "id", "collection")).collect()}
    back = S.restore(spark, str(tmp_path / "s"), schema, str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, points.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        S.backup(points, str(tmp_path / "s"))
    parts = sorted(Path(tmp_path / "s" / "points").glob("part-*.parquet"))
    raw = parts[0].read_bytes()
    parts[0].rename(tmp_path / "gone")
    with pytest.raises(S.Damaged, match="rows of 25"):
        S.restore(spark, str(tmp_path / "s"), schema)
    for crc in (tmp_path / "s" / "points").glob(".*.crc"):
        crc.rename(tmp_path / f"{crc.name}.old")
    parts[0].write_bytes(raw[: len(raw) // 2])
    with pytest.raises(S.Damaged):
        S.restore(spark, str(tmp_path / "s"), schema, str(tmp_path / "u"))
    assert not (tmp_path / "u").exists()
    # another value in as many rows
    parts[0].unlink()
    first = spark.read.parquet(str(tmp_path / "gone")).withColumn("text", F.lit("other"))
    first.coalesce(1).write.mode("append").parquet(str(tmp_path / "s" / "points"))
    with pytest.raises(S.Damaged):
        S.restore(spark, str(tmp_path / "s"), schema)
