"""A table of titles against papers, held against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quiremill.operators import resolve as R
from quiremill.operators import titles as T


def made(n, seed):
    r = random.Random(seed)
    words = "Competitive strategy of the firm and its market resources in a theory von Übung value chain 2nd".split()
    out = [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(n)]
    for i in range(0, n, 3):  # near ones
        t = list(out[i])
        for _ in range(r.randrange(1, 4)):
            t[r.randrange(len(t))] = r.choice("xyz ")
        out.append("".join(t))
    return [*out, out[0], f" {out[1].upper()} ", "", None, "abcd", "of th", "a b"]


def all_pairs(asked, papers, least):
    want = set()
    for i, x in asked:
        for j, y in papers:
            a, b = (x or "").strip(" ").lower(), (y or "").strip(" ").lower()
            if not a or not b:
                continue
            part, ratio = len(a) >= 5 and a in b, SequenceMatcher(None, a, b).ratio()
            if part or ratio >= least:
                want.add((i, j, part, round(ratio, 9)))
    return want


@pytest.mark.parametrize("least", [0.6, 0.85, 1.0])
def test_equals_all_pairs(spark, least):
    asked, papers = list(enumerate(made(60, 1))), [(f"p{i}", t) for i, t in enumerate(made(120, 1) + made(60, 2))]
    a, b = spark.createDataFrame(asked, "id int, title string"), spark.createDataFrame(papers, "paper_id string, title string")
    got = T.match_titles(a, b, least).collect()
    found = {(r["id"], r["paper_id"], r["is_part"], round(r["ratio"], 9)) for r in got}
    assert len(got) == len(found) and found == all_pairs(asked, papers, least)


def test_ratios_saved(spark):
    a, b = (spark.createDataFrame([(t,) for t in made(n, s)], "title string").select(T.normal(F.col("title")).alias("title")).where("title <> ''").distinct() for n, s in ((60, 1), (300, 3)))
    pairs = a.count() * b.count()
    for least, share in ((0.6, 0.9), (0.85, 0.25), (0.95, 0.05)):
        assert T.close_titles(a, b, least).count() < share * pairs


def test_as_one_title(spark):
    papers = spark.createDataFrame([("A", "Competitive Strategy"), ("B", "Competitive Strategies of Firms"), ("C", "Nothing alike")], "paper_id string, title string")
    one = {(r["paper_id"], r["is_part"], round(r["combined"], 9)) for r in R.by_title(papers, "competitive strateg").collect()}
    many = T.match_titles(spark.createDataFrame([(1, "Competitive Strateg")], "id int, title string"), papers).collect()
    assert one == {(r["paper_id"], r["is_part"], round(r["combined"], 9)) for r in many} and len(one) == 2
    assert T.match_titles(spark.createDataFrame([], "id int, title string"), papers).count() == 0
