"""Further operators over the star-schema tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as X
from ..functions.citations import distinct_by_key, intext_key
from ..operators import authors as A
from ..operators import bundle as B
from ..operators import content as C
from ..operators import graph as G
from ..operators import layout as L
from ..operators import resolve as R
from ..operators import rollup as U
from ..operators import sentences as Z
from ..operators import titles as M
from ..operators import vectors as V
from ..sources import imports as I
from ..sources import papers as P
from . import route
from .star import _FURNITURE, _SPECIAL, _W, documents, parts, points, probe, query, t


def conversations(spark, d):
    return t(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


# --- filters


@query("SELECT p_partkey AS paper_id, p_size AS year FROM part WHERE p_size=7 AND contains(lower(p_brand),'brand#1')")
def papers_filtered(spark, d):
    return R.filtered(parts(spark, d), 7, "BRAND#1").select("paper_id", "year")


@query("SELECT p_partkey AS id FROM part WHERE p_size::VARCHAR IN ('5','9','17') AND (contains(lower(p_brand),'#2') OR contains(lower(p_brand),'#4')) AND p_type IN ('LARGE','SMALL')")
def search_filters(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("paper_id"), F.col("p_size").alias("year"), F.col("p_brand").alias("journal"), F.col("p_type").alias("section"))
    return p.where(V.matching(years=[5, "9", 17], journals=["#2", "#4"], kinds={"section": ["LARGE", "SMALL"]})).select("id")


@query(f"SELECT doc_id FROM (SELECT doc_id, trim(text,' ') AS text FROM documents) WHERE len(text)>=10 AND NOT regexp_matches(text,{_FURNITURE}) AND NOT ({_SPECIAL}>0.15 OR regexp_matches(text,'H\\d{{6}}') OR len(regexp_extract_all(text,'\\s+'))/len(text)>0.5) AND NOT (contains(lower(text),'all rights reserved') OR contains(lower(text),'copyright') OR contains(lower(text),'downloaded from') OR contains(lower(text),'for personal use only') OR contains(lower(text),'doi:'))")
def valid_sentences(spark, d):
    return documents(spark, d).where(X.is_valid_sentence(F.col("text"))).select("doc_id")


@query("SELECT p_partkey AS paper_id, (len(trim(p_name))>=5 AND p_size%7<>0 AND 1880+p_size*3 BETWEEN 1900 AND 2026) AS valid FROM part")
def metadata_valid(spark, d):
    who = F.array(F.when(F.col("p_size") % 7 == 0, "Unknown Author").otherwise(F.col("p_type")))
    return t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), P.is_valid_metadata(F.col("p_name"), who, (1880 + F.col("p_size") * 3).cast("string"), F.lit(2025)).alias("valid"))


@query("SELECT p_partkey AS paper_id, CASE WHEN p_size%7<>0 AND 1880+p_size*3 BETWEEN 1900 AND 2026 THEN 'first' ELSE 'second' END AS extraction_method, CASE WHEN p_size%7<>0 AND 1880+p_size*3 BETWEEN 1900 AND 2026 THEN p_name ELSE p_brand END AS title FROM part WHERE len(trim(p_name))>=5")
def metadata_cascade(spark, d):
    who = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type"))
    first = F.struct(F.col("p_name").alias("title"), who.alias("authors"), (1880 + F.col("p_size") * 3).cast("string").alias("year"))
    second = F.struct(F.col("p_brand").alias("title"), F.array("p_type").alias("authors"), F.lit("2001").alias("year"))
    got = t(spark, d, "part").where(F.length(F.trim("p_name")) >= 5).select(F.col("p_partkey").alias("paper_id"), P.cascade([("first", first), ("second", second)], F.lit(2025)).alias("m"))
    return got.select("paper_id", "m.extraction_method", "m.title")


@query("SELECT p_partkey AS paper_id, p_partkey%3=0 AS is_id FROM part")
def paper_id_format(spark, d):
    h = F.sha2("p_name", 256)
    value = F.when(F.col("p_partkey") % 3 == 0, F.upper(h)).when(F.col("p_partkey") % 3 == 1, F.substring(h, 1, 63)).otherwise(F.concat(F.substring(h, 1, 63), F.lit("g")))
    return t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), ids.is_paper_id(value).alias("is_id"))


@query("SELECT doc_id, (contains(lower(text),'stone') OR contains(lower(text),'ann thede') OR contains(lower(text),'the')) AS cites FROM documents")
def cites_target(spark, d):
    return documents(spark, d).select("doc_id", R.cites_target(F.col("text"), F.array(F.lit("Jo Stone"), F.lit("Ann Thede")), F.lit("The")).alias("cites"))


@query("SELECT conv_id, turn, CASE WHEN role='user' AND len(text)%2=0 THEN 'citation' WHEN role='user' THEN 'A' ELSE 'content' END AS kind FROM conversations")
def point_kinds(spark, d):
    claim = F.when(F.length("text") % 2 == 1, "A").otherwise("")
    return conversations(spark, d).select("conv_id", "turn", I.point_filter(F.col("role") == "user", claim).alias("kind"))


@query("SELECT p_brand AS brand, count(*) AS papers, CASE WHEN count(*)>=10 THEN 0.9 WHEN count(*)>=5 THEN 0.7 WHEN count(*)>=2 THEN 0.5 ELSE 0.3 END::DOUBLE AS concept, CASE WHEN count(*)=1 THEN 0.8 WHEN count(*)<=3 THEN 0.6 ELSE 0.4 END::DOUBLE AS author, (CASE WHEN count(*)>=10 THEN 0.9 WHEN count(*)>=5 THEN 0.7 WHEN count(*)>=2 THEN 0.5 ELSE 0.3 END<0.8 AND count(*)>1) AS clarify, CASE WHEN count(*)=1 THEN 'selected' WHEN count(*)<=5 THEN 'choose' ELSE 'too_many' END AS next FROM part GROUP BY 1")
def entity_rules(spark, d):
    got = t(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("papers"))
    n = F.col("papers")
    return got.select("brand", "papers", R.concept_confidence(n).alias("concept"), R.vector_author_confidence(n).alias("author"), R.needs_clarification(R.concept_confidence(n), n).alias("clarify"), R.disambiguation(n).alias("next"))


# --- graph and documents


@query("WITH r AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS x, l_returnflag AS k, l_linenumber AS seq FROM lineitem WHERE l_orderkey%2=0), e AS (SELECT f, x, k, max(seq) AS seq FROM r GROUP BY 1,2,3) SELECT f AS from_id, x AS to_id, k AS relation_type, seq, CASE WHEN x IN (SELECT o_orderkey FROM orders WHERE o_orderkey%2=0) THEN 'argument' ELSE 'paper' END AS target_kind FROM e WHERE f IN (SELECT o_orderkey FROM orders) AND (x IN (SELECT o_orderkey FROM orders WHERE o_orderkey%2=0) OR x IN (SELECT p_partkey FROM part))")
def relations(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_linenumber").alias("seq")).distinct()
    arguments = t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("argument_id"))
    return G.relate(line, arguments, t(spark, d, "part").select(F.col("p_partkey").alias("paper_id")))


@query("SELECT s.conv_id AS paper_id, s.turn AS sentence_id, coalesce(arg_min(p.turn, p.turn)::VARCHAR, 'unknown_paragraph') AS paragraph_id FROM (SELECT conv_id, turn, CASE WHEN turn%2=0 THEN substring(text,3,12) ELSE reverse(text) END AS x FROM conversations) s LEFT JOIN conversations p ON p.conv_id=s.conv_id AND contains(p.text, s.x) GROUP BY s.conv_id, s.turn")
def sentence_paragraph(spark, d):
    c = conversations(spark, d)
    s = c.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("sentence_id"), F.when(F.col("turn") % 2 == 0, F.substring("text", 3, 12)).otherwise(F.reverse("text")).alias("text"))
    p = c.select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("string").alias("paragraph_id"), F.col("turn").alias("paragraph_index"), "text")
    return G.first_containing_paragraph(s, p)


_N = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},'^\\s+|\\s+$','','g'),'\\s+',' ','g'),'[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s()\\[\\],.]',' ','g'),'\\s+',' ','g'))"
_PARAGRAPH_SQL = f"""
WITH p AS (SELECT conv_id, turn, {_N.format(x="text")} AS p FROM conversations WHERE role='assistant'),
s AS (SELECT conv_id, turn, role, {_N.format(x="CASE turn%4 WHEN 0 THEN text WHEN 1 THEN text||' '||text WHEN 2 THEN substring(text,5,60) ELSE substring(text,9) END")} AS s, {_N.format(x="substring(text,2,14)")} AS cite FROM conversations),
pw AS (SELECT *, list_filter(string_split(p,' '), lambda w: w<>'') AS pw FROM p),
sw AS (SELECT *, list_filter(string_split(s,' '), lambda w: w<>'') AS sw FROM s),
b AS (SELECT pw.conv_id, pw.turn AS pt, sw.turn AS st, p, s, cite, pw, sw, list_distinct(sw) AS sd, array_to_string(pw[len(pw)//4+1:3*len(pw)//4],' ') AS mid FROM pw JOIN sw ON pw.conv_id=sw.conv_id),
r AS (SELECT conv_id, pt, st, CASE WHEN contains(p,s) THEN 1
 WHEN len(s)>100 AND len(pw)>10 AND len(mid)>30 AND contains(s,mid) THEN 2
 WHEN len(s)>30 AND len(s)<=100 AND len(sd)>5 AND len(list_intersect(sd,pw))/len(sd)>0.7 THEN 3
 WHEN len(cite)>3 AND contains(p,cite) THEN 4
 WHEN len(s)>50 AND len(list_filter(range(1,len(sw)-3), lambda i: len(array_to_string(sw[i:i+4],' '))>20 AND contains(p,array_to_string(sw[i:i+4],' '))))>0 THEN 5 END AS rule FROM b)
SELECT conv_id AS paper_id, pt AS paragraph_id, st AS sentence_id, rule FROM r WHERE rule IS NOT NULL
"""


@query(_PARAGRAPH_SQL)
def paragraph_sentence_rules(spark, d):
    c = conversations(spark, d).withColumnRenamed("conv_id", "paper_id")
    x = F.col("text")
    changed = F.when(F.col("turn") % 4 == 0, x).when(F.col("turn") % 4 == 1, F.concat(x, F.lit(" "), x)).when(F.col("turn") % 4 == 2, F.substring(x, 5, 60)).otherwise(F.substring(x, F.lit(9), F.length(x)))
    s = c.select("paper_id", F.col("turn").alias("sentence_id"), changed.alias("text"), F.array(F.substring(x, 2, 14)).alias("intexts"))
    return C.paragraph_sentences(c.where("role = 'assistant'").select("paper_id", F.col("turn").alias("paragraph_id"), "text"), s)


def processed(spark, d):
    """Sentence lines as the reader gives them: papers are customers, sentences their orders, citations the suppliers of these."""
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").cast("string").alias("s"), F.col("l_linenumber").alias("n"))
    cite = F.struct(F.concat(F.lit("("), F.col("s"), F.lit(")")).alias("intext"), F.struct(F.concat(F.lit("T"), F.col("s")).alias("title"), F.lit("1990").alias("year")).alias("reference"), F.concat(F.lit("S"), F.col("s")).alias("paper_id"))
    cites = line.groupBy("k").agg(F.collect_list(cite).alias("citations"))
    own = t(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("paper_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("sentence_text"))
    lines = own.join(cites, "k", "left").withColumnRenamed("k", "sentence_index")
    meta = t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("paper_id"), F.col("c_name").alias("title"), F.lit("2001-05").alias("year"))
    return lines, meta


@query("SELECT 'C'||o_custkey AS citing_id, 'S'||l_suppkey AS cited_id, count(*) AS citation_count FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2")
def import_paper_cites(spark, d):
    return I.to_graph(*processed(spark, d))["paper_cites"]


@query("SELECT 'C'||c_custkey AS paper_id, c_name AS title, 2001 AS year, false AS stub FROM customer UNION ALL SELECT DISTINCT 'S'||l_suppkey, 'T'||l_suppkey, 1990, true FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def import_papers(spark, d):
    return I.to_graph(*processed(spark, d))["papers"].select("paper_id", "title", "year", "stub")


@query("SELECT 'C'||o_custkey||'_sent_'||o_orderkey AS from_id, 'S'||l_suppkey AS to_id, 'CITES' AS relation_type, count(*) AS mentions FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2")
def import_relations(spark, d):
    return I.to_graph(*processed(spark, d))["relations"].select("from_id", "to_id", "relation_type", "mentions")


@query("SELECT 'C'||o_custkey||'_sent_'||o_orderkey AS argument_id, o_orderpriority AS text, 'NEUTRAL' AS claim_type FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def import_arguments(spark, d):
    return I.to_graph(*processed(spark, d))["arguments"].select("argument_id", "text", "claim_type")


@query("SELECT sha256('sentences_C'||o_custkey||'_'||o_orderkey) AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'citation' ELSE 'content' END AS sentence_type FROM orders")
def import_points(spark, d):
    return I.to_points(processed(spark, d)[0]).select("id", "sentence_type")


def filed(spark, d):
    """Documents with paragraphs: papers are customers, paragraphs their orders, sentences these orders' lines, which cite suppliers
    and sometimes say how."""
    # line numbers of an order repeat; the flag comes last, so that all uses of the lines read, and deal, the same columns
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag"))
    line, order = t(spark, d, "lineitem").withColumn("l_linenumber", number), t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("paper_id"), "o_orderpriority")
    says = F.concat(F.lit("s"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("."))
    who = F.col("l_suppkey").cast("string")
    typed = F.struct((F.col("l_returnflag") == "R").alias("has_argument_relations"), F.array(F.struct(F.lit("SUPPORTS").alias("relation_type"), F.col("l_discount").alias("confidence"))).alias("entities"))
    cite = F.struct(F.concat(F.lit("("), who, F.lit(")")).alias("intext"), F.struct(F.concat(F.lit("T"), who).alias("title"), F.lit("1990").alias("year")).alias("reference"), F.concat(F.lit("S"), who).alias("paper_id"), typed.alias("argument_analysis"))
    rows = line.select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("sentence_index"), says.alias("sentence_text"), F.array(cite).alias("citations"), F.struct((F.col("l_returnflag") == "R").alias("has_argument_relations")).alias("argument_analysis")).join(order, "k")
    lines = rows.drop("k", "o_orderpriority")
    texts = rows.groupBy("paper_id", "k", "o_orderpriority").agg(F.array_join(F.sort_array(F.collect_list(F.struct("sentence_index", "sentence_text")))["sentence_text"], " ").alias("paragraph_text"), F.count("*").cast("int").alias("sentence_count"))
    paragraphs = texts.select("paper_id", F.col("k").cast("int").alias("paragraph_index"), "paragraph_text", F.col("o_orderpriority").alias("section"), "sentence_count")
    meta = t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("paper_id"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("authors"), F.lit("2001-05").alias("year"), F.lit("10.1/x").alias("doi"))
    return lines, meta, paragraphs


_FILED = "SELECT 'C'||o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_discount) AS n, 'S'||l_suppkey AS s, l_returnflag AS f, l_discount AS d FROM lineitem JOIN orders ON l_orderkey=o_orderkey"


def filed_graph(spark, d):
    return I.import_lines(*filed(spark, d))


@query(f"WITH e AS ({_FILED}) SELECT c AS paper_id, c_name AS title, count(DISTINCT (k,n)) AS sentence_citations, count(DISTINCT k) AS paragraph_citations, count(DISTINCT (k,n))+count(DISTINCT k) AS total_citations FROM e JOIN customer ON c='C'||c_custkey WHERE s='S5' GROUP BY 1,2")
def filed_citing_papers(spark, d):
    return G.citing_papers(I.graph_of(filed_graph(spark, d)), "S5").select("paper_id", "title", "sentence_citations", "paragraph_citations", "total_citations")


@query(f"WITH e AS ({_FILED}) SELECT c||'_para_'||k AS paragraph_id, s AS cited_id, count(*) AS citation_count, count(*)/(SELECT count(*) FROM lineitem WHERE l_orderkey=k)::DOUBLE AS citation_density FROM e GROUP BY c, k, s")
def filed_paragraph_cites(spark, d):
    return filed_graph(spark, d)["paragraph_cites"]


@query(f"WITH e AS ({_FILED}) SELECT c||'_sent_'||(100*k+n) AS sentence_id, c||'_para_'||k AS paragraph_id, 2001 AS year, true AS has_citations, len('s'||k||'-'||n||'.') AS char_count FROM e")
def filed_sentences(spark, d):
    return filed_graph(spark, d)["sentences"].select("sentence_id", "paragraph_id", "year", "has_citations", "char_count")


@query(f"WITH e AS ({_FILED}) SELECT c||'_sent_'||(100*k+n) AS sentence_id, s AS cited_id, '('||substr(s,2)||')' AS citation_text, 's'||k||'-'||n||'.' AS citation_context, 1.0::DOUBLE AS confidence FROM e")
def filed_sentence_cites(spark, d):
    return filed_graph(spark, d)["sentence_cites"]


@query(f"WITH e AS ({_FILED}) SELECT c||'_sent_'||(100*k+n) AS from_id, s AS to_id, CASE WHEN f='R' THEN 'SUPPORTS' ELSE 'CITES' END AS relation_type, CASE WHEN f='R' THEN d END AS confidence, CASE WHEN f='R' THEN 'CLAIM_MAIN' ELSE 'NEUTRAL' END AS claim_type FROM e")
def filed_relations(spark, d):
    g = filed_graph(spark, d)
    return g["relations"].join(g["arguments"], F.col("from_id") == F.col("argument_id")).select("from_id", "to_id", "relation_type", "confidence", "claim_type")


@query("SELECT 'C'||c_custkey AS paper_id, c_name AS title, 2001 AS year, '10.1/x' AS doi, c_mktsegment AS author, false AS stub FROM customer UNION ALL SELECT DISTINCT 'S'||l_suppkey, 'T'||l_suppkey, 1990, NULL, NULL, true FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def filed_papers(spark, d):
    return filed_graph(spark, d)["papers"].select("paper_id", "title", "year", "doi", F.get("authors", F.lit(0)).alias("author"), "stub")


@query(f"WITH e AS ({_FILED}), c AS (SELECT c, k, n, s, f, row_number() OVER (PARTITION BY c ORDER BY k, n) - 1 AS i FROM e) SELECT sha256('sentences_'||c||'_'||(100*k+n)) AS id, 'sentences' AS collection, CASE WHEN f='R' THEN 'CLAIM_MAIN' ELSE 'citation' END AS kind, 1::INT AS n FROM e UNION ALL SELECT sha256('paragraphs_'||c||'_'||k), 'paragraphs', o_orderpriority, count(*)::INT FROM e JOIN orders ON o_orderkey=k GROUP BY c, k, o_orderpriority UNION ALL SELECT sha256('sections_'||c||'_0'), 'sections', 'other', ceil(count(*)/5)::INT FROM e GROUP BY c UNION ALL SELECT sha256('citations_'||c||'_'||i), 'citations', s, 1::INT FROM c")
def filed_collections(spark, d):
    lines, meta, paragraphs = filed(spark, d)
    got = I.collections(lines, meta, paragraphs)
    kind = F.coalesce("sentence_type", F.when(F.col("collection") == "paragraphs", F.col("section")), "section_type", "cited_paper_id")
    n = F.coalesce(F.when(F.col("collection") == "paragraphs", F.col("citation_count")), "paragraph_count", F.lit(1))
    return got.select("id", "collection", kind.alias("kind"), n.alias("n"))


@query("SELECT p_partkey AS paper_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag='R' AND l_linenumber=1)")
def import_new(spark, d):
    done = t(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("paper_id"))
    return P.import_new(parts(spark, d), done).select("paper_id")


# --- authors and resolution


@query("SELECT sha256(lower(trim(n))) AS h, arg_min(n, s*10+k) AS name, count(DISTINCT p) AS papers FROM (SELECT p_partkey AS p, p_size AS s, unnest([p_type, upper(p_type)||' ', p_brand]) AS n, unnest([0,1,2]) AS k FROM part) GROUP BY 1")
def author_index(spark, d):
    papers = t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.array("p_type", F.concat(F.upper("p_type"), F.lit(" ")), "p_brand").alias("authors"), F.col("p_size").alias("seq"))
    authors, links = A.build(papers)
    n = links.groupBy("author_id").agg(F.count("*").alias("papers"))
    return authors.join(n, F.col("id") == F.col("author_id")).select(F.sha2("normalized_name", 256).alias("h"), "name", "papers")


def matches(spark, d):
    return parts(spark, d).withColumn("match_score", F.col("year") % 10)


@query("SELECT p_partkey AS paper_id, count(l_orderkey) AS n_citing FROM part LEFT JOIN lineitem ON l_partkey=p_partkey WHERE p_size<10 GROUP BY p_partkey, p_size ORDER BY 2 DESC, p_size%10 DESC, 1 LIMIT 1")
def best_target(spark, d):
    pairs = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing_id"), F.col("l_partkey").alias("cited_id"))
    return R.best_target(matches(spark, d).where("year < 10"), pairs).select("paper_id", "n_citing")


@query("SELECT row_number() OVER (ORDER BY p_size%10 DESC, p_partkey)::INTEGER AS choice, p_partkey AS paper_id, p_name AS title, p_size AS year FROM part ORDER BY p_size%10 DESC, p_partkey LIMIT 5")
def clarification_options(spark, d):
    return R.options(matches(spark, d))


@query("SELECT DISTINCT title AS candidate FROM (SELECT p_name AS title FROM part ORDER BY p_size%10 DESC, p_partkey LIMIT 5) ORDER BY 1 LIMIT 3")
def top_titles(spark, d):
    return R.top_candidates(matches(spark, d), F.array("title"))


@query("SELECT p_partkey AS paper_id FROM part WHERE contains(lower(p_type), 'andar') AND p_size=12")
def papers_of_entities(spark, d):
    p = parts(spark, d).join(t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.array("p_type").alias("authors")), "paper_id")
    return R.papers_of_entities(p, " ANDAR", 12).select("paper_id")


# --- search, roll-ups, conversations


_BEST = "list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0))"


@query(f"SELECT count(*) AS total_results, round(max(score),6) AS max_score, count(DISTINCT label) AS collections FROM (SELECT label, {_BEST} AS score, row_number() OVER (PARTITION BY label ORDER BY {_BEST} DESC, vec_id) AS n FROM embeddings) WHERE n<=3")
def search_totals(spark, d):
    return V.totals(V.search_collections(points(spark, d), probe(spark, d), 3)).withColumn("max_score", F.round("max_score", 6))


@query("SELECT l_returnflag AS label, count(*) AS n, round(avg(l_discount),6) AS avg_confidence FROM lineitem GROUP BY 1")
def label_distribution(spark, d):
    spans = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_discount").cast("double").alias("confidence"))
    return U.label_distribution(spans).withColumn("avg_confidence", F.round("avg_confidence", 6))


_SPAN = "CASE p_size%4 WHEN 0 THEN '('||p_name||', '||(1950+p_size)||')' WHEN 1 THEN p_name||' and '||p_brand WHEN 2 THEN p_brand||' et al. ('||(1950+p_size)||'-'||(1960+p_size)||')' ELSE p_brand END"


@query(f"SELECT count(*) FILTER (starts_with(x,'(') AND ends_with(x,')')) AS parenthetical, count(*) FILTER (NOT (starts_with(x,'(') AND ends_with(x,')'))) AS narrative, count(*) FILTER (contains(x,' and ') OR contains(x,', ') OR contains(x,' et al.')) AS multi_author, count(*) FILTER (regexp_matches(x,'\\d{{4}}-\\d{{4}}')) AS year_range FROM (SELECT {_SPAN} AS x FROM part)")
def citation_patterns(spark, d):
    k, year = F.col("p_size") % 4, lambda n: (F.col("p_size") + n).cast("string")
    span = F.when(k == 0, F.concat(F.lit("("), "p_name", F.lit(", "), year(1950), F.lit(")"))).when(k == 1, F.concat("p_name", F.lit(" and "), "p_brand"))
    span = span.when(k == 2, F.concat("p_brand", F.lit(" et al. ("), year(1950), F.lit("-"), year(1960), F.lit(")"))).otherwise(F.col("p_brand"))
    return U.citation_pattern_counts(t(spark, d, "part").select(span.alias("span")))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n=1")
def first_by_key(spark, d):
    return distinct_by_key(t(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_id")


@query("SELECT user_id::VARCHAR AS paper_id, arg_max(event_type, event_id) AS title FROM events GROUP BY 1 HAVING NOT (arg_max(event_type, event_id)='view' AND max(event_id)%2=0)")
def unique_papers(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("paper_id"), F.when(F.col("event_type") == "view", "Unknown view").otherwise(F.col("event_type")).alias("title"), F.when(F.col("event_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"))).alias("authors"), F.col("event_id").alias("seq"))
    return U.unique_papers(e, "seq").select("paper_id", F.regexp_replace("title", "^Unknown ", "").alias("title"))


_FINAL = "greatest(0, least(10, 5+2*(p_size%2)+2*(p_size%3=0)::INT+(p_size%5=0)::INT-2*(p_size%4)-p_size%2))/10"


@query(f"SELECT p_partkey AS paper_id, {_FINAL}::DOUBLE AS final, ((5*(p_size%2)+3*(p_size%3=0)::INT+2*(p_size%5=0)::INT)/10)::DOUBLE AS target, (least(10, 5+2*(p_size%2)+2*(p_size%3=0)::INT+2*(p_size%5=0)::INT+(p_size%7>2)::INT)/10)::DOUBLE AS asked FROM part")
def confidence_rules(spark, d):
    z = F.col("p_size")
    two, three, five = z % 2 == 1, z % 3 == 0, z % 5 == 0
    return t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), U.final_confidence(two, three, five, z % 4, z % 2).alias("final"), U.target_confidence(two, three, five).alias("target"), X.query_confidence(two, three, five, z % 7).alias("asked"))


@query("SELECT conv_id, turn, CASE WHEN contains(l,'continue') OR contains(l,'yes') OR contains(l,'ok') OR contains(l,'proceed') OR contains(l,'1') THEN 'continue' WHEN contains(l,'expand') OR contains(l,'more') OR contains(l,'additional') OR contains(l,'search') OR contains(l,'2') THEN 'expand' WHEN contains(l,'refine') OR contains(l,'modify') OR contains(l,'change') OR contains(l,'3') THEN 'refine' ELSE 'continue' END AS reply FROM (SELECT *, lower(text) AS l FROM conversations)")
def reply_classes(spark, d):
    return conversations(spark, d).select("conv_id", "turn", route.reply_column(F.col("text")).alias("reply"))


@query("SELECT conv_id, turn, count(*) FILTER (role='user') OVER w AS section_index, last_value(CASE WHEN role='user' THEN text END IGNORE NULLS) OVER w AS section_title FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def heading_sections(spark, d):
    return C.headings_to_sections(conversations(spark, d), ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "section_index", "section_title")


@query("WITH a AS (SELECT user_id, event_id, CASE WHEN event_id-lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)>200 THEN 1 ELSE 0 END AS s FROM events) SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS block FROM a")
def line_blocks(spark, d):
    return C.lines_to_blocks(t(spark, d, "events"), ["user_id"], "event_id", 200).select("user_id", "event_id", "block")


def placed(spark, d):
    """Characters: users are documents, kinds of events their pages, each event one character, its height half the value."""
    e = t(spark, d, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("page"), F.col("event_id").alias("x"), (F.floor("value") / 2).alias("y"), F.substring("event_type", 1, 1).alias("char"), (8 + F.col("event_id") % 8).alias("size"))


_LINES = "SELECT user_id AS doc_id, event_type AS page, floor(value)/2 AS y, string_agg(substr(event_type,1,1), '' ORDER BY event_id) AS text, count(*) AS chars, sum(8+event_id%8)::DOUBLE AS sizes FROM events GROUP BY 1,2,3"


@query(_LINES)
def char_lines(spark, d):
    return L.chars_to_lines(placed(spark, d))


@query(f"WITH l AS ({_LINES}), a AS (SELECT *, CASE WHEN lag(y) OVER w - y > 2 THEN 1 ELSE 0 END AS far FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY y DESC)), b AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS block FROM a) SELECT doc_id, page, block::BIGINT AS block, string_agg(text, chr(10) ORDER BY y DESC) AS text, sum(sizes)/sum(chars) AS font_size FROM b GROUP BY 1,2,3")
def char_blocks(spark, d):
    return L.placed_blocks(L.chars_to_lines(placed(spark, d)), gap=2)


def cited_points(spark, d):
    """The collection of citations: embeddings whose text names the supplier of their number."""
    e = t(spark, d, "embeddings")
    who = F.concat(F.lit("Lee, S"), (F.col("vec_id") % 10).cast("string"), F.lit(" says"))
    return e.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("C"), (F.col("vec_id") % 40).cast("string")).alias("paper_id"), F.concat(F.lit("t"), (F.col("vec_id") % 40).cast("string")).alias("title"), who.alias("text"), F.concat(F.lit("in "), who).alias("citation_context"))


def asked_vectors(spark, d):
    return t(spark, d, "embeddings").where("vec_id in (3, 5)").select(F.col("vec_id").cast("string").alias("id"), "embedding")


_HITS = "h AS (SELECT e.vec_id FROM (SELECT e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, 'p'||e.vec_id) AS n FROM embeddings e, embeddings q WHERE q.vec_id IN (3,5)) e WHERE n<=60), v AS (SELECT DISTINCT 'C'||(vec_id%40) AS paper_id, 't'||(vec_id%40) AS title, 'Lee, S'||(vec_id%10)||' says' AS text FROM h WHERE vec_id%10=5)"


@query(f"WITH e AS ({_FILED}), {_HITS}, g AS (SELECT DISTINCT c AS paper_id, c_name AS title FROM e JOIN customer ON c='C'||c_custkey WHERE s='S5') SELECT *, 'graph' AS origin FROM g UNION ALL SELECT paper_id, title, 'vector' FROM v WHERE paper_id NOT IN (SELECT paper_id FROM g)")
def bundle_citing_papers(spark, d):
    asked = asked_vectors(spark, d).withColumnRenamed("embedding", "vector")
    got = B.reverse_citations(I.graph_of(filed_graph(spark, d)), cited_points(spark, d), asked, "S5", ["Ann S5"], "", 60)
    return got["citing_papers"]


@query(f"WITH {_HITS} SELECT paper_id, title, 'vector' AS origin FROM v")
def bundle_without_id(spark, d):
    asked = asked_vectors(spark, d).withColumnRenamed("embedding", "vector")
    return B.reverse_citations(I.graph_of(filed_graph(spark, d)), cited_points(spark, d), asked, None, ["Ann S5"], "", 60)["citing_papers"]


@query()
def title_table(spark, d):
    """Every different part name against all parts."""
    p = parts(spark, d).select("paper_id", "title")
    return M.match_titles(p.select(F.col("title").alias("id"), "title").distinct(), p, 0.85)


@query()
def parsed_sentences(spark, d):
    return Z.parse_sentences(documents(spark, d))


_Q = f"(least(n/10000,5.0) + CASE WHEN w/n*100 BETWEEN 10 AND 25 THEN 3.0 ELSE greatest(0.0, 3.0-abs(w/n*100-17.5)/5) END + 3.0 - CASE WHEN o>0.3 THEN 2.0 ELSE 0.0 END - CASE WHEN sh/w>0.3 THEN 2.0 ELSE 0.0 END) AS q FROM (SELECT doc_id, len(text) AS n, {_W} AS w, {_SPECIAL} AS o, len(list_filter(regexp_extract_all(text,'[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: len(x)<=2)) AS sh FROM documents WHERE len(text)>0)"


@query(f"SELECT doc_id, CASE WHEN q>=7 AND doc_id%3>0 THEN 'excellent' WHEN q>=5 AND doc_id%3>0 THEN 'good' WHEN q>=3 THEN 'fair' ELSE 'poor' END AS level, (q<3)::INT+(doc_id%3=0)::INT+(doc_id%3*3<5)::INT+(doc_id%2=0)::INT AS advice FROM (SELECT doc_id, {_Q})")
def quality_levels(spark, d):
    score, n = F.col("score"), F.col("doc_id") % 3 * 3
    found = P.recommendations(score, n > 0, n, F.col("doc_id") % 2 == 1)
    advice = F.when(F.element_at(found, 1) == P.NO_ADVICE, 0).otherwise(F.size(found))
    # scores first: both columns use them more than once
    scored = documents(spark, d).where(F.length("text") > 0).select("doc_id", X.quality_score(F.col("text")).alias("score"))
    return scored.select("doc_id", P.quality_level(score, n > 0).alias("level"), advice.alias("advice"))


@query("SELECT path, (avg((len(trim(text,' '))<100)::INT)>0.6 AND avg((doc_id%3=0)::INT)>0.3) AS is_scanned FROM (SELECT doc_id, doc_id//8 AS path, doc_id%8 AS page_no, coalesce(text,'') AS text FROM documents) WHERE page_no<5 GROUP BY path")
def scan_detection(spark, d):
    pages = documents(spark, d).select(F.expr("doc_id div 8").alias("path"), (F.col("doc_id") % 8).alias("page_no"), "text", (F.col("doc_id") % 3 == 0).cast("int").alias("images"))
    return P.is_scanned(pages)


@query("SELECT doc_id, substring(text,1,300) AS part FROM documents")
def token_truncation(spark, d):
    return documents(spark, d).select("doc_id", X.token_truncate(F.col("text"), 100).alias("part"))


@query("SELECT p_partkey AS paper_id, p_type||'; '||p_brand||' ('||p_size||'). '||p_name||'. '||p_type||'. '||p_name||', X' AS reference FROM part")
def reference_strings(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), X.reference_string(F.array("p_type", "p_brand"), F.col("p_size").cast("string"), F.col("p_name"), F.col("p_type"), F.col("p_name"), F.lit("X")).alias("reference"))


@query("SELECT p_partkey AS paper_id, p_type AS surname, (1900+p_size)::VARCHAR AS year FROM part WHERE NOT contains(p_type, ' ')")
def intext_keys(spark, d):
    cite = F.concat(F.lit("("), F.col("p_type"), F.lit(" et al., "), (1900 + F.col("p_size")).cast("string"), F.lit("a)"))
    key = intext_key(cite)
    return t(spark, d, "part").where("NOT contains(p_type, ' ')").select(F.col("p_partkey").alias("paper_id"), key["surname"].alias("surname"), key["year"].alias("year"))
