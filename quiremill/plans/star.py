"""The operators over the star-schema tables, each with the SQL that must give the same rows.

citing papers: customer; cited papers: supplier (ids below zero, stubs); paragraphs: orders;
sentences: lineitem, which cite l_suppkey; authors: supplier, who "write" the parts they supply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import similarity as S
from ..functions import text as X
from ..functions.citations import extract_citations
from ..operators import authors as A
from ..operators import content as C
from ..operators import graph as G
from ..operators import resolve as R
from ..operators import rollup as U
from ..operators import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TARGET, SOURCE = -5, 7
#: For the SQL side: sentences with their edges, and paragraphs with theirs.
GRAPH = """WITH s AS (SELECT DISTINCT l_orderkey*10+l_linenumber AS sentence_id, l_orderkey AS paragraph_id, o_custkey AS paper_id, l_linenumber AS sentence_index, year(o_orderdate)::INTEGER AS year, o_orderpriority AS section, -l_suppkey-1 AS cited_id FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
pc AS (SELECT paragraph_id, paper_id, year, section, cited_id, count(*) AS citation_count FROM s GROUP BY ALL) """


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def graph(spark: SparkSession, d: str) -> G.Graph:
    line = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sentence_id"), F.col("l_orderkey").alias("paragraph_id"), F.col("l_linenumber").alias("sentence_index"), (-1 - F.col("l_suppkey")).alias("cited_id"))
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("paragraph_id"), F.col("o_custkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("section"))
    papers = t(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("journal"), F.lit(False).alias("stub"))
    stubs = t(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("paper_id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("journal"), F.lit(True).alias("stub"))
    # line numbers repeat within some orders; edges with their paper are dealt by order, which the join needs too
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").repartition("l_orderkey").distinct()
    own = own.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sentence_id"), F.col("l_orderkey").alias("paragraph_id"), (-1 - F.col("l_suppkey")).alias("cited_id"))
    citing = own.join(orders.select("paragraph_id", "paper_id"), "paragraph_id").select("sentence_id", "cited_id", "paper_id")
    line = line.distinct()
    return G.Graph(
        papers=papers.unionByName(stubs),
        paragraphs=orders.withColumn("paragraph_index", F.col("paragraph_id")),
        sentences=line.drop("cited_id").distinct().join(orders.drop("section"), "paragraph_id"),
        sentence_cites=line.select("sentence_id", "cited_id"),
        paragraph_cites=line.groupBy("paragraph_id", "cited_id").agg(F.count("*").alias("citation_count")),
        citing=citing,
    )


def flagship(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    top = G.influence(g, 1).first()
    return G.citing_papers(g, top["cited_id"])


_COUNTS = "count(DISTINCT sentence_id) AS sentence_citations, count(DISTINCT paragraph_id) AS paragraph_citations, count(DISTINCT sentence_id)+count(DISTINCT paragraph_id) AS total_citations"


@query(GRAPH + f"SELECT paper_id, {_COUNTS}, c_name AS title FROM s JOIN customer ON paper_id=c_custkey WHERE cited_id={TARGET} GROUP BY paper_id, c_name")
def citing_papers(spark, d):
    return G.citing_papers(graph(spark, d), TARGET)


@query(GRAPH + f"SELECT cited_id, {_COUNTS} FROM s WHERE paper_id={SOURCE} GROUP BY cited_id")
def cited_papers(spark, d):
    return G.cited_papers(graph(spark, d), SOURCE)


@query(GRAPH + f"SELECT sentence_id, paragraph_id, paper_id, sentence_index, year FROM s WHERE cited_id={TARGET} ORDER BY year DESC NULLS FIRST, sentence_index NULLS LAST, sentence_id LIMIT 100")
def citing_sentences(spark, d):
    return G.citing_sentences(graph(spark, d), TARGET).select("sentence_id", "paragraph_id", "paper_id", "sentence_index", "year")


@query(GRAPH + f"SELECT paragraph_id, paper_id, section, year, citation_count FROM pc WHERE cited_id={TARGET} ORDER BY citation_count DESC, year DESC NULLS FIRST, paragraph_id LIMIT 50")
def citing_paragraphs(spark, d):
    return G.citing_paragraphs(graph(spark, d), TARGET, by_count=True).select("paragraph_id", "paper_id", "section", "year", "citation_count")


@query(GRAPH + f"SELECT 'out' AS direction, cited_id AS other_id, count(DISTINCT sentence_id) AS frequency FROM s WHERE paper_id={SOURCE} GROUP BY cited_id UNION ALL SELECT 'in', paper_id, count(DISTINCT sentence_id) FROM s WHERE cited_id={SOURCE} GROUP BY paper_id")
def citation_network(spark, d):
    return G.citation_network(graph(spark, d), SOURCE)


@query(GRAPH + f"SELECT 'out' AS direction, cited_id AS other_id, count(DISTINCT sentence_id) AS frequency FROM s WHERE paper_id={TARGET} GROUP BY cited_id UNION ALL SELECT 'in', paper_id, count(DISTINCT sentence_id) FROM s WHERE cited_id={TARGET} GROUP BY paper_id")
def citation_network_of_cited(spark, d):
    return G.citation_network(graph(spark, d), TARGET)


@query(GRAPH + f"SELECT (SELECT least(count(*),200) FROM s WHERE cited_id={TARGET}) AS total_sentences, (SELECT least(count(*),100) FROM pc WHERE cited_id={TARGET}) AS total_paragraphs")
def citation_context_counts(spark, d):
    return G.citation_context_counts(graph(spark, d), TARGET)


@query(GRAPH + "SELECT (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier) AS total_papers, (SELECT count(*) FROM customer) AS uploaded_papers, (SELECT count(*) FROM supplier) AS stub_papers, (SELECT count(*) FROM (SELECT DISTINCT paper_id, cited_id FROM s)) AS paper_relations, (SELECT count(*) FROM s) AS citation_instances")
def network_overview(spark, d):
    return G.network_overview(graph(spark, d))


@query(GRAPH + "SELECT -s_suppkey-1 AS paper_id, count(DISTINCT s.paper_id) AS cited_by_count FROM supplier LEFT JOIN s ON s.cited_id=-s_suppkey-1 GROUP BY s_suppkey ORDER BY cited_by_count DESC, -s_suppkey LIMIT 10")
def stub_ranking(spark, d):
    return G.stub_ranking(graph(spark, d))


@query(GRAPH + "SELECT (SELECT count(DISTINCT sentence_id) FROM s) AS sentences, (SELECT count(*) FROM orders) AS paragraphs, (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier) AS papers, (SELECT count(*) FROM s) AS cites")
def graph_totals(spark, d):
    return G.graph_totals(graph(spark, d))


@query(GRAPH + f"SELECT sentence_id, paragraph_id, paper_id, section, cited_id FROM s WHERE cited_id={TARGET}")
def sentence_paths(spark, d):
    return G.sentence_paths(graph(spark, d), TARGET)


@query(GRAPH + "SELECT a.cited_id AS a, b.cited_id AS b, count(*) AS together FROM (SELECT DISTINCT paper_id, cited_id FROM s) a JOIN (SELECT DISTINCT paper_id, cited_id FROM s) b ON a.paper_id=b.paper_id AND a.cited_id<b.cited_id GROUP BY 1,2")
def co_citation(spark, d):
    return G.co_citation(graph(spark, d))


@query(GRAPH + "SELECT cited_id, count(DISTINCT paper_id) AS citing_papers, count(*) AS mentions FROM s GROUP BY cited_id ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def influence_rank(spark, d):
    return G.influence(graph(spark, d))


@query(GRAPH + "SELECT year, count(*) AS citations FROM s GROUP BY year")
def citations_per_year(spark, d):
    return G.citations_per_year(graph(spark, d))


@query(GRAPH + "SELECT paper_id AS citing_id, cited_id, count(*) AS mentions FROM s GROUP BY 1,2")
def paper_pair_counts(spark, d):
    return G.paper_pairs(graph(spark, d))


@query(GRAPH + "SELECT pc.paragraph_id, cited_id, citation_count, round(citation_count/n, 6) AS citation_density FROM pc JOIN (SELECT paragraph_id, count(DISTINCT sentence_id) AS n FROM s GROUP BY 1) z ON z.paragraph_id=pc.paragraph_id")
def paragraph_density(spark, d):
    g = graph(spark, d)
    return G.paragraph_citations(g.sentences, g.sentence_cites).withColumn("citation_density", F.round("citation_density", 6))


@query(GRAPH + ", k AS (SELECT l_orderkey*10+l_linenumber AS sentence_id, min(l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT cited_id, count(*) AS citations, count(*) FILTER (f='A') AS a, count(*) FILTER (f='N') AS n, count(*) FILTER (f='R') AS r FROM s JOIN k USING (sentence_id) GROUP BY 1 ORDER BY citations DESC, cited_id LIMIT 10")
def most_cited(spark, d):
    kind = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sentence_id"), F.col("l_returnflag").alias("relation_type"))
    kind = kind.groupBy("sentence_id").agg(F.min("relation_type").alias("relation_type"))
    got = G.most_cited(graph(spark, d), kind).withColumn("m", F.map_from_entries("types"))
    return got.select("cited_id", "citations", *(F.coalesce(F.col("m")[k], F.lit(0)).alias(k.lower()) for k in "ANR"))


@query("SELECT p_partkey AS paper_id, p_name AS title, p_brand AS journal, p_size AS year FROM part WHERE p_partkey=11")
def paper_metadata(spark, d):
    return G.paper_metadata(parts(spark, d).select("paper_id", "title", "journal", "year"), 11)


def parts(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("journal"), F.col("p_size").alias("year"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/pdf/"), F.col("p_partkey").cast("string"))).alias("pdf_path"))


@query("SELECT i AS paper_id, CASE WHEN p_size%2=0 THEN '/pdf/'||p_partkey END AS pdf_path FROM (SELECT unnest([1,2,3,4,99999999])::BIGINT AS i) LEFT JOIN part ON i=p_partkey")
def paths_for_ids(spark, d):
    return A.paths_for(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 99999999)], "paper_id long"), parts(spark, d))


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F')")
def pending_papers(spark, d):
    o = t(spark, d, "orders")
    progress = o.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return U.pending(o.select(F.col("o_orderkey").alias("path")), progress)


def author_tables(spark, d):
    authors = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), ids.author_key(F.col("s_name")).alias("normalized_name"))
    links = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("author_id"), F.col("l_partkey").alias("paper_id"), F.lit(0).alias("author_position"))
    return authors, links.repartition("paper_id").distinct()  # dealt by paper, which its pairs of authors need too


@query("SELECT s_suppkey AS id, s_name AS name, count(DISTINCT l_partkey) AS paper_count FROM supplier LEFT JOIN lineitem ON l_suppkey=s_suppkey GROUP BY 1,2")
def author_counts(spark, d):
    return A.paper_counts(*author_tables(spark, d))


@query("SELECT (SELECT count(*) FROM part) AS total_papers, (SELECT count(*) FROM part WHERE p_size%2=0) AS papers_with_pdf, (SELECT count(*) FROM supplier) AS total_authors, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS authors_with_papers, round((SELECT count(*) FROM part WHERE p_size%2=0)/(SELECT count(*) FROM part),6) AS availability_rate")
def author_stats(spark, d):
    return A.statistics(*author_tables(spark, d), parts(spark, d))


_AUTHOR = "SELECT DISTINCT s_suppkey AS author_id, s_name AS author_name, l_partkey AS paper_id, p_name AS title, p_size AS year FROM supplier JOIN lineitem ON l_suppkey=s_suppkey JOIN part ON p_partkey=l_partkey WHERE "


@query(_AUTHOR + "lower(trim(s_name)) = (SELECT lower(trim(s_name)) FROM supplier WHERE s_suppkey=3)")
def author_exact(spark, d):
    authors, links = author_tables(spark, d)
    name = authors.where("id = 3").first()["name"]
    return A.papers_of(name, authors, links, parts(spark, d), exact=True).select("author_id", "author_name", "paper_id", "title", "year")


@query(_AUTHOR + "lower(s_name) LIKE '%7'")
def author_like(spark, d):
    authors, links = author_tables(spark, d)
    return A.papers_of("7", authors, links, parts(spark, d)).where(F.col("author_name").endswith("7")).select("author_id", "author_name", "paper_id", "title", "year")


@query("WITH x AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS p FROM lineitem) SELECT x.u AS a, y.u AS b, count(*) AS papers FROM x JOIN x y ON x.p=y.p AND x.u<y.u GROUP BY 1,2")
def collaboration(spark, d):
    return A.collaboration(author_tables(spark, d)[1])


@query("SELECT p_partkey AS paper_id, p_name AS title, round(1.0/len(list_filter(string_split_regex(lower(p_name),'\\s+'), lambda w: w<>'')),6) AS match_ratio FROM part WHERE list_contains(string_split_regex(lower(p_name),'\\s+'), (SELECT string_split(lower(p_name),' ')[1] FROM part WHERE p_partkey=1))")
def author_token_match(spark, d):
    p = parts(spark, d)
    token = p.where("paper_id = 1").first()["title"].lower().split(" ")[0]
    got = A.match_tokens(p.withColumn("tokens", S.name_tokens(F.col("title"))), [token])
    return got.select("paper_id", "title", F.round("match_ratio", 6).alias("match_ratio"))


@query("WITH q AS (SELECT lower(p_name[1:8]) AS q FROM part WHERE p_partkey=1) SELECT p_partkey AS paper_id, round(least(1.0, len(q)/len(p_name) + CASE WHEN starts_with(lower(p_name), q) THEN 0.1 ELSE 0.0 END + least(len(q)/len(p_name)*0.2, 0.2)),6) AS confidence FROM part, q WHERE contains(lower(trim(p_name)), trim(q)) AND len(q)>=5 AND len(trim(q))=len(q)")
def title_substring_confidence(spark, d):
    p = parts(spark, d)
    q = F.lit(p.where("paper_id = 1").first()["title"][:8].lower())
    hit = p.where(S.is_title_part(q, F.col("title")) & (F.length(F.trim(q)) == F.length(q)))
    return hit.select("paper_id", F.round(S.part_confidence(q, F.col("title")), 6).alias("confidence"))


@query()
def title_fuzzy(spark, d):
    p = parts(spark, d)
    return R.by_title(p, p.where("paper_id = 1").first()["title"][:-2] + "xx").select("paper_id", "title", "ratio", "combined", "is_part", "status")


@query("SELECT p_partkey AS paper_id, sha256(lower(trim(regexp_replace(regexp_replace(p_name,'[^\\p{L}\\p{N}_\\s]','','g'),'\\s+',' ','g')))||'_'||(1990+p_size%30)) AS id FROM part")
def paper_id_hash(spark, d):
    p = parts(spark, d)
    return p.select("paper_id", ids.paper_id(F.col("title"), F.lit(1990) + F.col("year") % 30).alias("id"))


def points(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("collection"))


def probe(spark, d, key=0):
    return points(spark, d).where(F.col("id") == key).first()["vector"]


_DOT = "list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0))"


@query(f"SELECT vec_id AS id, round({_DOT},6) AS score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return V.search(points(spark, d), probe(spark, d), 10, "dot").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, label::VARCHAR AS collection, round({_DOT},6) AS score FROM embeddings WHERE label IN (1,2) ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    return V.search(points(spark, d), probe(spark, d), 10, "dot", where=F.col("collection").isin("1", "2")).select("id", "collection", F.round("score", 6).alias("score"))


@query(f"SELECT id, collection, score FROM (SELECT vec_id AS id, label::VARCHAR AS collection, round({_DOT},6) AS score, row_number() OVER (PARTITION BY label ORDER BY {_DOT} DESC, vec_id) AS n FROM embeddings) WHERE n<=3")
def vector_multi_collection(spark, d):
    return V.search_collections(points(spark, d), probe(spark, d), 3).select("id", "collection", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round({_DOT},5) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)),5) AS cosine, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)),5) AS euclid FROM embeddings")
def vector_metrics(spark, d):
    q = V.literal(probe(spark, d))
    v = F.col("vector")
    return points(spark, d).select("id", F.round(V.dot(v, q), 5).alias("dot"), F.round(V.cosine(v, q), 5).alias("cosine"), F.round(V.euclid(v, q), 5).alias("euclid"))


@query(f"SELECT count(*) AS hits, round(max({_DOT}),6) AS max_score, round(min({_DOT}),6) AS min_score FROM embeddings WHERE {_DOT}>=0.2")
def vector_threshold(spark, d):
    got = V.search(points(spark, d), probe(spark, d), None, "dot", min_score=0.2)
    return got.agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.min("score"), 6).alias("min_score"))


@query("SELECT query, vec_id AS id, score FROM (SELECT q.vec_id AS query, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]),6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS n FROM embeddings e, embeddings q WHERE q.vec_id%100=0) WHERE n<=5")
def vector_query_blocks(spark, d):
    p = points(spark, d)
    return V.search_blocks(p, p.where("id % 100 = 0"), 5).select("query", "id", F.round("score", 6).alias("score"))


def documents(spark, d):
    return t(spark, d, "documents").select("doc_id", "text")


@query("WITH p AS (SELECT doc_id, string_split(lower(text),'the') AS a FROM documents) SELECT doc_id, len(a)-1 AS occurrences FROM p WHERE len(a)>1")
def kwic_counts(spark, d):
    got = documents(spark, d).select("doc_id", F.size(X.occurrences(F.col("text"), "the")).alias("occurrences"))
    return got.where("occurrences > 0").select("doc_id", F.col("occurrences").cast("long"))


_SPLIT = "WITH p AS (SELECT doc_id, text, string_split(lower(text),'tion') AS a FROM documents), q AS (SELECT doc_id, text, unnest(range(1, len(a))) AS k, a FROM p WHERE len(a)>1), pos AS (SELECT doc_id, text, len(array_to_string(a[1:k],'tion')) AS position FROM q) "


@query(_SPLIT + "SELECT doc_id, position::INTEGER AS position FROM pos")
def kwic_positions(spark, d):
    return C.kwic(documents(spark, d), "tion").select("doc_id", "position")


@query("SELECT doc_id, trim(CASE WHEN instr(text,'onan')>0 THEN substring(text, greatest(instr(text,'onan')-50,1), instr(text,'onan')+4+50-greatest(instr(text,'onan')-50,1)) ELSE text END, ' ') AS context FROM documents WHERE contains(text,'onan')")
def context_window(spark, d):
    return documents(spark, d).where(F.col("text").contains("onan")).select("doc_id", X.context(F.col("text"), F.lit("onan")).alias("context"))


@query("SELECT conv_id AS paper_id, string_agg('## '||role||chr(10)||chr(10)||text, chr(10)||chr(10) ORDER BY turn) AS full_text, count(*) AS sections FROM conversations GROUP BY conv_id")
def full_text_assembly(spark, d):
    s = t(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("section_index"), F.col("role").alias("title"), "text")
    return C.full_text(s).select("paper_id", "full_text", F.col("sections").cast("long"))


@query("SELECT doc_id, CASE WHEN len(text)>200 THEN text[1:200]||'...' ELSE text END AS preview FROM documents")
def preview(spark, d):
    return documents(spark, d).select("doc_id", X.truncate(F.col("text"), 200).alias("preview"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split_regex(text,'[.!?]+'), lambda s: trim(s,' ')), lambda s: s<>''))::INTEGER AS sentences, len(string_split_regex(text,'[.!?]+'))::INTEGER AS pieces FROM documents")
def sentence_split(spark, d):
    x = F.col("text")
    return documents(spark, d).select("doc_id", F.size(X.naive_sentences(x)).alias("sentences"), X.sentence_count(x).alias("pieces"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text,'\\s+'), lambda w: w<>''))::INTEGER AS words, len(text)::INTEGER AS chars FROM documents")
def word_char_counts(spark, d):
    x = F.col("text")
    return documents(spark, d).select("doc_id", X.word_count(x).alias("words"), X.char_count(x).alias("chars"))


_SPECIAL = "len(regexp_replace(text,'[\\p{L}\\p{N}\\p{M}_\\s.,;:!?()-]','','g'))/len(text)"


@query(f"SELECT doc_id, round({_SPECIAL},6) AS special_ratio, ({_SPECIAL}>0.15 OR regexp_matches(text,'H\\d{{6}}') OR len(regexp_extract_all(text,'\\s+'))/len(text)>0.5) AS is_noise FROM documents")
def noise_filter(spark, d):
    x = F.col("text")
    return documents(spark, d).select("doc_id", F.round(X.special_ratio(x), 6).alias("special_ratio"), X.is_noise(x).alias("is_noise"))


_FURNITURE = "'^\\d+\\s*$|^[A-Z\\s]+/Vol\\.\\s*\\d+|Management Science.*\\d{4}|Downloaded from.*\\d{4}|For personal use only|^\\d+\\s+[A-Z][a-z]+\\s+\\d{4}$|^Figure\\s+\\d+|^Table\\s+\\d+|^\\s*\\d+\\.\\d+\\s'"


@query(f"SELECT doc_id, regexp_matches(text,{_FURNITURE}) AS furniture, (contains(lower(text),'all rights reserved') OR contains(lower(text),'copyright') OR contains(lower(text),'downloaded from') OR contains(lower(text),'for personal use only') OR contains(lower(text),'doi:')) AS notice FROM documents")
def boilerplate_filter(spark, d):
    x = F.col("text")
    return documents(spark, d).select("doc_id", X.is_furniture(x).alias("furniture"), X.is_notice(x).alias("notice"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text,'-\\s*\\n\\s*','','g'),'[\\x01-\\x1F\\x7F-\\x{9F}\\x{2000}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}-\\x{206F}]',' ','g'),'[\\s\\x{A0}\\x{85}]+',' ','g'),' ') AS clean FROM documents")
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", X.clean_sentence(F.col("text")).alias("clean"))


_S = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"


def _chain(x: str, *steps: tuple[str, str, str]) -> str:
    for pattern, with_, flags in steps:
        x = f"regexp_replace({x}, '{pattern}', {with_}, '{flags}')"
    return x


@query(
    "SELECT page_id, "
    + _chain(
        "html", ("<[^>]*>", "' '", "gs"), ("```.*?```", "''", "gs"), ("`[^`]+`", "''", "g"), ("(?m)^#{1,6}[\\s\\x0b]*", "''", "g"), ("\\[([^\\]]+)\\]\\([^)]+\\)", "'\\1'", "g"),
        ("\\*\\*([^*]+)\\*\\*", "'\\1'", "g"), ("\\*([^*]+)\\*", "'\\1'", "g"), ("__([^_]+)__", "'\\1'", "g"), ("_([^_]+)_", "'\\1'", "g"),
        ("\\|[^|\\n]*\\|", "''", "g"), ("(?m)^[-|: ]+$", "''", "g"), ("\\n[\\s\\x0b]*\\n", "chr(10)||chr(10)", "g"), ("[ \\t]+", "' '", "g"), (f"^{_S}+|{_S}+$", "''", "g"),
    )
    + " AS text FROM pages"
)
def strip_markup(spark, d):
    return t(spark, d, "pages").select("page_id", X.strip_markdown(F.regexp_replace("html", "(?s)<[^>]*>", " ")).alias("text"))


@query("SELECT page_id, CASE WHEN contains(h,'abstract') THEN 'abstract' WHEN contains(h,'introduction') OR contains(h,'background') THEN 'introduction' WHEN contains(h,'literature') OR contains(h,'related work') OR contains(h,'prior') THEN 'literature_review' WHEN contains(h,'method') OR contains(h,'approach') OR contains(h,'design') THEN 'methodology' WHEN contains(h,'result') OR contains(h,'finding') OR contains(h,'analysis') THEN 'results' WHEN contains(h,'discussion') THEN 'discussion' WHEN contains(h,'conclusion') OR contains(h,'summary') THEN 'conclusion' WHEN contains(h,'reference') OR contains(h,'bibliography') THEN 'references' ELSE 'other' END AS section_type FROM (SELECT page_id, lower(html) AS h FROM pages)")
def section_type(spark, d):
    return t(spark, d, "pages").select("page_id", X.section_type(F.col("html")).alias("section_type"))


_VOTES = {k: "+".join(f"contains(l,'{p}')::INT" for p in v) for k, v in X.LANGUAGES.items()}
_BEST = "CASE WHEN greatest({all})=0 THEN 'en' {when} END".format(all=",".join(_VOTES), when=" ".join(f"WHEN {k}=greatest({','.join(_VOTES)}) THEN '{k}'" for k in _VOTES))


@query(f"SELECT doc_id, fr, de, {_BEST} AS language FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _VOTES.items())} FROM (SELECT doc_id, lower(text) AS l FROM documents))")
def language_votes(spark, d):
    votes = documents(spark, d).select("doc_id", *(v.alias(k) for k, v in X.language_votes(F.col("text")).items()))
    return votes.select("doc_id", "fr", "de", X.pick_language({k: F.col(k) for k in X.LANGUAGES}).alias("language"))


@query("WITH d AS (SELECT doc_id, list_distinct(string_split(lower(text),' ')) AS w FROM documents), b AS (SELECT item_id, list_distinct(string_split(lower(text),' ')) AS w FROM benchmark) SELECT doc_id, item_id, len(list_intersect(d.w,b.w))::INTEGER AS shared FROM d, b WHERE len(list_intersect(d.w,b.w))>5 AND len(list_intersect(d.w,b.w))/len(b.w)>0.7")
def paragraph_sentence_overlap(spark, d):
    return C.word_overlap(documents(spark, d), t(spark, d, "benchmark"), "doc_id", "item_id")


_W = "len(list_filter(string_split_regex(text,'\\s+'), lambda w: w<>''))"


@query(f"SELECT doc_id, round(greatest(0.0, least(n/10000,5.0) + CASE WHEN w/n*100 BETWEEN 10 AND 25 THEN 3.0 ELSE greatest(0.0, 3.0-abs(w/n*100-17.5)/5) END + 3.0 - CASE WHEN o>0.3 THEN 2.0 ELSE 0.0 END - CASE WHEN sh/w>0.3 THEN 2.0 ELSE 0.0 END),4) AS quality FROM (SELECT doc_id, len(text) AS n, {_W} AS w, {_SPECIAL} AS o, len(list_filter(regexp_extract_all(text,'[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: len(x)<=2)) AS sh FROM documents)")
def text_quality(spark, d):
    return documents(spark, d).select("doc_id", F.round(X.quality_score(F.col("text")), 4).alias("quality"))


@query()
def citation_extraction(spark, d):
    """Every whole text; the tests hold it against the scanner and its goldens."""
    return documents(spark, d).select("doc_id", F.array_join(extract_citations("text"), "|").alias("cites"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n<=3")
def memory_last3(spark, d):
    return U.recent_turns(t(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*)>=6")
def memory_over_threshold(spark, d):
    return U.to_summarise(t(spark, d, "conversations"), 6)


@query("SELECT conv_id, string_agg(role||': '||CASE WHEN role='assistant' AND len(text)>200 THEN text[1:200]||'...' ELSE text END, chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n<=3 GROUP BY conv_id")
def conversation_context(spark, d):
    return U.conversation_context(t(spark, d, "conversations"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return G.upsert(old, new, ["user_id"], "event_id")


@query("WITH x AS (SELECT user_id AS paper_id, event_type, event_type='view' AS stub, event_id AS seq FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY stub, seq DESC) AS n FROM x) SELECT paper_id, event_type AS title, stub FROM r WHERE n=1")
def stub_resolution(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("title"), (F.col("event_type") == "view").alias("stub"), F.col("event_id").alias("seq"))
    return G.upsert_papers(e.limit(0), e, "seq").select("paper_id", "title", "stub")


def tagged(spark, d):
    """Events of a user as tags: the first type in a row opens a span, others of that type go on."""
    e = t(spark, d, "events").select("user_id", "event_id", "event_type")
    same = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")) == F.col("event_type")
    return e.withColumn("tag", F.concat(F.when(F.coalesce(same, F.lit(False)), "I-").otherwise("B-"), F.col("event_type")))


@query("WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS span FROM a) SELECT user_id, event_type AS label, min(event_id) AS start, max(event_id) AS \"end\", count(*) AS tokens FROM b GROUP BY user_id, span, event_type")
def bio_spans(spark, d):
    return U.bio_spans(tagged(spark, d), ["user_id"], "event_id").drop("span")


@query("WITH c AS (SELECT count(*) FILTER (quality=1) AS predicted, count(*) FILTER (toxic=1) AS actual, count(*) FILTER (quality=1 AND toxic=1) AS correct FROM labels) SELECT predicted, actual, correct, round(correct/predicted,6) AS precision, round(correct/actual,6) AS recall, round(2*(correct/predicted)*(correct/actual)/(correct/predicted+correct/actual),6) AS f1 FROM c")
def prf_metrics(spark, d):
    x = t(spark, d, "labels")
    got = U.span_scores(x.where("quality = 1"), x.where("toxic = 1"), ["doc_id"])
    return got.select("predicted", "actual", "correct", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1,2")
def confusion(spark, d):
    return U.confusion(t(spark, d, "labels"), "quality", "toxic")


@query("WITH l AS (SELECT unnest([0,1]) AS label), c AS (SELECT label, count(*) FILTER (quality=label) AS support, count(*) FILTER (toxic=label) AS given, count(*) FILTER (quality=label AND toxic=label) AS ok FROM l, labels GROUP BY label) SELECT label::INTEGER AS label, support, round(ok/given,6) AS precision, round(ok/support,6) AS recall FROM c")
def class_scores(spark, d):
    return U.class_scores(t(spark, d, "labels"), "quality", "toxic").select("label", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT count(*) AS total_files, count(*) FILTER (event_type='purchase') AS completed, count(*) FILTER (event_type='error') AS failed, round(count(*) FILTER (event_type='purchase')*100.0/count(*),4) AS success_rate FROM events")
def progress_summary(spark, d):
    e = t(spark, d, "events").select(F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("open").alias("status"))
    return U.progress_summary(e).withColumn("success_rate", F.round("success_rate", 4))


@query("SELECT event_type AS tool, (user_id%3)::INTEGER AS kind, count(*) AS n, array_to_string(list_sort(list(event_id))[1:3],',') AS examples FROM events GROUP BY 1,2")
def result_rollup(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("tool"), (F.col("user_id") % 3).cast("int").alias("kind"), F.col("event_id").alias("item"))
    return U.result_rollup(e).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query("SELECT user_id, count(*) AS items, count(DISTINCT event_type) AS tools, CASE WHEN count(*)>10 AND count(DISTINCT event_type)>2 THEN 'high' WHEN count(*)>5 AND count(DISTINCT event_type)>1 THEN 'medium' ELSE 'low' END AS bucket FROM events GROUP BY user_id")
def confidence_bucket(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("items"), F.countDistinct("event_type").alias("tools"))
    return e.withColumn("bucket", U.confidence_bucket(F.col("items"), F.col("tools")))


@query("SELECT p_brand AS brand, count(*) AS matches, CASE WHEN count(*)=1 THEN 0.9 WHEN count(*)<=3 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM part GROUP BY 1")
def entity_confidence(spark, d):
    m = t(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("matches"))
    return m.withColumn("confidence", R.entity_confidence(F.col("matches")))


@query("SELECT conv_id, turn, CASE WHEN contains(l,'cited by') OR contains(l,'references to') OR contains(l,'who cites') THEN 'incoming' WHEN contains(l,'cites') OR contains(l,'references') OR contains(l,'mentions') THEN 'outgoing' ELSE 'both' END AS direction, CASE WHEN contains(l,'cit') OR contains(l,'refer') OR contains(l,'mention') OR contains(l,'quote') OR contains(l,'support') OR contains(l,'refute') OR contains(l,'extend') THEN 'citation_analysis' WHEN role='user' THEN 'author_papers' ELSE 'paper_search' END AS class FROM (SELECT *, lower(text) AS l FROM conversations)")
def route_keywords(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", X.citation_direction(F.col("text")).alias("direction"), X.query_class(F.col("text"), F.col("role") == "user").alias("class"))
