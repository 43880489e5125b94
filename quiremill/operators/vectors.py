"""Vector search by exact brute force.

One vector, or a block of at most MOST_QUERIES, is given by the caller and travels with the plan as literals; the scan
keeps its filters and column pruning. A table of queries of any size stays a table: points and queries are packed into blocks of
a fixed number of rows, and each pair of blocks is one matrix product in a task. Either way the top k per query are
kept before anything is shuffled, and again after.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_QUERIES = 64
COLLECTIONS = ("sentences", "paragraphs", "sections", "citations")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine, "dot": dot, "euclid": lambda a, b: -euclid(a, b)}


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def matching(paper_ids: Sequence[str] = (), years: Sequence[int | str] = (), journals: Sequence[str] = (), kinds: dict[str, Sequence[str]] | None = None) -> Column | None:
    """Filters of a search as one predicate; an empty list asks for nothing. years match as number or text,
    journals by any part of the name whatever its case; kinds: values by column (sentence_type, section, section_type)."""
    tests = [F.col("paper_id").isin(*paper_ids)] if paper_ids else []
    tests += [F.coalesce(F.col("year").cast("string"), F.lit("")).isin(*(str(y) for y in years))] if years else []
    if journals:
        low = F.lower(F.coalesce("journal", F.lit("")))
        tests.append(reduce(lambda a, b: a | b, (low.contains(j.lower()) for j in journals)))
    tests += [F.col(c).isin(*values) for c, values in (kinds or {}).items() if values]
    return reduce(lambda a, b: a & b, tests) if tests else None


def totals(results: DataFrame, collection: str = "collection") -> DataFrame:
    """One row over the results of all collections: how many, the best score, and how many collections gave any."""
    return results.agg(F.count("*").alias("total_results"), F.max("score").alias("max_score"), F.countDistinct(collection).alias("collections"))


def search(points: DataFrame, vector: Sequence[float], k: int | None = 5, metric: str = "cosine", key: str = "id", where: Column | None = None, min_score: float | None = None, column: str = "vector") -> DataFrame:
    """The k best points, raw score, ties by key. Filters hold before the cut, so k are found if there are k. k=None: all, in no order."""
    got = points if where is None else points.where(where)
    got = got.withColumn("score", METRICS[metric](F.col(column), literal(vector)))
    got = got if min_score is None else got.where(F.col("score") >= min_score)
    return got if k is None else got.orderBy(F.desc("score"), key).limit(k)


def search_collections(points: DataFrame, vector: Sequence[float], k: int = 3, collection: str = "collection", key: str = "id", column: str = "vector") -> DataFrame:
    """The k best of each collection in one pass."""
    got = points.withColumn("score", dot(F.col(column), literal(vector)))
    return _by_window(got, collection, key, k).drop(column)


def _by_window(got: DataFrame, collection: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(collection).orderBy(F.desc("score"), key)
    return got.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")  # Spark cuts to k in each task first


def search_many(points: DataFrame, queries: dict, k: int = 5, key: str = "id", column: str = "vector") -> DataFrame:
    """(query, key, score): the k best for each query of a block of at most MOST_QUERIES."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"pass at most {MOST_QUERIES} queries at a time")
    scores = F.array(*(F.struct((F.lit(q).cast("long") if isinstance(q, int) else F.lit(q)).alias("query"), dot(F.col(column), literal(v)).alias("score")) for q, v in queries.items()))
    got = points.select(key, F.explode(scores).alias("s")).select("s.query", key, "s.score")
    return _by_window(got, "query", key, k)


#: Rows of a packed block of points and of queries.
POINT_ROWS, QUERY_ROWS = 4096, 512


def packed(rows: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(keys, vectors, width): rows with a vector, so many in a block, vectors as doubles in a row. One pass, no shuffle."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}  # vectors of one width together

        def block(width: int) -> pa.RecordBatch:
            keys, vectors = held.pop(width)
            made = [pa.array([keys], pa.list_(key_type)), pa.array([np.concatenate(vectors).tobytes()], pa.binary()), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays(made, ["keys", "vectors", "width"])

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                keys, vectors = held.setdefault(len(x), ([], []))
                keys.append(k)
                vectors.append(x)
                if len(keys) >= size:
                    yield block(len(x))
        for width in list(held):
            yield block(width)

    return rows.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(key, column).mapInArrow(run, f"keys array<{kind}>, vectors binary, width int")


def best_of(p: np.ndarray, p_keys: np.ndarray, q: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the keys and scores of its k best of p; all that tie with the last of these compete by key."""
    if metric == "euclid":
        scores = np.stack([-np.sqrt(((p - x) ** 2).sum(1)) for x in q])
    else:
        scores = q @ p.T
        if metric == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = scores / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None])
    for row in scores:
        known = np.flatnonzero(~np.isnan(row))
        if len(known) > k:
            least = np.partition(row[known], len(known) - k)[len(known) - k]
            known = known[row[known] >= least - TIE * abs(least)]
        order = np.lexsort((p_keys[known], -row[known])) if p_keys.dtype != object else sorted(range(len(known)), key=lambda i: (-row[known[i]], p_keys[known[i]]))
        # products of different shapes round apart; what is that close goes on to the last cut
        yield p_keys[known[order]], row[known[order]]


#: Scores of one pair from products of different shapes differ by less than this share.
TIE = 1e-12


def search_blocks(points: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", column: str = "vector", metric: str = "dot", slots: int | None = None) -> DataFrame:
    """(query, key, score): the k best points for each row of queries (key, column), however many of either. Rows without a
    vector, and points of another width than the query, take no part; ties go by key.

    Blocks of points are dealt over slots, each slot gets all blocks of queries; nothing of either goes through the driver, and
    no task holds more than one block of each."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    slots = slots or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = packed(points, key, column, POINT_ROWS).withColumn("slot", F.pmod(F.xxhash64("vectors"), F.lit(slots)))
    q = packed(queries, key, column, QUERY_ROWS).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")))
    pairs = p.join(q.select("slot", "width", F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors")), ["slot", "width"])
    kind, q_kind = points.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                width, p_list, q_list = b.column("width")[r].as_py(), b.column("keys")[r].values, b.column("q_keys")[r].values
                p_keys = p_list.to_numpy(zero_copy_only=False)
                x, y = (np.frombuffer(b.column(c)[r].as_buffer(), "<f8").reshape(-1, max(1, width)) for c in ("vectors", "q_vectors"))
                found = list(best_of(x, p_keys, y, k, metric)) if width else []
                at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                if len(at):
                    yield pa.RecordBatch.from_arrays([q_list.take(pa.array(at)), pa.array(np.concatenate([f[0] for f in found]), p_list.type), pa.array(np.concatenate([f[1] for f in found]), pa.float64())], ["query", key, "score"])

    got = pairs.select("keys", "vectors", "width", "q_keys", "q_vectors").mapInArrow(run, f"query {q_kind}, `{key}` {kind}, score double")
    return _by_window(got, "query", key, k)


def embed_text(text: str | None, size: int = 384) -> list[float]:
    """A bag of hashed tokens, of unit length: the default where no model is at hand."""
    out = np.zeros(size)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        out[h % size] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(out)
    return (out / n if n else out).astype(np.float32).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: pd.Series) -> pd.Series:
    return text.map(embed_text)


def index(rows: DataFrame, collection: str | Column, text: str = "text", keys: Sequence[str] = ("paper_id", "idx")) -> DataFrame:
    """rows as points of a collection, named or by a column. The id is a hash of the keys, so indexing again adds nothing."""
    name = F.lit(collection) if isinstance(collection, str) else collection
    return rows.withColumn("id", F.sha2(F.concat_ws("_", name, *keys), 256)).withColumn("collection", name).withColumn("vector", embed(F.col(text)))
