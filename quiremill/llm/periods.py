"""Operator 11: runs of repeated word sequences in texts (periodic runs), and the texts without the repeats.

A run is a stretch of words with smallest period q, at least max(LEAST, TIMES * q) words long, that no
neighbouring word extends. How often each lag has equal words is counted exactly: words that occur
often by one Fourier autocorrelation, others by the differences of their places. Only lags with as many
matches as the shortest run needs are scanned for islands of matches; matches that a run of a smaller
period already explains are taken off its multiples first.

Words are what stands between the bytes 9 to 13 and 32. Null text counts as empty; texts without words have
no runs and collapse to nothing. Texts of any length are read whole; a text's words fit one task, its
longest table holds eight bytes for each word (FFT: 32). Each row is judged by itself: repeated rows
have equal results, an empty table gives an empty one, no column but the key and the text is read. Of equally long
runs the query reports the one that starts first, then the one of the smaller period. Rows without
doc_id are not rewritten by the query, as they have no number to draw from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import slices

LEAST, TIMES = 6, 4
#: Words as the task defines them.
SPACE = r"[\x20\x09-\x0D]+"
#: Lags above this are looked at from every lag-th word first.
SPARSE = 32
#: Cells of one block of transformed words.
CELLS = 1 << 21


def lag_counts(w: np.ndarray, most: int) -> np.ndarray:
    """How many i have w[i] == w[i + q], for each lag q up to most. w: word numbers from 0."""
    freq = np.bincount(w)
    size = 1 << int(len(w) + most).bit_length()
    # f: words that occur over t times are transformed, the others compared t places apart; t is the cheapest (in about nanoseconds)
    f = np.sort(freq)[::-1].astype(np.int64)
    transform = 3000 + 2 * size * size.bit_length()
    rest = np.concatenate([np.cumsum((f * f)[::-1])[::-1], [0]])
    light = np.concatenate([f, [0]])
    heavy = int(np.argmin(np.arange(len(f) + 1) * transform + light * 8000 + 4 * rest))
    out = np.zeros(most + 1, np.int64)
    order = np.argsort(w, kind="stable")
    ends = np.cumsum(freq)
    if heavy:
        ids = np.argsort(-freq, kind="stable")[:heavy]
        power, block = np.zeros(size // 2 + 1), max(1, CELLS // size)
        for low in range(0, heavy, block):
            some = ids[low : low + block]
            rows = np.zeros((len(some), size))
            for row, x in zip(rows, some, strict=True):
                row[order[ends[x] - freq[x] : ends[x]]] = 1
            got = np.fft.rfft(rows)
            power += (got.real**2 + got.imag**2).sum(0)
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        rare = np.ones(len(freq), bool)
        rare[ids] = False
        order = order[rare[w[order]]]
    word, at = w[order], np.arange(len(order))
    k = 1
    while len(at := at[at + k < len(order)]) and len(at := at[word[at + k] == word[at]]):
        d = order[at + k] - order[at]
        out += np.bincount(d[d <= most], minlength=most + 1)
        k += 1
    out[0] = len(w)
    return out


def reach(w: np.ndarray, q: int, i: int, most: int, step: int) -> int:
    """How many of the places i, i + step, ... (most at the utmost) have the same word q further on."""
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        low = i + done if step > 0 else i - done - size + 1
        same = (w[low : low + size] == w[low + q : low + q + size])[::step]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = done + size, 4 * size
    return done


def worth_a_scan(w: np.ndarray, q: int, known: list[tuple[int, int, int]]) -> bool:
    """Whether lag q has an island that is none of a known run. An island of 3 q places holds three anchors
    in a row, every q-th place, and all places between them; that is looked for first."""
    if q <= SPARSE:
        return True
    anchors = w[::q]
    same = anchors[:-1] == anchors[1:]
    j = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
    for start, length, p in known:
        if q % p == 0 and len(j):
            j = j[(j < start) | (j + 3 * q >= start + length)]
    for r in range(1, SPARSE):
        if not len(j):
            return False
        j = j[(w[j + r] == w[j + q + r]) & (w[j + q + r] == w[j + 2 * q + r])]
    last = len(w) - q
    return len(j) > SPARSE or any((ahead := reach(w, q, i, last - i, 1)) > 2 * q and ahead + reach(w, q, i - 1, i, -1) >= 3 * q for i in j.tolist())


def runs_of(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by period and then start."""
    n = len(w)
    most = n // times
    if n < least or most < 1:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(least, times * lags) - lags
    counts = lag_counts(w, most)
    counts[0] = 0
    found: dict[tuple[int, int], int] = {}
    known: list[tuple[int, int, int]] = []
    for q in np.flatnonzero(counts >= need).tolist():
        if counts[q] < need[q]:
            continue
        known = [x for x in known if x[1] > 3 * q]
        if not worth_a_scan(w, q, known):
            continue
        gaps = np.concatenate([[-1], np.flatnonzero(w[:-q] != w[q:]), [n - q]])
        islands = np.diff(gaps) - 1
        for i in np.flatnonzero(islands >= need[q]).tolist():
            start, length = int(gaps[i]) + 1, int(islands[i]) + q
            if (start, length) in found:  # a multiple of a smaller period
                continue
            found[start, length] = q
            known.append((start, length, q))
            multiples = np.arange(2 * q, min(most, length - 1) + 1, q)
            counts[multiples] -= length - multiples
    return [(s, length, p) for (s, length), p in found.items()]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: all but those after the first period of a run."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        steps[start + p] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed): runs in order of start and period, collapsed the words that stay."""
    kind = df.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, text):
                counts, runs, left = [], [], []
                for t in texts:
                    words = (t or "").encode().split()
                    ids: dict[bytes, int] = {}
                    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
                    found = sorted(runs_of(w), key=lambda r: (r[0], r[2])) if len(ids) < len(words) else []
                    if found:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                    counts.append(len(w))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    left.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(left, pa.string())], names=[key, "n_words", "runs", "collapsed"])

    schema = f"{key} {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return df.select(key, text).mapInArrow(run, schema)


def rewritten(doc_id: Column, text: Column) -> Column:
    """The text in which the words from a on repeat those from a to a + p, for one document in ten, drawn by its id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        i = F.sequence(F.lit(0).cast("long"), n - 1)
        one = F.transform(i, lambda k: F.get(words, F.when(k < a, k).otherwise(a + (k - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(one, " ")).otherwise(F.lit(""))

    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    # a lambda binds the words, so that they are split once
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", rewritten(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    # of the longest: the first, then the smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    rows = find_runs(docs).withColumn("m", longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("m.col2")).alias("start"),
        F.col("m.length").alias("length"),
        (-F.col("m.col3")).alias("period"),
        F.floor(1000 * F.col("m.length") / -F.col("m.col3")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def crc32_sql(digits: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a string of ASCII characters."""
    bits = "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bits})"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda x: ascii(x)::BIGINT)), {byte}))"


#: The same by definition: pairs of equal words of a text, islands of them by lag, the smallest lag of each stretch.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, {crc32_sql("doc_id::VARCHAR")} AS h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents
), e AS (
  SELECT doc_id, h, w, len(w) AS n, (h // 10) % nullif(len(w), 0) AS a, 3 + (h // 10) % 8 AS k FROM d
), r AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM e
), p AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM r
), m AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), g AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m
), t AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)
), u AS (
  SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY doc_id, start, length
), x AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u
), c AS (
  SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.i) AS left_ FROM p ANTI JOIN x ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY p.doc_id
), f AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS m FROM u GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, m.start AS start, m.length AS length, m.period AS period,
  (1000 * m.length) // m.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_, '')) AS collapsed_sha256
FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
