"""Operator 9: packing of token sequences by non-negative least squares over length combinations.

Each document is cut into full windows and a remainder. The histogram of remainders has fewer bins
than a window has tokens, however many documents there are; that histogram is all that the driver
sees. Shallow combinations of lengths that fill a window exactly are its columns; the repeat counts
solve min |Ax - h|, x >= 0, by accelerated projected gradients, and are rounded so that no length
is used more often than it occurs. Remainders are numbered within their length without a single
task, and the number tells the window and the place. What the combinations leave over is laid end
to end in one greedy pass and cut at the windows' ends, so that only the very last window is padded.

Null text counts as empty: its document is the end id alone. Texts of any length are encoded whole and fill as many
windows as they need; equal remainders are placed in order of their rows. Repeated rows are documents of their
own. No documents, no pieces. Other columns than the key and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoded, forget, json_encoder, lean, release
from .common import exclusive_prefix, gapless_rank, materialise, table

WINDOW = 2048
END = 1
#: Of so many of the commonest lengths all pairs are tried as part of a triple.
COMMON = 96
STEPS = 1500


def combinations(hist: np.ndarray, window: int, common: int = COMMON) -> list[tuple[int, ...]]:
    """Lengths that together fill a window: all pairs; triples of two common lengths and what they
    lack; two lengths twice each; one length four times. Only of lengths that occur (hist[l] > 0)."""
    has = np.flatnonzero(hist > 0)
    there = set(has.tolist()) - {0}
    out = {(a, window - a) for a in there if a <= window - a and window - a in there}
    top = [int(x) for x in has[np.argsort(-hist[has], kind="stable")] if x][:common]
    for i, a in enumerate(top):
        for b in top[i:]:
            if window - a - b in there:
                out.add(tuple(sorted((a, b, window - a - b))))
    if window % 2 == 0:
        out |= {(a, a, window // 2 - a, window // 2 - a) for a in there if a <= window // 2 - a and window // 2 - a in there}
    return sorted(out)


def solve(hist: np.ndarray, combos: list[tuple[int, ...]], steps: int = STEPS) -> np.ndarray:
    """Repeat counts: least squares against the histogram, none below zero."""
    if not combos:
        return np.zeros(0)
    wide = max(map(len, combos))
    idx = np.array([c + (0,) * (wide - len(c)) for c in combos])
    use = (idx > 0).astype(float)
    h = hist.astype(float) / max(1, hist.max())
    # the largest eigenvalue of AtA is at most its largest row sum
    row = np.bincount(idx.ravel(), (use * use.sum(1, keepdims=True)).ravel(), len(hist))
    row[0] = 0
    step = 1 / max(1.0, float((row[idx] * use).max()))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        over = np.bincount(idx.ravel(), (use * y[:, None]).ravel(), len(hist)) - h
        over[0] = 0
        new = np.maximum(0, y - step * (over[idx] * use).sum(1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * max(1, hist.max())


def whole_counts(hist: np.ndarray, combos: list[tuple[int, ...]], x: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts near x, the largest first, that use no length more often than it occurs."""
    left, out = hist.copy(), []
    for k in np.argsort(-x, kind="stable").tolist():
        c = combos[k]
        n = min([int(np.ceil(x[k])), *(int(left[a]) // c.count(a) for a in set(c))])
        if n > 0:
            out.append((c, n))
            for a in c:
                left[a] -= n
    return out


class Places:
    """Where the r-th remainder of a length goes: window and offset, or -1 if it is left over."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]], window: int):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for c, n in chosen:
            for j, a in enumerate(c):
                slots.setdefault(a, []).append((n, base, sum(c[:j])))
            base += n
        self.windows = base
        self.at = {a: (np.cumsum([0] + [n for n, _, _ in s]), np.array([b for _, b, _ in s]), np.array([o for _, _, o in s])) for a, s in slots.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        for a in np.unique(length).tolist():
            if a in self.at:
                ends, base, offset = self.at[a]
                rows = np.flatnonzero((length == a) & (rank < ends[-1]))
                k = np.searchsorted(ends, rank[rows], "right") - 1
                seq[rows], off[rows] = base[k] + rank[rows] - ends[k], offset[k]
        return seq, off


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(uid, key, tokens, ids): written once to the shared folder; ids two bytes each, with the end id."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = json_encoder(path), np.array([end], "<u2").tobytes()
        keyed = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], ["uid", "key"]), b.column(2)], ["k", "t"]) for b in batches)
        for keys, ids in encoded(keyed, encoder):
            ids = [x + tail for x in ids]
            uid, own = keys.flatten()
            yield pa.RecordBatch.from_arrays([uid, own, pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["uid", key, "tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), key, text)
    return materialise(rows.mapInArrow(run, f"uid long, {key} {kind}, tokens long, ids binary"), "tokens")


def plan(meta: DataFrame, window: int = WINDOW) -> DataFrame:
    """meta (uid, tokens) with full (the window of the first full piece) and, for the remainder,
    seq, off, and cut: how much of it goes there (the rest opens window seq + 1)."""
    meta = meta.withColumn("fulls", F.expr(f"tokens div {window}")).withColumn("rest", F.expr(f"tokens % {window}"))
    hist = np.zeros(window, np.int64)
    n_full = 0
    for r in meta.groupBy("rest").agg(F.count("*").alias("n"), F.sum("fulls").alias("f")).collect():  # at most one row a length
        hist[r["rest"]], n_full = r["n"], n_full + r["f"]
    hist[0] = 0
    combos = combinations(hist, window)
    places = Places(whole_counts(hist, combos, solve(hist, combos)), window)

    @F.pandas_udf("seq long, off long")
    def place(rest: pd.Series, rank: pd.Series) -> pd.DataFrame:
        forget()  # tokens are counted by now
        release()
        seq, off = places.find(rest.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"seq": seq, "off": off})

    ranked = gapless_rank(meta.where("rest > 0").select("uid", "rest"), ["rest"], "uid", "rank")
    ranked = materialise(ranked.withColumn("p", place("rest", "rank")).select("uid", "rest", "p.seq", "p.off"), "places")
    kept = ranked.where("seq >= 0").withColumn("cut", F.col("rest"))
    left = ranked.where("seq < 0").select("uid", "rest")
    at = exclusive_prefix(left, "uid", "rest", "at")
    laid = left.join(at, "uid").select(
        "uid", "rest",
        (F.expr(f"at div {window}") + places.windows).alias("seq"),
        F.expr(f"at % {window}").alias("off"),
        F.least("rest", F.lit(window) - F.expr(f"at % {window}")).alias("cut"),
    )
    used = np.array([n * hist_l for n, hist_l in zip(hist, range(window), strict=True)]).sum() - places.windows * window
    first_full = places.windows + -(-int(used) // window)
    fulls = exclusive_prefix(meta.where("fulls > 0").select("uid", "fulls"), "uid", "fulls", "before")
    fulls = fulls.select(F.col("uid"), (F.col("before") + first_full).alias("full"))
    rests = kept.unionByName(laid).drop("rest")
    return fulls.join(rests, "uid", "full")


def pack(docs: DataFrame, path: str, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids
    (array<int>) if asked for. Sequences are 0, 1, 2, ... without a gap."""
    held = tokenised(docs, path, key, text)
    rows = held.join(plan(held.select("uid", "tokens"), window), "uid").select(key, "tokens", "full", "seq", "off", "cut", "ids")
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0)
            source, out, lists = [], [], []
            for i, (n, full, seq, off, cut, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("tokens", "full", "seq", "off", "cut", "ids")), strict=True)):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                parts = [(k * window, window, full + k, 0) for k in range(n // window)]
                if rest := n % window:
                    parts.append((n - rest, cut, seq, off))
                    if cut < rest:
                        parts.append((n - rest + cut, rest - cut, seq + 1, 0))
                for start, length, s, o in parts:
                    piece = ids[start : start + length]
                    source.append(i)
                    out.append((start, length, zlib.crc32(piece.tobytes()), n, s, o))
                    if with_ids:
                        lists.append(piece.astype(np.int32))
            if source:
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([own.take(pa.array(source)), *cols, *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])], names)

    return rows.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of each window in order; no more than a window to a row."""
    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return got.select("sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"))


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
