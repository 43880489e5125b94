"""Operator 2: quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole text becomes a vector:
how often each pair of character classes occurs, and how much its words repeat among themselves,
side by side and from before. An encoder maps it to a hidden vector; gated attention, learned from
document labels alone, gives each passage a weight; the score is read off the weighted sum.

The model is fitted on at most SAMPLE labelled rows, never held-out ones, in the order of their id
hash, as far as they have SAMPLE_PASSAGES passages in all (a row that no longer fits is left out),
which bounds what reaches the driver: passages of SIZE half-precision numbers. Labels, lang, source
and doc_id are no inputs. Null and empty texts have one passage of zeros. Without labelled rows
every score is 0.5. Rows without doc_id count as held out; repeated rows are scored alike. A doc_id
labelled twice counts as its lower label, one with several texts as the least. Texts of any length are scored whole, in parts of bounded
size. An empty table gives an empty one; other columns stay, except those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import materialise, table

PASSAGE = 64
SAMPLE = 6000
SAMPLE_PASSAGES = 64_000
HIDDEN, GATE, EPOCHS, BAGS = 32, 16, 25, 64
THRESHOLD = 0.3
AT_ONCE = 1 << 20

#: Class of each byte: control, space, lower, upper, digit, and so on; 12 for those beyond ASCII.
CLASS = np.full(256, 12, np.int64)
CLASS[:33] = 0
for _k, _chars in enumerate((" ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?;:", "|", "#$%&*@^~+=<>\\/_{}[]`", "'\"()-"), 1):
    for _c in _chars:
        CLASS[ord(_c)] = _k
CLASS[127] = 0
KINDS = 13
EXTRA = 6
SIZE = KINDS * KINDS + EXTRA


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. Rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passages, SIZE) and how many passages each text has, at least one."""
    raw, extra, counts = [], [], []
    for text in texts:
        words = text.split()
        n = max(1, -(-len(words) // PASSAGE))
        counts.append(n)
        seen: set[str] = set()
        for i in range(n):
            part = words[i * PASSAGE : (i + 1) * PASSAGE]
            own = set(part)
            raw.append(" ".join(part).encode())
            size = len(part) or 1
            extra.append((len(own) / size, sum(map(eq, part, part[1:])) / size, len(own & seen) / (len(own) or 1), len(raw[-1]) / size / 10, len(part) / PASSAGE, min(n, 8) / 8))
            seen |= own
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    at = np.repeat(np.arange(len(raw)), sizes)
    same = at[1:] == at[:-1]
    code = (at[:-1] * KINDS + kinds[:-1]) * KINDS + kinds[1:]
    pairs = np.bincount(code[same], minlength=len(raw) * KINDS * KINDS).reshape(len(raw), -1)
    share = np.sqrt(pairs / np.maximum(1, sizes - 1)[:, None])  # roots even out rare and common pairs
    return np.concatenate([share, np.array(extra)], 1).astype(np.float32), np.array(counts)


class Model:
    """Encoder, gated attention and output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        made = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32)
        self.p = {"w1": made(SIZE, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "v": made(HIDDEN, GATE), "u": made(HIDDEN, GATE), "a": made(GATE, 1)[:, 0], "c": made(HIDDEN, 1)[:, 0], "c0": np.zeros(1, np.float32)}
        self.fitted = False

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, starts = self.p, np.cumsum(counts) - counts
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        w = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(w[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "w": w, "z": z, "s": 1 / (1 + np.exp(-(z @ p["c"] + p["c0"]))), "starts": starts}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text, and the weight of each passage. In double precision and rounded, as single
        precision rounds a text's products by what else is in its batch."""
        if not self.fitted:
            return np.full(len(counts), 0.5), np.repeat(1 / counts, counts)
        f = self._forward(x.astype(np.float64), counts)
        return np.round(f["s"], 9), f["w"]

    def fit(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 11) -> Model:
        if not len(counts):
            return self
        self.mean, self.scale, self.fitted = x.mean(0), np.maximum(x.std(0), 1e-3), True
        p, r, starts = self.p, np.random.default_rng(seed), np.cumsum(counts) - counts
        first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(counts))
            for i in range(0, len(order), BAGS):
                bags = order[i : i + BAGS]
                n = counts[bags]
                rows = np.repeat(starts[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for k, grad in self._gradient(x[rows], n, labels[bags]).items():
                    grad = grad + 1e-4 * p[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    rate = 3e-3 * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1))
                    p[k] = (p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                step += 1
        return self

    def _gradient(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.p, self._forward(x, counts)
        d = (f["s"] - labels) / len(counts)
        dz = np.repeat(d[:, None] * p["c"], counts, 0)
        dw = (dz * f["h"]).sum(1)
        de = f["w"] * (dw - np.repeat(np.add.reduceat(f["w"] * dw, f["starts"]), counts))
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["w"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w1": f["x"].T @ dh, "b1": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of the documents of at most so many labelled ids that aren't held out; null text as empty."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(label).alias("y"))
    known = known.orderBy(F.xxhash64(key), key).limit(rows).select(F.col(key).alias("__k"), "y")  # a bound, so it may be broadcast
    got = docs.select(key, F.coalesce(text, F.lit("")).alias(text))
    return got.join(F.broadcast(known), F.col(key) == F.col("__k")).groupBy(key, "y").agg(F.min(text).alias(text)).select(key, text, "y")


def passages(text: Column) -> Column:
    """How many passages vectors() makes of a text, at most."""
    return F.greatest(F.lit(1), F.ceil(F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")) / PASSAGE))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, key: str = "doc_id", text: str = "text", most: int = SAMPLE_PASSAGES) -> Model:
    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                x, counts = vectors(part.column(text).to_pylist())
                ends = np.cumsum(counts)
                raw = [x[a:z].astype(np.float16).tobytes() for a, z in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y").cast(pa.int64()), pa.array(raw, pa.binary())], ["h", "y", "x"])

    known = sample(docs, labels, label, rows, key, text).select(F.xxhash64(key).alias("h"), text, "y", passages(F.col(text)).alias("n"))
    known = materialise(known, "labelled")
    # of a bounded number of rows: which of them fit
    sizes = known.groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").collect()
    chosen, used = [], 0
    for r in sizes:
        if used + r["n"] <= most:
            chosen.append((r["h"],))
            used += r["n"]
    if not chosen:
        return Model()
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long"))
    got = known.join(few, "h", "left_semi").mapInArrow(run, "h long, y long, x binary").toArrow()
    got = got.sort_by([("h", "ascending"), ("y", "ascending")])  # so that a fit doesn't depend on the order of tasks
    counts = np.array([len(x.as_buffer()) // 2 // SIZE for x in got.column("x")])
    x, at = np.empty((counts.sum(), SIZE), np.float32), 0
    for raw, n in zip(got.column("x"), counts.tolist(), strict=True):
        x[at : at + n] = np.frombuffer(raw.as_buffer(), np.float16).reshape(n, SIZE)
        at += n
    return Model().fit(x, counts, got.column("y").to_numpy().astype(np.float32))


def slices(batch: pa.RecordBatch, text: str, at_once: int = AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of bounded size, unless one text alone is larger."""
    texts, at, some, size = batch.column(text), 0, [], 0
    for i in range(len(batch)):
        some.append(texts[i].as_py() or "")
        size += len(some[-1])
        if size >= at_once or i + 1 == len(batch):
            yield batch.slice(at, len(some)), some
            at, some, size = i + 1, [], 0


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """docs with the score and, next to it, passages (their number) and focus (the one of most weight).
    Columns of docs that have these names give way."""
    new = {out: pa.float64(), f"{out}_passages": pa.int64(), f"{out}_focus": pa.int64()}
    kept = [c for c in docs.columns if c not in new]

    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, text):
                x, counts = vectors(texts)
                s, w = model.scores(x, counts)
                ends = np.cumsum(counts)
                focus = [int(np.argmax(w[a:z])) for a, z in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(s), pa.array(counts), pa.array(focus, pa.int64())], [*kept, *new])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` double, `{out}_passages` long, `{out}_focus` long"])
    return docs.select(*kept).mapInArrow(run, schema)


def op2_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    got = score(docs, model)
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("score_passages").alias("passages"), F.col("score_focus").alias("focus"))
