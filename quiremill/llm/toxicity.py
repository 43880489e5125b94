"""Operator 6: toxicity, scored on text that a noisy-channel decoder has restored.

A character trigram model is counted over the whole corpus. Every word that offers a choice becomes
a lattice: each symbol or digit may stand for itself or for the letters it imitates, a repeated
letter may be an echo, a separator may be nothing or the end of a word. The Viterbi path under the
character model and the channel's costs is the restored word, and nothing but restored words is
scored. Words that offer no choice have one path, which needs no search; what has no letter is none.

Terms (restored words and their beginnings) are weighed by the log ratio of how often they occur in
toxic and in other labelled texts; of toxic ones, texts with the same least word hash count once,
so that copies of one text do not make its words suspect. A second part of the labelled rows fits a
logistic curve on the largest weights of a text, so scores are probabilities on texts that the
terms were not taken from. Labels, lang, source and doc_id are no inputs of a score.

At most SAMPLE labelled rows (of the least id hash) and MOST_TERMS terms are learned from, never held-out ones, whole
texts of any length. Words of any length are restored whole, in time that grows with the length. Null text counts as empty and is scored by the curve at no terms. Without toxic
labels all scores are 0. Rows without doc_id count as held out; repeated rows are scored alike; a
doc_id labelled twice counts as its lower label. An empty table gives an empty one; other columns
stay, except one named like the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import materialise, table
from .quality import held_out, sample, slices

SAMPLE = 20_000
#: Of ten labelled texts, those that give terms; the others fit the curve.
TERM_TENTHS = 7
LEAST_TEXTS = 3
LEAST_WEIGHT = 2.5
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.5
REMEMBERED = 400_000
#: Terms that the model learns from at most, those of the most toxic texts; this bounds the driver, however long the texts are.
MOST_TERMS = 200_000
#: Characters of a token after which its lattice is looked at for what is decided.
SETTLED = 256

# What symbols and digits imitate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
SEPARATORS = ".-_*~'`·"
#: Letters of the character model: these, one for all other letters, and 0 for what is no letter.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
OTHER = len(ALPHABET) + 1
SYMBOLS = OTHER + 1
#: Costs of the channel, as log probabilities: a letter that is meant, a symbol for a letter, an echo, a
#: separator that is nothing, one that ends a word, a symbol that is itself, one more, a word behind it.
KEPT, IMITATED, ECHO, SEPARATED, BROKEN, LITERAL, AGAIN, RESTART = -0.05, -1.2, -1.0, -0.7, -3.0, -5.0, -1.0, -4.0

LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{LETTER}+")
#: Behind or before a letter, what may be something else; a letter twice.
SYMBOL_CLASS = "[" + re.escape("".join(LEET) + SEPARATORS) + "]"
CHOICE = re.compile(rf"({LETTER})\1|{LETTER}{SYMBOL_CLASS}|{SYMBOL_CLASS}{LETTER}")
#: What a word may begin and end with.
BEGINS, ENDS = re.compile(r"[\w@$|+(€£¡!]"), re.compile(r"[\w@$|€£]")
GAP = re.compile(r" (\S) (\S) (\S) ")
GAPPED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")


def _symbol_table() -> np.ndarray:
    out = np.array([OTHER if chr(c).isalpha() else 0 for c in range(0x250)], np.int64)
    for i, c in enumerate(ALPHABET, 1):
        out[ord(c)] = i
    return out


SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """The symbol of each character of lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < len(SYMBOL), SYMBOL[np.minimum(codes, len(SYMBOL) - 1)], OTHER)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts over all texts: an array with one cell for each three symbols, whatever the corpus."""

    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for _, texts in slices(b, text):
                s = symbols(" " + "  ".join(texts) + " ")
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["k", "n"])

    got = docs.select(text).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), interpolated with bigrams and single symbols."""
    three = counts + 0.0
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


def trimmed(word: str) -> str:
    """A word without the symbols around it, each end scanned once."""
    first, end = BEGINS.search(word), len(word)
    if not first:
        return ""
    while end > first.start() and not ENDS.match(word[end - 1]):
        end -= 1
    return word[first.start() : end]


class Restorer:
    """Words of chunks of text, restored."""

    def __init__(self, model: np.ndarray):
        self.model, self.logs = model, model.ravel().tolist()

    @staticmethod
    @cache
    def symbol(c: str) -> int:
        return int(symbols(c)[0])

    def decode(self, token: str) -> str:
        """The best path through the lattice of a token: its letters, with a space where a word ends."""
        # (last two symbols, whether a symbol is between them and what comes) -> (log probability, output so far, last letter)
        paths: dict[tuple[int, int, int], tuple[float, str, str]] = {(0, 0, 0): (0.0, "", "")}
        logs, symbol, done = self.logs, self.symbol, []
        for i, c in enumerate(token.lower() + " "):
            if i % SETTLED == SETTLED - 1:
                # what all paths begin with is decided; without it their outputs stay short, however long the token
                said = commonprefix([p[1] for p in paths.values()])[:-1]
                if said:
                    done.append(said)
                    paths = {k: (cost, out[len(said) :], last) for k, (cost, out, last) in paths.items()}
            new: dict[tuple[int, int, int], tuple[float, str, str]] = {}
            letters = ((c, KEPT, ECHO),) if c.isalpha() else tuple((x, IMITATED, ECHO + IMITATED) for x in LEET.get(c, ""))
            for (a, b, gap), (cost, out, last) in paths.items():
                at = (a * SYMBOLS + b) * SYMBOLS
                offers = []
                for letter, meant, echo in letters:
                    s = symbol(letter)
                    offers.append(((b, s, 0), cost + meant + logs[at + s] + (RESTART if gap and out else 0.0), out + letter, letter))
                    if last == letter:
                        offers.append(((a, b, gap), cost + echo, out, last))
                if c == " ":
                    offers.append(((b, 0, 0), cost + (logs[at] if b else 0.0), out, ""))
                elif not c.isalpha():
                    apart = c in SEPARATORS
                    if apart and b:
                        offers.append(((a, b, gap), cost + SEPARATED, out, last))
                    if b:
                        offers.append(((b, 0, 0 if apart else 1), cost + (BROKEN if apart else LITERAL) + logs[at], out + " ", ""))
                    else:
                        offers.append(((a, 0, gap if apart else 1), cost + (LITERAL if not out and not gap and not apart else AGAIN), out, ""))
                for key, value, text, end in offers:
                    if key not in new or (value, text) > new[key][:2]:
                        new[key] = (value, text, end)
            paths = new
        return ("".join(done) + max(paths.values())[1]).strip()

    def words(self, chunk: str) -> list[str]:
        """The restored words of a chunk."""
        low = chunk.lower()
        if not CHOICE.search(low):
            return WORD.findall(low)
        return [w for part in low.split() for w in (self.decode(trimmed(part)).split() if CHOICE.search(part) else WORD.findall(part))]

    def text(self, text: str) -> str:
        """The whole text with its odd words restored, for reading."""
        text = GAPPED.sub(lambda m: m[0].replace(" ", "."), text)
        return re.sub(r"\S+", lambda m: self.decode(trimmed(m[0])) if CHOICE.search(m[0].lower()) else m[0], text)


def chunks(text: str) -> set[str]:
    """The different pieces between spaces, and runs of single characters as one piece each."""
    out = set(text.split(" "))
    if GAP.search(f" {text} "):
        out.update(m[0].replace(" ", ".") for m in GAPPED.finditer(text))
    return out


def beginnings(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def terms(restorer: Restorer, text: str) -> tuple[set[str], int]:
    """All terms of a text, and its least word hash, which copies of a text mostly share."""
    words = {w for c in chunks(text) for w in restorer.words(c)}
    return {t for w in words for t in beginnings(w)}, min((zlib.crc32(w.encode()) for w in words), default=0)


class Model:
    def __init__(self, chars: np.ndarray, weights: dict[str, float], curve: np.ndarray | None):
        self.restorer, self.weights, self.curve = Restorer(chars), weights, curve
        self.seen: dict[str, tuple[tuple[str, float], ...]] = {}

    def hits(self, text: str) -> dict[str, float]:
        """The words of a text that have weight."""
        own, out = chunks(text), {}
        fresh = [c for c in own if c not in self.seen]
        get = self.weights.get
        for c in fresh:
            found = []
            for w in self.restorer.words(c):
                if (weight := max(get(t, 0.0) for t in beginnings(w))) > 0:
                    found.append((w, weight))
            self.seen[c] = tuple(found)
        for c in own:
            if found := self.seen[c]:
                out.update(found)
        if len(self.seen) > REMEMBERED:
            for c in fresh:
                del self.seen[c]
        return out

    def inputs(self, text: str) -> tuple[float, float, float, float]:
        best = sorted(self.hits(text).values(), reverse=True)
        return (1.0, best[0] if best else 0.0, best[1] if len(best) > 1 else 0.0, float(np.log1p(sum(b > 5 for b in best))))

    def score(self, text: str) -> float:
        if self.curve is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve, self.inputs(text)), -30, 30))))

    def __getstate__(self):
        return {"chars": self.restorer.model, "weights": self.weights, "curve": self.curve}

    def __setstate__(self, s):
        self.__init__(s["chars"], s["weights"], s["curve"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights by Newton steps; all but the first are drawn to zero and kept from below zero."""
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * w
        new = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)), grad)
        new[1:] = np.maximum(0, new[1:])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    chars = log_model(trigram_counts(docs, text))
    known = sample(docs, labels, label, rows, key, text)
    known = materialise(known.select(text, "y", (F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(10)) < TERM_TENTHS).alias("gives")), "labelled")

    @bpe.lean
    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars)
        for b in batches:
            got = [terms(restorer, t.as_py() or "") for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([pa.array([g[1] for g in got], pa.int64()), pa.array([sorted(g[0]) for g in got], pa.list_(pa.string()))], ["sig", "terms"])

    giving = known.where("gives")
    bad = giving.where("y = 1").select(text).mapInArrow(toxic, "sig long, terms array<string>")
    bad = bad.select("sig", F.explode("terms").alias("t")).groupBy("t").agg(F.countDistinct("sig").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    bad = bad.orderBy(F.desc("n"), "t").limit(MOST_TERMS)
    bad = {r["t"]: r["n"] for r in bad.toLocalIterator()}  # of a sample of bounded size
    n_bad = giving.where("y = 1").count()

    @bpe.lean
    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, count = Restorer(chars), Counter()
        for b in batches:
            for t in b.column(text):
                count.update(x for x in terms(restorer, t.as_py() or "")[0] if x in bad)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["t", "n"])

    good = giving.where("y <> 1").select(text)
    n_good = good.count()
    also = {r["t"]: r["n"] for r in good.mapInArrow(others, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).toLocalIterator()}
    weights = {t: float(np.log((n + 0.5) / (n_bad + 1)) - np.log((also.get(t, 0) + 0.5) / (n_good + 1))) for t, n in bad.items()}
    model = Model(chars, {t: w for t, w in weights.items() if w >= LEAST_WEIGHT}, None)

    @bpe.lean
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int64()), pa.array([list(model.inputs(t.as_py() or "")) for t in b.column(text)], pa.list_(pa.float64()))], ["y", "x"])

    rest = known.where("not gives").mapInArrow(inputs, "y long, x array<double>").toArrow()
    y = np.array(rest.column("y").to_pylist(), float)
    if n_bad and len(y) and 0 < y.sum() < len(y):
        model.curve = logistic(np.array(rest.column("x").to_pylist()), y)
    elif n_bad:  # too few rows to fit a curve: even odds at three times the least weight
        model.curve = np.array([-3 * LEAST_WEIGHT, 1.0, 0.0, 0.0])
    return model


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """docs with the score; a column of docs of that name gives way."""
    kept = [c for c in docs.columns if c != out]

    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([model.score(t) for t in texts], pa.float64())], [*kept, out])

    return docs.select(*kept).mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` double"]))


def op6_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
