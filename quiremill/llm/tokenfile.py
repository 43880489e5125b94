"""Operator 10: token files with Elias-Fano encoded document boundaries.

A shard holds the ids of a run of documents in key order, one after the other, and two Elias-Fano
codes: of the documents' ends, and of their keys, which ascend. The low bits of each number are in a
packed array, the high bits in unary, and the place of every SAMPLE-th one is kept, so that
select(i) reads a few bytes and run(i, n) the bits of those n numbers only; no table of 64-bit
offsets or keys is stored or built. A code takes about 2 + log2(bound / documents) bits a document.
Shards are rows of a Parquet table, as a store may be one that only Spark reads; export() writes
them as files of their own.

Layout, little endian: b"QMTF", version u32, documents u64, tokens u64, nulls u64 (leading documents
whose key is null), the first key that isn't i64, how far the last is beyond it u64, width of an id
u8, low bits of ends and of keys u8 each, 5 bytes 0; for ends and for keys: samples u64 each, low
bits, high bits; ids. Bit arrays and ids start at multiples of 8.

Null text counts as empty: the end id alone. Null keys come first, equal keys are ordered by text,
repeated rows are documents of their own; texts of any length are whole. No documents, no shards.
Columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoded, json_encoder
from .common import exclusive_prefix, materialise, table

END = 1
SAMPLE = 256
#: Tokens after which a shard is closed; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 20
HEAD = struct.Struct("<4sIQQQqQBBB5x")


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to a bound below 2**64."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (bound // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (bound >> low_bits) + 1, np.uint8)
        bits[ones] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    @staticmethod
    def sizes(n: int, bound: int, low_bits: int) -> tuple[int, int, int]:
        """Bytes of samples, low bits and high bits."""
        return -(-n // SAMPLE) * 8, -(-n * low_bits // 8), -(-(n + (bound >> low_bits) + 1) // 8)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        place, want = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        first = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := first.bit_count()) <= want:
            want, byte = want - ones, byte + 1
            first = int(self.high[byte])
        for _ in range(want):
            first &= first - 1
        one = byte * 8 + (first & -first).bit_length() - 1
        at = i * self.low_bits
        raw = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (one - i << self.low_bits) + (raw >> (at & 7) & (1 << self.low_bits) - 1)

    def run(self, i: int, n: int) -> np.ndarray:
        """The numbers from the i-th on, n of them: from the sample before them to the one behind them."""
        first, behind = i // SAMPLE, -(-(i + n) // SAMPLE)
        place = int(self.samples[first])
        end = int(self.samples[behind]) if behind < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[place >> 3 : (end + 7) >> 3], bitorder="little")[place & 7 :]
        ones = np.flatnonzero(bits)[i - first * SAMPLE :][:n] + (place - i) - np.arange(n)
        at, width = i * self.low_bits, self.low_bits
        raw = np.unpackbits(self.low[at >> 3 : (at + n * width + 7) >> 3], bitorder="little")[at & 7 :][: n * width]
        low = raw.reshape(n, width) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
        return (ones.astype(np.uint64) << np.uint64(width)) + low.astype(np.uint64)

    def bytes(self) -> list[bytes]:
        return [self.samples.astype("<u8").tobytes(), _pad(self.low.tobytes()), _pad(self.high.tobytes())]


def pack_shard(keys: list[int | None], ids: list[bytes], width: int = 2) -> bytes:
    """ids: of each document, width bytes each. keys: in ascending order, null ones first."""
    ends = np.cumsum([len(x) // width for x in ids])
    tokens, nulls = int(ends[-1]) if len(ids) else 0, sum(k is None for k in keys)
    own = keys[nulls:]
    first, span = (own[0], own[-1] - own[0]) if own else (0, 0)
    codes = EliasFano.encode(ends, tokens), EliasFano.encode(np.array([k - first for k in own], np.uint64), span)
    head = HEAD.pack(b"QMTF", 2, len(ids), tokens, nulls, first, span, width, *(c.low_bits for c in codes))
    return b"".join([head, *codes[0].bytes(), *codes[1].bytes(), *ids])


class Shard:
    """A view of a shard's bytes; nothing is copied."""

    def __init__(self, raw):
        magic, version, self.n, self.tokens, self.nulls, self.first, span, width, *low_bits = HEAD.unpack_from(raw)
        if magic != b"QMTF" or version != 2:
            raise ValueError("not a token file")
        at = HEAD.size

        def part(size: int, kind) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at)
            at += size + -size % 8
            return got

        def code(n: int, bound: int, bits: int) -> EliasFano:
            samples, low, high = EliasFano.sizes(n, bound, bits)
            places, lows, highs = part(samples, "<u8"), part(low, np.uint8), part(high, np.uint8)
            return EliasFano(n, bits, lows, highs, places)

        self.ends, self.keys = code(self.n, self.tokens, low_bits[0]), code(self.n - self.nulls, span, low_bits[1])
        self.ids = part(self.tokens * width, f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.keys.select(i - self.nulls)

    def run(self, i: int, n: int) -> tuple[pa.Array, np.ndarray]:
        """Keys of n documents from the i-th on, and n + 1 offsets: each one's start and the last one's end."""
        start = self.ends.select(i - 1) if i else 0
        ends = self.ends.run(i, n).astype(np.int64)
        blank = max(0, min(n, self.nulls - i))
        keys = np.zeros(n, np.int64)
        if blank < n:  # unsigned sums wrap around to what the signed key is
            keys[blank:] = (self.keys.run(i + blank - self.nulls, n - blank) + np.int64(self.first).view(np.uint64)).view(np.int64)
        return pa.array(keys, mask=np.arange(n) < blank), np.concatenate([[start], ends])


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shards of docs in ascending key order, written to the shared folder and read back:
    (shard_no, documents, tokens, data). shard_no ascends with the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail, no = json_encoder(path), np.array([end], "<u2").tobytes(), TaskContext.get().partitionId() << 32
        keys, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([no]), pa.array([len(ids)]), pa.array([size]), pa.array([pack_shard(keys, ids)], pa.binary())], ["shard_no", "documents", "tokens", "data"])

        for own, got in encoded(batches, encoder):
            for k, x in zip(own.to_pylist(), got, strict=True):
                n = len(x) // 2 + 1
                if ids and size + n > shard_tokens:
                    yield shard()
                    keys, ids, size, no = [], [], 0, no + 1
                keys.append(k)
                ids.append(x + tail)
                size += n
        if ids:
            yield shard()

    rows = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(F.asc_nulls_first(key)).sortWithinPartitions(F.asc_nulls_first(key), text)
    return materialise(rows.mapInArrow(run, "shard_no long, documents long, tokens long, data binary"), "tokenfile")


def documents(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, read back from the shards: offsets by the
    select structures, SAMPLE documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(raw.as_buffer())
                for i in range(0, s.n, SAMPLE):
                    own, at = s.run(i, min(SAMPLE, s.n - i))
                    crc = [zlib.crc32(s.ids[a:z].astype("<u4").tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), no)), own, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["shard_no", key, "start", "n_tokens", "ids_crc32"])

    rows = shards.select("shard_no", "data").mapInArrow(run, f"shard_no long, {key} long, start long, n_tokens long, ids_crc32 long")
    base = exclusive_prefix(shards.select("shard_no", "tokens"), "shard_no", "tokens", "base")
    return rows.join(base, "shard_no").select(key, (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def export(shards: DataFrame, folder: str) -> int:
    """Write each shard as a file of its own below a folder that the executors can write to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for no, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = f"{folder}/{no:016x}.qmtf"
                with open(name + ".part", "wb") as f:
                    f.write(raw.as_buffer())
                os.replace(name + ".part", name)  # a task that is run again leaves the same file
            yield pa.RecordBatch.from_arrays([b.column(0)], ["shard_no"])

    return shards.select("shard_no", "data").mapInArrow(run, "shard_no long").count()


def op10_elias_fano_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards that are read back are rows of a Parquet table, as the store may be one that only Spark reads; export() makes files of them."""
    return documents(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
