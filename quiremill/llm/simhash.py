"""Operator 4: SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two fingerprints link if at most 4 bits differ. The bits are cut into
three segments, fewer than the five that exact matching needs: if each of the first two differed
in two bits or more and the third in one, five would differ. So linked fingerprints agree in the
third segment, or in one of the first two but for a single bit. Each fingerprint is indexed under
its third segment and under the one-wildcard variants of the other two (45 keys); an equality join
on the keys finds every link, the join itself verifies the distance and lets a pair pass at one of
its common keys only, so no pair appears twice. Equal fingerprints are one node from the start, so
groups of copies, however large, are never expanded.

Null text counts as empty. Texts without words have fingerprint zero and link like any other. Texts of any length are
read whole, an empty table gives an empty one.
Repeated rows keep their doc_id once each; the component is named by the least doc_id.

similar() serves deduplication: it links every two texts that have 0.8 of their five-word shingles in
common, however one was made from the other. Three rounds make the candidates; sizes and parity
sketches rule some out without losing one, and the exact similarity decides on each that is left.
First the index above, on fingerprints of the five-word shingles: each text with the least one of
the group that its fingerprint links to. As texts that were cut off or added to differ in more bits,
prefixes find the rest exactly: in one order of all shingles, two such texts have a shingle in common
among the first n - 0.8 n + 1 of each. Shingles that are common in a sample come last in that order,
so that a line of many texts makes few candidates. The second round takes each shared shingle's texts
with the one in which it comes first, the third all pairs that are not yet in one component, as far
as the number of shingles that their prefixes share allows it.

What is compared is a document: a key with a text. A second text under a key is a document of its own. dedupe() keeps
the row that was compared, whole, whatever its other columns are called and of whatever type. Empty tables
give empty ones; texts of any length are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import components, materialise, table

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: First bit, width and wildcards (0 or 1) of each segment.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
#: Shingles whose bits are summed at a time.
AT_ONCE = 1 << 16

#: For each byte, its eight bits spread over the eight bytes of a word, so that additions of up to 255 words count them apart.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def majority(raw: bytes) -> int:
    """Bit set: set in more than half of the eight-byte hashes."""
    spread, total = SPREAD[np.frombuffer(raw, np.uint8).reshape(-1, 8)], np.zeros(64, np.int64)
    for k in range(0, len(spread), 255):
        total += spread[k : k + 255].sum(0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(total * 2 > len(spread)).tobytes(), "big")


def jaccard(a: str, b: str, size: int = 5) -> float:
    """Exact similarity of the sets of runs of so many words; a shorter text is one run."""
    one, two = _runs(a, size), _runs(b, size)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (len(one) + len(two) - both) if len(one) or len(two) else 1.0


@lru_cache(64)
def _runs(text: str, size: int) -> np.ndarray:
    """Distinct, eight bytes each."""
    words = text.encode().lower().split()
    count = max(1, len(words) - size + 1) if words else 0
    return np.unique(np.fromiter((hash(tuple(words[i : i + size])) for i in range(count)), np.int64, count))


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit set: set in more than half of the shingles' hashes."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    total, shingles = np.zeros(64, np.int64), max(1, n - size + 1)
    if n < size:
        raw = [digest(line, seed)]
        total += np.unpackbits(np.frombuffer(raw[0], np.uint8))
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
        starts = [0, *(e + 1 for e in ends[: n - size])]
        ends = ends[size - 1 :]
        for i in range(0, shingles, AT_ONCE):
            raw = b"".join([digest(line[a:z], seed) for a, z in zip(starts[i : i + AT_ONCE], ends[i : i + AT_ONCE], strict=True)])
            spread = SPREAD[np.frombuffer(raw, np.uint8).reshape(-1, 8)]
            for k in range(0, len(spread), 255):
                total += spread[k : k + 255].sum(0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(total * 2 > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", of: Callable[[str], int] = fingerprint) -> DataFrame:
    """(key, fp): fp as a signed long, written once to the shared folder."""
    kind = docs.schema[key].dataType.simpleString()

    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [of(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], [key, "fp"])

    return materialise(docs.select(key, text).mapInArrow(run, f"{key} {kind}, fp long"), "fingerprints")


def _part(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)


def variants(fp: Column, segments: Sequence[tuple[int, int, int]] = SEGMENTS) -> Column:
    """The keys of a fingerprint: number of the variant above 32 bits, the segment without the wildcard bit below."""
    out = []
    for at, width, wild in segments:
        whole = _part(fp, at, width)
        for bit in range(width) if wild else [None]:
            kept = whole if bit is None else whole.bitwiseAND(~(1 << bit) & (1 << width) - 1)
            out.append(kept.bitwiseOR(F.lit(len(out) << 32)))
    return F.array(*out)


def first_common(differ: Column, segments: Sequence[tuple[int, int, int]] = SEGMENTS) -> Column:
    """The number of the variant at which a pair with these differing bits passes; null at none."""
    number, out = 0, None
    for at, width, wild in segments:
        x = _part(differ, at, width)
        # without a difference the first wildcard, with one the wildcard of that bit
        test = (x.bitwiseAND(x - 1) == 0) if wild else x == 0
        own = F.when(x == 0, F.lit(number)).otherwise(F.lit(number) + F.bit_count(x - 1)) if wild else F.lit(number)
        out = F.when(test, own) if out is None else out.when(test, own)
        number += width if wild else 1
    return out


def links(nodes: DataFrame, node: str = "rep", fp: str = "fp", distance: int = DISTANCE, segments: Sequence[tuple[int, int, int]] = SEGMENTS) -> DataFrame:
    """(a, b) of nodes whose fingerprints differ in at most distance bits, each pair once.

    Spark takes the keyed rows for as few as the nodes, and would send what fits its limit then, 45 times that, through the driver: hence the hint."""
    found = sum(1 + wild for _, _, wild in segments) - 1
    if distance > found:
        raise ValueError(f"these segments find links of up to {found} bits")
    keyed = nodes.select(F.col(node).alias("n"), F.col(fp).alias("f"), F.explode(variants(F.col(fp), segments)).alias("v"))
    a, b = keyed.alias("a"), keyed.hint("merge").alias("b")
    differ = F.col("a.f").bitwiseXOR(F.col("b.f"))
    order = (F.col("a.f") < F.col("b.f")) | (F.col("a.f") == F.col("b.f")) & (F.col("a.n") < F.col("b.n"))
    hit = (F.col("a.v") == F.col("b.v")) & order & (F.bit_count(differ) <= distance)
    hit = hit & (F.shiftright("a.v", 32) == first_common(differ, segments))
    return a.join(b, hit).select(F.col("a.n").alias("a"), F.col("b.n").alias("b"))


#: Up to so many ids a set is sent to all tasks; beyond, texts are shuffled to it.
MOST_SENT = 1_000_000


def verified(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """pairs (a, b), of which the texts (node, u, text) have at least that Jaccard similarity."""
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).distinct()
    ids = F.broadcast(ids) if pairs.count() * 2 <= MOST_SENT else ids
    some = texts.join(ids, F.col("node") == F.col("n"), "left_semi")
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            good = [jaccard(s.as_py(), t.as_py(), size) >= least for s, t in zip(x.column("ta"), x.column("tb"), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        _runs.cache_clear()

    return both.select("a", "b", "ta", "tb").mapInArrow(run, pairs.schema)


#: Longs of a text's sketch; about so many texts, chosen by hash, show which shingles are common.
SKETCH, SAMPLE = 8, 4096
#: A shingle in so many texts of the sample is common; at most so many are remembered.
COMMON, MOST_COMMON = 5, 200_000


def _shingles(text: str, size: int) -> np.ndarray:
    """The distinct hashes, as signed longs, in ascending order; those of jaccard()'s runs."""
    words = text.encode().lower().split()
    raw = b"".join([xxhash.xxh64_digest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))]) if words else b""
    return np.unique(np.frombuffer(raw, ">i8").astype(np.int64))


def prefix(shingles: np.ndarray, least: float, common: np.ndarray) -> tuple[np.ndarray, bool]:
    """(first, late). first: the first shingles in an order that all texts share: rare ones before common ones, then by hash. Two
    texts of that similarity have one of these in common: of n shingles they share least * n or more. late: whether the last of these is common."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64), False  # texts without words are equal
    late = np.isin(shingles, common)
    size = n - max(1, math.ceil(least * n - 1e-9)) + 1
    return np.concatenate([shingles[~late], shingles[late]])[:size], size > n - int(late.sum())


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles dealt over the bits: two sketches differ in no more bits than the sets in shingles."""
    bits = np.bincount(shingles.view(np.uint64) % np.uint64(64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Of texts (u, text): shingles in many texts of a bounded sample. Any answer keeps the links whole; a good one keeps candidates few."""
    few = texts.where(F.pmod("u", F.lit(max(1, texts.count() // SAMPLE))) == 0)

    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_shingles(t.as_py(), size) for t in b.column("text")]))], ["v"])

    count = few.select("text").mapInArrow(run, "v long").groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = count.orderBy(F.desc("n"), "v").limit(MOST_COMMON).select("v").toArrow()
    return np.sort(found.column("v").to_numpy())


def _can(a: str, b: str, least: float) -> Column:
    """Whether sizes and sketches of two texts allow that similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.s")[i].bitwiseXOR(F.col(f"{b}.s")[i])) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}.s")[0].bitwiseXOR(F.col(f"{b}.s")[0])))
    return (F.least(n, m) >= F.greatest(n, m) * least - 1e-9) & (differ <= (n + m) * ((1 - least) / (1 + least)) + 1e-9)


def documents(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(ids, texts) of the rows with a key. ids: (k, u, node), a number for each key and text hash, in order of key and hash;
    texts: (node, u, text), one for each different text, with the least of its numbers."""
    one = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text")).withColumn("u", F.xxhash64("text"))
    ids = one.select("k", "u").distinct().repartitionByRange("k", "u").sortWithinPartitions("k", "u")
    ids = materialise(ids.withColumn("node", F.monotonically_increasing_id()), "ids")
    # copies of a text are one node from the start
    first = ids.groupBy("u").agg(F.min(F.struct("node", "k")).alias("x")).select(F.col("x.k").alias("k"), "u", F.col("x.node").alias("node"))
    return ids, materialise(one.join(first, ["k", "u"]).dropDuplicates(["node"]).select("node", "u", "text"), "texts")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """(key, component) of docs with a key: documents connected by pairs that similar, named by the least key among them.
    A key with several texts has a row for each."""
    ids, linked = _linked(docs, key, text, least, size)
    names = linked.join(ids.select(F.col("node").alias("root"), F.col("k").alias("component")), "root")
    return names.select(F.col("k").alias(key), "component")


def _linked(docs: DataFrame, key: str, text: str, least: float, size: int) -> tuple[DataFrame, DataFrame]:
    """(ids, linked): ids of documents(), linked: (k, u, node, root), root the least node that a node is linked with."""
    if not 0 < least <= 1:
        raise ValueError("least is a similarity above 0, 1 at most")
    ids, texts = documents(docs, key, text)
    common = common_shingles(texts, size)

    @bpe.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(i, 1024) for w in batches for i in range(0, len(w), 1024)):
            sets = [_shingles(t.as_py(), size) for t in b.column("text")]
            firsts = [prefix(x, least, common) for x in sets]
            prints_ = np.array([majority(x.tobytes()) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            columns = [pa.array([len(x) for x in sets], pa.int32()), pa.array(prints_), pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))]
            columns += [pa.array([late for _, late in firsts], pa.bool_()), pa.array([x for x, _ in firsts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("node"), *columns], ["rep", "n", "fp", "s", "late", "keys"])

    prints = materialise(texts.select("node", "text").mapInArrow(run, "rep long, n int, fp long, s array<long>, late boolean, keys array<long>"), "prints")
    signed = materialise(verified(_signed(prints, least), texts, least, size), "links")
    keyed = prints.select("rep", F.posexplode("keys").alias("at", "v"))
    # of each key the text in which it comes first, in a group the one with the least of its own
    least_of = keyed.groupBy("v").agg(F.min(F.struct("at", "rep")).alias("x"), F.count("*").alias("k")).where("k > 1").select("v", F.col("x.rep").alias("star"))
    # the size of a compressed or unfolded table is far more than what Spark takes it for: where all texts' keys meet, none is sent to the driver
    shared = materialise(keyed.join(least_of.hint("merge"), "v").select("v", "rep", "star"), "shared")
    sets = prints.select("rep", "n", "s", (F.col("n") - F.size("keys")).alias("room"), F.struct("late", F.element_at("keys", -1).alias("v")).alias("end"))
    pairs = shared.where("rep <> star").select(F.least("rep", "star").alias("a"), F.greatest("rep", "star").alias("b")).distinct()
    pairs = pairs.join(signed.hint("merge"), ["a", "b"], "left_anti")
    x, y = sets.alias("x"), sets.alias("y")
    first = materialise(pairs.join(x.hint("merge"), F.col("a") == F.col("x.rep")).join(y.hint("merge"), F.col("b") == F.col("y.rep")).where(_can("x", "y", least)).select("a", "b"), "pairs")
    edges = materialise(verified(first, texts, least, size), "links")
    roots = components(edges.unionByName(signed))
    # what is in one component needs no other link
    named = sets.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "n", "s", "room", "end", F.coalesce("root", "rep").alias("c"))
    rows = materialise(shared.select("v", "rep").join(named.hint("merge"), "rep"), "keyed")
    x, y = rows.alias("x"), rows.hint("merge").alias("y")
    hit = (F.col("x.v") == F.col("y.v")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & _can("x", "y", least)
    # of the two prefixes one ends first; what is common up to there is common to both prefixes, what is beyond is in its room
    room = F.when(F.col("x.end") <= F.col("y.end"), F.col("x.room")).otherwise(F.col("y.room"))
    need = (F.col("x.n") + F.col("y.n")) * (least / (1 + least)) - room - 1e-9
    found = x.join(y, hit).groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), need.alias("need")).count()
    rest = found.where("count >= need").select("a", "b").join(first, ["a", "b"], "left_anti")
    # components of components: edges between the names that the first links gave
    name = named.select(F.col("rep").alias("a"), F.col("c").alias("ca")), named.select(F.col("rep").alias("b"), F.col("c").alias("cb"))
    more = materialise(verified(rest, texts, least, size), "links").join(name[0], "a").join(name[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    last = components(more).select(F.col("node").alias("c"), "root")
    named = named.join(last, "c", "left").select("rep", F.coalesce("root", "c").alias("root"))
    owner = ids.groupBy("u").agg(F.min("node").alias("rep")).join(named, "rep").select("u", "root")
    return ids, ids.join(owner, "u")


def _signed(prints: DataFrame, least: float) -> DataFrame:
    """(a, b): each text with the least one of those that links() connects its fingerprint with, as far
    as sizes and sketches allow that similarity; as many pairs as texts, at most."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("rep").alias("rep")), "nodes")
    roots = components(links(nodes))
    named = nodes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "rep").alias("root"))
    own = prints.join(named, F.col("fp") == F.col("f")).where("rep <> root").select("rep", "n", "s", "root")
    x, y = own.alias("x"), prints.select("rep", "n", "s").alias("y")
    near = x.join(y, F.col("x.root") == F.col("y.rep")).where(_can("x", "y", least))
    return near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component): rows without a key have a component only through their fingerprint."""
    prints = fingerprints(docs, key, text)
    nodes = materialise(prints.groupBy("fp").agg(F.min(key).alias("rep")), "nodes")
    roots = components(links(nodes.where("rep is not null"), distance=distance))
    named = nodes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "rep").alias("component"))
    return prints.join(named, F.col("fp") == F.col("f")).select(key, "fp", "component")


def _comparable(df: DataFrame, column: str) -> Column:
    """The column, or its JSON text where its type has no order."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else F.col(column)


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """One row of each group of similar(), whole: the document of the least key, of several under this key the one whose text
    has the least hash; of rows that repeat it in key and text the least stays. Every group keeps a row whose text is in it, and
    no two rows that stay are that similar. Rows without a key are never copies of a row with one; of equal ones one stays."""
    names = docs.columns
    _, linked = _linked(docs, key, text, least, size)
    kept = linked.where("node = root").select("k", "u")
    # the columns go into structs, so that none is in the way of a name used here
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("k"), hashed.alias("u"), F.struct(*(F.col(c) for c in names)).alias("r"), F.struct(*(_comparable(docs, c).alias(f"c{i}") for i, c in enumerate(names))).alias("o"))
    one = rows.join(kept, ["k", "u"], "left_semi").groupBy("k", "u").agg(F.min_by("r", "o").alias("r")).select("r")
    alone = rows.where("k is null").groupBy("o").agg(F.any_value("r").alias("r")).select("r")
    return one.unionByName(alone).select(*(F.col("r")[c].alias(c) for c in names))


def op4_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))
