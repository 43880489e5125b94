"""Operator 13: the trie of conversation prefixes, from a global sort of turn arrays.

Turns become digests (MD5 of role and text, with the text's code points), conversations arrays of digests. Equal arrays are one class, whose
members are counted before anything is sorted. The classes' arrays are range-sorted over all tasks; each task
sweeps its arrays in order with a stack: what two neighbours have in common stays open, the rest is closed and
its sums go to the node below. What lies on a task's first and last array may go on in other tasks: such nodes
are handed over as they are, with the sums of what was closed above them, and one sweep of the same kind over these arrays, two for each
task, stitches them. Its rows number twice the tasks, whatever the table.

Turns are in order of turn, null first, ties by digest. Null role or text counts as empty. Rows without conv_id
belong to no conversation and are left out. A conversation may have no turn (prefix_trie takes empty paths); it ends at the root. An
empty table has no nodes. Repeated rows are turns of their own. Texts of any length are digested in
the JVM and go no further. Bound: the digests of one conversation (under 100 bytes a turn) go through one task;
ids of one class are joined in many tasks, and only the digest chain over these pieces is one task's.
Arrays that share their first WIDE turns are one task's. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .periods import crc32_sql

#: Turns of an array that decide which task sorts it.
WIDE = 256
#: Ids of one piece of a class's list, rows of one batch.
PIECE, BATCH = 1 << 14, 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of each conversation in order, as (turn, digest, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("path"))


def grafted(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each path with its first turns replaced by those of its block's first conversation: so many as a checksum of its id says."""
    rows = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    firsts = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most - 1).alias("first"))
    rows = rows.join(firsts, "base", "left")
    begin = F.slice(F.coalesce("first", F.slice("path", 1, 0)), F.lit(1), F.col("h"))
    end = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(begin, end).alias("path"))


def ends_of(members: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids of each key, ascending, joined by commas. members: (key, conv_id)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, key, held, done = TaskContext.get().partitionId(), 0, None, [], []

        def cut() -> None:
            if held:
                done.append((key, task, at, ",".join(map(str, held))))
                held.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip(("key", "task", "at", "ids"), d, strict=True)) for d in done], schema=kinds)
            done.clear()
            return made

        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if k != key or len(held) >= PIECE:
                    cut()
                    key, at = k, at + 1
                held.append(c)
            yield batch()
        cut()
        yield batch()

    kinds = pa.schema([("key", pa.string()), ("task", pa.int32()), ("at", pa.int64()), ("ids", pa.string())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for b in batches:
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                else:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "ends"])
            done.clear()
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "ends"])

    rows = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
    cut_up = rows.mapInArrow(pieces, "key string, task int, at long, ids string")
    return cut_up.repartition("key").sortWithinPartitions("key", "task", "at").select("key", "ids").mapInArrow(chain, "key string, ends string")


class Node:
    """An open node: what it has got of closed nodes and of the paths that end at it."""

    __slots__ = ("chars", "children", "conv", "ends", "held", "kids", "leaves", "n", "refs", "saved")

    def __init__(self, chars: int, held: bool):
        self.chars, self.held = chars, held
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = self.ends = None
        self.kids: list[tuple] = []
        self.refs: list[tuple] = []

    def add(self, n: int, conv: int | None, children: int, leaves: int, saved: int, ends: str | None = None) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.ends = ends or self.ends

    def part(self) -> tuple:
        return self.n, self.conv, self.children, self.leaves, self.saved, self.ends


def sweep(paths: Iterable[tuple], hold: bool) -> Iterator[tuple]:
    """Closes the nodes of ascending paths (digests, chars, {depth: part}, ref). Yields

    ("node", depth, parent's conversation, None, part) once that parent is closed,
    ("node", depth, None, (side, parent's depth), part) where it is held,
    ("ref", ref, depth, conversation) for what refs of paths point at,
    and, if hold, ("path", side, digests, chars, {depth: part}) of the first (0) and last (1) path, for another sweep."""
    stack: list[Node] = []
    before: list[str] = []
    first: tuple | None = None
    held: dict[int, tuple] = {}
    now: tuple = ((), ())

    def pop() -> Iterator[tuple]:
        depth, v = len(stack) - 1, stack.pop()
        if v.held:
            held[depth] = v.part()
            return
        saved = v.saved + (v.n - 1) * v.chars
        leaves = v.leaves if v.children else 1
        for kid_depth, part in v.kids:
            yield "node", kid_depth, v.conv, None, part
        for ref in v.refs:
            yield "ref", ref, depth, v.conv
        row = (depth, (v.n, v.conv, v.children, leaves, saved, v.ends))
        if not stack:
            yield "node", depth, None, None, row[1]
            return
        up = stack[-1]
        up.add(v.n, v.conv, 1, leaves, saved)
        if up.held:
            yield "node", depth, None, (0, depth - 1), row[1]
        else:
            up.kids.append(row)

    for digests, chars, parts, ref in paths:
        common = 0
        while common < min(len(before), len(digests)) and before[common] == digests[common]:
            common += 1
        while len(stack) > common + 1:
            yield from pop()
        while len(stack) <= len(digests):
            stack.append(Node(chars[len(stack) - 1] if stack else 0, hold and first is None))
        first, now, before = first or (digests, chars), (digests, chars), digests
        for depth, part in parts.items():
            stack[depth].add(*part)
            if ref is not None:
                stack[depth].refs.append(ref)
    if not hold:
        while stack:
            yield from pop()
        return
    last = {}
    while stack:
        depth, v = len(stack) - 1, stack.pop()
        (held if v.held else last)[depth] = v.part()
        for kid_depth, part in v.kids:
            yield "node", kid_depth, None, (1, depth), part
    if first:
        yield "path", 0, *first, held
        if last:
            yield "path", 1, *now, last


PART = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
SWEPT = pa.schema(
    [("kind", pa.string()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("task", pa.int64()), ("side", pa.int64()), ("ref_depth", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string()), ("digests", pa.list_(pa.string())), ("chars", pa.list_(pa.int64())), ("parts", pa.list_(PART))]
)
DDL = (
    "kind string, depth long, parent_conv_id long, task long, side long, ref_depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, digests array<string>, chars array<long>, parts array<struct<depth:long,n:long,conv:long,children:long,leaves:long,saved:long,ends:string>>"
)


def as_batches(swept: Iterator[tuple], task: int) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for kind, *x in swept:
        if kind == "node":
            depth, parent, ref, part = x
            row = dict(zip(("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends"), part, strict=True)) | {"depth": depth, "parent_conv_id": parent}
            if ref:
                row |= {"task": task, "side": ref[0], "ref_depth": ref[1]}
        elif kind == "ref":
            (at, side), depth, conv = x
            row = {"task": at, "side": side, "ref_depth": depth, "conv_id": conv}
        else:
            side, digests, chars, parts = x
            row = {"task": task, "side": side, "digests": digests, "chars": chars, "parts": [{"depth": d, **dict(zip(("n", "conv", "children", "leaves", "saved", "ends"), p, strict=True))} for d, p in parts.items()]}
        rows.append({"kind": kind, **row})
        if len(rows) >= BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema=SWEPT)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=SWEPT)


def swept(df: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple]], hold: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from as_batches(sweep((path for b in batches for path in read(b)), hold), TaskContext.get().partitionId())

    return df.mapInArrow(run, DDL)


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row a node of the trie of paths (conv_id, path of structs with digest and chars), with the sums of its
    members and its subtree; conv_id must be unique and not null."""

    def sequences(b: pa.RecordBatch) -> Iterator[tuple]:
        for digests, chars, n, conv, ends in zip(*(b.column(c) for c in ("digests", "chars", "n", "conv_id", "ends")), strict=True):
            digests = digests.as_py()
            yield digests, chars.as_py(), {len(digests): (n.as_py(), conv.as_py(), 0, 0, 0, ends.as_py())}, None

    def borders(b: pa.RecordBatch) -> Iterator[tuple]:
        for task, side, digests, chars, parts in zip(*(b.column(c) for c in ("task", "side", "digests", "chars", "parts")), strict=True):
            yield digests.as_py(), chars.as_py(), {p.pop("depth"): tuple(p.values()) for p in parts.as_py()}, (task.as_py(), side.as_py())

    rows = paths.select("conv_id", F.col("path.digest").alias("digests"), F.col("path.chars").alias("chars"))
    rows = materialise(rows.withColumn("key", F.sha2(F.array_join("digests", ""), 256)), "paths")
    classes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    ends = ends_of(rows.select("key", "conv_id"))
    unique = rows.drop("key").join(classes, "conv_id").join(ends, "key")
    unique = unique.repartitionByRange(F.slice("digests", 1, WIDE)).sortWithinPartitions("digests").select("digests", "chars", "n", "conv_id", "ends")
    local = materialise(swept(unique, sequences, True), "sweep")
    paths_ = local.where("kind = 'path'").repartition(1).sortWithinPartitions("task", "side")
    stitched = materialise(swept(paths_, borders, False), "stitch")
    refs = stitched.where("kind = 'ref'").select("task", "side", "ref_depth", F.col("conv_id").alias("up"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")]
    nodes = local.where("kind = 'node'")
    below = nodes.where("side is not null").drop("parent_conv_id").join(refs.withColumnRenamed("up", "parent_conv_id"), ["task", "side", "ref_depth"])
    return below.select(*out).unionByName(nodes.where("side is null").select(*out)).unionByName(stitched.where("kind = 'node'").select(*out))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialise(turn_arrays(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(grafted(convs))


#: The same by grouping every prefix of every conversation.
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, x, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) - 1 AS pos, count(*) OVER (PARTITION BY c) AS n FROM t
), i AS (
  SELECT ids.c, ids.h, ids.base, coalesce(b.n, 0) AS nb FROM (
    SELECT DISTINCT c, {crc32_sql("c::VARCHAR")} % 6 AS h, c - c % 100 AS base FROM t
  ) ids LEFT JOIN (SELECT DISTINCT c, n FROM o) b ON b.c = ids.base
), r AS (
  SELECT i.c, o.pos, o.x, o.chars FROM i JOIN o ON o.c = i.base AND o.pos < i.h
  UNION ALL SELECT i.c, least(h, nb) + o.pos - h, o.x, o.chars FROM i JOIN o ON o.c = i.c AND o.pos >= i.h
), l AS (
  SELECT i.c, coalesce(list(x ORDER BY pos) FILTER (x IS NOT NULL), []) AS xs, coalesce(list(r.chars ORDER BY pos) FILTER (x IS NOT NULL), []) AS cs
  FROM i LEFT JOIN r ON r.c = i.c GROUP BY i.c
), m AS (
  SELECT c, d, sha256(array_to_string(xs[1:d], '')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(xs[1:d - 1], '')) END AS up, coalesce(cs[d], 0) AS chars, d = len(xs) AS last
  FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM l)
), n AS (
  SELECT k, min(c) AS c, min(d) AS d, min(up) AS up, count(*) AS n, (count(*) - 1) * min(chars) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM m GROUP BY k
), s AS (
  SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT up, count(*) AS n_children FROM n GROUP BY up) ch ON ch.up = n.k
), a AS (
  SELECT m.k, sum((s.n_children = 0)::INT) AS n_leaves, sum(s.saved) AS saved FROM s JOIN m ON m.c = s.c AND m.d <= s.d GROUP BY m.k
)
SELECT s.c AS conv_id, s.d AS depth, p.c AS parent_conv_id, s.n AS n_convs, s.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, s.ends AS ends_sha256
FROM s JOIN a ON a.k = s.k LEFT JOIN s p ON p.k = s.up
"""
