"""Operator 1: chat formatting at the level of tokens.

A conversation is BOS and then its turns: [INST] text [/INST] for a user, [OUT] text </s> for an
assistant, [SYS] text [/SYS] for a system turn, [ROLE] role [TEXT] text [/ROLE] for any other role.
Segments are encoded apart from each other, so no merge crosses a mark, and the marks are reserved
ids beyond the vocabulary, spliced in between. Ids of ordinary text are never reserved ids.

A control string within a role or text is escaped by a backslash behind its first character (one
more where backslashes stand there already), which removing one backslash undoes. As no control
string holds "[" or "<" but in front, none can form where a text meets a mark, either, so that the
formatted text can be read back as well as the ids.

The loss mask covers the texts of assistant turns. Lengths of segments add up to places within the
turn, those of turns to places within the conversation; +1 where a loss span starts and -1 where it
ends, summed up, is the mask.

Rows are ordered by turn (null first), role, text; null role or text counts as empty; rows that
repeat are turns of their own; a null conv_id is one conversation. No turns, no rows; other columns
are ignored. Turns, not conversations, are what is encoded and read back: they are dealt over the
tasks by ranges of (conversation, turn), so a conversation of any length is spread over many, and
what stands before a task's first turn is carried over by a table of at most two rows a task. Only
the digests, being chains, read one conversation's texts in order, row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, json_encoder, library
from .common import materialise, same_join, table

MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")
#: Opening and closing mark of the known roles.
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
LOSS_ROLE = "assistant"
#: Ids of the marks: this one and those that follow it, behind the vocabulary and its special token.
RESERVED = 50257

CONTROL = re.compile("|".join(rf"{re.escape(m[0])}\\*{re.escape(m[1:])}" for m in MARKS))


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def segments(role: str, text: str) -> list[tuple[bool, str]]:
    """(is a mark, string) in order."""
    if role in ROLES:
        start, end = ROLES[role]
        return [(True, start), (False, escape(text)), (True, end)]
    return [(True, "[ROLE]"), (False, escape(role)), (True, "[TEXT]"), (False, escape(text)), (True, "[/ROLE]")]


def assemble(turns: list[tuple[str, str]], encoder: Encoder) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """(ids, mask, formatted text) of each (role, text)."""
    cut = [segments(*t) for t in turns]
    ids = iter(encoder.encode(s for c in cut for mark, s in c if not mark))
    out = []
    for (role, _), c in zip(turns, cut, strict=True):
        parts = [np.array([RESERVED + MARKS.index(s)], np.int64) if mark else np.frombuffer(next(ids), "<u2").astype(np.int64) for mark, s in c]
        ends = np.cumsum([len(p) for p in parts])
        steps = np.zeros(int(ends[-1]) + 1, np.int8)
        if role == LOSS_ROLE:  # the text is the segment before the last
            steps[ends[-3]] += 1
            steps[ends[-2]] -= 1
        out.append((np.concatenate(parts), np.cumsum(steps, dtype=np.int8)[:-1], "".join(s for _, s in c)))
    return out


def read(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[str, str, str]:
    """role, text, text under the mask, from the ids of a turn alone. decode: ids to text."""
    marks = np.flatnonzero(ids >= RESERVED)
    names = [MARKS[i - RESERVED] for i in ids[marks]]
    if names[0] == "<s>":
        marks, names = marks[1:], names[1:]
    between = [unescape(decode(ids[a + 1 : z])) for a, z in zip(marks[:-1], marks[1:], strict=True)]
    under = unescape(decode(ids[mask.astype(bool)]))
    if names[0] == "[ROLE]":
        return between[0], between[1], under
    role = next(r for r, (start, end) in ROLES.items() if [start, end] == names)
    return role, between[0], under


def format_turns(turns: DataFrame, path: str) -> DataFrame:
    """turns (conv_id, turn, role, text) with position, start (the place of the turn's first id in its
    conversation), ids, mask and formatted; written once to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, at, place, fresh = json_encoder(path), None, 0, 0, True
        task = TaskContext.get().partitionId()
        for b in batches:
            for low in range(0, len(b), 512):  # of bounded size whatever the batch
                part = b.slice(low, 512)
                conv, roles, texts = part.column("conv_id").to_pylist(), part.column("role").to_pylist(), part.column("text").to_pylist()
                made, positions, starts = assemble(list(zip(roles, texts, strict=True)), encoder), [], []
                for c, (ids, _, _) in zip(conv, made, strict=True):
                    if fresh or c != now:
                        now, at, place, fresh = c, 0, 0, False
                    positions.append(at)
                    starts.append(place)
                    at, place = at + 1, place + len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task] * len(part), pa.int32()), *(part.column(c) for c in ("conv_id", "turn")),
                        pa.array(positions, pa.int64()), pa.array(starts, pa.int64()),
                        pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                        pa.array([m[1] for m in made], pa.list_(pa.int8())),
                        pa.array([m[2] for m in made]),
                    ],
                    ["task", "conv_id", "turn", "position", "start", "ids", "mask", "formatted"],
                )

    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    # the last key deals rows that repeat over several tasks, too
    order = ["conv_id", "turn", "role", "text", "uid"]
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("uid")
    made = materialise(rows.mapInArrow(run, "task int, conv_id long, turn long, position long, start long, ids array<int>, mask array<tinyint>, formatted string"), "turns")
    # conversations of more than one task: what their earlier tasks hold; at most two of them begin or end in a task
    sums = made.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("tokens"))
    split = sums.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("task", "n", "tokens"))).alias("a")).where(F.size("a") > 1)
    before = lambda i, c: F.aggregate(F.slice("a", F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x[c])
    carry = split.select("conv_id", F.explode(F.transform("a", lambda x, i: F.struct(x["task"].alias("task"), before(i, "n").alias("turns_before"), before(i, "tokens").alias("tokens_before")))).alias("c"))
    got = same_join(made, F.broadcast(carry.select("conv_id", "c.*")), ["conv_id", "task"], "left")
    position = F.col("position") + F.coalesce("turns_before", F.lit(0))
    # the opening mark belongs to the first turn, and is before all others
    opens, bos = position == 0, MARKS.index("<s>") + RESERVED
    return got.select(
        "conv_id", "turn", position.alias("position"),
        F.when(opens, 0).otherwise(F.col("start") + F.coalesce("tokens_before", F.lit(0)) + 1).cast("long").alias("start"),
        F.when(opens, F.concat(F.array(F.lit(bos)), "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(opens, F.concat(F.array(F.lit(0).cast("tinyint")), "mask")).otherwise(F.col("mask")).alias("mask"),
        F.when(opens, F.concat(F.lit("<s>"), "formatted")).otherwise(F.col("formatted")).alias("formatted"),
    )


def read_turns(formatted: DataFrame, path: str) -> DataFrame:
    """(conv_id, position, role, text, under, formatted_chars, n_tokens, loss_tokens) from the ids and masks of
    format_turns(), each turn by itself; under is the text below the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        decode = lambda ids: lib.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""
        for b in batches:
            out = []
            for ids, mask, formatted in zip(*(b.column(c) for c in ("ids", "mask", "formatted")), strict=True):
                i, m = ids.values.to_numpy(), mask.values.to_numpy()
                out.append((*read(i, m, decode), len(formatted.as_py()), len(i), int(m.sum())))
            cols = list(zip(*out, strict=True)) or [()] * 6
            made = [pa.array(c, pa.string() if k < 3 else pa.int64()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("position"), *made], ["conv_id", "position", "role", "text", "under", "formatted_chars", "n_tokens", "loss_tokens"])

    return formatted.select("conv_id", "position", "ids", "mask", "formatted").mapInArrow(run, "conv_id long, position long, role string, text string, under string, formatted_chars long, n_tokens long, loss_tokens long")


def digests(formatted: DataFrame, path: str) -> DataFrame:
    """What the ids and masks of format_turns() hold, one row a conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6], state[7]))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * len(names)
            kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for conv, position, role, text, under, chars, tokens, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if position == 0:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[2].update(f"{role}\n{text}\n".encode())
                state[4].update(under.encode())
                for i, x in ((1, 1), (3, len(under)), (5, chars), (6, tokens), (7, loss)):
                    state[i] += x
            yield batch()
            done.clear()
        close()
        yield batch()

    rows = read_turns(formatted, path).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names))


#: A conversation whose texts are full of control strings.
ODD = "</s>[INST] ok [/INST]"


def op1_token_level_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"),
    )
    got = digests(format_turns(turns.unionByName(odd), path), path)
    return got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: The same from the texts: marks have fixed lengths, and each control string grows by one character.
ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD}' UNION ALL SELECT -1, 1, 'assistant', '{ODD}'
), l AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '{CONTROL.pattern}')) + CASE role
    {" ".join(f"WHEN '{r}' THEN {len(a) + len(z)}" for r, (a, z) in ROLES.items())}
    ELSE {len("[ROLE][TEXT][/ROLE]")} + len(role) + len(regexp_extract_all(role, '{CONTROL.pattern}')) END AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  ({len("<s>")} + sum(n))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
