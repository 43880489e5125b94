"""Bucketed tables, status by file, conversation memory as a stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quiremill.operators import graph as G
from quiremill.operators import rollup as U
from quiremill.streaming import ingest

ROW = "user_id long, value string, seq long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, f"v{i}", i) for k in range(i, i + 3)], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = ingest.Bucketed(spark, str(tmp_path / "t"), ROW, ["user_id"], "seq", 8)
    for _ in range(2):  # the second run finds nothing new
        ingest.upsert_stream(ingest.new_files(spark, str(tmp_path / "in"), ROW, per_batch=1), t, str(tmp_path / "c")).awaitTermination()
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = G.upsert(batch.limit(0), batch, ["user_id"], "seq")
    assert rows(t.read().select("user_id", "value", "seq")) == rows(want.select("user_id", "value", "seq"))


def test_a_merge_rewrites_the_buckets_it_touches(spark, tmp_path):
    t = ingest.Bucketed(spark, str(tmp_path / "t"), ROW, ["user_id"], "seq", 16)
    assert t.read().count() == 0 and t.last() == (0, -1)
    assert t.merge(spark.range(500).select(F.col("id").alias("user_id"), F.lit("a").alias("value"), F.lit(1).cast("long").alias("seq")), 0) == 16
    before = t.current()
    one = spark.createDataFrame([(7, "b", 2)], ROW)
    assert t.merge(one, 1) == 1
    now = t.current()
    assert sum(now[b] != before[b] for b in now) == 1 and {p.name for p in (tmp_path / "t" / "data" / "v=2").iterdir() if p.is_dir()} == {f"bucket={b}" for b in now if now[b] == 2}
    assert t.merge(one, 1) == 0 and t.merge(one.limit(0), 2) == 0  # a batch again; a batch without rows
    assert t.last() == (3, 2)
    assert t.read().count() == 500 and rows(t.read().where("user_id in (6, 7)")) == [(6, "a", 1), (7, "b", 2)]


def test_tombstones_outlast_late_rows(spark, tmp_path):
    t = ingest.Bucketed(spark, str(tmp_path / "t"), ROW, ["user_id"], "seq", 4)
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "a", 1), (None, "n", 1)], ROW), 0)
    t.clear(spark.createDataFrame([(1,), (9,)], "user_id long"), F.lit(5), 1)
    assert sorted(r["value"] for r in t.read().collect()) == ["a", "n"]
    t.merge(spark.createDataFrame([(1, "late", 4), (9, "late", 4), (1, "tied", 5)], ROW), 2)
    assert {r["user_id"] for r in t.read().collect()} == {2, None}
    t.merge(spark.createDataFrame([(1, "again", 6)], ROW), 3)
    assert {(r["user_id"], r["value"]) for r in t.read().collect()} == {(1, "again"), (2, "a"), (None, "n")}
    assert t.read(tombstones=True).where("deleted").count() == 1
    # another object over the same folder sees the same
    assert ingest.Bucketed(spark, str(tmp_path / "t"), ROW, ["user_id"], "seq", 4).read().count() == 3


def test_papers_beat_stubs(spark, tmp_path):
    schema = "paper_id string, title string, stub boolean, seq long"
    t = ingest.Papers(spark, str(tmp_path / "t"), schema, ["paper_id"], "seq", 4)
    t.merge(spark.createDataFrame([("A", "stub", True, 1), ("B", "real", False, 1)], schema), 0)
    t.merge(spark.createDataFrame([("A", "real", False, 2), ("B", "stub", True, 2), ("C", "stub", True, 2)], schema), 1)
    assert {r["paper_id"]: r["title"] for r in t.read().collect()} == {"A": "real", "B": "real", "C": "stub"}


def test_status_by_file(spark, tmp_path):
    p = ingest.progress_table(spark, str(tmp_path / "p"), 8)
    files = spark.createDataFrame([(f"/in/{d}/{i}.pdf", f"/in/{d}") for d in "ab" for i in range(3)], "path string, directory string")
    p.merge(ingest.completed(files.where("path not like '%2.pdf'").withColumn("total_sentences", F.lit(4)), F.lit(1)), 0)
    p.merge(ingest.failed(files.where("path like '%2.pdf'").withColumn("error", F.lit("boom")), F.lit(2)), 1)
    got = {r["path"]: r for r in p.read().collect()}
    assert (got["/in/a/0.pdf"]["status"], got["/in/a/0.pdf"]["paper_id"], got["/in/a/0.pdf"]["total_sentences"]) == ("completed", "unknown", 4)
    assert (got["/in/a/2.pdf"]["status"], got["/in/a/2.pdf"]["error"]) == ("failed", "boom")
    summary = U.progress_summary(p.read()).first()
    assert (summary["completed"], summary["failed"]) == (4, 2)
    assert {r["path"] for r in ingest.pending_files(files, p).collect()} == {"/in/a/2.pdf", "/in/b/2.pdf"}
    assert ingest.pending_files(files, p, force=True).count() == 6
    ingest.clear_progress(p, F.lit(3), "/in/a", 2)
    assert {r["path"] for r in p.read().collect()} == {f"/in/b/{i}.pdf" for i in range(3)}
    p.merge(ingest.completed(files, F.lit(1)), 3)  # a replay of what was before the clear
    assert {r["directory"] for r in p.read().collect()} == {"/in/b"} and ingest.pending_files(files, p).count() == 4
    ingest.clear_progress(p, F.lit(4))
    assert p.read().count() == 0 and ingest.pending_files(files, p).count() == 6


TURN = "conv_id long, turn long, role string, text string, ts timestamp"
START = datetime(2024, 1, 1)


def talk(sizes, gap=()):
    return [(c, t, "user" if t % 2 == 0 else None, f"c{c} t{t}" if t % 5 else None, START + timedelta(minutes=t + c)) for c, n in sizes.items() for t in range(n) if (c, t) not in gap]


def literal(turns, threshold=10, keep=3):
    out, by = [], {}
    for c, t, role, text, _ in sorted(turns, key=lambda x: (x[0], x[1])):
        window, number = by.setdefault(c, ([], 0))
        window.append((t, f"{role or ''}: {text or ''}"))
        if len(window) >= threshold:
            old = window[: threshold - keep]
            out.append((c, "summary", number, old[0][0], old[-1][0], "\n".join(x[1] for x in old)))
            by[c] = (window[threshold - keep :], number + 1)
    return sorted(out)


def run(spark, folder, batches, **how):
    """One micro-batch for each list of turns, in this order."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, TURN).coalesce(1).write.parquet(str(folder / "in" / f"{i:03d}"))
    import os

    for i in range(len(batches)):
        for f in (folder / "in" / f"{i:03d}").iterdir():
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    source = ingest.new_files(spark, str(folder / "in" / "*"), TURN, per_batch=1)
    q = ingest.memory_stream(source, **how).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows(spark.read.schema(ingest.MEMORY).parquet(str(folder / "out")))


def test_memory_batch_form(spark):
    turns = talk({1: 35, 2: 9, 3: 10, 4: 17}, gap={(1, 4), (1, 20)})
    assert rows(ingest.memory_summaries(spark.createDataFrame(turns, TURN))) == literal(turns)
    assert rows(ingest.memory_summaries(spark.createDataFrame(turns, TURN), 4, 0)) == literal(turns, 4, 0)
    with pytest.raises(ValueError):
        ingest.memory_summaries(spark.createDataFrame(turns, TURN), 3, 3)


def test_memory_stream_of_shuffled_turns(spark, tmp_path):
    turns = talk({1: 35, 2: 9, 3: 10, 4: 17})
    mixed = list(turns)
    random.Random(3).shuffle(mixed)
    got = run(spark, tmp_path, [mixed[i::4] for i in range(4)], delay="2 days")
    assert got == literal(turns) == rows(ingest.memory_summaries(spark.createDataFrame(turns, TURN)))


def test_memory_stream_gaps_late_turns_and_silence(spark, tmp_path):
    turns = talk({1: 14}, gap={(1, 2)})
    late = [(1, 2, "user", "too late", START + timedelta(minutes=3)), (1, 5, "user", "again", START + timedelta(minutes=6))]
    tick = lambda c, days: [(c, 0, "user", "tick", START + timedelta(days=days))]
    again = [(1, 1, "user", "once more", START + timedelta(minutes=20))]
    got = run(spark, tmp_path, [turns[:6], turns[6:] + again, tick(7, 1), tick(8, 2), late, tick(9, 40), tick(10, 41)], delay="1 hour")
    # the gap was given up when the watermark passed, so the rows are those of a batch without the turn
    assert [r for r in got if r[0] == 1 and r[1] == "summary"] == literal(turns)
    # in time but its place was taken: a row of its own; behind the watermark: Spark passes over it
    assert {(r[3], r[5]) for r in got if r[1] == "late"} == {(1, "user: once more")}
    gone = {r[0]: r for r in got if r[1] == "forgotten"}
    assert {1, 7} <= set(gone) and gone[1][2] == 1 and gone[1][4] == 13 and gone[1][5].startswith("user: c1 t8") and 10 not in gone
