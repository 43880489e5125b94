"""Incremental ingestion: resumable, idempotent, and equal to the batch result.

A stream reads new files as they arrive; each batch is merged by key into a bucketed table, so a
batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas

#: A column of every bucketed table: the row is a tombstone.
GONE = "deleted"


class Bucketed:
    """A table by key, copy on write: a merge rewrites only the buckets that its keys fall into.

    data/v=<n>/bucket=<b>/ holds a bucket as the n-th merge wrote it, manifest/ one row (n, batch, bucket) for each bucket that
    a merge has rewritten, appended after its data. A bucket's last row names its folder; what no row names was never there. A row
    with deleted set is a tombstone: it stays, so that a row that comes late can't bring its key back. Of a key the row of
    the largest order stays; of equal orders the tombstone, else the greatest row. One writer at a time; readers see whole merges."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, list(keys), order, buckets
        schema = schema.replace(f", {GONE} boolean", "")
        self.schema = f"{schema}, {GONE} boolean"
        self.names = [f.name for f in T._parse_datatype_string(schema).fields]
        self._manifest = "n long, batch long, bucket int"
        # an empty manifest, where there is none: from now on it can be read
        spark.createDataFrame([], self._manifest).write.mode("ignore").json(f"{path}/manifest")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(self._manifest).json(f"{self.path}/manifest")

    def last(self) -> tuple[int, int]:
        """(number of the last merge, number of its batch)."""
        r = self.manifest().agg(F.max("n").alias("n"), F.max("batch").alias("batch")).first()
        return (r["n"] or 0, -1 if r["batch"] is None else r["batch"])

    def current(self) -> dict[int, int]:
        """The merge that wrote each bucket last; no more rows than buckets."""
        return {r["bucket"]: r["n"] for r in self.manifest().where("bucket is not null").groupBy("bucket").agg(F.max("n").alias("n")).collect()}

    def _stored(self, buckets: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/v={n}/bucket={b}" for b, n in buckets.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, tombstones: bool = False) -> DataFrame:
        rows = self._stored(self.current())
        return rows if tombstones else rows.where(~F.coalesce(F.col(GONE), F.lit(False))).drop(GONE)

    def rank(self) -> Column:
        rest = [c for c in self.names if c not in self.keys and c != self.order]
        return F.struct(F.col(self.order), F.coalesce(F.col(GONE), F.lit(False)).alias("gone"), *(F.col(c) for c in rest))

    def merge(self, new: DataFrame, batch: int | None = None) -> int:
        """Rows of the schema, deleted or not; the number of buckets rewritten. A batch whose number was merged before is passed over."""
        n, seen = self.last()
        if batch is not None and batch <= seen:
            return 0
        if GONE not in new.columns:
            new = new.withColumn(GONE, F.lit(False))
        new = new.select(*self.names, GONE)
        touched = [r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as buckets
        now = self.current()
        both = self._stored({b: now[b] for b in touched if b in now}).unionByName(new)
        rest = [*(c for c in self.names if c not in self.keys), GONE]
        last = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.rank()).alias("__r")).select(*self.keys, *(F.col("__r")[c].alias(c) for c in rest))
        if touched:
            last.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/v={n + 1}")
        marks = [(n + 1, batch, b) for b in touched] or [(n + 1, batch, None)]
        self.spark.createDataFrame(marks, self._manifest).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return len(touched)

    def clear(self, keys: DataFrame, order: Column, batch: int | None = None) -> int:
        """Tombstones, of this order, for keys; what comes later with a larger order is there again."""
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(self.schema).fields}
        rest = [F.lit(None).cast(kinds[c]).alias(c) for c in self.names if c not in self.keys and c != self.order]
        return self.merge(keys.select(*self.keys).distinct().select(*self.keys, order.cast(kinds[self.order]).alias(self.order), *rest, F.lit(True).alias(GONE)), batch)


class Papers(Bucketed):
    """Papers and stubs by id: a real record is never replaced by a stub."""

    def rank(self) -> Column:
        return F.struct(F.coalesce(F.col(GONE), F.lit(False)).alias("gone"), (~F.coalesce(F.col("stub"), F.lit(False))).alias("real"), super().rank().alias("last"))


def upsert_stream(source: DataFrame, target: Bucketed, checkpoint: str) -> StreamingQuery:
    """Last write wins by key, for all that is there now; start it again for what comes later."""
    return source.writeStream.foreachBatch(lambda df, i: target.merge(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


# --- status by file


def progress_table(spark: SparkSession, path: str, buckets: int = 64) -> Bucketed:
    return Bucketed(spark, path, f"{schemas.PROGRESS}, seq long", ["path"], "seq", buckets)


def completed(results: DataFrame, seq: Column) -> DataFrame:
    """Rows of progress for results (path, directory, paper_id, total_sentences, total_citations); what isn't known is unknown or 0."""
    have = lambda c, kind, other: (F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in results.columns else F.lit(other)).cast(kind).alias(c)
    return results.select("path", F.lit("completed").alias("status"), "directory", have("paper_id", "string", "unknown"), have("total_sentences", "int", 0), have("total_citations", "int", 0), F.current_timestamp().alias("completed_at"), F.lit(None).cast("string").alias("error"), seq.cast("long").alias("seq"))


def failed(results: DataFrame, seq: Column) -> DataFrame:
    """Rows of progress for results (path, directory, error)."""
    zero = F.lit(0)
    return results.select("path", F.lit("failed").alias("status"), "directory", F.lit(None).cast("string").alias("paper_id"), zero.alias("total_sentences"), zero.alias("total_citations"), F.current_timestamp().alias("completed_at"), F.col("error").cast("string").alias("error"), seq.cast("long").alias("seq"))


def pending_files(files: DataFrame, progress: Bucketed, force: bool = False) -> DataFrame:
    """files (path, ...) that aren't completed: failed ones and such as were cleared are tried again."""
    done = progress.read().where("status = 'completed'").select("path")
    return files if force else files.join(done, "path", "left_anti")


def clear_progress(progress: Bucketed, seq: Column, directory: str | None = None, batch: int | None = None) -> int:
    """Forgets the files of a directory, or all."""
    rows = progress.read()
    return progress.clear(rows if directory is None else rows.where(F.col("directory") == directory), seq, batch)


# --- conversation memory

#: Turns after which a conversation is summarised, turns that stay, days of silence after which it is forgotten.
THRESHOLD, KEEP, DAYS = 10, 3, 30
MEMORY = "conv_id long, kind string, number long, first_turn long, last_turn long, text string"


def memory_summaries(turns: DataFrame, threshold: int = THRESHOLD, keep: int = KEEP) -> DataFrame:
    """(conv_id, kind, number, first_turn, last_turn, text) of turns (conv_id, turn, role, text): whenever so many turns have gathered, all but the
    last few become a summary row, and these stay. In order of turn, numbers that are missing are passed over; of rows with one number the least counts.

    A summary covers threshold - keep turns, so the n-th turn of a conversation is in summary n / (threshold - keep), which is there once
    its turns and as many as stay are: no loop over turns. A conversation's turns are numbered in one window."""
    from pyspark.sql import Window

    step = threshold - keep
    if not 0 <= keep < threshold:
        raise ValueError("some turns must go: keep is below threshold")
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = turns.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(line).alias("line"))
    own = Window.partitionBy("conv_id")
    rows = rows.withColumn("n", F.row_number().over(own.orderBy("turn")) - 1).withColumn("all", F.count("*").over(own))
    rows = rows.withColumn("number", F.floor(F.col("n") / step)).where(F.col("all") >= F.col("number") * step + threshold)
    got = rows.groupBy("conv_id", "number").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("a"))
    return got.select("conv_id", F.lit("summary").alias("kind"), "number", "first_turn", "last_turn", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


def memory_stream(turns: DataFrame, threshold: int = THRESHOLD, keep: int = KEEP, days: int = DAYS, delay: str = "1 hour") -> DataFrame:
    """memory_summaries() of a stream (conv_id, turn, role, text, ts), whatever order its turns come in.

    A turn waits in the state until all numbers from 0 to it have come, or until the watermark (delay behind the latest ts) has passed
    it; then missing numbers are given up. Kinds of rows: summary, as in batch; late, a turn that came in time but when its place was passed or
    taken, with its text (what comes behind the watermark Spark passes over); forgotten, a conversation that was silent for so many days of event time, with the number of the summaries it
    had and the turns that were kept. After that a conversation begins anew, at whatever number comes. Rows without
    conversation, turn or time are left out. The state holds fewer than threshold turns and those that wait."""
    import pandas as pd

    if not 0 <= keep < threshold:
        raise ValueError("some turns must go: keep is below threshold")
    state_schema = "next long, number long, seen long, window array<struct<turn:long,line:string>>, waiting array<struct<turn:long,ts:long,line:string>>"
    silent, names = days * 24 * 3600 * 1000, [f.split(" ")[0] for f in MEMORY.split(", ")]

    def step(key, batches, state):
        rows: list[tuple] = []
        if state.exists:
            following, number, seen, window, waiting = state.get
            window, waiting = [tuple(x) for x in window], {x[0]: (x[1], x[2]) for x in waiting}
        else:
            following, number, seen, window, waiting = 0, 0, 0, [], {}

        def take(turn: int, line: str) -> None:
            nonlocal following, number, window
            window.append((turn, line))
            following = turn + 1
            if len(window) >= threshold:
                old = window[: threshold - keep]
                rows.append((key[0], "summary", number, old[0][0], old[-1][0], "\n".join(x[1] for x in old)))
                number, window = number + 1, window[threshold - keep :]

        def drain(passed: int) -> None:
            while waiting:
                turn = min(waiting)
                if turn != following and waiting[turn][0] > passed:
                    return
                take(turn, waiting.pop(turn)[1])

        for b in batches:
            b = b.assign(role=b["role"].fillna(""), text=b["text"].fillna(""))
            for turn, role, text, ts in b[["turn", "role", "text", "ts"]].itertuples(index=False):
                turn, line, at = int(turn), f"{role}: {text}", int(ts.timestamp() * 1000)
                seen = max(seen, at)
                if turn < following:
                    rows.append((key[0], "late", number, turn, turn, line))
                elif turn in waiting:
                    # of two rows with one number the least counts, as in batch
                    kept, other = sorted((waiting[turn][1], line))
                    if kept != other:
                        rows.append((key[0], "late", number, turn, turn, other))
                    waiting[turn] = (min(at, waiting[turn][0]), kept)
                else:
                    waiting[turn] = (at, line)
        passed = state.getCurrentWatermarkMs()
        drain(passed)
        if not waiting and seen + silent <= passed:
            rows.append((key[0], "forgotten", number, window[0][0] if window else following, following - 1, "\n".join(x[1] for x in window)))
            if state.exists:
                state.remove()
        else:
            state.update((following, number, seen, window, [(t, *x) for t, x in waiting.items()]))
            until = min(at for at, _ in waiting.values()) if waiting else seen + silent
            state.setTimeoutTimestamp(max(until, passed) + 1)
        yield pd.DataFrame(rows, columns=names)

    known = turns.where("conv_id is not null and turn is not null and ts is not null").withWatermark("ts", delay)
    return known.groupBy("conv_id").applyInPandasWithState(step, MEMORY, state_schema, "append", "EventTimeTimeout")
