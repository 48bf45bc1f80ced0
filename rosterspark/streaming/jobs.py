"""Structured Streaming versions of the contact jobs.

The same Column functions serve batch and stream: ``validate`` is stateless,
progress counters are a streaming aggregation; what needs a key's earlier rows
is in ``state`` (dedup, progress fold).  Query recovery is the ``checkpointLocation``; delivery in ``foreachBatch`` is idempotent through
the ledger.  Arrival order replaces line order across micro-batches.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rules
from ..operators import sessions as S
from ..session import path_exists


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """A file source as a stream (``maxFilesPerTrigger`` bounds each micro-batch)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def run_available_now(stream: DataFrame, sink_path: str, checkpoint: str, output_mode: str = "append",
                      fmt: str = "parquet", foreach_batch: Callable | None = None):
    """Process everything available, then stop; returns the finished query (for ``recentProgress``)."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", sink_path).start()
    q.awaitTermination()
    return q


# --- R1 ----------------------------------------------------------------------


def stream_validate(contacts: DataFrame, **kw) -> DataFrame:
    """The batch ``validate`` on a stream (stateless)."""
    return rules.validate(contacts, **kw)


# --- R3 ----------------------------------------------------------------------


def stream_progress(events: DataFrame) -> DataFrame:
    """Per-session counters as a streaming aggregation (update/complete mode); ``state.progress_stream`` folds the rest.

    The trigger interval replaces a throttle of notifications.
    """
    return S.session_event_stats(events)


NUMBERS = "batches long, rows long"


# --- S7 ----------------------------------------------------------------------


def stream_contacts(spark: SparkSession, directory: str, schema: T.StructType, sink: Callable,
                    checkpoint: str, batch_size: int | None = None, fmt: str = "csv",
                    chunk_rows: int | None = None, order_col: str | None = None, numbers_path: str | None = None, **options):
    """Deliver a directory of contact files in micro-batches numbered from 1.

    ``batch_size`` bounds the files per micro-batch.  With ``chunk_rows`` and an
    ``order_col`` every row also gets ``chunk_no``: consecutive slices of
    ``chunk_rows`` rows in order, numbered from 1 and continued across
    micro-batches (the last slice may be shorter).  ``sink(batch_df, batch_no)``
    is called for every non-empty micro-batch; returns ``(batches, rows)`` of
    the stream since its checkpoint began.  The totals after each micro-batch
    lie in ``numbers_path`` below its id, so numbers go on after a restart and
    a retried micro-batch gets the numbers it had.
    """
    from ..operators.delivery import plan_batches

    if fmt == "csv":
        options.setdefault("header", True)
    stream = file_stream(spark, directory, schema, fmt, max_files_per_trigger=batch_size, **options)
    totals = numbers_path or f"{checkpoint.rstrip('/')}-numbers"

    def before(batch_id):
        """(micro-batches with rows, rows) of all micro-batches before this one, from the row that the last one left."""
        if batch_id < 0:
            return 0, 0
        return tuple(spark.read.schema(NUMBERS).parquet(f"{totals}/batch={batch_id}").first())

    def each(df, batch_id):
        batches, rows = before(batch_id - 1)
        n = df.count()  # one small action per micro-batch
        if n:
            if chunk_rows and order_col:
                planned = plan_batches(df, 1, order_col)  # dense 1-based position inside the micro-batch
                df = planned.withColumn(
                    "chunk_no", (F.floor((F.lit(rows) + F.col("seq") - 1) / F.lit(chunk_rows)) + 1).cast("bigint")
                ).drop("seq", "batch_no", "pos_in_batch")
            sink(df, batches + 1)
        spark.createDataFrame([(batches + bool(n), rows + n)], NUMBERS).coalesce(1).write.mode("overwrite").parquet(f"{totals}/batch={batch_id}")

    run_available_now(stream, None, checkpoint, foreach_batch=each)
    done = spark.read.schema(f"{NUMBERS}, batch long").parquet(totals) if path_exists(spark, totals) else None
    last = done.agg(F.max("batches"), F.max("rows")).first() if done is not None else (0, 0)
    return tuple(last)


# --- R4 / R5 / R6 --------------------------------------------------------------


def watch_sessions(spark: SparkSession, snapshot_path: str) -> Callable:
    """``foreachBatch`` function emitting only sessions that changed (J5) in each micro-batch.

    Input rows: ``session_id, seq, ts, status, processed``.  Snapshot version
    ``v=<batch>`` lives below ``snapshot_path``; each batch reads the previous
    version, so nothing is read and overwritten at once.  Changes are
    written to ``snapshot_path/changes/batch=<id>``; a retried batch replaces its own.
    """

    def each(batch: DataFrame, batch_id: int):
        latest = S.latest_checkpoint(batch.withColumnRenamed("seq", "checkpoint_id")).select(
            "session_id", "status", "processed")
        before = f"{snapshot_path}/v={batch_id - 1}"
        prev = spark.read.parquet(before) if path_exists(spark, before) else latest.limit(0)  # first batch: empty snapshot
        current = latest.unionByName(prev.join(latest.select("session_id"), "session_id", "left_anti"))
        S.session_diff(prev, current).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{snapshot_path}/changes/batch={batch_id}")
        current.write.mode("overwrite").parquet(f"{snapshot_path}/v={batch_id}")

    return each


def autosave(path: str, active: tuple[str, ...] = (S.ACTIVE,)) -> Callable:
    """``foreachBatch`` function that saves the latest row of every active session in the micro-batch.

    Input rows: ``session_id, ts, status`` and what else is to be kept, as
    ``progress_stream`` returns them (a ``ts`` is added where there is none).
    The saves of a micro-batch lie in ``path/batch=<id>``, so a retried one
    replaces its own; ``compact_saves`` merges them.
    """
    def each(batch: DataFrame, batch_id: int):
        rows = batch if "ts" in batch.columns else batch.withColumn("ts", F.lit(None).cast("timestamp"))
        cols = [c for c in rows.columns if c != "session_id"]
        latest = rows.groupBy("session_id").agg(F.max_by(F.struct(*cols), F.struct("ts", *[c for c in cols if c != "ts"])).alias("r"))
        saved = latest.select("session_id", *[F.col(f"r.{c}").alias(c) for c in cols]).filter(F.col("status").isin(*active))
        saved.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def read_saves(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The latest save of each session: merged ones and those since, with the micro-batch of the save."""
    fs, root = _folder(spark, path)
    folders = [f.getPath().getName() for f in fs.listStatus(root)]
    merged = max((int(f[6:]) for f in folders if f.startswith("merged") and path_exists(spark, f"{path}/{f}/_SUCCESS")), default=None)
    ids = sorted(int(f[6:]) for f in folders if f.startswith("batch=") and path_exists(spark, f"{path}/{f}/_SUCCESS"))
    ids = [i for i in ids if (merged is None or i > merged) and (upto is None or i <= upto)]
    parts = [spark.read.parquet(f"{path}/merged{merged}")] if merged is not None else []
    if ids:
        parts.append(spark.read.option("basePath", path).parquet(*[f"{path}/batch={i}" for i in ids]).withColumnRenamed("batch", "saved_in")
                     .withColumn("saved_in", F.col("saved_in").cast("long")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    cols = [c for c in every.columns if c != "session_id"]
    latest = every.groupBy("session_id").agg(F.max_by(F.struct(*cols), "saved_in").alias("r"))
    return latest.select("session_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def compact_saves(spark: SparkSession, path: str, upto: int) -> None:
    """Merge all saves up to a micro-batch into one table of the latest per session, then drop what it replaces.

    The merged table is complete before anything goes; readers take the newest
    complete one and the micro-batches after it, so a compaction that fails or
    runs twice changes no answer.
    """
    read_saves(spark, path, upto).write.mode("overwrite").parquet(f"{path}/merged{upto}")
    fs, root = _folder(spark, path)
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) <= upto or name.startswith("merged") and int(name[6:]) < upto:
            fs.delete(f.getPath(), True)


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def stream_deliver(deliver_fn: Callable) -> Callable:
    """``foreachBatch`` wrapper; ``deliver_fn(batch_df, batch_id)`` must be ledger-idempotent."""

    def each(df: DataFrame, batch_id: int):
        if not df.isEmpty():
            deliver_fn(df, batch_id)

    return each
