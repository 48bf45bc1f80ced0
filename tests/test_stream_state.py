"""Keyed state of streams (R2, R3), saves (R5) and numbering over restarts."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterspark.operators import sessions as S
from rosterspark.streaming import jobs as R
from rosterspark.streaming import state as RS

ROWS = "line_number long, email string"


@pytest.fixture()
def small_batches(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "3")
    spark.conf.set(names[1], "2")
    spark.conf.set(names[2], "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def run_dedup(spark, base, rows, **kw):
    spark.createDataFrame(rows, ROWS).write.mode("append").parquet(f"{base}/in")
    stream = R.file_stream(spark, f"{base}/in", StructType.fromDDL(ROWS))
    return R.run_available_now(RS.dedup_stream(stream, **kw), f"{base}/out", f"{base}/ckpt")


def test_hot_key_is_numbered_in_order_over_restarts(spark, tmpdir_path, small_batches):
    """A key with more rows than an Arrow batch, in two runs of one checkpoint; blank rows leave no state."""
    for lo, hi in ((1, 21), (21, 31)):
        q = run_dedup(spark, tmpdir_path, [(k, "a@x.com") for k in reversed(range(lo, hi))] + [(lo + 100, ""), (lo + 101, None)])
    got = {r.line_number: (r.dup_number, r.is_duplicate, r.original_line) for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    assert got == {k: (k, k > 1, 1 if k > 1 else None) for k in range(1, 31)} | {k: (None, False, None) for k in (101, 102, 121, 122)}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_a_micro_batch_touches_only_its_own_keys(spark, tmpdir_path, small_batches):
    run_dedup(spark, tmpdir_path, [(k, f"u{k}@x.com") for k in range(60)])
    q = run_dedup(spark, tmpdir_path, [(100, "u7@x.com"), (101, "new@x.com")])
    state = q.lastProgress["stateOperators"][0]
    assert (state["numRowsTotal"], state["numRowsUpdated"]) == (61, 2)
    late = {r.line_number: r.dup_number for r in spark.read.parquet(f"{tmpdir_path}/out").filter("line_number >= 100").collect()}
    assert late == {100: 2, 101: 1}


def test_keys_are_forgotten_after_their_time(spark, tmpdir_path, small_batches):
    spark.createDataFrame([(1, "a@x.com")], ROWS).write.mode("append").parquet(f"{tmpdir_path}/in")
    stream = R.file_stream(spark, f"{tmpdir_path}/in", StructType.fromDDL(ROWS))
    q = (RS.dedup_stream(stream, ttl_ms=500).writeStream.format("parquet").option("path", f"{tmpdir_path}/out")
         .option("checkpointLocation", f"{tmpdir_path}/ckpt").trigger(processingTime="300 milliseconds").start())
    try:
        end, left = time.time() + 60, None
        while time.time() < end and left != 0:
            time.sleep(0.3)
            progress = q.lastProgress
            if progress and progress["batchId"] and progress["stateOperators"]:
                left = progress["stateOperators"][0]["numRowsTotal"]
        assert left == 0
    finally:
        q.stop()


def events(n, seed=1):
    rnd = random.Random(seed)
    t0, out = dt.datetime(2024, 1, 1), []
    for k in range(n):
        kind = rnd.choice([S.PHASE_CHANGE, S.BATCH_START, S.BATCH_COMPLETE, S.BATCH_COMPLETE, S.RECORD_PROCESSED, S.ERROR_OCCURRED, S.SESSION_COMPLETE])
        out.append((rnd.choice([1, 1, 1, 2, 3]), t0 + dt.timedelta(seconds=rnd.randrange(n)), k, kind, rnd.choice([True, False, None]),
                    rnd.choice([0.0, 5.0, 12.5]) if kind == S.BATCH_COMPLETE else None, f"p{k % 3}" if kind == S.PHASE_CHANGE else None,
                    k if kind == S.BATCH_START else None))
    return out


EVENTS = "session_id long, ts timestamp, seq long, type string, success boolean, duration_ms double, phase string, batch_number long"


def test_fold_equals_the_batch_result_in_any_order(spark, tmpdir_path, small_batches):
    rows = events(900)
    for part in (rows[0::3], rows[1::3], rows[2::3]):  # late events in every micro-batch
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(f"{tmpdir_path}/in")
        stream = R.file_stream(spark, f"{tmpdir_path}/in", StructType.fromDDL(EVENTS))
        R.run_available_now(RS.progress_stream(stream), None, f"{tmpdir_path}/ckpt", "update",
                            foreach_batch=R.autosave(f"{tmpdir_path}/saves", ("active", "completed", "failed")))
    ev = spark.createDataFrame(rows, EVENTS)
    want = {r.session_id: r for r in S.tracker_stats(ev).collect()}
    mean = {r.session_id: r.ema_batch_ms for r in S.batch_time_ema(ev).collect()}
    got = {r.session_id: r for r in R.read_saves(spark, f"{tmpdir_path}/saves").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        w = want[k].asDict()
        assert {c: r[c] for c in w} == w
        assert r.ema_batch_ms == pytest.approx(mean[k], abs=2e-6)


def test_a_retried_save_and_a_compaction_change_nothing(spark, tmpdir_path):
    rows = "session_id long, status string, processed long"
    save = R.autosave(tmpdir_path)
    for batch_id, part in ((0, [(1, "active", 5), (2, "active", 1)]), (1, [(1, "active", 9), (3, "paused", 2)]), (1, [(1, "active", 9), (3, "paused", 2)]),
                           (2, [(2, "active", 4)])):
        save(spark.createDataFrame(part, rows), batch_id)
    want = {1: 9, 2: 4}

    def saved():
        return {r.session_id: r.processed for r in R.read_saves(spark, tmpdir_path).collect()}

    assert saved() == want
    for _ in range(2):
        R.compact_saves(spark, tmpdir_path, 1)
        assert saved() == want
    save(spark.createDataFrame([(1, "active", 11)], rows), 3)
    R.compact_saves(spark, tmpdir_path, 3)
    assert saved() == {1: 11, 2: 4}


def test_numbers_go_on_after_a_restart(spark, tmpdir_path):
    seen = []

    def sink(df, no):
        seen.append((no, sorted((r.line_number, r.chunk_no) for r in df.collect())))

    for lo in (0, 70):
        spark.createDataFrame([(k, f"u{k}@x.com") for k in range(lo + 1, lo + 71)], ROWS).write.mode("append").parquet(f"{tmpdir_path}/in")
        totals = R.stream_contacts(spark, f"{tmpdir_path}/in", StructType.fromDDL(ROWS), sink, f"{tmpdir_path}/ckpt", fmt="parquet",
                                   chunk_rows=100, order_col="line_number")
    assert totals == (2, 140) and [no for no, _ in seen] == [1, 2]
    chunks = dict(x for _, rows in seen for x in rows)
    assert [chunks[k] for k in (1, 70, 71, 100, 101, 140)] == [1, 1, 1, 1, 2, 2]
