"""Delivery with a stub sender (send-once, resume) and the streaming helpers."""

import os
import datetime as dt

from pyspark.sql import functions as F

from rosterspark.operators import delivery as D
from rosterspark.operators import rules
from rosterspark.plans import jobs as J
from rosterspark.streaming import jobs as R


def _no_wait(_s):
    return None


def _contacts(spark, n=40):
    rows = [(i, f"user{i}@x.com" if i % 7 else f"bad{i}", "A", "B", "+1234567890") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "line_number long, email string, first_name string, last_name string, phone_number string")


def test_pacing_token_bucket(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 13)], "line_number long")
    p = D.pacing(D.plan_batches(df, 5), rate_per_s=1.0, burst=2, delay_ms=1000).orderBy("seq").collect()
    assert [r.batch_no for r in p] == [1] * 5 + [2] * 5 + [3] * 2
    assert [r.planned_offset_ms for r in p][:4] == [0, 0, 1000, 2000]
    assert p[5].planned_offset_ms == 4000  # max(token 4000, batch start 1000)


def test_estimate_text(spark):
    df = spark.createDataFrame([(10000,), (3,)], "n long")
    ms, text = D.estimate_duration(F.col("n"), 5, 1000)
    got = df.select(ms, text).collect()
    assert (got[0][0], got[0][1]) == (3000000, "50m 0s") and (got[1][0], got[1][1]) == (1500, "1s")


def test_deliver_send_once_and_resume(spark, tmpdir_path):
    calls = os.path.join(tmpdir_path, "calls")
    os.makedirs(calls)

    def flaky(payload, key):
        # record every call on disk (executors are separate threads in local mode)
        with open(os.path.join(calls, key.replace(":", "_").replace("@", "_")), "a") as fh:
            fh.write("x")
        if payload.get("email", "").startswith("user3"):
            return {"status": 401}  # not retryable: fails in this run
        return {"status": 200}

    ledger = os.path.join(tmpdir_path, "ledger")
    run = J.import_contacts(_contacts(spark), "s1", sender=flaky, ledger_path=ledger, rate_per_s=1e6, burst=100,
                            delay_ms=0, concurrency=3, sleep=_no_wait)
    res = run.results.collect()
    ok = [r for r in res if r.success]
    bad = [r for r in res if not r.success]
    assert len(res) == 35 and all(r.error_code == "AUTH_ERROR" for r in bad)
    assert run.rejects.count() == 5  # invalid e-mails are rejected by the gate, never sent
    first_calls = {f: len(open(os.path.join(calls, f)).read()) for f in os.listdir(calls)}
    assert all(v == 1 for v in first_calls.values())  # auth errors are not retried

    def healed(payload, key):
        with open(os.path.join(calls, key.replace(":", "_").replace("@", "_")), "a") as fh:
            fh.write("x")
        return {"status": 200}

    run2 = J.import_contacts(_contacts(spark), "s1", sender=healed, ledger_path=ledger, rate_per_s=1e6, burst=100,
                             delay_ms=0, concurrency=2, sleep=_no_wait)
    total = {f: len(open(os.path.join(calls, f)).read()) for f in os.listdir(calls)}
    resent = {f for f in total if total[f] == 2}
    assert len(resent) == len(bad)  # only the remainder was sent again
    assert all(total[f] == 1 for f in total if f not in resent)
    ledger_rows = run2.results.filter("success").select("contact_id").distinct().count()
    assert ledger_rows == 35


def test_retry_then_success_counts_attempts(spark, tmpdir_path):
    state = {}

    def once_503(payload, key):
        n = state.get(key, 0)
        state[key] = n + 1
        return {"status": 503} if n == 0 else {"status": 200}

    df = J.import_contacts(_contacts(spark, 6), "s2", sender=once_503, ledger_path=os.path.join(tmpdir_path, "l"),
                           rate_per_s=1e6, burst=10, delay_ms=0, sleep=_no_wait).results.collect()
    assert all(r.success and r.attempts == 2 for r in df)


def test_fail_fast_stops_rest_of_batch(spark, tmpdir_path):
    def fail_user2(payload, key):
        return {"status": 404} if payload.get("email") == "user2@x.com" else {"status": 200}

    res = J.import_contacts(_contacts(spark, 12), "s3", sender=fail_user2, ledger_path=os.path.join(tmpdir_path, "l"),
                            rate_per_s=1e6, burst=10, delay_ms=0, fail_fast=True, batch_size=5,
                            sleep=_no_wait).results
    sent = {r.contact_id for r in res.collect()}
    assert "user2@x.com" in sent and "user3@x.com" not in sent and "user6@x.com" in sent


def test_dry_run_sends_nothing(spark):
    run = J.import_contacts(_contacts(spark), "dry", dry_run=True)
    assert run.results is None and run.planned.count() == 40
    assert run.duration_estimate.first().records == 35


def test_stream_contacts_chunks(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "stream_in")
    os.makedirs(d)
    for i in range(3):
        with open(os.path.join(d, f"f{i}.csv"), "w") as fh:
            fh.write("email,first_name\n" + "".join(f"u{i}_{j}@x.com,N\n" for j in range(4)))
    seen = []
    schema = "email string, first_name string"
    from pyspark.sql.types import StructType
    batches, rows = R.stream_contacts(spark, d, StructType.fromDDL(schema), lambda df, no: seen.append((no, df.count())),
                                      os.path.join(tmpdir_path, "ck"), batch_size=1)
    assert rows == 12 and batches == 3 and [n for n, _ in seen] == [1, 2, 3]


def test_watch_sessions_emits_changes_only(spark, tmpdir_path):
    snap = os.path.join(tmpdir_path, "snap")
    fn = R.watch_sessions(spark, snap)
    t = dt.datetime(2024, 1, 1)
    b0 = spark.createDataFrame([("a", 1, t, "running", 1), ("b", 2, t, "running", 1)],
                               "session_id string, seq long, ts timestamp, status string, processed long")
    fn(b0, 0)
    b1 = spark.createDataFrame([("a", 3, t, "running", 1), ("b", 4, t, "completed", 5)],
                               "session_id string, seq long, ts timestamp, status string, processed long")
    fn(b1, 1)
    ch = spark.read.parquet(os.path.join(snap, "changes"))
    assert sorted((r.batch_id, r.session_id, r.change) for r in ch.collect()) == [
        (0, "a", "added"), (0, "b", "added"), (1, "b", "changed")]


def test_error_triage_columns(spark):
    from rosterspark.operators import triage as G

    df = spark.createDataFrame([("NetworkError", "x"), ("Error", "Subscriber validation failed: y"),
                                ("RateLimitError", "Rate limit exceeded"), ("TimeoutError", "timed out")],
                               "error_name string, error_message string")
    got = {r.category: r.errors for r in G.categorize_errors(df).collect()}
    assert got == {"network_error": 1, "validation_error": 1, "rate_limit_error": 1, "unknown_error": 1}


def test_stream_contacts_row_chunks(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "chunks_in")
    rows = [(i, f"u{i}@x.com") for i in range(1, 251)]
    for part, lo in enumerate((0, 120)):
        spark.createDataFrame(rows[lo:lo + 120] if part == 0 else rows[120:], "line_number long, email string") \
            .write.mode("append").parquet(d)
    got = []
    from pyspark.sql.types import StructType
    R.stream_contacts(spark, d, StructType.fromDDL("line_number long, email string"),
                      lambda df, no: got.extend((r.line_number, r.chunk_no) for r in df.collect()),
                      os.path.join(tmpdir_path, "ck2"), fmt="parquet", chunk_rows=100, order_col="line_number")
    chunk_of = dict(got)
    assert len(chunk_of) == 250 and max(chunk_of.values()) == 3
    assert sorted(v for v in chunk_of.values()).count(1) == 100 and list(chunk_of.values()).count(3) == 50
