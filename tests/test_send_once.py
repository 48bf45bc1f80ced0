"""Slices, intents and leases of the delivery (X3, X7), marks with their time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterspark.operators import delivery as D
from rosterspark.plans.jobs import stub_sender


def planned(spark, n=60):
    df = spark.createDataFrame([(k, f"u{k}@x.com", "A", "B", "") for k in range(1, n + 1)],
                               "line_number long, email string, first_name string, last_name string, phone_number string")
    return D.plan_batches(df, 5).withColumn("contact_id", F.col("email"))


def send(spark, to_send, ledger, **kw):
    return D.deliver(to_send, kw.pop("sender", stub_sender), ledger, "s", rate_per_s=1e6, burst=1000, sleep=lambda _s: None, **kw)


def test_a_killed_run_repeats_one_slice(spark, tmpdir_path):
    ledger, rows = f"{tmpdir_path}/ledger", planned(spark)

    def die(number):
        if number == 1:
            raise KeyError("died")

    with pytest.raises(KeyError):
        send(spark, rows, ledger, slice_batches=4, before_results=die)
    assert D.read_ledger(spark, ledger).count() == 20
    assert {r.slice for r in D.in_doubt(spark, ledger, "s").collect()} == {1}
    with pytest.raises(RuntimeError, match="slice 1"):  # the lease is still held
        send(spark, rows, ledger, slice_batches=4)
    D.release(spark, ledger, "s")
    results = send(spark, rows, ledger, slice_batches=4)
    assert results.count() == 60
    tries = {r.contact_id: r["count"] for r in D.read_intents(spark, ledger).groupBy("contact_id").count().collect()}
    twice = {c for c, n in tries.items() if n == 2}
    ok = {r.contact_id for r in results.filter("success").collect()}
    again = {f"u{k}@x.com" for k in range(1, 21)} - ok  # failures before the kill are sent again
    assert {f"u{k}@x.com" for k in range(21, 41)} - twice == set() and twice - {f"u{k}@x.com" for k in range(21, 41)} <= again
    assert max(tries.values()) <= 3 and len(tries) == 60


def test_more_senders_than_tokens(spark, tmpdir_path):
    """concurrency is kept; the burst is shared out in parts of a token."""
    slept = []

    def run(rows):
        import pandas as pd

        fn = D._send_partition(lambda p, k: {"status": 200}, "s", 1, 1.0, 0.25, False, slept.append, 0)
        return list(fn([pd.DataFrame(rows)]))

    out = run([{"contact_id": "a", "batch_no": 1, "seq": 1, "payload": {}}])
    assert out[0].success.tolist() == [True] and slept and 0.5 < slept[0] <= 0.75


def test_data_error_and_time_of_results(spark, tmpdir_path):
    def sender(payload, key):
        if payload["email"].startswith("u1@"):
            raise OSError("no route")
        return {"status": 200, "data": {"id": 7, "a": None}}

    rows = planned(spark, 3)
    results = send(spark, rows, f"{tmpdir_path}/l", sender=sender, max_attempts=1)
    got = {r.contact_id: (r.success, r.data, r.error) for r in results.collect()}
    assert got["u1@x.com"] == (False, None, "no route") and got["u2@x.com"] == (True, '{"a": null, "id": 7}', None)
    marks = D.with_processed_marks(rows.select("contact_id"), results).collect()
    assert all(isinstance(m.processed_at, dt.datetime) and m.processed for m in marks)


def test_a_lookup_reads_one_bucket(spark, tmpdir_path):
    from rosterspark.operators import dedup

    df = spark.createDataFrame([(k, f"u{k % 200}@x.com" if k % 3 else "hot@x.com") for k in range(3000)], "line_number long, email string")
    marked = dedup.mark_duplicates(df)
    dedup.write_key_index(marked, f"{tmpdir_path}/keys", 16)
    index = spark.read.parquet(f"{tmpdir_path}/keys")
    for key in ("u7@x.com", "hot@x.com", "nobody@x.com"):
        found = dedup.lookup_key(index, key, 16)
        want = marked.filter(F.col("dup_key") == key)
        assert sorted(r.line_number for r in found.collect()) == sorted(r.line_number for r in want.collect())
        scan = [p for p in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in p]
        assert len(scan) == 1 and "PushedFilters: [IsNotNull(dup_key), EqualTo(dup_key" in scan[0] and "PartitionFilters: [isnotnull(bucket" in scan[0]
        folders = {f.rsplit("/", 2)[1] for f in found.inputFiles()}
        touched = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
        assert len({f.rsplit("/", 2)[1] for f in touched}) <= 1 and len(folders) >= 1
