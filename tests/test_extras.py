"""Operators without a registered query: exports, cross-run dedup, merge, custom keys, observers."""

import datetime as dt
import os

from pyspark.sql import functions as F

from rosterspark.operators import dedup, rules, sessions
from rosterspark.operators.observe import ProgressListener, with_progress_metrics
from rosterspark.sources import files as FS

SCHEMA = "line_number long, email string, first_name string, last_name string, phone_number string"


def test_export_delivery_report_and_sessions(spark, tmpdir_path):
    res = spark.createDataFrame([(1, "a@x.com", True, "ok"), (2, "b@x.com", False, 'said "no"')],
                                "line_number long, contact_id string, success boolean, message string")
    out = os.path.join(tmpdir_path, "deliv")
    FS.export_delivery_report(res, out, "csv")
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines == ["Type,Row,Email,Status,Message", 'Success,1,"a@x.com",Imported,"ok"',
                     'Error,2,"b@x.com",Failed,"said ""no"""']
    FS.export_delivery_report(res, out + "_dry", "csv", dry_run=True)
    assert "Invalid" in [r.value for r in spark.read.text(out + "_dry").collect()][2]
    s = spark.createDataFrame([(7, "paused", 10, 4, 3, 1, dt.datetime(2024, 1, 1), "f.csv")],
                              "session_id long, status string, total long, processed long, successful long, "
                              "failed long, start_time timestamp, csv_file string")
    exp = sessions.sessions_export(s, F.lit("2024-01-01 01:02:03").cast("timestamp"))
    row = exp.first()
    assert row["Success Rate"] == 30 and row["Duration"] == "1h 2m" and len(exp.columns) == 11
    FS.export_sessions(exp, os.path.join(tmpdir_path, "sess"), "csv")
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "sess")).first()
    assert back["Session ID"] == "7" and back["Started"].startswith("2024-01-01T00:00:00")


def test_dedup_across_runs(spark, tmpdir_path):
    run1 = spark.createDataFrame([(1, "a@x.com", "", "", ""), (2, "b@x.com", "", "", "")], SCHEMA)
    run2 = spark.createDataFrame([(3, "A@x.com ", "", "", ""), (4, "c@x.com", "", "", "")], SCHEMA)
    seen = os.path.join(tmpdir_path, "seen")
    dedup.remember_keys(dedup.mark_duplicates(run1), seen)
    fresh = dedup.mark_across_runs(run2, spark.read.parquet(seen)).filter("dup_number = 1")
    assert [r.line_number for r in fresh.collect()] == [4]


def test_duplicate_group_lookup(spark):
    df = spark.createDataFrame([(1, "a@x.com", "", "", ""), (2, "A@x.com", "", "", ""), (3, "b@x.com", "", "", "")],
                               SCHEMA)
    g = dedup.duplicate_group(df, "a@x.com").collect()
    assert len(g) == 1 and g[0].total_count == 2 and g[0].original_line == 1
    assert dedup.has_duplicates(df, "a@x.com") and not dedup.has_duplicates(df, "b@x.com")


def test_custom_dedup_key(spark):
    df = spark.createDataFrame([(1, "a@x.com", "Ann", "", ""), (2, "z@x.com", "ann", "", "")], SCHEMA)

    def by_first_name():
        return F.lower(F.col("first_name"))

    m = dedup.mark_duplicates(df, by_first_name)
    assert [r.dup_number for r in m.orderBy("line_number").collect()] == [1, 2]


def test_merge_findings(spark):
    df = spark.createDataFrame([(1, "a@x.con", "", "", "123")], SCHEMA)
    a = rules.validate(df, rules=["email"])
    b = rules.validate(df, rules=["phone"])
    m = rules.merge_findings(a, b).first()
    assert [f.code for f in m.findings] == ["POSSIBLE_TYPO", "INVALID_PHONE_FORMAT"] and m.is_valid is False


def test_observation_and_listener(spark):
    df = spark.createDataFrame([(1, "a@x.com", "", "", ""), (2, "bad", "", "", "")], SCHEMA)
    observed, obs = with_progress_metrics(rules.validate(df))
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"processed": 2, "valid": 1, "invalid": 1}
    seen = []
    lst = ProgressListener(on_progress=[lambda p: 1 / 0, seen.append])
    lst._call(lst.on_progress, {"batch_id": 0})
    assert seen == [{"batch_id": 0}] and len(lst.errors) == 1  # a failing observer is isolated


def test_dedup_report_and_run_rows(spark):
    from rosterspark.operators import report

    df = spark.createDataFrame([(1, "a@x.com", "Ann", "A", ""), (2, "A@x.com", "Ann", "A", ""),
                                (3, "b@x.com", "Bo", "B", "")], SCHEMA)
    stats, groups = dedup.dedup_report(dedup.mark_duplicates(df))
    s = stats.first()
    assert (s.total_records, s.unique_records, s.duplicate_records, s.duplicate_groups) == (3, 2, 1, 1)
    g = groups.first()
    assert g.total_count == 2 and g.original_email == "a***@x.com" and g.original_line == 1
    run = report.summary_as_run(report.validation_summary(rules.validate(df)), "r1", "2024-01-01 00:00:00")
    totals = report.run_totals(run.unionByName(run)).first()
    assert totals.runs == 2 and totals.records == 6 and totals.successful == 6  # a duplicate is still valid


def test_autosave_and_stream_delivery(spark, tmpdir_path):
    import time as _t

    from rosterspark.operators import delivery as D
    from rosterspark.plans import jobs as J
    from rosterspark.streaming import jobs as R

    src = os.path.join(tmpdir_path, "src")
    state = spark.createDataFrame([("s1", 1, dt.datetime(2024, 1, 1), "processing", 10, 3)],
                                  "session_id string, checkpoint_id long, ts timestamp, status string, total long, processed long")
    state.write.parquet(src)
    stream = R.file_stream(spark, src, state.schema, "parquet")
    for _ in range(2):  # a retried micro-batch replaces its own saves
        R.autosave(os.path.join(tmpdir_path, "ck"), ("processing",))(spark.read.parquet(src), 0)
    R.run_available_now(stream, None, os.path.join(tmpdir_path, "q"), foreach_batch=R.autosave(os.path.join(tmpdir_path, "ck2"), ("processing",)))
    for folder in ("ck", "ck2"):
        assert [(r.session_id, r.processed) for r in R.read_saves(spark, os.path.join(tmpdir_path, folder)).collect()] == [("s1", 3)]

    contacts = spark.createDataFrame([(i, f"u{i}@x.com", "A", "B", "") for i in range(1, 9)], SCHEMA)
    csrc = os.path.join(tmpdir_path, "contacts")
    contacts.write.parquet(csrc)
    ledger = os.path.join(tmpdir_path, "ledger")

    def deliver_batch(df, batch_id):
        planned = D.plan_batches(rules.validate(df), 5).withColumn("contact_id", F.lower("email"))
        D.deliver(planned.filter("is_valid"), J.stub_sender, ledger, "stream-1", rate_per_s=1e6, burst=100,
                  sleep=lambda _s: None)

    for _ in range(2):  # a rerun of the stream from scratch must not send anything twice
        s2 = R.file_stream(spark, csrc, contacts.schema, "parquet")
        R.run_available_now(s2, None, os.path.join(tmpdir_path, f"q2-{_t.time()}"),
                            foreach_batch=R.stream_deliver(deliver_batch))
    led = D.read_ledger(spark, ledger).filter("success")
    assert led.count() == led.select("contact_id").distinct().count()


def test_validate_report_job(spark):
    from rosterspark.plans.jobs import validate_report
    from rosterspark.sources import fixtures

    from conftest import SF01

    rep = validate_report(fixtures.contacts(spark, SF01))
    s = rep.summary.first()
    assert (s.total_records, s.valid_records, s.duplicates_found) == (1500, 917, 232)
    top = rep.by_domain.orderBy("rank").first()
    assert (top.domain, top.total, top.valid) == ("gmail.com", 225, 174)
    assert rep.duplicates.count() == 232 and rep.duplicates.filter(F.col("email").contains("***@")).count() == 232


def test_read_contacts_keeps_original(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "orig")
    os.makedirs(d)
    with open(os.path.join(d, "c.csv"), "w") as fh:
        fh.write("Email,fname,extra\nA@x.com,Ann,1\n")
    contacts, _q, _c = FS.read_contacts(spark, d, keep_original=True)
    r = contacts.first()
    assert r.email == "A@x.com" and r.first_name == "Ann" and r.original == {"Email": "A@x.com", "fname": "Ann", "extra": "1"}
