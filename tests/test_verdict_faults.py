"""Faults found in review, each with the smallest input that showed it."""

from datetime import datetime

from rosterspark.operators import dedup, delivery, rules
from rosterspark.plans.catalog import QUERIES
from rosterspark.plans.jobs import import_contacts
from rosterspark.sources import files as FS

CONTACT = "line_number long, email string, first_name string, last_name string, phone_number string"


def contacts(spark, emails):
    return spark.createDataFrame([(k + 1, e, "An", "Bo", "+12025550100") for k, e in enumerate(emails)], CONTACT)


def test_appended_csv_parts_lose_no_row(spark, tmpdir_path):
    path = f"{tmpdir_path}/c"
    for part in (range(6), range(6, 12)):
        FS.write_contacts(spark.createDataFrame([(f"u{k}@x.com", f"n{k}") for k in part], "email string, first_name string"), path, append=True)
    got, quarantine, _ = FS.read_contacts(spark, path)
    assert {r.email for r in got.collect()} == {f"u{k}@x.com" for k in range(12)} and quarantine.count() == 0


def test_quoted_line_break_is_one_record(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write('email,first_name\nn@x.com,"An\nn"\nb@x.com,Bo\n')
    got, _, _ = FS.read_contacts(spark, f"{tmpdir_path}/a.csv")
    assert [(r.line_number, r.email, r.first_name) for r in got.orderBy("line_number").collect()] == [(1, "n@x.com", "An\nn"), (2, "b@x.com", "Bo")]


def test_merged_findings_are_counted_again(spark):
    v = rules.validate(contacts(spark, ["bad", None]))
    for r in rules.merge_findings(v, v).collect():
        assert r.error_count == sum(f.severity == "error" for f in r.findings) and r.error_count + r.warning_count == len(r.findings)


def test_import_without_rules_still_gates(spark, tmpdir_path):
    run = import_contacts(contacts(spark, ["a@x.com", None, "bad"]), "s", sender=lambda p, k: {"status": 200},
                          ledger_path=f"{tmpdir_path}/ledger", skip_validation=True, skip_dedup=True, delay_ms=0, sleep=lambda s: None)
    assert run.results.count() == 1 and run.rejects.count() == 2


def test_results_are_the_latest_of_each_contact(spark):
    row = lambda c, ok, at: ("s", c, 1, 1, ok, None, None, 1, 5, None, datetime(2024, 1, at), None, None)
    led = spark.createDataFrame([row("a", False, 1), row("a", True, 2), row("b", True, 1)], delivery.RESULT_SCHEMA)
    assert {(r.contact_id, r.success) for r in delivery.latest_results(led).collect()} == {("a", True), ("b", True)}


def test_numbering_goes_on_across_runs(spark, tmpdir_path):
    first = dedup.mark_duplicates(contacts(spark, ["a@x.com", "a@x.com", "b@x.com"]))
    dedup.remember_keys(first, f"{tmpdir_path}/seen")
    got = dedup.mark_across_runs(contacts(spark, ["a@x.com", "c@x.com", "a@x.com"]), spark.read.parquet(f"{tmpdir_path}/seen"))
    rows = [(r.line_number, r.dup_number, r.is_duplicate, r.original_line) for r in got.orderBy("line_number").collect()]
    assert [r[:3] for r in rows] == [(1, 3, True), (2, 1, False), (3, 4, True)] and rows[0][3] == rows[2][3] == 1


def test_blank_keys_stay_no_duplicates_across_runs(spark, tmpdir_path):
    dedup.remember_keys(dedup.mark_duplicates(contacts(spark, ["", None, "a@x.com"])), f"{tmpdir_path}/seen")
    got = dedup.mark_across_runs(contacts(spark, ["", None, "a@x.com"]), spark.read.parquet(f"{tmpdir_path}/seen"))
    assert [(r.dup_number, r.is_duplicate, r.original_line) for r in got.orderBy("line_number").collect()] == [(None, False, None), (None, False, None), (2, True, 3)]


def test_totals_of_no_results_are_zero(spark):
    t = delivery.combined_batch_stats(spark.createDataFrame([], delivery.RESULT_SCHEMA)).first()
    assert (t.total_batches, t.total_requests, t.successful, t.failed, t.success_rate) == (0, 0, 0, 0, 0)


def test_plans_without_self_joins(spark):
    sf = "/root/testdata/sf0.001"
    for name, scans, joins in (("latest_resumable", 1, 0), ("final_outcomes", 1, 0)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == scans and plan.count("Join") == joins and "Window" not in plan, plan
