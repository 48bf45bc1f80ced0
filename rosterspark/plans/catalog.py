"""Registered queries: name -> ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables through the fixture views (so its work
grows with them) and calls the library operators.  The DuckDB side of each
lives in ``oracle_sql.ORACLE`` under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import constants as K
from ..operators import dedup, report, rules
from ..sources import fixtures
from ..sources.contacts import normalize_columns, to_contact

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validate(fixtures.contacts(spark, sf_dir))


def _valid(spark, sf_dir):
    return _validated(spark, sf_dir).filter("is_valid")


@query("contacts_normalized")
def contacts_normalized(spark, sf_dir):
    c = fixtures.contacts(spark, sf_dir)
    # present the fixture under alias headers, then normalise them back
    raw = c.select(
        "line_number",
        F.col("email").alias("EMAIL"),
        F.col("first_name").alias("firstName"),
        F.col("last_name").alias("LastName"),
        F.col("phone_number").alias("phone"),
    )
    contact = to_contact(normalize_columns(raw), with_created_at=False)
    return contact.select(
        "line_number",
        "email",
        "first_name",
        "last_name",
        "phone_number",
        "source",
        X.full_name().alias("full_name"),
        X.has_valid_email().alias("has_valid_email"),
        X.has_phone().alias("has_phone"),
        X.has_valid_phone().alias("has_valid_phone"),
        X.email_domain().alias("email_domain"),
        X.contact_id().alias("contact_id"),
    )


@query("contacts_masked")
def contacts_masked(spark, sf_dir):
    c = fixtures.contacts(spark, sf_dir)
    return c.select(
        "line_number",
        X.mask_email().alias("masked_email"),
        X.mask_phone().alias("masked_phone"),
        X.mask_phone_tail().alias("phone_tail"),
    )


@query("delivery_payloads")
def delivery_payloads(spark, sf_dir):
    c = fixtures.contacts(spark, sf_dir)
    return c.select("line_number", X.contact_id().alias("contact_id"), X.delivery_payload().alias("payload"))


@query("validation_findings")
def validation_findings(spark, sf_dir):
    return rules.explode_findings(_validated(spark, sf_dir))


@query("validation_status")
def validation_status(spark, sf_dir):
    return rules.finding_summary(_validated(spark, sf_dir))


@query("validation_summary")
def validation_summary(spark, sf_dir):
    return report.validation_summary(_validated(spark, sf_dir))


@query("domain_stats")
def domain_stats(spark, sf_dir):
    return report.stats_by_domain(_validated(spark, sf_dir))


@query("code_stats")
def code_stats(spark, sf_dir):
    return report.stats_by_code(_validated(spark, sf_dir))


@query("phone_stats")
def phone_stats(spark, sf_dir):
    return report.stats_by_phone(fixtures.contacts(spark, sf_dir))


@query("common_issues")
def common_issues(spark, sf_dir):
    return report.common_issues(_validated(spark, sf_dir))


@query("errors_by_code")
def errors_by_code(spark, sf_dir):
    return report.errors_by_code(_validated(spark, sf_dir))


@query("quarantine")
def quarantine(spark, sf_dir):
    return report.quarantine(_validated(spark, sf_dir))


@query("findings_preview")
def findings_preview(spark, sf_dir):
    return report.findings_preview(_validated(spark, sf_dir))


def _dup(strategy):
    def run(spark, sf_dir):
        m = dedup.mark_duplicates(_valid(spark, sf_dir), strategy)
        return m.select("line_number", "dup_key", "dup_number", "is_duplicate", "original_line")

    return run


for _s in ("email", "email_phone", "strict"):
    QUERIES[f"dup_{_s}"] = _dup(_s)


@query("dup_groups")
def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(_valid(spark, sf_dir), "email")


@query("dup_stats")
def dup_stats(spark, sf_dir):
    return dedup.dedup_stats(_valid(spark, sf_dir), "email")


@query("unique_contacts")
def unique_contacts(spark, sf_dir):
    v = _valid(spark, sf_dir).select("line_number", "email", "first_name", "last_name", "phone_number")
    return dedup.unique_contacts(v, "email")


# --- sessions, progress events, checkpoints ----------------------------------

from ..operators import sessions as S  # noqa: E402

AS_OF = "2002-01-01 00:00:00"  # evaluation time for elapsed-time figures
SNAPSHOT_CUT = "2001-01-01 00:00:00"  # sessions started later are absent from the older snapshot


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("session_overview")
def session_overview(spark, sf_dir):
    return S.session_overview(fixtures.sessions(spark, sf_dir))


@query("session_progress")
def session_progress(spark, sf_dir):
    return S.session_progress(fixtures.sessions(spark, sf_dir), _as_of())


@query("resumable")
def resumable(spark, sf_dir):
    return S.resumable(fixtures.sessions(spark, sf_dir))


@query("resumable_overview")
def resumable_overview(spark, sf_dir):
    return S.resumable_overview(fixtures.sessions(spark, sf_dir))


@query("latest_resumable")
def latest_resumable(spark, sf_dir):
    return S.latest_resumable(fixtures.sessions(spark, sf_dir))


@query("session_diff")
def session_diff(spark, sf_dir):
    s = fixtures.sessions(spark, sf_dir)
    old = s.filter(F.col("start_time") < F.lit(SNAPSHOT_CUT).cast("timestamp_ntz"))
    running = F.col("status") == "running"
    new = s.filter(F.col("status") != "cancelled").select(
        "session_id",
        F.when(running, F.lit("completed")).otherwise(F.col("status")).alias("status"),
        F.when(running, F.col("total")).otherwise(F.col("processed")).alias("processed"),
    )
    return S.session_diff(old, new)


@query("sessions_export")
def sessions_export(spark, sf_dir):
    return S.sessions_export(fixtures.sessions(spark, sf_dir), _as_of())


@query("run_totals")
def run_totals(spark, sf_dir):
    return report.run_totals(fixtures.sessions(spark, sf_dir))


@query("progress_timeline")
def progress_timeline(spark, sf_dir):
    return S.progress_timeline(fixtures.progress_events(spark, sf_dir))


@query("batch_time_mean")
def batch_time_mean(spark, sf_dir):
    return S.batch_time_mean(fixtures.progress_events(spark, sf_dir))


@query("batch_time_ema")
def batch_time_ema(spark, sf_dir):
    return S.batch_time_ema(fixtures.progress_events(spark, sf_dir))


@query("phase_intervals")
def phase_intervals(spark, sf_dir):
    return S.phase_intervals(fixtures.progress_events(spark, sf_dir))


@query("session_event_stats")
def session_event_stats(spark, sf_dir):
    return S.session_event_stats(fixtures.progress_events(spark, sf_dir))


@query("latest_checkpoint")
def latest_checkpoint(spark, sf_dir):
    return S.latest_checkpoint(fixtures.checkpoints(spark, sf_dir))


@query("checkpoint_retention")
def checkpoint_retention(spark, sf_dir):
    return S.checkpoint_retention(fixtures.checkpoints(spark, sf_dir))


@query("checkpoints_to_delete")
def checkpoints_to_delete(spark, sf_dir):
    return S.checkpoints_to_delete(fixtures.checkpoints(spark, sf_dir)).select("session_id", "checkpoint_id")


@query("resumable_checkpoints")
def resumable_checkpoints(spark, sf_dir):
    return S.resumable_checkpoints(fixtures.checkpoints(spark, sf_dir))


# --- delivery -----------------------------------------------------------------

from ..operators import delivery as D  # noqa: E402

RATE_PER_S, BURST, DELAY_MS, BATCH = 1.0, 2, 1000, 5


def _kept(spark, sf_dir):
    """Import path: all rows, dup-marked by e-mail (Q2/Q3), duplicates dropped."""
    m = dedup.mark_duplicates(_validated(spark, sf_dir), "email")
    return m.filter(~F.col("is_duplicate"))


@query("gate_rejects")
def gate_rejects(spark, sf_dir):
    _send, rejects = D.gate(_validated(spark, sf_dir))
    return rejects


@query("batch_plan")
def batch_plan(spark, sf_dir):
    planned = D.plan_batches(_kept(spark, sf_dir), BATCH)
    paced = D.pacing(planned, RATE_PER_S, BURST, DELAY_MS)
    return paced.select("line_number", X.contact_id().alias("contact_id"), "is_valid", "seq", "batch_no",
                        "pos_in_batch", "planned_offset_ms")


@query("duration_estimate")
def duration_estimate(spark, sf_dir):
    n = _kept(spark, sf_dir).filter("is_valid").agg(F.count(F.lit(1)).cast("bigint").alias("records"))
    ms, text = D.estimate_duration(F.col("records"), BATCH, DELAY_MS)
    return n.select("records", ms.alias("estimate_ms"), text.alias("estimate_text"))


@query("attempt_triage")
def attempt_triage(spark, sf_dir):
    a = D.number_attempts(fixtures.delivery_attempts(spark, sf_dir))
    return D.classify_outcome(a, "attempt_no").select(
        "seq", "contact_id", "attempt_no", "success", "error_code", "retryable", "retry_delay_ms")


@query("retry_plan")
def retry_plan(spark, sf_dir):
    return D.retry_plan(fixtures.delivery_attempts(spark, sf_dir))


@query("final_outcomes")
def final_outcomes(spark, sf_dir):
    return D.final_outcomes(fixtures.delivery_attempts(spark, sf_dir))


def _import_results(spark, sf_dir):
    # written once: numbering reads its rows twice, and each time would validate and mark duplicates again
    kept = materialize(_kept(spark, sf_dir).select("line_number", "email", "is_valid"), "import-kept")
    planned = D.plan_batches(kept, BATCH)
    fo = D.final_outcomes(fixtures.delivery_attempts(spark, sf_dir)).select(
        F.col("contact_id").alias("line_number"), F.col("success").alias("_ok"), F.col("error_code").alias("_err"))
    j = planned.join(fo, "line_number", "left")
    return j.select(
        "line_number",
        X.contact_id().alias("contact_id"),
        "batch_no",
        "seq",
        (F.col("is_valid") & F.coalesce(F.col("_ok"), F.lit(False))).alias("success"),
        F.when(~F.col("is_valid"), F.lit(K.ERROR_VALIDATION_FAILED)).otherwise(F.col("_err")).alias("error_code"),
    )


@query("import_results")
def import_results(spark, sf_dir):
    return _import_results(spark, sf_dir)


@query("batch_stats")
def batch_stats(spark, sf_dir):
    return D.per_batch_stats(_import_results(spark, sf_dir))


@query("batch_totals")
def batch_totals(spark, sf_dir):
    return D.combined_batch_stats(_import_results(spark, sf_dir))


@query("delivery_run_stats")
def delivery_run_stats(spark, sf_dir):
    a = D.classify_outcome(fixtures.delivery_attempts(spark, sf_dir))
    return D.delivery_run_stats(a)


@query("session_counters")
def session_counters(spark, sf_dir):
    marked = dedup.mark_duplicates(_validated(spark, sf_dir), "email")
    fo = D.final_outcomes(fixtures.delivery_attempts(spark, sf_dir))
    return D.session_counters(D.outcome_of_contacts(marked, fo))


@query("resume_remainder")
def resume_remainder(spark, sf_dir):
    sendable = _kept(spark, sf_dir).filter("is_valid").select(
        "line_number", X.contact_id().alias("contact_id"))
    done = D.final_outcomes(fixtures.delivery_attempts(spark, sf_dir)).filter("success").select(
        F.col("contact_id").alias("line_number"))
    return D.remainder_after(sendable, done, "line_number")


@query("processed_marks")
def processed_marks(spark, sf_dir):
    v = _valid(spark, sf_dir).select("line_number", "email")
    uniq = dedup.unique_contacts(v, "email").select(F.col("dup_key").alias("contact_id"), "line_number")
    res = _import_results(spark, sf_dir).withColumn(
        "message", F.when(F.col("success"), F.lit("Successfully subscribed")).otherwise(F.col("error_code")))
    return D.with_processed_marks(uniq, res.select("contact_id", "seq", "success", "message"))


# --- triage -------------------------------------------------------------------

from ..operators import triage as G  # noqa: E402


@query("error_categories")
def error_categories(spark, sf_dir):
    _send, rejects = D.gate(_validated(spark, sf_dir))
    gate_errors = rejects.select(F.lit("Error").alias("error_name"), F.col("message").alias("error_message"))
    a = D.classify_outcome(fixtures.delivery_attempts(spark, sf_dir)).filter(~F.col("success"))
    name, msg = G.error_name_message(F.col("error_code"), F.col("retry_after_s"))
    api_errors = a.select(name.alias("error_name"), msg.alias("error_message"))
    return G.categorize_errors(gate_errors.unionByName(api_errors))


@query("quality_issues")
def quality_issues(spark, sf_dir):
    f = rules.explode_findings(_validated(spark, sf_dir))
    issues = f.select(F.col("message").alias("issue"), G.finding_severity(F.col("severity")).alias("severity"))
    return G.quality_issues(issues)


# --- file sources -------------------------------------------------------------

import uuid as _uuid  # noqa: E402

from ..session import materialize, scratch_path  # noqa: E402
from ..sources import files as FS  # noqa: E402


def _csv_folder(spark):
    return scratch_path(spark, f"contacts-csv-{_uuid.uuid4().hex[:12]}")


def _contacts_csv(spark, sf_dir, change=lambda c: c):
    """The folder of the contacts, written as multi-file CSV in input order."""
    path = _csv_folder(spark)
    c = change(fixtures.contacts(spark, sf_dir))
    FS.write_contacts(c.repartitionByRange("line_number").sortWithinPartitions("line_number").drop("line_number"), path)
    return path


@query("csv_contacts")
def csv_contacts(spark, sf_dir):
    """Contacts written as multi-file CSV by Spark, read back and numbered."""
    return FS.read_contacts(spark, _contacts_csv(spark, sf_dir))[0]


@query("csv_quarantine")
def csv_quarantine(spark, sf_dir):
    return FS.read_contacts(spark, _contacts_csv(spark, sf_dir))[1]


@query("csv_read_stats")
def csv_read_stats(spark, sf_dir):
    """Row counts of a CSV read."""
    path = _contacts_csv(spark, sf_dir)
    contacts, empty, _check = FS.read_contacts(spark, path)
    return FS.read_stats(contacts, empty).withColumn("data_rows", F.lit(FS.count_rows(spark, path)).cast("bigint"))


@query("csv_max_rows")
def csv_max_rows(spark, sf_dir):
    """The first 100 data rows (the limit is the feature)."""
    return FS.read_contacts(spark, _contacts_csv(spark, sf_dir), max_rows=100)[0]


@query("csv_quoted_newline")
def csv_quoted_newline(spark, sf_dir):
    """Line breaks, quotes and commas inside cells survive the round trip."""
    broken = F.concat(F.lit('An\n"x", '), F.col("first_name"))
    path = _contacts_csv(spark, sf_dir, lambda c: c.withColumn("first_name", broken))
    return FS.read_contacts(spark, path)[0]


def _halves(spark, sf_dir):
    c = fixtures.contacts(spark, sf_dir)
    odd = F.col("line_number") % 2 == 1
    return c.filter(odd).drop("line_number"), c.filter(~odd).drop("line_number")


@query("csv_append_roundtrip")
def csv_append_roundtrip(spark, sf_dir):
    """Rows of two appended writes; no record is taken for a header."""
    path = _csv_folder(spark)
    for part in _halves(spark, sf_dir):
        FS.write_contacts(part, path, append=True)
    return FS.read_contacts(spark, path)[0].drop("line_number")


@query("csv_mixed_headers")
def csv_mixed_headers(spark, sf_dir):
    """Files with other column orders and names in one folder, each read by its own header."""
    path = _csv_folder(spark)
    first, second = _halves(spark, sf_dir)
    FS.write_contacts(first, path, append=True)
    other = second.select(F.col("phone_number").alias("Phone"), F.lit("x").alias("note"), F.col("last_name").alias("lname"),
                          F.col("first_name").alias("firstName"), F.col("email").alias("EMAIL"))
    FS.write_contacts(other, path, append=True)
    return FS.read_contacts(spark, path, multiline=False)[0].drop("line_number")


@query("csv_wide_files")
def csv_wide_files(spark, sf_dir):
    """A narrow file next to files of 41 columns with line breaks, each read by its own header."""
    path = _csv_folder(spark)
    first, second = _halves(spark, sf_dir)
    FS.write_contacts(first.select("email"), path, append=True)
    wide = second.select(*[F.lit(f"x{i}").alias(f"extra_{i}") for i in range(37)], "phone_number", "last_name",
                         F.concat(F.col("first_name"), F.lit('\n"2", b')).alias("first_name"), "email")
    FS.write_contacts(wide, path, append=True)
    return FS.read_contacts(spark, path)[0].drop("line_number")


@query("csv_count_newlines")
def csv_count_newlines(spark, sf_dir):
    """Rows counted where cells hold line breaks."""
    path = _contacts_csv(spark, sf_dir, lambda c: c.withColumn("last_name", F.concat(F.lit("a\n\nb "), F.col("last_name"))))
    contacts, empty, _check = FS.read_contacts(spark, path)
    return FS.read_stats(contacts, empty).withColumn("data_rows", F.lit(FS.count_rows(spark, path)).cast("bigint"))


@query("header_check")
def header_check(spark, sf_dir):
    """S3: how many files have each error and warning; a file for each e-mail domain, whose header names the domain."""
    path = _csv_folder(spark)
    c = fixtures.contacts(spark, sf_dir).select("line_number", "email", F.split_part("email", F.lit("@"), F.lit(2)).alias("d"))
    c = c.filter(F.col("d").rlike("^[A-Za-z0-9.]+$"))
    heads = c.select("d").distinct().select(F.lit(0).cast("bigint").alias("n"), "d", F.concat(F.lit("mobile,Email,"), F.col("d")).alias("line"))
    lines = heads.unionByName(c.select(F.col("line_number").alias("n"), "d", F.concat(F.lit("1,"), F.col("email"), F.lit(",x")).alias("line")))
    lines = lines.withColumn("g", F.md5("d")).repartition("g").sortWithinPartitions("g", "n")
    lines.select("g", "line").write.partitionBy("g").text(path)
    return FS.header_checks(spark, f"{path}/g=*", ("email", "company")).groupBy("kind", "message").agg(F.count(F.lit(1)).alias("files"))


@query("export_findings_csv")
def export_findings_csv(spark, sf_dir):
    """Lines of the exported csv report."""
    path = scratch_path(spark, f"report-{_uuid.uuid4().hex[:12]}")
    FS.export_validation_report(_validated(spark, sf_dir), path, "csv")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("export_findings_text")
def export_findings_text(spark, sf_dir):
    """Lines of the exported text report."""
    path = scratch_path(spark, f"report-{_uuid.uuid4().hex[:12]}")
    FS.export_validation_report(_validated(spark, sf_dir), path, "text")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("export_delivery_csv")
def export_delivery_csv(spark, sf_dir):
    """Lines of the exported csv of delivery results."""
    path = scratch_path(spark, f"report-{_uuid.uuid4().hex[:12]}")
    FS.export_delivery_report(_import_results(spark, sf_dir).withColumn("message", F.col("error_code")), path, "csv")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("checkpoints_after_cleanup")
def checkpoints_after_cleanup(spark, sf_dir):
    """Saves appended in two runs, all but the newest ten of a session deleted."""
    base = scratch_path(spark, f"checkpoints-{_uuid.uuid4().hex[:12]}")
    ck = fixtures.checkpoints(spark, sf_dir)
    for part in (0, 1):
        FS.append_checkpoint(ck.filter(F.col("checkpoint_id") % 2 == part), f"{base}/all")
    saved = FS.read_checkpoints(spark, f"{base}/all")
    return FS.delete_checkpoints(spark, f"{base}/all", S.checkpoints_to_delete(saved), f"{base}/kept")


@query("recent_issues")
def recent_issues(spark, sf_dir):
    return S.recent_issues(fixtures.progress_events(spark, sf_dir))


@query("duplicates_preview")
def duplicates_preview(spark, sf_dir):
    return report.duplicates_preview(dedup.mark_duplicates(_valid(spark, sf_dir), "email"))


@query("dedup_across_runs")
def dedup_across_runs(spark, sf_dir):
    """The later half of the valid contacts, numbered on top of what an earlier run remembered."""
    valid = _valid(spark, sf_dir)
    seen = scratch_path(spark, f"seen-{_uuid.uuid4().hex[:12]}")
    last = valid.agg(F.max("line_number")).first()[0] or 0
    early = F.col("line_number") <= last // 2
    dedup.remember_keys(dedup.mark_duplicates(valid.filter(early), "email"), seen)
    marked = dedup.mark_across_runs(valid.filter(~early), spark.read.parquet(seen), "email")
    return marked.select("line_number", "dup_key", "dup_number", "is_duplicate", "original_line")


# --- near duplicates ----------------------------------------------------------

from ..operators import fuzzy as Z  # noqa: E402


def _near(threshold):
    def run(spark, sf_dir):
        v = _valid(spark, sf_dir).select("line_number", "email")
        uniq = dedup.unique_contacts(v, "email").select("line_number", "email")
        r = Z.find_potential_duplicates(uniq, None, threshold)
        return r.select(F.col("probe_id").alias("probe_line"), F.col("match_id").alias("match_line"),
                        "similarity", "reason", "rank")

    return run


QUERIES["potential_duplicates"] = _near(0.9)
QUERIES["potential_duplicates_08"] = _near(0.8)


# --- streaming (run to completion with availableNow, compared with the batch oracle) ----

from ..streaming import jobs as R  # noqa: E402
from ..streaming import state as RS  # noqa: E402


def _ordered_parts(df, path):
    df.repartitionByRange("line_number").sortWithinPartitions("line_number").write.mode("append").parquet(path)


@query("stream_validate")
def stream_validate(spark, sf_dir):
    """Validation findings of a contact file stream (one file per micro-batch)."""
    c = fixtures.contacts(spark, sf_dir)
    base = scratch_path(spark, f"stream-validate-{_uuid.uuid4().hex[:12]}")
    _ordered_parts(c, f"{base}/in")
    stream = R.file_stream(spark, f"{base}/in", c.schema, "parquet", max_files_per_trigger=1)
    R.run_available_now(rules.explode_findings(R.stream_validate(stream)), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@query("stream_dedup")
def stream_dedup(spark, sf_dir):
    """R2: e-mail duplicates of valid contacts arriving in two runs of one checkpointed query."""
    valid = _valid(spark, sf_dir).select("line_number", "email", "first_name", "last_name", "phone_number")
    base = scratch_path(spark, f"stream-dedup-{_uuid.uuid4().hex[:12]}")
    bounds = valid.agg(F.min("line_number").alias("lo"), F.max("line_number").alias("hi")).first()
    mid = (bounds["lo"] + bounds["hi"]) // 2 if bounds["lo"] is not None else 0
    for part in (valid.filter(F.col("line_number") <= mid), valid.filter(F.col("line_number") > mid)):
        _ordered_parts(part, f"{base}/in")
        # one micro-batch per run: the file source orders files by modification time, not name
        stream = R.file_stream(spark, f"{base}/in", valid.schema, "parquet")
        R.run_available_now(RS.dedup_stream(stream, "email"), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@query("stream_progress")
def stream_progress(spark, sf_dir):
    """Per-session counters of a progress-event stream (complete mode, last result kept)."""
    ev = fixtures.progress_events(spark, sf_dir)
    base = scratch_path(spark, f"stream-progress-{_uuid.uuid4().hex[:12]}")
    ev.repartitionByRange("seq").write.parquet(f"{base}/in")
    stream = R.file_stream(spark, f"{base}/in", ev.schema, "parquet", max_files_per_trigger=2)

    def keep(df, batch_id):
        df.write.mode("overwrite").parquet(f"{base}/out/v={batch_id}")

    q = R.run_available_now(R.stream_progress(stream), None, f"{base}/ckpt", "complete", foreach_batch=keep)
    last = max(p["batchId"] for p in q.recentProgress)
    return spark.read.parquet(f"{base}/out/v={last}")


@query("stream_tracker")
def stream_tracker(spark, sf_dir):
    """The state of each session folded from a stream of tracker events (update mode), saved per micro-batch and merged.

    Files are dealt by a hash, so events reach a session's state out of order.
    """
    ev = fixtures.tracker_events(spark, sf_dir)
    base = scratch_path(spark, f"stream-tracker-{_uuid.uuid4().hex[:12]}")
    ev.repartition(4, F.xxhash64("seq")).write.parquet(f"{base}/in")
    stream = R.file_stream(spark, f"{base}/in", ev.schema, "parquet", max_files_per_trigger=2)
    save = R.autosave(f"{base}/saves", (S.ACTIVE, "completed", "failed"))
    R.run_available_now(RS.progress_stream(stream), None, f"{base}/ckpt", "update", foreach_batch=save)
    R.compact_saves(spark, f"{base}/saves", 0)
    return R.read_saves(spark, f"{base}/saves").drop("ts", "saved_in")


@query("tracker_stats")
def tracker_stats(spark, sf_dir):
    """Totals, status, phase, current batch and duration of each session from its events."""
    return S.tracker_stats(fixtures.tracker_events(spark, sf_dir))


@query("tracker_timeline")
def tracker_timeline(spark, sf_dir):
    """Counters, phase, current batch and status after each event."""
    return S.progress_timeline(fixtures.tracker_events(spark, sf_dir))


# --- end-to-end jobs ------------------------------------------------------------

from . import jobs as J  # noqa: E402


@query("import_dry_run")
def import_dry_run(spark, sf_dir):
    """X8 dry run: the plan an import would send (same rows as ``batch_plan``)."""
    run = J.import_contacts(fixtures.contacts(spark, sf_dir), "dry-run", dry_run=True)
    return run.planned.select("line_number", "contact_id", "is_valid", "seq", "batch_no", "pos_in_batch",
                              "planned_offset_ms")


@query("import_skip_validation")
def import_skip_validation(spark, sf_dir):
    """X8 without rules: the gate still wants a usable e-mail."""
    run = J.import_contacts(fixtures.contacts(spark, sf_dir), "unchecked", dry_run=True, skip_validation=True)
    return run.planned.select("line_number", "contact_id", "is_valid", "seq", "batch_no")


@query("import_summary")
def import_summary(spark, sf_dir):
    """Totals over gate rejects and planned sends of a dry run."""
    return J.import_contacts(fixtures.contacts(spark, sf_dir), "dry-totals", dry_run=True).summary


@query("import_resume_summary")
def import_resume_summary(spark, sf_dir):
    """Totals of an import run twice on one ledger; the second run sends only what failed, rows count once."""
    ledger = scratch_path(spark, f"ledger-{_uuid.uuid4().hex[:12]}")
    for _ in range(2):
        run = J.import_contacts(fixtures.contacts(spark, sf_dir), "resumed", sender=J.stub_sender, ledger_path=ledger,
                                rate_per_s=1e6, burst=1000, delay_ms=0, concurrency=4, sleep=_no_wait)
    return run.summary


def _no_wait(_seconds):
    return None


@query("delivery_stub")
def delivery_stub(spark, sf_dir):
    """X3/X6/X7 with the deterministic stub sender (no endpoint, so no pacing waits)."""
    ledger = scratch_path(spark, f"ledger-{_uuid.uuid4().hex[:12]}")
    run = J.import_contacts(fixtures.contacts(spark, sf_dir), "stub-run", sender=J.stub_sender, ledger_path=ledger,
                            rate_per_s=1e6, burst=1000, delay_ms=0, concurrency=4, sleep=_no_wait)
    return run.results.select("session_id", "contact_id", "batch_no", "seq", "success", "error_code", "attempts")


@query("delivery_interrupted")
def delivery_interrupted(spark, sf_dir):
    """A run dies after sending its third slice and before recording it; the next one sends the rest.

    ``sends`` counts a contact's intents: only the slice that was in hand, and what had failed before, goes out twice.
    """
    ledger = scratch_path(spark, f"ledger-{_uuid.uuid4().hex[:12]}")

    class Died(Exception):
        pass

    def die(number):
        if number == 2:
            raise Died

    def run(**kw):
        return J.import_contacts(fixtures.contacts(spark, sf_dir), "died", sender=J.stub_sender, ledger_path=ledger, rate_per_s=1e6,
                                 burst=1000, delay_ms=0, concurrency=4, sleep=_no_wait, **kw)

    slices = max(1, -(-fixtures.contacts(spark, sf_dir).count() // 25))  # about five slices of batches of five
    try:
        run(slice_batches=slices, before_results=die)
    except Died:
        D.release(spark, ledger, "died")
    results = run(slice_batches=slices).results
    sends = D.read_intents(spark, ledger).groupBy("contact_id").agg(F.count(F.lit(1)).alias("sends"))
    return results.join(sends, "contact_id").select("contact_id", "success", "error_code", "sends", "data", "error")


# --- views and listings ------------------------------------------------------------


@query("safe_view")
def safe_view(spark, sf_dir):
    """Masked contact view with flags and finding messages."""
    return X.safe_view(_validated(spark, sf_dir))


@query("with_warnings")
def with_warnings(spark, sf_dir):
    """Rows with any warning, valid or not."""
    return rules.with_warnings(_validated(spark, sf_dir)).select("line_number", "is_valid", "warning_count")


@query("duplicate_contacts")
def duplicate_contacts(spark, sf_dir):
    """Every non-first holder with its original's masked e-mail and names."""
    m = dedup.mark_duplicates(_valid(spark, sf_dir), "email", carry=("email", "first_name", "last_name"))
    return dedup.duplicate_contacts(m).select(
        "line_number", X.mask_email("email").alias("email"), "dup_number", "original_line",
        X.mask_email("original.email").alias("original_email"), F.col("original.first_name").alias("original_first_name"),
        F.col("original.last_name").alias("original_last_name"))


@query("duplicate_lookup")
def duplicate_lookup(spark, sf_dir):
    """The holders of one key (the first that has duplicates), read from one bucket of a key table."""
    path = scratch_path(spark, f"keys-{_uuid.uuid4().hex[:12]}")
    dedup.write_key_index(dedup.mark_duplicates(_valid(spark, sf_dir), "email").select("line_number", "dup_key", "dup_number", "original_line"), path)
    index = spark.read.parquet(path)
    key = index.filter("dup_number = 2").agg(F.min("dup_key")).first()[0]
    return dedup.lookup_key(index, key or "")


@query("run_totals_by_kind")
def run_totals_by_kind(spark, sf_dir):
    """Totals of validate and import runs; the session table stands for the runs, odd sessions are imports."""
    runs = fixtures.sessions(spark, sf_dir).withColumn("kind", F.when(F.col("session_id") % 2 == 1, "import").otherwise("validate"))
    return report.run_totals_by_kind(runs.withColumn("duplicates", F.col("processed") % 7))


@query("merged_findings")
def merged_findings(spark, sf_dir):
    """Two partial validations of the same rows merged (join on line number) = the full findings."""
    c = fixtures.contacts(spark, sf_dir)
    a = rules.validate(c, rules=["email", "phone"])
    b = rules.validate(c, rules=["required", "name", "completeness"])
    return rules.explode_findings(rules.merge_findings(a, b))


@query("dedup_report_groups")
def dedup_report_groups(spark, sf_dir):
    """Duplicate groups with the original's masked e-mail and names."""
    _stats, groups = dedup.dedup_report(dedup.mark_duplicates(_valid(spark, sf_dir), "email"))
    return groups.select("dup_key", "total_count", "original_line", "original_email", "first_name", "last_name")
