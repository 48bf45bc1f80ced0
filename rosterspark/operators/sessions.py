"""Import sessions, progress events and checkpoints.

Inputs follow FIXTURES.md: ``sessions`` (one row per run), ``progress_events``
(one row per event, ordered by ``(ts, seq)`` within a session) and
``checkpoints`` (one immutable row per save).  Per-session ordered work uses
the chunked scans of ``ordered`` so that a hot session stays parallel;
per-session totals are plain aggregations with partial combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import rate_pct
from .ordered import neighbors, ordinal, running, time_chunk

EVENT_ORDER = ["ts", "seq"]

# --- fixed values: event type names -----------------------------------------
PHASE_CHANGE = "phase_change"
BATCH_START = "batch_start"
BATCH_PROGRESS = "batch_progress"
BATCH_COMPLETE = "batch_complete"
RECORD_PROCESSED = "record_processed"
ERROR_OCCURRED = "error_occurred"
WARNING_OCCURRED = "warning_occurred"
MILESTONE_REACHED = "milestone_reached"
SESSION_COMPLETE = "session_complete"
STATISTICS_UPDATE = "statistics_update"
ACTIVE = "active"  # status of a session until it completes or fails
EMA_KEEP = 0.8  # weight of the old average in the moving average of batch time


def _chunk(unit: str | None):
    """Where sessions are cut: at a fixed time unit if given, else large ones at sampled edges (``ordered``)."""
    return time_chunk("ts", unit) if unit else None


def _is(t: str) -> Column:
    return F.col("type") == F.lit(t)


def _n(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


# --- sessions table -----------------------------------------------------------


def session_overview(sessions: DataFrame) -> DataFrame:
    """Total, running, completed, failed, latest session id (newest start)."""
    return sessions.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_sessions"),
        F.count_if(F.col("status") == "running").cast("bigint").alias("active_sessions"),
        F.count_if(F.col("status") == "completed").cast("bigint").alias("completed_sessions"),
        F.count_if(F.col("status") == "failed").cast("bigint").alias("failed_sessions"),
        F.max_by("session_id", F.struct("start_time", "session_id")).alias("latest_session"),
    )


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def session_progress(sessions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Completion %, success rate %, records/s and ETA (ms) as of a time.

    ``as_of`` defaults to the current time; rate is processed / elapsed
    seconds, ETA is remaining / rate (NULL when the rate is 0).
    """
    as_of = as_of if as_of is not None else F.localtimestamp()
    el = elapsed_ms(F.col("start_time"), as_of)
    rps = F.when(el > 0, F.col("processed").cast("double") / (el / F.lit(1000.0))).otherwise(F.lit(0.0))
    return sessions.select(
        "session_id",
        "status",
        rate_pct("processed", "total").alias("completion_pct"),
        rate_pct("successful", "total").alias("success_rate"),
        F.round(rps, 6).alias("records_per_second"),
        # remaining / rate * 1000 == remaining * elapsed_ms / processed: one division, exact inputs
        F.when(
            (el > 0) & (F.col("processed") > 0),
            F.floor(((F.col("total") - F.col("processed")) * el).cast("double") / F.col("processed")),
        ).cast("bigint").alias("eta_ms"),
    )


def _can_resume() -> Column:
    return (F.col("status").isin(*K.RESUMABLE_STATUSES) & F.col("total").isNotNull()
            & (F.col("processed") < F.col("total")))


def resumable(sessions: DataFrame) -> DataFrame:
    """T5: paused/failed/interrupted sessions with a summary and work left."""
    return sessions.filter(_can_resume()).select("session_id", "status", "total", "processed", (F.col("total") - F.col("processed")).alias("remaining"))


def resumable_overview(sessions: DataFrame) -> DataFrame:
    """Counts of resumable sessions by status."""
    r = resumable(sessions)
    return r.agg(
        F.count(F.lit(1)).cast("bigint").alias("resumable_sessions"),
        *[F.count_if(F.col("status") == s).cast("bigint").alias(f"{s}_sessions") for s in K.RESUMABLE_STATUSES],
    )


def latest_resumable(sessions: DataFrame) -> DataFrame:
    """The newest resumable session (top-1 is the feature)."""
    return sessions.filter(_can_resume()).select(
        "session_id", "status", "total", "processed", (F.col("total") - F.col("processed")).alias("remaining"), "start_time",
    ).orderBy(F.desc("start_time"), F.desc("session_id")).limit(1)


def session_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added / removed / changed sessions between two snapshots (null-safe)."""
    o = old.select("session_id", F.lit(True).alias("_in_old"), F.col("status").alias("old_status"),
                   F.col("processed").alias("old_processed"))
    n = new.select("session_id", F.lit(True).alias("_in_new"), F.col("status").alias("new_status"),
                   F.col("processed").alias("new_processed"))
    # presence markers keep NULL fields from being mistaken for absence
    j = o.join(n, "session_id", "full_outer")
    change = (
        F.when(F.col("_in_old").isNull(), F.lit("added"))
        .when(F.col("_in_new").isNull(), F.lit("removed"))
        .when(
            ~F.col("old_status").eqNullSafe(F.col("new_status"))
            | ~F.col("old_processed").eqNullSafe(F.col("new_processed")),
            F.lit("changed"),
        )
    )
    return (
        j.withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select("session_id", "change", "old_status", "new_status", "old_processed", "new_processed")
    )


def format_duration(ms: Column) -> Column:
    """``1h 2m`` / ``2m 5s`` / ``5s`` from milliseconds."""
    s = F.floor(ms / 1000).cast("bigint")
    m = F.floor(s / 60).cast("bigint")
    h = F.floor(m / 60).cast("bigint")
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def sessions_export(sessions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The session table as exported (success rate %, duration text)."""
    as_of = as_of if as_of is not None else F.localtimestamp()
    end = F.col("end_time") if "end_time" in sessions.columns else F.lit(None)
    return sessions.select(
        F.col("session_id").alias("Session ID"),
        F.col("status").alias("Status"),
        (F.col("type") if "type" in sessions.columns else F.lit("import")).alias("Type"),
        F.col("csv_file").alias("CSV File"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("Total Records"),
        F.coalesce("processed", F.lit(0)).cast("bigint").alias("Processed"),
        F.coalesce("successful", F.lit(0)).cast("bigint").alias("Successful"),
        F.coalesce("failed", F.lit(0)).cast("bigint").alias("Failed"),
        rate_pct(F.coalesce("successful", F.lit(0)), F.coalesce("total", F.lit(0))).alias("Success Rate"),
        F.col("start_time").alias("Started"),
        format_duration(elapsed_ms(F.col("start_time"), F.coalesce(end, as_of))).alias("Duration"),
    )


# --- progress events ----------------------------------------------------------


def progress_timeline(events: DataFrame, chunk_unit: str | None = None) -> DataFrame:
    """Running counters, current phase and (for events with ``batch_number``) current batch and status after each event."""
    rp = _is(RECORD_PROCESSED)
    sums = {
        "processed": _n(rp),
        "successful": _n(rp & F.coalesce(F.col("success"), F.lit(False))),
        "failed": _n(rp & ~F.coalesce(F.col("success"), F.lit(False))),
        "warnings": _n(_is(WARNING_OCCURRED)),
        "errors": _n(_is(ERROR_OCCURRED)),
        "batches": _n(_is(BATCH_COMPLETE)),
        "milestones": _n(_is(MILESTONE_REACHED)),
    }
    lasts = {"current_phase": F.when(_is(PHASE_CHANGE), F.col("phase"))}
    if "batch_number" in events.columns:
        lasts["current_batch"] = F.when(_is(BATCH_START), F.col("batch_number"))
        lasts["status"] = _ended_as()
    out = running(events, "session_id", EVENT_ORDER, _chunk(chunk_unit), sums, lasts)
    if "status" in lasts:
        out = out.withColumn("status", F.coalesce("status", F.lit(ACTIVE)))
    return out.select("seq", "session_id", "ts", *sums.keys(), *lasts.keys())


def _ended_as() -> Column:
    """Status that a session's end gives it; null for other events."""
    return F.when(_is(SESSION_COMPLETE), F.when(F.coalesce(F.col("success"), F.lit(False)), F.lit("completed")).otherwise(F.lit("failed")))


def tracker_stats(events: DataFrame) -> DataFrame:
    """A15 with status, current batch, errors, batches and duration: a session's state after all of its events.

    Partial aggregates only (no window): what a later event replaces is the value at the greatest (ts, seq).
    """
    rp, order = _is(RECORD_PROCESSED), F.struct(*EVENT_ORDER)
    ok = rp & F.coalesce(F.col("success"), F.lit(False))

    def at_last(cond, value):
        return F.max_by(value, F.when(cond, order))

    counts = {"events": F.lit(True), "processed": rp, "successful": ok, "failed": rp & ~F.coalesce(F.col("success"), F.lit(False)),
              "warnings": _is(WARNING_OCCURRED), "errors": _is(ERROR_OCCURRED), "milestones": _is(MILESTONE_REACHED), "batches": _is(BATCH_COMPLETE)}
    s = events.groupBy("session_id").agg(
        *[F.count_if(c).cast("bigint").alias(n) for n, c in counts.items()],
        at_last(_is(PHASE_CHANGE), F.col("phase")).alias("phase"),
        at_last(_is(BATCH_START), F.col("batch_number")).alias("current_batch"),
        F.coalesce(at_last(_is(SESSION_COMPLETE), _ended_as()), F.lit(ACTIVE)).alias("status"),
        elapsed_ms(F.min("ts"), F.max("ts")).alias("duration_ms"))
    return s.withColumn("success_rate", rate_pct("successful", "processed"))


def _batch_times(events: DataFrame) -> DataFrame:
    return events.filter(_is(BATCH_COMPLETE) & (F.col("duration_ms") > 0))


def batch_time_mean(events: DataFrame, chunk_unit: str | None = None) -> DataFrame:
    """Running mean of batch durations (non-zero ones) after each completed batch."""
    b = _batch_times(events)
    out = running(
        b, "session_id", EVENT_ORDER, _chunk(chunk_unit),
        sums={"batch_no": F.lit(1).cast("bigint"), "_sum_ms": F.col("duration_ms")},
    )
    return out.select(
        "seq", "session_id", "batch_no", F.round(F.col("_sum_ms") / F.col("batch_no"), 6).alias("mean_batch_ms")
    )


def batch_time_ema(events: DataFrame, chunk_unit: str | None = None) -> DataFrame:
    """Moving average of batch time per session (first value, then 0.8*old + 0.2*new).

    Closed form ``sum(w_i * d_i)`` with ``w_1 = 0.8^(n-1)`` and
    ``w_i = 0.2 * 0.8^(n-i)``: each row needs only its position ``i`` (a
    chunked running count) and the session's count ``n``; the sum is a
    partial aggregation.  No session is ever collected into one array.
    """
    b = ordinal(_batch_times(events), "session_id", EVENT_ORDER, _chunk(chunk_unit), "i")
    n = b.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    j = b.join(n, "session_id")
    keep = F.lit(EMA_KEEP)
    w = F.when(F.col("i") == 1, F.pow(keep, F.col("n") - 1)).otherwise(
        (F.lit(1.0) - keep) * F.pow(keep, F.col("n") - F.col("i"))
    )
    return j.groupBy("session_id").agg(
        F.first("n").cast("bigint").alias("batches"),
        F.round(F.sum(w * F.col("duration_ms")), 6).alias("ema_batch_ms"),
    )


def phase_intervals(events: DataFrame, chunk_unit: str | None = None) -> DataFrame:
    """Per phase change: previous phase, phase, entered at, time spent (ms) until the next."""
    pc = events.filter(_is(PHASE_CHANGE)).select("session_id", "seq", "ts", "phase")
    out = neighbors(pc, "session_id", EVENT_ORDER, _chunk(chunk_unit), ["phase", "ts"])
    return out.select(
        "session_id",
        "seq",
        F.col("prev_phase").alias("previous_phase"),
        "phase",
        F.col("ts").alias("entered_at"),
        elapsed_ms(F.col("ts"), F.col("next_ts")).alias("time_spent_ms"),
    )


def session_event_stats(events: DataFrame) -> DataFrame:
    """Per-session totals over the event log, and the latest phase."""
    rp = _is(RECORD_PROCESSED)
    ok = rp & F.coalesce(F.col("success"), F.lit(False))
    s = events.groupBy("session_id").agg(
        F.count_if(rp).cast("bigint").alias("processed"),
        F.count_if(ok).cast("bigint").alias("successful"),
        F.count_if(rp & ~F.coalesce(F.col("success"), F.lit(False))).cast("bigint").alias("failed"),
        F.count_if(_is(WARNING_OCCURRED)).cast("bigint").alias("warnings"),
        F.count_if(_is(ERROR_OCCURRED)).cast("bigint").alias("errors"),
        F.count_if(_is(MILESTONE_REACHED)).cast("bigint").alias("milestones"),
        F.max_by(F.col("phase"), F.when(_is(PHASE_CHANGE), F.struct(*EVENT_ORDER))).alias("last_phase"),
    )
    return s.withColumn("success_rate", rate_pct("successful", "processed"))


def recent_issues(events: DataFrame, n_errors: int = 5, n_warnings: int = 3) -> DataFrame:
    """T4: the last ``n_errors`` errors and ``n_warnings`` warnings of each session, newest first.

    ``row_number() <= n`` becomes a group limit before the shuffle, so a session
    with many events sends a few rows per task.
    """
    def last(kind, n):
        w = Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in EVENT_ORDER])
        return (events.filter(_is(kind)).select("session_id", "seq", "ts", "type")
                .withColumn("newest", F.row_number().over(w).cast("bigint")).filter(F.col("newest") <= n))

    return last(ERROR_OCCURRED, n_errors).unionByName(last(WARNING_OCCURRED, n_warnings))


# --- checkpoints --------------------------------------------------------------


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Newest checkpoint per session (ties broken by checkpoint id)."""
    cols = [c for c in checkpoints.columns if c != "session_id"]
    r = checkpoints.groupBy("session_id").agg(
        F.max_by(F.struct(*cols), F.struct("ts", "checkpoint_id")).alias("_c")
    )
    return r.select("session_id", *[F.col(f"_c.{c}").alias(c) for c in cols])


def checkpoint_retention(checkpoints: DataFrame, keep: int = K.MAX_CHECKPOINTS) -> DataFrame:
    """The newest ``keep`` checkpoints of each session, numbered newest first.

    ``row_number() <= keep`` becomes a per-partition group limit before the
    shuffle, so a session with many saves sends at most ``keep`` rows per task.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("checkpoint_id"))
    return (
        checkpoints.withColumn("keep_rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("keep_rank") <= keep)
        .select("session_id", "checkpoint_id", "ts", "keep_rank")
    )


def checkpoints_to_delete(checkpoints: DataFrame, keep: int = K.MAX_CHECKPOINTS) -> DataFrame:
    """W8 deletion set: everything not retained (anti join on the key)."""
    kept = checkpoint_retention(checkpoints, keep).select("session_id", "checkpoint_id")
    return checkpoints.join(kept, ["session_id", "checkpoint_id"], "left_anti")


def resumable_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """T5 (checkpoint form): latest checkpoint not completed/failed with work left."""
    latest = latest_checkpoint(checkpoints)
    return latest.filter(
        ~F.col("status").isin("completed", "failed") & (F.col("processed") < F.col("total"))
    )
