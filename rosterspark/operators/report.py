"""Validation report statistics.

All inputs are the frame returned by ``rules.validate`` (plus ``line_number``).
Each statistic is one aggregation with map-side partial combine; top-k lists
use ``orderBy().limit()`` (TakeOrderedAndProject) or ``row_number() <= k``
filters, which Spark turns into a per-partition group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import email_domain, has_phone, mask_email, rate_pct
from .dedup import _blank, dup_key
from .rules import ERROR, WARNING, explode_findings


def validation_summary(validated: DataFrame, strategy="email", dedupe_valid_only: bool = True) -> DataFrame:
    """A1 (+Q13): total, valid, invalid, with warnings, duplicates, rate, error/warning counts, is_valid.

    Duplicates are counted among the valid rows (the validate path), in the
    same pass: rows are grouped by their dup key (NULL for rows that do not
    take part) and the per-key partial counts are summed.
    """
    key = dup_key(strategy)
    take_part = ~_blank(key) & (F.col("is_valid") if dedupe_valid_only else F.lit(True))
    per_key = validated.groupBy(F.when(take_part, key).alias("_k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_valid").alias("n_valid"),
        F.count_if(F.col("warning_count") > 0).alias("n_warn"),
        F.sum("error_count").alias("n_err"),
        F.sum("warning_count").alias("n_wfind"),
    )
    s = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_records"),
        F.coalesce(F.sum("n_valid"), F.lit(0)).cast("bigint").alias("valid_records"),
        F.coalesce(F.sum("n_warn"), F.lit(0)).cast("bigint").alias("records_with_warnings"),
        F.coalesce(F.sum(F.when(F.col("_k").isNotNull(), F.col("n") - 1)), F.lit(0)).cast("bigint").alias(
            "duplicates_found"
        ),
        F.coalesce(F.sum("n_err"), F.lit(0)).cast("bigint").alias("error_count"),
        F.coalesce(F.sum("n_wfind"), F.lit(0)).cast("bigint").alias("warning_count"),
    )
    return s.select(
        "total_records",
        "valid_records",
        (F.col("total_records") - F.col("valid_records")).alias("invalid_records"),
        "records_with_warnings",
        "duplicates_found",
        rate_pct("valid_records", "total_records").alias("validation_rate"),
        "error_count",
        "warning_count",
        (F.col("total_records") == F.col("valid_records")).alias("is_valid"),
    )


def stats_by_domain(validated: DataFrame, n: int = 10) -> DataFrame:
    """Total / valid / invalid per e-mail domain, top ``n`` by total, ties by first line."""
    per = (
        validated.select(email_domain("email").alias("domain"), "is_valid", "line_number")
        .filter(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("total"),
            F.count_if("is_valid").cast("bigint").alias("valid"),
            F.count_if(~F.col("is_valid")).cast("bigint").alias("invalid"),
            F.min("line_number").cast("bigint").alias("first_line"),
        )
    )
    top = per.orderBy(F.desc("total"), "first_line").limit(n)
    # the window runs over at most ``n`` rows (after the limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "first_line")).cast("bigint"))


def invalid_errors(validated: DataFrame) -> DataFrame:
    """Long table of the error findings of invalid rows (input of A3, A5, A6)."""
    return explode_findings(validated.filter(~F.col("is_valid"))).filter(F.col("severity") == ERROR)


def stats_by_code(validated: DataFrame) -> DataFrame:
    """A3 (Q1: keyed by ``code``): number of errors per code over invalid rows."""
    return invalid_errors(validated).groupBy("code").agg(F.count(F.lit(1)).cast("bigint").alias("error_count"))


def stats_by_phone(validated: DataFrame) -> DataFrame:
    """A4: with / without phone, rate %."""
    s = validated.agg(
        F.count_if(has_phone("phone_number")).cast("bigint").alias("with_phone_number"),
        F.count(F.lit(1)).cast("bigint").alias("_total"),
    )
    return s.select(
        "with_phone_number",
        (F.col("_total") - F.col("with_phone_number")).alias("without_phone_number"),
        rate_pct("with_phone_number", "_total").alias("phone_number_rate"),
    )


def common_issues(validated: DataFrame, n: int = 10, examples: int = 5) -> DataFrame:
    """Per (field, code) count and the first ``examples`` occurrences, top ``n`` by count.

    Ties keep first-appearance order.  Output is long: one row per example.
    """
    errs = invalid_errors(validated)
    counts = errs.groupBy("field", "code").agg(
        F.count(F.lit(1)).cast("bigint").alias("issue_count"),
        F.min(F.struct("line_number", "finding_no")).alias("_first"),
    )
    top = counts.orderBy(F.desc("issue_count"), "_first").limit(n)
    top = top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("issue_count"), "_first")).cast("bigint")
    ).drop("_first")
    w = Window.partitionBy("field", "code").orderBy("line_number", "finding_no")
    ex = (
        errs.withColumn("example_no", F.row_number().over(w))
        .filter(F.col("example_no") <= examples)
        .select(
            "field",
            "code",
            F.col("example_no").cast("bigint"),
            F.col("line_number").alias("example_line"),
            F.col("value").alias("example_value"),
            F.col("message").alias("example_message"),
        )
    )
    # ``top`` has at most ``n`` rows
    return ex.join(F.broadcast(top), ["field", "code"], "inner").select(
        "rank", "field", "code", "issue_count", "example_no", "example_line", "example_value", "example_message"
    )


def errors_by_code(validated: DataFrame) -> DataFrame:
    """Long listing ``code, line_number, field, value, message`` (no per-code arrays)."""
    return invalid_errors(validated).select("code", "line_number", "field", "value", "message")


def quarantine(validated: DataFrame) -> DataFrame:
    """V20 invalid side, with its error codes and messages as text."""
    errs = F.filter("findings", lambda f: f["severity"] == ERROR)
    return validated.filter(~F.col("is_valid")).select(
        "line_number",
        "email",
        "first_name",
        "last_name",
        "phone_number",
        F.array_join(F.transform(errs, lambda f: f["code"]), ",").alias("error_codes"),
        F.array_join(F.transform(errs, lambda f: f["message"]), ", ").alias("error_messages"),
    )


def findings_preview(validated: DataFrame, n_errors: int = 10, n_warnings: int = 5) -> DataFrame:
    """T4: the first ``n_errors`` errors and ``n_warnings`` warnings in input order."""
    f = explode_findings(validated)
    first_err = f.filter(F.col("severity") == ERROR).orderBy("line_number", "finding_no").limit(n_errors)
    first_warn = f.filter(F.col("severity") == WARNING).orderBy("line_number", "finding_no").limit(n_warnings)
    return first_err.unionByName(first_warn)


def duplicates_preview(marked: DataFrame, n: int = 5) -> DataFrame:
    """T4: the first ``n`` duplicates in input order, e-mail masked (top-n is the feature)."""
    return marked.filter("is_duplicate").select(
        "line_number", mask_email("email").alias("email"), "dup_number", "original_line").orderBy("line_number").limit(n)


def run_totals(runs: DataFrame) -> DataFrame:
    """Totals over a ``runs`` table (one row per validate or import run)."""
    return runs.agg(
        F.count(F.lit(1)).cast("bigint").alias("runs"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("records"),
        F.coalesce(F.sum("processed"), F.lit(0)).cast("bigint").alias("processed"),
        F.coalesce(F.sum("successful"), F.lit(0)).cast("bigint").alias("successful"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("bigint").alias("failed"),
        F.max("start_time").alias("last_run_at"),
    )


def summary_as_run(summary: DataFrame, run_id, started_at, kind: str = "validate") -> DataFrame:
    """Shape one A1 row as a ``runs`` row, ready to append."""
    return summary.select(
        F.lit(run_id).alias("run_id"),
        F.lit(kind).alias("kind"),
        F.col("total_records").alias("total"),
        F.col("total_records").alias("processed"),
        F.col("valid_records").alias("successful"),
        F.col("invalid_records").alias("failed"),
        F.col("duplicates_found").alias("duplicates"),
        F.lit(started_at).cast("timestamp").alias("start_time"),
    )


def run_totals_by_kind(runs: DataFrame) -> DataFrame:
    """Totals of validate and of import runs (``kind``), with duplicates and success rate."""
    sums = {"records": "total", "processed": "processed", "successful": "successful", "failed": "failed", "duplicates": "duplicates"}
    t = runs.groupBy("kind").agg(F.count(F.lit(1)).cast("bigint").alias("runs"),
                                 *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in sums.items()],
                                 F.max("start_time").alias("last_run_at"))
    return t.withColumn("success_rate", rate_pct("successful", "processed"))
