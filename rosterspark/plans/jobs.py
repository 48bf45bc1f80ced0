"""End-to-end jobs: the validate report (3.1) and the import run (X8, 3.2).

Both build one lazy plan up to the marked contact frame, write it once below
the shared checkpoint folder (lineage cut: a lost executor re-reads it instead
of re-parsing the input), and derive every report from that table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import contact_id, has_valid_email
from ..operators import dedup, delivery, report, rules
from ..session import materialize


@dataclass
class ValidationReport:
    """Named DataFrames of one validate run (all masked where they show contacts)."""

    marked: DataFrame
    summary: DataFrame
    by_domain: DataFrame
    by_code: DataFrame
    by_phone: DataFrame
    common_issues: DataFrame
    findings: DataFrame
    duplicates: DataFrame
    extra: dict = field(default_factory=dict)


def validate_report(contacts: DataFrame, strict: bool = False, rules_subset=None, include_dedup: bool = True,
                    strategy="email") -> ValidationReport:
    """3.1: validate → dedupe the valid rows (Q3) → statistics A1-A5."""
    v = rules.validate(contacts, rules=rules_subset, strict=strict)
    marked = v
    if include_dedup:
        # invalid rows take no part in the validate-path dedup
        valid_marked = dedup.mark_duplicates(v.filter("is_valid"), strategy)
        marked = valid_marked.unionByName(
            v.filter(~F.col("is_valid"))
            .withColumn("dup_key", F.lit(None).cast("string"))
            .withColumn("dup_number", F.lit(None).cast("bigint"))
            .withColumn("is_duplicate", F.lit(False))
            .withColumn("original_line", F.lit(None).cast("bigint"))
        )
    if not include_dedup:
        marked = (marked.withColumn("dup_key", F.lit(None).cast("string"))
                  .withColumn("dup_number", F.lit(None).cast("bigint"))
                  .withColumn("is_duplicate", F.lit(False))
                  .withColumn("original_line", F.lit(None).cast("bigint")))
    marked = materialize(marked, "validate-marked")
    from ..functions.expr import mask_email

    dups = marked.filter("is_duplicate").select(
        "line_number", mask_email("email").alias("email"), "first_name", "last_name", "dup_number", "original_line")
    return ValidationReport(
        marked=marked,
        summary=report.validation_summary(marked, strategy),
        by_domain=report.stats_by_domain(marked),
        by_code=report.stats_by_code(marked),
        by_phone=report.stats_by_phone(marked),
        common_issues=report.common_issues(marked),
        findings=rules.explode_findings(marked),
        duplicates=dups,
    )


@dataclass
class ImportRun:
    session_id: str
    planned: DataFrame
    rejects: DataFrame
    results: DataFrame | None
    summary: DataFrame
    duration_estimate: DataFrame


def import_contacts(
    contacts: DataFrame,
    session_id: str,
    sender: Callable | None = None,
    ledger_path: str | None = None,
    dry_run: bool = False,
    skip_validation: bool = False,
    skip_dedup: bool = False,
    max_records: int | None = None,
    batch_size: int = K.DEFAULT_BATCH_SIZE,
    delay_ms: int = 1000,
    rate_per_s: float = K.DEFAULT_RATE_PER_S,
    burst: int = K.DEFAULT_BURST,
    concurrency: int = 1,
    fail_fast: bool = False,
    sleep: Callable[[float], None] = time.sleep,
    **send_options,
) -> ImportRun:
    """Validate → dedupe all kept rows → gate → plan → (deliver) → results.

    ``dry_run`` stops before sending.  ``skip_validation`` runs no rules (every
    row with a usable e-mail is kept).  Invalid rows are kept by default and
    rejected by the gate (Q2).  ``max_records`` keeps the first n rows.
    Further options go to ``delivery.deliver``.
    """
    c = contacts
    if max_records:
        c = c.filter(F.col("line_number") <= F.lit(int(max_records)))
    if skip_validation:
        v = c.withColumn("findings", rules.findings_column([])).withColumn("error_count", F.lit(0)).withColumn(
            "warning_count", F.lit(0)).withColumn("is_valid", has_valid_email())
    else:
        v = rules.validate(c)
    m = v if skip_dedup else dedup.mark_duplicates(v, "email")
    kept = m if skip_dedup else m.filter(~F.col("is_duplicate"))
    kept = materialize(kept, f"import-{session_id}-kept")
    planned = delivery.pacing(delivery.plan_batches(kept, batch_size), rate_per_s, burst, delay_ms)
    planned = planned.withColumn("contact_id", contact_id())
    to_send, rejects = delivery.gate(planned)
    rejects = rejects.join(planned.select("line_number", "batch_no", "seq"), "line_number")
    n = to_send.agg(F.count(F.lit(1)).cast("bigint").alias("records"))
    ms, text = delivery.estimate_duration(F.col("records"), batch_size, delay_ms)
    estimate = n.select("records", ms.alias("estimate_ms"), text.alias("estimate_text"))
    results = None
    if not dry_run:
        if sender is None or ledger_path is None:
            raise ValueError("a sender and a ledger path are needed unless dry_run")
        results = delivery.deliver(to_send, sender, ledger_path, session_id, concurrency, rate_per_s=rate_per_s,
                                   burst=burst, delay_ms=delay_ms, fail_fast=fail_fast, sleep=sleep, **send_options)
    all_res = delivery.all_results(
        rejects.select("contact_id", "batch_no", "seq", "success", "error_code"),
        results.select("contact_id", "batch_no", "seq", "success", "error_code") if results is not None
        else to_send.select("contact_id", "batch_no", "seq", F.lit(True).alias("success"),
                            F.lit(None).cast("string").alias("error_code")),
    )
    summary = delivery.combined_batch_stats(all_res)
    return ImportRun(session_id, planned, rejects, results, summary, estimate)


def stub_sender(payload, key, attempt):
    """A deterministic sender for tests and the registered stub query (no network).

    Outcome by the md5 of the e-mail: mostly 200; some 503 on the first attempt
    and 200 on the next, some 401 and 404.
    """
    import hashlib

    email = (payload or {}).get("email") or ""
    name = hashlib.md5(email.encode("utf8")).hexdigest()
    h = int(name[:6], 16) % 20
    if h < 2:
        return {"status": (401, 404)[h], "error": ("HTTP 401", "HTTP 404")[h]}
    return {"status": 503 if h == 2 and attempt == 1 else 200, "data": {"id": name[:8]}}
