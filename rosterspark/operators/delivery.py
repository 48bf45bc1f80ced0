"""Paced, retried delivery of contacts as a Spark job.

Planning (gate, batch numbers, release offsets, outcome triage, retry plan) is
plain DataFrame code.  Sending runs on executors inside ``mapInPandas`` with a
caller-supplied ``sender`` callable, slice by slice: intents first, then the
sends, then their results in an append-only ledger *before* anything else reads
them.  A recomputation never re-sends a contact that the ledger already
records, a rerun sends only the remainder (left-anti join on the ledger), and
what dies in between repeats at most one slice.
"""

from __future__ import annotations

import time
import uuid
from typing import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.expr import contact_id, delivery_payload, rate_pct
from ..session import materialize
from .ordered import ordinal, running
from .rules import ERROR

CHUNK_ROWS = 1 << 20
SLICE_BATCHES = 2000  # batches that are sent between two records in the ledger


# --- X1 gate ------------------------------------------------------------------


def gate(validated: DataFrame):
    """``(to_send, rejects)``.  Invalid contacts become failed results."""
    errs = F.filter("findings", lambda f: f["severity"] == ERROR)
    rejects = validated.filter(~F.col("is_valid")).select(
        "line_number",
        contact_id().alias("contact_id"),
        F.lit(False).alias("success"),
        F.lit(K.ERROR_VALIDATION_FAILED).alias("error_code"),
        F.concat(F.lit(K.VALIDATION_FAILED_PREFIX), F.array_join(F.transform(errs, lambda f: f["message"]), ", "))
        .alias("message"),
    )
    return validated.filter("is_valid"), rejects


# --- X2 plan ------------------------------------------------------------------


def sequence(df: DataFrame, order_col: str = "line_number", name: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Dense 1-based position in ``order_col`` order without a global window.

    Rows are grouped in ranges of ``chunk_rows`` order values; each range is
    numbered locally and offset by the counts of the earlier ranges (a table
    with one row per range).  ``order_col`` must be unique.
    """
    d = df.withColumn("_all", F.lit(0))
    chunk = F.floor(F.col(order_col) / F.lit(chunk_rows))
    return running(d, "_all", [order_col], chunk, sums={name: F.lit(1).cast("bigint")}).drop("_all")


def plan_batches(df: DataFrame, size: int = K.DEFAULT_BATCH_SIZE, order_col: str = "line_number",
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``seq``, ``batch_no`` (consecutive slices of ``size``) and ``pos_in_batch``."""
    s = sequence(df, order_col, "seq", chunk_rows)
    return s.withColumn("batch_no", (F.floor((F.col("seq") - 1) / F.lit(size)) + 1).cast("bigint")).withColumn(
        "pos_in_batch", ((F.col("seq") - 1) % size + 1).cast("bigint")
    )


def pacing(planned: DataFrame, rate_per_s: float = K.DEFAULT_RATE_PER_S, burst: int = K.DEFAULT_BURST,
           delay_ms: int = 0) -> DataFrame:
    """``planned_offset_ms`` — earliest release time of each request.

    Token bucket (capacity ``burst``, refill ``rate_per_s``): request ``seq``
    may leave at ``max(0, (seq - burst) / rate)`` s; batch ``k`` may not start
    before ``(k - 1) * delay_ms``.  The release time is the later of the two.
    """
    token_ms = F.greatest(F.lit(0.0), (F.col("seq") - F.lit(burst)).cast("double") / F.lit(float(rate_per_s))) * 1000
    batch_ms = ((F.col("batch_no") - 1) * F.lit(delay_ms)).cast("double")
    return planned.withColumn("planned_offset_ms", F.ceil(F.greatest(token_ms, batch_ms)).cast("bigint"))


def estimate_duration(n: Column, size: int = K.DEFAULT_BATCH_SIZE, delay_ms: int = 1000) -> tuple[Column, Column]:
    """``(ms, text)`` with ``ms = ceil(n/size) * (delay + 500)`` and text ``Xm Ys`` / ``Ys``."""
    ms = (F.ceil(n / F.lit(size)) * F.lit(delay_ms + K.REQUEST_OVERHEAD_MS)).cast("bigint")
    minutes = F.floor(ms / 60000).cast("bigint")
    seconds = F.floor((ms % 60000) / 1000).cast("bigint")
    text = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s"))) \
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    return ms, text


# --- X4 / X5 outcome triage and retry plan ----------------------------------


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(K.BACKOFF_BASE_MS) * F.pow(F.lit(2), attempt), F.lit(K.BACKOFF_CAP_MS)).cast("bigint")


def classify_outcome(attempts: DataFrame, attempt_col: str | None = None) -> DataFrame:
    """``success, error_code, retryable, retry_delay_ms`` from status / network code.

    Optional column ``graphql_codes`` (array of error codes) marks GraphQL
    errors in an otherwise successful response.
    """
    st = F.col("http_status")
    net = F.col("network_code")
    att = F.col(attempt_col) if attempt_col else F.lit(1)
    gql = F.col("graphql_codes") if "graphql_codes" in attempts.columns else F.lit(None).cast("array<string>")
    has_gql = F.coalesce(F.size(gql) > 0, F.lit(False))
    ok_http = net.isNull() & st.between(200, 299)
    code = (
        F.when(net == "ETIMEDOUT", F.lit(K.ERROR_TIMEOUT))
        .when(net.isNotNull(), F.lit(K.ERROR_NETWORK))
        .when(st.isin(*K.AUTH_STATUSES), F.lit(K.ERROR_AUTH))
        .when(st == K.RATE_LIMIT_STATUS, F.lit(K.ERROR_RATE_LIMIT))
        .when(~st.between(200, 299) | st.isNull(), F.lit(K.ERROR_API))
        .when(has_gql, F.lit(K.ERROR_GRAPHQL))
    )
    retryable = (
        F.when(code.isNull(), F.lit(False))
        .when(code.isin(K.ERROR_TIMEOUT, K.ERROR_NETWORK, K.ERROR_RATE_LIMIT), F.lit(True))
        .when(code == K.ERROR_API, st.isin(*K.RETRYABLE_SERVER_STATUSES))
        .when(code == K.ERROR_GRAPHQL, F.exists(gql, lambda c: c.isin(*K.GRAPHQL_RETRYABLE_CODES)))
        .otherwise(F.lit(False))
    )
    ra = F.col("retry_after_s") if "retry_after_s" in attempts.columns else F.lit(None)
    delay = (
        F.when(code.isNull(), F.lit(None))
        .when(code == K.ERROR_RATE_LIMIT, F.coalesce(ra * 1000, F.lit(K.RATE_LIMIT_DEFAULT_DELAY_MS)))
        .when(code == K.ERROR_TIMEOUT, F.lit(K.TIMEOUT_RETRY_DELAY_MS))
        .when(code == K.ERROR_NETWORK, F.lit(K.NETWORK_RETRY_DELAY_MS))
        .when((code == K.ERROR_API) & st.isin(*K.RETRYABLE_SERVER_STATUSES), F.lit(K.SERVER_RETRY_DELAY_MS))
        .when(code == K.ERROR_API, F.lit(K.OTHER_API_DELAY_MS))
        .otherwise(backoff_ms(att))
    )
    return attempts.withColumn("success", ok_http & ~has_gql).withColumn("error_code", code).withColumn(
        "retryable", retryable
    ).withColumn("retry_delay_ms", delay.cast("bigint"))


def number_attempts(attempts: DataFrame, key: str = "contact_id", ts: str = "attempted_at") -> DataFrame:
    """Attempt number per contact in time order (a contact with very many attempts is chunked)."""
    return ordinal(attempts, key, [ts, "seq"], None, "attempt_no")


def retry_plan(attempts: DataFrame, max_attempts: int = K.DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """Per attempt, whether it is retried and when (one retry layer, ``max_attempts`` honoured)."""
    numbered = number_attempts(attempts)
    c = classify_outcome(numbered, "attempt_no")
    will = ~F.col("success") & F.col("retryable") & (F.col("attempt_no") < F.lit(max_attempts))
    return c.select(
        "seq",
        "contact_id",
        "attempt_no",
        "error_code",
        will.alias("will_retry"),
        F.when(will, F.col("retry_delay_ms")).alias("retry_delay_ms"),
        F.when(will, F.timestamp_add("MILLISECOND", F.col("retry_delay_ms"), F.col("attempted_at"))).alias(
            "next_attempt_at"
        ),
    )


def final_outcomes(attempts: DataFrame) -> DataFrame:
    """The last attempt of each contact with its triage; its number is the contact's number of attempts.

    One partial aggregate (``max_by`` and ``count``), then triage of one row per contact.
    """
    rest = [c for c in attempts.columns if c != "contact_id"]
    last = attempts.groupBy("contact_id").agg(
        F.max_by(F.struct(*rest), F.struct("attempted_at", "seq")).alias("_l"),
        F.count(F.lit(1)).alias("attempt_no"),
    )
    last = last.select("contact_id", "attempt_no", *[F.col(f"_l.{c}").alias(c) for c in rest if c != "attempt_no"])
    return classify_outcome(last, "attempt_no").select(
        "contact_id", "seq", "attempt_no", "success", "error_code", "attempted_at")


# --- A8 / A9 / A10 / A14 statistics -----------------------------------------


def _batch_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("batch_no").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if("success").cast("bigint").alias("successful"),
        F.count_if(~F.col("success")).cast("bigint").alias("failed"),
        F.count_if(F.col("error_code") == K.ERROR_VALIDATION_FAILED).cast("bigint").alias("validation_failed"),
        F.count_if(F.coalesce(F.col("error_code"), F.lit("")) != K.ERROR_VALIDATION_FAILED).cast("bigint").alias(
            "processed"
        ),
    )


def per_batch_stats(results: DataFrame) -> DataFrame:
    """Counts and success rate of each batch."""
    return _batch_counts(results).withColumn("success_rate", rate_pct("successful", "total"))


def combined_batch_stats(results: DataFrame) -> DataFrame:
    """Batches, requests, successful, failed, success rate: sums over the batches (zeros without any)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    t = _batch_counts(results).agg(
        F.count("batch_no").cast("bigint").alias("total_batches"),
        total("total").alias("total_requests"),
        total("successful").alias("successful"),
        total("failed").alias("failed"),
    )
    return t.withColumn("success_rate", rate_pct("successful", "total_requests"))


def delivery_run_stats(results: DataFrame, ts: str = "attempted_at") -> DataFrame:
    """Operations, successes, failures, last operation time, success rate."""
    s = results.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_operations"),
        F.count_if("success").cast("bigint").alias("successful_operations"),
        F.count_if(~F.col("success")).cast("bigint").alias("failed_operations"),
        F.max(ts).alias("last_operation_at"),
    )
    return s.withColumn("success_rate", rate_pct("successful_operations", "total_operations"))


def outcome_of_contacts(marked: DataFrame, outcomes: DataFrame, allow_missing_phone: bool = True) -> DataFrame:
    """Per contact of an import run: ``sent`` / ``failed`` / ``skipped`` with reason and error class.

    ``marked`` is validated and dup-marked (all kept rows, Q2/Q3); ``outcomes``
    holds the final delivery result per ``contact_id`` (= ``line_number``).
    """
    o = outcomes.select(
        F.col("contact_id").alias("line_number"),
        F.col("success").alias("_ok"),
        F.col("error_code").alias("_err"),
    )
    j = marked.join(o, "line_number", "left")
    invalid_email = F.exists("findings", lambda f: f["code"].isin("MISSING_EMAIL", "INVALID_EMAIL_FORMAT"))
    missing_phone = F.exists("findings", lambda f: f["code"] == "MISSING_PHONE")
    reason = (
        F.when(~F.col("is_valid") & invalid_email, F.lit("invalid_email"))
        .when(~F.col("is_valid"), F.lit(K.ERROR_VALIDATION_FAILED))
        .when(F.col("is_duplicate"), F.lit("duplicate"))
    )
    if not allow_missing_phone:
        reason = reason.when(missing_phone, F.lit("missing_phone"))
    status = (
        F.when(reason.isin("invalid_email", "duplicate", "missing_phone"), F.lit("skipped"))
        .when(reason.isNotNull(), F.lit("failed"))
        .when(F.col("_ok").isNull(), F.lit("not_sent"))
        .when(F.col("_ok"), F.lit("successful"))
        .otherwise(F.lit("failed"))
    )
    err = F.when(reason == K.ERROR_VALIDATION_FAILED, F.lit(K.ERROR_VALIDATION_FAILED)).when(
        reason.isNull() & ~F.coalesce(F.col("_ok"), F.lit(True)), F.col("_err")
    )
    return j.select("line_number", contact_id().alias("contact_id"), status.alias("status"),
                    reason.alias("skip_reason"), err.alias("error_code"))


def session_counters(outcomes: DataFrame) -> DataFrame:
    """A10: processed = successful + failed + skipped; skip reasons; error classes (+ other)."""
    st, rs, ec = F.col("status"), F.col("skip_reason"), F.col("error_code")
    s = outcomes.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_records"),
        F.count_if(st == "successful").cast("bigint").alias("successful_records"),
        F.count_if(st == "failed").cast("bigint").alias("failed_records"),
        F.count_if(st == "skipped").cast("bigint").alias("skipped_records"),
        F.count_if(rs == "duplicate").cast("bigint").alias("duplicates_found"),
        F.count_if(rs == "invalid_email").cast("bigint").alias("invalid_emails"),
        F.count_if(rs == "missing_phone").cast("bigint").alias("missing_phones"),
        F.count_if(ec == K.ERROR_VALIDATION_FAILED).cast("bigint").alias("validation_errors"),
        F.count_if(ec == K.ERROR_API).cast("bigint").alias("api_errors"),
        F.count_if(ec == K.ERROR_NETWORK).cast("bigint").alias("network_errors"),
        F.count_if((st == "failed") & ~ec.isin(K.ERROR_VALIDATION_FAILED, K.ERROR_API, K.ERROR_NETWORK))
        .cast("bigint").alias("other_errors"),
    )
    return s.withColumn(
        "processed_records", F.col("successful_records") + F.col("failed_records") + F.col("skipped_records")
    ).withColumn("success_rate", rate_pct("successful_records", "total_records"))


# --- X3 deliver, X6 results, X7 ledger, J4 resume, J1/P13 marks --------------

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("contact_id", T.StringType()),
        T.StructField("batch_no", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("command_id", T.StringType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("data", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def _send_partition(sender: Callable, session_id: str, max_attempts: int, rate_per_s: float, burst: int,
                    fail_fast: bool, sleep: Callable[[float], None], delay_ms: int):
    """Executor-side loop: paced, retried calls of ``sender`` for the rows of one partition.

    ``sender(payload: dict, idempotency_key: str) -> dict`` (a third parameter,
    if it takes one, is the number of the attempt, from 1) returns
    ``{"status": int, "network_code": str|None, "retry_after_s": int|None,
    "graphql_codes": list|None, "data": ..., "error": str|None}``; exceptions
    count as network errors.  ``data`` is kept as JSON text, ``error`` as it is.
    ``burst`` may be a share of one token where there are more senders than tokens.
    """
    import datetime as _dt
    import inspect
    import json

    import pandas as pd

    counted = len(inspect.signature(sender).parameters) > 2

    def classify(res):
        st, net = res.get("status"), res.get("network_code")
        gql = res.get("graphql_codes") or []
        if net == "ETIMEDOUT":
            return K.ERROR_TIMEOUT, True, K.TIMEOUT_RETRY_DELAY_MS
        if net:
            return K.ERROR_NETWORK, True, K.NETWORK_RETRY_DELAY_MS
        if st in K.AUTH_STATUSES:
            return K.ERROR_AUTH, False, None
        if st == K.RATE_LIMIT_STATUS:
            ra = res.get("retry_after_s")
            return K.ERROR_RATE_LIMIT, True, (ra * 1000 if ra else K.RATE_LIMIT_DEFAULT_DELAY_MS)
        if st is None or not (200 <= st <= 299):
            return K.ERROR_API, st in K.RETRYABLE_SERVER_STATUSES, K.SERVER_RETRY_DELAY_MS
        if gql:
            return K.ERROR_GRAPHQL, any(c in K.GRAPHQL_RETRYABLE_CODES for c in gql), None
        return None, False, None

    def run(batches):
        capacity = max(1.0, float(burst))
        tokens, last = float(burst), time.monotonic()
        failed_batch = None
        prev_batch = None
        for pdf in batches:
            out = []
            for rec in pdf.sort_values("seq").to_dict("records"):
                b = rec["batch_no"]
                if prev_batch is not None and b != prev_batch and delay_ms:
                    sleep(delay_ms / 1000.0)
                prev_batch = b
                if fail_fast and failed_batch == b:
                    continue  # the rest of a failed batch is not sent and gets no result
                attempts, t0, code = 0, time.monotonic(), None
                while True:
                    now = time.monotonic()
                    tokens = min(capacity, tokens + (now - last) * rate_per_s)
                    last = now
                    if tokens < 1.0:
                        sleep((1.0 - tokens) / rate_per_s)
                        now = time.monotonic()
                        tokens = min(capacity, tokens + (now - last) * rate_per_s)
                        last = now
                    tokens -= 1.0
                    attempts += 1
                    key = f"{session_id}:{rec['contact_id']}"
                    try:
                        payload = dict(rec["payload"]) if isinstance(rec["payload"], dict) else rec["payload"]
                        res = sender(payload, key, attempts) if counted else sender(payload, key)
                    except Exception as exc:  # noqa: BLE001 - a failed call is a network error
                        res = {"status": None, "network_code": type(exc).__name__, "error": str(exc)}
                    code, retry, delay = classify(res)
                    if code is None or not retry or attempts >= max_attempts:
                        break
                    sleep((delay if delay is not None else min(K.BACKOFF_BASE_MS * 2 ** attempts, K.BACKOFF_CAP_MS))
                          / 1000.0)
                ok = code is None
                data, error = res.get("data"), None if ok else res.get("error") or f"Subscription failed: {code}"
                if not ok and fail_fast:
                    failed_batch = b
                out.append({
                    "session_id": session_id, "contact_id": rec["contact_id"], "batch_no": b, "seq": rec["seq"],
                    "success": ok, "error_code": code,
                    "message": "Successfully subscribed" if ok else f"Subscription failed: {code}",
                    "attempts": attempts, "duration_ms": int((time.monotonic() - t0) * 1000),
                    "command_id": key, "sent_at": _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
                    "data": None if data is None else json.dumps(data, sort_keys=True), "error": error,
                })
            yield pd.DataFrame(out, columns=[f.name for f in RESULT_SCHEMA.fields])

    return run


def deliver(
    to_send: DataFrame,
    sender: Callable,
    ledger_path: str,
    session_id: str,
    concurrency: int = 1,
    max_attempts: int = K.DEFAULT_MAX_ATTEMPTS,
    rate_per_s: float = K.DEFAULT_RATE_PER_S,
    burst: int = K.DEFAULT_BURST,
    delay_ms: int = 0,
    fail_fast: bool = False,
    sleep: Callable[[float], None] = time.sleep,
    slice_batches: int = SLICE_BATCHES,
    before_results: Callable[[int], None] | None = None,
) -> DataFrame:
    """Send the remainder of ``to_send`` and append the results to the ledger.

    ``to_send`` needs ``contact_id`` (+ ``email``/``phone_number`` or a
    ``payload``) and ``seq``/``batch_no`` from ``plan_batches``.  Contacts the
    ledger already records as successful for ``session_id`` are skipped (J4).
    Sending goes slice by slice (``slice_batches`` consecutive batches).  Before
    a slice is sent its intents (who is about to be sent, by which run) are
    written next to the ledger, after it its results; so whatever dies, at most
    one slice is sent again, and ``in_doubt`` names the contacts.  The folder of
    a slice's intents is its lease: a second run of the session that comes upon
    a slice in hand fails instead of sending it too.  Rows of a slice are spread
    over ``concurrency`` partitions by batch (a batch stays in one partition, in
    order); rate and burst are split evenly across them.  Results are written
    once and read back, never recomputed: the latest row of each contact of the
    session.  ``before_results`` is called with each slice between sending and
    recording it (for tests).
    """
    spark = to_send.sparkSession
    from ..session import scratch_path, ship_package

    ship_package(spark)
    remainder = resume_remainder(to_send, spark, ledger_path, session_id)
    if "payload" not in remainder.columns:
        remainder = remainder.withColumn("payload", delivery_payload())
    run_id = uuid.uuid4().hex
    rows = remainder.select(
        F.col("contact_id").cast("string").alias("contact_id"), "batch_no", "seq", "payload",
        F.floor((F.col("batch_no") - 1) / F.lit(slice_batches)).cast("bigint").alias("slice"),
    )
    path = scratch_path(spark, f"to-send-{run_id}")
    rows.write.partitionBy("slice").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    parts = max(1, int(concurrency))
    fn = _send_partition(sender, session_id, max_attempts, rate_per_s / parts, burst / parts, fail_fast, sleep, delay_ms)
    slices = sorted(r["slice"] for r in rows.select("slice").distinct().collect())  # one number per slice_batches batches
    for k in slices:
        part = rows.filter(F.col("slice") == k)
        _take_lease(spark, ledger_path, session_id, k, run_id, part)
        sent = part.select("contact_id", "batch_no", "seq", F.from_json("payload", "map<string,string>").alias("payload"))
        results = sent.repartition(parts, "batch_no").sortWithinPartitions("seq").mapInPandas(fn, RESULT_SCHEMA)
        if before_results is not None:
            results = materialize(results, "sent")
            before_results(k)
        results.write.mode("append").parquet(ledger_path)
        _drop_lease(spark, ledger_path, session_id, k)
    return latest_results(read_ledger(spark, ledger_path).filter(F.col("session_id") == session_id))


INTENTS = "contact_id string, batch_no bigint, seq bigint, run_id string, session_id string, slice bigint"


def _intent_folder(ledger_path: str) -> str:
    return f"{ledger_path.rstrip('/')}-intents"


def _lease(spark, ledger_path: str, session_id: str, number: int):
    """(file system, path) of the lease of a slice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_intent_folder(ledger_path)}-leases/{quote(session_id, safe='')}/{number}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _take_lease(spark, ledger_path: str, session_id: str, number: int, run_id: str, part: DataFrame) -> None:
    fs, path = _lease(spark, ledger_path, session_id, number)
    fs.mkdirs(path.getParent())
    try:
        fs.create(path, False).close()  # fails if the file exists: one of two runs gets it
    except Py4JJavaError as e:
        raise RuntimeError(f"slice {number} of {session_id} is being sent by another run, or was when a run died: "
                           "see in_doubt() and release()") from e
    part.select("contact_id", "batch_no", "seq", F.lit(run_id).alias("run_id"), F.lit(session_id).alias("session_id"), F.col("slice")).write.mode(
        "append").parquet(_intent_folder(ledger_path))


def _drop_lease(spark, ledger_path: str, session_id: str, number: int) -> None:
    fs, path = _lease(spark, ledger_path, session_id, number)
    fs.delete(path, False)


def read_intents(spark, ledger_path: str) -> DataFrame:
    """Who was about to be sent, by slice and run: a row for each time."""
    from ..session import path_exists

    if not path_exists(spark, _intent_folder(ledger_path)):
        return spark.createDataFrame([], INTENTS)
    return spark.read.schema(INTENTS).parquet(_intent_folder(ledger_path))


def in_doubt(spark, ledger_path: str, session_id: str) -> DataFrame:
    """Contacts with more intents than results: sent, or not, when a run died."""
    tried = read_intents(spark, ledger_path).filter(F.col("session_id") == session_id).groupBy("contact_id").agg(
        F.count(F.lit(1)).alias("intents"), F.max("slice").alias("slice"))
    known = read_ledger(spark, ledger_path).filter(F.col("session_id") == session_id).groupBy("contact_id").agg(F.count(F.lit(1)).alias("results"))
    both = tried.join(known, "contact_id", "left").withColumn("results", F.coalesce("results", F.lit(0)))
    return both.filter(F.col("intents") > F.col("results"))


def release(spark, ledger_path: str, session_id: str) -> None:
    """Give back the leases of a run that died, so that the next one sends its last slice again (same idempotency keys)."""
    fs, path = _lease(spark, ledger_path, session_id, 0)
    fs.delete(path.getParent(), True)


def latest_results(ledger: DataFrame) -> DataFrame:
    """The last row of each contact (a success over a failure of the same time); contacts without an id keep all rows."""
    rank = F.struct("sent_at", "success", "attempts", "seq")
    cols = ledger.columns
    last = ledger.filter("contact_id is not null").groupBy("session_id", "contact_id").agg(F.max_by(F.struct(*cols), rank).alias("_r"))
    return last.select("_r.*").select(*cols).unionByName(ledger.filter("contact_id is null"))


def read_ledger(spark, ledger_path: str) -> DataFrame:
    """The append-only ledger (empty before the first run)."""
    from ..session import path_exists

    if not path_exists(spark, ledger_path):
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).parquet(ledger_path)


def resume_remainder(contacts: DataFrame, spark, ledger_path: str, session_id: str) -> DataFrame:
    """Contacts with no successful ledger entry for the session (left-anti join)."""
    done = read_ledger(spark, ledger_path).filter((F.col("session_id") == session_id) & F.col("success")).select(
        "contact_id"
    )
    return contacts.join(done, contacts["contact_id"].cast("string") == done["contact_id"], "left_anti")


def remainder_after(contacts: DataFrame, done: DataFrame, key: str = "contact_id") -> DataFrame:
    """J4 core: rows of ``contacts`` whose key is not in ``done``."""
    return contacts.join(done.select(key).distinct(), key, "left_anti")


def with_processed_marks(contacts: DataFrame, results: DataFrame) -> DataFrame:
    """Attach ``processed, success, message, was_successful`` from the results (equi left join), and
    ``processed_at`` where results have ``sent_at``."""
    timed = ["sent_at"] if "sent_at" in results.columns else []
    r = results.groupBy("contact_id").agg(
        F.max_by(F.struct("success", "message", *timed), F.struct("seq")).alias("_r")
    )
    j = contacts.join(r, "contact_id", "left")
    return j.select(
        *contacts.columns,
        F.col("_r").isNotNull().alias("processed"),
        F.col("_r.success").alias("success"),
        F.col("_r.message").alias("message"),
        (F.col("_r").isNotNull() & F.coalesce(F.col("_r.success"), F.lit(False))).alias("was_successful"),
        *[F.col("_r.sent_at").alias("processed_at") for _ in timed],
    )


def all_results(rejects: DataFrame, results: DataFrame) -> DataFrame:
    """Gate rejects first, then delivery results."""
    return rejects.unionByName(results, allowMissingColumns=True)
