"""Reference SQL for each registered query, runnable by DuckDB.

These strings are the independent side of the correctness check: the same
fixture views as the Spark queries (inlined as CTEs), and the rules written
out as plain SQL, one ``SELECT`` per rule.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources.fixtures import cte


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS = K.JS_WS_CLASS


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def miss(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def email_ok(x: str = "email") -> str:
    return f"coalesce(regexp_matches({x}, {q(K.EMAIL_PATTERN)}), false)"


def phone_ok(x: str = "phone_number") -> str:
    return f"coalesce(regexp_matches({js_trim(x)}, {q(K.PHONE_PATTERN)}), false)"


def rate(part: str, whole: str) -> str:
    return (
        f"CASE WHEN ({whole}) = 0 THEN CAST(0 AS BIGINT) "
        f"ELSE CAST(floor(CAST({part} AS DOUBLE) / ({whole}) * 100 + 0.5) AS BIGINT) END"
    )


def lower_trim(x: str) -> str:
    return f"CASE WHEN {miss(x)} THEN '' ELSE {js_trim('lower(' + x + ')')} END"


def trim0(x: str) -> str:
    return f"CASE WHEN {miss(x)} THEN '' ELSE {js_trim(x)} END"


def dup_key_sql(strategy: str) -> str:
    if strategy == "email":
        return lower_trim("email")
    if strategy == "email_phone":
        return f"({lower_trim('email')}) || '|' || ({trim0('phone_number')})"
    return (
        f"({lower_trim('email')}) || '|' || ({trim0('phone_number')}) || '|' || "
        f"({lower_trim('first_name')}) || '|' || ({lower_trim('last_name')})"
    )


def has_phone(x: str = "phone_number") -> str:
    return f"(NOT {miss(x)} AND {js_trim(x)} <> '')"


def domain_sql(x: str = "email") -> str:
    return f"nullif(split_part({x}, '@', 2), '')"


def _typo_case() -> str:
    whens = " ".join(f"WHEN ends_with(email, {q(e)}) THEN {q(m)}" for e, _s, m in K.EMAIL_TYPOS)
    return f"CASE {whens} END"


def _typo_any() -> str:
    return "(" + " OR ".join(f"ends_with(email, {q(e)})" for e, _s, _m in K.EMAIL_TYPOS) + ")"


NULLS = "CAST(NULL AS VARCHAR)"

# one row per (rule, firing line); r is the rule's position in evaluation order
_RULES = [
    (1, "error", K.FIELD_EMAIL, "MISSING_EMAIL", q(K.MSG_MISSING_EMAIL), NULLS, miss("email")),
    (2, "error", K.FIELD_EMAIL, "INVALID_EMAIL_FORMAT", q(K.MSG_INVALID_EMAIL), "email",
     f"NOT {miss('email')} AND NOT {email_ok()}"),
    (3, "error", K.FIELD_EMAIL, "EMAIL_TOO_LONG", q(K.MSG_EMAIL_TOO_LONG), "email",
     f"NOT {miss('email')} AND {email_ok()} AND length(email) > {K.EMAIL_MAX_LENGTH}"),
    (4, "warning", K.FIELD_EMAIL, "POSSIBLE_TYPO", _typo_case(), "email",
     f"NOT {miss('email')} AND {email_ok()} AND length(email) <= {K.EMAIL_MAX_LENGTH} AND {_typo_any()}"),
    (5, "error", K.FIELD_PHONE, "INVALID_PHONE_FORMAT", q(K.MSG_INVALID_PHONE), "phone_number",
     f"NOT {miss('phone_number')} AND {js_trim('phone_number')} <> '' AND NOT {phone_ok()}"),
    (8, "error", "email", "MISSING_REQUIRED_FIELD", q("email" + K.MSG_REQUIRED_SUFFIX), "email", miss("email")),
    (9, "warning", K.FIELD_FIRST, "NAME_TOO_LONG", q(K.MSG_FIRST_TOO_LONG), "first_name",
     f"NOT {miss('first_name')} AND length(first_name) > {K.NAME_MAX_LENGTH}"),
    (10, "warning", K.FIELD_FIRST, "EMPTY_NAME", q(K.MSG_FIRST_EMPTY), "first_name",
     f"NOT {miss('first_name')} AND {js_trim('first_name')} = ''"),
    (11, "warning", K.FIELD_LAST, "NAME_TOO_LONG", q(K.MSG_LAST_TOO_LONG), "last_name",
     f"NOT {miss('last_name')} AND length(last_name) > {K.NAME_MAX_LENGTH}"),
    (12, "warning", K.FIELD_LAST, "EMPTY_NAME", q(K.MSG_LAST_EMPTY), "last_name",
     f"NOT {miss('last_name')} AND {js_trim('last_name')} = ''"),
    (13, "warning", K.FIELD_PHONE, "MISSING_PHONE", q(K.MSG_MISSING_PHONE), NULLS,
     f"NOT {miss('email')} AND {miss('phone_number')}"),
    (14, "warning", K.FIELD_NAME, "MISSING_NAME", q(K.MSG_MISSING_NAME), NULLS,
     f"{miss('first_name')} AND {miss('last_name')}"),
]

_FINDINGS_UNION = "\nUNION ALL\n".join(
    f"SELECT line_number, {r} AS r, '{sev}' AS severity, '{fld}' AS field, '{code}' AS code, "
    f"{msg} AS message, CAST({val} AS VARCHAR) AS value FROM contacts WHERE {cond}"
    for r, sev, fld, code, msg, val, cond in _RULES
)

# contacts, raw findings (fr), findings with numbers (fnd), validated rows (v)
VALIDATED = (
    cte("contacts")
    + f""",
fr AS ({_FINDINGS_UNION}),
fnd AS (SELECT line_number, r, CAST(row_number() OVER (PARTITION BY line_number ORDER BY r) AS BIGINT) AS finding_no,
               severity, field, code, message, value FROM fr),
ecount AS (SELECT line_number, count(*) FILTER (WHERE severity = 'error') AS ne,
                  count(*) FILTER (WHERE severity = 'warning') AS nw FROM fnd GROUP BY line_number),
v AS (SELECT c.*, CAST(coalesce(ec.ne, 0) AS BIGINT) AS error_count, CAST(coalesce(ec.nw, 0) AS BIGINT) AS warning_count,
             (coalesce(ec.ne, 0) = 0 AND NOT {miss('c.email')} AND {email_ok('c.email')}) AS is_valid
      FROM contacts c LEFT JOIN ecount ec ON c.line_number = ec.line_number)
"""
)


def _marked(strategy: str, source: str = "v WHERE is_valid") -> str:
    """``mk``: rows of ``source`` with dup key, number, flag, original line."""
    key = dup_key_sql(strategy)
    return f""",
kd AS (SELECT *, {key} AS dup_key FROM {source}),
mk AS (SELECT line_number, dup_key,
         CASE WHEN {js_trim('dup_key')} = '' THEN CAST(NULL AS BIGINT)
              ELSE CAST(row_number() OVER (PARTITION BY dup_key ORDER BY line_number) AS BIGINT) END AS dup_number,
         CASE WHEN {js_trim('dup_key')} = '' THEN CAST(NULL AS BIGINT)
              ELSE min(line_number) OVER (PARTITION BY dup_key) END AS first_line
       FROM kd)
"""


def _dup_query(strategy: str) -> str:
    return (
        VALIDATED
        + _marked(strategy)
        + """SELECT line_number, dup_key, dup_number, coalesce(dup_number > 1, false) AS is_duplicate,
       CASE WHEN dup_number > 1 THEN first_line END AS original_line FROM mk"""
    )


ORACLE: dict[str, str] = {}

ORACLE["contacts_normalized"] = cte("contacts") + f"""
SELECT line_number, email, coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name,
  coalesce(phone_number, '') AS phone_number, '{K.SOURCE_CSV}' AS source,
  CASE WHEN {js_trim("coalesce(first_name, '') || ' ' || coalesce(last_name, '')")} <> ''
       THEN {js_trim("coalesce(first_name, '') || ' ' || coalesce(last_name, '')")}
       ELSE split_part(email, '@', 1) END AS full_name,
  (NOT {miss('email')} AND {email_ok()}) AS has_valid_email,
  {has_phone()} AS has_phone,
  ({has_phone()} AND {phone_ok()}) AS has_valid_phone,
  {domain_sql()} AS email_domain,
  CASE WHEN NOT {miss('email')} THEN {js_trim('lower(email)')} END AS contact_id
FROM contacts
"""

ORACLE["contacts_masked"] = cte("contacts") + f"""
SELECT line_number,
  CASE WHEN {miss('email')} THEN ''
       WHEN coalesce(split_part(email, '@', 1), '') <> '' AND coalesce(split_part(email, '@', 2), '') <> ''
       THEN substr(split_part(email, '@', 1), 1, 2) || '***@' || split_part(email, '@', 2)
       ELSE email END AS masked_email,
  CASE WHEN {miss('phone_number')} THEN ''
       WHEN length(regexp_replace(phone_number, '[^0-9]', '', 'g')) < 4 THEN phone_number
       ELSE '+***' || right(regexp_replace(phone_number, '[^0-9]', '', 'g'), 4) END AS masked_phone,
  CASE WHEN length(phone_number) > 4 THEN '***' || right(phone_number, 4) ELSE phone_number END AS phone_tail
FROM contacts
"""

ORACLE["delivery_payloads"] = cte("contacts") + f"""
SELECT line_number, CASE WHEN NOT {miss('email')} THEN {js_trim('lower(email)')} END AS contact_id,
  '{{' || concat_ws(',',
      CASE WHEN NOT {miss('email')} AND {email_ok()} THEN '"email":"' || {js_trim('lower(email)')} || '"' END,
      CASE WHEN {has_phone()} AND {phone_ok()} THEN '"phoneNumber":"' || {js_trim('phone_number')} || '"' END)
  || '}}' AS payload
FROM contacts
"""

ORACLE["validation_findings"] = VALIDATED + """
SELECT line_number, finding_no, severity, field, code, message, value FROM fnd
"""

ORACLE["validation_status"] = VALIDATED + """,
ef AS (SELECT line_number, field, severity, min(r) AS r FROM fnd GROUP BY line_number, field, severity),
agg AS (SELECT line_number,
          string_agg(field, ',' ORDER BY r) FILTER (WHERE severity = 'error') AS error_fields,
          string_agg(field, ',' ORDER BY r) FILTER (WHERE severity = 'warning') AS warning_fields
        FROM ef GROUP BY line_number),
msgs AS (SELECT line_number,
          string_agg(message, '; ' ORDER BY r) FILTER (WHERE severity = 'error') AS error_messages,
          string_agg(message, '; ' ORDER BY r) FILTER (WHERE severity = 'warning') AS warning_messages
        FROM fnd GROUP BY line_number)
SELECT v.line_number, v.is_valid, v.error_count, v.warning_count,
  coalesce(agg.error_fields, '') AS error_fields, coalesce(agg.warning_fields, '') AS warning_fields,
  coalesce(msgs.error_messages, '') AS error_messages, coalesce(msgs.warning_messages, '') AS warning_messages
FROM v LEFT JOIN agg ON v.line_number = agg.line_number LEFT JOIN msgs ON v.line_number = msgs.line_number
"""

ORACLE["validation_summary"] = VALIDATED + _marked("email") + f"""
, s AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records,
          count(*) FILTER (WHERE warning_count > 0) AS records_with_warnings,
          sum(error_count) AS error_count, sum(warning_count) AS warning_count FROM v),
d AS (SELECT count(*) FILTER (WHERE dup_number > 1) AS duplicates_found FROM mk)
SELECT CAST(total_records AS BIGINT) AS total_records, CAST(valid_records AS BIGINT) AS valid_records,
  CAST(total_records - valid_records AS BIGINT) AS invalid_records,
  CAST(records_with_warnings AS BIGINT) AS records_with_warnings,
  CAST(duplicates_found AS BIGINT) AS duplicates_found,
  {rate('valid_records', 'total_records')} AS validation_rate,
  CAST(error_count AS BIGINT) AS error_count, CAST(warning_count AS BIGINT) AS warning_count,
  total_records = valid_records AS is_valid
FROM s, d
"""

ORACLE["domain_stats"] = VALIDATED + f"""
, per AS (SELECT {domain_sql()} AS domain, CAST(count(*) AS BIGINT) AS total,
            CAST(count(*) FILTER (WHERE is_valid) AS BIGINT) AS valid,
            CAST(count(*) FILTER (WHERE NOT is_valid) AS BIGINT) AS invalid,
            CAST(min(line_number) AS BIGINT) AS first_line
          FROM v WHERE {domain_sql()} IS NOT NULL GROUP BY 1)
SELECT domain, total, valid, invalid, first_line,
  CAST(row_number() OVER (ORDER BY total DESC, first_line) AS BIGINT) AS rank
FROM per ORDER BY total DESC, first_line LIMIT 10
"""

_INVALID_ERRORS = """,
ie AS (SELECT f.* FROM fnd f JOIN v ON f.line_number = v.line_number WHERE NOT v.is_valid AND f.severity = 'error')
"""

ORACLE["code_stats"] = VALIDATED + _INVALID_ERRORS + """
SELECT code, CAST(count(*) AS BIGINT) AS error_count FROM ie GROUP BY code
"""

ORACLE["phone_stats"] = cte("contacts") + f"""
, s AS (SELECT count(*) FILTER (WHERE {has_phone()}) AS w, count(*) AS t FROM contacts)
SELECT CAST(w AS BIGINT) AS with_phone_number, CAST(t - w AS BIGINT) AS without_phone_number,
  {rate('w', 't')} AS phone_number_rate FROM s
"""

ORACLE["common_issues"] = VALIDATED + _INVALID_ERRORS + """,
cnt AS (SELECT field, code, CAST(count(*) AS BIGINT) AS issue_count,
          min(line_number * 1000 + finding_no) AS first_pos FROM ie GROUP BY field, code),
top AS (SELECT field, code, issue_count,
          CAST(row_number() OVER (ORDER BY issue_count DESC, first_pos) AS BIGINT) AS rank
        FROM cnt ORDER BY issue_count DESC, first_pos LIMIT 10),
ex AS (SELECT field, code, CAST(row_number() OVER (PARTITION BY field, code ORDER BY line_number, finding_no) AS BIGINT)
            AS example_no, line_number AS example_line, value AS example_value, message AS example_message FROM ie)
SELECT top.rank, top.field, top.code, top.issue_count, ex.example_no, ex.example_line, ex.example_value, ex.example_message
FROM ex JOIN top ON ex.field = top.field AND ex.code = top.code WHERE ex.example_no <= 5
"""

ORACLE["errors_by_code"] = VALIDATED + _INVALID_ERRORS + """
SELECT code, line_number, field, value, message FROM ie
"""

ORACLE["quarantine"] = VALIDATED + """,
e AS (SELECT line_number, string_agg(code, ',' ORDER BY r) AS error_codes,
        string_agg(message, ', ' ORDER BY r) AS error_messages FROM fnd WHERE severity = 'error' GROUP BY line_number)
SELECT v.line_number, v.email, v.first_name, v.last_name, v.phone_number,
  coalesce(e.error_codes, '') AS error_codes, coalesce(e.error_messages, '') AS error_messages
FROM v LEFT JOIN e ON v.line_number = e.line_number WHERE NOT v.is_valid
"""

ORACLE["findings_preview"] = VALIDATED + """
SELECT * FROM (SELECT line_number, finding_no, severity, field, code, message, value FROM fnd
               WHERE severity = 'error' ORDER BY line_number, finding_no LIMIT 10)
UNION ALL
SELECT * FROM (SELECT line_number, finding_no, severity, field, code, message, value FROM fnd
               WHERE severity = 'warning' ORDER BY line_number, finding_no LIMIT 5)
"""

for _s in ("email", "email_phone", "strict"):
    ORACLE[f"dup_{_s}"] = _dup_query(_s)

ORACLE["dup_groups"] = VALIDATED + _marked("email") + f"""
SELECT dup_key, '{K.STRATEGY_NAMES['email']}' AS strategy, CAST(min(line_number) AS BIGINT) AS original_line,
  CAST(count(*) AS BIGINT) AS total_count, CAST(count(*) - 1 AS BIGINT) AS duplicate_count
FROM mk WHERE dup_number IS NOT NULL GROUP BY dup_key HAVING count(*) > 1
"""

ORACLE["dup_stats"] = VALIDATED + _marked("email") + f"""
, s AS (SELECT count(*) AS t, count(*) FILTER (WHERE dup_number > 1) AS d,
          count(DISTINCT dup_key) FILTER (WHERE dup_number = 2) AS g FROM mk)
SELECT '{K.STRATEGY_NAMES['email']}' AS strategy, CAST(t AS BIGINT) AS total_records,
  CAST(t - d AS BIGINT) AS unique_records, CAST(d AS BIGINT) AS duplicate_records,
  CAST(g AS BIGINT) AS duplicate_groups, {rate('d', 't')} AS duplicate_rate, {rate('t - d', 't')} AS unique_rate
FROM s
"""

ORACLE["unique_contacts"] = VALIDATED + _marked("email") + """
SELECT mk.dup_key, v.line_number, v.email, v.first_name, v.last_name, v.phone_number
FROM mk JOIN v ON mk.line_number = v.line_number WHERE mk.dup_number = 1
"""

# --- sessions, progress events, checkpoints ----------------------------------

AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"


def _ms(a: str, b: str) -> str:
    """Milliseconds from ``a`` to ``b``, difference truncated (as Spark's timestamp_diff)."""
    return f"CAST(trunc((epoch_us({b}) - epoch_us({a})) / 1000.0) AS BIGINT)"


ORACLE["session_overview"] = cte("sessions") + """
SELECT CAST(count(*) AS BIGINT) AS total_sessions,
  CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS active_sessions,
  CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed_sessions,
  CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed_sessions,
  (SELECT session_id FROM sessions ORDER BY start_time DESC, session_id DESC LIMIT 1) AS latest_session
FROM sessions
"""

_RPS = f"CASE WHEN {_ms('start_time', AS_OF)} > 0 THEN CAST(processed AS DOUBLE) / ({_ms('start_time', AS_OF)} / CAST(1000 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END"

ORACLE["session_progress"] = cte("sessions") + f"""
SELECT session_id, status, {rate('processed', 'total')} AS completion_pct, {rate('successful', 'total')} AS success_rate,
  round({_RPS}, 6) AS records_per_second,
  CASE WHEN {_ms('start_time', AS_OF)} > 0 AND processed > 0
       THEN CAST(floor(CAST((total - processed) * {_ms('start_time', AS_OF)} AS DOUBLE) / processed) AS BIGINT) END AS eta_ms
FROM sessions
"""

_RESUMABLE = "status IN ('paused', 'failed', 'interrupted') AND total IS NOT NULL AND processed < total"

ORACLE["resumable"] = cte("sessions") + f"""
SELECT session_id, status, total, processed, total - processed AS remaining FROM sessions WHERE {_RESUMABLE}
"""

ORACLE["resumable_overview"] = cte("sessions") + f"""
SELECT CAST(count(*) AS BIGINT) AS resumable_sessions,
  CAST(count(*) FILTER (WHERE status = 'paused') AS BIGINT) AS paused_sessions,
  CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed_sessions,
  CAST(count(*) FILTER (WHERE status = 'interrupted') AS BIGINT) AS interrupted_sessions
FROM sessions WHERE {_RESUMABLE}
"""

ORACLE["latest_resumable"] = cte("sessions") + f"""
SELECT session_id, status, total, processed, total - processed AS remaining, start_time
FROM sessions WHERE {_RESUMABLE} ORDER BY start_time DESC, session_id DESC LIMIT 1
"""

ORACLE["session_diff"] = cte("sessions") + """,
o AS (SELECT session_id, status AS old_status, processed AS old_processed FROM sessions
      WHERE start_time < TIMESTAMP '2001-01-01 00:00:00'),
n AS (SELECT session_id, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS new_status,
             CASE WHEN status = 'running' THEN total ELSE processed END AS new_processed
      FROM sessions WHERE status <> 'cancelled'),
j AS (SELECT coalesce(o.session_id, n.session_id) AS session_id, o.session_id AS os, n.session_id AS ns,
             old_status, new_status, old_processed, new_processed
      FROM o FULL OUTER JOIN n ON o.session_id = n.session_id)
SELECT session_id,
  CASE WHEN os IS NULL THEN 'added' WHEN ns IS NULL THEN 'removed' ELSE 'changed' END AS change,
  old_status, new_status, old_processed, new_processed
FROM j
WHERE os IS NULL OR ns IS NULL OR old_status IS DISTINCT FROM new_status OR old_processed IS DISTINCT FROM new_processed
"""

_DUR = _ms("start_time", AS_OF)

ORACLE["sessions_export"] = cte("sessions") + f""",
d AS (SELECT *, CAST(floor({_DUR} / 1000) AS BIGINT) AS s FROM sessions),
e AS (SELECT *, CAST(floor(s / 60) AS BIGINT) AS m FROM d),
f AS (SELECT *, CAST(floor(m / 60) AS BIGINT) AS h FROM e)
SELECT session_id AS "Session ID", status AS "Status", 'import' AS "Type", csv_file AS "CSV File",
  CAST(coalesce(total, 0) AS BIGINT) AS "Total Records", CAST(coalesce(processed, 0) AS BIGINT) AS "Processed",
  CAST(coalesce(successful, 0) AS BIGINT) AS "Successful", CAST(coalesce(failed, 0) AS BIGINT) AS "Failed",
  {rate('coalesce(successful, 0)', 'coalesce(total, 0)')} AS "Success Rate", start_time AS "Started",
  CASE WHEN h > 0 THEN CAST(h AS VARCHAR) || 'h ' || CAST(m % 60 AS VARCHAR) || 'm'
       WHEN m > 0 THEN CAST(m AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's'
       ELSE CAST(s AS VARCHAR) || 's' END AS "Duration"
FROM f
"""

ORACLE["run_totals"] = cte("sessions") + """
SELECT CAST(count(*) AS BIGINT) AS runs, CAST(coalesce(sum(total), 0) AS BIGINT) AS records,
  CAST(coalesce(sum(processed), 0) AS BIGINT) AS processed, CAST(coalesce(sum(successful), 0) AS BIGINT) AS successful,
  CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed, max(start_time) AS last_run_at
FROM sessions
"""

_W = "(PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _cnt(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER {_W} AS BIGINT)"


ORACLE["progress_timeline"] = cte("progress_events") + f"""
SELECT seq, session_id, ts,
  {_cnt("type = 'record_processed'")} AS processed,
  {_cnt("type = 'record_processed' AND coalesce(success, false)")} AS successful,
  {_cnt("type = 'record_processed' AND NOT coalesce(success, false)")} AS failed,
  {_cnt("type = 'warning_occurred'")} AS warnings,
  {_cnt("type = 'error_occurred'")} AS errors,
  {_cnt("type = 'batch_complete'")} AS batches,
  {_cnt("type = 'milestone_reached'")} AS milestones,
  last_value(CASE WHEN type = 'phase_change' THEN phase END IGNORE NULLS) OVER {_W} AS current_phase
FROM progress_events
"""

ORACLE["tracker_timeline"] = ORACLE["progress_timeline"].replace(cte("progress_events"), cte("tracker_events")).replace(
    "AS current_phase\n", f"""AS current_phase,
  last_value(CASE WHEN type = 'batch_start' THEN batch_number END IGNORE NULLS) OVER {_W} AS current_batch,
  coalesce(last_value(CASE WHEN type = 'session_complete' THEN CASE WHEN coalesce(success, false) THEN 'completed' ELSE 'failed' END END
           IGNORE NULLS) OVER {_W}, 'active') AS status
""").replace("FROM progress_events", "FROM tracker_events")

_BATCHES = "SELECT * FROM progress_events WHERE type = 'batch_complete' AND duration_ms > 0"

ORACLE["batch_time_mean"] = cte("progress_events") + f"""
SELECT seq, session_id, CAST(count(*) OVER {_W} AS BIGINT) AS batch_no,
  round(sum(duration_ms) OVER {_W} / count(*) OVER {_W}, 6) AS mean_batch_ms
FROM ({_BATCHES}) b
"""

ORACLE["batch_time_ema"] = cte("progress_events") + f""",
b AS (SELECT session_id, duration_ms AS d, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS i,
        count(*) OVER (PARTITION BY session_id) AS n FROM ({_BATCHES}) x)
SELECT session_id, CAST(n AS BIGINT) AS batches,
  round(sum(CASE WHEN i = 1 THEN pow(0.8, n - 1) ELSE (1.0 - 0.8) * pow(0.8, n - i) END * d), 6) AS ema_batch_ms
FROM b GROUP BY session_id, n
"""

ORACLE["phase_intervals"] = cte("progress_events") + f""",
p AS (SELECT session_id, seq, ts, phase,
        lag(phase) OVER (PARTITION BY session_id ORDER BY ts, seq) AS previous_phase,
        lead(ts) OVER (PARTITION BY session_id ORDER BY ts, seq) AS next_ts
      FROM progress_events WHERE type = 'phase_change')
SELECT session_id, seq, previous_phase, phase, ts AS entered_at, {_ms('ts', 'next_ts')} AS time_spent_ms FROM p
"""

ORACLE["session_event_stats"] = cte("progress_events") + f""",
s AS (SELECT session_id,
  CAST(count(*) FILTER (WHERE type = 'record_processed') AS BIGINT) AS processed,
  CAST(count(*) FILTER (WHERE type = 'record_processed' AND coalesce(success, false)) AS BIGINT) AS successful,
  CAST(count(*) FILTER (WHERE type = 'record_processed' AND NOT coalesce(success, false)) AS BIGINT) AS failed,
  CAST(count(*) FILTER (WHERE type = 'warning_occurred') AS BIGINT) AS warnings,
  CAST(count(*) FILTER (WHERE type = 'error_occurred') AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE type = 'milestone_reached') AS BIGINT) AS milestones
  FROM progress_events GROUP BY session_id),
lp AS (SELECT session_id, phase AS last_phase FROM (
         SELECT session_id, phase, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS rn
         FROM progress_events WHERE type = 'phase_change') x WHERE rn = 1)
SELECT s.*, lp.last_phase, {rate('successful', 'processed')} AS success_rate
FROM s LEFT JOIN lp ON s.session_id = lp.session_id
"""

_LATEST_CK = """SELECT session_id, checkpoint_id, ts, status, total, processed FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, checkpoint_id DESC) AS rn FROM checkpoints) x
WHERE rn = 1"""

ORACLE["latest_checkpoint"] = cte("checkpoints") + _LATEST_CK

ORACLE["checkpoint_retention"] = cte("checkpoints") + """
SELECT session_id, checkpoint_id, ts, keep_rank FROM (
  SELECT session_id, checkpoint_id, ts,
    CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, checkpoint_id DESC) AS BIGINT) AS keep_rank
  FROM checkpoints) x WHERE keep_rank <= 10
"""

ORACLE["checkpoints_to_delete"] = cte("checkpoints") + """
SELECT session_id, checkpoint_id FROM (
  SELECT session_id, checkpoint_id,
    row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, checkpoint_id DESC) AS rn FROM checkpoints) x
WHERE rn > 10
"""

ORACLE["resumable_checkpoints"] = cte("checkpoints") + f"""
SELECT * FROM ({_LATEST_CK}) l WHERE status NOT IN ('completed', 'failed') AND processed < total
"""

# --- delivery -----------------------------------------------------------------

_KEPT = VALIDATED + _marked("email", "v") + """,
kept AS (SELECT v.*, mk.dup_key FROM v JOIN mk ON v.line_number = mk.line_number WHERE coalesce(mk.dup_number, 1) = 1),
plan AS (SELECT kept.*, CAST(row_number() OVER (ORDER BY line_number) AS BIGINT) AS seq FROM kept)
"""
_CID = f"CASE WHEN NOT {miss('email')} THEN {js_trim('lower(email)')} END"

ORACLE["gate_rejects"] = VALIDATED + f""",
e AS (SELECT line_number, string_agg(message, ', ' ORDER BY r) AS m FROM fnd WHERE severity = 'error' GROUP BY line_number)
SELECT v.line_number, {_CID.replace('email', 'v.email')} AS contact_id, false AS success,
  'validation_failed' AS error_code, 'Subscriber validation failed: ' || coalesce(e.m, '') AS message
FROM v LEFT JOIN e ON v.line_number = e.line_number WHERE NOT v.is_valid
"""

ORACLE["batch_plan"] = _KEPT + f"""
SELECT line_number, {_CID} AS contact_id, is_valid, seq,
  CAST(floor((seq - 1) / 5) + 1 AS BIGINT) AS batch_no, CAST((seq - 1) % 5 + 1 AS BIGINT) AS pos_in_batch,
  CAST(ceil(greatest(greatest(CAST(0 AS DOUBLE), CAST(seq - 2 AS DOUBLE) / 1.0) * 1000,
                     CAST((floor((seq - 1) / 5)) * 1000 AS DOUBLE))) AS BIGINT) AS planned_offset_ms
FROM plan
"""

ORACLE["duration_estimate"] = _KEPT + """,
n AS (SELECT CAST(count(*) AS BIGINT) AS records FROM kept WHERE is_valid),
e AS (SELECT records, CAST(ceil(records / 5) * 1500 AS BIGINT) AS estimate_ms FROM n)
SELECT records, estimate_ms,
  CASE WHEN floor(estimate_ms / 60000) > 0
       THEN CAST(CAST(floor(estimate_ms / 60000) AS BIGINT) AS VARCHAR) || 'm ' ||
            CAST(CAST(floor((estimate_ms % 60000) / 1000) AS BIGINT) AS VARCHAR) || 's'
       ELSE CAST(CAST(floor((estimate_ms % 60000) / 1000) AS BIGINT) AS VARCHAR) || 's' END AS estimate_text
FROM e
"""

_TRIAGE = cte("delivery_attempts") + """,
an AS (SELECT *, CAST(row_number() OVER (PARTITION BY contact_id ORDER BY attempted_at, seq) AS BIGINT) AS attempt_no
       FROM delivery_attempts),
tr AS (SELECT *,
  CASE WHEN network_code = 'ETIMEDOUT' THEN 'TIMEOUT_ERROR' WHEN network_code IS NOT NULL THEN 'NETWORK_ERROR'
       WHEN http_status IN (401, 403) THEN 'AUTH_ERROR' WHEN http_status = 429 THEN 'RATE_LIMIT_ERROR'
       WHEN http_status IS NULL OR NOT (http_status BETWEEN 200 AND 299) THEN 'API_ERROR' END AS error_code
  FROM an),
tr2 AS (SELECT *, error_code IS NULL AS success,
  CASE WHEN error_code IS NULL THEN false
       WHEN error_code IN ('TIMEOUT_ERROR', 'NETWORK_ERROR', 'RATE_LIMIT_ERROR') THEN true
       WHEN error_code = 'API_ERROR' THEN coalesce(http_status IN (500, 502, 503, 504), false) ELSE false END AS retryable,
  CAST(CASE WHEN error_code IS NULL THEN NULL
       WHEN error_code = 'RATE_LIMIT_ERROR' THEN coalesce(retry_after_s * 1000, 5000)
       WHEN error_code = 'TIMEOUT_ERROR' THEN 3000 WHEN error_code = 'NETWORK_ERROR' THEN 2000
       WHEN error_code = 'API_ERROR' AND http_status IN (500, 502, 503, 504) THEN 2000
       WHEN error_code = 'API_ERROR' THEN 1000
       ELSE least(1000 * pow(2, attempt_no), 10000) END AS BIGINT) AS retry_delay_ms
  FROM tr)
"""

ORACLE["attempt_triage"] = _TRIAGE + """
SELECT seq, contact_id, attempt_no, success, error_code, retryable, retry_delay_ms FROM tr2
"""

ORACLE["retry_plan"] = _TRIAGE + """
SELECT seq, contact_id, attempt_no, error_code, (NOT success AND retryable AND attempt_no < 3) AS will_retry,
  CASE WHEN NOT success AND retryable AND attempt_no < 3 THEN retry_delay_ms END AS retry_delay_ms,
  CASE WHEN NOT success AND retryable AND attempt_no < 3 THEN attempted_at + to_milliseconds(retry_delay_ms) END
    AS next_attempt_at
FROM tr2
"""

_FINAL = """,
fo AS (SELECT contact_id, seq, attempt_no, success, error_code, attempted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY attempted_at DESC, seq DESC) AS rn FROM tr2) x
  WHERE rn = 1)
"""

ORACLE["final_outcomes"] = _TRIAGE + _FINAL + "SELECT * FROM fo"

_TRIAGE_TAIL = _TRIAGE.replace(cte("delivery_attempts"), "")

_IMPORT = _KEPT.replace(cte("contacts"), cte("contacts", "delivery_attempts")) + _TRIAGE_TAIL + _FINAL + """,
res AS (SELECT plan.*, CAST(floor((plan.seq - 1) / 5) + 1 AS BIGINT) AS batch_no,
         (plan.is_valid AND coalesce(fo.success, false)) AS r_success,
         CASE WHEN NOT plan.is_valid THEN 'validation_failed' ELSE fo.error_code END AS r_error
       FROM plan LEFT JOIN fo ON plan.line_number = fo.contact_id)
"""

ORACLE["import_results"] = _IMPORT + f"""
SELECT line_number, {_CID} AS contact_id, batch_no, seq, r_success AS success, r_error AS error_code FROM res
"""

ORACLE["batch_stats"] = _IMPORT + f""",
b AS (SELECT batch_no, count(*) AS total, count(*) FILTER (WHERE r_success) AS successful,
        count(*) FILTER (WHERE NOT r_success) AS failed,
        count(*) FILTER (WHERE r_error = 'validation_failed') AS validation_failed,
        count(*) FILTER (WHERE coalesce(r_error, '') <> 'validation_failed') AS processed
      FROM res GROUP BY batch_no)
SELECT batch_no, CAST(total AS BIGINT) AS total, CAST(successful AS BIGINT) AS successful,
  CAST(failed AS BIGINT) AS failed, CAST(validation_failed AS BIGINT) AS validation_failed,
  CAST(processed AS BIGINT) AS processed, {rate('successful', 'total')} AS success_rate
FROM b
"""

ORACLE["batch_totals"] = _IMPORT + f""",
t AS (SELECT count(DISTINCT batch_no) AS total_batches, count(*) AS total_requests,
        count(*) FILTER (WHERE r_success) AS successful, count(*) FILTER (WHERE NOT r_success) AS failed FROM res)
SELECT CAST(total_batches AS BIGINT) AS total_batches, CAST(total_requests AS BIGINT) AS total_requests,
  CAST(successful AS BIGINT) AS successful, CAST(failed AS BIGINT) AS failed,
  {rate('successful', 'total_requests')} AS success_rate
FROM t
"""

ORACLE["delivery_run_stats"] = _TRIAGE + f""",
s AS (SELECT count(*) AS t, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS bad,
        max(attempted_at) AS last_operation_at FROM tr2)
SELECT CAST(t AS BIGINT) AS total_operations, CAST(ok AS BIGINT) AS successful_operations,
  CAST(bad AS BIGINT) AS failed_operations, last_operation_at, {rate('ok', 't')} AS success_rate FROM s
"""

_OUTCOMES = VALIDATED.replace(cte("contacts"), cte("contacts", "delivery_attempts")) + _marked("email", "v") + \
    _TRIAGE_TAIL + _FINAL + """,
oc AS (SELECT v.line_number,
         CASE WHEN NOT v.is_valid AND EXISTS (SELECT 1 FROM fnd WHERE fnd.line_number = v.line_number
                                               AND fnd.code IN ('MISSING_EMAIL', 'INVALID_EMAIL_FORMAT'))
              THEN 'invalid_email'
              WHEN NOT v.is_valid THEN 'validation_failed'
              WHEN mk.dup_number > 1 THEN 'duplicate' END AS skip_reason,
         fo.success AS ok, fo.error_code AS err
       FROM v JOIN mk ON v.line_number = mk.line_number LEFT JOIN fo ON v.line_number = fo.contact_id),
oc2 AS (SELECT *,
  CASE WHEN skip_reason IN ('invalid_email', 'duplicate', 'missing_phone') THEN 'skipped'
       WHEN skip_reason IS NOT NULL THEN 'failed' WHEN ok IS NULL THEN 'not_sent'
       WHEN ok THEN 'successful' ELSE 'failed' END AS status,
  CASE WHEN skip_reason = 'validation_failed' THEN 'validation_failed'
       WHEN skip_reason IS NULL AND NOT coalesce(ok, true) THEN err END AS error_code
  FROM oc)
"""

ORACLE["session_counters"] = _OUTCOMES + f""",
s AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE status = 'successful') AS successful_records,
  count(*) FILTER (WHERE status = 'failed') AS failed_records, count(*) FILTER (WHERE status = 'skipped') AS skipped_records,
  count(*) FILTER (WHERE skip_reason = 'duplicate') AS duplicates_found,
  count(*) FILTER (WHERE skip_reason = 'invalid_email') AS invalid_emails,
  count(*) FILTER (WHERE skip_reason = 'missing_phone') AS missing_phones,
  count(*) FILTER (WHERE error_code = 'validation_failed') AS validation_errors,
  count(*) FILTER (WHERE error_code = 'API_ERROR') AS api_errors,
  count(*) FILTER (WHERE error_code = 'NETWORK_ERROR') AS network_errors,
  count(*) FILTER (WHERE status = 'failed' AND error_code NOT IN ('validation_failed', 'API_ERROR', 'NETWORK_ERROR'))
    AS other_errors
  FROM oc2)
SELECT CAST(total_records AS BIGINT) AS total_records, CAST(successful_records AS BIGINT) AS successful_records,
  CAST(failed_records AS BIGINT) AS failed_records, CAST(skipped_records AS BIGINT) AS skipped_records,
  CAST(duplicates_found AS BIGINT) AS duplicates_found, CAST(invalid_emails AS BIGINT) AS invalid_emails,
  CAST(missing_phones AS BIGINT) AS missing_phones, CAST(validation_errors AS BIGINT) AS validation_errors,
  CAST(api_errors AS BIGINT) AS api_errors, CAST(network_errors AS BIGINT) AS network_errors,
  CAST(other_errors AS BIGINT) AS other_errors,
  CAST(successful_records + failed_records + skipped_records AS BIGINT) AS processed_records,
  {rate('successful_records', 'total_records')} AS success_rate
FROM s
"""

ORACLE["resume_remainder"] = _KEPT.replace(cte("contacts"), cte("contacts", "delivery_attempts")) + \
    _TRIAGE_TAIL + _FINAL + f"""
SELECT line_number, {_CID} AS contact_id FROM kept
WHERE is_valid AND line_number NOT IN (SELECT contact_id FROM fo WHERE success)
"""

ORACLE["processed_marks"] = _IMPORT + f""",
uq AS (SELECT mk2.dup_key AS contact_id, mk2.line_number FROM (
         SELECT line_number, {lower_trim('email')} AS dup_key,
                row_number() OVER (PARTITION BY {lower_trim('email')} ORDER BY line_number) AS rn
         FROM v WHERE is_valid) mk2 WHERE rn = 1),
rr AS (SELECT {_CID} AS contact_id, seq, r_success AS success,
         CASE WHEN r_success THEN 'Successfully subscribed' ELSE r_error END AS message FROM res),
last AS (SELECT contact_id, success, message FROM (
         SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY seq DESC) AS rn FROM rr) x WHERE rn = 1)
SELECT uq.contact_id, uq.line_number, last.contact_id IS NOT NULL AS processed, last.success, last.message,
  (last.contact_id IS NOT NULL AND coalesce(last.success, false)) AS was_successful
FROM uq LEFT JOIN last ON uq.contact_id = last.contact_id
"""


# --- triage -------------------------------------------------------------------

ORACLE["error_categories"] = VALIDATED.replace(cte("contacts"), cte("contacts", "delivery_attempts")) + \
    _TRIAGE_TAIL + """,
ge AS (SELECT 'Error' AS error_name, 'Subscriber validation failed: ' || coalesce(string_agg(message, ', ' ORDER BY r), '')
         AS error_message FROM v LEFT JOIN fnd ON v.line_number = fnd.line_number AND fnd.severity = 'error'
       WHERE NOT v.is_valid GROUP BY v.line_number),
ae AS (SELECT CASE WHEN error_code = 'AUTH_ERROR' THEN 'AuthenticationError' WHEN error_code = 'RATE_LIMIT_ERROR' THEN 'RateLimitError' WHEN error_code = 'API_ERROR' THEN 'ApiError' WHEN error_code = 'TIMEOUT_ERROR' THEN 'TimeoutError' WHEN error_code = 'NETWORK_ERROR' THEN 'NetworkError' WHEN error_code = 'GRAPHQL_ERROR' THEN 'GraphQLError' END AS error_name,
         CASE WHEN error_code = 'AUTH_ERROR' THEN 'Authentication failed: HTTP request failed' WHEN error_code = 'RATE_LIMIT_ERROR' THEN CASE WHEN retry_after_s IS NOT NULL THEN 'Rate limit exceeded. Retry after ' || CAST(retry_after_s AS VARCHAR) || ' seconds' ELSE 'Rate limit exceeded' END WHEN error_code = 'API_ERROR' THEN 'HTTP request failed' WHEN error_code = 'TIMEOUT_ERROR' THEN 'Operation ''network_request'' timed out after 0ms' WHEN error_code = 'NETWORK_ERROR' THEN 'Network error: Connection refused' WHEN error_code = 'GRAPHQL_ERROR' THEN 'GraphQL error' END AS error_message FROM tr2 WHERE NOT success),
al AS (SELECT * FROM ge UNION ALL SELECT * FROM ae),
cat AS (SELECT CASE WHEN contains(coalesce(error_name, ''), 'Validation') OR contains(coalesce(error_message, ''), 'validation') THEN 'validation_error' WHEN contains(coalesce(error_name, ''), 'Network') OR contains(coalesce(error_message, ''), 'network') THEN 'network_error' WHEN contains(coalesce(error_name, ''), 'Auth') OR contains(coalesce(error_message, ''), 'authentication') THEN 'authentication_error' WHEN contains(coalesce(error_name, ''), 'Rate') OR contains(coalesce(error_message, ''), 'rate limit') THEN 'rate_limit_error' ELSE 'unknown_error' END AS category FROM al)
SELECT category, CAST(count(*) AS BIGINT) AS errors,
  CASE category WHEN 'validation_error' THEN 'Review input data format and validation rules' WHEN 'network_error' THEN 'Check network connectivity and retry with backoff' WHEN 'authentication_error' THEN 'Verify API credentials and token validity' WHEN 'rate_limit_error' THEN 'Reduce request rate and implement proper throttling' WHEN 'unknown_error' THEN 'Review error details and contact support if needed' ELSE 'Review error details and contact support if needed' END AS suggestion
FROM cat GROUP BY category
"""

ORACLE["quality_issues"] = VALIDATED + """,
iss AS (SELECT message AS issue, CASE WHEN severity = 'error' THEN 'high' ELSE 'medium' END AS severity FROM fnd),
g AS (SELECT issue, severity, CAST(count(*) AS BIGINT) AS occurrences FROM iss GROUP BY issue, severity)
SELECT issue, severity, occurrences, CASE severity WHEN 'low' THEN 'debug' WHEN 'medium' THEN 'warn' WHEN 'high' THEN 'error' WHEN 'critical' THEN 'error' ELSE 'warn' END AS level,
  array_to_string(CASE WHEN contains(issue, 'email') THEN ['Validate email format before processing', 'Consider implementing fuzzy matching for typos'] ELSE [] END || CASE WHEN contains(issue, 'phone') THEN ['Standardize phone number format', 'Allow international number formats'] ELSE [] END || CASE WHEN contains(issue, 'duplicate') THEN ['Implement deduplication strategy', 'Consider merge rules for duplicate data'] ELSE [] END || CASE WHEN severity = 'critical' THEN ['Stop processing and review data source'] ELSE [] END, '; ') AS recommendations
FROM g
"""

# --- file sources -------------------------------------------------------------

_BLANK_ROW = " AND ".join(f"({c} IS NULL OR {js_trim(c)} = '')" for c in ("email", "first_name", "last_name", "phone_number"))

ORACLE["csv_contacts"] = cte("contacts") + f"""
SELECT CAST(line_number + 1 AS BIGINT) AS line_number, email, first_name, last_name, phone_number
FROM contacts WHERE NOT ({_BLANK_ROW})
"""

ORACLE["csv_quarantine"] = cte("contacts") + f"""
SELECT CAST(line_number + 1 AS BIGINT) AS line_number, 'Empty row' AS error FROM contacts WHERE {_BLANK_ROW}
"""

ORACLE["csv_max_rows"] = f"SELECT * FROM ({ORACLE['csv_contacts']}) c WHERE line_number <= 100"

ORACLE["csv_read_stats"] = cte("contacts") + f"""
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE NOT ({_BLANK_ROW})) AS BIGINT) AS valid_rows,
  CAST(count(*) FILTER (WHERE {_BLANK_ROW}) AS BIGINT) AS invalid_rows, CAST(count(*) AS BIGINT) AS data_rows FROM contacts
"""

ORACLE["csv_quoted_newline"] = cte("contacts") + f"""
SELECT CAST(line_number + 1 AS BIGINT) AS line_number, email, 'An' || chr(10) || '"x", ' || first_name AS first_name,
  last_name, phone_number
FROM contacts WHERE NOT ({_BLANK_ROW} AND first_name IS NULL)
"""

ORACLE["csv_append_roundtrip"] = cte("contacts") + f"""
SELECT email, first_name, last_name, phone_number FROM contacts WHERE NOT ({_BLANK_ROW})
"""

# the files of even lines hold a note, so none of their rows is empty
ORACLE["csv_mixed_headers"] = cte("contacts") + f"""
SELECT email, first_name, last_name, phone_number FROM contacts WHERE line_number % 2 = 0 OR NOT ({_BLANK_ROW})
"""

ORACLE["csv_wide_files"] = cte("contacts") + f"""
SELECT email, CAST(NULL AS VARCHAR) AS first_name, CAST(NULL AS VARCHAR) AS last_name, CAST(NULL AS VARCHAR) AS phone_number
FROM contacts WHERE line_number % 2 = 1 AND email IS NOT NULL AND {js_trim('email')} <> ''
UNION ALL
SELECT email, first_name || chr(10) || '"2", b', last_name, phone_number FROM contacts WHERE line_number % 2 = 0
"""

ORACLE["csv_count_newlines"] = cte("contacts") + f"""
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE NOT ({_BLANK_ROW} AND last_name IS NULL)) AS BIGINT) AS valid_rows,
  CAST(count(*) FILTER (WHERE {_BLANK_ROW} AND last_name IS NULL) AS BIGINT) AS invalid_rows, CAST(count(*) AS BIGINT) AS data_rows FROM contacts
"""

ORACLE["header_check"] = cte("contacts") + """,
d AS (SELECT DISTINCT split_part(email, '@', 2) AS d FROM contacts WHERE regexp_matches(split_part(email, '@', 2), '^[A-Za-z0-9.]+$'))
SELECT 'error' AS kind, 'Required header ''company'' not found. Expected one of: company' AS message, count(*) AS files FROM d
UNION ALL SELECT 'warning', 'Unexpected header ''' || lower(d) || ''' will be ignored', count(*) FROM d GROUP BY 2
"""

_QUOTED = "'\"' || replace(coalesce({0}, ''), '\"', '\"\"') || '\"'"

ORACLE["export_findings_csv"] = VALIDATED + f"""
SELECT 'Type,Row,Field,Value,Message' AS line
UNION ALL
SELECT CASE WHEN severity = 'error' THEN 'Error' ELSE 'Warning' END || ',' || line_number || ',' || coalesce(field, '') || ',' ||
  {_QUOTED.format('value')} || ',' || {_QUOTED.format('message')} FROM fnd
"""

ORACLE["export_findings_text"] = VALIDATED + """
SELECT 'VALIDATION REPORT' AS line
UNION ALL
SELECT row_number() OVER (PARTITION BY severity ORDER BY line_number, finding_no) || '. Row ' || line_number || ': ' || message
FROM fnd
"""

ORACLE["export_delivery_csv"] = _IMPORT + f"""
SELECT 'Type,Row,Email,Status,Message' AS line
UNION ALL
SELECT CASE WHEN r_success THEN 'Success' ELSE 'Error' END || ',' || line_number || ',' || {_QUOTED.format(_CID)} || ',' ||
  CASE WHEN r_success THEN 'Imported' ELSE 'Failed' END || ',' || {_QUOTED.format('r_error')} FROM res
"""

ORACLE["checkpoints_after_cleanup"] = cte("checkpoints") + """
SELECT session_id, checkpoint_id, ts, status, total, processed FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, checkpoint_id DESC) AS rn FROM checkpoints) x
WHERE rn <= 10
"""

ORACLE["recent_issues"] = cte("progress_events") + """
SELECT session_id, seq, ts, type, CAST(rn AS BIGINT) AS newest FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, type ORDER BY ts DESC, seq DESC) AS rn FROM progress_events
  WHERE type IN ('error_occurred', 'warning_occurred')) x
WHERE rn <= CASE type WHEN 'error_occurred' THEN 5 ELSE 3 END
"""

ORACLE["dedup_across_runs"] = f"""
SELECT d.* FROM ({ORACLE['dup_email']}) d
WHERE line_number > (SELECT floor(max(line_number) / 2) FROM ({ORACLE['dup_email']}) m)
"""

# --- near duplicates (brute force on the oracle side) ---------------------------


def _near_sql(t: float) -> str:
    return VALIDATED + _marked("email") + f""",
u AS (SELECT v.line_number, lower(v.email) AS e FROM v JOIN mk ON v.line_number = mk.line_number WHERE mk.dup_number = 1),
p AS (SELECT a.line_number AS probe_line, b.line_number AS match_line,
        CAST(greatest(length(a.e), length(b.e)) - levenshtein(a.e, b.e) AS DOUBLE) / greatest(length(a.e), length(b.e)) AS sim
      FROM u a, u b WHERE a.line_number <> b.line_number)
SELECT probe_line, match_line, round(sim, 6) AS similarity, 'email_similarity' AS reason,
  CAST(row_number() OVER (PARTITION BY probe_line ORDER BY sim DESC, match_line) AS BIGINT) AS rank
FROM p WHERE sim >= {t} AND sim < 1.0
"""


ORACLE["potential_duplicates"] = _near_sql(0.9)
ORACLE["potential_duplicates_08"] = _near_sql(0.8)

# --- streaming: same answers as the batch queries -------------------------------

ORACLE["stream_validate"] = ORACLE["validation_findings"]
ORACLE["stream_dedup"] = ORACLE["dup_email"]
ORACLE["stream_progress"] = ORACLE["session_event_stats"]


def _last_of(type_: str, value: str) -> str:
    return f"arg_max({value}, (ts, seq)) FILTER (WHERE type = '{type_}')"


_TRACKED = f"""SELECT *, {rate('successful', 'processed')} AS success_rate FROM (SELECT session_id, count(*) AS events,
  count(*) FILTER (WHERE type = 'record_processed') AS processed,
  count(*) FILTER (WHERE type = 'record_processed' AND coalesce(success, false)) AS successful,
  count(*) FILTER (WHERE type = 'record_processed' AND NOT coalesce(success, false)) AS failed,
  count(*) FILTER (WHERE type = 'warning_occurred') AS warnings,
  count(*) FILTER (WHERE type = 'error_occurred') AS errors,
  count(*) FILTER (WHERE type = 'milestone_reached') AS milestones,
  count(*) FILTER (WHERE type = 'batch_complete') AS batches,
  {_last_of('phase_change', 'phase')} AS phase,
  {_last_of('batch_start', 'batch_number')} AS current_batch,
  coalesce({_last_of('session_complete', "CASE WHEN coalesce(success, false) THEN 'completed' ELSE 'failed' END")}, 'active') AS status,
  {_ms('min(ts)', 'max(ts)')} AS duration_ms
  FROM tracker_events GROUP BY session_id) s"""

ORACLE["tracker_stats"] = cte("tracker_events") + _TRACKED

ORACLE["stream_tracker"] = cte("tracker_events") + f""",
b AS (SELECT session_id, duration_ms AS d, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS i,
        count(*) OVER (PARTITION BY session_id) AS n FROM tracker_events WHERE type = 'batch_complete' AND duration_ms > 0),
e AS (SELECT session_id, round(sum(CASE WHEN i = 1 THEN pow(0.8, n - 1) ELSE (1.0 - 0.8) * pow(0.8, n - i) END * d), 6) AS ema_batch_ms
      FROM b GROUP BY session_id),
t AS ({_TRACKED})
SELECT t.*, e.ema_batch_ms FROM t LEFT JOIN e ON e.session_id = t.session_id
"""

ORACLE["import_dry_run"] = ORACLE["batch_plan"]

ORACLE["import_skip_validation"] = _KEPT + f"""
SELECT line_number, {_CID} AS contact_id, (NOT {miss('email')} AND {email_ok()}) AS is_valid, seq,
  CAST(floor((seq - 1) / 5) + 1 AS BIGINT) AS batch_no
FROM plan
"""

# the stub's outcome: 20 classes by the first six hexadecimal digits of the md5 of the e-mail
_HEX = " + ".join(f"(instr('0123456789abcdef', substr(md5({_CID}), {i + 1}, 1)) - 1) * {16 ** (5 - i)}" for i in range(6))
_STUB = _KEPT + f""",
st AS (SELECT {_CID} AS contact_id, is_valid, CAST(floor((seq - 1) / 5) + 1 AS BIGINT) AS batch_no, seq,
         ({_HEX}) % 20 AS h FROM plan)
"""

ORACLE["delivery_interrupted"] = _STUB + """,
sl AS (SELECT *, CAST(floor((batch_no - 1) / CAST(ceil((SELECT count(*) FROM contacts) / 25.0) AS DOUBLE)) AS BIGINT) AS slice FROM st WHERE is_valid)
SELECT contact_id, h >= 2 AS success, CASE h WHEN 0 THEN 'AUTH_ERROR' WHEN 1 THEN 'API_ERROR' END AS error_code,
  CAST(1 + CASE WHEN slice = 2 THEN 1 ELSE 0 END + CASE WHEN slice < 2 AND h < 2 THEN 1 ELSE 0 END AS BIGINT) AS sends,
  CASE WHEN h >= 2 THEN '{"id": "' || substr(md5(contact_id), 1, 8) || '"}' END AS data,
  CASE h WHEN 0 THEN 'HTTP 401' WHEN 1 THEN 'HTTP 404' END AS error
FROM sl
"""

ORACLE["delivery_stub"] = _STUB + """
SELECT 'stub-run' AS session_id, contact_id, batch_no, seq, h >= 2 AS success,
  CASE h WHEN 0 THEN 'AUTH_ERROR' WHEN 1 THEN 'API_ERROR' END AS error_code,
  CAST(CASE WHEN h = 2 THEN 2 ELSE 1 END AS INT) AS attempts
FROM st WHERE is_valid
"""


def _totals_sql(rows: str, ok: str) -> str:
    return rows + f""",
t AS (SELECT count(DISTINCT batch_no) AS b, count(*) AS n, count(*) FILTER (WHERE {ok}) AS g FROM st)
SELECT CAST(b AS BIGINT) AS total_batches, CAST(n AS BIGINT) AS total_requests, CAST(g AS BIGINT) AS successful,
  CAST(n - g AS BIGINT) AS failed, {rate('g', 'n')} AS success_rate FROM t
"""


ORACLE["import_summary"] = _totals_sql(_STUB, "is_valid")
ORACLE["import_resume_summary"] = _totals_sql(_STUB, "is_valid AND h >= 2")

# --- views and listings ------------------------------------------------------------


def _mask_email_sql(x: str) -> str:
    return (f"CASE WHEN {miss(x)} THEN '' WHEN coalesce(split_part({x}, '@', 1), '') <> '' AND "
            f"coalesce(split_part({x}, '@', 2), '') <> '' THEN substr(split_part({x}, '@', 1), 1, 2) || '***@' || "
            f"split_part({x}, '@', 2) ELSE {x} END")


ORACLE["safe_view"] = VALIDATED + f""",
msg AS (SELECT line_number,
          string_agg(message, '; ' ORDER BY r) FILTER (WHERE severity = 'error') AS errors,
          string_agg(message, '; ' ORDER BY r) FILTER (WHERE severity = 'warning') AS warnings
        FROM fnd GROUP BY line_number)
SELECT v.line_number, {_mask_email_sql('v.email')} AS email,
  coalesce(v.first_name, '') AS first_name, coalesce(v.last_name, '') AS last_name,
  CASE WHEN {miss('v.phone_number')} THEN ''
       WHEN length(regexp_replace(v.phone_number, '[^0-9]', '', 'g')) < 4 THEN v.phone_number
       ELSE '+***' || right(regexp_replace(v.phone_number, '[^0-9]', '', 'g'), 4) END AS phone_number,
  CASE WHEN {js_trim("coalesce(v.first_name, '') || ' ' || coalesce(v.last_name, '')")} <> ''
       THEN {js_trim("coalesce(v.first_name, '') || ' ' || coalesce(v.last_name, '')")}
       ELSE split_part(v.email, '@', 1) END AS full_name,
  (NOT {miss('v.email')} AND {email_ok('v.email')}) AS has_valid_email,
  {has_phone('v.phone_number')} AS has_phone_number, v.is_valid,
  coalesce(msg.errors, '') AS errors, coalesce(msg.warnings, '') AS warnings
FROM v LEFT JOIN msg ON v.line_number = msg.line_number
"""

ORACLE["with_warnings"] = VALIDATED + """
SELECT line_number, is_valid, CAST(warning_count AS BIGINT) AS warning_count FROM v WHERE warning_count > 0
"""

ORACLE["duplicate_contacts"] = VALIDATED + _marked("email") + f"""
SELECT mk.line_number, {_mask_email_sql('d.email')} AS email, mk.dup_number, mk.first_line AS original_line,
  {_mask_email_sql('o.email')} AS original_email, o.first_name AS original_first_name,
  o.last_name AS original_last_name
FROM mk JOIN v d ON mk.line_number = d.line_number JOIN v o ON mk.first_line = o.line_number
WHERE mk.dup_number > 1
"""

ORACLE["duplicate_lookup"] = VALIDATED + _marked("email") + """
SELECT line_number, dup_key, dup_number, CASE WHEN dup_number > 1 THEN first_line END AS original_line
FROM mk WHERE dup_key = (SELECT min(dup_key) FROM mk WHERE dup_number = 2) AND dup_number IS NOT NULL
"""

ORACLE["run_totals_by_kind"] = cte("sessions") + f""",
t AS (SELECT CASE WHEN session_id % 2 = 1 THEN 'import' ELSE 'validate' END AS kind, CAST(count(*) AS BIGINT) AS runs,
  CAST(sum(total) AS BIGINT) AS records, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(successful) AS BIGINT) AS successful,
  CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(processed % 7) AS BIGINT) AS duplicates, max(start_time) AS last_run_at
  FROM sessions GROUP BY 1)
SELECT *, {rate('successful', 'processed')} AS success_rate FROM t
"""

ORACLE["duplicates_preview"] = VALIDATED + _marked("email") + f"""
SELECT mk.line_number, {_mask_email_sql('v.email')} AS email, mk.dup_number, mk.first_line AS original_line
FROM mk JOIN v ON mk.line_number = v.line_number WHERE mk.dup_number > 1 ORDER BY mk.line_number LIMIT 5
"""

ORACLE["merged_findings"] = ORACLE["validation_findings"]

ORACLE["dedup_report_groups"] = VALIDATED + _marked("email") + f""",
g AS (SELECT dup_key, CAST(count(*) AS BIGINT) AS total_count, min(line_number) AS original_line
      FROM mk WHERE dup_number IS NOT NULL GROUP BY dup_key HAVING count(*) > 1)
SELECT g.dup_key, g.total_count, g.original_line, {_mask_email_sql('v.email')} AS original_email,
  v.first_name, v.last_name
FROM g JOIN v ON g.original_line = v.line_number
"""
