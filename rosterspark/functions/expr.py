"""Row-local column expressions.

Every function takes and returns ``Column`` objects built from
``pyspark.sql.functions`` only, so rule evaluation stays inside whole-stage
codegen and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

ColumnOrName = "Column | str"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim like JavaScript: every Unicode space and the BOM, both ends."""
    ws = K.JS_WS_CLASS
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+\\z", "")


def is_missing(c) -> Column:
    """JavaScript falsiness for a string: NULL or empty.  Blank is not missing."""
    c = _col(c)
    return c.isNull() | (c == F.lit(""))


def is_blank(c) -> Column:
    """NULL, empty, or only whitespace."""
    c = _col(c)
    return c.isNull() | (js_trim(c) == F.lit(""))


def matches_email(c) -> Column:
    """E-mail pattern on the untrimmed value; NULL-safe (NULL -> false)."""
    c = _col(c)
    return F.coalesce(c.rlike(K.EMAIL_PATTERN), F.lit(False))


def matches_phone(c) -> Column:
    """Phone pattern on the trimmed value; NULL-safe."""
    return F.coalesce(js_trim(c).rlike(K.PHONE_PATTERN), F.lit(False))


def has_valid_email(email="email") -> Column:
    e = _col(email)
    return ~is_missing(e) & matches_email(e)


def has_phone(phone="phone_number") -> Column:
    p = _col(phone)
    return ~is_missing(p) & (js_trim(p) != F.lit(""))


def has_valid_phone(phone="phone_number") -> Column:
    return has_phone(phone) & matches_phone(phone)


def contact_id(email="email") -> Column:
    """Lower-case, trimmed e-mail (NULL when the e-mail is missing)."""
    e = _col(email)
    return F.when(~is_missing(e), js_trim(F.lower(e)))


def full_name(first="first_name", last="last_name", email="email") -> Column:
    """``trim(first + ' ' + last)``, else the e-mail's local part."""
    name = js_trim(F.concat(F.coalesce(_col(first), F.lit("")), F.lit(" "), F.coalesce(_col(last), F.lit(""))))
    return F.when(name != F.lit(""), name).otherwise(F.substring_index(_col(email), "@", 1))


def email_domain(email="email") -> Column:
    """Text between the first and the second ``@``; NULL when absent or empty."""
    e = _col(email)
    return F.nullif(F.get(F.split(e, "@"), 1), F.lit(""))


def mask_email(email="email") -> Column:
    """``jo***@example.com``; missing -> ''; no local or domain part -> unchanged."""
    e = _col(email)
    parts = F.split(e, "@")
    local = F.get(parts, 0)
    domain = F.get(parts, 1)
    ok = (F.coalesce(local, F.lit("")) != F.lit("")) & (F.coalesce(domain, F.lit("")) != F.lit(""))
    return (
        F.when(is_missing(e), F.lit(""))
        .when(ok, F.concat(F.substring(local, 1, 2), F.lit("***@"), domain))
        .otherwise(e)
    )


def mask_phone(phone="phone_number") -> Column:
    """Digits form: ``+***`` + last 4 digits; missing -> ''; < 4 digits -> unchanged."""
    p = _col(phone)
    digits = F.regexp_replace(p, "[^0-9]", "")
    return (
        F.when(is_missing(p), F.lit(""))
        .when(F.length(digits) < 4, p)
        .otherwise(F.concat(F.lit("+***"), F.right(digits, F.lit(4))))
    )


def mask_phone_tail(phone="phone_number") -> Column:
    """Log form: ``***`` + last 4 raw characters when longer than 4."""
    p = _col(phone)
    return F.when(F.length(p) > 4, F.concat(F.lit("***"), F.right(p, F.lit(4)))).otherwise(p)


def delivery_payload(email="email", phone="phone_number") -> Column:
    """JSON body sent for a contact; an invalid part is left out."""
    e, p = _col(email), _col(phone)
    return F.to_json(
        F.struct(
            F.when(has_valid_email(e), js_trim(F.lower(e))).alias("email"),
            F.when(has_valid_phone(p), js_trim(p)).alias("phoneNumber"),
        )
    )


def rate_pct(part, whole) -> Column:
    """``Math.round(100 * part / whole)``, 0 when ``whole`` is 0, as BIGINT."""
    part, whole = _col(part), _col(whole)
    return F.when(
        whole == 0, F.lit(0).cast("bigint")
    ).otherwise(F.floor(part.cast("double") / whole * F.lit(100) + F.lit(0.5)).cast("bigint"))


def rate_pct_sql(part: str, whole: str) -> str:
    """SQL text of ``rate_pct``, the same in Spark and DuckDB."""
    return (
        f"CASE WHEN ({whole}) = 0 THEN CAST(0 AS BIGINT) "
        f"ELSE CAST(floor(CAST({part} AS DOUBLE) / ({whole}) * 100 + 0.5) AS BIGINT) END"
    )


def redact_columns(df, sensitive=None, email_cols=("email",), phone_cols=("phoneNumber", "phone_number", "phone")):
    """P10: one projection masking e-mail/phone columns and redacting secrets."""
    sensitive = list(sensitive or K.SENSITIVE_COLUMNS)
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in email_cols:
            c = F.when(is_missing(c), c).otherwise(mask_email(c))
        elif name in phone_cols:
            c = F.when(is_missing(c), c).otherwise(mask_phone_tail(c))
        if name in sensitive:
            c = F.when(~is_missing(F.col(f"`{name}`")), F.lit(K.REDACTED)).otherwise(F.col(f"`{name}`"))
        out.append(c.alias(name))
    return df.select(*out)


def safe_view(df):
    """The only contact view reports may show: masked e-mail and phone, names, full name, flags."""
    cols = [c for c in ("line_number",) if c in df.columns]
    out = [
        *cols,
        mask_email("email").alias("email"),
        F.coalesce(F.col("first_name"), F.lit("")).alias("first_name"),
        F.coalesce(F.col("last_name"), F.lit("")).alias("last_name"),
        mask_phone("phone_number").alias("phone_number"),
        full_name().alias("full_name"),
        has_valid_email().alias("has_valid_email"),
        has_phone().alias("has_phone_number"),
    ]
    if "is_valid" in df.columns:
        out.append(F.col("is_valid"))
    if "findings" in df.columns:
        out.append(F.array_join(F.transform(F.filter("findings", lambda f: f["severity"] == "error"),
                                            lambda f: f["message"]), "; ").alias("errors"))
        out.append(F.array_join(F.transform(F.filter("findings", lambda f: f["severity"] == "warning"),
                                            lambda f: f["message"]), "; ").alias("warnings"))
    return df.select(*out)
