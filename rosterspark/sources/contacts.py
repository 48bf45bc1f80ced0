"""Column normalisation into the contact schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

CONTACT_COLUMNS = ["email", "first_name", "last_name", "phone_number"]


def alias_plan(columns, mode: str = "exact") -> dict:
    """Target column -> source column, first alias present (exact, case-sensitive).

    ``mode='relaxed'`` also accepts the header-check aliases, case-insensitively
    and trimmed (``E-mail``, ``mobile``, ``surname`` ...).
    """
    plan = {}
    for target, aliases in K.VALUE_ALIASES.items():
        hit = next((a for a in aliases if a in columns), None)
        if hit is None and mode == "relaxed":
            field = {v: k for k, v in K.HEADER_FIELD_TO_COLUMN.items()}[target]
            lowered = {c.lower().strip(): c for c in reversed(list(columns))}
            hit = next((lowered[a] for a in K.HEADER_ALIASES[field] if a in lowered), None)
        if hit is not None:
            plan[target] = hit
    return plan


def normalize_columns(df: DataFrame, mode: str = "exact", keep=("line_number",)) -> DataFrame:
    """One projection to ``keep… + email, first_name, last_name, phone_number``.

    Column choice is made once per input from its header (Q17); a target with
    no alias present becomes a NULL string column.  Names are matched
    case-sensitively by position, so ``email`` and ``EMAIL`` stay distinct.
    """
    cols = df.columns
    plan = alias_plan(cols, mode)
    # positional names first: Spark resolves names case-insensitively
    pos = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    out = [F.col(f"_c{cols.index(k)}").alias(k) for k in keep if k in cols]
    for target in CONTACT_COLUMNS:
        if target in plan:
            out.append(F.col(f"_c{cols.index(plan[target])}").cast("string").alias(target))
        else:
            out.append(F.lit(None).cast("string").alias(target))
    return pos.select(*out)


def to_contact(df: DataFrame, with_created_at: bool = True) -> DataFrame:
    """Missing first/last/phone -> '', e-mail untouched, source and creation time."""
    out = (
        df.withColumn("first_name", F.coalesce("first_name", F.lit("")))
        .withColumn("last_name", F.coalesce("last_name", F.lit("")))
        .withColumn("phone_number", F.coalesce("phone_number", F.lit("")))
        .withColumn("source", F.lit(K.SOURCE_CSV))
    )
    if with_created_at:
        out = out.withColumn("created_at", F.current_timestamp())
    return out
