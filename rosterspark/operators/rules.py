"""Validation rules.

A rule is data: a name, the strategy it belongs to, severity, field label,
code, and Column expressions for its condition, message and reported value.
``validate`` evaluates every selected rule in **one projection**: each rule
becomes ``when(cond, struct(...))`` and the array of non-null structs is the
row's ``findings``.  Nothing leaves the JVM unless a caller registers a
Python rule (the documented slow path).
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.expr import is_missing, js_trim, matches_email, matches_phone, has_valid_email

ERROR = "error"
WARNING = "warning"

FINDING_TYPE = T.StructType(
    [
        T.StructField("severity", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    """One named check.  ``condition``/``message``/``value`` build Columns."""

    name: str
    strategy: str
    severity: str
    field: str
    code: str
    condition: Callable[[], Column]
    message: Callable[[], Column]
    value: Callable[[], Column] = field(default=lambda: F.lit(None).cast("string"))
    enabled: bool = True

    def finding(self) -> Column:
        return F.when(
            self.condition(),
            F.struct(
                F.lit(self.severity).alias("severity"),
                F.lit(self.field).alias("field"),
                F.lit(self.code).alias("code"),
                self.message().cast("string").alias("message"),
                self.value().cast("string").alias("value"),
            ),
        )


def _c(name):
    return lambda: F.col(name)


def _lit(text):
    return lambda: F.lit(text)


def _email_ok():
    e = F.col("email")
    return ~is_missing(e) & matches_email(e)


def _typo_message() -> Column:
    e = F.col("email")
    out = None
    for ending, _suggestion, message in K.EMAIL_TYPOS:
        cond = e.endswith(ending)
        out = F.when(cond, F.lit(message)) if out is None else out.when(cond, F.lit(message))
    return out


def _typo_any() -> Column:
    e = F.col("email")
    cond = None
    for ending, _s, _m in K.EMAIL_TYPOS:
        c = e.endswith(ending)
        cond = c if cond is None else cond | c
    return cond


def default_rules(required_fields=("email",)) -> "OrderedDict[str, Rule]":
    """The built-in rules in evaluation order: e-mail, phone, required, name, completeness."""
    rules = [
        # e-mail strategy: an if-chain, at most one finding
        Rule("MISSING_EMAIL", "email", ERROR, K.FIELD_EMAIL, "MISSING_EMAIL",
             lambda: is_missing(F.col("email")), _lit(K.MSG_MISSING_EMAIL)),
        Rule("INVALID_EMAIL_FORMAT", "email", ERROR, K.FIELD_EMAIL, "INVALID_EMAIL_FORMAT",
             lambda: ~is_missing(F.col("email")) & ~matches_email(F.col("email")),
             _lit(K.MSG_INVALID_EMAIL), _c("email")),
        Rule("EMAIL_TOO_LONG", "email", ERROR, K.FIELD_EMAIL, "EMAIL_TOO_LONG",
             lambda: _email_ok() & (F.length("email") > K.EMAIL_MAX_LENGTH),
             _lit(K.MSG_EMAIL_TOO_LONG), _c("email")),
        Rule("POSSIBLE_TYPO", "email", WARNING, K.FIELD_EMAIL, "POSSIBLE_TYPO",
             lambda: _email_ok() & (F.length("email") <= K.EMAIL_MAX_LENGTH) & _typo_any(),
             _typo_message, _c("email")),
        # phone strategy: optional; a present, non-blank value must match
        Rule("INVALID_PHONE_FORMAT", "phone", ERROR, K.FIELD_PHONE, "INVALID_PHONE_FORMAT",
             lambda: ~is_missing(F.col("phone_number")) & (js_trim("phone_number") != "")
             & ~matches_phone(F.col("phone_number")),
             _lit(K.MSG_INVALID_PHONE), _c("phone_number")),
        # unreachable with the default pattern; kept for custom phone patterns
        Rule("PHONE_TOO_SHORT", "phone", ERROR, K.FIELD_PHONE, "PHONE_TOO_SHORT",
             lambda: matches_phone(F.col("phone_number")) & (F.length(js_trim("phone_number")) < K.PHONE_MIN_LENGTH),
             _lit(K.MSG_PHONE_TOO_SHORT), _c("phone_number"), enabled=False),
        Rule("PHONE_TOO_LONG", "phone", ERROR, K.FIELD_PHONE, "PHONE_TOO_LONG",
             lambda: matches_phone(F.col("phone_number")) & (F.length(js_trim("phone_number")) > K.PHONE_MAX_LENGTH),
             _lit(K.MSG_PHONE_TOO_LONG), _c("phone_number"), enabled=False),
    ]
    for fld in required_fields:
        rules.append(
            Rule(f"MISSING_REQUIRED_FIELD:{fld}", "required", ERROR, fld, "MISSING_REQUIRED_FIELD",
                 (lambda f=fld: is_missing(F.col(f))), _lit(f"{fld}{K.MSG_REQUIRED_SUFFIX}"), _c(fld))
        )
    for col, label, too_long, empty in (
        ("first_name", K.FIELD_FIRST, K.MSG_FIRST_TOO_LONG, K.MSG_FIRST_EMPTY),
        ("last_name", K.FIELD_LAST, K.MSG_LAST_TOO_LONG, K.MSG_LAST_EMPTY),
    ):
        rules.append(
            Rule(f"NAME_TOO_LONG:{label}", "name", WARNING, label, "NAME_TOO_LONG",
                 (lambda c=col: ~is_missing(F.col(c)) & (F.length(c) > K.NAME_MAX_LENGTH)), _lit(too_long), _c(col))
        )
        rules.append(
            Rule(f"EMPTY_NAME:{label}", "name", WARNING, label, "EMPTY_NAME",
                 (lambda c=col: ~is_missing(F.col(c)) & (js_trim(c) == "")), _lit(empty), _c(col))
        )
    rules += [
        Rule("MISSING_PHONE", "completeness", WARNING, K.FIELD_PHONE, "MISSING_PHONE",
             lambda: ~is_missing(F.col("email")) & is_missing(F.col("phone_number")), _lit(K.MSG_MISSING_PHONE)),
        Rule("MISSING_NAME", "completeness", WARNING, K.FIELD_NAME, "MISSING_NAME",
             lambda: is_missing(F.col("first_name")) & is_missing(F.col("last_name")), _lit(K.MSG_MISSING_NAME)),
    ]
    return OrderedDict((r.name, r) for r in rules)


class RuleRegistry:
    """Ordered, name-keyed rules.  Add / remove / get / list / replace."""

    def __init__(self, rules=None, required_fields=("email",)):
        self._rules = OrderedDict(rules) if rules is not None else default_rules(required_fields)

    def add(self, rule: Rule) -> None:
        if not isinstance(rule, Rule):
            raise TypeError("a rule must be a Rule")
        self._rules[rule.name] = rule

    replace = add

    def remove(self, name: str) -> None:
        self._rules.pop(name, None)

    def get(self, name: str):
        return self._rules.get(name)

    def names(self):
        return list(self._rules)

    def strategies(self):
        return list(OrderedDict.fromkeys(r.strategy for r in self._rules.values()))

    def select(self, names=None):
        """Rules to run.  ``names`` may hold rule names or strategy names; unknown ones are ignored."""
        active = [r for r in self._rules.values() if r.enabled]
        if names is None:
            return active
        wanted = set(names)
        return [r for r in self._rules.values() if (r.name in wanted) or (r.strategy in wanted and r.enabled)]


def findings_column(rules) -> Column:
    """``ARRAY<STRUCT<severity, field, code, message, value>>`` of the rules that fire."""
    if not rules:
        return F.array().cast(T.ArrayType(FINDING_TYPE))
    return F.filter(F.array(*[r.finding() for r in rules]), lambda x: x.isNotNull())


def _type_rules(df: DataFrame):
    """V2: a non-string e-mail/phone source column makes every present value a type error."""
    extra = []
    types = {f.name: f.dataType for f in df.schema.fields}
    if "email" in types and not isinstance(types["email"], T.StringType):
        extra.append(Rule("INVALID_EMAIL_TYPE", "email", ERROR, K.FIELD_EMAIL, "INVALID_EMAIL_TYPE",
                          lambda: F.col("email").isNotNull(), _lit(K.MSG_EMAIL_TYPE), _c("email")))
    if "phone_number" in types and not isinstance(types["phone_number"], T.StringType):
        extra.append(Rule("INVALID_PHONE_TYPE", "phone", ERROR, K.FIELD_PHONE, "INVALID_PHONE_TYPE",
                          lambda: F.col("phone_number").isNotNull(), _lit(K.MSG_PHONE_TYPE), _c("phone_number")))
    return extra


def validate(df: DataFrame, rules=None, registry: RuleRegistry | None = None, strict: bool = False,
             required_fields=("email",)) -> DataFrame:
    """Add ``findings``, ``error_count``, ``warning_count`` and ``is_valid``.

    ``rules`` names rules or strategies to run (default: all enabled ones).
    ``strict`` (V22) makes warnings count as errors for ``is_valid``.
    """
    registry = registry or RuleRegistry(required_fields=required_fields)
    selected = registry.select(rules)
    if any(getattr(r, "is_python", False) for r in selected):
        from ..session import ship_package

        ship_package(df.sparkSession)
    type_rules = _type_rules(df)
    if type_rules:
        # a type error replaces the format checks of that field
        bad = {r.strategy for r in type_rules}
        selected = type_rules + [r for r in selected if r.strategy not in bad]
        df = df.withColumn("email", F.col("email").cast("string")).withColumn(
            "phone_number", F.col("phone_number").cast("string"))
    out = df.withColumn("findings", findings_column(selected))
    errors = F.size(F.filter("findings", lambda f: f["severity"] == ERROR))
    warnings = F.size(F.filter("findings", lambda f: f["severity"] == WARNING))
    ok = (errors == 0) if not strict else (F.size("findings") == 0)
    return (
        out.withColumn("error_count", errors)
        .withColumn("warning_count", warnings)
        .withColumn("is_valid", ok & has_valid_email("email"))
    )


def explode_findings(validated: DataFrame, keys=("line_number",)) -> DataFrame:
    """Long table ``keys…, finding_no, severity, field, code, message, value``."""
    return validated.select(*keys, F.posexplode("findings").alias("pos", "f")).select(
        *keys,
        (F.col("pos") + 1).cast("bigint").alias("finding_no"),
        F.col("f.severity").alias("severity"),
        F.col("f.field").alias("field"),
        F.col("f.code").alias("code"),
        F.col("f.message").alias("message"),
        F.col("f.value").alias("value"),
    )


def finding_summary(validated: DataFrame, keys=("line_number",)) -> DataFrame:
    """Per row counts, distinct fields with errors / warnings, messages."""
    err = F.filter("findings", lambda f: f["severity"] == ERROR)
    warn = F.filter("findings", lambda f: f["severity"] == WARNING)
    return validated.select(
        *keys,
        "is_valid",
        F.size(err).cast("bigint").alias("error_count"),
        F.size(warn).cast("bigint").alias("warning_count"),
        F.array_join(F.array_distinct(F.transform(err, lambda f: f["field"])), ",").alias("error_fields"),
        F.array_join(F.array_distinct(F.transform(warn, lambda f: f["field"])), ",").alias("warning_fields"),
        F.array_join(F.transform(err, lambda f: f["message"]), "; ").alias("error_messages"),
        F.array_join(F.transform(warn, lambda f: f["message"]), "; ").alias("warning_messages"),
    )


def findings_for_field(findings: Column | str, fld: str, severity: str = ERROR) -> Column:
    return F.filter(findings, lambda f: (f["field"] == fld) & (f["severity"] == severity))


def has_errors_for_field(findings: Column | str, fld: str) -> Column:
    return F.exists(findings, lambda f: (f["field"] == fld) & (f["severity"] == ERROR))


def _count_of(severity: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["severity"] == severity))


def merge_findings(a: DataFrame, b: DataFrame, key: str = "line_number") -> DataFrame:
    """Concatenate two validations of the same rows; valid only if both are."""
    b2 = b.select(key, F.col("findings").alias("_f2"), F.col("is_valid").alias("_v2"))
    out = (
        a.join(b2, key, "inner")
        .withColumn("findings", F.concat("findings", "_f2"))
        .withColumn("is_valid", F.col("is_valid") & F.col("_v2"))
        .drop("_f2", "_v2")
    )
    for name, severity in (("error_count", ERROR), ("warning_count", WARNING)):
        if name in out.columns:
            out = out.withColumn(name, _count_of(severity).cast(dict(a.dtypes)[name]))
    return out


def split_valid(validated: DataFrame):
    """``(valid, invalid)``.  Persist or checkpoint ``validated`` first when both are used."""
    return validated.filter("is_valid"), validated.filter(~F.col("is_valid"))


def with_warnings(validated: DataFrame) -> DataFrame:
    """Rows with any warning, valid or not."""
    return validated.filter(F.exists("findings", lambda f: f["severity"] == WARNING))


def column_rule(name, severity, fld, code, condition: Column, message: str, value: Column | None = None,
                strategy: str = "custom") -> Rule:
    """a custom rule from Column expressions (the fast path)."""
    return Rule(name, strategy, severity, fld, code, lambda: condition, lambda: F.lit(message),
                (lambda: value) if value is not None else (lambda: F.lit(None).cast("string")))


def python_rule(name: str, fn: Callable, columns, severity=ERROR, fld="validation", code="CUSTOM",
                strategy="custom") -> Rule:
    """F1 slow path: ``fn(row_dict) -> message or None`` evaluated in an Arrow-batched pandas UDF.

    V15: if ``fn`` raises, the row gets one ``STRATEGY_ERROR`` on field
    ``validation`` and the other rules still run.
    """
    import pandas as pd

    cols = list(columns)

    @F.pandas_udf("kind string, message string")
    def _run(*series):
        kinds, msgs = [], []
        frame = pd.concat(series, axis=1, keys=cols)
        for rec in frame.to_dict("records"):
            try:
                m = fn(rec)
                kinds.append("hit" if m else None)
                msgs.append(m if m else None)
            except Exception as exc:  # noqa: BLE001 - reported as a finding
                kinds.append("crash")
                msgs.append(f"Strategy {name} failed: {exc}")
        return pd.DataFrame({"kind": kinds, "message": msgs})

    def _res():
        return _run(*[F.col(c) for c in cols])

    class _PyRule(Rule):
        is_python = True

        def finding(self_inner) -> Column:
            r = _res()
            return (
                F.when(r["kind"] == "hit", F.struct(F.lit(severity).alias("severity"), F.lit(fld).alias("field"),
                                                    F.lit(code).alias("code"), r["message"].alias("message"),
                                                    F.lit(None).cast("string").alias("value")))
                .when(r["kind"] == "crash", F.struct(F.lit(ERROR).alias("severity"),
                                                     F.lit(K.FIELD_VALIDATION).alias("field"),
                                                     F.lit("STRATEGY_ERROR").alias("code"),
                                                     r["message"].alias("message"),
                                                     F.lit(name).alias("value")))
            )

    return _PyRule(name, strategy, severity, fld, code, lambda: F.lit(True), lambda: F.lit(""))
