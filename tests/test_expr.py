"""Unit tables for the row-local expressions (FIXTURES.md §4)."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterspark.functions import constants as K
from rosterspark.functions import expr as X
from rosterspark.plans import oracle_sql as O

EMAILS = [
    ("a@b", True), ("a@b.com", True), (" a@b.com", False), ("a@b.com\n", False), ("a@-b.com", False),
    ("a@b-.com", False), ("x@" + "a" * 63 + ".com", True), ("x@" + "a" * 64 + ".com", False),
    ("a..b@c.de", True), ("a@b..c", False), ("é@b.com", False), ("o'x+1@s.co.uk", True), ("a@b@c", False),
    ("@b.com", False), ("a@", False),
]
PHONES = [
    ("+1234567890", True), ("+" + "1" * 9, False), ("+" + "1" * 15, True), ("+" + "1" * 16, False),
    (" +1234567890 ", True), ("+1 (838) 555-7235", False), ("5551234", False), ("+1234567890\n", True),
]


def test_email_pattern_spark_duckdb_python(spark):
    df = spark.createDataFrame([(e,) for e, _ in EMAILS], "email string")
    got = [r[0] for r in df.select(X.matches_email("email")).collect()]
    assert got == [ok for _, ok in EMAILS]
    py = re.compile(K.EMAIL_PATTERN.replace("\\z", "\\Z"))
    assert [bool(py.search(e)) for e, _ in EMAILS] == [ok for _, ok in EMAILS]
    con = duckdb.connect()
    for e, ok in EMAILS:
        assert con.execute(f"SELECT {O.email_ok('x')} FROM (SELECT ? AS x)", [e]).fetchone()[0] == ok, e


def test_phone_pattern_on_trimmed_value(spark):
    df = spark.createDataFrame([(p,) for p, _ in PHONES], "p string")
    got = [r[0] for r in df.select(X.matches_phone("p")).collect()]
    # a trailing newline is whitespace for the JavaScript trim, so it is removed before the match
    assert got == [ok for _, ok in PHONES]


def test_js_trim_unicode_spaces(spark):
    s = " ﻿　 a b  \t"
    df = spark.createDataFrame([(s,), ("   ",), (None,)], "s string")
    assert [r[0] for r in df.select(X.js_trim("s")).collect()] == ["a b", "", None]
    con = duckdb.connect()
    assert con.execute(f"SELECT {O.js_trim('x')} FROM (SELECT ? AS x)", [s]).fetchone()[0] == "a b"


@pytest.mark.parametrize("email,masked", [
    ("john@example.com", "jo***@example.com"), ("a@b", "a***@b"), ("abc", "abc"), ("a@b@c", "a***@b"),
    ("", ""), (None, ""),
])
def test_mask_email(spark, email, masked):
    df = spark.createDataFrame([(email,)], "email string")
    assert df.select(X.mask_email("email")).first()[0] == masked


def test_mask_phone_forms(spark):
    df = spark.createDataFrame([("+1234567890",), ("123",), ("",), (None,)], "phone_number string")
    got = df.select(X.mask_phone(), X.mask_phone_tail()).collect()
    assert [tuple(r) for r in got] == [("+***7890", "***7890"), ("123", "123"), ("", ""), ("", None)]


def test_full_name_domain_contact_id_payload(spark):
    df = spark.createDataFrame(
        [(" John ", "Doe", " A@B.com ", " +1234567890 "), (None, "", "x@y.org", "555"), (None, None, None, None)],
        "first_name string, last_name string, email string, phone_number string")
    rows = df.select(X.full_name(), X.email_domain(), X.contact_id(), X.delivery_payload()).collect()
    assert rows[0][0] == "John  Doe" and rows[0][1] == "B.com " and rows[0][2] == "a@b.com"
    assert rows[0][3] == '{"phoneNumber":"+1234567890"}'  # leading space: e-mail invalid, left out
    assert rows[1][0] == "x" and rows[1][1] == "y.org" and rows[1][3] == '{"email":"x@y.org"}'
    assert rows[2][0] is None and rows[2][1] is None and rows[2][2] is None and rows[2][3] == "{}"


def test_rate_pct_half_up_and_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (0, 0), (2, 3)], "a long, b long")
    assert [r[0] for r in df.select(X.rate_pct("a", "b")).collect()] == [13, 33, 0, 67]


def test_redact_columns(spark):
    df = spark.createDataFrame([("a@b.com", "+1234567890", "s3cret", "")], "email string, phone string, token string, key string")
    r = X.redact_columns(df).first()
    assert r["email"] == "a***@b.com" and r["phone"] == "***7890" and r["token"] == "[REDACTED]" and r["key"] == ""
