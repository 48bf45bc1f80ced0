"""CSV source and sink edge cases (files written by the tests themselves)."""

import os

import pytest
from pyspark.sql import functions as F

from rosterspark.sources import files as FS
from rosterspark.sources.contacts import normalize_columns


def _write(dirpath, name, text, encoding="utf-8"):
    os.makedirs(dirpath, exist_ok=True)
    p = os.path.join(dirpath, name)
    with open(p, "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return p


def test_quoting_blank_and_empty_rows(spark, tmpdir_path):
    text = (
        "email,first_name,last_name,phone_number\n"
        '"a,b@x.com",Ann,"O""Neil",+1234567890\n'
        "\n"
        ",,,\n"
        "   ,  , ,\n"
        'c@x.com,"",Lee\n'
        "d@x.com,Dee,Doe,+1234567890,extra\n"
    )
    d = os.path.join(tmpdir_path, "in")
    _write(d, "contacts.csv", text)
    contacts, quarantine, check = FS.read_contacts(spark, d)
    rows = {r.line_number: r for r in contacts.collect()}
    # the blank line is dropped by the reader, so line numbers count non-blank data lines
    assert sorted(rows) == [1, 4, 5]
    assert rows[1].email == "a,b@x.com" and rows[1].last_name == "O\"Neil"
    assert rows[4].first_name == "" and rows[4].phone_number is None  # quoted empty vs short row
    assert rows[5].phone_number == "+1234567890"  # long row: extra cell ignored
    assert sorted(r.line_number for r in quarantine.collect()) == [2, 3]
    assert check.is_valid and check.warnings == []


def test_multiline_field(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "ml")
    _write(d, "c.csv", 'email,first_name\n"x@y.com","line1\nline2"\nz@y.com,Zed\n')
    contacts, _q, _c = FS.read_contacts(spark, d, multiline=True)
    got = {r.line_number: r.first_name for r in contacts.collect()}
    assert got == {1: "line1\nline2", 2: "Zed"}


def test_headers_aliases_unknown_missing_bom(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "h")
    _write(d, "c.csv", "﻿EMAIL,Email,FirstName,mobile,notes\nA@B.com,b@c.com,Ann,+1234567890,hi\n")
    contacts, _q, check = FS.read_contacts(spark, d)
    r = contacts.first()
    assert r.email == "A@B.com"  # first alias in list order: EMAIL before Email
    assert r.first_name == "Ann" and r.phone_number is None  # 'mobile' only passes the header check (Q5)
    assert check.warnings == ["Unexpected header 'notes' will be ignored"]
    relaxed, _q2, _c2 = FS.read_contacts(spark, d, mode="relaxed")
    assert relaxed.first().phone_number == "+1234567890"
    d2 = os.path.join(tmpdir_path, "bad")
    _write(d2, "c.csv", "name,phone\nx,y\n")
    with pytest.raises(ValueError, match="Required header 'email' not found"):
        FS.read_contacts(spark, d2)


def test_upper_case_and_two_aliases_positional(spark):
    df = spark.createDataFrame([("a@x.com", "B@X.COM", "p")], ["email", "EMAIL", "phone"])
    out = normalize_columns(df, keep=()).first()
    assert out.email == "a@x.com" and out.phone_number == "p"


def test_max_rows_counts_empty_rows(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "mr")
    _write(d, "c.csv", "email\na@x.com\n,\nb@x.com\nc@x.com\n")
    contacts, quarantine, _c = FS.read_contacts(spark, d, max_rows=3)
    assert [r.line_number for r in contacts.orderBy("line_number").collect()] == [1, 3]
    assert quarantine.count() == 1
    s = FS.read_stats(contacts, quarantine).first()
    assert (s.total_rows, s.valid_rows, s.invalid_rows) == (3, 2, 1)


def test_line_numbers_across_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "multi")
    _write(d, "part-b.csv", "email\n" + "".join(f"b{i}@x.com\n" for i in range(5)))
    _write(d, "part-a.csv", "email\n" + "".join(f"a{i}@x.com\n" for i in range(300)))
    contacts, _q, _c = FS.read_contacts(spark, d)
    got = [r.email for r in contacts.orderBy("line_number").collect()]
    assert got == [f"a{i}@x.com" for i in range(300)] + [f"b{i}@x.com" for i in range(5)]
    nums = sorted(r.line_number for r in contacts.collect())
    assert nums == list(range(1, 306))


def test_write_roundtrip_and_refuse_empty(spark, tmpdir_path):
    df = spark.createDataFrame([("a@x.com", "", None, ' q"uote, '), ("b@x.com", "0", "false", "x")],
                               "email string, first_name string, last_name string, phone_number string")
    out = os.path.join(tmpdir_path, "w")
    FS.write_contacts(df, out)
    back, _q, _c = FS.read_contacts(spark, out)
    rows = sorted(tuple(r)[1:] for r in back.collect())
    assert rows == [("a@x.com", "", None, ' q"uote, '), ("b@x.com", "0", "false", "x")]
    assert FS.count_rows(spark, out) == 2
    with pytest.raises(ValueError):
        FS.write_contacts(df.limit(0), os.path.join(tmpdir_path, "w2"))
    prof = FS.profile_inputs(spark, out + "/*.csv").collect()
    assert prof and all(p.size > 0 and p.size_formatted.endswith("B") for p in prof)


def test_export_validation_report_csv(spark, tmpdir_path):
    from rosterspark.operators import rules

    df = spark.createDataFrame([(1, "bad", "", "", ""), (2, "a@b.con", "", "", "")],
                               "line_number long, email string, first_name string, last_name string, phone_number string")
    out = os.path.join(tmpdir_path, "rep")
    FS.export_validation_report(rules.validate(df), out, "csv")
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[0] == "Type,Row,Field,Value,Message"
    assert lines[1] == 'Error,1,email,"bad","Invalid email format"'
    assert lines[-1].startswith("Warning,")


def test_read_sessions_skips_corrupt(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "sessions")
    os.makedirs(d)
    FS.write_session_file(os.path.join(d, "s1.json"), {
        "id": "s1", "status": "paused", "csvFile": "a.csv", "startTime": "2024-01-01T00:00:00Z",
        "summary": {"total": 10, "processed": 4, "successful": 3, "failed": 1}})
    with open(os.path.join(d, "broken.json"), "w") as fh:
        fh.write("{not json")
    good, bad = FS.read_sessions(spark, d)
    assert [r.session_id for r in good.collect()] == ["s1"] and bad.count() == 1


def test_checkpoint_append_read_delete(spark, tmpdir_path):
    import datetime as dt

    p = os.path.join(tmpdir_path, "ck")
    for i in range(3):
        row = spark.createDataFrame([("s1", i, dt.datetime(2024, 1, 1, 0, i), "processing", 10, i * 3)],
                                    "session_id string, checkpoint_id long, ts timestamp, status string, total long, processed long")
        FS.append_checkpoint(row, p)
    assert FS.read_checkpoints(spark, p, "s1").count() == 3
    doomed = spark.createDataFrame([("s1", 0)], "session_id string, checkpoint_id long")
    left = FS.delete_checkpoints(spark, p, doomed, p + "_v2")
    assert sorted(r.checkpoint_id for r in left.collect()) == [1, 2]


def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmpdir_path):
    """A file with line breaks, quotes and commas in cells is cut into many splits; rows and numbers stay."""
    rows = [(f"u{i}@x.com", f'N{i}\n"q", {i}\n\n' if i % 3 else "plain", "" if i % 5 else f'"{i}"', "+1" + "2" * (i % 9)) for i in range(4000)]

    def cell(x):
        return '"' + x.replace('"', '""') + '"' if set(x) & set('",\n') else x

    d = os.path.join(tmpdir_path, "big")
    _write(d, "a.csv", "email,first_name,last_name,phone_number\r\n" + "".join(",".join(map(cell, r)) + "\r\n" for r in rows))
    _write(d, "b.csv", "phone,EMAIL\n1,z@x.com\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert spark.read.text(d).rdd.getNumPartitions() > 20
        contacts, quarantine, _check = FS.read_contacts(spark, d)
        got = sorted(tuple(r) for r in contacts.collect())
        assert FS.count_rows(spark, d) == 4001 and quarantine.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(k + 1, *(x or None for x in r)) for k, r in enumerate(rows)] + [(4001, "z@x.com", None, None, "1")]


def test_states_of_lines(spark, tmpdir_path):
    """Quotes inside a plain cell open nothing; a quoted cell may end and another begin on one line."""
    text = 'email,first_name,last_name\na@x.com,5" nail,x\nb@x.com,"one\n,""two"",\n3","four\n5"\n\nc@x.com,"",""""\n'
    d = os.path.join(tmpdir_path, "q")
    _write(d, "c.csv", text)
    got = [tuple(r) for r in FS.read_contacts(spark, d)[0].orderBy("line_number").select("email", "first_name", "last_name").collect()]
    assert got == [("a@x.com", '5" nail', "x"), ("b@x.com", 'one\n,"two",\n3', "four\n5"), ("c@x.com", "", '"')]
    assert FS.read_header(spark, d) == ["email", "first_name", "last_name"]


def test_latin1_and_header_of_each_file(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "l1")
    _write(d, "a.csv", "email,first_name\nä@x.com,Zoë\n", "latin-1")
    assert FS.read_contacts(spark, d, encoding="latin1")[0].first().first_name == "Zoë"
    _write(d, "b.csv", "ort,y\nx,z\n", "latin-1")
    got = FS.header_checks(spark, d, ("email",), "latin1").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.kind) for r in got) == [("b.csv", "error"), ("b.csv", "warning"), ("b.csv", "warning")]
    with pytest.raises(ValueError, match="b.csv"):
        FS.read_contacts(spark, d, encoding="latin1")
