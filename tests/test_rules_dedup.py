"""Rules, dedup and the skew-split paths (property tests against plain formulations)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterspark.plans.catalog import QUERIES
from rosterspark.operators import dedup, ordered, rules
from rosterspark.sources import fixtures

from conftest import SF01


@pytest.fixture(scope="module")
def validated(spark):
    return rules.validate(fixtures.contacts(spark, SF01)).cache()


def test_fixture_numbers(validated):
    assert validated.count() == 1500
    assert validated.filter("is_valid").count() == 917
    v = validated.filter("is_valid")
    assert v.select(dedup.dup_key("email")).distinct().count() == 685
    assert v.select(dedup.dup_key("email_phone")).distinct().count() == 801


def test_missing_email_gives_two_errors(spark):
    df = spark.createDataFrame([(1, None, "A", "B", "+1234567890")],
                               "line_number long, email string, first_name string, last_name string, phone_number string")
    codes = [r.code for r in rules.explode_findings(rules.validate(df)).collect()]
    assert codes == ["MISSING_EMAIL", "MISSING_REQUIRED_FIELD"]


def test_strict_and_subset(spark):
    df = spark.createDataFrame([(1, "a@b.con", "", "", "")],
                               "line_number long, email string, first_name string, last_name string, phone_number string")
    assert rules.validate(df).first().is_valid is True
    assert rules.validate(df, strict=True).first().is_valid is False
    only_email = rules.validate(df, rules=["email"]).first()
    assert [f.code for f in only_email.findings] == ["POSSIBLE_TYPO"]


def test_registry_and_custom_rules(spark):
    reg = rules.RuleRegistry()
    reg.add(rules.column_rule("NO_TEST", "error", "email", "TEST_DOMAIN", F.col("email").endswith("@test.com"),
                              "test domains are not allowed", F.col("email")))

    def crash(rec):
        if rec["first_name"] == "boom":
            raise RuntimeError("bad row")
        return "short name" if rec["first_name"] and len(rec["first_name"]) < 2 else None

    reg.add(rules.python_rule("PY_NAME", crash, ["first_name"], severity="warning", fld="firstName", code="SHORT"))
    with pytest.raises(TypeError):
        reg.add("not a rule")
    df = spark.createDataFrame(
        [(1, "x@test.com", "A", "B", ""), (2, "y@ok.com", "boom", "B", ""), (3, "z@ok.com", "Zed", "B", "")],
        "line_number long, email string, first_name string, last_name string, phone_number string")
    got = {r.line_number: (r.is_valid, [f.code for f in r.findings])
           for r in rules.validate(df, registry=reg).collect()}
    assert got[1][0] is False and "TEST_DOMAIN" in got[1][1] and "SHORT" in got[1][1]
    assert got[2][0] is False and "STRATEGY_ERROR" in got[2][1]
    assert got[3][0] is True
    reg.remove("PY_NAME")
    assert "PY_NAME" not in reg.names()


def test_non_string_email_is_type_error(spark):
    df = spark.createDataFrame([(1, 12, "A", "B", "")],
                               "line_number long, email long, first_name string, last_name string, phone_number string")
    codes = [f.code for f in rules.validate(df).first().findings]
    assert codes[0] == "INVALID_EMAIL_TYPE"


def test_validate_plan_has_no_python(validated):
    plan = validated._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("strategy", ["email", "email_phone", "strict"])
def test_hot_key_path_equals_plain_window(validated, strategy):
    v = validated.filter("is_valid").select("line_number", "email", "first_name", "last_name", "phone_number")
    w = Window.partitionBy("dup_key").orderBy("line_number")
    n = F.when(~dedup._blank(F.col("dup_key")), F.row_number().over(w))
    plain = dedup.with_dup_key(v, strategy).select("line_number", "dup_key", n.alias("n"), F.coalesce(n > 1, F.lit(False)),
                                                   F.when(n > 1, F.first("line_number").over(w)))
    split = dedup.mark_duplicates(v, strategy, range_rows=2)  # nearly every key is cut
    cols = ["line_number", "dup_key", "dup_number", "is_duplicate", "original_line"]
    a = sorted(tuple(r) for r in plain.collect())
    b = sorted(tuple(r) for r in split.select(*cols).collect())
    assert a == b


def test_one_key_with_a_third_of_rows(spark):
    rows = [(i, "hot@x.com" if i % 3 == 0 else f"u{i}@x.com", "", "", "") for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "line_number long, email string, first_name string, last_name string, phone_number string")
    m = dedup.mark_duplicates(df, "email", range_rows=64)
    hot = m.filter(F.col("dup_key") == "hot@x.com").orderBy("line_number").select("dup_number", "original_line").collect()
    assert [r.dup_number for r in hot] == list(range(1, 1001))
    assert {r.original_line for r in hot[1:]} == {3}
    stats = dedup.dedup_stats(df).first()
    assert stats.duplicate_records == 999 and stats.duplicate_groups == 1 and stats.total_records == 3000


def test_unique_plus_duplicates_is_total(validated):
    m = dedup.mark_duplicates(validated, "email")
    uniq, dups = dedup.split_duplicates(m)
    assert uniq.count() + dups.count() == validated.count()
    assert dedup.unique_contacts(validated, "email").count() == m.filter(F.col("dup_number") == 1).count()


def check_scans(ev, order, chunk, **kw):
    """Running counts, last values and neighbours against plain windows."""
    rp, phase = (F.col("type") == "record_processed").cast("long"), F.when(F.col("type") == "phase_change", F.col("phase"))
    got = ordered.running(ev, "session_id", order, chunk, sums={"n": rp}, lasts={"ph": phase}, mins={"m": F.col("seq") % 1000}, **kw)
    w = Window.partitionBy("session_id").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = ev.select("seq", F.sum(rp).over(upto).alias("n"), F.last(phase, True).over(upto).alias("ph"), F.min(F.col("seq") % 1000).over(upto))
    assert sorted(map(str, got.select("seq", "n", "ph", "m").collect())) == sorted(map(str, ref.toDF("seq", "n", "ph", "m").collect()))
    nb = ordered.neighbors(ev, "session_id", order, chunk, ["seq", "phase"], **kw)
    ref = ev.select("seq", F.lag("seq").over(w), F.lead("seq").over(w), F.lag("phase").over(w)).toDF("seq", "prev_seq", "next_seq", "prev_phase")
    assert sorted(map(str, nb.select(*ref.columns).collect())) == sorted(map(str, ref.collect()))


@pytest.mark.parametrize("kw", [{"chunk": "minute"}, {"chunk": None}, {"chunk": None, "range_rows": 20},
                                {"chunk": None, "range_rows": 1}, {"chunk": None, "range_rows": 3, "max_keys": 4}])
def test_cut_scans_equal_plain_windows(spark, kw):
    kw = dict(kw)
    chunk = kw.pop("chunk") if "chunk" in kw else None
    check_scans(fixtures.progress_events(spark, SF01), ["ts", "seq"], ordered.time_chunk("ts", chunk) if chunk else None, **kw)


def test_a_burst_a_null_key_and_one_key_are_cut(spark):
    """One key has most rows, half of them at one time; another key is null."""
    ev = spark.range(6000).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 < 9, F.lit(1)).otherwise(F.col("id")).cast("long").alias("session_id"),
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "phase_change").otherwise("record_processed").alias("type"), F.col("id").cast("string").alias("phase"))
    check_scans(ev, ["ts", "seq"], None, range_rows=50)
    edges = ordered.range_edges(ev, "session_id", ["ts", "seq"], 50).collect()
    ranges = ordered._ranged(ev, "session_id", ["ts", "seq"], ordered.range_edges(ev, "session_id", ["ts", "seq"], 50), "inner")
    sizes = {tuple(r[:2]): r["count"] for r in ranges.groupBy("session_id", "_chunk").count().collect()}
    assert {1, None} <= {r["_key"] for r in edges} and max(sizes.values()) < 600
    most = ordered.range_edges(ev, "session_id", ["ts", "seq"], 1).filter("_key = 1").first()
    assert len(most["_edges"]) == ordered.MAX_RANGES - 1 and len(most["_blocks"]) == ordered.BLOCK - 1
    check_scans(ev, ["ts", "seq"], None, range_rows=1)


def test_building_ordered_queries_starts_no_job(spark):
    names = ["dup_email", "dup_email_phone", "dup_strict", "progress_timeline", "batch_time_mean", "batch_time_ema", "phase_intervals",
             "attempt_triage", "retry_plan", "tracker_timeline"]
    for n in names:
        QUERIES[n](spark, SF01)  # derived fixture tables are written once per session
    spark.sparkContext.setJobGroup("build-only", "plans of ordered queries")
    try:
        frames = [QUERIES[n](spark, SF01) for n in names]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("build-only")) == [] and len(frames) == len(names)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
