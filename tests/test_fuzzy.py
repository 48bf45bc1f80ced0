"""Exact near-duplicate join against a brute-force cross join on small inputs."""

import pytest
from pyspark.sql import functions as F

from rosterspark.operators import dedup, fuzzy, rules
from rosterspark.sources import fixtures

from conftest import SF001, SF01, brute_force_pairs


@pytest.fixture(scope="module")
def emails(spark):
    v = rules.validate(fixtures.contacts(spark, SF01)).filter("is_valid")
    u = dedup.unique_contacts(v.select("line_number", "email"), "email")
    return u.select(F.lower("email").alias("s")).cache()


@pytest.mark.parametrize("t", [0.7, 0.8, 0.9])
def test_segment_join_equals_brute_force(spark, emails, t):
    got = fuzzy.similar_pairs(emails, None, t).select("a", "b", F.round("similarity", 9).alias("x"))
    ref = brute_force_pairs(emails, emails, t).select("a", "b", F.round("similarity", 9).alias("x"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in ref.collect())


def test_two_sided_equals_self_join(spark, emails):
    other = emails.select("s")  # a different frame object: the two-sided path
    a = fuzzy.similar_pairs(emails, None, 0.8)
    b = fuzzy.similar_pairs(emails, other, 0.8)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_salted_hot_keys_same_result(spark, emails):
    a = fuzzy.similar_pairs(emails, emails, 0.8)
    b = fuzzy.similar_pairs(emails, emails, 0.8, hot_rows=1, max_hot_keys=100000, salt=5)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_short_strings_and_low_threshold(spark):
    words = ["ab", "abc", "abd", "b", "ba", "xyz", "xy", "a", "abcd", "bcda", "aaaa", "aaab"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for t in (0.3, 0.5, 0.6):
        got = fuzzy.similar_pairs(df, df, t)
        ref = brute_force_pairs(df, df, t)
        assert sorted((r.a, r.b) for r in got.collect()) == sorted((r.a, r.b) for r in ref.collect()), t


def test_counts_from_the_blueprint(spark, emails):
    assert fuzzy.similar_pairs(emails, emails, 0.9).count() == 232
    assert fuzzy.similar_pairs(emails, emails, 0.8).count() == 248


def test_find_potential_duplicates_ranked(spark):
    df = spark.createDataFrame([(1, "john@example.com"), (2, "jon@example.com"), (3, "john@exampel.com"),
                                (4, "zzz@other.org")], "line_number long, email string")
    r = fuzzy.find_potential_duplicates(df, df, 0.8).filter("probe_id = 1").orderBy("rank").collect()
    assert [x.match_id for x in r] == [2, 3] and r[0].reason == "email_similarity"
    plan = fuzzy.similar_pairs(df.select(F.col("email").alias("s")), df.select(F.col("email").alias("s")), 0.8)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_local_part_keys_and_domain_pairs_equal_brute_force(spark):
    """Large domains by subsequences and by segments, hot keys by domain pair, strings without @ and beyond ASCII."""
    import random

    rnd = random.Random(3)
    rows = set()
    for domain in ("@mail.example.com", "@gmail.com", "@hmail.com", "@x@gmail.com", ""):
        for base in ("abcdefgh", "müllerstraße17x", "aabbaabb", "jo"):
            for _ in range(14):
                w = list(base)
                for _ in range(rnd.randrange(4)):
                    w[rnd.randrange(len(w))] = rnd.choice(["", "z", "b", "ü", "a7"])
                rows.add("".join(w) + domain)
    df = spark.createDataFrame([(w,) for w in sorted(rows)], "s string")
    for t, most in ((0.8, 1024), (0.8, 1), (0.6, 100)):
        ref = sorted((r.a, r.b) for r in brute_force_pairs(df, df, t).collect())
        c = fuzzy._candidates(df, df, t, False, 2, 1000, 3, most_keys=most)
        got = {(r.a, r.b) for r in c.collect()}
        assert got == {(a, b) for a, b in ref if len(a) <= len(b)}, (t, most)


def test_random_locals_of_one_domain_make_few_candidates(spark):
    """Rows per string stay bounded where every string shares its domain (each level of re-segmenting multiplied them)."""
    df = spark.range(3000).select(F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 10), F.lit("@mail.example.com")).alias("s"))
    big = df.select("s", fuzzy._domain("s").alias("u"))
    keys = big.select("s", fuzzy._local("s", "u"), F.length("u"), F.xxhash64("u")).mapInArrow(
        lambda b: fuzzy._local_keys(0.8, False, True, fuzzy.MOST_KEYS, b), "k long, s string")
    assert keys.count() <= 252 * 3000
    assert fuzzy.similar_pairs(df, None, 0.8).count() > 0


def _odd_strings():
    import random

    rnd = random.Random(5)
    rows = set()
    for domain in ("@gmail.com", "@gmail.con", "@mail.com", "@g@mail.com", "@x.co", ""):
        for base in ("abcdefgh", "müller17", "abc@g", "abcq", "aabbaabb", "jo"):
            for _ in range(7):
                w = list(base)
                for _ in range(rnd.randrange(4)):
                    w[rnd.randrange(len(w))] = rnd.choice(["", "z", "b", "ü", "@"])
                rows.add("".join(w) + domain)
    return sorted(rows - {""})


@pytest.mark.parametrize("t, most, largest, few", [(0.8, 1024, 256, 0), (0.8, 1, 256, 0), (0.8, 1024, 3, 16), (0.6, 1024, 256, 0), (0.6, 40, 2, 0)])
def test_cells_of_domains_equal_brute_force(spark, monkeypatch, t, most, largest, few):
    """Near domains, an @ in local parts, places, subsequences, segments and one key a cell; domains beyond the largest."""
    monkeypatch.setattr(fuzzy, "FEW", few)
    df = spark.createDataFrame([(w,) for w in _odd_strings()], "s string").cache()
    ref = sorted((r.a, r.b) for r in brute_force_pairs(df, df, t).collect())
    same = fuzzy._candidates(df, df, t, False, 2, 1000, 3, most_keys=most, largest=largest)
    got = sorted((r.a, r.b) for r in same.collect())
    assert got == [(a, b) for a, b in ref if len(a) <= len(b)]
    two = fuzzy._candidates(df, df.select("s"), t, True, 2, 1000, 3, most_keys=most, largest=largest)
    assert sorted((r.a, r.b) for r in two.collect()) == [(a, b) for a, b in ref if len(a) < len(b)]


def _key_rows(local, other, edits, side, buckets=3):
    import pyarrow as pa

    n = len(local)
    cols = [pa.array(range(n), pa.int64()), pa.array(local), pa.array([other] * n, pa.int32()), pa.array([edits] * n, pa.int32()),
            pa.array([77] * n, pa.int64()), pa.array([side] * n, pa.int8())]
    return list(fuzzy._cell_keys(fuzzy.MOST_KEYS, buckets, [pa.record_batch(cols, names=list("abcdef"))]))


def test_near_domains_make_few_candidates():
    """Strings of two near domains, and of one domain, are paired by their local parts (the former were all paired)."""
    import hashlib

    import pyarrow as pa

    local = [hashlib.md5(str(i).encode()).hexdigest()[:10] for i in range(4000)]
    for edits, side, keys, most in ((3, (1, 2), 165, 3000), (5, (3,), 462, 60000)):
        blocks = pa.Table.from_batches([b for x in side for b in _key_rows(local, 10, edits, x)]).sort_by("bucket").combine_chunks()
        rows = sum(len(x.as_py()) for x in blocks["k"]) // 8
        assert rows <= keys * len(side) * 4000
        pairs = {(min(i, j), max(i, j)) for b in fuzzy._pair_up(blocks.to_batches(max_chunksize=2))
                 for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i != j}
        assert 0 < len(pairs) <= most, len(pairs)


def test_rows_of_a_common_key_are_all_paired(monkeypatch):
    """A key of more rows than pairs are made at a time for, beside small ones."""
    import numpy as np

    monkeypatch.setattr(fuzzy, "PAIRS", 50)
    k = np.repeat([1, 2, 5, 9, 11], [3, 1, 40, 3, 9])
    got = [(int(a), int(b)) for x, y in fuzzy._runs(k) for a, b in zip(x, y)]
    assert sorted(got) == [(a, b) for a in range(len(k)) for b in range(a + 1, len(k)) if k[a] == k[b]]


def test_local_parts_of_two_domains_differ_by_the_rest(spark):
    """0.9, yahoo.co against yahoo.com: one edit is left for the local parts, and the bound holds for odd cuts."""
    import random

    rnd = random.Random(9)
    domains = ["@yahoo.co", "@yahoo.com", "@mail.com", "@gmail.com", "@g@mail.com", "@a.b", ""]
    rows = [(x, u, y, v) for _ in range(60) for u in domains for v in domains
            for x, y in [tuple("".join(rnd.choice("ab@gm") for _ in range(rnd.randrange(6))) for _ in range(2))]]
    df = spark.createDataFrame(rows, "x string, u string, y string, v string").withColumn("n", F.length("x")).withColumn("p", F.length("y"))
    df = df.withColumn("whole", F.levenshtein(F.concat("x", "u"), F.concat("y", "v")))
    df = df.withColumn("gap", fuzzy._domain_gap("u", "v", "n", "p", F.col("whole")))
    assert df.filter(F.col("gap").isNull() | (F.levenshtein("x", "y") > F.col("whole") - F.col("gap"))).count() == 0
    one = spark.createDataFrame([("@yahoo.co", "@yahoo.com", 10, 10), ("@yahoo.com", "@yahoo.com", 10, 10),
                                 ("@yahoo.com", "@mail.example.com", 10, 10)], "u string, v string, n int, p int")
    assert [r.gap for r in one.select("u", fuzzy._domain_gap("u", "v", "n", "p", F.lit(2)).alias("gap")).collect()] == [1, 0, None]
