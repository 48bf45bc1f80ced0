"""Property tests: the skew paths are exact on adversarial random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rosterspark.operators import dedup, fuzzy

from conftest import brute_force_pairs

WORDS = st.lists(st.text(alphabet="ab@.c", min_size=1, max_size=9), min_size=2, max_size=40, unique=True)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(words=WORDS, t=st.sampled_from([0.5, 0.6, 0.75, 0.8, 0.9]))
def test_fuzzy_levels_equal_brute_force(spark, words, t):
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = fuzzy.similar_pairs(df, None, t, materialize_inputs=False, hot_rows=2, max_hot_keys=1000, salt=3)
    ref = brute_force_pairs(df, df, t)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((r.a, r.b) for r in ref.collect())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(keys=st.lists(st.sampled_from(["a@x", "b@x", "A@X ", "", "   ", "c@y"]), min_size=1, max_size=60))
def test_dedup_hot_path_equals_plain(spark, keys):
    rows = [(i + 1, k, "", "", "") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "line_number long, email string, first_name string, last_name string, "
                                     "phone_number string")
    cols = ["line_number", "dup_key", "dup_number", "is_duplicate", "original_line"]
    plain = sorted(tuple(r) for r in dedup.mark_duplicates(df).select(*cols).collect())
    split = sorted(tuple(r) for r in dedup.mark_duplicates(df, range_rows=3).select(*cols).collect())
    assert plain == split
    uniq, dups = dedup.split_duplicates(dedup.mark_duplicates(df))
    assert uniq.count() + dups.count() == len(keys)
