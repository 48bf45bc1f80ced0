"""Exact deduplication.

``mark_duplicates`` numbers the holders of each key in input order with the
scans of ``ordered``: a key with very many holders is cut into ranges of the
order column that are numbered locally and moved on by the counts before, so no
key, however large, is sorted by a single task.  Rows with a blank key never
enter the shuffle.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import is_missing, js_trim, rate_pct
from .ordered import RANGE_ROWS, running


def _lower_trim(c: str) -> Column:
    col = F.col(c)
    return F.when(is_missing(col), F.lit("")).otherwise(js_trim(F.lower(col)))


def _trim(c: str) -> Column:
    col = F.col(c)
    return F.when(is_missing(col), F.lit("")).otherwise(js_trim(col))


def dup_key(strategy: str | Callable[[], Column] = "email") -> Column:
    """D1-D3 key expressions; a callable is a custom key (F2)."""
    if callable(strategy):
        return strategy()
    if strategy == "email":
        return _lower_trim("email")
    if strategy == "email_phone":
        return F.concat(_lower_trim("email"), F.lit("|"), _trim("phone_number"))
    if strategy == "strict":
        return F.concat_ws(
            "|", _lower_trim("email"), _trim("phone_number"), _lower_trim("first_name"), _lower_trim("last_name")
        )
    raise ValueError(f"unknown dedup strategy {strategy!r}")


def strategy_name(strategy) -> str:
    if callable(strategy):
        return getattr(strategy, "__name__", "CustomDeduplicationStrategy")
    return K.STRATEGY_NAMES[strategy]


def _blank(key: Column) -> Column:
    return key.isNull() | (js_trim(key) == F.lit(""))


def with_dup_key(df: DataFrame, strategy="email") -> DataFrame:
    return df.withColumn("dup_key", dup_key(strategy))


def key_counts(keyed: DataFrame, order_col: str = "line_number") -> DataFrame:
    """Per non-blank key: row count and first position.  Partial aggregation, skew-proof."""
    return (
        keyed.filter(~_blank(F.col("dup_key")))
        .groupBy("dup_key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first_line"))
    )


def mark_duplicates(df: DataFrame, strategy="email", order_col: str = "line_number", range_rows: int = RANGE_ROWS,
                    carry: tuple = ()) -> DataFrame:
    """Add ``dup_key, dup_number, is_duplicate, original_line``.

    ``dup_number`` is the 1-based ordinal of the row among the holders of its
    key in ``order_col`` order (first duplicate = 2); ``original_line`` is the
    first holder's position, set on duplicates only.  Blank keys are never
    duplicates (``dup_number`` NULL).  ``order_col`` must be unique per row.
    Keys with many holders are numbered in ranges of about ``range_rows`` rows.
    With ``carry`` a duplicate also gets ``original``, a struct of these columns
    of the first holder (J2): the least (order, columns) so far, no join.
    """
    keyed = with_dup_key(df, strategy)
    blank = _blank(F.col("dup_key"))
    first = F.struct(F.col(order_col).alias("_line"), *[F.col(c) for c in carry])
    kind = keyed.select(first.alias("f")).schema["f"].dataType
    blanks = keyed.filter(blank).withColumns({"dup_number": F.lit(None).cast("bigint"), "_first": F.lit(None).cast(kind)})
    numbered = running(keyed.filter(~blank), "dup_key", [order_col], sums={"dup_number": F.lit(1).cast("bigint")},
                       mins={"_first": first}, range_rows=range_rows)
    again = F.coalesce(F.col("dup_number") > 1, F.lit(False))
    added = {"is_duplicate": again, "original_line": F.when(again, F.col("_first._line")).cast("bigint")}
    if carry:
        added["original"] = F.when(again, F.struct(*[F.col(f"_first.{c}").alias(c) for c in carry]))
    return numbered.unionByName(blanks).withColumns(added).drop("_first")


def split_duplicates(marked: DataFrame):
    """``(unique, duplicates)``; blank-key rows are in ``unique``."""
    return marked.filter(~F.col("is_duplicate")), marked.filter(F.col("is_duplicate"))


def unique_contacts(df: DataFrame, strategy="email", order_col: str = "line_number") -> DataFrame:
    """First holder of each non-blank key; a partial ``min_by`` aggregate (no window)."""
    keyed = with_dup_key(df, strategy).filter(~_blank(F.col("dup_key")))
    cols = [c for c in df.columns]
    first = keyed.groupBy("dup_key").agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r")
    )
    return first.select("dup_key", *[F.col(f"_r.{c}").alias(c) for c in cols])


def duplicate_contacts(marked: DataFrame) -> DataFrame:
    """Every non-first holder."""
    return marked.filter(F.col("dup_number") > 1)


def duplicate_groups(df: DataFrame, strategy="email", order_col: str = "line_number") -> DataFrame:
    """One row per key with at least one duplicate: original, total count.

    Members are not collected into an array (a hot key would make one huge
    row); list them with ``duplicate_contacts`` filtered by key instead.
    """
    keyed = with_dup_key(df, strategy)
    return (
        key_counts(keyed, order_col)
        .filter(F.col("n") > 1)
        .select(
            "dup_key",
            F.lit(strategy_name(strategy)).alias("strategy"),
            F.col("first_line").cast("bigint").alias("original_line"),
            F.col("n").cast("bigint").alias("total_count"),
            (F.col("n") - 1).cast("bigint").alias("duplicate_count"),
        )
    )


def duplicate_group(df: DataFrame, key: str, strategy="email", order_col="line_number") -> DataFrame:
    """The group of one key (filter first, so only that key is read past the scan)."""
    keyed = with_dup_key(df, strategy).filter(F.col("dup_key") == F.lit(key))
    return duplicate_groups(keyed.drop("dup_key"), strategy, order_col)


KEY_BUCKETS = 64


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_key_index(marked: DataFrame, path: str, buckets: int = KEY_BUCKETS) -> None:
    """Marked rows as a table for lookups by key: a folder per hash of the key, rows sorted by key and position.

    Rows are dealt by ranges of (bucket, key, position), so a key with a third
    of all rows fills many files of its bucket.  A lookup reads one bucket, and
    of its files the row groups whose key range and bloom filter admit the key.
    """
    keyed = marked.filter(F.col("dup_number").isNotNull()).withColumn("bucket", _bucket(F.col("dup_key"), buckets))
    order = ["bucket", "dup_key", "dup_number"]
    (keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#dup_key", "true").partitionBy("bucket").parquet(path))


def lookup_key(index: DataFrame, key: str, buckets: int = KEY_BUCKETS) -> DataFrame:
    """The holders of one key from a table of ``write_key_index``; one bucket is read."""
    return index.filter((F.col("bucket") == _bucket(F.lit(key), buckets)) & (F.col("dup_key") == F.lit(key))).drop("bucket")


def has_duplicates(df: DataFrame, key: str, strategy="email") -> bool:
    return not duplicate_group(df, key, strategy).isEmpty()


def dedup_stats(df: DataFrame, strategy="email") -> DataFrame:
    """Total, unique, duplicates, groups, rates, strategy (one row)."""
    keyed = with_dup_key(df, strategy).withColumn(
        "dup_key", F.when(~_blank(F.col("dup_key")), F.col("dup_key"))
    )
    per_key = keyed.groupBy("dup_key").agg(F.count(F.lit(1)).alias("n"))
    agg = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("dup_key").isNotNull(), F.col("n") - 1).otherwise(0)), F.lit(0))
        .cast("bigint")
        .alias("duplicate_records"),
        F.count_if(F.col("dup_key").isNotNull() & (F.col("n") > 1)).cast("bigint").alias("duplicate_groups"),
    )
    return agg.select(
        F.lit(strategy_name(strategy)).alias("strategy"),
        "total_records",
        (F.col("total_records") - F.col("duplicate_records")).alias("unique_records"),
        "duplicate_records",
        "duplicate_groups",
        rate_pct("duplicate_records", "total_records").alias("duplicate_rate"),
        rate_pct(F.col("total_records") - F.col("duplicate_records"), F.col("total_records")).alias("unique_rate"),
    )


def dedup_report(marked: DataFrame, strategy="email"):
    """Summary plus masked groups (original masked e-mail and names)."""
    from ..functions.expr import mask_email

    stats = dedup_stats(marked.drop("dup_key", "dup_number", "is_duplicate", "original_line"), strategy)
    first = F.struct(F.col("line_number").alias("original_line"), mask_email("email").alias("original_email"),
                     "first_name", "last_name")
    groups = (
        marked.filter(F.col("dup_number").isNotNull())
        .groupBy("dup_key")
        .agg(F.count(F.lit(1)).alias("total_count"), F.max(F.when(F.col("dup_number") == 1, first)).alias("_first"))
        .filter((F.col("total_count") > 1) & F.col("_first").isNotNull())
        .select("dup_key", "total_count", "_first.*")
    )
    return stats, groups


def mark_across_runs(df: DataFrame, seen_keys: DataFrame, strategy="email", order_col: str = "line_number") -> DataFrame:
    """``mark_duplicates`` on top of earlier runs (``seen_keys`` from ``remember_keys``).

    The first holder of a key that m rows had before is number m + 1, and
    ``original_line`` points at the earliest run's first holder.
    """
    seen = seen_keys.groupBy("dup_key").agg(F.sum("n").alias("_n"), F.min_by("line_number", "run").alias("_line"))
    marked = mark_duplicates(df, strategy, order_col).join(seen, "dup_key", "left")
    known = F.col("_n").isNotNull() & ~_blank(F.col("dup_key"))
    return (marked.withColumn("dup_number", F.when(known, F.col("dup_number") + F.col("_n")).otherwise(F.col("dup_number")))
            .withColumn("is_duplicate", F.col("is_duplicate") | known)
            .withColumn("original_line", F.when(known, F.col("_line")).otherwise(F.col("original_line")))
            .drop("_n", "_line"))


def remember_keys(marked: DataFrame, path: str, mode: str = "append", run: int = 0, order_col: str = "line_number") -> None:
    """Persist each key's first line and number of rows, so that a later run can continue."""
    first = marked.filter(~_blank(F.col("dup_key"))).groupBy("dup_key").agg(F.min(order_col).alias("line_number"), F.count(F.lit(1)).alias("n"))
    first.withColumn("run", F.lit(run)).write.mode(mode).parquet(path)
