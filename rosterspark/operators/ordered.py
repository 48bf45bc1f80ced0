"""Ordered per-key scans that stay parallel when one key is huge, in one lazy plan.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task; a session holding a third of all events would then be scanned by a
single core.  The helpers here cut large keys into *ranges* of the ordering.
Each range is scanned locally with a window over ``(key, range)``; a small
table with one row per range carries totals, the last non-null values and the
boundary rows over to later ranges.  Results equal the single-window scan.

Where to cut is part of the plan, so building it starts no job.  A row is a
sample if a hash of its key and order columns says so (one of ``range_rows``);
the samples of a key, sorted, are quantiles of its ordering and serve as the
edges between ranges.  Being chosen by value, they are the same whenever the
plan or a lost part of it runs again, and they lie densely where rows do: a
burst is cut as finely as a quiet time, and equal times by the order columns
after them.  Keys without a sample stay whole.

What is broadcast is bounded by construction: edges of the ``MAX_KEYS`` keys
with the most samples, ``MAX_RANGES - 1`` each, and one row for each of their
ranges.  Any other key has less than one ``MAX_KEYS``-th of the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 18  # one row of so many is a sample: target rows per range of a large key
MAX_KEYS = 1024  # keys that are cut
BLOCK = 16  # a row's range is looked up among blocks of edges, then inside one
MAX_RANGES = BLOCK * BLOCK


def time_chunk(ts: str, unit: str = "hour") -> Column:
    """A chunk id that grows with ``ts`` (time zone independent for TIMESTAMP_NTZ)."""
    return F.date_trunc(unit, F.col(ts))


def _place(order: list[str]) -> Column:
    return F.struct(*[F.col(o) for o in order])


def range_edges(df: DataFrame, key: str, order: list[str], range_rows: int, max_keys: int = MAX_KEYS) -> DataFrame:
    """``(_key, _edges, _blocks)``: sorted edges of the keys that are cut, and the last edge of each block of them."""
    samples = df.select(F.col(key).alias("_key"), _place(order).alias("_at")).filter(
        F.pmod(F.xxhash64("_key", "_at"), F.lit(range_rows)) == 0)
    most = MAX_RANGES - 1
    n = F.size("_all")
    thinned = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))),
                          lambda i: F.element_at("_all", F.when(n <= most, i).otherwise(F.floor(i * n / (most + 1)).cast("int"))))
    cut = samples.groupBy("_key").agg(F.sort_array(F.collect_list("_at")).alias("_all")).withColumn("_n", n).withColumn("_edges", thinned)
    cut = cut.withColumn("_blocks", F.filter("_edges", lambda _, i: i % BLOCK == BLOCK - 1))
    return cut.orderBy(F.desc("_n"), "_key").limit(max_keys).select("_key", "_edges", "_blocks")


def _ranged(df: DataFrame, key: str, order: list[str], edges: DataFrame, how: str) -> DataFrame:
    """Rows with ``_chunk`` (edges up to the row; 0 for keys that stay whole) and ``_cut``."""
    place = _place(order)
    out = df.join(F.broadcast(edges), F.col(key).eqNullSafe(F.col("_key")), how)
    before = F.size(F.filter("_blocks", lambda e: e <= place)) * BLOCK
    inside = F.size(F.filter(F.slice("_edges", before + 1, BLOCK), lambda e: e <= place))
    cut = F.col("_edges").isNotNull()
    return out.withColumn("_chunk", F.when(cut, before + inside).otherwise(0)).withColumn("_cut", cut).drop("_key", "_edges", "_blocks")


def _split(df: DataFrame, key: str, order: list[str], chunk: Column | None, range_rows: int, max_keys: int):
    """(all rows with ``_chunk``, rows of the keys that need a carry, with ``_chunk``)."""
    if chunk is not None:
        d = df.withColumn("_chunk", chunk).withColumn("_cut", F.lit(True))
        return d, d
    edges = range_edges(df, key, order, range_rows, max_keys)
    return _ranged(df, key, order, edges, "left"), _ranged(df, key, order, edges, "inner")


def _carried(local: DataFrame, carry: DataFrame, key: str, small: bool) -> DataFrame:
    """Left join of the carry table; ``small`` says that its size is bounded by the edges."""
    c = carry.withColumnsRenamed({key: "_ckey", "_chunk": "_cchunk"})
    on = F.col(key).eqNullSafe(F.col("_ckey")) & F.col("_chunk").eqNullSafe(F.col("_cchunk"))
    return local.join(F.broadcast(c) if small else c, on & F.col("_cut"), "left").drop("_ckey", "_cchunk", "_cut")


def running(
    df: DataFrame,
    key: str,
    order: list[str],
    chunk: Column | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    range_rows: int = RANGE_ROWS,
    max_keys: int = MAX_KEYS,
) -> DataFrame:
    """Add inclusive running ``sums``, last non-null ``lasts`` and running ``mins`` per key in ``order``.

    With ``chunk`` (a value that grows with the order, equal for ties) every key
    is cut there; without, large keys are cut at edges of about ``range_rows`` rows.
    """
    sums, lasts, mins = dict(sums or {}), dict(lasts or {}), dict(mins or {})
    all_rows, cut_rows = _split(df, key, order, chunk, range_rows, max_keys)

    def with_values(d):
        return d.withColumns({**{f"_v_{n}": c for n, c in sums.items()}, **{f"_l_{n}": c for n, c in lasts.items()},
                              **{f"_m_{n}": c for n, c in mins.items()}})

    wl = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = with_values(all_rows).withColumns({
        **{f"_v_{n}": F.sum(f"_v_{n}").over(wl) for n in sums}, **{f"_l_{n}": F.last(f"_l_{n}", ignorenulls=True).over(wl) for n in lasts},
        **{f"_m_{n}": F.min(f"_m_{n}").over(wl) for n in mins}})
    per_range = with_values(cut_rows).groupBy(key, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(F.col(f"_l_{n}"), F.when(F.col(f"_l_{n}").isNotNull(), _place(order))).alias(f"_e_{n}") for n in lasts],
        *[F.min(f"_m_{n}").alias(f"_s_{n}") for n in mins])
    wc = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(
        key, "_chunk",
        *[F.sum(f"_t_{n}").over(wc).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_e_{n}", ignorenulls=True).over(wc).alias(f"_o_{n}") for n in lasts],
        *[F.min(f"_s_{n}").over(wc).alias(f"_o_{n}") for n in mins])
    out = _carried(local, carry, key, chunk is None)
    out = out.withColumns({
        **{n: F.coalesce(F.col(f"_v_{n}"), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums},
        **{n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_o_{n}")) for n in lasts},
        **{n: F.least(F.col(f"_m_{n}"), F.col(f"_o_{n}")) for n in mins}})
    return out.drop("_chunk", *[f"_{p}_{n}" for n in sums for p in "vo"], *[f"_{p}_{n}" for n in lasts for p in "lo"],
                    *[f"_{p}_{n}" for n in mins for p in "mo"])


def neighbors(df: DataFrame, key: str, order: list[str], chunk: Column | None, cols: list[str],
              range_rows: int = RANGE_ROWS, max_keys: int = MAX_KEYS) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>`` (values of the previous / next row of the key); cut as in ``running``."""
    all_rows, cut_rows = _split(df, key, order, chunk, range_rows, max_keys)
    row = F.struct(*[F.col(c) for c in cols])
    wl = Window.partitionBy(key, "_chunk").orderBy(*order)
    local = all_rows.withColumn("_row", row).withColumns({"_lag": F.lag("_row").over(wl), "_lead": F.lead("_row").over(wl)})
    per_range = cut_rows.groupBy(key, "_chunk").agg(
        F.min_by(row, _place(order)).alias("_first"), F.max_by(row, _place(order)).alias("_last"))
    wc = Window.partitionBy(key).orderBy("_chunk")
    carry = per_range.select(key, "_chunk", F.lag("_last").over(wc).alias("_before"), F.lead("_first").over(wc).alias("_after"))
    out = _carried(local, carry, key, chunk is None)
    prev, nxt = F.coalesce(F.col("_lag"), F.col("_before")), F.coalesce(F.col("_lead"), F.col("_after"))
    out = out.withColumns({**{f"prev_{c}": prev[c] for c in cols}, **{f"next_{c}": nxt[c] for c in cols}})
    return out.drop("_chunk", "_row", "_lag", "_lead", "_before", "_after")


def ordinal(df: DataFrame, key: str, order: list[str], chunk: Column | None = None, name: str = "ordinal",
            range_rows: int = RANGE_ROWS) -> DataFrame:
    """1-based position of each row within its key (a running count)."""
    return running(df, key, order, chunk, sums={name: F.lit(1).cast("bigint")}, range_rows=range_rows)
