"""Near-duplicate e-mails without a cross join.

``sim(a, b) = (L - lev(a, b)) / L`` with ``L`` the longer length, so
``sim >= t`` means ``lev <= tau(L) = floor((1 - t) * L)``.  Every string is cut
before its last ``@`` (none: the whole string) into a local part and a domain.

Cells (``_by_cell``): the ``largest`` domains are compared with one another.  If
strings ``x u`` and ``y v`` are within ``tau``, their local parts are within
``tau - e(u, v)`` (``_domain_gap``; ``e`` is 0 for one domain).  A cell is a pair of
domains with a length of local part each that both occur; only these get keys.
With ``edits`` left for a cell whose longer local parts have ``m`` characters, an
alignment with ``k`` insertions against as many deletions keeps ``m - edits + k``
characters: for equal lengths either the same characters stand at the same
``m - edits`` places (a key for each choice of places) or ``m - edits + 1``
characters are a common subsequence (a key for each subsequence); for different
lengths ``m - edits`` are.  Where that would be more than ``MOST_KEYS`` for a
string, the shorter parts are cut into segments as below; cells of few strings
have one key.  A key row is a key, the hash of its string and a side; they are
sent as blocks of bytes, bucket by bucket of keys, and paired within a bucket.
Distinct pairs of hashes are joined with their strings (a collision adds a
candidate, never hides one).

Pairs with a domain beyond the ``largest``:

Same domain: ``tau`` edits leave at least ``m - tau`` characters of the longer
part (length ``m``) in common, in order: the keys are all such subsequences, or
segments beyond ``MOST_KEYS``.  Domains with at most ``hot_rows`` index strings are
paired as they are.

Different domains: the segment (pigeonhole) scheme of Li, Deng, Wang and Feng,
"Pass-Join" (PVLDB 5(3), 2011): the shorter string ``s`` (length ``n``) is cut
into ``tau + 1`` even segments; if ``lev(s, r) <= tau`` one segment occurs
unchanged in ``r`` at a shift ``d`` with ``|d| + |(m - n) - d| <= tau``.  Both
sides are exploded into ``(n, m, segment, text)`` keys and equi-joined.  Keys
with more than ``hot_rows`` index entries (at most ``max_hot_keys`` of them, so
the broadcast list is bounded) are joined domain pair by domain pair, only for
domains that ``tau`` edits may turn into each other (``_domain_cost``), salted.

Every candidate is checked with the exact, bounded ``levenshtein(a, b, tau)``.
Nothing is dropped; ``segment_key_report`` lists the hot keys.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K

EPS = 1e-6  # tau is over-estimated by at most this; verification is exact
MOST_KEYS = 1024  # subsequences of one local part; beyond, segments
SLICE = 2000  # strings whose keys are held at a time
LARGEST = 256  # domains compared with one another
BROADCAST_CELLS = 100_000
FEW = 16  # candidates per string for which a cell has one key
PAIRS = 1 << 18  # pairs made at a time
BLOCK_ROWS = 1 << 20  # key rows sorted into buckets at a time
PARTITION_ROWS = 2_000_000  # key rows of a partition
BUCKET_ROWS = 50_000  # key rows of a bucket, at least


def similarity(a, b) -> Column:
    """0 if either is missing, 1 if equal, else ``(L - lev) / L``."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    L = F.greatest(F.length(a), F.length(b))
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return (
        F.when(missing, F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise((L - F.levenshtein(a, b)).cast("double") / L)
    )


def score_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """D14 over a table of candidate pairs."""
    return pairs.withColumn("similarity", similarity(a, b))


def _tau(L: Column, t: float) -> Column:
    return F.floor(F.lit(1.0 - t) * L + F.lit(EPS)).cast("int")


def _segments(n: Column, tau: Column):
    """Start and length of each of ``tau + 1`` even segments of a string of length ``n``.

    The first ``k - n % k`` segments have ``n // k`` characters, the rest one more.
    """
    k = tau + 1
    base = F.floor(n / k).cast("int")
    longer = (n % k).cast("int")
    short_count = k - longer
    i = F.col("seg_no")
    start = F.when(i < short_count, i * base).otherwise(short_count * base + (i - short_count) * (base + 1))
    length = F.when(i < short_count, base).otherwise(base + 1)
    return start, length


def _index_rows(strings: DataFrame, t: float) -> DataFrame:
    """Index side: string ``s`` of length ``n`` cut for every admissible longer length ``m``."""
    d = strings.select("s", F.length("s").alias("n"))
    # m - n <= floor((1 - t) m)  <=>  m <= n / t
    d = d.withColumn("m", F.explode(F.sequence(F.col("n"), F.floor(F.col("n") / F.lit(t) + F.lit(EPS)).cast("int"))))
    d = d.withColumn("tau", _tau(F.col("m"), t))
    short = d.filter(F.col("n") < F.col("tau") + 1).select(
        "s", "n", "m", "tau", F.lit(-1).alias("seg_no"), F.lit("").alias("seg"))
    long_ = d.filter(F.col("n") >= F.col("tau") + 1).withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.col("tau"))))
    start, length = _segments(F.col("n"), F.col("tau"))
    long_ = long_.select("s", "n", "m", "tau", "seg_no", F.substring("s", start + 1, length).alias("seg"))
    return long_.unionByName(short)


def _probe_rows(strings: DataFrame, t: float) -> DataFrame:
    """Probe side: string ``r`` of length ``m``, substrings at the admissible shifts per segment."""
    d = strings.select(F.col("s").alias("r"), F.length("s").alias("m"))
    d = d.withColumn("tau", _tau(F.col("m"), t))
    d = d.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - F.col("tau")), F.col("m"))))
    # keep only n whose own bound admits m (the index side used the same rule)
    d = d.filter(F.col("m") <= F.floor(F.col("n") / F.lit(t) + F.lit(EPS)))
    short = d.filter(F.col("n") < F.col("tau") + 1).select(
        "r", "n", "m", "tau", F.lit(-1).alias("seg_no"), F.lit("").alias("seg"))
    long_ = d.filter(F.col("n") >= F.col("tau") + 1).withColumn("seg_no", F.explode(F.sequence(F.lit(0), F.col("tau"))))
    start, length = _segments(F.col("n"), F.col("tau"))
    delta = F.col("m") - F.col("n")
    lo = F.ceil((delta - F.col("tau")) / F.lit(2.0)).cast("int")
    hi = F.floor((delta + F.col("tau")) / F.lit(2.0)).cast("int")
    long_ = long_.withColumn("_start", start).withColumn("_len", length).withColumn(
        "d", F.explode(F.sequence(lo, hi)))
    pos = F.col("_start") + F.col("d")
    long_ = long_.filter((pos >= 0) & (pos + F.col("_len") <= F.col("m"))).select(
        "r", "n", "m", "tau", "seg_no", F.substring("r", pos + 1, F.col("_len")).alias("seg"))
    return long_.unionByName(short)


KEY = ["n", "m", "seg_no", "seg"]


def segment_key_report(index: DataFrame, hot_rows: int) -> DataFrame:
    """Segment keys with more than ``hot_rows`` index entries (those joined by domain pair)."""
    return index.groupBy(*KEY).agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") > hot_rows)


def _domain(s: str) -> Column:
    """The string from its last ``@`` on ('' without one)."""
    return F.when(F.instr(F.col(s), "@") > 0, F.concat(F.lit("@"), F.substring_index(F.col(s), "@", -1))).otherwise(F.lit(""))


def _local(s: str, domain: str) -> Column:
    return F.substring(F.col(s), F.lit(1), F.length(s) - F.length(domain))


def _near(t: float) -> Column:
    """Whether strings ``s`` and ``r`` (``len(s) <= len(r)``) are different and within the bound."""
    tau = f"cast(floor({1.0 - t!r}D * length(r) + {EPS!r}D) as int)"
    return (F.col("s") != F.col("r")) & (F.expr(f"levenshtein(s, r, {tau})") >= 0)


# --- same domain -------------------------------------------------------------


def _mix(h: np.ndarray, x) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _even_segments(n: int, k: int) -> list[tuple[int, int]]:
    """As ``_segments``: start and length of ``k`` even segments."""
    base, longer = divmod(n, k)
    lens = [base] * (k - longer) + [base + 1] * longer
    return [(sum(lens[:i]), x) for i, x in enumerate(lens)]


def _hash_at(codes: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Hashes (row, choice) of the characters at each choice of places."""
    h = np.full((len(codes), len(places)), seed + 1, np.uint64)
    for j in range(places.shape[1]):
        h = _mix(h, codes[:, places[:, j]])
    return h


def _keys_of(codes: np.ndarray, domain_length: int, t: float, strict: bool, probe: bool, most: int):
    """Keys (row, key) of local parts of one length, one array for each length ``m`` of the longer part."""
    n = codes.shape[1]
    m = n + int(strict and not probe)
    while True:
        tau = floor((1.0 - t) * (m + domain_length) + EPS)
        q = m - tau  # characters that stay
        if q > n:
            return
        if q <= 0:
            yield _hash_at(codes, np.zeros((1, 0), np.int64), m << 20)
        elif comb(m, q) <= most:
            yield _hash_at(codes, np.array(list(combinations(range(n), q)), np.int64), m << 20)
        else:
            for n1 in range(q, m + 1) if probe else (n,):  # the length of the shorter part
                if n1 <= tau:
                    yield _hash_at(codes, np.zeros((1, 0), np.int64), (m << 20) + (n1 << 8) + 255)
                    continue
                lo, hi = (-((tau - m + n1) // 2), (m - n1 + tau) // 2) if probe else (0, 0)
                for i, (start, length) in enumerate(_even_segments(n1, tau + 1)):
                    at = np.array([x for x in range(start + lo, start + hi + 1) if x >= 0 and x + length <= n], np.int64)
                    if len(at):
                        yield _hash_at(codes, at[:, None] + np.arange(length), (m << 20) + (n1 << 8) + i % 255)
        if probe:
            return
        m += 1


def _local_keys(t, strict, probe, most, batches):
    """(k, s) for the strings (s, local part, length and hash of the domain) of each batch, every key of a string once."""
    for batch in batches:
        s, local = batch.column(0), batch.column(1).to_pylist()
        width, domain = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
        lens = np.array([len(x) for x in local], np.int64)
        order = np.lexsort((width, lens))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(lens[order]) != 0) | (np.diff(width[order]) != 0)])) if len(order) else order
        for a, b in zip(cut, [*cut[1:], len(order)]):
            for at in range(a, b, SLICE):
                rows = order[at:min(b, at + SLICE)]
                codes = np.frombuffer("".join([local[i] for i in rows]).encode("utf-32-le", "surrogatepass"), "<u4")
                codes = codes.astype(np.uint64).reshape(len(rows), int(lens[rows[0]]))
                for keys in _keys_of(codes, int(width[rows[0]]), t, strict, probe, most):
                    keys = np.sort(_mix(keys, domain[rows][:, None]), axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, _ = np.nonzero(new)
                    yield pa.record_batch([pa.array(keys[new].view(np.int64)), s.take(pa.array(rows[row]))], names=["k", "s"])


def _same_domain(index: DataFrame, probe: DataFrame, t: float, strict: bool, hot_rows: int, most: int) -> DataFrame:
    """Near pairs ``(s, r)`` with one domain; inputs ``(s, u)`` and ``(r, u)``."""
    big = index.groupBy("u").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > hot_rows).select(F.col("u").alias("_u"))
    shorter = F.length("s") < F.length("r") if strict else F.length("s") <= F.length("r")

    def few(d):
        return d.join(big, d["u"] == F.col("_u"), "left_anti")

    def keys(d, col, is_probe):
        d = d.join(big, d["u"] == F.col("_u"), "left_semi")
        d = d.select(col, _local(col, "u"), F.length("u"), F.xxhash64("u"))
        return d.mapInArrow(partial(_local_keys, t, strict, is_probe, most), "k long, s string")

    small = few(index).join(few(probe), "u").filter(shorter & _near(t)).select("s", "r")
    large = keys(index, "s", False).join(keys(probe, "r", True).withColumnRenamed("s", "r"), "k")
    return small.unionByName(large.filter(shorter & _near(t)).select("s", "r"))


# --- cells: pairs of the largest domains -----------------------------------------


def _domain_gap(u: str, v: str, n: str, p: str, tau: Column) -> Column:
    """``e`` with ``lev(x, y) <= tau - e`` for any ``x u`` and ``y v`` within ``tau``, ``x`` of length ``n``, ``y`` of ``p``; null if none can be.

    An alignment cuts ``y v`` into what faces ``x`` and what faces ``u``.  If the
    latter is ``v`` without its first ``i`` characters, ``x`` faces ``i`` more than
    ``y``; if it is ``v`` after an end of ``y``, that end faces the first ``a``
    characters of ``u`` and ``x`` faces the rest of ``y``, at best ``a`` less.
    """
    def least(whole, other, more):
        def gap(i):
            lev = F.levenshtein(F.col(other), F.substring(F.col(whole), i + F.lit(1), F.length(whole)))
            return F.when(lev + F.abs(more - i) <= tau, lev - i)

        return F.array_min(F.transform(F.sequence(F.lit(0), F.length(whole)), gap))

    return F.least(least(v, u, F.col(n) - F.col(p)), least(u, v, F.col(p) - F.col(n)))


def _key_count(n: int, other: int, edits: int, most: int) -> int:
    """How many keys a string of a cell has; 0 if its keys are segments."""
    m = max(n, other)
    q = m - edits
    if q <= 0:
        return 1
    more = comb(m, q + 1) if n == other and edits > 1 else 0
    return comb(n, q) + (comb(n, q + 1) if more else 0) if max(comb(m, q), more) <= most else 0


def _cell_keys_of(codes: np.ndarray, other: int, edits: int, cut: bool, most: int):
    """Keys (row, key) of local parts of one length, against parts of length ``other``; ``cut``: these are cut into segments."""
    n = codes.shape[1]
    q = max(n, other) - edits
    if q <= 0:
        yield _hash_at(codes, np.zeros((1, 0), np.int64), 0)
    elif _key_count(n, other, edits, most):
        places = np.array(list(combinations(range(n), q)), np.int64).reshape(-1, q)
        if n != other:
            yield _hash_at(codes, places, 1)
            return
        yield _mix(_hash_at(codes, places, 2), np.arange(len(places), dtype=np.uint64))  # the same places
        if edits > 1:
            yield _hash_at(codes, np.array(list(combinations(range(n), q + 1)), np.int64).reshape(-1, q + 1), 3)
    else:
        shorter, longer = min(n, other), max(n, other)
        if shorter <= edits:
            yield _hash_at(codes, np.zeros((1, 0), np.int64), 0)
            return
        lo, hi = (0, 0) if cut else (-((edits - longer + shorter) // 2), (longer - shorter + edits) // 2)
        for i, (start, length) in enumerate(_even_segments(shorter, edits + 1)):
            at = np.array([x for x in range(start + lo, start + hi + 1) if x >= 0 and x + length <= n], np.int64)
            if len(at):
                yield _hash_at(codes, at[:, None] + np.arange(length), 4 + i)


def _cell_keys(most, buckets, batches):
    """Blocks of key rows of (id, local part, other length, edits, cell, side), every key of a row once."""
    held, count = [], 0
    for batch in batches:
        ids, cell = batch.column(0).to_numpy(), batch.column(4).to_numpy().view(np.uint64)
        local, side = batch.column(1).to_pylist(), batch.column(5).to_numpy()
        kind = np.array([[len(x) for x in local], batch.column(2).to_numpy(), batch.column(3).to_numpy(), side], np.int64)
        order = np.lexsort(kind)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(kind[:, order]) != 0).any(axis=0)])) if len(order) else order
        for a, b in zip(cut, [*cut[1:], len(order)]):
            n, other, edits, which = (int(x) for x in kind[:, order[a]])
            for at in range(a, b, SLICE):
                rows = order[at:min(b, at + SLICE)]
                codes = np.frombuffer("".join([local[i] for i in rows]).encode("utf-32-le", "surrogatepass"), "<u4")
                codes = codes.astype(np.uint64).reshape(len(rows), n)
                for keys in _cell_keys_of(codes, other, edits, n < other or n == other and which == 1, most):
                    keys = np.sort(_mix(keys, cell[rows][:, None]), axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, _ = np.nonzero(new)
                    held.append((keys[new], ids[rows[row]], side[rows[row]]))
                    count += len(row)
                    if count >= BLOCK_ROWS:
                        yield _block(held, buckets)
                        held, count = [], 0
    if count:
        yield _block(held, buckets)


def _block(held, buckets: int):
    """A row (bucket, k, id, side) for each bucket of keys: the bytes of its key rows' columns."""
    cols = [np.concatenate(c) for c in zip(*held)]
    bucket = (cols[0] % np.uint64(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order))

    def packed(c):
        data = c[order]
        return pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

    return pa.record_batch([pa.array(there.astype(np.int32)), *(packed(c) for c in cols)], names=["bucket", "k", "id", "side"])


def _runs(k: np.ndarray):
    """Places ``(x, y)`` of all pairs of rows with one key, ``x`` before ``y``; the keys are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        if size * size <= PAIRS:
            a, b = np.triu_indices(size, 1)
            for i in range(0, len(at), step := max(1, PAIRS // len(a))):
                yield (at[i:i + step, None] + a).ravel(), (at[i:i + step, None] + b).ravel()
            continue
        for start in at:
            for i in range(0, size, step := max(1, PAIRS // size)):
                a, b = np.meshgrid(np.arange(i, min(size, i + step)), np.arange(i + 1, size), indexing="ij")
                yield start + a[a < b], start + b[a < b]


def _pair_up(batches):
    """Pairs (i, j) of an index row's and a probe row's id with one key, for rows (bucket, k, id, side) sorted by bucket.

    Side 1 is index, 2 probe, 3 both: two such rows are one pair.
    """
    def pairs(held):
        k, ids, side = (np.concatenate([np.frombuffer(block[c].as_buffer(), of) for block in held])
                        for c, of in enumerate((np.uint64, np.int64, np.int8)))
        order = np.argsort(k)
        k, ids, side = k[order], ids[order], side[order]
        for x, y in _runs(k):
            there = (side[x] & 1 > 0) & (side[y] & 2 > 0)
            back = (side[y] & 1 > 0) & (side[x] & 2 > 0) & ~there
            i, j = np.concatenate([ids[x[there]], ids[y[back]]]), np.concatenate([ids[y[there]], ids[x[back]]])
            if len(i):
                yield pa.record_batch([pa.array(i), pa.array(j)], names=["i", "j"])

    held, at = [], None
    for batch in batches:
        for bucket, *block in zip(*batch.columns):
            if bucket != at and held:
                yield from pairs(held)
                held = []
            held.append(block)
            at = bucket
    if held:
        yield from pairs(held)


def _by_cell(index: DataFrame, probe: DataFrame, lengths: DataFrame, t: float, strict: bool, most: int, same: bool) -> DataFrame:
    """Near pairs ``(s, r)`` of the domains in ``lengths``; inputs ``(s, u)`` and ``(r, u)``, ``same``: one table."""
    from ..session import materialize

    spark = index.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    longest = lengths.groupBy("u").agg((F.max("n") + F.length("u")).alias("w"))
    lanes = F.sequence(F.lit(0), F.lit(15))
    links = longest.withColumn("lane", F.explode(lanes)).repartition(16, "lane").join(
        longest.select(F.col("u").alias("v"), F.col("w").alias("_w"), F.pmod(F.xxhash64("u"), F.lit(16)).cast("int").alias("lane")), "lane")
    links = links.withColumn("_most", _tau(F.least(F.col("_w"), F.floor(F.col("w") / F.lit(t) + F.lit(EPS))), t))
    links = links.filter(_domain_cost("u", "v") <= F.col("_most")).select("u", "v")

    cells = links.join(lengths.filter("ni > 0").drop("np"), "u").join(
        lengths.filter("np > 0").select(F.col("u").alias("v"), F.col("n").alias("p"), "np"), "v")
    short, long_ = F.col("n") + F.length("u"), F.col("p") + F.length("v")
    cells = cells.filter((short < long_ if strict else short <= long_) & (long_ - short <= _tau(long_, t)))
    cells = cells.withColumn("edits", _tau(long_, t) - _domain_gap("u", "v", "n", "p", _tau(long_, t)))
    cells = cells.filter(F.abs(F.col("n") - F.col("p")) <= F.col("edits"))
    if same:  # one order of two domains; the other is mirrored
        cells = cells.filter((short < long_) | (F.col("u") <= F.col("v")))
    both = (F.col("u") == F.col("v")) & (F.col("n") == F.col("p")) & F.lit(same)
    few = F.col("ni") * F.col("np") <= F.lit(FEW) * (F.col("ni") + F.col("np"))
    cells = materialize(cells.select(
        "u", "n", "v", "p", F.when(few, F.greatest("n", "p")).otherwise(F.col("edits")).cast("int").alias("edits"),
        F.xxhash64("u", "v", "n", "p").alias("cell"), both.alias("both"), "ni", "np"), "similarity-cells")
    rows = count = 0
    for r in cells.groupBy("n", "p", "edits").agg(F.count(F.lit(1)).alias("cells"), F.sum("ni").alias("ni"), F.sum(
            F.when(~F.col("both"), F.col("np")).otherwise(0)).alias("np")).collect():
        count += r.cells
        rows += r.ni * (_key_count(r.n, r.p, r.edits, most) or r.edits + 1)
        rows += r.np * (_key_count(r.p, r.n, r.edits, most) or (r.edits + 1) ** 2)
    parts = min(max(parts, -(-rows // PARTITION_ROWS)), rows // BUCKET_ROWS + 1)

    def sides(d, col, u, n, other, side, wanted):
        wanted = F.broadcast(wanted) if count <= BROADCAST_CELLS else wanted
        d = d.select(F.xxhash64(col).alias("id"), _local(col, "u").alias("x"), F.col("u").alias(u)).withColumn(n, F.length("x").cast("int"))
        return d.repartition(parts).join(wanted, [u, n]).select(
            "id", "x", F.col(other).alias("other"), "edits", "cell", F.lit(side).cast("tinyint").alias("side"))

    buckets = min(4 * parts, rows // BUCKET_ROWS + 1, 65536)

    def keys(d):
        return d.mapInArrow(partial(_cell_keys, most, buckets), "bucket int, k binary, id binary, side binary")

    made = keys(sides(index, "s", "u", "n", "p", 1, cells.filter(~F.col("both")))).unionByName(
        keys(sides(probe, "r", "v", "p", "n", 2, cells.filter(~F.col("both")))))
    if same:
        made = made.unionByName(keys(sides(index, "s", "u", "n", "p", 3, cells.filter("both"))))
    pairs = made.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_pair_up, "i long, j long").distinct()
    pairs = pairs.join(index.select(F.xxhash64("s").alias("i"), "s"), "i").join(probe.select(F.xxhash64("r").alias("j"), "r"), "j")
    pairs = pairs.filter(_near(t)).select("s", "r")
    if same:
        there = F.array(F.struct("s", "r"), F.struct(F.col("r").alias("s"), F.col("s").alias("r")))
        pairs = pairs.select(F.inline(F.when(F.length("s") == F.length("r"), there).otherwise(F.slice(there, 1, 1))))
    return pairs


# --- different domains ---------------------------------------------------------


def _hot_keys(idx: DataFrame, hot_rows: int, max_hot_keys: int) -> DataFrame:
    """Keys with more than ``hot_rows`` index rows, at most ``max_hot_keys`` of them (broadcast-safe)."""
    return (
        idx.groupBy("k").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > hot_rows)
        .orderBy(F.desc("_c"), "k").limit(max_hot_keys).select("k")
    )


def _domain_cost(u: str, v: str) -> Column:
    """What any strings ``x u`` and ``y v`` differ by at least: an end of one domain against the other domain.

    An alignment of the strings cuts ``y v`` where ``u`` begins: the rest is an
    end of ``v``, or all of ``v`` after some of ``y`` and so opposite an end of ``u``.
    """
    def least(whole, other):
        ends = F.transform(F.sequence(F.lit(1), F.length(whole) + 1), lambda i: F.levenshtein(
            F.col(other), F.substring(F.col(whole), i, F.length(whole))))
        return F.array_min(ends)

    return F.least(least(v, u), least(u, v))


def _other_domain(index: DataFrame, probe: DataFrame, t: float, strict: bool, hot_rows: int, max_hot_keys: int,
                  salt: int) -> DataFrame:
    """Near pairs ``(s, r)`` with different domains, ``len(s) <= len(r)``."""
    key = F.xxhash64("n", "m", "seg_no", "seg").alias("k")
    idx, prb = _index_rows(index, t), _probe_rows(probe.withColumnRenamed("r", "s"), t)
    if strict:  # pairs with len(index) == len(probe) are produced by the other call
        prb = prb.filter(F.col("n") < F.col("m"))
    idx = idx.select("s", "tau", key, _domain("s").alias("u"))
    prb = prb.select("r", key, _domain("r").alias("v"))
    hot = F.broadcast(_hot_keys(idx, hot_rows, max_hot_keys))
    cold = idx.join(hot, "k", "left_anti").join(prb.join(hot, "k", "left_anti"), "k").filter(
        (F.col("u") != F.col("v")) & _near(t)).select("s", "r")
    idx, prb = idx.join(hot, "k", "left_semi"), prb.join(hot, "k", "left_semi")
    domains = idx.select("k", "u", "tau").distinct().join(prb.select("k", "v").distinct(), "k").filter(F.col("u") != F.col("v"))
    domains = domains.filter(_domain_cost("u", "v") <= F.col("tau")).select("k", "u", "v").distinct()
    spread = idx.join(domains, ["k", "u"]).withColumn("_salt", F.pmod(F.xxhash64("s"), F.lit(salt)))
    again = prb.join(domains.select("k", "v").distinct(), ["k", "v"], "left_semi").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    warm = spread.join(again, ["k", "v", "_salt"]).filter(_near(t)).select("s", "r")
    return cold.unionByName(warm)


def _candidates(index_strings: DataFrame, probe_strings: DataFrame, t: float, strict: bool,
                hot_rows: int, max_hot_keys: int, salt: int, most_keys: int = MOST_KEYS, largest: int = LARGEST) -> DataFrame:
    """Near pairs (a from index side, b from probe side) with ``len(a) <= len(b)`` (``strict``: shorter), each once."""
    from ..session import materialize, ship_package

    ship_package(index_strings.sparkSession)
    i = index_strings.select("s", _domain("s").alias("u"))
    p = probe_strings.select(F.col("s").alias("r"), _domain("s").alias("u"))

    def lengths_of(d, col, ni, np):
        return d.select("u", (F.length(col) - F.length("u")).alias("n"), F.lit(ni).alias("ni"), F.lit(np).alias("np"))

    same = index_strings is probe_strings
    lengths = lengths_of(i, "s", 1, 1) if same else lengths_of(i, "s", 1, 0).unionByName(lengths_of(p, "r", 0, 1))
    lengths = materialize(lengths.groupBy("u", "n").agg(F.sum("ni").alias("ni"), F.sum("np").alias("np")), "similarity-lengths")
    top = lengths.groupBy("u").agg(F.sum(F.col("ni") + F.col("np")).alias("_c")).orderBy(F.desc("_c"), "u").limit(largest)
    more = lengths.select("u").distinct().count() > largest
    if more:
        top = F.broadcast(materialize(top.select("u"), "similarity-domains"))
        lengths = lengths.join(top, "u", "left_semi")
    found = _by_cell(i, p, lengths, t, strict, most_keys, same)
    if more:
        rest, others = i.join(top, "u", "left_anti"), p.join(top, "u", "left_anti")
        found = found.unionByName(_same_domain(rest, others, t, strict, hot_rows, most_keys))
        for one, two in ((rest, p), (i.join(top, "u", "left_semi"), others)):
            found = found.unionByName(_other_domain(one.select("s"), two.select("r"), t, strict, hot_rows, max_hot_keys, salt))
    return found.distinct().select(F.col("s").alias("a"), F.col("r").alias("b"))


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.8, col: str = "s",
                  hot_rows: int = 32, max_hot_keys: int = 65536, salt: int = 16,
                  materialize_inputs: bool = True) -> DataFrame:
    """All distinct string pairs ``(a from left, b from right)`` with ``threshold <= sim < 1``.

    ``right=None`` (or the same frame) is a self-join: the candidates of one
    orientation are generated once and mirrored, since similarity is symmetric.
    The distinct strings are written once below the checkpoint folder so the
    two sides of every join read a small file instead of re-running the
    upstream plan.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    same = right is None or right is left

    def strings(df):
        out = df.select(F.col(col).alias("s")).filter(F.col("s").isNotNull() & (F.col("s") != "")).distinct()
        if materialize_inputs:
            from ..session import materialize

            out = materialize(out, "similarity-strings")
        return out

    L = strings(left)
    R = L if same else strings(right)
    # len(a) <= len(b): index a, probe b; len(b) < len(a): index b, probe a
    c1 = _candidates(L, R, threshold, False, hot_rows, max_hot_keys, salt)
    if same:  # both directions of a pair from one row
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        cand = c1.select(F.inline(F.when(F.length("a") < F.length("b"), both).otherwise(F.slice(both, 1, 1))))
    else:
        c2 = _candidates(R, L, threshold, True, hot_rows, max_hot_keys, salt).select(
            F.col("b").alias("a"), F.col("a").alias("b"))
        cand = c1.unionByName(c2)
    Lmax = F.greatest(F.length("a"), F.length("b"))
    # bounded edit distance: -1 once it exceeds tau (the threshold may be a column in SQL form)
    scored = cand.withColumn("_tau", _tau(Lmax, threshold)).withColumn("_lev", F.expr("levenshtein(a, b, _tau)"))
    scored = scored.drop("_tau").filter(F.col("_lev") >= 0).withColumn(
        "similarity", (Lmax - F.col("_lev")).cast("double") / Lmax)
    return scored.filter((F.col("similarity") >= F.lit(threshold)) & (F.col("similarity") < F.lit(1.0))).drop("_lev")


def find_potential_duplicates(probes: DataFrame, seen: DataFrame | None = None, threshold: float = 0.8,
                              id_col: str = "line_number", email_col: str = "email", **kw) -> DataFrame:
    """For each probe, the seen contacts with ``threshold <= sim < 1`` on lower-cased e-mails.

    Output: ``probe_id, match_id, similarity, reason, rank`` (best first, ties by match id).
    """
    from ..session import materialize

    same = seen is None or seen is probes
    p = materialize(probes.select(F.col(id_col).alias("probe_id"), F.lower(F.col(email_col)).alias("s")),
                    "similarity-probes")
    s = p.withColumnRenamed("probe_id", "match_id") if same else materialize(
        seen.select(F.col(id_col).alias("match_id"), F.lower(F.col(email_col)).alias("s")), "similarity-seen")
    pairs = similar_pairs(p, None if same else s, threshold, **kw)
    out = (
        pairs.join(p.withColumnRenamed("s", "a"), "a")
        .join(s.withColumnRenamed("s", "b"), "b")
        .filter(F.col("probe_id") != F.col("match_id"))
    )
    w = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "match_id")
    return out.select(
        "probe_id",
        "match_id",
        F.round("similarity", 6).alias("similarity"),
        F.lit(K.SIMILARITY_REASON).alias("reason"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    )
