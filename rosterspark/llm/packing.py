"""Best-fit packing (operator 1) with Martello-Toth dominance reduction.

Texts become token ids, longer ones are cut into pieces of the capacity.  As
lengths are at most the capacity, an instance is its histogram of lengths (at
most 2048 rows); the driver works on that alone, whatever the number of pieces:

* ``reduce_instance`` permanently fixes a set {w}, {w, k} or {w, k, b} wherever
  it provably dominates every set that could hold w: nothing else fits; k fills
  the sequence or only one more piece fits; k is no shorter than any two pieces
  that fit together; or k is the longest that fits and b, the longest after it,
  is no shorter than the second piece of any two.  A set is fixed as often as
  its lengths last, for these conditions survive taking pieces away.
* ``best_fit`` places the remainder longest first, each into the fullest
  sequence that holds it; sequences with equal contents are handled together.

The plan says for each length which ranks go where; Spark ranks the pieces of a
length (salted, so that a frequent length is not one task) and joins the plan,
whose size is bounded by the capacity and which is therefore broadcast.

Defined cases: a null or empty text has the end id only (length 1).  Repeated
rows are packed each.  Ties of equal length are ranked by (doc_id, piece); a
null doc_id sorts first.  An empty table packs to nothing.  Only doc_id and
text are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import bucket_count, chunks, doc_rows, public_id
from rosterspark.session import materialize

CAPACITY = 2048
CACHED_WORDS = 600_000
PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PLAIN = re.compile("[\x21-\x3b\x3d-\x7e\u00c0-\u00ff]+").fullmatch  # no special token and nothing that normalising composes
_LOADED: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _merger(path):
    """A function from a plain word to its ids: the vocabulary's merges in order of rank, on bytes, with a byte that no
    text holds for the end of a word.  Gives the tokenizer's own ids, several times quicker than asking it word by word."""
    import regex
    import tiktoken

    vocab = json.load(open(path, encoding="utf8"))["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    ranks = {}
    for token, i in vocab.items():
        last = token.endswith("</w>") and len(token) > 4
        ranks[bytes(byte[c] for c in (token[:-4] if last else token)) + b"\xff" * last] = i
    merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall  # the vocabulary file's own pattern

    def ids(word: str):
        out = []
        for p in parts(word.lower()):
            out += merge(p.encode() + b"\xff")
        return out
    return ids


def _words_encoder(path):
    """A function from texts to their id bytes.  The tokenizer drops white space and never joins words across it, so
    ids are found word by word and kept for words seen again."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = (Tokenizer.from_file(path), _merger(path) if path == default_tokenizer() else None, {})
    tok, plain, known = _LOADED[path]

    def encode(bodies):
        split = [b.split() for b in bodies]
        if len(known) > CACHED_WORDS:
            known.clear()
        other = []
        for w in set().union(*split).difference(known):
            text = w.decode("utf-8", "replace")
            if plain and PLAIN(text):
                known[w] = np.array(plain(text), "<u4").tobytes()
            else:
                other.append((w, text))
        for (w, _), e in zip(other, tok.encode_batch([t for _, t in other], add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, ws)) for ws in split]
    return encode


def _pieces(path, capacity, batches):
    encode = _words_encoder(path)
    for ids, _, bodies in chunks(batches, 1_000_000):
        out = []
        for i, data in zip(ids.tolist(), encode(bodies)):
            data += b"\0\0\0\0"
            for p, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at:at + 4 * capacity]
                out.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*out))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                              names=["id", "piece", "start", "length", "ids_crc32"])


def reduce_instance(counts: dict[int, int], capacity: int):
    """(fixed, rest): fixed sets as (lengths, how often), and the histogram that is left."""
    left, lengths, fixed = dict(counts), sorted(counts), []

    def fix(pattern):
        times = min(left[x] // pattern.count(x) for x in set(pattern))
        fixed.append((pattern, times))
        for x in pattern:
            left[x] -= times
        for x in set(pattern):
            if not left[x]:
                lengths.remove(x)

    def smallest(w, n):
        got = []
        for x in lengths:
            got += [x] * min(n - len(got), left[x] - (x == w))
            if len(got) == n:
                break
        return got

    def longest(room, used):
        k = bisect_right(lengths, room) - 1
        while k >= 0 and left[lengths[k]] <= used.count(lengths[k]):
            k -= 1
        return lengths[k] if k >= 0 else None

    def best_two(w, room):
        """(largest sum of two pieces that fit with w, largest second piece of two)."""
        total, second = 0, 0
        for x in lengths:
            if 2 * x > room + lengths[-1]:
                break
            y = longest(min(room - x, x), [w, x]) if room > x and left[x] > (x == w) else None
            if y is not None:
                total, second = max(total, x + y), max(second, y)
        return total, second

    for w in sorted(counts, reverse=True):
        while left[w]:
            room = capacity - w
            k = longest(room, [w])
            if k is None:
                fix([w])
                continue
            low = smallest(w, 3)
            if k == room or len(low) < 2 or low[0] + low[1] > room:
                fix([w, k])
                continue
            if len(low) == 3 and sum(low) <= room:
                break
            total, second = best_two(w, room)
            b = longest(room - k, [w, k]) if room > k else None
            if k >= total:
                fix([w, k])
            elif b is not None and b >= second:
                fix([w, k, b])
            else:
                break
    return fixed, {x: n for x, n in left.items() if n}


def best_fit(counts: dict[int, int], capacity: int):
    """Sets as (lengths with how many of each, how often): best fit, longest first."""
    groups: dict[int, list] = {}
    rooms: list[int] = []

    def put(room, pattern, times):
        if times:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, (), n
            each = room // w
            full = min(times, n // each)
            put(room - each * w, pattern + ((w, each),), full)
            n -= full * each
            times -= full
            if times and 0 < n < each:
                put(room - n * w, pattern + ((w, n),), 1)
                n, times = 0, times - 1
            if pattern:
                put(room, pattern, times)
    return [g for room in rooms for g in groups[room]]


def plan(counts: dict[int, int], capacity: int):
    """Rows (length, lo, hi, first, each, at): of the pieces of a length, rank r in [lo, hi) goes to sequence
    first + (r - lo) // each, at place at + (r - lo) % each * length."""
    fixed, rest = reduce_instance(counts, capacity)
    sets = [(tuple((x, p.count(x)) for x in sorted(set(p), reverse=True)), n) for p, n in fixed] + best_fit(rest, capacity)
    rows, used, first = [], dict.fromkeys(counts, 0), 0
    for pattern, times in sets:
        at = 0
        for x, each in pattern:
            rows.append((x, used[x], used[x] + times * each, first, each, at))
            used[x] += times * each
            at += x * each
        first += times
    return rows


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``rows`` with ``name``: their number from 0 within the keys.  Rows are numbered within salts of the keys and
    moved on by the counts of the salts before; ``rows`` must be a written table."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(bucket_count(rows.sparkSession))))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (salted.withColumn("_row", F.row_number().over(own).cast("long")).join(counts, [*keys, "_salt"])
            .withColumn(name, F.col("_row") - 1 + F.col("_base")).drop("_row", "_base", "_salt"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of ``docs`` (module docstring)."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    pieces = materialize(doc_rows(docs).mapInArrow(partial(_pieces, path, capacity), PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = spark.createDataFrame(plan(counts, capacity), "length long, lo long, hi long, first long, each long, at long")
    ranked = numbered(pieces, ["length"], ["id", "piece", "ids_crc32"], "rank").alias("p")
    placed = ranked.join(F.broadcast(rows).alias("q"), (F.col("p.length") == F.col("q.length"))
                         & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(public_id("p.id"), "piece", "start", "p.length", "ids_crc32",
                         (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
                         (F.col("at") + nth % F.col("each") * F.col("p.length")).alias("offset"))
