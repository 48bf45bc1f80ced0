"""Benchmark decontamination (operator 6) by spaced-seed hashing.

Words are split at ASCII white space, case-folded over Unicode (so 'STRASSE' is
'straße') and stripped of ASCII punctuation at both ends.  A mask says which of 11 consecutive words are hashed and which are ignored, so a
hit survives substitutions at ignored places.  The hashes of the benchmark meet
those of the documents, and every hit is verified along its diagonal (document
position less item position): with +1 for an equal word and -4 for a different
one, the best stretch must hold ``MIN_EQUAL`` equal words, so at least four
fifths of its words are equal.  Every such stretch fits one of the four masks
somewhere (enumerated in the tests).

Items of 5 to ``SHORT`` words need four fifths of their words equal on one
diagonal, wherever the changed ones stand.  Under 10 words at most one may
change, up to 16 at most three, so one half of the item has at most one: the
seeds are the item (its halves, from 10 words on) with one word ignored, once
for each word.  Items under 5 words never match: so few words stand in clean
text by chance.

Benchmark items are taken in blocks of at most ``BLOCK_WORDS`` words; a block's
index is broadcast (that is its size bound) and all documents are scanned for
it.  Documents are never shuffled and a passage in a third of them is no hot
key.

``overlaps`` returns one row per document row and item found in it: doc_id,
key, item_id, doc_start, item_start, n_words, n_equal (the best stretch, the
first on ties; of a short item whose best stretch is too short, the stretch
from its first to its last equal word).  ``clean`` returns the rows of documents without any overlap.
Defined cases: null texts have no words; null ids stay null; repeated rows are
judged each; an empty table on either side finds nothing; other columns are
ignored (``clean`` keeps them).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import NULL_ID, chunks, doc_rows, mix, starts_of

# 1 is hashed, 0 ignored.
MASKS = ("11101011011", "11011010111", "11110000111", "11101110111")
SHORT = 16
MIN_ITEM = 5
MIN_EQUAL = 13
MISMATCH = -4
BLOCK_WORDS = 1_000_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FOUND = "id long, key long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
CHUNK = 3_000_000
HITS = 1 << 17  # hits verified at a time


def clean_words(body: bytes) -> list[bytes]:
    folded = body.lower() if body.isascii() else body.decode(errors="surrogateescape").casefold().encode(errors="surrogateescape")
    return [w for w in (x.strip(PUNCTUATION) for x in folded.split()) if w]


def _hashes(bodies):
    words, lens = [], []
    for b in bodies:
        w = clean_words(b)
        lens.append(len(w))
        words += w
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.array(lens, np.int64)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, xxhash.xxh64_intdigest(mask.encode()), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += h[k:k + n] * np.uint64(xxhash.xxh64_intdigest(bytes([k])) | 1)
    return mix(out, out)


def need(n):
    """Equal words that an item of n words (a number or an array) must have."""
    return np.minimum(MIN_EQUAL, -(-4 * n // 5))


def item_seeds(n: int):
    """(mask, item positions) of the seeds of an item of n words."""
    if n < MIN_ITEM:
        return
    if n > SHORT:
        for mask in MASKS:
            yield mask, np.arange(n - len(mask) + 1)
        return
    for a, b in ((0, n),) if n < 2 * MIN_ITEM else ((0, n // 2), (n // 2, n)):
        for k in range(b - a):
            mask = "1" * k + "0" + "1" * (b - a - k - 1)
            yield mask.strip("0"), np.array([a + (k == 0)])  # a seed begins and ends within the passage


class Index:
    """The seed hashes of a block of items."""

    def __init__(self, ids, bodies):
        self.ids = ids
        self.h, self.lens = _hashes(bodies)
        self.starts = starts_of(self.lens)
        wanted: dict = {}
        for n in np.unique(self.lens).tolist():
            items = np.flatnonzero(self.lens == n)
            for mask, at in item_seeds(n):
                wanted.setdefault(mask, []).append((np.repeat(items, len(at)), np.tile(at, len(items))))
        self.masks = sorted(wanted)
        seeds = []
        for mask in self.masks:
            item, at = (np.concatenate(x) for x in zip(*wanted[mask]))
            seeds.append((seed_hashes(self.h, mask)[self.starts[item] + at], item, at))
        seed, item, at = (np.concatenate(x) for x in zip(*seeds)) if seeds else (np.zeros(0, np.uint64),) * 3
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order].astype(np.int64), at[order].astype(np.int64)
        self.cells = np.zeros(1 << 20, bool)
        self.cells[(self.seed >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h):
        """(document position, item, item position) of every equal seed, about ``HITS`` at a time."""
        for mask in self.masks:
            s = seed_hashes(h, mask)
            pos = np.flatnonzero(self.cells[(s >> np.uint64(44)).astype(np.int64)])
            s = s[pos]
            lo, hi = np.searchsorted(self.seed, s, "left"), np.searchsorted(self.seed, s, "right")
            some = hi > lo
            pos, lo, n = pos[some], lo[some], (hi - lo)[some]
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1
            for p, a, m in zip(*(np.split(x, cuts) for x in (pos, lo, n))):
                k = np.repeat(a, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                yield np.repeat(p, m), self.item[k], self.at[k]

    def enough(self, h, starts, doc, item, diagonal):
        """Whether a short item has the equal words it needs on the diagonal; True for the others."""
        out = np.ones(len(item), bool)
        short = np.flatnonzero(self.lens[item] <= SHORT)
        doc, item, diagonal, k = doc[short], item[short], diagonal[short], np.arange(SHORT)
        at = (starts[doc] + diagonal)[:, None] + k
        inside = (k < self.lens[item][:, None]) & (at >= starts[doc][:, None]) & (at < starts[doc + 1][:, None])
        own = np.minimum(self.starts[item][:, None] + k, len(self.h) - 1)
        equal = inside & (h[np.clip(at, 0, len(h) - 1)] == self.h[own])
        out[short] = equal.sum(1) >= need(self.lens[item])
        return out


def best_stretch(equal: np.ndarray):
    """(lo, hi) of the first stretch of greatest sum, +1 for equal and MISMATCH for different words."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    gain = total - np.minimum.accumulate(total)
    hi = int(np.argmax(gain))
    lo = int(np.argmin(total[:hi + 1]))
    return lo, hi


def _scan(index, batches):
    ix = index.value
    for ids, keys, bodies in chunks(batches, CHUNK):
        h, lens = _hashes(bodies)
        starts = starts_of(lens)
        seen: set = set()
        for pos, item, at in ix.hits(h):
            doc = np.searchsorted(starts, pos, "right") - 1
            diagonal = pos - starts[doc] - at
            good = ix.enough(h, starts, doc, item, diagonal)
            seen.update(zip(doc[good].tolist(), item[good].tolist(), diagonal[good].tolist()))
        best: dict = {}
        for d, i, diagonal in sorted(seen):
            a, b = ix.starts[i], ix.starts[i + 1]
            lo, hi = max(0, -diagonal), min(b - a, lens[d] - diagonal)
            if hi <= lo:
                continue
            at0 = starts[d] + diagonal
            equal = h[at0 + lo:at0 + hi] == ix.h[a + lo:a + hi]
            x, y = best_stretch(equal)
            if b - a <= SHORT and equal[x:y].sum() < need(b - a):
                same = np.flatnonzero(equal)
                x, y = (int(same[0]), int(same[-1]) + 1) if len(same) else (0, 0)
            n = int(equal[x:y].sum())
            if n >= need(b - a) and 5 * n >= 4 * (y - x):
                row = (-n, int(diagonal + lo + x), int(lo + x), int(y - x))
                best[d, i] = min(best.get((d, i), row), row)
        rows = [(int(ids[d]), int(keys[d]), ix.ids[i], r[1], r[2], r[3], -r[0]) for (d, i), r in sorted(best.items())]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)],
                                  names=["id", "key", "item_id", "doc_start", "item_start", "n_words", "n_equal"])


def _blocks(benchmark: DataFrame):
    ids, bodies, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        body = r["t"].encode()
        n = len(body.split())
        if ids and size + n > BLOCK_WORDS:
            yield ids, bodies
            ids, bodies, size = [], [], 0
        ids.append(r["i"])
        bodies.append(body)
        size += n
    if ids:
        yield ids, bodies


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns of ``FOUND`` (id: see ``common.doc_rows``); module docstring."""
    spark, rows = docs.sparkSession, doc_rows(docs)
    found = spark.createDataFrame([], FOUND)
    for ids, bodies in _blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(ids, bodies))
        found = found.union(rows.mapInArrow(partial(_scan, index), FOUND))
    return found


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (id, key) is not in ``found``; all columns of ``docs``."""
    names = free_names(docs, "_id", "_key")
    return docs.join(found.select(F.col("id").alias(names[0]), F.col("key").alias(names[1])).distinct(), same_row(docs, *names), "left_anti")


def row_id(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID))


def row_key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def same_row(docs: DataFrame, id_name: str, key_name: str):
    """Whether columns of another table (names that ``docs`` has not) name the row."""
    return (row_id(docs) == F.col(id_name)) & (row_key(docs) == F.col(key_name))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return without(docs, overlaps(docs, benchmark))
