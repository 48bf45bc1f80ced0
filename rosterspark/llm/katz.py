"""Language-model scoring (operator 3): a Katz backoff bigram model, counted and evaluated in Spark.

P(w | h) = d(r) r / c(h) where the pair (h, w) was seen r > 0 times in training,
else alpha(h) P(w); d are Good-Turing discounts for r up to 5 (larger counts
lose ``KEEP`` so that every context keeps some mass) and alpha(h) makes the
probabilities after h sum to exactly one:
alpha(h) = (1 - sum of d(r) r / c(h)) / (1 - sum of P(w) over the w seen after h).
P(w) backs off in the same way: discounted relative counts, and the mass left
goes to the one unknown word.  h is the word before, or the start of the text;
the end of the text is a token.

Rounds.  (0) word counts by word: N, V, count of counts, and the few words
(at most 4 per bucket) that are too frequent for one bucket.  (1) pairs by
their second word (a frequent one is dealt by its first word as well): each
bucket is a partition of the n-gram table; it adds up the pairs and sends each
document its sums, each context its share of the backoff weight, and the pairs
not seen in training to their contexts.  (2) contexts by word: backoff weights
for the unseen pairs.  (3) sums per document.  A document's part of a bucket
travels as packed arrays, one row per chunk and bucket.

Words are known by 64-bit hashes.  Defined cases: a null or empty text has the
end token only.  A null doc_id counts as the text '' (its remainder is 0: held
out).  Repeated rows each count.  With no training rows V = N = 0 and every
probability is that of the unknown word, 1.  An empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import (
    BLOCK, NULL_ID, block_batch, bucket_count, bucket_of, chunks, doc_rows, mix, pack, per_bucket, small, split_by,
    starts_of, unpack, word_hashes,
)
from rosterspark.session import materialize

START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" start", b" end"))  # no word has a blank
DEPTH = 5     # Good-Turing discounts for counts up to this
KEEP = 0.05   # what larger counts lose
CHUNK = 6_000_000


def held_out(ids, folds=10):
    text = [b"" if i == NULL_ID else str(i).encode() for i in ids.tolist()]
    return np.array([zlib.crc32(t) % folds == 0 for t in text], bool)


def _tokens(bodies):
    """(token, context, document, tokens of each document): words and the end of each text, after the word before."""
    h, lens = word_hashes(bodies, lower=True)
    starts = starts_of(lens)
    at = starts[:-1] + np.arange(len(lens))  # where each text begins with one more token a text
    token = np.full(len(h) + len(lens), END, np.uint64)
    word = np.ones(len(token), bool)
    word[starts[1:] + np.arange(len(lens))] = False
    token[word] = h
    context = np.concatenate([[START], token[:-1]])
    context[at] = START
    return token, context, np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1), lens + 1


def _vocabulary_blocks(n, batches):
    for ids, _, bodies in chunks(batches, CHUNK):
        token, _, doc, _ = _tokens(bodies)
        token = token[~held_out(ids)[doc]]
        word, count = np.unique(token, return_counts=True)
        if len(word):
            yield block_batch([(b, pack(word[at], small(count[at]))) for b, at in split_by(bucket_of(word, n), n)])


def _vocabulary(n, table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("block").to_pylist()]
    word = np.concatenate([p[0] for p in parts])
    word, at = np.unique(word, return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(float)).astype(np.int64)
    top = np.argsort(-count)[:4 * n]
    return pa.table({"words": [len(word)], "tokens": [int(count.sum())], "ends": [int(count[word == END].sum())], "nr": [np.bincount(np.minimum(count, DEPTH + 2), minlength=DEPTH + 3).tolist()],
                     "block": [pack(word[top], count[top])]})


def discounts(nr) -> np.ndarray:
    """d(r) for r = 0..DEPTH from the counts of counts; (r - 1/2) / r where Good-Turing gives none between 0 and 1."""
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, DEPTH + 1)])
    if nr[1] > 0:
        cut = (DEPTH + 1) * nr[DEPTH + 1] / nr[1]
        for r in range(1, DEPTH + 1):
            if nr[r] > 0 and cut < 1:
                x = ((r + 1) * nr[r + 1] / (r * nr[r]) - cut) / (1 - cut)
                if 0 < x < 1:
                    d[r] = x
    return d


class Unigrams:
    """P(w) from the word's count; ``unknown`` is the mass left for the unknown word."""

    def __init__(self, tokens, nr):
        self.tokens, self.d = max(tokens, 1), discounts(nr)
        few = sum(nr[r] * r * (1 - self.d[r]) for r in range(1, DEPTH + 1))
        many = sum(nr[DEPTH + 1:])
        self.unknown = (few + KEEP * many) / self.tokens if tokens else 1.0

    def of(self, count):
        low = np.minimum(count, DEPTH).astype(np.int64)
        mass = np.where(count > DEPTH, count - KEEP, self.d[low] * count)
        return np.where(count > 0, mass / self.tokens, self.unknown)


def _pair_blocks(n, hot, batches):
    """Block: chunk number, documents (training or not), words with their pairs (context, document, how often)."""
    part, serial = TaskContext.get().partitionId(), 0
    for ids, keys, bodies in chunks(batches, CHUNK):
        token, context, doc, lens = _tokens(bodies)
        train = ~held_out(ids)
        chunk = np.array([(part << 32) + serial], np.int64)
        serial += 1
        del bodies  # what is used up is let go here as well
        bucket = bucket_of(token, n).astype(np.int32)
        if len(hot):
            frequent = hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token
            bucket[frequent] = bucket_of(mix(token[frequent], context[frequent]), n)
            del frequent
        rows = [(int(chunk[0] % n), pack(chunk, np.zeros(0, np.uint8), ids, train.astype(np.uint8), small(lens)))]
        for b, at in split_by(bucket, n):
            at = at[np.argsort(token[at], kind="stable")]
            word, count = np.unique(token[at], return_counts=True)
            left, where = np.unique(context[at], return_inverse=True)
            rows.append((b, pack(chunk, np.ones(1, np.uint8), word, small(count), left, small(where), small(doc[at]), train.astype(np.uint8))))
        yield block_batch(rows)


ROUND1 = "kind int, chunk long, bucket int, block binary"


def _pair_bucket(m, hot, hot_count, tokens, nr, table: pa.Table) -> pa.Table:
    """Kinds: 0 documents of a chunk, 1 sums of a chunk's documents, 2 context shares and unseen pairs, 3 counts of counts."""
    out, parts = [], []
    for data in table.column("block").to_pylist():
        p = unpack(data)
        if len(p[1]) == 0:
            out.append((0, int(p[0][0]), 0, data))
        else:
            parts.append(p)
    if parts:
        # positions are 32-bit numbers within a bucket, and what is used up is let go: a task holds some 40 bytes a token
        words, at = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        lefts, left_at = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
        at, left_at = at.astype(np.int32), left_at.astype(np.int32)
        narrow = np.int32 if sum(len(p[7]) for p in parts) < 2**31 else np.int64
        word, left, doc, train, base, w0, l0 = [], [], [], [], 0, 0, 0
        bases = []
        for p in parts:
            word.append(np.repeat(at[w0:w0 + len(p[2])], p[3].astype(np.int64)))
            left.append(left_at[l0:l0 + len(p[4])][p[5]])
            train.append(p[7].astype(bool)[p[6]])
            doc.append(p[6].astype(narrow) + narrow(base))
            bases.append(base)
            w0, l0, base = w0 + len(p[2]), l0 + len(p[4]), base + len(p[7])
            p[2:] = []  # all of it is in the arrays now
        bases.append(base)
        del at, left_at
        word, left, doc, train = (np.concatenate(x) for x in (word, left, doc, train))
        count = np.bincount(word[train], minlength=len(words))
        if len(hot):
            i = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            count = np.where(hot[i] == words, hot_count[i], count)
        code = word.astype(np.int64) * len(lefts) + left
        order = np.argsort(code).astype(np.int32)
        code = code[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        del code
        first = np.flatnonzero(new)
        seen = np.add.reduceat(train[order].astype(np.int32), first).astype(np.int64)
        pair = np.empty(len(order), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - 1
        r = seen.astype(np.int32)[pair]
        uni = Unigrams(tokens, nr)
        p_word = uni.of(count)
        # sums of each document
        base_sum = np.bincount(doc, weights=np.log10(count + 0.1)[word], minlength=base)
        known = np.bincount(doc, weights=(count > 0)[word], minlength=base).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(seen > DEPTH, np.log10(seen - KEEP), np.where(seen > 0, 0.0, np.log10(p_word)[word[order[first]]]))
            as_context = np.where((count > 0) & (words != END), -np.log10(count), 0.0)
        score = np.bincount(doc, weights=own[pair], minlength=base)
        score += np.bincount(doc, weights=as_context[word], minlength=base)
        del pair
        low = [np.bincount(doc[r == k], minlength=base) for k in range(1, DEPTH + 1)]
        for p, a, b in zip(parts, bases[:-1], bases[1:]):
            out.append((1, int(p[0][0]), 0, pack(base_sum[a:b], score[a:b], small(known[a:b]), *(small(x[a:b]) for x in low))))
        # what each context gets from the pairs in training here
        f = first[seen > 0]
        g_left, g_word, g_r = left[order[f]], word[order[f]], seen[seen > 0]
        share = [np.bincount(g_left[g_r == k], minlength=len(lefts)) for k in range(1, DEPTH + 1)]
        share.append(np.bincount(g_left[g_r > DEPTH], minlength=len(lefts)))
        mass = np.bincount(g_left, weights=p_word[g_word], minlength=len(lefts))
        # pairs not seen in training
        u = np.flatnonzero(r == 0)
        chunk_of = np.searchsorted(np.array(bases[1:]), doc[u], "right")
        hot_left = np.zeros(len(lefts), bool)
        special = np.concatenate([hot, [START]])
        hot_left[np.isin(lefts, special)] = True
        home = bucket_of(lefts, m)
        have = mass > 0
        chunks_ = np.array([int(p[0][0]) for p in parts], np.int64)
        go = np.where(hot_left[left[u]], chunks_[chunk_of] % m, home[left[u]]) if len(u) else np.zeros(0, np.int64)
        by_home, by_go = dict(split_by(np.where(have & ~hot_left, home, m), m)), dict(split_by(go, m))
        all_hot = np.flatnonzero(have & hot_left)
        for b in range(m):
            h = np.concatenate([by_home.get(b, all_hot[:0]), all_hot])
            x = u[by_go[b]] if b in by_go else u[:0]
            if len(h) == 0 and len(x) == 0:
                continue
            left_used, where = np.unique(left[x], return_inverse=True)
            ch = chunk_of[by_go[b]] if b in by_go else u[:0]
            out.append((2, 0, b, pack(lefts[h], mass[h], *(small(s_[h]) for s_ in share), lefts[left_used], small(where), chunks_, small(ch),
                                      small(doc[x] - np.array(bases, np.int64)[ch]))))
        out.append((3, 0, 0, pack(np.bincount(np.minimum(seen, DEPTH + 2), minlength=DEPTH + 3))))
    cols = list(zip(*out)) or [[]] * 4
    return pa.table({"kind": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()),
                     "bucket": pa.array(cols[2], pa.int32()), "block": pa.array(cols[3], pa.binary())})


def _context_bucket(d, table: pa.Table) -> pa.Table:
    """Kind 4: for a chunk's documents, the sums of log10(alpha(h) c(h)) over their unseen pairs."""
    parts = [unpack(x) for x in table.column("block").to_pylist()]
    out = []
    lefts, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    add = lambda k: np.bincount(at, weights=np.concatenate([p[k] for p in parts]).astype(float), minlength=len(lefts))
    mass = add(1)
    free = sum(add(1 + r) * r * (1 - d[r]) for r in range(1, DEPTH + 1)) + KEEP * add(2 + DEPTH)
    with np.errstate(divide="ignore"):
        weight = np.log10(free) - np.log10(np.maximum(1 - mass, 1e-12))
    sums: dict = {}  # chunk: (documents, sums) from each pair bucket
    k = 3 + DEPTH
    for p in parts:
        if len(p[k + 1]) == 0:
            continue
        used = p[k]
        if len(lefts):
            i = np.minimum(np.searchsorted(lefts, used), len(lefts) - 1)
            w = np.where(lefts[i] == used, weight[i], 0.0)  # a context without training has no weight: P(w) stands alone
        else:
            w = np.zeros(len(used))
        w = w[p[k + 1].astype(np.int64)]
        for c in np.unique(p[k + 3]):
            m = p[k + 3] == c
            doc, where = np.unique(p[k + 4][m], return_inverse=True)
            sums.setdefault(int(p[k + 2][c]), []).append((doc, np.bincount(where, weights=w[m])))
    for chunk, found in sums.items():  # one row per chunk, however many pair buckets sent unseen pairs
        doc, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        out.append((4, chunk, 0, pack(small(doc), np.bincount(where, weights=np.concatenate([y for _, y in found])))))
    cols = list(zip(*out)) or [[]] * 4
    return pa.table({"kind": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()),
                     "bucket": pa.array(cols[2], pa.int32()), "block": pa.array(cols[3], pa.binary())})


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _documents(d, tokens, words, starts, table: pa.Table) -> pa.Table:
    kinds, blocks = table.column("kind").to_pylist(), [unpack(x) for x in table.column("block").to_pylist()]
    _, _, ids, train, lens = next(b for k, b in zip(kinds, blocks) if k == 0)
    n = len(ids)
    base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for k, b in zip(kinds, blocks):
        if k == 1:
            base += b[0]
            score += b[1] + sum(np.log10(d[r] * r) * b[2 + r] for r in range(1, DEPTH + 1))
            known += b[2]
        elif k == 4:
            score[b[0].astype(np.int64)] += b[1]
    lens = lens.astype(np.int64)
    if starts:
        score -= np.log10(starts)
    base -= lens * np.log10(tokens + 0.1 * (words + 1))
    return pa.table({"doc_id": pa.array([None if i == NULL_ID else i for i in ids.tolist()], pa.int64()),
                     "held_out": pa.array(train == 0), "n_tokens": pa.array(lens), "n_known": pa.array(known),
                     "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})


def score_documents(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` scored by the model learnt from the training rows of ``docs`` (module docstring); columns ``RESULT``."""
    n = bucket_count(docs.sparkSession)  # of pairs: a task holds one bucket
    m = (n + 2) // 3  # of contexts, which are fewer: every pair bucket sends a row to each, and each a row to every chunk
    rows = doc_rows(docs)
    found = per_bucket(rows.mapInArrow(partial(_vocabulary_blocks, n), BLOCK), partial(_vocabulary, n),
                       "words long, tokens long, ends long, nr array<long>, block binary").collect()  # one row per bucket
    words, tokens = sum(r["words"] for r in found), sum(r["tokens"] for r in found)
    nr = np.sum([r["nr"] for r in found], axis=0).tolist() if found else [0] * (DEPTH + 3)
    hot = {}
    for r in found:
        hot.update(zip(*(x.tolist() for x in unpack(r["block"]))))
    starts = sum(r["ends"] for r in found)
    hot = {w: c for w, c in hot.items() if 4 * n * c > tokens}  # fewer than 4 n words
    hot_words = np.array(sorted(hot), np.uint64)
    hot_count = np.array([hot[int(w)] for w in hot_words], np.int64)
    pairs = per_bucket(rows.mapInArrow(partial(_pair_blocks, n, hot_words), BLOCK),
                       partial(_pair_bucket, m, hot_words, hot_count, tokens, nr), ROUND1)
    pairs = materialize(pairs, "pairs")
    counts = [unpack(r["block"])[0] for r in pairs.filter("kind = 3").select("block").collect()]  # one row per bucket
    d = discounts(np.sum(counts, axis=0).tolist() if counts else [0] * (DEPTH + 3))
    back = per_bucket(pairs.filter("kind = 2").select("bucket", "block"), partial(_context_bucket, d), ROUND1)
    both = pairs.filter("kind < 2").union(back).select("chunk", "kind", "block")

    def run(table: pa.Table) -> pa.Table:
        return _documents(d, tokens, words, starts, table)
    return both.groupBy("chunk").applyInArrow(run, RESULT)
