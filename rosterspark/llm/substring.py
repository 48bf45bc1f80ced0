"""Substring dedup (operator 2): word sequences of 20 words that occurred earlier, by recompression.

Method.  Each round names runs (a word or symbol repeated k times becomes one
symbol) and then pairs (neighbours merge if the hash of the left one is even
and that of the right one odd).  A name is a hash of what it stands for, so all
tasks give equal pieces equal names, and whether two symbols merge depends on
these two alone.  Inside two equal word sequences the symbols therefore agree,
but for a few at either end; ``Parse`` works out for every window which
symbols are certain to agree.  The window's anchor is the least certain symbol
together with the neighbouring words that every such window holds.  Spark
counts the anchors over all documents; windows at shared anchors are verified
over their full 20 words (see ``repeats``).  Windows without a certain symbol
(long runs) use their own name as anchor.

``repeated_words`` is the general interface: for each row the word ranges that
occurred earlier; ``drop_repeats`` also returns the words kept.

Defined cases: a null text has no words.  Texts shorter than the window keep
all words.  Order is by (doc_id, hash of the text, start); a null doc_id sorts
first.  Repeated rows (same doc_id, same text) are one document, each row gets
the result.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rosterspark.llm.common import doc_rows, mix, names, starts_of, unzip, word_hashes
from rosterspark.llm.repeats import apply_runs, covered_runs, union_length
from rosterspark.llm.suffix import _nulls

WINDOW = 20
ROUNDS = 2
MOST = np.uint64(2**64 - 1)


def _runs(name, start, doc):
    """Runs of equal neighbours as one symbol."""
    cut = np.ones(len(name), bool)
    cut[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.concatenate([first, [len(name)]]))
    return np.where(count > 1, mix(name[first], count.astype(np.uint64)), name[first]), start[first], doc[first]


def _pairs(name, start, doc, salt):
    """Neighbours (even, odd) merged; even and odd by a bit of the name's hash."""
    odd = (mix(name, np.full(len(name), salt, np.uint64)) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(name), bool)  # the symbol merges with its left neighbour
    joined[1:] = ~odd[:-1] & odd[1:] & (doc[1:] == doc[:-1])
    keep = np.flatnonzero(~joined)
    left = np.zeros(len(name), bool)
    left[:-1] = joined[1:]
    out = name[keep].copy()
    two = keep[left[keep]]
    out[left[keep]] = mix(name[two], name[two + 1])
    return out, start[keep], doc[keep]


def _range(values, lo, hi, op):
    """op over values[lo:hi] for ranges that are not empty, from tables of 1, 2, 4, ... values."""
    out = np.empty(len(lo), values.dtype)
    size = hi - lo
    step, table = 1, values
    top = int(size.max()) if len(size) else 0
    while step <= top:
        at = np.flatnonzero((size >= step) & (size < 2 * step))
        out[at] = op(table[lo[at]], table[hi[at] - step])
        if 2 * step <= top:
            table = op(table[:-step], table[step:])
        step *= 2
    return out


class WordParse:
    """Names and anchors of the windows of a chunk of texts."""

    def __init__(self, window, rounds, bodies):
        self.window = window
        h, lens = word_hashes(bodies, lower=False)
        self.starts = starts_of(lens)
        n = len(h)
        self.n = n - window + 1
        if self.n <= 0:
            self.at = np.zeros(0, np.int64)
            return
        side = 2 * rounds
        cut = {side: None, window: None}
        names(h, window, cut)
        sides, self.names = cut[side], cut[window]
        doc = np.repeat(np.arange(len(lens)), lens)
        at = np.arange(self.n)
        self.at = at = at[at + window <= self.starts[1:][doc[:self.n]]]  # windows inside one text
        name, start, of = h, np.arange(n), doc
        left, right = at.copy(), at + window
        for r in range(rounds):
            for step in ("runs", "pairs"):
                name, start, of = _runs(name, start, of) if step == "runs" else _pairs(name, start, of, r + 1)
                bounds = np.concatenate([start, [n]])
                after = np.full(n + 1, n, np.int64)
                after[bounds] = bounds
                after = np.minimum.accumulate(after[::-1])[::-1]  # first bound >= x
                before = np.zeros(n + 1, np.int64)
                before[bounds] = bounds
                before = np.maximum.accumulate(before)  # last bound <= x
                left = after[np.minimum(left + 1, n)]
                right = before[np.maximum(right - 1, 0)]
        index = np.zeros(n + 1, np.int64)
        index[bounds] = np.arange(len(bounds))
        i0, i1 = index[left], index[right]
        has = (right > left) & (i1 > i0)
        end = bounds[1:]
        core = np.full(len(name), MOST, np.uint64)
        ok = (start >= side) & (end + side <= n)
        core[ok] = np.minimum(mix(mix(sides[start[ok] - side], name[ok]), sides[end[ok]]), MOST - np.uint64(1))
        self.anchor = self.names[at].copy()
        self.anchor[has] = _range(core, i0[has], i1[has], np.minimum)
        self.has, self.core, self.of, self.i0, self.i1 = has, core, of, i0[has], i1[has]

    def anchors(self):
        """(document, name) of each symbol that is some window's anchor, and of the windows that are their own."""
        if len(self.at) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        own = self.at[~self.has]
        doc = np.searchsorted(self.starts, own, "right") - 1
        if len(self.i0) == 0:
            return doc, self.names[own]
        symbol = np.arange(int(self.i0[0]), int(self.i1[-1]))
        first = np.searchsorted(self.i1, symbol, "right")
        last = np.searchsorted(self.i0, symbol, "right")
        inside = last > first
        symbol, first, last = symbol[inside], first[inside], last[inside]
        used = _range(self.anchor[self.has], first, last, np.maximum) == self.core[symbol]
        symbol = symbol[used]
        return np.concatenate([self.of[symbol], doc]), np.concatenate([self.core[symbol], self.names[own]])

    def windows(self, wanted):
        """(document, start, anchor, name) of the windows with an anchor among ``wanted`` (sorted)."""
        if len(self.at) == 0 or len(wanted) == 0:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.uint64), z.astype(np.uint64)
        found = wanted[np.minimum(np.searchsorted(wanted, self.anchor), len(wanted) - 1)] == self.anchor
        at = self.at[found]
        doc = np.searchsorted(self.starts, at, "right") - 1
        return doc, at - self.starts[doc], self.anchor[found], self.names[at]


def _dropped(window, batches):
    for batch in batches:
        out = []
        for body, v in zip(batch.column(2).to_pylist(), batch.column(3)):
            words = unzip(body).split()
            n = len(words)
            lo, hi = union_length(v.values.to_numpy() if v.is_valid else None, window)
            at, kept = 0, []
            for a, b in zip(lo.tolist(), hi.tolist()):
                kept += words[at:a]
                at = b
            kept += words[at:]
            rest = b" ".join(kept)
            spans = [{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi)]
            out.append((n, n - len(kept), hashlib.sha256(rest).hexdigest(), rest, spans))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.record_batch([_nulls(batch.column(0)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                               pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()),
                               pa.array(cols[4], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                              names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])


def drop_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, spans): every row without the words of earlier windows."""
    rows = doc_rows(docs)
    runs = covered_runs(rows, partial(WordParse, window, rounds), keep_first=True)
    return apply_runs(rows, runs, partial(_dropped, window),
                      "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, "
                      "spans array<struct<lo: long, hi: long>>")
