"""Suffix-array dedup (operator 5): every byte string of 400 bytes that occurs more than once, by prefix doubling.

Method.  Positions are ranked by name pairs at growing offsets: the name of
the h bytes at i is the pair (name of i, name of i + h/2), for h = 16, 32, ...,
128, then 200 and 400.  Two Spark rounds sort and rerank the surviving
positions.  At offset 200 only *sampled* positions take part (the least name
among the 201 positions inside a 400-byte window: a choice that equal windows
make alike); a position whose rank is unique drops out with all its windows.
At offset 400 the windows at the remaining positions are ranked and those that
share a rank are the repeats.  Names are hashes of their pairs instead of dense
ranks, so that naming needs no global numbering.

``repeated_spans`` is the general interface: rows (doc_id, key, spans), spans
being maximal byte ranges [lo, hi) covered by strings of ``window`` bytes that
start anywhere else too.  ``strip_repeats`` returns the remaining bytes as well.

Nulls and empty texts: a null text is empty, has no spans.  A null doc_id is
kept as null.  Repeated rows (same doc_id, same text) are one document: they
do not make each other repeats, and each row gets the result.  Rows with the
same doc_id and different texts are different documents.  An empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rosterspark.llm.common import NULL_ID, doc_rows, pair, starts_of, unzip
from rosterspark.llm.repeats import apply_runs, covered_runs, union_length

WINDOW = 400
BLOCK_POSITIONS = 1 << 15  # positions named at a time, so that the arrays stay in the processor's cache


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values, by doubling."""
    h = 1
    while 2 * h <= width:
        a = op(a[:-h], a[h:])
        h *= 2
    return op(a[:len(a) - (width - h)], a[width - h:]) if h < width else a


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one number: the rank at offset 8 without any sort."""
    out = np.empty(len(buf) - 7, np.uint64)
    for k in range(min(8, len(out))):
        n = len(out[k::8])
        out[k::8] = np.frombuffer(buf[k:k + 8 * n].tobytes(), "<u8")
    return out


def piece_names(buf: np.ndarray, piece: int) -> np.ndarray:
    """Names of the ``piece`` bytes at every position, from the rank at offset 8 doubled to 16, 32, ..."""
    h, cur = 8, eights(buf)
    while 2 * h <= piece:
        cur = pair(cur[:-h], cur[h:])
        h *= 2
    rest = piece - h
    return pair(cur[:len(cur) - rest], cur[rest:]) if rest else pair(cur, cur)


def blockwise(a: np.ndarray, width: int, op) -> np.ndarray:
    out = np.empty(len(a) - width + 1, a.dtype)
    for at in range(0, len(out), BLOCK_POSITIONS):
        part = slide(a[at:at + BLOCK_POSITIONS + width - 1], width, op)
        out[at:at + len(part)] = part
    return out


class ByteParse:
    """Names of the windows of a chunk; anchor: the least name of ``window / 2`` bytes inside the window."""

    def __init__(self, window, bodies):
        if window < 16 or window % 2:
            raise ValueError("the window must be an even number of bytes, 16 or more")
        self.window, self.piece = window, window // 2
        self.starts = starts_of(np.array([len(b) for b in bodies]))
        buf = np.frombuffer(b"".join(bodies), np.uint8)
        self.n = len(buf) - window + 1
        if self.n <= 0:
            return
        self.pieces = np.empty(len(buf) - self.piece + 1, np.uint64)
        for at in range(0, len(self.pieces), BLOCK_POSITIONS):
            part = piece_names(buf[at:at + BLOCK_POSITIONS + self.piece - 1], self.piece)
            self.pieces[at:at + len(part)] = part
        self.least = blockwise(self.pieces, window - self.piece + 1, np.minimum)
        end = np.repeat(self.starts[1:], np.diff(self.starts))[:self.n]
        self.valid = np.arange(self.n) + window <= end

    def doc_of(self, at):
        return np.searchsorted(self.starts, at, "right") - 1

    def anchors(self):
        """(document, name) of each sampled position."""
        if self.n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        span = self.window - self.piece
        least = np.zeros(self.n + 2 * span, np.uint64)
        least[span:span + self.n] = np.where(self.valid, self.least, np.uint64(0))
        most = blockwise(least, span + 1, np.maximum)
        at = np.flatnonzero((most == self.pieces) & (most > 0))
        return self.doc_of(at), self.pieces[at]

    def windows(self, wanted):
        """(document, start, anchor, name) of the windows with an anchor among ``wanted`` (sorted)."""
        if self.n <= 0 or len(wanted) == 0:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.uint64), z.astype(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], self.least[1:] != self.least[:-1]]))
        value = self.least[cut]
        found = wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value
        at = np.flatnonzero(np.repeat(found, np.diff(np.concatenate([cut, [self.n]]))) & self.valid)
        doc = self.doc_of(at)
        return doc, at - self.starts[doc], self.least[at], pair(self.pieces[at], self.pieces[at + self.piece])


def _spans(window, batches):
    for batch in batches:
        spans = [union_length(v.values.to_numpy() if v.is_valid else None, window) for v in batch.column(3)]
        flat = [[{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi)] for lo, hi in spans]
        yield pa.record_batch([_nulls(batch.column(0)), batch.column(1),
                               pa.array(flat, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                              names=["doc_id", "key", "spans"])


def _nulls(ids):
    return pa.array([None if i == NULL_ID else i for i in ids.to_pylist()], pa.int64())


def _stripped(window, batches):
    for batch in batches:
        out = []
        for body, v in zip(batch.column(2).to_pylist(), batch.column(3)):
            body = unzip(body)
            lo, hi = union_length(v.values.to_numpy() if v.is_valid else None, window)
            at, kept = 0, []
            for a, b in zip(lo.tolist(), hi.tolist()):
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            rest = b"".join(kept)
            out.append((len(body), len(body) - len(rest), len(lo), hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.record_batch([_nulls(batch.column(0)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                               pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _runs(docs: DataFrame, window: int):
    rows = doc_rows(docs)
    return rows, covered_runs(rows, partial(ByteParse, window), keep_first=False)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, spans) for every row of ``docs``: maximal repeated byte ranges (module docstring)."""
    rows, runs = _runs(docs, window)
    return apply_runs(rows, runs, partial(_spans, window), "doc_id long, key long, spans array<struct<lo: long, hi: long>>")


def strip_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every row without its repeated bytes."""
    rows, runs = _runs(docs, window)
    return apply_runs(rows, runs, partial(_stripped, window),
                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
