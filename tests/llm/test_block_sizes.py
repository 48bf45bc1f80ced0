"""Rows and memory of packed blocks."""

import numpy as np
import pyarrow as pa

from rosterspark.llm import jaccard, katz
from rosterspark.llm.common import mix, pack, small, unpack, word_hashes


def test_a_context_bucket_sends_one_row_per_chunk():
    one, few = np.array([7], np.uint64), np.array([1])
    block = pack(one, np.array([0.25]), *(small(few) for _ in range(katz.DEPTH + 1)), one, small(few - 1), np.array([5], np.int64), small(few - 1), small(few))
    out = katz._context_bucket(np.full(katz.DEPTH + 1, 0.5), pa.table({"block": pa.array([block] * 40, pa.binary())}))
    assert out.num_rows == 1 and out["chunk"].to_pylist() == [5]
    single = katz._context_bucket(np.full(katz.DEPTH + 1, 0.5), pa.table({"block": pa.array([block], pa.binary())}))
    doc, total = unpack(out["block"].to_pylist()[0])
    assert doc.tolist() == [1] and np.isfinite(total).all() and single.num_rows == 1


def test_sketches_of_many_sets_equal_those_of_each():
    rng = np.random.default_rng(2)
    sizes = np.append(rng.integers(0, 50, 600), 0)
    elems = rng.integers(0, 2**63, int(sizes.sum())).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, words in enumerate(jaccard._sketches(elems, sizes).reshape(len(sizes), jaccard.SKETCH)):
        e = elems[at[i]:at[i + 1]]
        odd = np.bincount((mix(e, e) >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
        assert (np.packbits(odd.astype(np.uint8)).view(np.int64) == words).all()


def test_words_are_hashed_text_by_text():
    h, lens = word_hashes([b"a B", b"", b"b"], lower=True)
    assert lens.tolist() == [2, 0, 1] and h[1] == h[2] and len(word_hashes([], lower=True)[0]) == 0
