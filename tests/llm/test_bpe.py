"""Byte-level BPE against the tiktoken library, and its defined cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rosterspark.llm import bpe
from rosterspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", "a", "b", " ", "  ", "\n", "\t", "1", "23", "!", "?", "é", "ß", "日", "本", "٣", "'s", "'re", "’",
         "😀", "\x1c", "\x85", "\x00", "<|endoftext|>", "'LL", "0x", "\U000105c0", "thing", "ation"]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.vocabulary(bpe.default_vocabulary()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text, library):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def per_text(texts):
    ids, counts = bpe.encode_texts(texts, bpe.vocabulary(bpe.default_vocabulary()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("window", [bpe.WINDOW, 50])
def test_ids_equal_the_library(library, window, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", window)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 40))) for _ in range(3000)]
    texts += ["".join(texts[:300]), "a" * 500, " " * 333 + "x", "ab" * 400 + "'s" + " " * 100, "!" * 1000, ""]
    assert per_text(texts) == [library.encode_ordinary(t) for t in texts]


def test_ids_when_the_cache_is_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 64)
    bpe.vocabulary.cache_clear()
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(30)) for _ in range(400)]
    for k in range(0, 400, 50):
        assert per_text(texts[k:k + 50]) == [library.encode_ordinary(t) for t in texts[k:k + 50]]
    bpe.vocabulary.cache_clear()


def test_classes_of_all_code_points_equal_the_library():
    single = {bytes([i]): i for i in range(256)}
    every = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    classes = bpe._classes()
    for kind, pattern in ((bpe.LETTER, r"\p{L}"), (bpe.NUMBER, r"\p{N}"), (bpe.SPACE, r"\s")):
        cut = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(cut.encode_ordinary("".join(map(chr, every)))).decode()
        assert [c for c in every if classes[c] == kind] == sorted(set(map(ord, found)))


def test_query_equals_the_library(spark, library):
    want = sorted((r.doc_id, *expected(r.text, library)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op13_byte_bpe"](spark, SF).collect())) == want


def test_defined_cases(spark, library):
    rows = [(1, None), (2, ""), (3, " \n\t "), (3, " \n\t "), (None, "no id's here"), (4, "word " * 30000), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("ids", "offsets", "body", "id", "n_tokens"):
        docs = docs.withColumn(c, F.lit("x"))
    got = [tuple(r) for r in bpe.digests(bpe.encode(docs)).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(((i, *expected(t, library)) for i, t in rows), key=key)
    assert bpe.digests(bpe.encode(docs.limit(0))).collect() == []


def test_decode_and_spans(spark):
    text = "Ça va 日本's   2024!? \n end"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert bytes(bpe.decode(row).collect()[0].body).decode() == text
    r, vocab = row.collect()[0], bpe.vocabulary(bpe.default_vocabulary())
    for a in range(0, len(r.ids), 3):
        part = bpe.decode_ids(np.array(r.ids[a:a + 3]), np.array(r.offsets[a:a + 3]), vocab)
        assert text.encode()[r.offsets[a]:].startswith(part)
