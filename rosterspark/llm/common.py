"""Shared pieces: document rows, chunked Arrow input, word hashing, packed blocks.

The Python operators follow one pattern.  Map tasks read documents in Arrow
batches, cut them into chunks of bounded size, do the per-position work with
numpy and emit *blocks*: one row per (chunk, bucket) that holds the packed
arrays of all records whose key falls into the bucket.  Spark shuffles the
blocks by bucket and one task at a time works through one bucket.  A chunk
sends a key at most once (duplicates inside a chunk are combined before the
shuffle), so even a key that every document has reaches its bucket at most
once per chunk.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.session import ship_package

NULL_ID = -(2**63)  # stands for a null doc_id inside the operators (sorts first)

K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_rows(docs: DataFrame) -> DataFrame:
    """(id, key, body): doc_id with null as ``NULL_ID``, a hash of the text, the text as UTF-8 bytes (null: empty).

    Only doc_id and text are taken, so further columns never clash.  ``key``
    tells rows with the same doc_id and different texts apart; rows equal in
    both are one document.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.xxhash64(text).alias("key"), text.cast("binary").alias("body"))


def public_id(col="id"):
    """The doc_id of an internal id (``NULL_ID`` back to null)."""
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias("doc_id")


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a block shuffle: the session's shuffle partitions, sized by the user to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(batches, limit: int):
    """(ids, keys, bodies) of consecutive rows with about ``limit`` bytes of text (a longer text is a chunk by itself)."""
    ids, keys, bodies, size = [], [], [], 0
    for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):  # few texts twice in memory
        for i, k, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
            if bodies and size + len(b) > limit:
                full, ids, keys, bodies, size = (np.array(ids, np.int64), np.array(keys, np.int64), bodies), [], [], [], 0
                yield full
                del full
            ids.append(i)
            keys.append(k)
            bodies.append(b)
            size += len(b)
    if bodies:
        yield np.array(ids, np.int64), np.array(keys, np.int64), bodies


def mix(a, b):
    """64-bit name of the pair (a, b) of names; vectorised."""
    x = a * K1
    x += (b ^ (b >> np.uint64(31))) * K2
    x ^= x >> np.uint64(32)
    x *= K3
    x ^= x >> np.uint64(29)
    return x


def pair(a, b):
    """As ``mix``, quicker, for inputs that are names already."""
    x = a * K1
    x += b * K2
    x ^= x >> np.uint64(32)
    return x


def names(level1: np.ndarray, length: int, cut: dict | None = None) -> np.ndarray:
    """Names of all substrings of ``length`` by prefix doubling: name(2h, i) = pair(name(h, i), name(h, i+h)).

    ``cut`` may list further lengths; it is filled with their names.
    """
    out, h, cur = level1, 1, level1
    for want in sorted({length, *(cut or ())}):
        while 2 * h <= want and len(cur) > h:
            cur = pair(cur[:-h], cur[h:])
            h *= 2
        n = max(0, len(level1) - want + 1)
        if n == 0:
            out = np.zeros(0, np.uint64)
        elif want == h:
            out = cur
        else:
            out = pair(cur[:n], cur[want - h:want - h + n])
        if cut is not None and want in cut:
            cut[want] = out
    return out


def word_hashes(bodies, lower: bool):
    """Hashes of all words (split at ASCII white space) of the texts in a row, and the word count of each text.

    The words of one text at a time are held.
    """
    parts = [np.zeros(0, np.uint64)]
    for b in bodies:
        words = (b.lower() if lower else b).split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(parts), np.array([len(p) for p in parts[1:]], np.int64)


def starts_of(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h, h) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


_ZC, _ZD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays) -> bytes:
    """Arrays as one compressed byte string (bytes of equal significance together)."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return _ZC.compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = _ZD.decompress(data)
    out, at, metas = [], 1, []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<4sQ", raw, at)
        metas.append((np.dtype(kind.strip().decode()), n))
        at += 12
    for dtype, n in metas:
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lens[0] of them), then the same for the next."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lens - starts, lens)


def split_by(bucket: np.ndarray, n: int):
    """For each bucket that occurs, its number and the positions of its members (in order)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b]:edges[b + 1]]


def block_batch(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                           names=["bucket", "block"])


BLOCK = "bucket int, block binary"


def list_array(values: np.ndarray, lens: np.ndarray, kind) -> pa.Array:
    """A list column from the values in a row and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(starts_of(lens), pa.int32()), pa.array(values, kind))


def zipped(rows: DataFrame) -> DataFrame:
    """doc_rows with compressed bodies, for shuffles that must carry whole texts."""
    def run(batches):
        for batch in batches:
            packed = [zip_body(b) for b in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "key", "body"])
    return rows.mapInArrow(run, "id long, key long, body binary")


def zip_body(body: bytes) -> bytes:
    return _ZC.compress(body)


def unzip(body: bytes) -> bytes:
    return _ZD.decompress(body)


def per_bucket(blocks: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the blocks of each bucket (a table of rows bucket, block)."""
    def run(table: pa.Table) -> pa.Table:
        return fn(table)
    return blocks.groupBy("bucket").applyInArrow(run, schema)
