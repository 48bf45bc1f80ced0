"""Quality classifier (operator 9): which of two zstandard dictionaries compresses a text better.

Two dictionaries are built from texts labelled good and bad.  Every text is
compressed, block by block of ``BLOCK`` bytes, with each of them; the features
are the difference of the two sizes and the size itself, both per byte.  A
logistic calibration on other labelled texts turns them into a score.

Only labels of training rows (crc32(doc_id) mod 5 is not 0) are read.  The fit
uses a bounded sample: at most ``SAMPLE`` doc_ids a class, chosen by hash, three
quarters for the dictionaries and one quarter for calibration (all of them for
both where a class would be missing).  The dictionaries are built on the driver
from at most ``SAMPLE_BLOCKS`` blocks a class, chosen by hash from anywhere in
the whole texts; calibration compresses whole texts in Spark's tasks.  Scoring
reads whole texts, straight from the Arrow buffers.

Defined cases: a null or empty text has features 0 and is scored like any
other.  A null doc_id is held out.  Repeated rows are scored each; if a doc_id
has several labels the greatest counts.  Without labels of both classes every
score is the share of label 1 (0.5 without labels).  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import NULL_ID, doc_rows
from rosterspark.llm.katz import held_out
from rosterspark.session import materialize

SAMPLE = 3000
SAMPLE_BLOCKS = 16000
DICTIONARY = 65536
BLOCK = 1024
FOLDS = 5
CUT = 0.3
SCORES = "doc_id long, held_out boolean, score double, predicted int"
_READY: dict = {}


def _dictionary(blocks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(blocks)[:DICTIONARY]


def _compressor(data: bytes):
    if data not in _READY:
        _READY[data] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data) if data else None,
                                                write_content_size=False, write_checksum=False, write_dict_id=False)
    return _READY[data]


def _sizes(good: bytes, bad: bytes, bodies) -> np.ndarray:
    """Per text of an Arrow column: the difference of the sizes with the two dictionaries and that with the good one, per byte."""
    good, bad = _compressor(good), _compressor(bad)
    out = np.zeros((len(bodies), 2))
    for i, body in enumerate(bodies):
        b = memoryview(body.as_buffer())
        if b:
            parts = [b[k:k + BLOCK] for k in range(0, len(b), BLOCK)]
            g = sum(len(good.compress(p)) for p in parts)
            out[i] = (sum(len(bad.compress(p)) for p in parts) - g) / len(b), g / len(b)
    return out


def features(sizes: np.ndarray) -> np.ndarray:
    """Per text: (1, size difference, size with the good dictionary, and their products)."""
    d, s = sizes.T
    return np.stack([np.ones(len(d)), d, s, d * d, s * s, d * s], 1)


def _logistic(x, y, ridge=1e-2, steps=50):
    """Weights of a logistic regression by Newton's method; columns scaled to unit spread."""
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[0] = 0, 1
    spread[spread == 0] = 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _measure(dictionaries, batches):
    good, bad = dictionaries.value
    for batch in batches:
        d, s = _sizes(good, bad, batch.column("body")).T
        yield pa.record_batch([batch.column("quality"), pa.array(d), pa.array(s)], names=["quality", "d", "s"])


def _blocks(rows: DataFrame, quality: int) -> list[bytes]:
    """``SAMPLE_BLOCKS`` blocks at most of the texts of a class, chosen by hash."""
    starts = F.sequence(F.lit(0), F.length("body") - 1, F.lit(BLOCK))
    blocks = (rows.filter((F.col("quality") == quality) & (F.length("body") > 0)).select("id", "key", "body", F.explode(starts).alias("at"))
              .select("id", "key", "at", F.substring("body", F.col("at") + 1, F.lit(BLOCK)).alias("block")))
    got = blocks.orderBy(F.xxhash64("id", "key", "at"), "id", "key", "at").limit(SAMPLE_BLOCKS).select("block")
    return [bytes(r["block"]) for r in got.collect()]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from a bounded sample of the labelled training rows."""
    lab = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("long").alias("quality"))
    lab = lab.filter(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != 0)
    share = lab.agg(F.avg("quality")).first()[0]
    model = {"good": b"", "bad": b"", "share": 0.5 if share is None else float(share), "w": None}
    ids = [lab.filter(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for q in (0, 1)]
    rows = materialize(doc_rows(docs).join(F.broadcast(ids[0].union(ids[1])), "id").dropDuplicates(["id", "key"]), "labelled")
    other = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(4)) == 0
    fitted, calibrating = rows.filter(~other), rows.filter(other)
    blocks = [_blocks(fitted, q) for q in (0, 1)]
    if not all(blocks) or calibrating.filter(F.length("body") > 0).select("quality").distinct().count() < 2:
        fitted = calibrating = rows
        blocks = [_blocks(rows, q) for q in (0, 1)]
    if not all(blocks):
        return model
    model["good"], model["bad"] = _dictionary(blocks[1]), _dictionary(blocks[0])
    pair = docs.sparkSession.sparkContext.broadcast((model["good"], model["bad"]))
    sizes = calibrating.select("quality", "body").mapInArrow(partial(_measure, pair), "quality long, d double, s double").orderBy("quality", "d", "s").collect()
    y = np.array([r["quality"] for r in sizes], float)
    mean, spread, w = _logistic(features(np.array([(r["d"], r["s"]) for r in sizes])), y)
    # classes were sampled evenly: put back the odds of the labelled rows
    odds = np.log(max(model["share"], 1e-3) / max(1 - model["share"], 1e-3)) - np.log(y.sum() / (1 - y).sum())
    w[0] += odds
    return model | {"mean": mean, "spread": spread, "w": w}


def _score(model, batches):
    m = model.value
    for batch in batches:
        ids = batch.column("id")
        if m["w"] is None:
            score = np.full(len(ids), m["share"])
        else:
            z = (features(_sizes(m["good"], m["bad"], batch.column("body"))) - m["mean"]) / m["spread"] @ m["w"]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        given = ids.to_numpy()
        yield pa.record_batch([pa.array([None if i == NULL_ID else i for i in given.tolist()], pa.int64()), pa.array(held_out(given, FOLDS)),
                               pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (module docstring)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return doc_rows(docs).mapInArrow(partial(_score, model), SCORES)
