"""Keyed state of the streaming jobs (R2, R3): what a key was before, kept in the state store.

Both operators first combine the rows of a key inside every input chunk (one
row per key and chunk crosses the shuffle, however many rows a hot key has),
then fold these rows into the key's state with ``applyInPandasWithState``.  The
state store (RocksDB where the session names that provider) is read and written
for the keys of the micro-batch only, so a micro-batch costs what it holds and
not what the stream has seen.  A retried or restarted micro-batch starts from
the state of the one before, as the query's checkpoint has it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.expr import is_missing, js_trim, rate_pct
from ..operators import dedup as DD
from ..operators import sessions as S
from ..session import ship_package

# --- R2: numbering of duplicates ------------------------------------------------

CHUNKS = "dup_key string, salt int, lines array<long>"
NUMBERED = "dup_key string, lines array<long>, numbers array<long>, first long"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of rows that are equal in all of some sorted arrays."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(np.concatenate([[True], new, [True]]))


def _lines_by_key(batches):
    """One row per key of each chunk: its lines, ascending."""
    for pdf in batches:
        if len(pdf):
            pdf = pdf.sort_values(["dup_key", "salt", "line"], kind="stable")
            names = pdf["dup_key"].to_numpy(object)
            at = _runs(names, pdf["salt"].to_numpy())
            lines = pdf["line"].to_numpy(np.int64)
            yield pd.DataFrame({"dup_key": names[at[:-1]], "salt": pdf["salt"].to_numpy()[at[:-1]],
                                "lines": [lines[a:b] for a, b in zip(at[:-1], at[1:])]})


def dedup_stream(contacts: DataFrame, strategy="email", order_col: str = "line_number", ttl_ms: int | None = None) -> DataFrame:
    """R2: ``order_col, dup_key, dup_number, is_duplicate, original_line`` of a stream of contacts (append mode).

    Inside a micro-batch the holders of a key are numbered in ``order_col``
    order; between micro-batches the numbering goes on from the key's state:
    rows so far and first line.  With ``ttl_ms`` a key that had no rows for so
    long is forgotten (for a processing-time trigger: with ``availableNow`` Spark
    waits for timeouts without end).  Blank keys are never duplicates and leave no state.
    ``order_col`` is a unique whole number; other columns are joined by it.
    """
    ship_package(contacts.sparkSession)
    key = DD.dup_key(strategy)
    blank = is_missing(key) | (js_trim(key) == F.lit(""))
    # salt -1: blank, 0: a key; blank rows are dealt by their line, for they need no state
    rows = contacts.select(F.coalesce(key, F.lit("")).alias("dup_key"), F.col(order_col).cast("long").alias("line"),
                           F.when(blank, -1 - F.pmod(F.xxhash64(order_col), F.lit(1024))).otherwise(0).cast("int").alias("salt"))
    chunks = rows.mapInPandas(_lines_by_key, CHUNKS)

    def number(key, chunks, state):
        name, salt = key
        if state.hasTimedOut:
            state.remove()
            return
        parts = [np.asarray(x, np.int64) for pdf in chunks for x in pdf["lines"]]
        lines = np.sort(np.concatenate(parts))
        if salt < 0:
            yield pd.DataFrame({"dup_key": [name], "lines": [lines], "numbers": [None], "first": [None]})
            return
        before, first = state.get if state.exists else (0, int(lines[0]))
        state.update((before + len(lines), first))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        for k in range(0, len(lines), 1 << 16):
            part = lines[k:k + (1 << 16)]
            yield pd.DataFrame({"dup_key": [name], "lines": [part], "numbers": [np.arange(len(part)) + (before + k + 1)], "first": [first]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    numbered = chunks.groupBy("dup_key", "salt").applyInPandasWithState(number, NUMBERED, "n long, first long", "append", timeout)
    lines = F.when(F.col("numbers").isNull(), F.transform("lines", lambda x: F.struct(x.alias("line"), F.lit(None).cast("long").alias("n")))
                   ).otherwise(F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.element_at("numbers", i + 1).alias("n"))))
    return numbered.select("dup_key", "first", F.explode(lines).alias("r")).select(
        F.col("r.line").alias(order_col), "dup_key", F.col("r.n").alias("dup_number"),
        (F.coalesce(F.col("r.n"), F.lit(0)) > 1).alias("is_duplicate"),
        F.when(F.col("r.n") > 1, F.col("first")).alias("original_line"))


# --- R3: progress of sessions ----------------------------------------------------

COUNTS = ("events", "processed", "successful", "failed", "warnings", "errors", "milestones", "batches")
LATEST = (("phase", "string"), ("current_batch", "long"), ("status", "string"))
CHUNK_ROWS = 1 << 17  # events that a task combines at a time
SHARES = 4  # tasks that the events of one session are dealt to
RECENT = 256  # batch times kept one by one; what a later one could still change in older ones is below 0.8^256

_LATEST_FIELDS = ", ".join(f"{n} {t}, {n}_ts long, {n}_seq long" for n, t in LATEST)
PARTS = (f"session_id long, {', '.join(f'{c} long' for c in COUNTS)}, ts_list array<long>, seq_list array<long>, "
         f"ms_list array<double>, {_LATEST_FIELDS}, first_ts long, last_ts long")
STATE = (f"{', '.join(f'{c} long' for c in COUNTS)}, ts_list array<long>, seq_list array<long>, ms_list array<double>, "
         f"folded long, folded_ms double, {_LATEST_FIELDS}, first_ts long, last_ts long")
PROGRESS = (f"session_id long, {', '.join(f'{c} long' for c in COUNTS)}, phase string, current_batch long, status string, "
            "ema_batch_ms double, duration_ms long")


def _micros(col: Column, kind: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), col)


def _together(batches, rows: int = CHUNK_ROWS):
    """The rows of consecutive batches as frames of ``rows`` or more (the last one may have fewer)."""
    held, n = [], 0
    for pdf in batches:
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _parts_by_session(batches):
    """One row per session of each chunk: counts, batch times in order, and the latest of what a later event replaces."""
    for pdf in _together(batches):
        pdf = pdf.sort_values(["session_id", "ts", "seq"], kind="stable").reset_index(drop=True)
        kind, ok = pdf["type"], pdf["success"].eq(True)
        record = kind == S.RECORD_PROCESSED
        timed = (kind == S.BATCH_COMPLETE) & (pdf["duration_ms"].fillna(0) > 0)
        flags = pd.DataFrame({
            "session_id": pdf["session_id"], "events": 1, "processed": record, "successful": record & ok, "failed": record & ~ok,
            "warnings": kind == S.WARNING_OCCURRED, "errors": kind == S.ERROR_OCCURRED, "milestones": kind == S.MILESTONE_REACHED,
            "batches": kind == S.BATCH_COMPLETE, "first_ts": pdf["ts"], "last_ts": pdf["ts"]})
        how = {c: "sum" for c in COUNTS} | {"first_ts": "min", "last_ts": "max"}
        out = flags.groupby("session_id", sort=True).agg(how)
        out[list(COUNTS)] = out[list(COUNTS)].astype("int64")
        b = pdf[timed]
        at = _runs(b["session_id"].to_numpy())
        names = b["session_id"].to_numpy()[at[:-1]] if len(b) else []
        for name, column in (("ts_list", "ts"), ("seq_list", "seq"), ("ms_list", "duration_ms")):
            values = b[column].to_numpy()
            lists = dict(zip(names, [values[x:y] for x, y in zip(at[:-1], at[1:])]))
            out[name] = [lists.get(s, values[:0]) for s in out.index]
        replaced = {"phase": (kind == S.PHASE_CHANGE, pdf["phase"]), "current_batch": (kind == S.BATCH_START, pdf["batch_number"]),
                    "status": (kind == S.SESSION_COMPLETE, pd.Series(np.where(ok, "completed", "failed"), index=pdf.index))}
        for name, (rows, values) in replaced.items():
            last = pd.DataFrame({"session_id": pdf["session_id"], name: values, f"{name}_ts": pdf["ts"], f"{name}_seq": pdf["seq"]})[rows]
            last = last.drop_duplicates("session_id", keep="last").set_index("session_id")
            for c in last.columns:
                out[c] = last[c].astype(object).reindex(out.index)
        yield out.reset_index()[[f.split()[0] for f in PARTS.split(", ")]]


def moving_average(durations, first: float | None = None) -> float | None:
    """The first value, then 0.8 * old + 0.2 * new; ``first`` is the average so far."""
    for d in durations:
        first = d if first is None else S.EMA_KEEP * first + (1 - S.EMA_KEEP) * d
    return first


def fold(state: dict, part: dict) -> dict:
    """The state of a session with one more row of ``PARTS``, whatever order rows come in."""
    out = {c: state[c] + int(part[c]) for c in COUNTS}
    out["first_ts"], out["last_ts"] = min(state["first_ts"], int(part["first_ts"])), max(state["last_ts"], int(part["last_ts"]))
    for name, _ in LATEST:
        fields = (name, f"{name}_ts", f"{name}_seq")
        new, old = (tuple(None if x[f] is None or x[f] != x[f] else x[f] for f in fields) for x in (part, state))
        newer = new[1] is not None and (old[1] is None or new[1:] >= old[1:])
        out.update(zip(fields, new if newer else old))
    times = sorted([*zip(state["ts_list"], state["seq_list"], state["ms_list"]), *zip(part["ts_list"], part["seq_list"], part["ms_list"])])
    old, recent = times[:-RECENT], times[-RECENT:]
    out["folded"] = state["folded"] + len(old)
    out["folded_ms"] = moving_average([d for _, _, d in old], state["folded_ms"])
    for k, name in enumerate(("ts_list", "seq_list", "ms_list")):
        out[name] = [(float if k == 2 else int)(t[k]) for t in recent]
    return out


_FIELDS = [f.split()[0] for f in STATE.split(", ")]
_EMPTY = {**{c: 0 for c in COUNTS}, "ts_list": [], "seq_list": [], "ms_list": [], "folded": 0, "folded_ms": None,
          **{f"{n}{s}": None for n, _ in LATEST for s in ("", "_ts", "_seq")}, "first_ts": 1 << 62, "last_ts": -(1 << 62)}


def progress_stream(events: DataFrame) -> DataFrame:
    """The state of every session that has events in the micro-batch (update mode).

    Counts, moving average of batch times, phase, current batch and status, as
    after all events so far in (ts, seq) order: late events take their place in
    it.  ``events``: session_id, ts, seq, type, success, duration_ms, phase,
    batch_number.
    """
    ship_package(events.sparkSession)
    kind = dict(events.dtypes)["ts"]
    rows = events.select("session_id", _micros(F.col("ts"), kind).alias("ts"), F.col("seq").cast("long").alias("seq"), "type", "success",
                         F.col("duration_ms").cast("double").alias("duration_ms"), "phase", F.col("batch_number").cast("long").alias("batch_number"))
    # few input files are few tasks: the events are dealt anew, those of a session to few tasks, which combine them
    dealt = rows.repartition(F.col("session_id"), F.pmod(F.xxhash64("seq"), F.lit(SHARES)))
    parts = dealt.mapInPandas(_parts_by_session, PARTS)

    def step(key, chunks, state):
        now = dict(zip(_FIELDS, state.get)) if state.exists else _EMPTY
        for pdf in chunks:
            for part in pdf.astype(object).to_dict("records"):
                now = fold(now, part)
        state.update(tuple(None if now[f] is None else int(now[f]) if f.endswith(("_ts", "_seq")) or f == "current_batch" else now[f] for f in _FIELDS))
        average = moving_average(now["ms_list"], now["folded_ms"])
        yield pd.DataFrame([{
            "session_id": key[0], **{c: now[c] for c in COUNTS}, "phase": now["phase"], "current_batch": now["current_batch"],
            "status": now["status"] or S.ACTIVE, "ema_batch_ms": None if average is None else round(average, 6),
            "duration_ms": (now["last_ts"] - now["first_ts"]) // 1000}])

    return parts.groupBy("session_id").applyInPandasWithState(step, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout).withColumn(
        "success_rate", rate_pct("successful", "processed"))
