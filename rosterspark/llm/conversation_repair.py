"""Conversation structure repair by Wagner-Fischer target alignment (operator 12).

A sound conversation's role initials are ``(s?(ua)+)?``: one string for each
length 0, 2, 3, 4, ...  The turns of a conversation are aligned to the string
of each feasible length.  Keeping a turn costs 0, giving it another role 1,
deleting it 2, inserting an empty turn 5; blank and repeated turns must be
deleted, a truncated one that stays costs 5 more.

* A threshold on the cost starts near the least any length can cost and doubles
  until a length stays within it.  Lengths go by the least cost their number of
  turns allows, and end when that passes the best cost so far (the incumbent).
* For one length the table of costs to the end holds only Ukkonen's band: the
  diagonals on which insertions and deletions alone do not pass the incumbent.
* Walking the table from the start along cheapest edits, taking D before I
  before K before R, backtraces the ASCII-least audit of that length; audits of
  equally cheap lengths are compared as strings.

Audits are cached by the classes of the turns (one byte each).  Over ``LONG``
turns the lengths are not tried one by one: the grammar's four states stand for
all target strings at once (same costs, same audit, time linear in the turns).

Spark deals the rows by conversation, each row twice: first all rows of a
conversation with only what the audit needs (class, hash of role and text), then
in the same order the rows with their texts, which are repaired as a stream.  A
task holds one byte and one hash a turn of one conversation, and no texts but a
batch.

``repaired(conversations)`` returns the repaired turns, ``audited`` one row a
conversation with its faults, cost, audit and the hash of the repaired turns;
``damaged`` breaks conversations in a repeatable way.

Defined cases: a null role or text is one space; turns go by turn (null first),
then role, then the hash of role and text; rows without conv_id are one
conversation (null); a conversation that lost all rows has zeros, an empty audit
and the hash of nothing; an empty table gives no rows; further columns are left
out.  Repeated turns are found by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import bucket_count
from rosterspark.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LONG = 96  # turns; above, all lengths are aligned at once
FAR = 1 << 60
ROLES = {"s": "system", "u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"  # fixed values: white space of the blank test

# classes of turns: s u a x (another role), upper case where truncated, D where the turn must go
FORCED = ord("D")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows broken by crc32("conv_id:turn") % 20; 0 copies: the row is lost."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(how == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))


def target(length: int, place: int) -> str:
    """The initial at a place of the string of a length."""
    if length % 2 and place == 0:
        return "s"
    return "u" if (place - length % 2) % 2 == 0 else "a"


def least_cost(length: int, forced: int, plain: int, cut: int) -> int:
    """No alignment of that many forced, sound and truncated turns to ``length`` costs less."""
    matched = min(length, plain + cut)
    return DELETE * (forced + plain + cut - matched) + INSERT * (length - matched) + TRUNCATED * max(0, matched - plain)


def _lengths(forced: int, plain: int, cut: int):
    """(least cost, length) of the feasible lengths, cheapest first."""
    down, up = plain, plain + 1
    while True:
        costs = [(least_cost(n, forced, plain, cut), n) for n in (down, up) if n >= 0]
        cost, n = min(costs)
        if n != 1:
            yield cost, n
        if n == down:
            down -= 1
        else:
            up += 1


def align(codes: bytes, length: int, most: int) -> tuple[int, str] | None:
    """(cost, ASCII-least audit) of the cheapest alignment to the string of ``length``, None if it costs more than ``most``."""
    turns = [c for c in codes if c != FORCED]
    forced, shift = len(codes) - len(turns), length - len(turns)
    spare = most - DELETE * forced - (INSERT * shift if shift > 0 else -DELETE * shift)
    if spare < 0:
        return None
    out = spare // (INSERT + DELETE)  # diagonals beyond those between 0 and shift
    low, high = min(0, shift) - out, max(0, shift) + out
    width = high - low + 1
    goal = [target(length, j) for j in range(length)]

    def row(met: int, code: int | None, below: list[int]) -> list[int]:
        """Costs to the end by diagonal, before a turn (None: after the last) with ``met`` unforced turns before it."""
        here = [FAR] * (width + 1)
        for k in range(width - 1, -1, -1):
            j = met + low + k
            if not 0 <= j <= length:
                continue
            best = FAR
            if code is None:
                best = 0 if j == length else FAR
            elif code == FORCED:
                best = DELETE + below[k]
            else:
                if k:
                    best = DELETE + below[k - 1]
                if j < length:
                    best = min(best, _fit(code, goal[j]) + below[k])
            if j < length and goal[j] != "s":
                best = min(best, INSERT + here[k + 1])
            here[k] = best
        return here

    met = len(turns)
    table = [row(met, None, [])]
    for code in reversed(codes):
        met -= code != FORCED
        table.append(row(met, code, table[-1]))
    table.reverse()
    cost = table[0][-low]
    if cost > most:
        return None
    audit, i, k, met, left = [], 0, -low, 0, cost
    while i < len(codes) or met + low + k < length:
        j = met + low + k
        code = codes[i] if i < len(codes) else None
        after = k - (code != FORCED)
        if code is not None and after >= 0 and left == DELETE + table[i + 1][after]:
            audit.append("D")
            met += code != FORCED
            i, k, left = i + 1, after, left - DELETE
        elif j < length and goal[j] != "s" and left == INSERT + table[i][k + 1]:
            audit.append("I")
            k, left = k + 1, left - INSERT
        else:
            fit = _fit(code, goal[j])
            audit.append("K" if chr(code).lower() == goal[j] else "R")
            met += 1
            i, left = i + 1, left - fit
    return cost, "".join(audit)


def _fit(code: int, goal: str) -> int:
    """Cost of the turn standing for an initial."""
    c = chr(code)
    cut = TRUNCATED if c.isupper() else 0
    if c.lower() == goal:
        return cut + KEEP
    return FAR if goal == "s" else cut + REROLE


@lru_cache(1 << 16)
def align_all(codes: bytes) -> tuple[int, str]:
    """(cost, audit) over the strings of all lengths, aligned one by one."""
    forced = codes.count(FORCED)
    cut = sum(chr(c).isupper() for c in codes) - forced
    shape = (forced, len(codes) - forced - cut, cut)
    most = next(_lengths(*shape))[0] + 4
    while True:
        best: tuple[int, str] | None = None
        for least, length in _lengths(*shape):
            bound = best[0] if best else most
            if least > bound:
                break
            done = align(codes, length, bound)
            if done and (best is None or done < best):
                best = done
        if best:
            return best
        most *= 2


#: By state (nothing yet, after s, after u, after a): the state after each initial that may follow.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def align_states(codes: bytes) -> tuple[int, str]:
    """As ``align_all`` with the grammar's states in place of the strings."""
    def inserted(row: list[int]) -> tuple[int, ...]:
        for _ in range(3):
            row = [min(row[s], INSERT + min(row[t] for g, t in FOLLOWS[s].items() if g != "s")) for s in range(4)]
        return tuple(row)

    def edits(code: int, state: int):
        """(letter, cost, next state) in order of letters, insertions left out."""
        yield "D", DELETE, state
        if code != FORCED:
            fits = [("K" if chr(code).lower() == g else "R", _fit(code, g), t) for g, t in FOLLOWS[state].items()]
            yield from sorted(x for x in fits if x[1] < FAR)

    table = [inserted([0, FAR, FAR, 0])]
    for code in reversed(codes):
        below = table[-1]
        table.append(inserted([min(c + below[t] for _, c, t in edits(code, s)) for s in range(4)]))
    table.reverse()
    audit, state, left, i = [], 0, table[0][0], 0
    while i < len(codes) or state not in (0, 3) or left:
        moves = [("I", INSERT, t, i) for g, t in FOLLOWS[state].items() if g != "s"]
        if i < len(codes):
            moves += [(letter, c, t, i + 1) for letter, c, t in edits(codes[i], state)]
        letter, c, state, i = min(m for m in moves if left == m[1] + table[m[3]][m[2]])
        audit.append(letter)
        left -= c
    return table[0][0], "".join(audit)


def audit_of(codes: bytes) -> tuple[int, str]:
    return align_states(codes) if len(codes) > LONG else align_all(codes)


ROWS = "conv_id long, kind int, turn long, role string, token binary, code string, blank boolean, text string"


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows for the stream: kind -1 names the conversation of a lost row, 0 has what the audit needs, 1 the text."""
    ship_package(rows.sparkSession)
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    code = F.when(F.right(solid, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    token = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text"))))
    kinds = F.when(F.col("copies") == 0, F.array(F.lit(-1))).otherwise(F.concat(
        F.array_repeat(F.lit(0), F.col("copies")), F.array_repeat(F.lit(1), F.col("copies"))))
    return (rows.select("conv_id", F.explode(kinds).alias("kind"), "turn", "role", token.alias("token"), code.alias("code"),
                        (solid == "").alias("blank"), "text")
            .withColumn("text", F.when(F.col("kind") == 1, F.col("text")))
            .repartition(bucket_count(rows.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "token"))


class Conversation:
    """Faults of one conversation while its rows go by, then its audit."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.seen = conv_id, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.initial = None
        self.turns = 0
        self.audit = None

    def see(self, turn, role, token, code, blank):
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if blank or token in self.seen:
            self.codes.append(FORCED)
            self.blank += blank
            self.duplicate += not blank
        else:
            self.codes += code.encode()
            self.truncated += code.isupper()
        self.seen.add(token)

    def settle(self):
        """All rows have gone by."""
        if self.audit is None:
            self.seen = None
            self.cost, self.audit = audit_of(bytes(self.codes))
            self.length = len(self.audit) - self.audit.count("D")
            self.at = self.place = 0

    def turns_before(self):
        """The turns that are inserted before the next row."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.conv_id, self.place, ROLES[target(self.length, self.place)], "", "I"
            self.at, self.place = self.at + 1, self.place + 1

    def repair(self, role, text):
        yield from self.turns_before()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.conv_id, self.place, role if edit == "K" else ROLES[target(self.length, self.place)], text, edit
            self.place += 1

    def gaps(self):
        return self.last - self.first + 1 - self.turns if self.turns else 0


def _stream(batches):
    """(a repaired turn, None) and, after the last of a conversation, (None, the conversation)."""
    now = None
    for batch in batches:
        for conv_id, kind, turn, role, token, code, blank, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield from _ended(now)
                now = Conversation(conv_id)
            if kind == 0:
                now.see(turn, role, token, code, blank)
            elif kind == 1:
                now.settle()
                for t in now.repair(role, text):
                    yield t, None
    if now is not None:
        yield from _ended(now)


def _ended(now: Conversation):
    now.settle()
    for t in now.turns_before():
        yield t, None
    yield None, now


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
AUDITED = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                    + [(c, pa.string()) for c in ("audit", "repaired_sha256")])


def _batches(rows, schema: pa.Schema, size: int):
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += sum(len(x) for x in r if isinstance(x, str))
        if len(part) == size or held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _plain(conversations: DataFrame, copies: str | None) -> DataFrame:
    """The columns that are read; ``copies`` names a column with the times that a row counts (0: only its conversation does)."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
                                (F.col(copies) if copies else F.lit(1)).alias("copies"))


def repaired(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that the cheapest edits leave, places from 0."""
    def run(batches):
        yield from _batches((t for t, _ in _stream(batches) if t), REPAIRED, 1 << 12)

    return _dealt(_plain(conversations, copies)).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def audited(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row a conversation."""
    def rows(batches):
        digest, first = hashlib.sha256(), True
        for turn, ended in _stream(batches):
            if turn:
                digest.update((f"{turn[2]}:" if first else f"\n{turn[2]}:").encode() + turn[3].encode())
                first = False
            else:
                c = ended
                yield (c.conv_id, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.audit, digest.hexdigest())
                digest, first = hashlib.sha256(), True

    def run(batches):
        yield from _batches(rows(batches), AUDITED, 1 << 12)

    return _dealt(_plain(conversations, copies)).mapInArrow(
        run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
