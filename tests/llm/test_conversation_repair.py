"""Conversation repair against brute force, and its defined cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rosterspark.llm import conversation_repair as repair
from rosterspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(classes):
    """(cost, audit, role initials) by uniform-cost search over edits; classes: (initial, must go, truncated)."""
    heap, best, seen = [(0, "", 0, "")], None, set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if (audit, i, out) in seen or len(out) > 2 * len(classes) + 2:
            continue
        seen.add((audit, i, out))
        if i == len(classes) and GRAMMAR.fullmatch(out) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        steps = [("I", 5, 0, g) for g in "ua"]
        if i < len(classes):
            c, gone, cut = classes[i]
            steps.append(("D", 2, 1, ""))
            if not gone:
                steps += [("K", 5 * cut, 1, c)] + [("R", 1 + 5 * cut, 1, g) for g in "ua"]
        for letter, price, step, g in steps:
            new = out + g
            if re.fullmatch("s?(ua)*u?", new) and len(g) <= 1 and (g or letter == "D"):
                heapq.heappush(heap, (cost + price, audit + letter, i + step, new))
    return best


def brute(rows):
    """rows: (conv_id, turn, role, text) undamaged.  {conv_id: the other columns}"""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(name.encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        convs[c] += [] if how == 0 else [(turn is not None, turn or 0, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2], hashlib.md5(f"{len(t[2])}:{t[2]}:{t[3]}".encode()).digest()))
        numbers = [t[1] for t in turns if t[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, classes, faults = set(), [], [0, 0, 0]
        for _, _, role, text in turns:
            solid = text.rstrip(WHITE)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            classes.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault in (0, 1), fault == 2))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, initials = cheapest(classes)
        lines, i, j = [], 0, 0
        for letter in audit:
            role = {"s": "system", "u": "user", "a": "assistant"}[initials[j]] if letter != "D" else ""
            if letter == "I":
                lines.append(f"{role}:")
            elif letter != "D":
                lines.append(f"{turns[i][2] if letter == 'K' else role}:{turns[i][3]}")
            i, j = i + (letter != "I"), j + (letter != "D")
        out[c] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def query(df):
    return repair.audited(repair.damaged(df), copies="copies")


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, SF)) == brute(rows)


def test_audits_equal_uniform_cost_search():
    rnd = random.Random(5)
    for k in range(400):
        codes = "".join(rnd.choice("suauauaxSUAXD" if k % 2 else "uauauaua") for _ in range(rnd.randrange(0, 6)))
        want = cheapest([(c.lower(), c == "D", c.isupper() and c != "D") for c in codes])[:2]
        assert repair.align_all(codes.encode()) == want == repair.align_states(codes.encode())


@pytest.mark.parametrize("n", [30, 80, 130])
def test_lengths_and_states_agree(n):
    rnd = random.Random(n)
    for _ in range(6):
        codes = "".join(rnd.choice("DDUAuaSsx") if rnd.random() < 0.2 else "ua"[j % 2] for j in range(n) if rnd.random() > 0.05).encode()
        assert repair.align_all(codes) == repair.align_states(codes)


def test_random_conversations(spark):
    rnd, rows = random.Random(9), []
    for c in range(150):
        rows += [(c, rnd.choice([k, k, k, k + 3, None]), rnd.choice(["user", "assistant", "system", "tool", "", None, "usher"]),
                  rnd.choice(["Fine.", "What?", "cut", "", " \t", None, "Fine.", "é. \n"])) for k in range(rnd.randrange(1, 6))]
    rows += [(None, 1, "user", "Null."), (None, 2, "assistant", "Id.")]
    assert found(query(frame(spark, rows))) == brute(rows)


def test_defined_cases(spark):
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (1, None, None, None), (2, 5, "assistant", "x" * 200000)]
    d = frame(spark, rows)
    for c in ("copies", "kind", "token", "code", "blank", "place", "_id"):
        d = d.withColumn(c, F.lit("x"))
    got = found(query(d))
    assert got == brute(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert query(d.limit(0)).collect() == []


def test_long_conversation_and_repaired_turns(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(4000) if k % 50 != 7]
    d = frame(spark, rows)
    turns = sorted(repair.repaired(d).collect(), key=lambda r: r.place)
    assert [r.place for r in turns] == list(range(len(turns)))
    assert GRAMMAR.fullmatch("".join(r.role[0] for r in turns))
    r = repair.audited(d).collect()[0]
    text = "\n".join(f"{t.role}:{t.text}" for t in turns)
    assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.gaps == 80 and r.illegal == 80 and (r.blank, r.duplicate, r.truncated) == (0, 0, 0)
    assert r.cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[x] for x in r.audit)
