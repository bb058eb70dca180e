"""Conversation repair against a plain Viterbi over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from trialframe.llm import turns

SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """Each row's first fault, by the definition."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, repaired) by memoised search over (row, accepting prefix state)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 3:
            for initial, to in after[state].items():
                if initial != "s":
                    c, a, r = best(i, to, inserts + 1)
                    ways.append((c + 3, "I" + a, ({"u": "user:", "a": "assistant:"}[initial], *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, r))
            if fault[i] not in ("blank", "duplicate"):
                more = 3 if fault[i] == "truncated" else 0
                if role[:1] in after[state]:
                    c, a, r = best(i + 1, after[state][role[:1]], 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *r)))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in after[state]:
                        c, a, r = best(i + 1, after[state][initial], 0)
                        ways.append((c + more + 3, "R" + a, (f"{name}:{text}", *r)))
        return min(ways) if ways else (10**9, "", ())

    return best(0, "", 0)


def brute(rows):
    """conv_id -> report row, for (conv_id, turn, role, text, live) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, live in rows if c == conv and live]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        fault = faults(own)
        cost, audit, repaired = cheapest(tuple(own), tuple(fault))
        at = [t for t, _, _ in own if t is not None]
        out[conv] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, *(fault.count(f) for f in (
            "blank", "duplicate", "truncated")), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                                                     for a, b in itertools.pairwise(own)),
            cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text, kind != 0)] * (2 if kind == 3 else 1)
    return out


def reported(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in found.collect()}


def odd_rows(seed, n, roles=("system", "user", "assistant", "tool", "", None, "User", "sys")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", "  \t", None, "end. \n", "a\x0bb", "漢字。", "x.\x1c"]
    return [(rng.choice([1, 2, 3, 4, 5, 6, 7, None, 9]), rng.choice([None, *range(12)]), rng.choice(roles),
             rng.choice(texts) if rng.random() < 0.6 else f"T{rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("rows_per_chunk,passes", [(1 << 16, 6), (3, 6), (1, 6), (2, 0), (1, 1)])
def test_every_chunk_size_and_exit_gives_the_plain_answer(spark, rows_per_chunk, passes):
    rows = odd_rows(5, 160) + [(50, i, "user", f"{i}.") for i in range(30)] + [
        (51, i, "user", "same.") for i in range(25)] + [(52, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(41)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as chunk", "'x' as digest", "2 as pos", "3 as kind")
    plan = turns.repair(turns.damage(df), rows_per_chunk, passes=passes)
    assert reported(plan.report()) == brute(damaged(rows))
    assert plan.passes <= passes
    if (rows_per_chunk, passes) == (2, 0):
        assert plan.left > 0


def test_repaired_turns_read_right(spark):
    rows = odd_rows(8, 120)
    plan = turns.repair(turns.damage(spark.createDataFrame(rows, SCHEMA)), 4)
    found = {}
    for r in plan.turns().orderBy("conv_id", "chunk", "nth").collect():
        found.setdefault(r.conv_id, []).append(r)
    want = brute(damaged(rows))
    for conv, own in found.items():
        kept = [r for r in own if r.edit != "D"]
        assert SHAPE.fullmatch("".join(r.role[:1] for r in kept))
        assert "".join(r.edit for r in own) == want[conv][6]
        joined = "\n".join(f"{r.role}:{r.text}" for r in kept)
        assert hashlib.sha256(joined.encode()).hexdigest() == want[conv][7]


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert reported(turns.repair(turns.damage(df)).report()) == brute(damaged(rows))


def test_alternating_conversation_converges(spark):
    """One conversation over many chunks: vectors differ by constants after one pass."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(400)]
    plan = turns.repair(spark.createDataFrame(rows, SCHEMA), 16)
    assert plan.passes <= 1 and plan.left == 0
    assert reported(plan.report())[1][5:7] == (0, "K" * 400)


def test_long_texts_and_pieces(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i} " + "long text " * 30_000 + ".") for i in range(12)]
    rows += [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = turns.repair(df, bytes_per_chunk=700_000)
    assert plan.rows.select("chunk").distinct().count() >= 6
    want = brute([(*r, True) for r in rows])
    assert reported(plan.report()) == reported(plan.report(piece=1)) == want


def test_empty_tables_and_conversations_without_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert turns.repair(turns.damage(df)).report().count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = reported(turns.repair(turns.damage(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))).report())
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
