"""Operator 13 against a plain recursion, over many segments and over one."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import pytest

from weft.llm import turn_repair
from weft.llm.queries import ORACLES, QUERIES

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, row long, mark string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """Least (cost, edits) of every rest, as strings; repaired lines from the edits."""
    out = []
    after = damage(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        turns, faults, seen = [r[1] for r in mine if r[1] is not None], [], set()
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]

        def ends(letters, rows=mine, faults=faults):
            """Repaired lines, or None if the letters lead nowhere; roles as they come."""
            lines, i, state = [], 0, 0
            for x in letters:
                step = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                role = "assistant" if step == 3 else "user"
                if x == "I":
                    lines.append(f"{role}:")
                    state = step
                    continue
                if x == "K":
                    lines.append(f"{rows[i][2]}:{rows[i][3]}")
                    state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}[state, rows[i][2][:1]]
                if x == "R":
                    lines.append(f"{role}:{rows[i][3]}")
                    state = step
                i += 1
            return lines

        @lru_cache(None)
        def rest(i, state, puts, rows=tuple(mine), faults=tuple(faults)):
            """Least (cost, letters) from here; ``puts``: rows put in just before."""
            found = [(0, "")] if i == len(rows) and state in (0, 3) else []
            step = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            add = lambda cost, letter, tail: found.append((cost + tail[0], letter + tail[1])) if tail else None
            if puts < 2:
                add(5, "I", rest(i, step, puts + 1))
            if i < len(rows):
                more = 5 * (faults[i] == "truncated")
                add(2, "D", rest(i + 1, state, 0))
                if faults[i] not in ("blank", "duplicate"):
                    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, rows[i][2][:1]))
                    if kept is not None:
                        add(more, "K", rest(i + 1, kept, 0))
                    add(1 + more, "R", rest(i + 1, step, 0))
            return min(found, default=None)

        cost, audit = rest(0, 0, 0)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(ends(audit)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "m") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Well. ", "x" * 50 + ".", "é日本", "a\nb."]
    made = [(c, t, rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "u", "Assistant", "s"]), rng.choice(texts) + rng.choice(["", "", str(rng.randrange(99)) + "."])) for c in range(120) for t in range(rng.randrange(0, 14))]
    made += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(150)]  # many segments
    made += [(None, None, None, None), (None, 3, "user", None), (600, None, "user", "Hi."), (600, None, "assistant", "Ho."), (601, 5, "user", "Same."), (601, 5, "user", "Same."), (601, 5, "assistant", "Same."), (602, 1, "user", None), (603, 2**40, "user", "Far."), (603, 1, None, "None.")]
    made += [(700, 0, "user", "long words. " * 100_000), (700, 1, "assistant", "x" * 500_000)]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("partitions", [1, 9])
def test_equal_to_a_plain_recursion(spark, rows, partitions):
    assert found(turn_repair.repair(frame(spark, rows).repartition(4), partitions)) == brute(rows)


def test_a_row_that_is_repeated_without_end(spark):
    rows = [(1, 4, "user", "Again.")] * 700 + [(1, t, "assistant", "So.") for t in range(10)] + [(2, 0, "user", "A."), (2, 1, "assistant", "B.")]
    assert found(turn_repair.repair(frame(spark, rows), 7)) == brute(rows)


def test_conversations_that_the_damage_empties(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(turn_repair.repair(frame(spark, [(gone, 0, "user", "Hi.")]), 3)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty(spark):
    assert found(turn_repair.repair(frame(spark, []), 3)) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_tight_arcs']})").fetchall(), key=str)
    assert found(QUERIES["op13_tight_arcs"](spark, f"/root/testdata/{sf}")) == want
