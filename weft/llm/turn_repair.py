"""Operator 13, conversation structure repair: a bidirectional tight-arc graph.

A conversation's rows in order, times the four states of ``(s?(ua)+)?``, are the nodes of a graph
whose arcs are edits.  Least costs from the start (forward) and to the end (backward) tell the arcs
that lie on a cheapest repair: those with forward + cost + backward = least cost.  From the start
the set of nodes reached is carried over these arcs, and the least letter among them is taken at
each step, which gives the least of all cheapest edit strings.

The table is put in order once, by ranges of (conv_id, turn, role, text's SHA-256), so a
conversation of any length is cut in segments of one partition.  A segment's costs are a 4 by 4
matrix (least cost from each state before it to each after it), which segments yield in parallel;
their (min, +) products along a conversation give every segment its forward and backward costs, and
the letters of all segments are again found in parallel, for each state it may begin with.  Only two
things need a conversation's rows in turn, and both are streamed: the choice of the segment's state,
and the SHA-256 of the repaired text, whose memory does not grow.

Defined results: nulls count as one space, in the damage's key too.  Rows of one turn come in order of
role and the text's SHA-256; equal rows are next to each other, and any but the first are
duplicates.  A role without an initial (empty) fits nowhere and is reroled or deleted.  Rows with a
null conv_id are one conversation.  A conversation without rows after the damage has zeros, an
empty audit and the hash of nothing.  An empty table gives an empty result; other columns are not
read.  Roles are told by their first letter, case counts.  Rows with equal conv_id and turn are
damaged alike.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, row_number, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: A row's code is 4 * fault + role; roles as in "sua", 3 for others.
WHOLE, DEAD, TRUNCATED = 0, 1, 2
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FAR = 1 << 60
STATES = range(4)
#: The state after a kept row by state and role, after a user's or assistant's row that is put in.
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Inserts before a row, or after the last: least cost from state to state.
INSERTS = tuple(tuple(0 if s == t else INSERT if NEXT[s] == t else 2 * INSERT if NEXT[NEXT[s]] == t else FAR for t in STATES) for s in STATES)
#: Cost from each state after the last row, and the letters.
CLOSING = (0, 2 * INSERT, INSERT, 0)
ENDING = ("", "II", "I", "")
BLANKS = " \t\n\x0b\x0c\r"


def arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, state before, state after, cost) of the edits of a row with ``code``."""
    fault, role = divmod(code, 4)
    out = [("D", s, s, DELETE) for s in STATES]
    if fault != DEAD:
        more = CUT * (fault == TRUNCATED)
        out += [("K", s, KEPT[s, role], KEEP + more) for s in STATES if (s, role) in KEPT]
        out += [("R", s, NEXT[s], REROLE + more) for s in STATES]
    return out


def product(a, b):
    """(min, +) product of two 4 by 4 matrices."""
    return tuple(tuple(min(FAR, *(a[s][k] + b[k][t] for k in STATES)) for t in STATES) for s in STATES)


def _step(code: int):
    row = [[FAR] * 4 for _ in STATES]
    for _, s, t, cost in arcs(code):
        row[s][t] = min(row[s][t], cost)
    return product(INSERTS, row)


ARCS = [arcs(code) for code in range(12)]
STEPS = [_step(code) for code in range(12)]
SAME = tuple(tuple(0 if s == t else FAR for t in STATES) for s in STATES)


class Chain:
    """Costs along rows: ``by`` is a product; results are kept less their least entry, of which there are few."""

    def __init__(self, by):
        self.by, self.known = by, {}

    def after(self, value, code: int):
        """(value less its least entry, that entry) after one more row."""
        if (found := self.known.get((value, code))) is None:
            new = self.by(value, code)
            least = min(min(r) if isinstance(r, tuple) else r for r in new)
            less = lambda x: x - least if x < FAR else FAR
            found = self.known[value, code] = (tuple(tuple(map(less, r)) if isinstance(r, tuple) else less(r) for r in new), least)
        return found


def _plus(x: int, y: int) -> int:
    return min(FAR, x + y)


MATRIX = Chain(lambda m, code: product(m, STEPS[code]))
FORWARD = Chain(lambda f, code: tuple(min(FAR, *(f[s] + STEPS[code][s][t] for s in STATES)) for t in STATES))
BACKWARD = Chain(lambda b, code: tuple(min(FAR, *(STEPS[code][s][t] + b[t] for t in STATES)) for s in STATES))


def forward(costs, m):
    return tuple(min(FAR, *(costs[s] + m[s][t] for s in STATES)) for t in STATES)


def backward(costs, m):
    return tuple(min(FAR, *(m[s][t] + costs[t] for t in STATES)) for s in STATES)


def _along(chain: Chain, start, codes):
    """Absolute costs before the first of ``codes`` and after each."""
    base = min(start)
    value, out = tuple(x - base if x < FAR else FAR for x in start), [tuple(start)]
    for code in codes:
        value, more = chain.after(value, code)
        base += more
        out.append(tuple(_plus(x, base) for x in value))
    return out


def least_letters(codes: bytes, before, after):
    """For each state that may begin a cheapest repair here: (letters, state after), else None.

    ``before`` and ``after``: least costs from the conversation's start to each state before these
    rows, and from each state after them to its end.  Before a row a node may still insert, so the
    forward costs of a layer include inserts.
    """
    to_end = _along(BACKWARD, after, reversed(codes))[::-1]
    from_start = [tuple(min(FAR, *(f[s] + INSERTS[s][t] for s in STATES)) for t in STATES) for f in _along(FORWARD, before, codes)]
    best = min(_plus(before[s], to_end[0][s]) for s in STATES)
    out = []
    for entry in STATES:
        if before[entry] + to_end[0][entry] != best:
            out.append(None)
            continue
        letters, frontier, i = bytearray(), {entry}, 0
        while i < len(codes):
            tight: dict[str, set[int]] = {}
            for s in frontier:
                for letter, u, v, cost in ARCS[codes[i]]:
                    if u == s and from_start[i][u] + cost + to_end[i + 1][v] == best:
                        tight.setdefault(letter, set()).add(v)
                if from_start[i][s] + INSERT + to_end[i][NEXT[s]] == best:
                    tight.setdefault("I", set()).add(NEXT[s])
            letter = min(tight)
            letters += letter.encode()
            frontier = tight[letter]
            i += letter != "I"
        # Every letter leads from a state to one state, so one state is left.
        out.append((letters.decode(), min(frontier)))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults, by crc32(conv_id:turn) % 20."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        conversations.select(row_number(conversations).alias("at"), "conv_id", F.col("turn").cast("long").alias("turn"), words("role").alias("role"), words("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select("at", "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.expr("if(kind = 3, array(0, 1), array(0))")).alias("copy"))
    )


def ordered(rows: DataFrame, partitions: int) -> DataFrame:
    """``rows`` with ``row``, which ascends in order; a partition of any key is cut at any row."""
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "at", "copy")]
    dealt = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return written(dealt.select("conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("row")), "ordered")


def last_character() -> Column:
    return F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)


def cut_short() -> Column:
    return last_character().rlike("[^.!?]")


SEGMENT = "conv_id {id}, row long, codes binary, matrix array<long>, first int, last int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"


def segments(rows: DataFrame, partitions: int) -> DataFrame:
    """One row for each conversation and partition of ``rows``; ``row`` is its first row."""
    fault = F.when(last_character() == "", DEAD).when(cut_short(), TRUNCATED).otherwise(WHOLE)
    role = F.substring("role", 1, 1)
    code = 4 * fault + F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("conv_id", rows.schema["conv_id"].dataType), ("turn", "long"), ("code", "int"))]
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("row").alias("row")).select("row", F.lit(0).alias("mark"), *nothing)
    marked = rows.select("row", F.lit(1).alias("mark"), "conv_id", "turn", code.alias("code")).union(firsts)
    marked = marked.repartition(partitions, F.shiftright("row", 33)).sortWithinPartitions("row", "mark")
    schema = SEGMENT.format(id=rows.schema["conv_id"].dataType.simpleString())

    def task(batches):
        names, out, now, first = [x.split()[0] for x in schema.split(", ")], [], None, None

        def done():
            out.append((now["id"], now["row"], bytes(now["codes"]), [_plus(x, now["base"]) for r in now["matrix"] for x in r], now["codes"][0] % 4, now["role"], now["low"], now["high"], now["turns"], *now["faults"], now["illegal"]))

        def drain():
            batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=arrow)
            out.clear()
            return batch

        arrow = None
        for batch in batches:
            if arrow is None:
                whole = pa.int64()
                arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("row", whole), ("codes", pa.binary()), ("matrix", pa.list_(whole)), ("first", pa.int32()), ("last", pa.int32()), *((n, whole) for n in names[6:])])
            for row, mark, conv, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not mark:
                    first = row
                    continue
                if now is None or (row >> 33, conv) != (now["part"], now["id"]):
                    if now is not None:
                        done()
                    now = {"id": conv, "part": row >> 33, "row": row, "codes": bytearray(), "matrix": SAME, "base": 0, "role": None, "low": None, "high": None, "turns": 0, "faults": [0, 0, 0], "illegal": 0}
                fault, role = divmod(code, 4)
                if fault == DEAD:
                    now["faults"][0] += 1
                elif first != row:
                    fault = DEAD
                    now["faults"][1] += 1
                elif fault == TRUNCATED:
                    now["faults"][2] += 1
                if now["role"] is not None:
                    now["illegal"] += (now["role"], role) not in LEGAL
                now["role"] = role
                if turn is not None:
                    now["turns"] += turn != now["high"]
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                now["codes"].append(4 * fault + role)
                now["matrix"], more = MATRIX.after(now["matrix"], 4 * fault + role)
                now["base"] += more
            if len(out) > 1000:
                yield drain()
        if now is not None:
            done()
        if out:
            yield drain()

    return written(marked.mapInArrow(task, schema), "segments")


def _groups(batches):
    """(conv_id, its rows as dicts) of batches in order of conv_id."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["conv_id"] != now:
                yield now, rows
                rows = []
            now = r["conv_id"]
            rows.append(r)
    if rows:
        yield now, rows


def costs(found: DataFrame, partitions: int) -> DataFrame:
    """(row, before, after) of each segment: least costs from the start and to the end."""

    def task(batches):
        out = []
        for _, parts in _groups(batches):
            each = [tuple(tuple(p["matrix"][4 * s : 4 * s + 4]) for s in STATES) for p in parts]
            before, after = [(0, FAR, FAR, FAR)], [CLOSING]
            for m in each[:-1]:
                before.append(forward(before[-1], m))
            for m in each[:0:-1]:
                after.append(backward(after[-1], m))
            out += zip((p["row"] for p in parts), before, after[::-1], strict=True)
            if len(out) > 5000:
                yield _cost_rows(out)
                out = []
        if out:
            yield _cost_rows(out)

    slim = found.select("conv_id", "row", "matrix").repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "row")
    return slim.mapInArrow(task, "row long, before array<long>, after array<long>")


def _cost_rows(out):
    kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "before", "after"])


def lettered(found: DataFrame, scanned: DataFrame) -> DataFrame:
    """Segments with the letters and the state after for each state that may begin them."""

    def task(batches):
        for batch in batches:
            letters, states = [], []
            for codes, before, after in zip(*(batch[c].to_pylist() for c in ("codes", "before", "after")), strict=True):
                each = least_letters(codes, before, after)
                letters.append([x and x[0] for x in each])
                states.append([x and x[1] for x in each])
            kept = batch.drop_columns(["codes", "before", "after"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(letters, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], [*kept.schema.names, "letters", "states"])

    given = found.drop("matrix").join(scanned, "row")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name not in ("codes", "before", "after")]
    return given.mapInArrow(task, ", ".join([*kept, "letters array<string>", "states array<int>"]))


class Repaired:
    """One conversation as it streams by: its figures, edits and the hash of what is left."""

    def __init__(self, conv):
        self.conv, self.audit, self.cost, self.hash, self.lines = conv, [], 0, hashlib.sha256(), 0
        self.state, self.walk, self.letters, self.at = START, START, "", 0
        self.low = self.high = self.role = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0]

    def segment(self, s: dict) -> None:
        if self.role is not None:
            self.illegal += (self.role, s["first"]) not in LEGAL
        self.role = s["last"]
        self.illegal += s["illegal"]
        self.turns += s["turns"] - (s["low"] is not None and s["low"] == self.high)
        self.low = s["low"] if self.low is None else self.low
        self.high = s["high"] if s["high"] is not None else self.high
        self.faults = [x + s[c] for x, c in zip(self.faults, ("blank", "duplicate", "truncated"), strict=True)]
        self.letters, self.at = s["letters"][self.state], 0
        self.state = s["states"][self.state]
        self.audit.append(self.letters)

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:".encode() + text.encode())
        self.lines += 1

    def insert(self) -> None:
        self.walk = NEXT[self.walk]
        self.line(NAMES[self.walk], "")

    def row(self, role: str, text: str, code: int) -> None:
        while self.letters[self.at] == "I":
            self.insert()
            self.at += 1
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.walk = KEPT[self.walk, "sua".find(role[:1])]
            self.line(role, text)
        elif letter == "R":
            self.walk = NEXT[self.walk]
            self.line(NAMES[self.walk], text)
        self.cost += CUT * (code == TRUNCATED and letter != "D")

    def result(self) -> tuple:
        for _ in ENDING[self.walk]:
            self.insert()
        audit = "".join(self.audit) + ENDING[self.state]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost = self.cost + INSERT * audit.count("I") + DELETE * audit.count("D") + REROLE * audit.count("R")
        return self.conv, gaps, *self.faults, self.illegal, cost, audit, self.hash.hexdigest()


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(conversations: DataFrame, rows: DataFrame, parts: DataFrame, partitions: int) -> DataFrame:
    """One row for each conv_id of ``conversations``."""
    every = conversations.groupBy("conv_id").agg(F.lit(-1).cast("long").alias("row")).withColumn("mark", F.lit(0))
    texts = rows.select("conv_id", "row", F.lit(2).alias("mark"), "role", "text", F.when(cut_short(), TRUNCATED).otherwise(WHOLE).alias("code"))
    stream = every.unionByName(parts.withColumn("mark", F.lit(1)), allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "row", "mark")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in RESULT) + ", audit string, repaired_sha256 string"

    def task(batches):
        now, out, arrow = None, [], None

        def drain():
            columns = list(zip(*out, strict=True))
            kinds = [arrow, *[pa.int64()] * len(RESULT), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *RESULT, "audit", "repaired_sha256"])

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            facts = batch.to_pylist() if 1 in batch["mark"].to_pylist() else None
            for k, (conv, mark, role, text, code) in enumerate(zip(*(batch[c].to_pylist() for c in ("conv_id", "mark", "role", "text", "code")), strict=True)):
                if mark == 0:
                    if now is not None:
                        out.append(now.result())
                    now = Repaired(conv)
                elif mark == 1:
                    now.segment(facts[k])
                else:
                    now.row(role, text, code)
            if len(out) > 1000:
                yield drain()
        if now is not None:
            out.append(now.result())
        if out:
            yield drain()

    return stream.mapInArrow(task, schema)


def repair(conversations: DataFrame, partitions: int | None = None, damage=damaged) -> DataFrame:
    """Repairs of ``conversations`` after ``damage`` (see the module); one row for each conv_id."""
    spark = conversations.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ordered(damage(conversations), partitions)
    found = segments(rows, partitions)
    out = written(repaired(conversations, rows, lettered(found, costs(found, partitions)), partitions), "repaired")
    remove(rows)
    remove(found)
    return out


#: The same by a recursion from the last row on: for each state the least (cost, edits) of what follows.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS k
      FROM conversations, t),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE k <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM e),
g AS (SELECT *, z = '' AS blank, z <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM f),
h AS (SELECT *, blank OR duplicate AS dead, NOT blank AND NOT duplicate AND z NOT IN ('.', '!', '?') AS truncated FROM g),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM h GROUP BY conv_id),
b AS (
  SELECT conv_id, n + 1 AS i, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS s0, {'c': 10::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']} AS s1,
         {'c': 5::BIGINT, 'a': 'I', 'r': ['assistant:']} AS s2, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS s3 FROM s
  UNION ALL
  SELECT conv_id, i,
    list_min([x0, {'c': x2.c + 5, 'a': 'I' || x2.a, 'r': list_prepend('user:', x2.r)}, {'c': x3.c + 10, 'a': 'II' || x3.a, 'r': ['user:', 'assistant:'] || x3.r}]),
    list_min([x1, {'c': x2.c + 5, 'a': 'I' || x2.a, 'r': list_prepend('user:', x2.r)}, {'c': x3.c + 10, 'a': 'II' || x3.a, 'r': ['user:', 'assistant:'] || x3.r}]),
    list_min([x2, {'c': x3.c + 5, 'a': 'I' || x3.a, 'r': list_prepend('assistant:', x3.r)}]),
    list_min([x3, {'c': x2.c + 5, 'a': 'I' || x2.a, 'r': list_prepend('user:', x2.r)}])
  FROM (
    SELECT b.conv_id, h.i,
      list_min([{'c': s0.c + 2, 'a': 'D' || s0.a, 'r': s0.r}, CASE WHEN NOT dead AND role[1] = 's' THEN {'c': s1.c + 5 * truncated::BIGINT, 'a': 'K' || s1.a, 'r': list_prepend(role || ':' || text, s1.r)} END,
                CASE WHEN NOT dead AND role[1] = 'u' THEN {'c': s2.c + 5 * truncated::BIGINT, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)} END,
                CASE WHEN NOT dead THEN {'c': s2.c + 1 + 5 * truncated::BIGINT, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)} END]) AS x0,
      list_min([{'c': s1.c + 2, 'a': 'D' || s1.a, 'r': s1.r}, CASE WHEN NOT dead AND role[1] = 'u' THEN {'c': s2.c + 5 * truncated::BIGINT, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)} END,
                CASE WHEN NOT dead THEN {'c': s2.c + 1 + 5 * truncated::BIGINT, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)} END]) AS x1,
      list_min([{'c': s2.c + 2, 'a': 'D' || s2.a, 'r': s2.r}, CASE WHEN NOT dead AND role[1] = 'a' THEN {'c': s3.c + 5 * truncated::BIGINT, 'a': 'K' || s3.a, 'r': list_prepend(role || ':' || text, s3.r)} END,
                CASE WHEN NOT dead THEN {'c': s3.c + 1 + 5 * truncated::BIGINT, 'a': 'R' || s3.a, 'r': list_prepend('assistant:' || text, s3.r)} END]) AS x2,
      list_min([{'c': s3.c + 2, 'a': 'D' || s3.a, 'r': s3.r}, CASE WHEN NOT dead AND role[1] = 'u' THEN {'c': s2.c + 5 * truncated::BIGINT, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)} END,
                CASE WHEN NOT dead THEN {'c': s2.c + 1 + 5 * truncated::BIGINT, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)} END]) AS x3
    FROM b JOIN h ON h.conv_id IS NOT DISTINCT FROM b.conv_id AND h.i = b.i - 1))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1
"""
