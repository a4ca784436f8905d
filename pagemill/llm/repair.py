"""Conversation repair: the cheapest edits that make a conversation's roles a system turn at most and then user and assistant in turn.

A depth-first branch-and-bound search with an explicit stack decides each conversation, below the cost of a first guess. A prefix of edits is given up where
its cost and the suffix's lower bound reach the incumbent, or where the table of its node (row, state) has a prefix as cheap;
edits are tried in ASCII order, so that of prefixes as cheap the first one met is the ASCII-least, and the incumbent
(cost, audit) is proved optimal when the stack is empty. The bound is the cost of what is left where every few rows may begin
in the state that suits them best.

A conversation of any length is worked on in segments of SEGMENT rows, whose rows are coded in a byte each: each segment has
a table of its cheapest costs between states, tables are chained backwards to what the rest of the conversation costs from
each state, and the search runs within a segment from each state in which it may be entered. So no task holds a
conversation, and only the digest of its repaired text, which is one chain by nature, is made in one pass over its rows; that
pass streams them.

States are what the kept rows end with: 0 nothing, 1 system, 2 user, 3 assistant. Rows are in order of turn (nulls first);
rows of one turn by role and text. A null role, text or key counts as one space where it is read as text; turn stays null
for order and gaps, and rows of a null conv_id are one conversation. Repeated rows are duplicates of the first. Other columns
are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Costs of edits (fixed values).
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Codes of rows: the role initial's place here, and flags.
INITIALS = "sua"
OTHER, FALLEN, TRUNCATED = 3, 4, 8
#: A state takes these initials, and moves to the state after.
NEXT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
#: States in which a conversation may end.
ENDS = (0, 3)
#: Rows that a search decides at once, and rows after which its bound counts every state as the cheapest one.
SEGMENT, RELAXED = 128, 8
FAR = 1 << 40
SPACES, ENDINGS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"


def row_moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state, in ASCII order: Delete, Keep, Rerole."""
    found = [("D", DELETE, state)]
    if not code & FALLEN:
        cut = CUT if code & TRUNCATED else 0
        initial = code & 3
        if initial in NEXT[state]:
            found.append(("K", cut, NEXT[state][initial]))
        found += [("R", RENAME + cut, to) for initial, to in NEXT[state].items() if initial]
    return found


def insert_moves(state: int) -> list[tuple[int, int]]:
    """(cost, next state) of an inserted row: user or assistant as the state asks."""
    return [(INSERT, to) for initial, to in NEXT[state].items() if initial]


def cheapest_inserts() -> np.ndarray:
    """The cost from state to state of inserts alone."""
    table = np.full((4, 4), FAR)
    for a in range(4):
        table[a, a] = 0
    for _ in range(4):
        for a in range(4):
            for b in range(4):
                for cost, to in insert_moves(b):
                    table[a, to] = min(table[a, to], table[a, b] + cost)
    return table


INSERTS = cheapest_inserts()


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cheapest way through two tables of costs."""
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def row_table(code: int) -> np.ndarray:
    table = np.full((4, 4), FAR)
    for a in range(4):
        for _, cost, b in row_moves(code, a):
            table[a, b] = min(table[a, b], cost)
    return times(INSERTS, table)


_TABLES = {code: row_table(code).tolist() for code in range(16)}


def segment_table(codes: bytes) -> np.ndarray:
    """The cheapest costs of a segment's rows, inserts before each included, from state to state."""
    table = np.full((4, 4), FAR)
    np.fill_diagonal(table, 0)
    for code in codes:
        table = times(table, np.array(_TABLES[code]))
    return table


def end_costs() -> list[int]:
    """What it costs to end from each state, by inserts alone."""
    return [int(min(INSERTS[a, b] for b in ENDS)) for a in range(4)]


def lower_bounds(codes: bytes, rest: Sequence[int]) -> list[list[int]]:
    """For each place and state: the rows from there on, and what comes after them, cost at least so much.

    Exact to the next multiple of RELAXED rows, where every state counts as the cheapest one; so the bound falls short by
    what joining these pieces costs, and no more.
    """
    bounds = [list(rest)]
    for i in range(len(codes) - 1, -1, -1):
        after, table = bounds[-1], _TABLES[codes[i]]
        if (len(codes) - i - 1) % RELAXED == 0 and i < len(codes) - 1:
            after = [min(after)] * 4
        bounds.append([min(x + y for x, y in zip(row, after, strict=True)) for row in table])
    return bounds[::-1]


def first_cost(codes: bytes, state: int, bounds: list[list[int]], last: bool) -> int:
    """What it costs to take the edit of the least bound each time."""
    i, cost, n = 0, 0, len(codes)
    while i < n or (last and state not in ENDS):
        moves = [(c, i + 1, to) for _, c, to in (row_moves(codes[i], state) if i < n else [])] + [(c, i, to) for c, to in insert_moves(state)]
        c, i, state = min(moves, key=lambda m: (m[0] + bounds[m[1]][m[2]], -m[1]))
        cost += c
    return cost + (0 if last else bounds[n][state])


def search(codes: bytes, state: int, rest: Sequence[int], last: bool) -> tuple[int, str, int] | None:
    """(cost, audit, state after) of the cheapest, of these the ASCII-least edits from a state, where `rest` is what the conversation costs from each state after; last: inserts may end it."""
    n = len(codes)
    bounds = lower_bounds(codes, rest)
    table: dict[tuple[int, int], int] = {}
    incumbent: tuple[int, str, int] | None = None
    limit = first_cost(codes, state, bounds, last) + 1  # what is as cheap as the first guess may have a lesser audit
    audit: list[str] = []
    stack: list[tuple[int, int, int, int, str]] = [(0, state, 0, 0, "")]  # row, state, cost, depth, edit
    while stack:
        i, at, cost, depth, edit = stack.pop()
        del audit[max(0, depth - 1) :]
        if edit:
            audit.append(edit)
        if cost + bounds[i][at] >= limit:
            continue
        if table.get((i, at), FAR) <= cost:
            continue
        table[i, at] = cost
        if i == n and (not last or at in ENDS):
            total = cost + (0 if last else rest[at])
            if total < limit:
                incumbent, limit = (total, "".join(audit), at), total
            if not last:
                continue
        moves = [(edit, i + 1, c, to) for edit, c, to in (row_moves(codes[i], at) if i < n else [])]
        if i < n or last:
            moves += [("I", i, c, to) for c, to in insert_moves(at)]
        for edit, j, c, to in sorted(moves, reverse=True):  # the ASCII-least comes off the stack first
            stack.append((j, to, cost + c, depth + 1, edit))
    return incumbent


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` deals."""
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    dealt = own.withColumn("fate", F.crc32(key) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", f"[{ENDINGS}]", "")).otherwise(F.col("text"))
    times_ = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.select("conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times_).alias("copy"))


SEGMENTS = "part int, at long, n int, codes binary, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, head int, tail int"


def to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, seq, conv_id, turn, code, fault) in order -> a row for each run of up to SEGMENT rows of a conversation in a part."""
    rows: list[tuple] = []
    now: list[tuple] = []

    def close() -> None:
        if not now:
            return
        codes = bytes(r[4] for r in now)
        turns = [r[3] for r in now if r[3] is not None]
        initials = [c & 3 for c in codes]
        illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:], strict=False))
        faults = [r[5] for r in now]
        rows.append((now[0][2], now[0][0], now[0][1], len(now), codes, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), *(faults.count(k) for k in (1, 2, 3)), illegal, initials[0], initials[-1]))
        now.clear()

    def out() -> pa.RecordBatch:
        names = ["conv_id", *(x.split()[0] for x in SEGMENTS.split(", "))]
        kinds = [pa.int64(), *({"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SEGMENTS.split(", "))]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(cols, names=names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "conv_id", "turn", "code", "fault")), strict=True):
            if now and (now[0][2] != row[2] or now[0][0] != row[0] or len(now) == SEGMENT):
                close()
            now.append(row)
        if rows:
            yield out()
    close()
    yield out()


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with `table`, each conversation's from its last to its first -> part, at, and for each state of entry: cost, state after, audit."""
    ends = end_costs()
    conv, rest = object(), ends
    for batch in batches:
        cost, after, audits = [], [], []
        for one, codes, table, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "table", "first")), strict=True):
            if last := one != conv:
                conv, rest = one, ends
            found = [search(codes, s, [0 if s in ENDS else ends[s] for s in range(4)] if last else rest, last) if s == 0 or not first else None for s in range(4)]
            cost.append([f[0] if f else None for f in found])
            after.append([f[2] if f else None for f in found])
            audits.append([f[1] if f else None for f in found])
            rest = [int(min(FAR, x)) for x in (np.array(table).reshape(4, 4) + np.array(rest)[None]).min(1)]
        cols = [pa.array(cost, pa.list_(pa.int64())), pa.array(after, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("at"), *cols], names=["conv_id", "part", "at", "costs", "after", "audits"])


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, each segment's row before its texts -> a row for each conversation; texts are hashed as they pass."""
    done: list[tuple] = []
    conv, open_ = None, False
    state = entered = 0
    counts, turns, audits, tail, cost = [0] * 4, [None, None, 0], [], None, None
    digest, first = hashlib.sha256(), True
    edits, k = "", 0

    def write(line: str) -> None:
        nonlocal first
        digest.update(line.encode() if first else b"\n" + line.encode())
        first = False

    def apply(row: tuple[str, str] | None) -> None:
        """Edits up to and with that of the row; without one, those left at the end."""
        nonlocal k, entered
        while k < len(edits):
            edit = edits[k]
            if edit != "I" and row is None:
                return
            k += 1
            if edit == "D":
                return
            role, text = row if edit != "I" else ("", "")
            if edit != "K":
                role = "assistant" if entered == 2 else "user"
            entered = NEXT[entered][INITIALS.index(role[0])]
            write(f"{role}:{text}")
            if edit != "I":
                return

    def close() -> None:
        if open_:
            apply(None)
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[0] is not None else 0
            done.append((conv, gaps, *counts, cost or 0, "".join(audits), digest.hexdigest()))

    def out() -> pa.RecordBatch:
        kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in OUT.split(", ")]
        cols = [pa.array([r[j] for r in done], kind) for j, kind in enumerate(kinds)]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in OUT.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if not open_ or row["conv_id"] != conv:
                close()
                conv, open_ = row["conv_id"], True
                state = entered = 0
                counts, turns, audits, tail, cost = [0] * 4, [None, None, 0], [], None, None
                digest, first, edits, k = hashlib.sha256(), True, "", 0
            if row["kind"] == 0:  # the conversation itself
                continue
            if row["kind"] == 1:  # a segment
                apply(None)
                entered = state
                edits, k = row["audits"][state], 0
                audits.append(edits)
                cost = row["costs"][state] if cost is None else cost  # of the whole conversation from its first segment on
                state = row["after"][state]
                pair = (tail, row["head"])
                counts = [a + row[c] for a, c in zip(counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                counts[3] += tail is not None and pair not in ((0, 1), (1, 2), (2, 1))
                tail = row["tail"]
                if row["first_turn"] is not None:
                    again = turns[1] == row["first_turn"]
                    turns = [row["first_turn"] if turns[0] is None else turns[0], row["last_turn"], turns[2] + row["turns"] - again]
                continue
            apply((row["role"], row["text"]))
        if done:
            yield out()
    close()
    yield out()


def repair_conversations(rows: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text, copy) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; original: also those of its conv_id that have no rows."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    seq = F.monotonically_increasing_id()
    kept = save(ranged.select("conv_id", "turn", "role", "text", F.shiftright(seq, 33).cast("int").alias("part"), seq.bitwiseAND((1 << 33) - 1).alias("seq")), "rows")

    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    keys = kept.select("part", "seq", "conv_id", "turn", "role", F.md5("text").alias("digest"), F.when(end == "", 1).when(~end.isin(*ENDINGS), 3).otherwise(0).alias("own"))
    same = ["conv_id", "role", "digest"]
    again = keys.groupBy(*same).agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    again = again.select(*[F.col(c).alias(f"a_{c}") for c in same], "first")
    on = F.col("conv_id").eqNullSafe(F.col("a_conv_id")) & (F.col("role") == F.col("a_role")) & (F.col("digest") == F.col("a_digest"))
    marked = keys.join(again, on, "left").withColumn("repeats", F.coalesce(F.struct("part", "seq") != F.col("first"), F.lit(False)))
    fault = F.when(F.col("own") == 1, 1).when(F.col("repeats"), 2).otherwise(F.col("own"))
    initial = F.expr(f"if(role = '', 0, locate(substring(role, 1, 1), '{INITIALS}'))")  # from 1; 0: none of them
    coded = marked.select("part", "seq", "conv_id", "turn", fault.alias("fault"), F.when(initial == 0, OTHER).otherwise(initial - 1).alias("initial"))
    coded = coded.withColumn("code", F.col("initial") + F.when(F.col("fault").isin(1, 2), FALLEN).when(F.col("fault") == 3, TRUNCATED).otherwise(0))
    placed = coded.select("part", "seq", "conv_id", "turn", F.col("code").cast("int").alias("code"), F.col("fault").cast("int").alias("fault")).repartition("part").sortWithinPartitions("part", "seq")
    segments = placed.mapInArrow(to_segments, f"conv_id long, {SEGMENTS}")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segment_table(c).ravel().tolist() for c in batch.column("codes").to_pylist()]
            yield batch.append_column("table", pa.array(found, pa.list_(pa.int64())))

    segments = save(segments.mapInArrow(tables, f"conv_id long, {SEGMENTS}, table array<long>"), "segments")
    first = segments.groupBy("conv_id").agg(F.min(F.struct("part", "at")).alias("least"))
    named = segments.join(first.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("first", F.struct("part", "at") == F.col("least"))
    backwards = named.select("conv_id", "part", "at", "codes", "table", "first").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("at"))
    solved = backwards.mapInArrow(solve, "conv_id long, part int, at long, costs array<long>, after array<int>, audits array<string>")
    whole = solved.drop("conv_id").join(segments.drop("codes", "table", "n"), ["part", "at"])

    def row(frame: DataFrame, kind: int, seq: str) -> DataFrame:
        """The columns of one stream of texts and what comes before them."""
        kinds = {"role": "string", "text": "string", "costs": "array<long>", "after": "array<int>", "audits": "array<string>", **{c: "long" for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")}, "head": "int", "tail": "int"}
        return frame.select("conv_id", F.col("part").cast("int").alias("part"), F.col(seq).alias("seq"), F.lit(kind).alias("kind"), *[(F.col(c) if c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    stream = row(whole, 1, "at").unionByName(row(kept.select("conv_id", "part", "seq", "role", "text"), 2, "seq"))
    if original is not None:
        every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("at"))
        stream = stream.unionByName(row(every, 0, "at"))
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind").mapInArrow(finish, OUT)
