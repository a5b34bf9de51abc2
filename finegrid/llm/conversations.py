"""Repair of damaged conversations: the cheapest edits that restore the alternation of roles.

A conversation should read ``system? (user assistant)+`` or be empty.  What was said so far puts it in one of four
states (nothing, after system, after user, after assistant), so the cheapest edits of a run of rows, from a state to a
state, are a 4 x 4 matrix.  Hirschberg's scheme finds them in linear space: four costs forward over the first half and
four costs backward over the second half meet in the middle, the best state there is fixed, and both halves go the
same way.  Long conversations are split into blocks; blocks combine by their matrices first, so no task ever holds a
whole one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from finegrid.llm.common import kept_in_worker, saved, type_of

#: Rows and bytes of text that a block holds at most (a single row may be longer), and blocks that combine into one.
BLOCK_ROWS, BLOCK_BYTES, FAN = 2048, 1 << 22, 512
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
NONE = 1 << 60

#: States: nothing yet, after system, after user, after assistant.  `ADDS[s]` is what an insertion or new role adds there.
START, SYSTEM, USER, ASSISTANT = range(4)
ADDS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)


# --- one row's choices --------------------------------------------------------------------------------------------------

def _kept(state: int, initial: str) -> int | None:
    """State after a row that keeps a role with this initial."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def kind_of(initial: str, must_go: bool, truncated: bool) -> str:
    """A row in one letter: ``x`` if it must go, else the initial of its role (``-`` if that is none of s, u, a), in upper case (``_``) if it is truncated."""
    if must_go:
        return "x"
    kind = initial if initial and initial in "sua" else "-"
    return (kind.upper() if kind != "-" else "_") if truncated else kind


def moves(kind: str) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, letters)`` for every way past a row: insertions before it, then its own edit.

    More than two insertions in a row only repeat a state.  Of equal costs the letters that come first.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    more = TRUNCATED if kind.isupper() or kind == "_" else 0

    def way(a: int, b: int | None, cost: int, letters: str) -> None:
        if b is not None:
            best[a, b] = min(best.get((a, b), (NONE, "")), (cost, letters))

    for state in range(4):
        now, cost, letters = state, 0, ""
        for _ in range(3):
            way(state, now, cost + DELETE, letters + "D")
            if kind != "x":
                way(state, _kept(now, kind.lower()), cost + KEEP + more, letters + "K")
                way(state, ADDS[now], cost + REROLE + more, letters + "R")
            now, cost, letters = ADDS[now], cost + INSERT, letters + "I"
    return [(a, b, cost, letters) for (a, b), (cost, letters) in sorted(best.items())]


def closing(state: int) -> tuple[int, str]:
    """``(cost, letters)`` of the insertions after the last row that make the conversation whole."""
    letters = ""
    while state not in ENDS:
        state, letters = ADDS[state], letters + "I"
    return len(letters) * INSERT, letters


# --- the four-state vectors ---------------------------------------------------------------------------------------------

# A vector holds a (cost, rank) per state.  Forward, rank orders the cheapest edits that end in the states; edits up to
# the same row are never one the beginning of the other, as each ends with the row's own letter, so an earlier
# difference decides for whole scripts.  Backward, rank orders the cheapest edits that begin in the states.
Vector = tuple[tuple[int, int], ...]
Matrix = tuple[Vector, ...]


def ranked(found: list[tuple | None]) -> Vector:
    """``(cost, key)`` per state -> ``(cost, rank of the key)``."""
    keys = sorted({f[1] for f in found if f is not None})
    return tuple((NONE, 0) if f is None else (f[0], keys.index(f[1])) for f in found)


def only(state: int) -> Vector:
    return tuple((0 if s == state else NONE, 0) for s in range(4))


def finish() -> Vector:
    """Backward vector after the last row."""
    return ranked([closing(s) for s in range(4)])


def crossing(left: Vector, right: Vector) -> int:
    """The state in the middle on the cheapest way, of equal ways the one whose letters come first."""
    return min((s for s in range(4) if left[s][0] < NONE and right[s][0] < NONE), key=lambda s: (left[s][0] + right[s][0], left[s][1], right[s][1]))


class Steps:
    """Vectors past one row, remembered: few of them ever occur.  The memory is emptied when it is full."""

    def __init__(self, most: int = 1 << 16):
        self.most = most
        self.moves: dict[str, list[tuple[int, int, int, str]]] = {}
        self.known: dict[tuple, Vector] = {}

    def ways(self, kind: str) -> list[tuple[int, int, int, str]]:
        if kind not in self.moves:
            self.moves[kind] = moves(kind)
        return self.moves[kind]

    def past(self, vector: Vector, kind: str, ahead: bool) -> tuple[int, Vector]:
        """The vector past a row, forward or backward, as (cost taken off all states, rest), so that it recurs."""
        key = vector, kind, ahead
        if key not in self.known:
            best: list[tuple | None] = [None] * 4
            for a, b, cost, letters in self.ways(kind):
                at, to = (a, b) if ahead else (b, a)
                if vector[at][0] < NONE:
                    candidate = vector[at][0] + cost, (vector[at][1], letters) if ahead else (letters, vector[at][1])
                    best[to] = candidate if best[to] is None else min(best[to], candidate)
            least = min(f[0] for f in best if f is not None)
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = least, ranked([None if f is None else (f[0] - least, f[1]) for f in best])
        return self.known[key]

    def over(self, vector: Vector, kinds: str, ahead: bool) -> tuple[int, Vector]:
        """The vector past a run of rows: (cost taken off, rest)."""
        total = 0
        for kind in kinds if ahead else reversed(kinds):
            cost, vector = self.past(vector, kind, ahead)
            total += cost
        return total, vector

    def audit(self, kinds: str, first: int, last: Vector) -> Iterator[str]:
        """Letters of the cheapest edits of ``kinds`` from state ``first`` to what ``last``, a backward vector, values; row by row.

        The letters after the last row are not among them.  Halves are worked through from a stack, so the space is
        one vector per level of halving.
        """
        waiting = [(0, len(kinds), first, last)]
        while waiting:
            a, z, state, end = waiting.pop()
            if z - a == 1:
                yield min((cost + end[b][0], letters, end[b][1]) for s, b, cost, letters in self.ways(kinds[a]) if s == state and end[b][0] < NONE)[1]
            elif z > a:
                middle = (a + z) // 2
                at = crossing(self.over(only(state), kinds[a:middle], True)[1], self.over(end, kinds[middle:z], False)[1])
                waiting += [(middle, z, at, end), (a, middle, state, only(at))]

    def matrix(self, kinds: str) -> Matrix:
        """Forward vectors over the rows from each state."""
        found = [self.over(only(state), kinds, True) for state in range(4)]
        return tuple(tuple((c + cost if c < NONE else NONE, rank) for c, rank in vector) for cost, vector in found)


# --- blocks of rows -----------------------------------------------------------------------------------------------------

def through(vector: Vector, block: Matrix) -> Vector:
    """A forward vector past a block."""
    best: list[tuple | None] = [None] * 4
    for a, b in product(range(4), range(4)):
        if vector[a][0] < NONE and block[a][b][0] < NONE:
            candidate = vector[a][0] + block[a][b][0], (vector[a][1], block[a][b][1])
            best[b] = candidate if best[b] is None else min(best[b], candidate)
    return ranked(best)


def crossings(blocks: list[Matrix], first: int, last: int) -> list[int]:
    """States before each block and after the last, on the best way from ``first`` to ``last``: the same scheme over blocks.

    Backward costs need no ranks here, as ways to different states in the middle differ before it.
    """
    out = {0: first, len(blocks): last}
    waiting = [(0, len(blocks))]
    while waiting:
        a, z = waiting.pop()
        if z - a < 2:
            continue
        middle = (a + z) // 2
        left = only(out[a])
        for block in blocks[a:middle]:
            left = through(left, block)
        costs = [0 if s == out[z] else NONE for s in range(4)]
        for block in reversed(blocks[middle:z]):
            costs = [min(NONE, *(block[s][t][0] + costs[t] for t in range(4))) for s in range(4)]
        out[middle] = crossing(left, tuple((c, 0) for c in costs))
        waiting += [(a, middle), (middle, z)]
    return [out[i] for i in range(len(blocks) + 1)]


def pack(m: Matrix) -> list[int]:
    return [x for vector in m for pair in vector for x in pair]


def unpack(v: list[int]) -> Matrix:
    return tuple(tuple((v[8 * a + 2 * b], v[8 * a + 2 * b + 1]) for b in range(4)) for a in range(4))


def edited(state: int, letters: str, roles: list[str], texts: list[str]) -> tuple[int, list[str], list[str]]:
    """``(state, roles, texts)`` after the edits; every letter but an insertion takes the next row."""
    at, new_roles, new_texts = 0, [], []
    for letter in letters:
        if letter != "D":
            state = _kept(state, roles[at][:1]) if letter == "K" else ADDS[state]
            new_roles.append(roles[at] if letter == "K" else NAMES[state])
            new_texts.append("" if letter == "I" else texts[at])
        at += letter != "I"
    return state, new_roles, new_texts


# --- tables -------------------------------------------------------------------------------------------------------------

WHITE = r"\x20\x09-\x0D"


def plain(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, n)``: rows as they are, nulls in role and text as one space, ``n`` = 1."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), s(role_col).alias("role"), s(text_col).alias("text"), F.lit(1).cast("long").alias("n"))


def damaged(df: DataFrame, **columns) -> DataFrame:
    """`plain` rows after the fixed damage: ``n`` counts a row's adjacent copies; dropped rows are gone."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = plain(df, **columns).withColumn("case", F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn")).cast("binary")) % 20).filter("case <> 0")
    case = F.col("case")
    text = F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(case == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(case == 3, F.col("n") * 2).otherwise(F.col("n")).alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n, blank, first, truncated)``: equal rows folded to one with their number ``n``.

    ``first``: nobody said this text in this role before, so all but one of the ``n`` are duplicates; else all are.
    """
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    last = F.regexp_extract("text", rf"([^{WHITE}])[{WHITE}]*\z", 1)
    folded = saved(folded.select("*", F.sha2("text", 256).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated")), "rows")
    times = folded.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("k"), F.count("turn").alias("numbered"), F.min("turn").alias("low")).filter("k > 1")
    times = times.select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("digest").alias("d_"), F.when(F.col("numbered") == F.col("k"), F.col("low")).alias("low"))  # null if a row has no turn: it comes first
    again = folded.join(times, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("digest") == F.col("d_")), "left")
    return again.select("conv_id", "turn", "role", "text", "n", "blank", (F.col("d_").isNull() | F.col("low").eqNullSafe(F.col("turn"))).alias("first"), "truncated")


BLOCK = "part int, chunk int, kinds string, illegal long, head string, tail string, roles array<string>, texts array<string>"


def blocks(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(conv_id, part, chunk, kinds, illegal, head, tail, roles, texts)``: runs of a conversation's rows, by turn (nulls first), role and text.

    Rows are dealt out by range, so a long conversation is cut between tasks as well; (part, chunk) orders its blocks.
    ``head`` and ``tail`` are the first and last initial; texts of rows that must go are left out.
    """

    def run(batches):
        part, chunk, size, now = TaskContext.get().partitionId(), 0, 0, None
        kinds, initials, roles, texts = [], [], [], []

        def out() -> pa.RecordBatch:
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            made = [pa.array([now], kind), pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array(["".join(kinds)]), pa.array([illegal], pa.int64()), pa.array(initials[:1]), pa.array(initials[-1:]), pa.array([roles], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string()))]
            for held in (kinds, initials, roles, texts):
                held.clear()
            return pa.RecordBatch.from_arrays(made, ["conv_id", "part", "chunk", "kinds", "illegal", "head", "tail", "roles", "texts"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 512):
                for conv, role, text, n, blank, first, truncated in zip(*(c.slice(lo, 512).to_pylist() for c in batch.columns)):
                    if kinds and now != conv:
                        yield out()
                    if now != conv:
                        chunk, size = 0, 0
                    now = conv
                    for i in range(n):
                        must_go = blank or not first or i > 0
                        more = 0 if must_go else len(text)
                        if len(kinds) >= most_rows or kinds and size + more > most_bytes:
                            yield out()
                            chunk, size = chunk + 1, 0
                        kinds.append(kind_of(role[:1], must_go, truncated))
                        initials.append(role[:1])
                        roles.append(role)
                        texts.append("" if must_go else text)
                        size += more
        if kinds:
            yield out()

    turn = F.col("turn").asc_nulls_first()
    dealt = rows.withColumn("__head", F.substring("text", 1, 32)).repartitionByRange("conv_id", turn, "role", "__head")
    ordered = dealt.sortWithinPartitions("conv_id", turn, "role", "text").select("conv_id", "role", "text", "n", "blank", "first", "truncated")
    return ordered.mapInArrow(run, f"conv_id {type_of(rows, 'conv_id')}, {BLOCK}")


def mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """``make(*row)`` of every row yields tuples of the columns of ``schema``."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                made = [r for row in zip(*(c.slice(lo, 512).to_pylist() for c in batch.columns)) for r in make(*row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(fields)], schema=fields)

    return df.mapInArrow(run, schema)


def _steps() -> Steps:
    return kept_in_worker("conversation steps", Steps)


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(table: DataFrame, fan: int = FAN) -> DataFrame:
    """``(conv_id, part, chunk, at, enter, leave, last)`` of the blocks of conversations that have several; ``leave`` is null for the last.

    Going up, ``fan`` blocks become one by their matrices, until each conversation is one; going down, the states
    around a block are handed to the blocks that it was made of.
    """
    conv = type_of(table, "conv_id")
    many = table.groupBy("conv_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("conv_id").alias("c_"))
    split = table.join(many, same("conv_id", "c_"), "left_semi").select("conv_id", "part", "chunk", "kinds")
    now = saved(mapped(split, lambda c, p, k, kinds: [(c, p, k, pack(_steps().matrix(kinds)))], f"conv_id {conv}, part int, chunk int, m array<long>"), "matrices")
    each = now.groupBy("conv_id", "part").agg(F.count("*").alias("k"))  # a row per conversation and task
    before = F.coalesce(F.sum("k").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = each.select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), before.alias("before"))
    placed = now.join(offsets, same("conv_id", "c_") & (F.col("part") == F.col("p_")))
    levels = [saved(placed.select("conv_id", (F.col("before") + F.col("chunk")).alias("at"), "m", "part", "chunk"), "level")]

    def joined(c, at, ms):
        total = unpack(ms[0])
        for m in ms[1:]:
            total = tuple(through(vector, unpack(m)) for vector in total)
        return [(c, at, pack(total))]

    def handed(c, ats, ms, enter, leave, last):
        states = crossings([unpack(m) for m in ms], enter, leave)
        return [(c, at, a, b, last and at == ats[-1]) for at, a, b in zip(ats, states, states[1:])]

    def ended(c, at, m):
        ways = [(cost + closing(s)[0], rank, s) for s, (cost, rank) in enumerate(unpack(m)[START]) if cost < NONE]
        return [(c, at, START, min(ways)[2], True)]

    def families(level: DataFrame) -> DataFrame:  # fan blocks at most
        up = F.floor(F.col("at") / fan).cast("long").alias("up")
        return level.groupBy("conv_id", up).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("b")).select("conv_id", "up", F.col("b.at").alias("ats"), F.col("b.m").alias("ms"))

    while levels[-1].filter("at > 0").limit(1).count():
        levels.append(saved(mapped(families(levels[-1]).select("conv_id", "up", "ms"), joined, f"conv_id {conv}, at long, m array<long>"), "level"))
    states = f"conv_id {conv}, at long, enter int, leave int, last boolean"
    given = mapped(levels[-1].select("conv_id", "at", "m"), ended, states)
    for level in reversed(levels[:-1]):
        own = given.select(F.col("conv_id").alias("c_"), F.col("at").alias("a_"), "enter", "leave", "last")
        family = families(level).join(own, same("conv_id", "c_") & (F.col("up") == F.col("a_"))).select("conv_id", "ats", "ms", "enter", "leave", "last")
        given = saved(mapped(family, handed, states), "handed")
    named = levels[0].select(F.col("conv_id").alias("c_"), F.col("at").alias("a_"), "part", "chunk")
    return given.join(named, same("conv_id", "c_") & (F.col("at") == F.col("a_"))).select("conv_id", "part", "chunk", "at", "enter", "leave", "last")


def repaired_blocks(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """``(conv_id, part, chunk, at, single, illegal, head, tail, cost, audit, roles, texts)``: blocks of the repaired conversations.

    ``audit`` has a letter per edit; ``at`` numbers the blocks of a conversation that has several.
    """
    conv = type_of(rows, "conv_id")
    table = saved(blocks(rows, most_rows, most_bytes), "blocks")
    where = saved(plan(table, fan), "plan").withColumnsRenamed({"conv_id": "c_", "part": "p_", "chunk": "k_"})
    met = table.join(where, same("conv_id", "c_") & (F.col("part") == F.col("p_")) & (F.col("chunk") == F.col("k_")), "left")

    def repair(c, part, chunk, at, enter, leave, last, illegal, head, tail, kinds, roles, texts):
        closes = last is None or last
        state = START if enter is None else enter
        words = list(_steps().audit(kinds, state, finish() if leave is None else only(leave)))
        letters = "".join(words)
        state, new_roles, new_texts = edited(state, letters, roles, texts)
        cost = sum({"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[x] for x in letters)
        cost += TRUNCATED * sum(word[-1] != "D" and (kind.isupper() or kind == "_") for word, kind in zip(words, kinds))
        if closes:
            more, tail_letters = closing(state)
            _, added, empty = edited(state, tail_letters, [], [])
            letters, cost, new_roles, new_texts = letters + tail_letters, cost + more, new_roles + added, new_texts + empty
        return [(c, part, chunk, at, at is None, illegal, head, tail, cost, letters, new_roles, new_texts)]

    chosen = met.select("conv_id", "part", "chunk", "at", "enter", "leave", "last", "illegal", "head", "tail", "kinds", "roles", "texts")
    return saved(mapped(chosen, repair, f"conv_id {conv}, part int, chunk int, at long, single boolean, illegal long, head string, tail string, cost long, audit string, roles array<string>, texts array<string>"), "repaired")


def repaired(df: DataFrame, **columns) -> DataFrame:
    """``(conv_id, part, chunk, place, role, text)``: the rows of the repaired conversations, in the order of (part, chunk, place).

    ``df`` is taken as it is, without the fixed damage; the treatment of nulls, repeats and ties is that of `report`.
    """
    found = repaired_blocks(judged(plain(df, **columns)))
    return found.select("conv_id", "part", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")).select("conv_id", "part", "chunk", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def _digests(found: DataFrame) -> DataFrame:
    """``(conv_id, audit, repaired_sha256)``; a conversation of several blocks streams through one task in order, as its digest and its audit demand, a block at a time."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    alone = found.filter("single").select("conv_id", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    several = found.filter("NOT single").select("conv_id", "part", "chunk", "audit", F.size("roles").alias("n"), lines.alias("lines"))
    ordered = several.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")

    def run(batches):
        now, digest, letters, started, kind = None, None, [], False, pa.null()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(batch.num_rows):
                conv, _, _, audit, n, text = (c[lo].as_py() for c in batch.columns)
                if digest is None or conv != now:
                    if digest is not None:
                        yield out()
                    now, digest, letters, started = conv, hashlib.sha256(), [], False
                letters.append(audit)
                if n:
                    digest.update(("\n" * started + text).encode("utf-8"))
                    started = True
        if digest is not None:
            yield out()

    return alone.unionByName(ordered.mapInArrow(run, alone.schema))


def report(df: DataFrame, rows: DataFrame, conv_col: str = "conv_id", most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every conversation of ``df``, ``rows`` being its (damaged) rows.

    A null conversation is one of its own.  Null roles and texts are one space, so a row without a text is blank; a
    role that begins with none of s, u, a can't be kept.  Rows go by turn (nulls first), of equal turns by role and
    text; equal rows stand side by side, and all but the first are duplicates.  A conversation without rows has
    zeros, an empty audit and the digest of an empty string; an empty table gives an empty one.
    """
    facts = saved(judged(rows), "judged")
    own = F.when(F.col("blank"), F.lit(0)).otherwise(F.when(F.col("first"), F.lit(1)).otherwise(F.lit(0)))
    counts = facts.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(F.lit(0))).alias("blank"),
        F.sum(F.when(F.col("blank"), F.lit(0)).otherwise(F.col("n") - own)).alias("duplicate"), F.sum(F.when(F.col("truncated"), own).otherwise(F.lit(0))).alias("truncated"))
    found = repaired_blocks(facts, most_rows, most_bytes, fan)
    inside = found.groupBy("conv_id").agg(F.sum("illegal").alias("inside"), F.sum("cost").alias("cost"))
    ahead = found.filter("NOT single").select("conv_id", F.col("at").alias("a_"), "tail")
    behind = found.filter("NOT single").select(F.col("conv_id").alias("c_"), (F.col("at") - 1).alias("b_"), "head")
    pair = F.concat("tail", "head").isin("su", "ua", "au")
    edges = ahead.join(behind, same("conv_id", "c_") & (F.col("a_") == F.col("b_"))).groupBy("conv_id").agg(F.sum(F.when(pair, F.lit(0)).otherwise(F.lit(1))).alias("edges"))
    out = df.select(F.col(conv_col).alias("id_")).distinct()
    for table in (counts, inside, edges, _digests(found)):
        out = out.join(table, same("id_", "conv_id"), "left").drop("conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(F.col("id_").alias(conv_col), *[zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")], (zero(F.col("inside")) + zero(F.col("edges"))).alias("illegal"), zero(F.col("cost")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged_report(df: DataFrame, **options) -> DataFrame:
    """`report` of the conversations after the fixed damage."""
    return report(df, damaged(df), **options)
