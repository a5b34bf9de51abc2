"""Whitening, packing and conversation repair against plain versions, with nulls, ties, repeats, empty tables and clashing names."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from finegrid.llm import bidiagonal, conversations, packing, queries, toxicity, whitening
from finegrid.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- whitening -------------------------------------------------------------------------------------------------------

def factor(a):
    r = np.linalg.qr(a, mode="r")
    return np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])


RNG = np.random.default_rng(5)
TURN = np.linalg.qr(RNG.normal(size=(30, 30)))[0]
MATRICES = {
    "noise": RNG.normal(size=(900, 64)), "graded": RNG.normal(size=(200, 30)) * 10.0 ** -np.arange(30), "graded up": RNG.normal(size=(200, 30)) * 10.0 ** (np.arange(30) - 20),
    "rank three": RNG.normal(size=(90, 3)) @ RNG.normal(size=(3, 20)), "few rows": RNG.normal(size=(4, 20)), "equal": np.eye(30) @ TURN, "two values": np.diag([5.0] * 10 + [1.0] * 20) @ TURN,
    "cluster": np.diag(np.r_[5 + 1e-9 * np.arange(10), np.ones(20)]) @ TURN, "one": RNG.normal(size=(9, 1)), "nothing": np.zeros((5, 4)), "outlier": np.r_[RNG.normal(size=(300, 40)), [np.full(40, 1e6)]],
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values(name):
    a = MATRICES[name]
    squares, vectors = bidiagonal.right_singular(factor(a), 16)
    k, top = len(squares), max(1e-300, (a * a).sum())
    want = np.r_[np.linalg.svd(a, compute_uv=False) ** 2, np.zeros(a.shape[1])][:k]
    assert k == min(16, a.shape[1]) and np.abs(squares - want).max() <= 1e-13 * top
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors.T) - vectors.T * squares).max() <= 1e-12 * top


def whitening_check(got, ids, vectors, k):
    """Rows of the contract, from numpy's eigenvalues of the covariance over the different vectors."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    different = sorted(set(map(tuple, x)))
    n, sums = len(different), [sum(c) for c in zip(*different)]
    y = np.array([[n * c - s for c, s in zip(v, sums)] for v in different], float) / n
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    by = {}
    for r in got:
        by.setdefault((r[0], r[3]), {})[r[1]] = r
    assert len(got) == k * len(ids)
    flips = np.zeros(k)
    for i, v in zip(ids, x):
        moved = [n * c - s for c, s in zip(v, sums)]
        rows = by[i, sum(m * m for m in moved)]
        want = np.array(moved, float) / n @ axes
        for c in range(k):
            r = rows[c + 1]
            assert r[2] == n and abs(r[5] - values[c] / np.trace(cov)) < 1e-9 and r[6] < 1e-9
            w = want[c] / math.sqrt(values[c])
            flips[c] = flips[c] or (np.sign(w * r[4]) if abs(w) > 1e-3 else 0)
            assert abs(w - r[4] * (flips[c] or 1)) < 1e-7


def test_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    whitening_check([tuple(r) for r in queries.op11_whitening(spark, SF).collect()], *zip(*rows), 16)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(2)
    good = [(i, [rng.uniform(-9, 9) for _ in range(3)]) for i in range(40)]
    good += [(7, good[7][1]), (None, good[3][1]), (99, good[3][1])]  # repeats and a null id
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in good + bad], "vec_id long, embedding array<double>, n int, x string, component int")
    got = [tuple(r) for r in whitening.whitened(df.repartition(7)).collect()]
    whitening_check(got, *zip(*good), 3)
    assert whitening.whitened(df.limit(0)).collect() == []
    flat = whitening.whitened(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0]), (3, [1e300])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat) == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None), (2, 1, 1, 0, None, None, None), (2, 2, 1, 0, None, None, None), (3, 1, 1, 0, None, None, None)]
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) and (r.component == 2 or abs(r.explained - 1) < 1e-12) for r in line)


def test_exact_beyond_64_bits():
    x = np.array([[1 << 61, 5], [-(1 << 61), 6]], np.int64)
    d = whitening.moved(x, 3, [0, 11])
    assert d.tolist() == [[3 << 61, 4], [-(3 << 61), 7]] and whitening.squares(d) == [None, None]
    assert whitening.squares(np.array([[3_000_000_000, 0]])) == [9 * 10 ** 18]


def test_many_tasks_join_their_results(spark):
    rows = spark.range(3000).select(F.array(F.col("id") % 50, F.col("id") % 7, F.lit(1_000_000_000)).alias("x")).repartition(90)
    n, sums = whitening.totals(rows)[3]
    assert n == 3000 and sums == [sum(i % 50 for i in range(3000)), sum(i % 7 for i in range(3000)), 3_000_000_000_000]


# --- packing ---------------------------------------------------------------------------------------------------------

def test_rule_takes_the_least_sum_of_squares():
    """Each placement against every open gap tried in turn."""
    rng = random.Random(3)
    rule, held, where = packing.SumOfSquares(30), {}, {}
    for _ in range(400):
        size = rng.randint(1, 30)
        before = dict(held)
        gaps = [g for g in before if g >= size and before[g]]
        cost = lambda g: sum(({**before, g: before[g] - 1} | ({g - size: before.get(g - size, 0) + 1} if g > size else {})).get(h, 0) ** 2 for h in range(1, 31))  # noqa: E731,B023
        sequence, offset = rule.place(size)
        gap = 30 - offset
        assert offset == where.get(sequence, 0)
        if gaps:
            assert gap in gaps and cost(gap) == min(map(cost, gaps)) and gap == min(g for g in gaps if cost(g) == cost(gap))
            held[gap] -= 1
        else:
            assert offset == 0
        where[sequence] = offset + size
        if gap > size:
            held[gap - size] = held.get(gap - size, 0) + 1


def packing_check(got, docs, capacity, end):
    """Every document's pieces, in full, and sequences without gaps."""
    tokenizer, want = Tokenizer.from_file(WORDS), []
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        want += [(i, k, a, len(ids[a:a + capacity]), zlib.crc32(np.array(ids[a:a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    at = {}
    for r in sorted(got, key=lambda r: (r[5], r[6])):
        assert r[6] == at.get(r[5], 0)
        at[r[5]] = r[6] + r[3]
    assert max(at.values()) <= capacity
    return len(at), -(-sum(r[3] for r in got) // capacity)


def test_packing(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    used, least = packing_check([tuple(r) for r in queries.op12_best_fit_packing(spark, SF).collect()], docs, 2048, 0)
    assert used <= least + 1
    several = packing.packed_documents(table(spark, SF, "documents"), WORDS, capacity=256, per_task=100)  # rounds of open sequences
    used, least = packing_check([tuple(r) for r in several.collect()], docs, 256, 0)
    assert used <= 1.02 * least


def test_packing_of_odd_rows(spark):
    docs = [(1, "one two three"), (1, "one two three"), (None, "four"), (2, None), (3, ""), (4, "  \n"), (5, "word. " * 3000), (6, "x" * 20000), (7, "Émile é"), (7, "other")] + [(8, "same")] * 300
    df = spark.createDataFrame([(*d, 5, "s", 1) for d in docs], "doc_id long, text string, piece int, sequence_id string, length int")
    placed = packing.packed_documents(df, WORDS, end_id=3, capacity=40, per_task=50, keep_ids=True)
    used, least = packing_check([(*r[:5], r.sequence_id, r.offset) for r in placed.collect()], docs, 40, 3)
    assert used <= 1.1 * least
    whole = packing.sequences(placed).collect()
    assert len(whole) == used and sum(r.length for r in whole) == sum(len(r.ids) for r in whole)
    parts = {(r.sequence_id, r.offset): list(r.ids) for r in placed.collect()}
    assert all(list(r.ids) == sum((parts[r.sequence_id, s] for s in r.starts), []) for r in whole)
    assert packing.packed_documents(df.limit(0), WORDS).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 41), (2, None)], "i int, length int"), capacity=40)
    clashing = packing.pack(spark.createDataFrame([(1, 4, "a", "b"), (2, 36, "c", "d")], "i int, length int, offset string, sequence_id string"), capacity=40).collect()
    assert len({r.sequence_id for r in clashing}) == 1 and sorted((r.i, r.offset) for r in clashing) == [(1, 36), (2, 0)]


# --- conversations ---------------------------------------------------------------------------------------------------

def random_turns(rng, most):
    roles, texts = ["user", "assistant", "system", " ", "unknown", "tool", ""], ["a.", "b", "", "c!", " \t", "d?  ", "é"]
    return [(rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts)) for _ in range(rng.randint(0, most))]


def kinds_of(rows):
    seen, out = set(), ""
    for role, text in rows:
        dark = text.strip(" \t")
        out += conversations.kind_of(role[:1], not dark or (role, text) in seen, bool(dark) and dark[-1] not in ".!?")
        seen.add((role, text))
    return out


def test_audits_are_the_cheapest_and_the_least():
    rng, steps = random.Random(4), conversations.Steps(most=50)
    for _ in range(600):
        rows = random_turns(rng, 14)
        want = plain.repair_rows([1], [(1, i, *r) for i, r in enumerate(rows)])[0]
        letters = "".join(steps.audit(kinds_of(rows), conversations.START, conversations.finish()))
        state, _, _ = conversations.edited(conversations.START, letters, *map(list, zip(*rows))) if rows else (conversations.START, [], [])
        assert letters + conversations.closing(state)[1] == want[7]


def test_crossings_between_blocks_change_nothing():
    rng, steps = random.Random(6), conversations.Steps()
    for _ in range(200):
        kinds = kinds_of(random_turns(rng, 40))
        cuts = sorted({0, len(kinds), *(rng.randint(0, len(kinds)) for _ in range(6))})
        runs = [kinds[a:z] for a, z in zip(cuts, cuts[1:])]
        whole = steps.matrix(kinds)
        for last in range(4):
            if whole[0][last][0] >= conversations.NONE:
                continue
            states = conversations.crossings([steps.matrix(r) for r in runs], 0, last)
            parts = [x for r, a, z in zip(runs, states, states[1:]) for x in steps.audit(r, a, conversations.only(z))]
            assert parts == list(steps.audit(kinds, 0, conversations.only(last)))


def test_conversations(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").collect()]
    want = sorted(plain.repair_rows([r[0] for r in rows], plain.damaged_rows(rows)))
    assert sorted(map(tuple, queries.op13_conversation_repair(spark, SF).collect())) == want
    small = conversations.damaged_report(table(spark, SF, "conversations").repartition(5), most_rows=2, most_bytes=300, fan=2)
    assert sorted(map(tuple, small.collect())) == want


def test_odd_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t if rng.random() < 0.9 else None, r, x) for c in range(25) for t, (r, x) in enumerate(random_turns(rng, 9))]
    rows += [(None, 1, "user", "who."), (None, None, None, None), (77, None, "user", "x."), (77, None, "user", "y."), (88, 5, None, "z."), (88, 3, "user", None)]
    rows += [(99, t, "user" if t % 2 else "assistant", "w" * 3000 + f" {t}.") for t in range(60)] + [(66, 1, "user", "copy.")] * 50
    rows += [(66, t, "user", "copy.") for t in range(2, 40)] + [(c, 0, "user", "gone.") for c in range(1000, 1040)]
    df = spark.createDataFrame([(*r, "c", 1, True) for r in rows], "conv_id long, turn long, role string, text string, blank string, n int, first boolean")
    want = sorted(plain.repair_rows([r[0] for r in rows], plain.damaged_rows(rows)), key=repr)
    assert sorted(map(tuple, conversations.damaged_report(df).collect()), key=repr) == want
    assert sorted(map(tuple, conversations.damaged_report(df, most_rows=3, fan=2).collect()), key=repr) == want
    assert any(r[7] == "" and r[8].startswith("e3b0c442") for r in want)  # all rows dropped
    assert conversations.damaged_report(df.limit(0)).collect() == []


def test_repaired_rows_are_whole_conversations(spark):
    got = conversations.repaired(table(spark, SF, "conversations").filter("turn <> 1")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.part, r.chunk, r.place)):
        by.setdefault(r.conv_id, []).append(r.role)
    for roles in by.values():
        rest = roles[roles[0] == "system":]
        assert rest and rest == ["user", "assistant"] * (len(rest) // 2)


def test_toxicity_fit_keeps_no_set_of_words_per_row():
    pick = random.Random(5)
    words = [b"w%06d" % i for i in range(20_000)]
    rows = [(b" ".join(pick.sample(words, 3000) + [b"idiotic"] * (i % 10 == 0)), int(i % 10 == 0)) for i in range(150)]
    size = sum(len(text) for text, _ in rows)
    tracemalloc.start()
    try:
        model = toxicity.fit(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert toxicity._spell(b"idiotic") in model.toxic
    assert peak < 6 * size, (peak, size)
