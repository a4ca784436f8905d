"""Hard negatives, the n-gram Jaccard join and conversation repair against plain versions."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import jaccard, negatives, queries, repair

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(11)


def test_packed_products_are_exact():
    for span, dim in ((3, 1), (100, 64), (300, 64), (5000, 70), (1 << 20, 33), (1 << 31, 5), (1 << 40, 3), (0, 4)):
        a, c = rng.integers(-span, span + 1, (7, dim)), rng.integers(-span, span // 2 + 1, (23, dim))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in c] for r in a], object)
        got = negatives.packed_products(a, c)
        assert all((int(g) - int(w)) % 2**64 == 0 for g, w in zip(got.ravel(), want.ravel())), (span, dim)
    assert negatives.fields(600, 600, 64) == 2 and negatives.fields(30, 30, 64) >= 3
    with pytest.raises(ValueError):
        negatives.scores(np.full((1, 4), 1 << 40), np.full((1, 4), 1 << 40))


def plain_negatives(rows):
    """By the words of the contract, over lists of (vec_id, label, vector)."""
    sound = {(i, k, tuple(v)) for i, k, v in rows if None not in (i, k, v) and all(x is not None and np.isfinite(x) for x in v)}
    ints = [(i, k, [int(np.floor(256 * float(x))) for x in v]) for i, k, v in sound]
    out = []
    for i, k, v in ints:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in ints if j != i)
        for s, p, _ in [x for x in scored if x[2] == k][:5]:
            inside = [x for x in scored if x[2] != k and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_are_the_plain_ones(spark, monkeypatch, small):
    if small:  # several blocks and turns
        for name, value in (("ANCHORS", 3), ("CANDIDATES", 17), ("TURN", 2)):
            monkeypatch.setattr(negatives, name, value)
    centre = rng.normal(0, 0.2, (3, 8))
    rows = [(int(i), int(i % 3), [float(x) for x in np.float32(centre[i % 2] + rng.normal(0, 0.05, 8))]) for i in range(0, 900, 4)]
    rows += [(100 + k, 1, rows[0][2]) for k in (1, 2, 3)] + [(7, 2, rows[0][2]), (7, 2, rows[0][2])]  # ties and repeated rows
    rows += [(1000, None, [1.0]), (1001, 1, None), (None, 1, [1.0] * 8), (1100, 1, [float("nan")] * 8), (1200, 1, [None] * 8), (1300, 1, [float("inf")] * 8), (1400, 1, []), (1500, 2, [0.5, 0.5]), (-100, 0, [0.3] * 9)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"block": F.lit("x"), "ids": F.lit(1), "score": F.lit(2.0)})
    got = negatives.mine_negatives(frame, "vec_id % 100 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert negatives.mine_negatives(frame.filter("false"), "vec_id % 100 = 0").count() == 0
    assert negatives.mine_negatives(frame.filter("vec_id = 4"), "vec_id % 100 = 0").count() == 0


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def plain_components(rows):
    sets = [(i, plain_sets(t)) for i, t in rows]
    at = list(range(len(sets)))

    def top(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in itertools.combinations([k for k, (i, s) in enumerate(sets) if s and i is not None], 2):
        x, y = sets[a][1], sets[b][1]
        both = len(x & y)
        if 100 * both >= 85 * (len(x) + len(y) - both):
            at[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least[top(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=repr)


def near_family(start, n, words, edits):
    base = [f"w{start}{k}" for k in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.choice(words, edits, replace=False):
            own[k] = f"x{start}{i}{k}"
        out.append((start + i, " ".join(own)))
    return out


def test_jaccard_components_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT", 7)
    monkeypatch.setattr(jaccard, "MOST_MARKS", 1 << 15)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += near_family(10_000, 40, 120, 1) + near_family(20_000, 40, 100, 2) + near_family(30_000, 30, 100, 1)  # linked, at the limit, mixed
    passage = " ".join(f"common{k}" for k in range(60))
    rows += [(40_000 + k, f"{passage} " + " ".join(f"own{k}{j}" for j in range(20 + k))) for k in range(25)]
    rows += [(50_000, None), (50_001, ""), (50_002, " \t\n"), (50_003, "One"), (50_004, "one "), (50_005, "one two three"), (50_006, "ONE two\x0bthree"), (50_007, "É one"), (50_008, "é one"), (50_009, "a b c d"), (50_009, "a b c d"), (50_009, "other text of five words"), (None, "one"), (None, None), (50_010, "word " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "key": F.lit("k"), "n": F.lit(0), "hash": F.lit("h"), "label": F.lit(1)})
    got = sorted(map(tuple, jaccard.jaccard_components(frame).collect()), key=repr)
    assert got == plain_components(rows)
    assert jaccard.jaccard_components(frame.filter("false")).count() == 0


def test_filters_of_lists_lose_no_pair():
    """Members of a list in their own components: every alike pair is among the pairs that blocks give."""
    family = [jaccard.shingle_sets(pa.array([t for _, t in near_family(1, 60, 150, 2) + near_family(1, 20, 150, 1)]), 4)][0]
    rows = [{"key": 1, "block": 0, "asks": False, "major": k == 0, "node": k, "label": k, "n": len(s), "keys": [1, 5], "bits": jaccard.parity_bits(s)} for k, s in enumerate(family)]
    other = [r | {"block": 1, "asks": r["node"] % 2 == 0} for r in rows]
    other += [r | {"key": 5, "block": 0} for r in rows[:9]]  # the same ones in another list: not once more
    batch = pa.RecordBatch.from_pylist(rows + sorted(other, key=lambda r: (r["key"], r["asks"])))
    pairs = [p for out in jaccard.list_pairs(iter([batch.slice(0, 7), batch.slice(7)]), 85) for p in zip(*(c.to_pylist() for c in out.columns))]
    found = {tuple(sorted(p)) for p in pairs}
    alone = [p for out in jaccard.list_pairs(iter([pa.RecordBatch.from_pylist(rows)]), 85) for p in zip(*(c.to_pylist() for c in out.columns))]
    assert {tuple(sorted(p)) for p in alone} == found and len(alone) == len(found)
    good = {(a, b) for a, b in itertools.combinations(range(len(family)), 2) if jaccard.alike(family[a], family[b], 85)}
    assert good and good <= found and len(found) < len(family) * (len(family) - 1) // 2
    a, b = family[0], family[5]
    assert jaccard.least_difference(np.frombuffer(jaccard.parity_bits(a), np.uint64), np.frombuffer(jaccard.parity_bits(b), np.uint64)[None])[0] <= len(np.setxor1d(a, b))


def plain_repair(codes):
    """(cost, audit) by all states and rows: the least of all ways, by cost and then by audit."""
    best = {0: (0, "")}
    letters = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserts(now):
        for _ in range(4):
            for s, (c, a) in list(now.items()):
                for x, to in letters[s].items():
                    if x != "s":
                        now[to] = min(now.get(to, (c + 2, a + "I")), (c + 2, a + "I"))
        return now

    for initial, fallen, cut in codes:
        best, after = inserts(dict(best)), {}
        for s, (c, a) in best.items():
            ways = [(c + 3, a + "D", s)]
            if not fallen:
                ways += [(c + cut, a + "K", letters[s][initial])] if initial in letters[s] else []
                ways += [(c + cut + 2, a + "R", to) for x, to in letters[s].items() if x != "s"]
            for cost, audit, to in ways:
                after[to] = min(after.get(to, (cost, audit)), (cost, audit))
        best = after
    best = inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def coded(rows):
    return bytes("sua".find(i) % 4 | 4 * f | 8 * c for i, f, c in rows)


def test_search_is_the_plain_one():
    for _ in range(1500):
        rows = [(str(rng.choice(list("suax"), p=[0.1, 0.4, 0.4, 0.1])), bool(rng.random() < 0.15), bool(rng.random() < 0.2)) for _ in range(int(rng.integers(0, 14)))]
        got = repair.search(coded(rows), 0, repair.end_costs(), True)
        assert got[:2] == plain_repair(rows), rows


def test_bounds_are_below_and_long_ones_end():
    rows = [(str(rng.choice(list("sua"), p=[0.05, 0.5, 0.45])), bool(rng.random() < 0.2), bool(rng.random() < 0.3)) for _ in range(256)]
    assert repair.search(coded(rows), 0, repair.end_costs(), True)[:2] == plain_repair(rows)
    bounds = repair.lower_bounds(coded(rows), repair.end_costs())
    assert bounds[0][0] <= plain_repair(rows)[0] and bounds[-1] == repair.end_costs()
    for i in (0, 100, 250):  # each state's bound is below what the rest costs from it
        exact = repair.search(coded(rows)[i:], 2, repair.end_costs(), True)[0]
        assert exact - 40 <= bounds[i][2] <= exact


def plain_query(rows):
    convs = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text, fate = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        convs[c] += [(t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        codes = [(role[:1] if role[:1] in ("s", "u", "a") else "x", f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(own, faults)]
        cost, audit = plain_repair(codes)
        lines, at, last = [], iter(own), None
        for e in audit:
            _, role, text = next(at) if e != "I" else (None, "", "")
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [256, 3])
def test_repair_query_is_the_plain_one(spark, monkeypatch, tmp_path, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    rows += [(c, None if rng.random() < 0.05 else int(t), roles[int(rng.choice(7, p=[0.4, 0.35, 0.1, 0.04, 0.04, 0.03, 0.04]))], [f"Text {k}.", "cut off", "", None, " \t", "Same.", "End!  \n"][int(k % 7)]) for c in (-5, 500, 501) for t, k in enumerate(rng.integers(0, 99, 40))]
    rows += [(None, 0, "user", "No id."), (None, 1, "assistant", "None"), (600, 3, "user", "Only"), (700, None, None, None)]
    rows += [(c, 0, "system", "Gone.") for c in range(800, 830)]  # some lose their only row
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "seq": F.lit("s"), "kind": F.lit(0), "copy": F.lit(9)})
    got = repair.repair_conversations(repair.damaged(frame), frame)
    assert got.columns == [c.split()[0] for c in repair.OUT.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_query(rows)
    assert repair.repair_conversations(repair.damaged(frame.filter("false")), frame.filter("false")).count() == 0


def test_registered(spark):
    for name in ("op11_hard_negatives", "op12_jaccard_join", "op13_conversation_repair"):
        assert queries.QUERIES[name](spark, SF).count() > 0
