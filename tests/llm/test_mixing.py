import hashlib
from collections import defaultdict
from fractions import Fraction

from driftline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, h int, target double"


def brute(rows):
    """Targets by repeated sharing, and documents taken in order of their hash."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    sources = sorted((s for s in by if s is not None)) + [None] * (None in by)
    total = {s: sum(size[i] for i in by[s]) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, budget = {}, set(sources), Fraction(3 * sum(total.values()), 2)
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(2 * total[s])
            budget -= target[s]
        free -= over
    out = {}
    for s in sources:
        base = int(target[s] >= total[s])
        left = target[s] - base * total[s]
        for i in sorted(by[s], key=lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)):
            take = left is not None and (size[i] <= left or size[i] - left < left)
            left = left - size[i] if take and size[i] <= left else left if not size[i] else None
            out[i] = (size[i], total[s], float(target[s]), size[i] * (base + bool(take and size[i])))
    return out


def rows_of(n=600):
    return [(k, None if k % 37 == 0 else "w " * (k * 7919 % 50), [None, "a", "b", "hot", "hot", "hot", "é"][k % 7]) for k in range(n)]


def test_against_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x", 3, 1.0) for r in rows], SCHEMA).repartition(4)
    out = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()}
    want = brute(rows)
    assert out.keys() == want.keys()
    for k in out:
        assert out[k][:2] == want[k][:2] and abs(out[k][2] - want[k][2]) < 1e-6 and out[k][3] == want[k][3], k


def test_near_targets_and_twice_at_most(spark):
    rows = rows_of(2000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, target = defaultdict(int), {}
    for r in mixing.mix(df).collect():
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(got[s] - target[s]) <= 25 for s in target)


def test_applied_rows_are_as_planned(spark):
    df = spark.createDataFrame([(*r, "x", 3, 1.0) for r in rows_of()], SCHEMA)
    plan = {r.doc_id: r.copies if r.size else 1 for r in mixing.mix(df).collect()}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r.doc_id] += 1
    assert {k: v for k, v in plan.items() if v} == dict(n)


def test_small_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.apply_mix(spark.createDataFrame([], schema)).count() == 0
    (row,) = mixing.mix(spark.createDataFrame([(None, None, None)], schema)).collect()
    assert (row.size, row.taken, row.target) == (0, 0, 0.0)
    same = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], schema)).collect()
    assert same[0] == same[1]
