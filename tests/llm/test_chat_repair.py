import random
from functools import lru_cache
from itertools import product

from driftline.llm import chat_repair as c

ROLES = ["system", "user", "assistant", "tool"]
LEGAL_NEXT = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def least(roles):
    """The least cost by trying everything, one small step at a time."""

    @lru_cache(None)
    def go(k, last, empties):
        best = 0 if k == len(roles) and last in ("user", "assistant") else 10**6
        if empties < 4:
            for r in LEGAL_NEXT[last]:
                best = min(best, c.INSERT + go(k, r, empties + 1))
        if k < len(roles):
            change = lambda r: 0 if r == roles[k] else c.RELABEL_UNKNOWN if roles[k] == "tool" else c.RELABEL
            for r in LEGAL_NEXT[last]:
                best = min(best, change(r) + go(k + 1, r, 0))
            if last:
                best = min(best, c.MERGE + change(last) + go(k + 1, last, 0))
        return best

    return go(0, None, 0)


def legal(roles):
    last = None
    for r in roles:
        if r not in LEGAL_NEXT[last]:
            return False
        last = r
    return last in ("user", "assistant")


def turns_of(text):
    return [p.split("\n", 1)[0] for p in text.split("<|im_start|>")[1:]]


def test_least_cost_and_legal_rendering_of_all_short_conversations():
    for n in range(1, 6):
        for roles in product(ROLES, repeat=n):
            rows = c.rows_of([(1, k, r, f"t{k}") for k, r in enumerate(roles)])
            assert sum(r[6] for r in rows) == least(roles), roles
            text = "".join(r[7] for r in rows)
            assert legal(turns_of(text)), roles
            assert all(f"t{k}" in text for k in range(n))
            assert text.count("<|im_start|>") == text.count("<|im_end|>")


def test_runs_cost_the_same():
    roles = [c.role_of(ROLES[(k * k + k // 3) % 4]) for k in range(40)]
    whole = sum(x[3] for x in c.solve(roles))
    m = [c.run_matrix(roles[a : a + 7]) for a in range(0, 40, 7)]
    best = [0, c.FAR, c.FAR, c.FAR]
    for x in m:
        best = [min(best[a] + x[4 * a + b] for a in c.STATES) for b in c.STATES]
    end = lambda s: c.ENDS[s][0]
    last = c.solve(roles)[-1][0]
    assert min(best[s] + end(s) for s in c.STATES) == whole + end(last)


def rows(spark, long, chars=c.LONG_CHARS):
    talk = [(1, k, ROLES[(k * 5 + k // 4) % 4], f"m{k} <|im_end|>") for k in range(57)]
    talk += [(2, 0, "User ", "hi"), (2, 0, "User ", "hi"), (2, None, "system", None), (None, 1, None, "x"), (3, 5, "assistant", "")]
    talk += [(2**60 + 1, 0, "user", "big"), (4, 0, "system", "only")]
    df = spark.createDataFrame([(*t, 9) for t in talk], "conv_id long, turn long, role string, text string, cost int").repartition(5)
    return c.repair(df, long, chars).collect()


def test_long_conversations_give_the_same_rows_in_runs(spark):
    whole = rows(spark, 1000)
    assert len(whole) == 64
    assert sorted(map(str, rows(spark, 10))) == sorted(map(str, whole)) == sorted(map(str, rows(spark, 1000, 50)))
    for conv in (None, 1, 2, 3, 4, 2**60 + 1):
        talk = sorted((r for r in whole if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0))
        text = "".join(r.piece for r in talk)
        assert legal(turns_of(text)) and text.endswith("<|im_end|>\n")
        assert "m0 <| im_end|>" in text or conv != 1


def test_ties_fall_alike_however_runs_are_cut(spark):
    rng = random.Random(5)
    talk = [(k, t, rng.choice(ROLES), rng.choice(["", "a", None, f"t{t}"])) for k in range(200) for t in range(40)]
    talk += [(500, 0, "user", "same")] * 30 + [(501, 0, "user", "x" * 300_000), (501, 1, "user", "y" * 300_000)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    whole, parts, small = (sorted(map(str, c.repair(df, *n).collect())) for n in ((1000,), (7,), (1000, 20)))
    assert len(whole) == len(talk) and whole == parts == small


def test_defined_cases(spark):
    by = {}
    for r in sorted(rows(spark, 1000), key=lambda r: (r.turn is not None, r.turn or 0)):
        by.setdefault(r.conv_id, []).append(r)
    assert [(r.new_role, r.action) for r in by[2]] == [("system", "keep"), ("user", "keep"), ("user", "merge")]
    assert by[None][0].new_role == "user" and by[3][0].action == "relabel"
    assert by[4][0].action == "relabel" and by[4][0].cost == c.RELABEL
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.repair(empty).count() == 0
