import random
from collections import defaultdict

import pytest
import xxhash

from driftline.llm import simhash

SCHEMA = "doc_id long, text string, f0 string, component_id int"


def print_of(text, n=3):
    words = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    for ch in "\t\n\x0b\x0c\r":
        words = words.replace(ch, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(nodes, near):
    """The least id that each node reaches, by depth-first search over all pairs."""
    out = {}
    for k in sorted(nodes):
        todo = [k] if k not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = k
                todo += [y for y in nodes if y not in out and near(nodes[x], nodes[y])]
    return out


def test_fingerprint_by_its_definition():
    for text in (None, "", " \n", "One", "one TWO", "A b c d", "É é x\x0by z É", "w " * 500, "the cat sat on the mat and the cat sat"):
        found = simhash.fingerprint(text, 3, 1)
        assert found[0] & (2**64 - 1) == print_of(text) and found[1] == max(len((text or "").split()) - 2, bool((text or "").split()))


@pytest.mark.parametrize("blocks,width,tile", [(4, 1, 50), (4, 1, 8192), (2, 1, 8192), (0, 2, 64)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, blocks, width, tile):
    rng = random.Random(5)
    prints = {}
    for k in range(400):
        base = rng.choice(list(prints.values())) if k % 2 and prints else rng.getrandbits(64)
        prints[k] = base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3]))) if k % 2 else base
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(k, signed(v), 5) for k, v in prints.items()], "doc_id long, f0 long, size long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: table)
    out = simhash.near_components(table, blocks=blocks, width=width, tile=tile)
    assert {r.doc_id: r.component_id for r in out.collect()} == labels(prints, lambda a, b: (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize("tile", [40, 8192])
def test_sizes_must_be_alike(spark, monkeypatch, tile):
    rng = random.Random(8)
    prints, sizes = {}, {}
    for k in range(500):
        base = rng.choice(list(prints.values())) if prints and k % 3 else rng.getrandbits(64)
        prints[k] = base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 5])))
        sizes[k] = rng.choice([0, 1, 4, 5, 6, 8, 10, 64, 80, 100, 125, rng.randint(1, 3000)])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(k, signed(v), sizes[k]) for k, v in prints.items()], "doc_id long, f0 long, size long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: table)
    out = simhash.near_components(table, radius=5, blocks=0, width=2, tile=tile, ratio=0.8)
    like = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 5 and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])
    assert {r.doc_id: r.component_id for r in out.collect()} == labels({k: k for k in prints}, like)


def test_documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts = [None, "", "  ", "a b"] + base + [b + " " + word() for b in base] + [b.upper() for b in base[:9]] + [base[0]] * 200
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(9000, "lorem " * 50_000, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = simhash.simhash(df).collect()
    prints = {k: print_of(t) for k, t, *_ in rows}
    want = labels(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [[word() for _ in range(150)] for _ in range(60)]
    near = [[*w[:70], word(), *w[71:]] for w in base[:30]]
    rows = [(k, " ".join(w), "x", 1) for k, w in enumerate(base + near)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(60))


def test_a_repeated_paragraph_makes_no_difference(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [[word() for _ in range(120)] for _ in range(40)]
    twice = [w + w for w in base[:20]]
    paragraph = [w + w[40:100] * 3 for w in base[20:]]
    rows = [(k, " ".join(w), "x", 1) for k, w in enumerate(base + twice + paragraph)]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == list(range(40))


def test_only_alike_sets_link(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for k in range(60):
        base = [word() for _ in range(200)]
        texts += [base, base[: 148 + k % 20] + [word() for _ in range(10)]]  # alike at 0.69 to 0.8
        texts += [base + [word() for _ in range(30 + k % 25)]]  # alike at 0.78 to 0.87
    hub = [word() for _ in range(100)]
    texts += [[*hub[:k], word(), *hub[k + 1 : 100 - k % 30]] for k in range(60)]
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    want = labels(dict(enumerate(sets)), lambda a, b: len(a & b) / len(a | b) >= 0.8)
    df = spark.createDataFrame([(k, " ".join(w), "x", 1) for k, w in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(simhash, "PART", 1000)
    monkeypatch.setattr(simhash, "PART_ROWS", 9)
    out = simhash.near_components(df, **simhash.NEAR)
    assert {r.doc_id: r.component_id for r in out.collect()} == want and 1 < len(set(want.values())) < len(texts)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d", "x", 1), (5, "a b c d", "x", 1), (5, "a b c d", "x", 1)], SCHEMA)
    assert [(r.doc_id, r.component_id) for r in simhash.simhash(df).orderBy("doc_id").collect()] == [(None, 5), (5, 5), (5, 5)]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_hub_with_many_links_gives_one_component(spark):
    hub = 0x0F0F0F0F0F0F0F0F
    prints = {0: hub} | {k + 1: hub ^ (1 << k) for k in range(64)}
    groups = defaultdict(set)
    import numpy as np

    tile = simhash._Tile(2)
    links = tile.start(np.array(list(prints)), np.array(list(prints.values()), np.uint64)[:, None], np.ones(len(prints), np.int64))
    for u, v in links:
        groups[min(u, v)].add(max(u, v))
    assert len(links) == 64


def test_the_filter_goes_by_rows_not_ids(spark):
    near = "one two three four five six seven eight nine ten " * 12
    rows = [(1, near, "b"), (5, near + "end", "x"), (5, "another text that is unlike the others here", "x"), (1, near, "a"), (None, near, "x"), (None, "alone in all of its words and more", "x")]
    for order in (rows, rows[::-1]):
        out = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, key string"))
        got = [(r.doc_id, r.text[:9]) for r in out.collect()]
        assert sorted(got, key=str) == sorted([(1, near[:9]), (5, "another t"), (None, "alone in ")], key=str)
