import hashlib
import re
from collections import defaultdict

from driftline.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, row int, keep_id long"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_against_brute_force(spark):
    rows = [(k, ["a  b", "a\tb", "A b", None, "", " ", "é\x0b ü", f"only {k}", "a b "][k % 9]) for k in range(400)]
    rows.append((400, "long " * 100_000))
    df = spark.createDataFrame([(i, t, "x", 1, 7) for i, t in rows], SCHEMA).repartition(5)
    for bits in (32768, 1 << 20):
        out = exact_dedup.exact_dedup(df, max_bits=bits)
        assert sorted(map(tuple, out.collect())) == brute(rows)


def test_a_full_bitmap_and_one_hot_group_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 32768)
    rows = [(k, "copy" if k % 3 == 0 else f"t{k}") for k in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect())) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b")], "doc_id long, text string")
    out = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in out if r.group_size == 3) == 1
    assert [r.doc_id for r in out if r.group_size == 2 and r.kept] == [2]


def test_filter_keeps_columns_and_one_of_each(spark):
    df = spark.createDataFrame([(k, ["x", "y  z", "y z"][k % 3], "s", 1, 2) for k in range(30)], SCHEMA)
    out = exact_dedup.keep_first(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df).count() == 0 and exact_dedup.keep_first(df).count() == 0


def test_the_first_pass_finds_every_repeated_cell_and_exchanges_no_rows(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"t{k % 2900}") for k in range(3000)]
    for parts in (1, 3, 70):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        digests = exact_dedup.written(df.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("rid")), "d")
        cells = digests.select(exact_dedup._cells(F.col("digest"), 1 << 17, 1)[0].alias("cell")).collect()
        count = {c: [r.cell for r in cells].count(c) for c in {r.cell for r in cells}}
        blocks = exact_dedup.repeated_cells(digests, 1 << 17, parts)
        marked = {32768 * r.block + 8 * k + j for r in blocks.collect() for k, byte in enumerate(r.bitmap) for j in range(8) if byte >> j & 1}
        assert marked == {c for c, n in count.items() if n > 1}
        _, maps, groups = exact_dedup.group_bitmaps(digests, 1 << 17, parts)
        assert exact_dedup.GROUPS <= groups < 2 * exact_dedup.GROUPS
        plan = maps._jdf.queryExecution().executedPlan().toString().split("Exchange")
        assert len(plan) == 2 and "bitmap_construct_agg" in plan[1]  # what is exchanged comes out of a partial aggregation


def test_the_filter_goes_by_rows_not_ids(spark, monkeypatch):
    rows = [(1, "same text", "b"), (5, "same  text", "x"), (5, "another, unique text", "x"), (1, "same text", "a"), (None, "same text", "x"), (None, "alone", "x"), (None, "gone", "1"), (None, "gone", "2")]
    out = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, key string"))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "same text"), (5, "another, unique text"), (None, "alone"), (None, "gone")], key=str)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 1)
    again = exact_dedup.keep_first(spark.createDataFrame(rows[::-1], "doc_id long, text string, key string").repartition(3))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
