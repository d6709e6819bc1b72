import hashlib
import random

import numpy as np

from driftline.llm import phrases

SCHEMA = "doc_id long, text string, fingerprint string, bucket int"


def prose(k, n=300):
    rng = random.Random(k)
    return " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(n))


def names(text, level):
    x = phrases._mix(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + phrases._POWERS[2])
    doc = np.zeros(len(x), np.int64)
    for _ in range(level):
        x, doc = phrases._next_level(x, doc)
    return x.tolist()


def test_neighbours_get_different_labels_below_six():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 20_000).astype(np.uint64)
    x = x[np.append(True, x[1:] != x[:-1])]
    x = phrases._mix(x)
    label = phrases._labels(x, np.array([0]))
    assert label.max() < 6 and (label[1:] != label[:-1]).all()


def test_equal_substrings_share_interior_phrases_at_any_offset():
    common = prose(1, 400)
    for level in (1, 2, 3):
        inside = names(common, level)
        margin = 12
        core = inside[margin:-margin]
        for k in range(5):
            other = names(prose(50 + k, 20)[: 40 + k] + common + prose(70 + k, 9), level)
            at = other.index(core[0])
            assert other[at : at + len(core)] == core


def test_texts_parsed_together_are_as_if_alone():
    texts = [prose(k, k) for k in range(30)] + ["", "a", "aa", "a" * 500, "ab" * 400, "日本語" * 9, "\U0001f600x"]
    together = phrases.sketches(texts)
    for k, t in enumerate(texts):
        assert (phrases.sketches([t])[0] == together[k]).all()
    assert len({bytes(x) for x in together}) == len(set(texts))


def test_likeness_follows_the_shared_part():
    a, b = prose(1), prose(2)
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    s = phrases.sketches([a, b, half, a])
    near = lambda i, j: float(phrases.likeness(s[i : i + 1], s[j : j + 1])[0])
    assert near(0, 3) == 1 and near(0, 1) < 0.1 and 0.35 < near(0, 2) < 0.65
    e = phrases.sketches(["", "", "x"])
    assert phrases.likeness(e[:1], e[1:2])[0] == 1 and phrases.likeness(e[:1], e[2:])[0] == 0


def brute(rows):
    out = {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), phrases.as_bytes(phrases.sketches([text]))[0].hex(), phrases.as_bytes(phrases.sketches([changed]))[0].hex())
    return out


def test_against_brute_force(spark, monkeypatch):
    rows = [(k * 3 - 50, [None, "", prose(k, k % 70), "é" * k, prose(3)][k % 5]) for k in range(240)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(6)
    for size, chars in ((20_000, 1 << 20), (25, 300), (1, 1 << 20)):
        monkeypatch.setattr(phrases, "BUCKET_ROWS", size)
        monkeypatch.setattr(phrases, "BATCH_CHARS", chars)  # many texts are longer than the second one
        out = phrases.fingerprints(df).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in out} == brute(rows)


def test_small_tables_ties_and_nulls(spark):
    assert phrases.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    (one,) = phrases.fingerprints(spark.createDataFrame([(5, "abcdefgh", "x", 1)], SCHEMA)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1
    same = spark.createDataFrame([(1, "b", "x", 1), (1, "a", "x", 1), (None, "c", "x", 1), (None, "c", "x", 1)], SCHEMA)
    assert len(phrases.fingerprints(same).collect()) == 4


def test_one_id_of_all_rows_is_split_and_the_chain_is_whole(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(None if k % 2 else 4, f"text {k % 7} of few", "x", 1) for k in range(120)], SCHEMA)
    out = phrases.fingerprints(df).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0] * 60 + [4] * 60
    # in each block of equal (id, text) all but the last text are followed by an equal one
    assert sum(r.near_next == 1 for r in out) >= 120 - 14


def test_a_text_longer_than_a_batch(spark):
    long = prose(1, 400_000)
    assert len(long) > phrases.BATCH_CHARS
    out = {r.doc_id: r for r in phrases.fingerprints(spark.createDataFrame([(1, long, "x", 1), (2, long[7:], "x", 1), (3, "end", "x", 1)], SCHEMA)).collect()}
    assert out[1].n_chars == len(long) and out[1].near_next > 0.9 > 0.1 > out[2].near_next
