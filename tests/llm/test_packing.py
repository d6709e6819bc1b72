import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import packing
from driftline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path(), most=50)


def plain(encoder, text):
    return np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x260), max_size=60))
def test_words_give_the_tokenizers_ids(text):
    e = packing.Encoder(tokenizer_path(), most=50)
    assert e.encode(text) == plain(e, text)


def test_every_simple_character(encoder):
    for k in range(0x250):
        for text in (chr(k), f"a{chr(k)}b 1{chr(k)}2", f"don't{chr(k)}'s _{chr(k)}_"):
            assert encoder.encode(text) == plain(encoder, text), hex(k)


def test_special_strings_other_scripts_and_long_texts(encoder, monkeypatch):
    for text in ("a <|endoftext|> b", "日本語 text é", "éa", "x " * 3000):
        assert encoder.encode(text) == plain(encoder, text)
    monkeypatch.setattr(packing, "STRIDE", 7)
    text = "one two, three's 4567 ###  eight\nnine"
    assert encoder.encode(text) == plain(encoder, text)


def rebuilt(rows):
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    return docs, windows


def test_round_trip(spark, encoder):
    texts = [None, "", "word " * 5000, "a b c", "a b c", "é " * 30, "x"] + [f"text number {k} " * (k % 90) for k in range(300)]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in enumerate(texts)], "doc_id long, text string, start string, offset int").repartition(3)
    docs, windows = rebuilt(packing.pack(df, tokenizer_path(), window=64).collect())
    assert set(docs) == set(range(len(texts)))
    for doc, pieces in docs.items():
        ids, at = plain(encoder, texts[doc] or "") + b"\1\0\0\0", 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(ids) // 4 and crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
            at += length
        assert at == len(ids) // 4
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == 64 or at & (at - 1) == 0


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    p = packing.SumOfSquares(0, window=32, most=10_000, share=1)
    for k in range(400):
        size = int(rng.integers(1, 32))
        count = p.count.copy()

        def cost(level, count=count, size=size):
            c = count.copy()
            c[level] -= level > 0
            c[level + size] += level + size < 32
            return int((c[:32] ** 2).sum())

        levels = [0, *(x for x in range(1, 33 - size) if count[x])]
        assert cost(p._level(size)) == min(map(cost, levels))
        list(p.place((k, 0, b"\0" * 4 * size, size)))


def test_open_windows_are_bounded_and_nothing_is_lost():
    p = packing.SumOfSquares(0, window=16, most=2)
    rows = []
    for k, size in enumerate([9, 9, 9, 10, 3, 16, 40, 1]):
        rows += p.place((k, 0, bytes(4 * size), size))
        assert p.n_open <= 2
    rows += p.flush()
    assert sum(r[2] for r in rows) == 97


def brute(sizes, window, most, share):
    """Rows (id, start, length, window, offset) of the windows that get full and of those left open, by trying all places for every piece."""
    open_, full, done, clock, next_ = [], [], 0, 0, 0
    squares = lambda levels: sum(levels.count(x) ** 2 for x in set(levels) - {0, window})
    for k, size in enumerate(sizes):
        start = 0
        while size:
            if size >= window:
                full.append((k, start, window, next_, 0))
                next_, done, start, size = next_ + 1, done + 1, start + window, size - window
                continue
            levels = [w["level"] for w in open_]
            cut, ways = size, []
            for w in open_:
                if w["level"] + size <= window:
                    ways.append((squares([x["level"] + size * (x is w) for x in open_]), 0, -w["level"], -w["stamp"], w))
            if len(open_) < min(most, 1 + done // share):
                ways.append((squares([*levels, size]), 1, 0, 0, None))
            if not ways:
                ways = [(squares([window if x is w else x["level"] for x in open_]), 0, w["level"], -w["stamp"], w) for w in open_]
            w = min(ways, key=lambda x: x[:4])[4]
            if w is None:
                w = {"level": 0, "seq": next_, "pieces": []}
                next_ += 1
                open_.append(w)
            cut = min(size, window - w["level"])
            w["pieces"].append((k, start, cut, w["seq"], w["level"]))
            clock += 1
            w["level"], w["stamp"] = w["level"] + cut, clock
            if w["level"] == window:
                full += w["pieces"]
                open_ = [x for x in open_ if x is not w]
            done, start, size = done + 1, start + cut, size - cut
    return full, [p for w in open_ for p in w["pieces"]]


@pytest.mark.parametrize("window,most,share", [(8, 1000, 1), (16, 3, 1), (32, 1000, 4), (16, 1000, 32)])
def test_placing_is_what_trying_all_places_gives(window, most, share):
    rng = np.random.default_rng(window)
    sizes = rng.integers(1, 2 * window, 300).tolist()
    p = packing.SumOfSquares(0, window, most, share)
    rows = [r for k, size in enumerate(sizes) for r in p.place((k, 0, bytes(4 * size), size))]
    full, left = brute(sizes, window, most, share)
    short = lambda r: (*r[:3], *r[5:7])
    assert list(map(short, rows)) == full and all(r[7] for r in rows)
    rest = list(p.flush())
    assert set(map(short, (r for r in rest if r[7]))) <= set(left)
    assert sum(r[2] for r in rest) == sum(p[2] for p in left)


def test_few_pieces_move_at_the_end():
    rng = np.random.default_rng(9)
    for n in (200, 1000, 10_000):
        p = packing.SumOfSquares(0)
        rows = []
        for k, size in enumerate(np.exp(rng.uniform(1, 8.5, n)).astype(int).tolist()):
            rows += p.place((k, 0, bytes(4 * size), size))
        rows += p.flush()
        windows = {}
        for r in rows:
            windows[r[5]] = windows.get(r[5], 0) + r[2]
        assert sum(size != packing.WINDOW for size in windows.values()) <= 11 and all(size & (size - 1) == 0 for size in windows.values())
        assert sum(r[7] for r in rows) >= 0.95 * len(rows)


def test_null_and_repeated_ids_and_clashing_names(spark, encoder):
    rows = [(None, "a b", 1), (None, None, 2), (3, "same text", 3), (3, "same text", 4), (3, "other", 5)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, placed int").repartition(2), tokenizer_path(), window=16).collect()
    want = sum(len(plain(encoder, t or "")) // 4 + 1 for _, t, _ in rows)
    assert sum(r.length for r in out) == want and {r.doc_id for r in out} == {None, 3}
    assert sum(r.doc_id == 3 and r.start == 0 for r in out) == 3


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
