import hashlib
import random

from driftline.llm import line_dedup

SCHEMA = "doc_id long, text string, start int, digest string"
A, B, C = "one two three four five", "the  Same line of six words", "ünïque line with five words"


def docs(spark):
    rows = [
        (3, f"{A}\nshort\n{B}"),
        (1, f"{B.lower()}\n{A}\n{C}"),
        (2, f"x y z\n\n{B.upper()}  \n{A}\n{A}"),
        (4, None),
        (5, ""),
        (6, f"{C} else"),
        (7, "\n".join(f"line number {k} of a long text" for k in range(4000))),
        (None, A),
    ]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def cuts(words):
    """Places of least hashes within six words, one at a time."""
    h = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
    return [k for k in range(1, len(h)) if all(h[k] < x for x in h[max(0, k - 6) : k]) and all(h[k] <= x for x in h[k + 1 : k + 7])]


def brute(rows, least=20):
    units, count = [], {}  # (id, line, part, start, end, words, text, whole)
    for i, text in rows:
        at = part = 0
        for line in (text or "").split("\n"):
            words = line.split(" ")
            starts = cuts([w.lower() for w in words]) if len(words) > 24 else []
            pieces = [(True, 0, len(words))] if starts else []
            pieces += [(False, a, b) for a, b in zip([0, *starts], [*starts, len(words)], strict=True)]
            for is_line, a, b in pieces:
                unit, begin = " ".join(words[a:b]), at + len(" ".join([*words[:a], ""]))
                clean = " ".join(unit.lower().split())
                n = len(clean.split())
                if n and (not is_line or n >= least):
                    units.append((i, at, -1 if is_line else part, begin, begin + len(unit), n, clean, is_line or not starts and n >= least))
                    count[clean] = count.get(clean, 0) + 1
                    part += not is_line
            at += len(line) + 1
    keep = {}
    for u in sorted(units, key=lambda u: (u[0] is None, u[0] or 0, u[3])):
        keep.setdefault(u[6], (u[0], u[3]))
    later = [u for u in units if keep[u[6]] != (u[0], u[3])]
    gone = {u[:2] for u in later if u[7]}
    parts = {(u[0], u[2]): u for u in later if u[2] >= 0}
    out = {u for u in later if u[7]}
    for i, p in parts:
        run = [p]
        while (i, run[0] - 1) in parts:
            run.insert(0, run[0] - 1)
        while (i, run[-1] + 1) in parts:
            run.append(run[-1] + 1)
        if sum(parts[i, k][5] for k in run) >= least and parts[i, p][:2] not in gone:
            out.add(parts[i, p])
    return {(u[0], u[3], u[4], *keep[u[6]], count[u[6]], u[7]) for u in out}


def test_against_brute_force(spark):
    df = docs(spark)
    got = {tuple(r) for r in line_dedup.repeated_spans(df, min_words=5).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 5) and len(got) == 6


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_passages_inside_lines(spark):
    passages = [prose(1000 + k, 52) for k in range(20)]
    rows = [(k, f"{prose(k, 30 + k % 7)} {passages[k % 20]} {prose(500 + k, 40)}\n{prose(900 + k, 12)}", 1, "x") for k in range(60)]
    clean = [(k, prose(3000 + k, 400), 1, "x") for k in range(100, 150)]
    df = spark.createDataFrame(rows + clean, SCHEMA)
    got = line_dedup.repeated_spans(df).collect()
    assert {tuple(r) for r in got} == brute([(r[0], r[1]) for r in rows + clean])
    inner = {k: [x for x in cuts(passages[k].split()) if 6 <= x < 46] for k in range(20)}  # the words around a passage don't matter there
    sure = {k for k in range(20) if inner[k] and inner[k][-1] - inner[k][0] >= 20}
    assert {r.doc_id for r in got} >= {k for k in range(20, 60) if k % 20 in sure} and len(sure) > 8 and max(r.doc_id for r in got) < 60
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert text[r.doc_id][r.start : r.end] == text[r.keep_doc_id][r.keep_start : r.keep_start + r.end - r.start]
        assert r.keep_doc_id < r.doc_id and not r.whole


def test_a_line_that_many_documents_share(spark):
    rows = [(k, f"only {k} has this very line\n{A}", 1, "x") for k in range(3000)]
    out = line_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA), min_words=5).collect()
    assert {r.doc_id for r in out} == set(range(1, 3000)) and {r.occurrences for r in out} == {3000}


def test_removed_text_and_offsets(spark):
    df = docs(spark)
    out = line_dedup.remove_repeats(df, line_dedup.repeated_spans(df, min_words=5))
    assert out.columns == [*df.columns, "removed", "original_chars"]
    was = {r.doc_id: r.text for r in df.collect()}
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == was[1] and by[4].text is None and by[7].text == was[7]
    assert by[3].text == "short" and by[2].text == "x y z\n"
    assert [was[3][s.start : s.end] for s in by[3].removed] == [A, B]
    assert by[3].original_chars == len(was[3])


def test_cut_keeps_the_rest():
    assert line_dedup.cut("a\nb\nc", [(0, 1)]) == "b\nc"
    assert line_dedup.cut("a\nb\nc", [(4, 5)]) == "a\nb"
    assert line_dedup.cut("a\nb\n", [(2, 3)]) == "a\n"
    assert line_dedup.cut("a", [(0, 1)]) == ""
    assert line_dedup.cut("a b c\nd", [(2, 3)]) == "a c\nd" and line_dedup.cut("a b", [(2, 3)]) == "a"


def test_repeated_rows_are_one_document_and_empty_tables(spark):
    twice = spark.createDataFrame([(1, A, 1, "x"), (1, A, 1, "x")], SCHEMA)
    assert line_dedup.repeated_spans(twice, min_words=5).count() == 0
    assert line_dedup.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_repeated_long_line_goes_whole_and_short_lines_stay(spark):
    long = prose(7, 80)
    rows = [(1, long, 1, "x"), (2, f"{prose(8, 30)}\n{long}\nend", 1, "x"), (3, f"{A}\n{prose(9, 40)}", 1, "x"), (4, f"{A}\n{prose(10, 40)}", 1, "x")]
    out = line_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    at = len(rows[1][1].split("\n")[0]) + 1
    assert [tuple(r) for r in out] == [(2, at, at + len(long), 1, 0, 2, True)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, A, 1, 2, 3), (2, A, 1, 2, 3)], "doc_id long, text string, removed int, original_chars int, occurrences int")
    out = line_dedup.remove_repeats(df, line_dedup.repeated_spans(df, min_words=5))
    assert out.columns == [*df.columns, "removed_", "original_chars_"]
    assert sorted((r.doc_id, r.text, r.removed, r.original_chars_) for r in out.collect()) == [(1, A, 1, len(A)), (2, "", 1, len(A))]


def test_short_lines_in_a_row_are_a_passage(spark):
    lines = [prose(50 + k, 9) for k in range(4)]
    rows = [(1, "\n".join(["a b", *lines]), 1, "x"), (2, "\n".join([*lines, "\n", prose(60, 9)]), 1, "x"), (3, f"{lines[2]}\nother\n{lines[3]}", 1, "x")]
    got = {tuple(r) for r in line_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([r[:2] for r in rows]) and {r[0] for r in got} == {2} and len(got) == 4
