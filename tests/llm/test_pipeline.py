import re
from itertools import combinations

import pytest

import corpus_pipeline as p
from driftline.llm import exact_dedup, language_id, mixing, packing, simhash
from driftline.llm.queries import ORACLES, QUERIES, tokenizer_path
from driftline.session import written

from .test_mixing import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, f in p.STAGES:
        out.append(written(f(spark, out[-1], DIR), "stage"))
    return out


def test_stages_keep_the_columns_and_decide(stages):
    docs, language, exact, near, mixed, packed = stages
    for d in (language, exact, near, mixed):
        assert d.columns == docs.columns
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in stages]
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2]) and set(ids[4]) <= set(ids[3]) and set(ids[5]) == set(ids[4])
    kept = {r.doc_id for r in language_id.identify(docs).where("not rejected").collect()}
    assert set(ids[1]) == kept and len(kept) > 0.95 * len(ids[0])
    texts = [r.text for r in exact.select("text").collect()]
    plain = {" ".join(t.split()) for t in texts}
    assert len(plain) >= len(texts) - 1
    gone = {r.doc_id for r in simhash.near_components(exact, **simhash.NEAR).where("doc_id <> component_id").collect()}
    assert set(ids[3]) == set(ids[2]) - gone
    copies = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.mix(near).collect()}
    assert {i: ids[4].count(i) for i in set(ids[4])} == {i: n for i, n in copies.items() if n}


def test_packed_tokens_are_those_of_the_mix(stages):
    mixed, packed = stages[4], stages[5]
    encoder = packing.Encoder(tokenizer_path())
    want = sum(len(encoder.encode(r.text or "")) // 4 + 1 for r in mixed.select("text").collect())
    assert sum(r["length"] for r in packed.collect()) == want


WHITE = r"[\x20\x09-\x0D]+"


def first_of_equals(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(WHITE, " ", r.text or ""), r.doc_id)
    return set(first.values())


def first_of_alike(rows):
    """All pairs of sets of five words, and what they join."""
    sets = {}
    for r in rows:
        w = [x for x in re.split(WHITE, re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")) if x]
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_stages_against_brute_force(stages):
    docs, language, exact, near, mixed, _ = (d.collect() for d in stages)
    ids = lambda rows: {r.doc_id for r in rows}
    learned = language_id.dictionaries(stages[0], "doc_id", "text", "lang")
    judge = language_id.Classifier(learned)
    assert ids(language) == {r.doc_id for r in docs if not judge(r.text)[2]}
    assert ids(exact) == first_of_equals(language) and len(exact) == len(ids(exact)) < len(language)
    assert ids(near) == first_of_alike(exact) and len(near) == len(ids(near))
    taken = brute([(r.doc_id, r.text, r.source) for r in near])
    copies = {i: n // size if size else 1 for i, (size, _, _, n) in taken.items()}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))


def test_ties_repeated_rows_and_null_ids_keep_their_texts(spark):
    long = "this sentence has words enough for its language to be told and none of its words are rare in english "
    rows = [(1, long + "one two", "en", "a", 0), (5, long + "one  two", "en", "a", 0), (5, "another " + long[::-1], "en", "b", 0), (1, long + "one two", "en", "a", 0), (None, long.upper() * 2, "en", None, 0), (None, long.upper() * 2, "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = df
    for _, f in p.STAGES[1:3]:
        out = written(f(spark, out, DIR), "stage")
    assert sorted(str((r.doc_id, r.text[:12])) for r in out.collect()) == sorted(str(x) for x in [(1, long[:12]), (5, ("another " + long[::-1])[:12]), (None, long.upper()[:12])])
    for _, f in p.STAGES[3:]:
        out = written(f(spark, out, DIR), "stage")
    assert out.count() > 0


def test_run_is_the_stages(spark, stages):
    got = p.run(spark, DIR)
    assert got.count() == stages[-1].count() and got.columns == stages[-1].columns


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in p.STAGES:
        docs = written(f(spark, docs, DIR), "stage")
    assert docs.count() == 0


def test_every_operator_has_its_query():
    assert sorted({int(k[2:].split("_")[0]) for k in QUERIES}) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_filters_pass_clashing_names(spark):
    schema = "doc_id long, text string, row string, key string, digest string, maybe int, size int, h int, lang_pred string, lang string, source string"
    rows = [(k, f"text number {k % 3} and more words", "r", "k", "d", 1, 2, 3, "x", "en", "s") for k in range(9)]
    df = spark.createDataFrame(rows, schema)
    for f in (exact_dedup.keep_first, simhash.keep_one, mixing.apply_mix, language_id.keep_identified):
        out = f(df)
        assert out.columns == df.columns
        out.collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    df, want = QUERIES[name](spark, DIR), con.sql(ORACLES[name])
    at = sorted(df.columns)
    assert sorted(want.columns) == at
    got = sorted(str([r[c] for c in at]) for r in df.collect())
    pos = [want.columns.index(c) for c in at]
    assert got == sorted(str([r[k] for k in pos]) for r in want.fetchall())


def test_every_stage_begins_with_tidied_executors(spark, monkeypatch):
    class Tidied(Exception):
        pass

    def tidied(session):
        raise Tidied

    monkeypatch.setattr(p, "tidy_executors", tidied)
    for _, begin in p.STAGES:
        with pytest.raises(Tidied):
            begin(spark, None, DIR)


def test_tidied_executors_have_collected_garbage(spark):
    jvm = spark.sparkContext._jvm
    garbage = jvm.java.util.ArrayList()
    seen = jvm.java.lang.ref.WeakReference(garbage)
    spark.sparkContext._gateway.detach(garbage)
    assert not seen.refersTo(None)
    p.tidy_executors(spark)
    assert seen.refersTo(None)
