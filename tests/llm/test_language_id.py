import random
import zlib

import pytest

from driftline.llm import language_id

WORDS = {
    "en": "the and of with house river walking never often thing where through".split(),
    "de": "der und das nicht häuser straße gehen immer über zwischen möglich".split(),
    "fr": "le et les avec maison rivière toujours être où déjà français nous".split(),
}
SCHEMA = "doc_id long, text string, lang string, score string, source string"


def text(lang, k, n=60):
    return " ".join(WORDS[lang][(k * 7 + j * j * 3 + j) % len(WORDS[lang])] for j in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, text(lang, k), lang, "x", "y") for k, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en", "x", "y"), (1001, "", None, "x", "y"), (1002, "123 ... 456", "fr", "x", "y"), (1003, text("de", 5, 40_000), None, "x", "y")]
    rows += [(None, text("fr", 3), "fr", "x", "y"), (0, text("en", 0), "en", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_held_out_accuracy(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = language_id.identify(docs).collect()
    assert len(out) == docs.count()
    tested = [r for r in out if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(tested) > 30 and all(r.lang_pred == truth[r.doc_id] for r in tested)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.rejected == (r.score < 0.5)


def test_texts_without_letters_and_whole_texts(docs):
    by = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "de"
    learned = {lang: " ".join(text(lang, k) for k in range(200, 230)).encode() for lang in WORDS}
    rng = random.Random(3)
    mixed = rng.choices(WORDS["en"], k=400) + rng.choices(WORDS["de"], k=4000)
    assert language_id.Classifier(learned)(" ".join(mixed))[0] == "de"


def test_held_out_labels_change_nothing(docs):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    pick = lambda d: sorted((r.doc_id or -1, r.lang_pred, r.score) for r in language_id.identify(d).collect())
    assert pick(docs) == pick(other)


def test_ties_are_rejected():
    same = {"a": b"one two three " * 50, "b": b"one two three " * 50}
    assert language_id.Classifier(same)("one two") == ("a", 0.0, True)


def test_filter_and_empty_tables(spark, docs):
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.identify(empty).count() == 0
    nothing = docs.withColumn("lang", docs.lang.substr(1, 0)).where("false").unionByName(docs.selectExpr("doc_id", "text", "cast(null as string) lang", "score", "source"))
    assert {r.lang_pred for r in language_id.identify(nothing).collect()} == {"und"}


def test_dictionaries_take_from_all_of_a_text_and_from_every_text(spark):
    parts = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}abcdefghi " * 28 for k in range(40)]  # pieces that tell where they come from
    rows = [(0, "".join(parts), "aa")] + [(100 + k, f"own{chr(97 + k % 26)}{chr(97 + k // 26)} " * 50, "bb") for k in range(60)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2] + [(7, None, "aa"), (8, "", "bb"), (9, "x", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.dictionaries(df, "doc_id", "text", "lang")
    heads = {k for k in range(len(parts[0]) * 40 // language_id.PIECE + 1) if language_id.letters("".join(parts)[k * language_id.PIECE :][: language_id.PIECE]).encode() in learned["aa"]}
    assert len(heads) == language_id.PIECES and max(heads) > 2 * language_id.PIECES
    assert all(f" {t[:5]} ".encode() in learned["bb"] for _, t, lang in rows if lang == "bb" and t)
    assert len(language_id.dictionaries(df, "doc_id", "text", "lang", size=500)["bb"]) <= 500
    assert set(language_id.dictionaries(df, "doc_id", "text", "lang", most=1)) == {"bb"}
