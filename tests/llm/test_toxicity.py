import random
import zlib

import pytest

from driftline.llm import toxicity as t

SCHEMA = "doc_id long, text string, score string, held_out int"
FILL = "river house tree walk green under over yellow table window moves slowly".split()


def make(k, toxic, rng):
    words = [rng.choice(FILL) for _ in range(60)]
    if toxic:
        for _ in range(2):
            words.insert(rng.randrange(60), rng.choice(["grubblenak", "grubblefor", "idiot", "zorkish"]))
    return " ".join(words[:30]) + ". " + " ".join(words[30:])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows = [(k, make(k, k % 3 == 0, rng), "x", 1) for k in range(600)]
    rows += [(700, None, "x", 1), (701, "", "x", 1), (702, "river " * 60_000 + "you idiot", "x", 1), (None, "idiot", "x", 1), (0, rows[0][1], "x", 1)]
    labels = [(k, int(k % 3 == 0)) for k in range(600)] + [(5, None), (None, 1), (6, 7), (999, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_transducers():
    i = t.insults(list(t.SYMBOLS))
    assert i.run("^i$") == ["^", "l", "$"] and i.run("^ii$") == ["^", "i", "I", "$"] and i.run("^oioi$") == ["^", "o", "i", "o", "i", "$"]
    h = t.threats(list(t.SYMBOLS))
    assert h.run("fht") == ["f", "o", "h", "t"] and h.run("hot") == ["o", "o", "h", "t"] and h.run("hoot") == ["o", "o", "o", "t"] and h.run("fth") == ["f", "t", "h"]
    n = t.negation(list(t.SYMBOLS))
    assert n.run("noih") == ["n", "o", "i-", "h-"] and n.run("nooooi")[-1] == "i-" and n.run("noooooi")[-1] == "i"
    assert t.reported(list(t.SYMBOLS)).run("iroi") == ["i", "r", "o", 'i"'] and t.reported(list(t.SYMBOLS)).run("mi") == ["m", 'i"']
    assert t.aimed(list(t.SYMBOLS)).run("toi") == ["i>"] and t.aimed(list(t.SYMBOLS)).run("iot") == ["i", "<"]


def test_the_composition_is_one_after_the_other():
    rng = random.Random(0)
    whole = t.grammar()
    for _ in range(800):
        s = ["^", *rng.choices("ihftnrmo", k=rng.randrange(14)), "$"]
        want = s
        parts, alphabet = [], list(t.SYMBOLS)
        for part in t.PARTS:
            parts.append(part(alphabet))
            alphabet = sorted({o for row in parts[-1].table.values() for _, out in row.values() for o in out})
        for part in parts:
            want = part.run(want)
        assert whole.run(s) == want


def plain(words):
    """The events of a clause by its words' classes, by looking around each word instead of reading from left to right."""
    n, out = len(words), []
    marked = lambda k: ("-" if "n" in words[max(0, k - t.SCOPE) : k] else "") + ('"' if {"r", "m"} & set(words[:k]) else "")
    if words == ["i"]:
        return ["l"]
    free = None  # the last insult that no target was before, while nothing has come after it that a target could mean
    for k, w in enumerate(words):
        if w not in "it":
            continue
        near = "t" in words[max(0, k - t.AIM) : k]
        if w == "i":
            kind = "I" if k and words[k - 1] == "i" else "i"
            out.append(kind + marked(k) + (">" if near else ""))
            free = k if not marked(k) and not near else None
        else:
            if free is not None and k - free <= t.AIM and not any(words[j] == "t" for j in range(free, k)):
                out.append("<")
            free = None
    assert n == len(words)
    return out


def test_events_of_all_clauses_without_threats():
    from itertools import product

    whole = t.grammar()
    for n in range(1, 7):
        for words in product("itnro", repeat=n):
            if set(words) & {"i"}:
                assert whole.run(["^", *words, "$"]) == plain(list(words)), words


FIVE = ["idiot", "the word idiot is in a dictionary of english", "he did not call anyone an idiot", "she said he is an idiot", "kill the process then kill the job"]


def test_clauses_count_rather_than_words():
    m = t.Model(t.INSULTS, dict(t.PRIOR), t.PRIOR_BIAS)
    assert m.events("You are an idiot") == {"i>": 1} and m.events("pathetic loser") == {"i": 1, "I": 1}
    assert m.events("you. idiot") == {"l": 1} and m.events("he is not an idiot") == {"i->": 1}
    assert m.events("she said he is an idiot") == {'i">': 1}
    assert m.events("I will kill you") == {"h": 1} and m.events(FIVE[4]) == {}
    assert m.events("skillful idiotic windows") == {}
    assert m.score("you are an idiot") > m.score("idiot") > m.score("he is not an idiot") > m.score("nothing")
    assert m.score("I will kill you") > m.score("they said I will kill you")
    for x in [*FIVE, "some trash is in the yard"]:
        assert m.score(x) < t.PREDICTED_FROM <= m.score("you are a worthless idiot")


def test_marks_change_predictions(tables):
    """Ablation: without the marks of negation, reporting and mention the same words are predicted."""
    model = t.train(*tables)
    bare = t.Model(model.terms, model.weights, model.bias)
    bare.words = {w: c for w, c in bare.words.items() if c not in (t.NEGATION, t.REPORT, t.MENTION)}
    for text in ("you are not an idiot and a moron", "she said you are an idiot and a moron", "the words idiot and moron hurt you"):
        assert model.score(text) < t.PREDICTED_FROM <= bare.score(text), text
    assert all(model.score(x) < t.PREDICTED_FROM for x in FIVE)


def test_held_out_documents_and_learnt_stems(tables):
    docs, labels = tables
    model = t.train(docs, labels)
    assert any(x.startswith("grubb") for x in model.terms) and any(x.startswith("zork") for x in model.terms)
    truth = dict(labels.where("toxic in (0, 1) and doc_id < 600").collect())
    for r in t.score(docs, model).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
        if r.doc_id in (700, 701):
            assert r.predicted == 0
        if r.doc_id == 702:
            assert r.predicted == 1


def test_held_out_labels_change_nothing(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    other = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = t.train(docs, labels), t.train(docs, other)
    assert (a.terms, a.weights, a.bias) == (b.terms, b.weights, b.bias)


def test_without_labels_or_documents(spark, tables):
    docs, labels = tables
    model = t.train(docs, labels.where("false"))
    by = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    assert by[702] > by[700] == by[701]
    assert t.score(docs.where("false"), model).count() == 0
