import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import entity, facts, names, registers, relational

SECTIONS = [f"clsf_{s}" for s in registers.SECTIONS]


def test_dictionary(spark):
    rows = [
        (1, 1, "ACME INC.", "names", None), (2, 1, "Vincent", "firstnames", None), (3, 1, "Theodor", "firstnames", None), (4, 1, "Nowak", "names", "legal"),
        (5, 1, "Jan", "firstnames", None), (6, 1, "Jan", "lastnames", None), (7, 1, "Kowalski", "lastnames", None), (8, 1, "Ewa Ziemba", "names", None),
        (9, 1, "The Works", "names", None), (10, 1, None, "names", None), (11, 1, "A & B", "names", None),
    ]
    df = spark.createDataFrame(rows, "doc long, id long, value string, assignement string, type string")
    got = {r.value: r.role for r in names.dictionary(df).collect()}
    assert got == {
        "ACME INC": "orgname", "VINCENT": "firstname", "THEODOR": "firstname", "NOWAK": "orgname", "JAN": "ambigname", "KOWALSKI": "lastname",
        "EWA": "ambigname", "ZIEMBA": "ambigname", "THE WORKS": "orgname", "A B": "orgname",
    }
    loose = {r.value: r.role for r in names.dictionary(df, literal=False).collect()}
    assert loose["VINCENT"] == "orgname" and loose["THEODOR"] == "orgname"


def test_classified(spark):
    known = spark.createDataFrame([("ACME", "orgname"), ("JAN", "firstname"), ("NOWAK", "lastname"), ("EWA", "ambigname")], "value string, role string")
    rows = [(k, 1, v, c, True, False, True) for k, (v, c) in enumerate([("ACME", None), ("JAN NOWAK", None), ("JAN NOWAK", "X"), ("JAN UNKNOWN", "X"), ("EWA", "X")])]
    df = spark.createDataFrame(rows, "id long, doc long, value string, city string, assignee boolean, applicant boolean, inventor boolean")
    got = {r.id: (r.organisation, r.firstnames, r.lastnames) for r in names.classified(df, known).collect()}
    assert got == {0: (True, None, None), 1: (False, "JAN", "NOWAK"), 2: (False, "JAN", "NOWAK"), 3: (None, None, None), 4: (False, None, None)}


def test_pulled(spark):
    rows = [
        ("d", "1", "inv", "last", "Kowalski", "lastnames-inventor"), ("d", "1", "inv", "first", "Jan", "firstnames-inventor"),
        ("d", "2", "app", "name", "Łoś sp.", "names-applicant"), ("d", "3", "own", "name", "Łoś sp.", "names-assignee"),
    ]
    df = spark.createDataFrame(rows, "doc string, id string, frame string, col string, value string, assignement string")
    cities = spark.createDataFrame([("d", "1", "Kraków 30-001")], "doc string, id string, value string")
    got = {r.value: (r.city, r.assignee, r.applicant, r.inventor) for r in registers.pulled(df, cities).collect()}
    assert got == {"JAN KOWALSKI": ("KRAKOW", False, False, True), "LOS SP.": (None, True, True, False)}


@pytest.fixture(scope="module")
def placed(spark):
    named = spark.createDataFrame([(1, "d", "X"), (2, "d", None), (3, "e", "Y")], "id long, doc string, city string")
    geoloc = spark.createDataFrame([("d", "X", 1.0, 2.0, "unique")], "doc string, city string, lat double, lon double, loceval string")
    raw = [("d", "date-application", "2011-05-01"), ("d", "date-grant", "2012-01-01"), ("d", "date-grant", "2011-12-01"), ("d", "date-priority", "2009-01-01"), ("e", "date-grant", "x"), ("e", "date-application", "2010-01-01")]
    events = facts.events(spark.createDataFrame(raw, "doc string, assignement string, value string"))
    classes = facts.classes(
        spark.createDataFrame([("d", "1", "IPC", "A61K 31/00"), ("d", "2", "IPC", "A 01"), ("d", "1", "CPC", "B"), ("e", "1", "IPC", "-")], "doc string, id string, assignement string, value string"),
        spark.createDataFrame([("e", "1", "IPCR-section", "H"), ("e", "1", "IPCR-class", "04")], "doc string, id string, assignement string, value string"),
    )
    return registers.placed(named, geoloc, events, classes)


def test_placed_and_selected(placed):
    by = {r.id: r for r in placed.collect()}
    assert by[1].grant == date(2011, 12, 1) and by[1].firstdate == date(2009, 1, 1) and (by[1].lat, by[1].loceval) == (1.0, "unique")
    assert by[1].clsf_A == 2 and by[1].clsf_B == 1 and by[1].clsf_H == 0 and by[1].IPC == ["A"] and by[1].CPC == ["B"]
    assert by[2].lat is None and by[3].clsf_H == 1 and by[3].grant is None and by[3].IPCR == ["H"]
    assert {r.id for r in registers.selected(placed).collect()} == {1, 2}
    assert {r.loceval: r["size"] for r in registers.location_report(placed).collect()} == {"unique": 1, "not given": 1, "not found": 1}
    assert {r.column: r.missing for r in registers.missing_report(placed, ["lat", "doc"]).collect()} == {"lat": 2, "doc": 0}


def test_events_and_codes(spark):
    raw = spark.createDataFrame([("d", "date-grant", "2012-01-11"), ("d", "date-grant", "2012-01-11"), ("e", "date-fill", "2012-01-01")], "doc string, assignement string, value string")
    got = {(r.doc, r.event): (r.year, r.delay) for r in facts.events(raw).collect()}
    assert got == {("d", "grant"): (2012, 10), ("e", "fill"): (2012, 0)}
    code = spark.createDataFrame([("d", "P.123 456"), ("e", "x")], "doc string, value string")
    assert [tuple(r) for r in facts.codes(code).collect()] == [("d", "P", "123456")]
    assert [tuple(r) for r in facts.codes(code, "PL").collect()] == [("d", "PL", "123456")]


def test_places(spark):
    gaz = spark.createDataFrame([("miasto", "Kraków", 50.06, 19.94), ("wieś", "Kraków", 53.0, 15.0), ("miasto", "Łódź", 51.77, 19.45)], "type string, city string, lat double, lon double")
    eav = spark.createDataFrame([("d", "Kraków, 30-001; ŁÓDŹ"), ("e", "~")], "doc string, value string")
    assert {(r.doc, r.city, r.lat, r.loceval) for r in facts.places(eav, gaz).collect()} == {("d", "KRAKOW", 50.06, "unique"), ("d", "LODZ", 51.77, "unique")}
    assert facts.distances(gaz).count() == 4


def test_places_are_those_of_trying_all():
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(40):
        points = [np.round(np.column_stack([rng.uniform(49, 54, k), rng.uniform(14, 24, k)]), 1) for k in rng.integers(1, 5, rng.integers(2, 5))]
        if rng.random() < 0.5:
            points[0] = np.repeat(points[0], 2, axis=0)  # ties
        flat, start = np.concatenate(points), np.cumsum([0, *map(len, points)])
        n = len(flat)
        a, b = np.divmod(np.arange(n * n), n)
        apart = facts.vincenty(*flat[a].T, *flat[b].T).reshape(n, n)
        picks = list(product(*[range(start[k], start[k + 1]) for k in range(len(points))]))
        sums = [apart[np.ix_(p, p)].sum() for p in picks]
        want = max(p for p, t in zip(picks, sums, strict=True) if t == min(sums))
        assert facts._choose(points) == [x - s for x, s in zip(want, start[:-1], strict=True)]


def test_many_ambiguous_names_are_settled_exactly():
    rng = np.random.default_rng(5)
    near = [np.array([[52 + x, 20 + y], [40 + 3 * x, 5 + 9 * y]]) for x, y in rng.uniform(0, 0.5, (20, 2))]  # 2 ** 20 combinations
    assert facts._choose(near) == [0] * 20


def people(spark):
    rows = []
    place = {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (1.0, 1.0), 3: (None, None), 4: (2.0, 2.0), 5: (1.0, 1.0)}
    value = {0: "JAN NOWAK", 1: "JAN NOWAK", 2: "JAN NOWAK", 3: "JAN NOWAK", 4: "EWA ZIEMBA", 5: "JAN NOWAK"}
    section = {0: "A", 1: "A", 2: "B", 3: "A", 4: "A", 5: "A"}
    for k in range(6):
        rows.append((k, f"d{k}", "", value[k], "", k == 5, *place[k], "unique" if place[k][0] else None, *[int(s == section[k]) for s in registers.SECTIONS]))
    columns = ", ".join(f"{c} int" for c in SECTIONS)
    return spark.createDataFrame(rows, f"id long, doc string, firstnames string, value string, lastnames string, organisation boolean, lat double, lon double, loceval string, {columns}")


def test_similarity_and_entities(spark):
    df = people(spark)
    pairs = entity.similarity(entity.coauthors(df))
    by = {(r.idL, r.idR): r for r in pairs.collect()}
    assert set(by) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert by[0, 1].geomatch and (by[0, 1].clsfmatch, by[0, 1].clsfdiff) == (1, 0) and (by[0, 2].clsfmatch, by[0, 2].clsfdiff) == (0, 1)
    assert not by[0, 3].geomatch and by[0, 1].nameaffil == 1 and by[0, 1].geoaffil == 1 and by[0, 3].geoaffil == 1
    got = {r.id: r.entity for r in entity.identify(pairs, df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(2)
    names_ = [f"JAN{k} NOWAK" for k in range(16)]
    rows = []
    for k in range(160):
        lat = rng.choice([None, 1.0, 2.0])
        counts = [rng.choice([0, 0, 0, 1, 2, 3]) if s in "AB" else 0 for s in registers.SECTIONS]
        rows.append((k, f"d{rng.randrange(110)}", "", rng.choice(names_), "", rng.random() < 0.05, lat, lat, None, *counts))
    columns = ", ".join(f"{c} int" for c in SECTIONS)
    df = entity.coauthors(spark.createDataFrame(rows, f"id long, doc string, firstnames string, value string, lastnames string, organisation boolean, lat double, lon double, loceval string, {columns}"))
    want = {r.id: r.entity for r in entity.identify(entity.similarity(df), df).collect()}
    assert {r.id: r.entity for r in entity.identify_all(df).collect()} == want
    assert len(set(want.values())) > 20


def test_chains_are_one_entity(spark):
    ids = spark.createDataFrame([(k,) for k in range(50)], "id long")
    rows = [(k, k + 1, 1, 1, 1, 0, True) for k in range(39)] + [(45, 47, 1, 1, 1, 0, True), (47, 46, 1, 1, 0, 1, True)]
    pairs = spark.createDataFrame(rows, "idL long, idR long, nameaffil int, geoaffil int, clsfmatch int, clsfdiff int, geomatch boolean")
    got = {r.id: r.entity for r in entity.identify(pairs, ids).collect()}
    assert all(got[k] == 0 for k in range(40)) and got[47] == 45 and got[46] == 46


def test_filled_places(spark):
    rows = [(1, "e", "d", 1.0, 1.0, "unique"), (2, "e", "d", 2.0, 2.0, "unique"), (3, "e", "d", None, None, None), (4, "f", "d", None, None, None), (5, "g", "h", None, None, None)]
    df = spark.createDataFrame(rows, "id long, entity string, doc string, lat double, lon double, loceval string")
    got = {r.id: (r.lat, r.loceval) for r in entity.fill_all(df).collect()}
    assert got == {1: (1.0, "unique"), 2: (2.0, "unique"), 3: (1.0, "identity"), 4: (1.0, "document"), 5: (None, None)}


def test_relational(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 7)], "k string, v int")
    assert {tuple(r) for r in relational.keep_first(df, ["k"], [F.col("v")]).collect()} == {("a", 1), ("b", 5), (None, 7)}
    assert {(r.k, r.n) for r in relational.group_number(df, ["k"], "n", 10).collect()} == {(None, 10), ("a", 11), ("b", 12)}
    assert [r.id for r in relational.row_ids(df, [F.col("v")]).orderBy("v").collect()] == [0, 1, 2, 3]
    other = spark.createDataFrame([("a", 4), ("c", 1)], "k string, v int")
    sums = df.groupBy("k").agg(F.sum("v").alias("v"))
    assert {tuple(r) for r in relational.difference(sums, other, ["k"], "v").collect()} == {("a", -1), ("b", 5), ("c", -1)}
    assert {(r.v, r.f) for r in relational.flagged(df, other.select("k"), "k", "f").collect()} == {(2, True), (1, True), (5, False), (7, False)}
    for check in (lambda: relational.expect_unique(df, ["k"]), lambda: relational.expect_columns(df, ["z"]), lambda: relational.expect_no_nulls(df, ["k"])):
        with pytest.raises(ValueError):
            check()
    assert relational.expect_unique(df, ["v"]) is df


def test_pairs_are_the_same_with_and_without_tables_and_broadcasts(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        lat = rng.choice([None, 1.0, 2.0])
        counts = [rng.choice([None, 0, 1, 2]) if s in "AB" else 0 for s in registers.SECTIONS]
        rows.append((k, f"d{rng.randrange(40)}", "", f"JAN{rng.randrange(4)} NOWAK", "", False, lat, lat, None, *counts))
    columns = ", ".join(f"{c} int" for c in SECTIONS)
    df = entity.coauthors(spark.createDataFrame(rows, f"id long, doc string, firstnames string, value string, lastnames string, organisation boolean, lat double, lon double, loceval string, {columns}"))
    pairs = lambda: sorted(map(tuple, entity.similarity(df).collect()))
    found = entity.similarity(df)
    assert "array_union" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(entity, "MOST_SETS", 0)
    assert pairs() == want
    monkeypatch.setattr(entity, "MOST_PEOPLE", 0)
    assert pairs() == want and len(want) > 1000


def test_equal_names_are_judged_once(spark):
    rows = [(k, 1, "ACME (PL) & Co.*", "names", None) for k in range(5)] + [(9, 1, "A.B", "names", None)]
    found = names.dictionary(spark.createDataFrame(rows, "doc long, id long, value string, assignement string, type string"), parts=["(PL)", ".*"])
    assert {r.value: r.role for r in found.collect()} == {"ACME PL CO": "orgname", "A": "ambigname", "B": "ambigname"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Contains(") == 0


def test_persons_are_pulled_in_one_shuffle_and_values_judged_once(spark):
    rows = [(f"d{k % 9}", str(k % 2), "f", f"c{k}", v, "names-applicant") for k, v in enumerate(["JAN NOWAK", "ACME", "X Y"] * 12)] + [(None, "1", "f", "c", "ACME", "names-assignee")]
    df = spark.createDataFrame(rows, "doc string, id string, frame string, col string, value string, assignement string")
    cities = spark.createDataFrame([("d1", "1", "B"), ("d1", "1", "A"), (None, "1", "C"), ("e", "1", "D")], "doc string, id string, value string")
    found = registers.pulled(df, cities)
    got = found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2  # of the plan and of its first form
    assert {(r.doc, r.city) for r in got} == {(f"d{k}", None) for k in range(9)} | {("d1", "A"), (None, None)}
    known = spark.createDataFrame([("ACME", "orgname"), ("JAN", "firstname"), ("NOWAK", "lastname")], "value string, role string")
    judged = {(r.value, r.organisation, r.firstnames, r.lastnames) for r in names.classified(found, known).collect()}
    assert judged == {("JAN NOWAK", False, "JAN", "NOWAK"), ("ACME", True, None, None), ("X Y", None, None, None)}
    assert names.classified(found, known).count() == len(got)
