import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import analytics, network

COLUMNS = "doc string, id long, lat double, lon double, pgid string, application date, grant date, clsf_A int, clsf_B int"


@pytest.fixture(scope="module")
def edges(spark):
    day = lambda y, m=1: date(y, m, 1)
    people = [
        ("a", 1, 50.0, 20.0, "x", day(2010), day(2011), 1, 0), ("a", 2, None, None, None, day(2010), day(2011), 1, 0),
        ("b", 3, 50.0, 20.0, "x", day(2012), day(2013), 1, 1), ("b", 4, 52.0, 21.0, "y", day(2012), day(2013), 1, 1),
        ("c", 5, 52.0, 21.0, "y", day(2009), day(2010), 0, 0), ("d", 6, 50.0, 20.0, "x", day(2012, 6), day(2014), 0, 0),
    ]
    persons = network.nodes(spark.createDataFrame(people, COLUMNS))
    cites = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d")], "from string, to string")
    return persons, network.network(cites, persons, sections=["A", "B"])


def test_edges(edges):
    _, e = edges
    got = {(r.id, r.idY): r for r in e.collect()}
    assert set(got) == {(1, 3), (1, 4), (2, 3), (2, 4), (5, 6)}
    assert got[1, 3].distance == 0 and got[2, 3].distance is None and 220 < got[1, 4].distance < 240
    assert got[1, 3].tapplication == 730 and got[1, 3].tgrant == 731 and got[1, 3].Jaccard == 0.5 and got[5, 6].Jaccard is None


def test_weighed_persons_count_the_same(spark, edges):
    persons, e = edges
    cites = e.select("from", "to").distinct()
    some = network.network(cites, network.weighed(persons.drop("id")), sections=["A", "B"])
    for f in (lambda x: network.delay_counts(x), lambda x: network.flow(x.dropna(subset=["lat", "latY"])), lambda x: network.region_matrix(x, "pgid"), lambda x: network.choropleth_cited(x, "pgid", (2009, 2020))):
        assert sorted(map(str, f(e).collect())) == sorted(map(str, f(some).collect()))


def test_distance_classes(spark):
    values = [0.0, 0.1, 50.0, 100.0, 100.1, 1000.0, 1001.0, None]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [r[0] for r in df.select(network.distance_class(F.col("d"))).collect()]
    assert got == ["{ 0 }", "(0, 100]", "(0, 100]", "(0, 100]", "(100, 200]", "(500, 1000]", "{ 0 }", "{ 0 }"]


def test_flow_and_matrix(edges):
    _, e = edges
    by = {(r.lat, r.lon): r for r in network.flow(e).collect()}
    assert (by[50.0, 20.0].incoming, by[50.0, 20.0].outgoing, by[50.0, 20.0].kind) == (3, 2, "dopływ")
    assert by[52.0, 21.0].net == 1 and by[52.0, 21.0].frac == 1 / 3
    m = {(r.pgid, r.pgidY): r for r in network.region_matrix(e, "pgid").collect()}
    assert m["x", "x"]["size"] == 0 and m["x", "x"].distance == 0 and m["x", "y"]["size"] == 1
    into, out = network.mean_distances(e)
    assert into.count() == 2 and out.count() == 2


def test_kinds(edges):
    persons, e = edges
    kinds = {(r.doc, r.pgid): (r.generator, r.synthesis) for r in network.cite_kinds(e, persons, "pgid", 2009).collect()}
    assert kinds["a", "x"] == ("cytowane w.&z.", "nie cytujące") and kinds["b", "y"] == ("nie cytowane", "cytujące w.&z.")
    assert kinds["c", "y"] == ("cytowane zewn.", "nie cytujące") and kinds["d", "x"] == ("nie cytowane", "cytujące zewn.")
    counts = network.cite_kind_counts(network.cite_kinds(e, persons, "pgid", 2009), "pgid")
    assert counts.agg(F.sum("size")).first()[0] == 5
    assert -1 <= (network.cite_correlations(counts, "pgid").first().cited_all or 0) <= 1


def test_distributions(spark):
    df = spark.createDataFrame([(float(v), "g") for v in (1, 2, 3, 4, 10)] + [(None, "g")], "v double, g string")
    r = analytics.describe(df, "v").first()
    assert (r["mean"], r["min"], r.q1, r.median, r.q3, r["max"]) == (4.0, 1.0, 2.0, 3.0, 4.0, 10.0) and abs(r["std"] - np.std([1, 2, 3, 4, 10], ddof=1)) < 1e-12
    assert {(x.bin, x["size"]) for x in analytics.histogram(df, "v", 5).collect()} == {(0, 4), (10, 1)}
    assert analytics.nice_step(0, 730, 50) == 20 and analytics.nice_step(1, 1) == 1
    assert analytics.auto_histogram(df, "v", 4).agg(F.sum("size")).first()[0] == 5
    k = analytics.kde(df, "v", 41).orderBy("at").collect()
    h = np.std([1, 2, 3, 4, 10], ddof=1) * 5**-0.2
    want = sum(math.exp(-(((k[7].at - v) / h) ** 2) / 2) for v in (1, 2, 3, 4, 10)) / (5 * h * math.sqrt(2 * math.pi))
    assert len(k) == 41 and abs(k[7].density - want) < 1e-12
    one = spark.createDataFrame([(3.0,)], "v double")
    assert {x.density for x in analytics.kde(one, "v", 5).collect()} == {None}


def test_panels(spark):
    rows = [("a", "r", y, 1.0) for y in range(2013, 2023)] + [("b", "r", y, 1.0) for y in range(2013, 2022)]
    df = spark.createDataFrame(rows, "key string, gid string, year int, value double")
    assert [tuple(r) for r in analytics.complete_keys(df, "key", "gid", "year", "value", (2013, 2022)).collect()] == [("a", "r")]
    wide = analytics.panel(df, ["year"], "key", "value", ["a", "b"])
    assert wide.where("year = 2022").first().b is None
    diff = analytics.yearly_difference(spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 2, 1)], "g string, y int, n int"), ["g"], "y", "n")
    assert {(r.g, r.y, r["diff"]) for r in diff.collect()} == {("a", 1, 0), ("a", 2, -2), ("b", 2, 0)}
    s = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in analytics.shares(s, ["a", "b"]).collect()] == [(0.25, 0.75), (None, None)]
    z = analytics.scaled(s, ["a"]).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(z[0]) < 1e-12 and abs(z[1] - 1) < 1e-12


def merge_cost(values, labels):
    return sum(np.var([v for v, c in zip(values, labels, strict=True) if c == k]) * labels.count(k) for k in set(labels))


def test_ward(spark):
    values = [1.0, 100.0, 2.0, 105.0, 3.0]
    assert analytics.ward(values) == [0, 1, 0, 1, 0]
    assert analytics.ward([5.0]) == [0] and analytics.ward([]) == []
    df = spark.createDataFrame([(f"r{k}", v) for k, v in enumerate(values)], "r string, v double")
    assert {(r.r, r.cluster) for r in analytics.ward_split(df, "r", "v").collect()} == {("r0", 0), ("r1", 1), ("r2", 0), ("r3", 1), ("r4", 0)}
    assert merge_cost(values, analytics.ward(values)) < merge_cost(values, [0, 1, 0, 0, 0])


def test_clusters_and_centrality(spark):
    rows = [(50 + k * 0.01, 20.0, 5, 0) for k in range(5)] + [(54 + k * 0.01, 18.0, 0, 5) for k in range(5)]
    df = spark.createDataFrame(rows, "lat double, lon double, a int, b int")
    out = analytics.kmeans(df, ["lat", "lon"], ["a", "b"], 2).collect()
    assert len({r.kmeans for r in out if r.lat < 52}) == 1 and len({r.kmeans for r in out}) == 2
    towns = spark.createDataFrame([(50.0, 20.0, 2), (50.0, 21.0, 1), (54.0, 18.0, 5)], "lat double, lon double, n int")
    got = {(r.lat, r.lon, r.radius): r.meandist for r in analytics.mean_distance(towns, [None, 100.0]).collect()}
    assert len([k for k in got if k[2] == 100.0]) == 2 and abs(got[50.0, 20.0, 100.0] * 3 - got[50.0, 21.0, 100.0] * 1.5) < 1e-9
    by = analytics.cluster_means(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "kmeans int, a double"), ["a"])
    assert {tuple(r) for r in by.collect()} == {(0, "a", 2.0), (1, "a", 5.0)}


def test_edges_of_some_columns_are_those_of_all(spark):
    from driftline.plans import tables

    d = "/root/testdata/sf0.001"
    by = lambda e: {tuple(r) for r in e.groupBy("from", "to", "wgid", "wgidY").agg(network.edge_count(e)).collect()}
    few = tables.edges(spark, d, ["wgid"])
    assert not {"distance", "Jaccard", "lat", "grant"} & set(few.columns)
    assert by(few) == by(tables.edges(spark, d)) and few.count() < tables.edges(spark, d).count()


def test_weighed_persons_are_counted_by_their_number(spark):
    rows = [("a", 1, 2011, "2011-01-01")] * 3 + [("b", 2, 2012, "2012-01-01")]
    people = spark.createDataFrame(rows, "doc string, w int, year int, application string").withColumn("application", F.to_date("application"))
    cites = spark.createDataFrame([("a", "b")], "from string, to string")
    counts = lambda p: {tuple(r) for r in network.cite_kind_counts(network.cite_kinds(network.network(cites, p), p, "w"), "w").collect()}
    assert counts(network.weighed(people)) == counts(people) and {r[-1] for r in counts(people)} == {3, 1}


def test_quartiles_are_exact_by_group_and_without_a_map_of_all_values(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k % 3 == 2 else f"g{k % 3}", float(v)) for k, v in enumerate(rng.integers(0, 60, 301))] + [("g0", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = analytics.describe(df, "v", ["g"])
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: (r.q1, r.median, r.q3, r.min, r.max) for r in found.collect()}
    for g in (None, "g0", "g1"):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g], [*np.percentile(v, [25, 50, 75]), min(v), max(v)])
    assert got["none"] == (None,) * 5 and len(got) == 4
    assert analytics.describe(df.where("false"), "v").first().median is None
