import math

import numpy as np
from pyspark.sql import functions as F

from driftline import session
from driftline.functions import geo
from driftline.operators import facts, regions


def test_published_distances():
    # Flinders Peak to Buninyong is 54 972.271 m on GRS80; WGS84 differs by less than a millimetre
    km = geo.vincenty([-(37 + 57 / 60 + 3.72030 / 3600)], [144 + 25 / 60 + 29.52440 / 3600], [-(37 + 39 / 60 + 10.15610 / 3600)], [143 + 55 / 60 + 35.38390 / 3600])
    assert abs(km[0] - 54.972271) < 1e-5
    assert geo.vincenty([50.0], [20.0], [50.0], [20.0])[0] == 0
    assert abs(geo.vincenty([0.0], [0.0], [0.0], [179.9])[0] - 20003) < 30
    assert np.isnan(geo.vincenty([np.nan], [0.0], [0.0], [0.0])[0])


def test_expressions(spark):
    df = spark.createDataFrame([(52.23, 21.01, 50.06, 19.94), (50.0, 20.0, 50.0, 20.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    f = lambda g: [r[0] for r in df.select(g(*map(F.col, "abcd"))).collect()]
    sphere, ellipsoid = f(geo.haversine), f(geo.geodesic)
    assert abs(sphere[0] - ellipsoid[0]) < 1 and sphere[1] == 0 and sphere[2] is None and ellipsoid[2] is None
    back = [r[0] for r in df.select(geo.haversine(*map(F.col, "cdab"))).collect()]
    assert abs(back[0] - sphere[0]) < 1e-9


def test_plane_coordinates_and_back(spark):
    for lat, lon in ((52.0, 19.0), (49.3, 14.2), (54.8, 23.9)):
        north, east = geo.to_transverse_mercator(lat, lon)
        r = spark.range(1).select(geo.from_transverse_mercator(F.lit(north), F.lit(east)).alias("p")).first().p
        assert abs(r.lat - lat) < 1e-9 and abs(r.lon - lon) < 1e-9
    assert abs(geo.to_transverse_mercator(52.0, 19.0)[1] - 500_000) < 1e-6


def square(x, y, size=1.0):
    x, y = float(x), float(y)
    return [{"lon": x, "lat": y}, {"lon": x + size, "lat": y}, {"lon": x + size, "lat": y + size}, {"lon": x, "lat": y + size}]


def squares(spark):
    schema = "gid string, geometry array<array<struct<lon:double,lat:double>>>"
    rows = [("a", [square(0, 0)]), ("b", [square(1, 0)]), ("h", [square(5, 5, 4), square(6, 6, 1)])]
    return spark.createDataFrame(rows, schema).select("gid", geo.ring_edges(F.col("geometry")).alias("edges"))


def test_points_and_regions(spark):
    points = [(1, 0.5, 0.5), (2, 0.5, 1.5), (3, 0.5, 1.0), (4, 6.5, 6.5), (5, 5.5, 8.0), (6, None, 1.0), (7, 50.0, 50.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {r.id: r.gid for r in regions.spatial_join(df, squares(spark), "gid").collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: None, 5: "h", 6: None, 7: None}
    right = regions.spatial_join(df.where("id = 1"), squares(spark), "gid", "right").collect()
    assert sorted((r.id or 0, r.gid) for r in right) == [(0, "b"), (0, "h"), (1, "a")]


def test_neighbours_and_moran(spark):
    pairs = regions.neighbours(squares(spark))
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("b", "a")]
    grid = [(f"{x}{y}", [square(x, y)]) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(grid, "gid string, geometry array<array<struct<lon:double,lat:double>>>")
    near = regions.neighbours(df.select("gid", geo.ring_edges(F.col("geometry")).alias("edges")))
    assert near.count() == 84
    values = spark.createDataFrame([(g, float(g[0]) * 2 + 1) for g, _ in grid], "gid string, value double")
    (i, n) = regions.moran(values, near).first()
    statistic, p = regions.moran_test(values, near, 200)
    assert abs(i - statistic) < 1e-9 and n == 16 and i > 0.3 and p < 0.05


def test_closest(spark):
    rows = [("d", "X", 50.0, 20.0), ("d", "X", 54.0, 18.0), ("d", "Y", 50.1, 20.1), ("e", "X", 50.0, 20.0), ("e", "X", 54.0, 18.0), ("f", "Y", 50.1, 20.1)]
    out = {(r.doc, r.city): (r.lat, r.loceval) for r in facts.closest(spark.createDataFrame(rows, "doc string, city string, lat double, lon double")).collect()}
    assert out == {("d", "X"): (50.0, "proximity"), ("d", "Y"): (50.1, "unique"), ("e", "X"): (50.0, "ambiguous"), ("f", "Y"): (50.1, "unique")}


def test_documents_with_the_same_towns_are_one_choice(spark):
    rows = [(d, c, 50.0 + d % 3 + k, 20.0) for d in range(60) for c, n in (("X", 2), ("Y", 3)) for k in range(n)]
    before = set(session._WRITTEN)
    out = facts.closest(spark.createDataFrame(rows, "doc long, city string, lat double, lon double"))
    (chosen,) = [p for p in session._WRITTEN if p not in before]
    assert spark.read.parquet(chosen).count() == 3 * 2
    found = {(r.doc, r.city): (r.lat, r.loceval) for r in out.collect()}
    assert len(found) == 120 and all(found[d, c] == found[d % 3, c] for d, c in found) and found[0, "X"] == found[0, "Y"]


def test_many_choices_are_bettered_one_at_a_time(monkeypatch):
    points = [np.array([[50.0, 20.0], [10.0 + k, 80.0]]) for k in range(6)]
    assert facts._choose(list("abcdef"), points) == [0] * 6
    monkeypatch.setattr(facts, "MOST_CHOICES", 1)
    assert facts._choose(list("abcdef"), points) == [0] * 6
    assert math.isfinite(facts.vincenty([1.0], [1.0], [2.0], [2.0])[0])


def test_places_are_chosen_for_every_order(spark):
    from driftline.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    docs = QUERIES["city_closest_all"](spark, d).select("doc").distinct()
    assert docs.count() == spark.read.parquet(f"{d}/orders.parquet").count()
