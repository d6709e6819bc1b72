import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftline.operators.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 40) | st.none(), st.integers(-20, 40)), max_size=40))
def test_any_graph(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = components(df).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_paths_stars_and_direction(spark):
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, k) for k in range(2000, 2400)]
    random.Random(0).shuffle(path)
    edges = path + star + [(b, a) for a, b in star]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == brute(edges)
