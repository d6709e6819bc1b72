"""Connected components of an edge table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Row count and a content sum: equal for equal edge sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, both: bool, rows: int) -> DataFrame:
    """One star step. both=True links larger neighbours to the least neighbour, both=False the smaller ones."""
    if both:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written apart from the join below, so that a hub's side of it can be split
    least = written(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least", rows)
    out = near.join(least, "u")
    if both:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return written(out.where("u <> v").distinct(), "star", rows)


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Labels (node, component) for every node of an edge, component being the least node that it reaches.

    Alternating large-star and small-star steps over a written edge table until nothing
    changes. Each node keeps one row per step, so a hub costs a partial aggregate and a
    splittable join, never one task for its neighbourhood.
    Nulls and loops are ignored; an empty edge table gives an empty result.
    """
    edges = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    edges = written(edges.where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = _star(_star(edges, True, 2 * before[0]), False, 2 * before[0])
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
