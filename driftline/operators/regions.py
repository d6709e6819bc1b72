"""Registers and regions: which region a point is in, neighbours, and spatial correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import within
from ..session import checked_small


def boxed(regions: DataFrame) -> DataFrame:
    """regions (gid, edges) with the box around each."""
    side = lambda f, k: f(F.transform("edges", lambda e: e[k]))
    return regions.withColumns({"x0": side(F.array_min, "x1"), "x1": side(F.array_max, "x1"), "y0": side(F.array_min, "y1"), "y1": side(F.array_max, "y1")})


def spatial_join(points: DataFrame, regions: DataFrame, name: str, how: str = "left") -> DataFrame:
    """points (lat, lon, ...) with the gid of the region each is within as `name`, null for none; how='right' keeps empty regions.

    Distinct points are looked up, once each: boxes rule out most regions and the even-odd rule decides.
    Regions are a table of places; points on a border are in none. A point in several regions has a row for each.
    """
    places = points.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    boxes = checked_small(boxed(regions.select("gid", "edges")), 100_000)
    near = places.join(boxes, (F.col("lon") >= F.col("x0")) & (F.col("lon") <= F.col("x1")) & (F.col("lat") >= F.col("y0")) & (F.col("lat") <= F.col("y1")))
    found = near.where(within(F.col("lon"), F.col("lat"), F.col("edges"))).select("lat", "lon", F.col("gid").alias(name))
    out = points.join(found, ["lat", "lon"], "left").select(*points.columns, name)
    if how == "left":
        return out
    return out.join(regions.select(F.col("gid").alias(name)), name, "right").select(*points.columns, name)


def mapped(registers: DataFrame, larger: DataFrame, smaller: DataFrame) -> DataFrame:
    """registers with wgid and pgid, the larger and the smaller region."""
    return spatial_join(spatial_join(registers, larger, "wgid"), smaller, "pgid")


def named(table: DataFrame, regions: DataFrame, columns: list[str]) -> DataFrame:
    """table with the name of the region in each of the columns as <column>_name, null for unknown ones; regions is (gid, name)."""
    names = checked_small(regions.select(F.col("gid").alias("__gid"), F.col("name").alias("__name")).dropDuplicates(["__gid"]))
    for c in columns:
        table = table.join(names.withColumnsRenamed({"__gid": f"__{c}", "__name": f"{c}_name"}), F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}")
    return table


def neighbours(regions: DataFrame, digits: int = 9) -> DataFrame:
    """(gid, gid2): regions that share a border point, both ways (Queen contiguity)."""
    corners = regions.select("gid", F.explode("edges").alias("e")).select("gid", F.round("e.x1", digits).alias("x"), F.round("e.y1", digits).alias("y")).distinct()
    other = corners.withColumnRenamed("gid", "gid2")
    return corners.join(other, ["x", "y"]).where("gid <> gid2").select("gid", "gid2").distinct()


def moran(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(I, n): Moran's I of (gid, value) with row-standardised weights of (gid, gid2). Regions without neighbours count in the mean only.

    Null if all values are equal.
    """
    mean = values.agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    z = values.crossJoin(F.broadcast(mean)).select("gid", (F.col("value") - F.col("m")).alias("z"), "n")
    weight = pairs.groupBy("gid").agg((F.lit(1.0) / F.count("*")).alias("w"))
    left = pairs.join(weight, "gid").join(z, "gid")
    right = z.select(F.col("gid").alias("gid2"), F.col("z").alias("z2"))
    crossed = left.join(right, "gid2").agg(F.sum(F.col("w") * F.col("z") * F.col("z2")).alias("a"), F.sum("w").alias("w"))
    square = z.agg(F.sum(F.col("z") * F.col("z")).alias("b"), F.max("n").alias("n"))
    return crossed.crossJoin(square).select(F.try_divide(F.col("n") * F.col("a"), F.col("w") * F.col("b")).alias("I"), "n")


def moran_test(values: DataFrame, pairs: DataFrame, permutations: int = 1000, seed: int = 1) -> tuple[float, float]:
    """Moran's I and the share of seeded permutations with at least as large a one. For a few thousand regions, on the driver."""
    rows = values.orderBy("gid").collect()
    at = {r.gid: k for k, r in enumerate(rows)}
    z = np.array([r.value for r in rows], float)
    z -= z.mean()
    w = np.zeros((len(z), len(z)))
    for a, b in pairs.collect():
        if a in at and b in at:
            w[at[a], at[b]] = 1
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1)
    scale = len(z) / w.sum() / (z @ z)
    statistic = scale * (z @ w @ z)
    rng = np.random.default_rng(seed)
    larger = sum(scale * (p @ w @ p) >= statistic for p in (rng.permutation(z) for _ in range(permutations)))
    return float(statistic), float((larger + 1) / (permutations + 1))
