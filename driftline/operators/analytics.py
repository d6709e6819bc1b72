"""Distributions, panels, clusters and centrality."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..session import checked_small, written

DESCRIBED = ["mean", "std", "min", "q1", "median", "q3", "max"]


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, least, quartiles by linear interpolation, and largest value.

    Quartiles are found among counted values that lie in ranges, so no task has all values of a group.
    """
    by = by or []
    values = [F.avg(column), F.stddev_samp(column), F.min(column), F.max(column)]
    basic = df.groupBy(*by).agg(*[v.cast("double").alias(n) for v, n in zip(values, ["mean", "std", "min", "max"], strict=True)])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    ranged = written(counts.repartitionByRange(n, *by, "__v").withColumn("__part", F.spark_partition_id()), "values")
    part = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__in"))
    known = Window.partitionBy(*by)
    part = part.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), F.sum("__in").over(known).alias("__all"), (F.sum("__in").over(known.orderBy("__part")) - F.col("__in")).alias("__start"))
    same = lambda side: [F.col(c).eqNullSafe(F.col(f"{side}{c}")) for c in by]
    placed = ranged.withColumn("__end", F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__v")))
    placed = placed.join(part, [F.col("__part") == F.col("__p"), *same("__")]).withColumn("__end", F.col("__end") + F.col("__start"))
    quartiles = []
    for name, p in zip(["q1", "median", "q3"], [0.25, 0.5, 0.75], strict=True):
        at = F.col("__all").cast("double") - 1
        holds = lambda k: F.max(F.when((F.col("__end") > k) & (F.col("__end") - F.col("__n") <= k), F.col("__v").cast("double")))
        low, high, share = holds(F.floor(at * p)), holds(F.ceil(at * p)), F.max(at * p - F.floor(at * p))
        quartiles.append((low * (1 - share) + high * share).alias(name))
    found = placed.groupBy(*by).agg(*quartiles).withColumnsRenamed({c: f"__{c}" for c in by})
    return basic.join(found, same("__") or F.lit(True), "left").select(*by, *DESCRIBED)


def histogram(df: DataFrame, column: str, step: float, by: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Counts by the lower bound of bins of one width; nulls are left out."""
    bin_ = (F.floor(F.col(column) / step) * step).alias(name)
    return df.where(F.col(column).isNotNull()).groupBy(*(by or []), bin_).agg(F.count("*").alias("size"))


def nice_step(least: float, most: float, bins: int = 50) -> float:
    """The least of 1, 2 or 5 times a power of ten that gives at most so many bins."""
    width = (most - least) / bins
    if width <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(width))
    return next(m * power for m in (1, 2, 5, 10) if m * power >= width * (1 - 1e-12))


def auto_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    row = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    return histogram(df, column, nice_step(float(row.a or 0), float(row.b or 0), bins))


def kde(df: DataFrame, column: str, points: int = 101, bandwidth: float | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, at, density): a Gaussian kernel's density on a grid from the least to the largest value, Scott's bandwidth by default.

    Values are counted first, so the grid meets distinct values and not rows. A group of one value has no density of its own: null.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    mean = F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")
    square = F.sum(F.col("__v") * F.col("__v") * F.col("__n"))
    total = F.sum("__n").alias("__total")
    spread = counts.groupBy(*by).agg(total, mean.alias("__m"), square.alias("__s"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    var = F.greatest((F.col("__s") - F.col("__total") * F.col("__m") * F.col("__m")) / F.nullif(F.col("__total") - 1, F.lit(0)), F.lit(0.0))
    width = F.lit(float(bandwidth)) if bandwidth else F.nullif(F.sqrt(var), F.lit(0.0)) * F.pow(F.col("__total"), F.lit(-0.2))
    grid = spread.withColumn("__h", width).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("at", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__k") / (points - 1))
    joined = counts.join(F.broadcast(grid), by) if by else counts.crossJoin(F.broadcast(grid))
    u = (F.col("at") - F.col("__v")) / F.col("__h")
    kernel = F.exp(-u * u / 2) * F.col("__n") / (F.col("__h") * F.col("__total") * math.sqrt(2 * math.pi))
    return joined.groupBy(*by, "__k", "at").agg(F.sum(kernel).alias("density")).drop("__k")


def yearly_difference(df: DataFrame, by: list[str], year: str, value: str, name: str = "diff") -> DataFrame:
    """df with the change from the group's year before, 0 for its first."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(year))
    return df.withColumn(name, F.coalesce(F.col(value) - before, F.lit(0)))


def period_counts(df: DataFrame, date: str, period: str, by: list[str] | None = None) -> DataFrame:
    """Counts by the first day of the quarter, month or year."""
    return df.groupBy(*(by or []), F.trunc(date, period).alias(period)).agg(F.count("*").alias("size"))


def season_counts(df: DataFrame, date: str) -> DataFrame:
    """(season, size) with seasons 1 to 4: the quarters, moved on by one."""
    return df.where(F.col(date).isNotNull()).groupBy((F.quarter(date) % 4 + 1).alias("season")).agg(F.count("*").alias("size"))


def panel(df: DataFrame, rows: list[str], key: str, value: str, keys: list[str]) -> DataFrame:
    """Means of the value, a column for each of the known keys."""
    return df.groupBy(*rows).pivot(key, keys).agg(F.avg(value))


def complete_keys(df: DataFrame, key: str, unit: str, year: str, value: str, years: tuple[int, int]) -> DataFrame:
    """(key, unit): the series that have a value in every one of the years."""
    inside = df.where(F.col(year).between(*years) & F.col(value).isNotNull())
    full = inside.groupBy(key, unit).agg(F.countDistinct(year).alias("n"))
    return full.where(F.col("n") == years[1] - years[0] + 1).select(key, unit)


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns over their sum by row; null if that is 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    return df.withColumn("__all", total.cast("double")).withColumns({c: F.try_divide(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.col("__all")) for c in columns}).drop("__all")


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, over their population deviation (over 1 if that is 0)."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    spread = lambda c: F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / spread(c) for c in columns}).select(*df.columns)


def kmeans(df: DataFrame, coords: list[str], columns: list[str], k: int, inner: float = 0.5, seed: int = 1, tries: int = 5) -> DataFrame:
    """df with kmeans, a cluster from 0: coordinates in radians and shares of the columns, both scaled; inner is the coordinates' weight.

    The best of `tries` starts is taken."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    names = {c: f"__{c}" for c in [*coords, *columns]}
    wide = df.dropna(subset=coords).withColumns({names[c]: F.radians(c) for c in coords} | {names[c]: F.col(c) for c in columns})
    wide = shares(wide, [names[c] for c in columns]).fillna(0.0, [names[c] for c in columns])
    wide = scaled(wide, list(names.values()))
    wide = wide.withColumns({names[c]: F.col(names[c]) * inner for c in coords} | {names[c]: F.col(names[c]) * (1 - inner) for c in columns})
    joined = VectorAssembler(inputCols=list(names.values()), outputCol="__joined vector").transform(wide)
    joined = written(joined, "scaled")
    starts = [KMeans(k=k, seed=seed + t, initSteps=5, featuresCol="__joined vector", predictionCol="kmeans").fit(joined) for t in range(tries)]
    model = min(starts, key=lambda m: m.summary.trainingCost)
    return model.transform(joined).select(*df.columns, "kmeans")


def cluster_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kmeans, column, value): means by cluster, one a row."""
    return df.groupBy("kmeans").agg(*[F.avg(c).alias(c) for c in columns]).unpivot("kmeans", columns, "column", "value")


def ward(values: list[float], clusters: int = 2) -> list[int]:
    """Cluster numbers of a few hundred values by Ward's linkage; numbers go up with the clusters' means."""
    order = np.argsort(np.asarray(values, float), kind="stable")
    v = np.asarray(values, float)[order]
    size, total = [1.0] * len(v), list(v)
    members = [[int(i)] for i in order]
    while len(members) > clusters:
        # merging clusters that are next to each other costs least in one dimension
        cost = [size[k] * size[k + 1] / (size[k] + size[k + 1]) * (total[k] / size[k] - total[k + 1] / size[k + 1]) ** 2 for k in range(len(members) - 1)]
        k = int(np.argmin(cost))
        size[k : k + 2] = [size[k] + size[k + 1]]
        total[k : k + 2] = [total[k] + total[k + 1]]
        members[k : k + 2] = [members[k] + members[k + 1]]
    out = [0] * len(v)
    for c, group in enumerate(members):
        for i in group:
            out[i] = c
    return out


def ward_split(totals: DataFrame, key: str, value: str, clusters: int = 2, most: int = 5000) -> DataFrame:
    """(key, value, cluster) of a table with a row per region: cluster 0 has the smallest mean. Raises for more than `most` rows."""
    rows = totals.select(key, value).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    found = ward([float(r[1]) for r in rows], clusters) if rows else []
    kinds = dict(totals.dtypes)
    return totals.sparkSession.createDataFrame([(r[0], r[1], c) for r, c in zip(rows, found, strict=True)], f"{key} {kinds[key]}, {value} {kinds[value]}, cluster int")


def mean_distance(towns: DataFrame, radii: list[float | None], weight: str = "n", distance: Column | None = None) -> DataFrame:
    """(lat, lon, radius, meandist): the weighted mean distance to the towns within each radius, itself at 0 included; None is any distance.

    towns is a row for each place; places whose mean is 0 are left out, and so is a place without weight around it.
    """
    a = towns.select("lat", "lon")
    b = towns.select(F.col("lat").alias("latY"), F.col("lon").alias("lonY"), F.col(weight).alias("w"))
    km = distance if distance is not None else haversine(*[F.col(c) for c in ("lat", "lon", "latY", "lonY")])
    pairs = a.crossJoin(checked_small(b)).withColumn("d", km)
    sums = []
    for k, r in enumerate(radii):  # all radii in one pass over the pairs
        w = F.col("w") if r is None else F.when(F.col("d") <= r, F.col("w"))
        sums += [F.sum(F.col("d") * w).alias(f"s{k}"), F.sum(w).alias(f"w{k}")]
    means = pairs.groupBy("lat", "lon").agg(*sums)
    each = [F.struct(F.lit(None if r is None else float(r)).cast("double").alias("radius"), F.col(f"s{k}").alias("s"), F.col(f"w{k}").alias("w")) for k, r in enumerate(radii)]
    rows = means.select("lat", "lon", F.explode(F.array(*each)).alias("m")).where("m.s <> 0")
    return rows.select("lat", "lon", "m.radius", F.try_divide("m.s", "m.w").alias("meandist"))


def mean_distance_by(towns: DataFrame, sections: list[str], radii: list[float | None]) -> DataFrame:
    """mean_distance for each section with its own column of weights: (section, lat, lon, radius, meandist)."""
    found = [mean_distance(towns.where(F.col(s) > 0), radii, s).select(F.lit(s).alias("section"), "*") for s in sections]
    return reduce(DataFrame.unionByName, found)
