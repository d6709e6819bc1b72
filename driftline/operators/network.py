"""The network of citations between persons, and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .registers import SECTIONS
from .relational import suffixed

FROM_YEAR = 2011
# fixed values: bounds of the distance classes in kilometres, and the class of all else
BOUNDS = [0, 100, 200, 300, 500, 1000]
ELSE = "{ 0 }"


def nodes(registers: DataFrame) -> DataFrame:
    return registers.withColumn("year", F.year("application"))


def network(
    citations: DataFrame, persons: DataFrame, towns: DataFrame | None = None, sections: list[str] = SECTIONS, from_year: int | None = FROM_YEAR
) -> DataFrame:
    """An edge for each person of a cited document and each of the citing one, whose columns end in Y.

    Columns besides, where persons have what they are made of: distance in kilometres, of `towns` (lat, lon, latY, lonY, distance) or on the
    sphere; tgrant and tapplication, days between; Jaccard of the sections. Only edges to later applications, and from from_year on, are there:
    persons of documents before it are dropped before they are joined as citing ones.
    """
    columns = [c for c in persons.columns if c != "year"]  # that of the application, and so taken from it
    people = persons.select(*columns)
    citing = people if from_year is None else people.where(F.year("application") >= from_year)
    citing = suffixed(citing, "Y").withColumnRenamed("docY", "to")
    edges = citations.join(citing, "to").join(people.withColumnRenamed("doc", "from"), "from")
    edges = edges.withColumn("tapplication", F.datediff("applicationY", "application")).where("tapplication > 0")
    edges = edges.withColumns({"doc": F.col("from"), "docY": F.col("to"), "year": F.year("application"), "yearY": F.year("applicationY")})
    if "grant" in persons.columns:
        edges = edges.withColumn("tgrant", F.datediff("grantY", "grant"))
    if "lat" in persons.columns:
        if towns is None:
            edges = edges.withColumn("distance", haversine(*[F.col(c) for c in ("lat", "lon", "latY", "lonY")]))
        else:
            edges = edges.join(towns, ["lat", "lon", "latY", "lonY"], "left")
    if all(f"clsf_{s}" in persons.columns for s in sections):
        edges = edges.withColumn("Jaccard", jaccard(sections))
    return edges


def jaccard(sections: list[str] = SECTIONS) -> Column:
    """Sections of both over sections of either; null if there are none."""
    has = lambda s, y: F.coalesce(F.col(f"clsf_{s}{y}"), F.lit(0)) > 0
    both = sum(((has(s, "") & has(s, "Y")).cast("int") for s in sections), F.lit(0))
    either = sum(((has(s, "") | has(s, "Y")).cast("int") for s in sections), F.lit(0))
    return F.try_divide(both.cast("double"), either)


def distance_class(c: Column, bounds: list[int] = BOUNDS) -> Column:
    """'(a, b]' of the bounds; 0, null and what is beyond the last are ELSE."""
    out = F.lit(ELSE)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out = F.when((c > a) & (c <= b), f"({a}, {b}]").otherwise(out)
    return out


def weighed(persons: DataFrame) -> DataFrame:
    """persons that are alike in all columns as one row with their number n: edges between them stand for n times nY."""
    return persons.groupBy(*persons.columns).agg(F.count("*").alias("n"))


def edge_count(edges: DataFrame) -> Column:
    """The number of edges, by weight where rows stand for several."""
    return F.sum(F.col("n") * F.col("nY")) if "nY" in edges.columns else F.count("*")


def edge_mean(edges: DataFrame, column: str) -> Column:
    """The mean of a column over the edges that have it, by weight where rows stand for several."""
    if "nY" not in edges.columns:
        return F.avg(column)
    w = F.when(F.col(column).isNotNull(), F.col("n") * F.col("nY"))
    return F.try_divide(F.sum(F.col(column) * w), F.sum(w))


def delay_counts(edges: DataFrame, step: int = 365) -> DataFrame:
    """(yearY, distbin, delay, size): edges by years of delay, in days, and class of distance."""
    delay = (F.floor(F.col("tapplication") / step) * step).cast("long")
    return edges.groupBy("yearY", distance_class(F.col("distance")).alias("distbin"), delay.alias("delay")).agg(edge_count(edges).alias("size"))


def flow(edges: DataFrame) -> DataFrame:
    """(lat, lon, incoming, outgoing, net, size, kind, frac): citations that arrive at a place less those that leave it.

    kind is 'dopływ' (inflow) for a net of 0 or more, else 'odpływ' (outflow); frac is |net| over all.
    """
    pairs = edges.groupBy("lat", "lon", "latY", "lonY").agg(edge_count(edges).alias("n"))  # few pairs of places, each read for both of its ends
    end = lambda lat, lon, side: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.lit(side).alias("side"))
    ends = pairs.select("n", F.explode(F.array(end("latY", "lonY", "in"), end("lat", "lon", "out"))).alias("e")).where("e.lat is not null and e.lon is not null")
    one = lambda side: F.coalesce(F.sum(F.when(F.col("e.side") == side, F.col("n"))), F.lit(0))
    joined = ends.groupBy("e.lat", "e.lon").agg(one("in").alias("incoming"), one("out").alias("outgoing"))
    joined = joined.withColumn("net", F.col("incoming") - F.col("outgoing"))
    return joined.select(
        "lat",
        "lon",
        "incoming",
        "outgoing",
        "net",
        F.abs("net").alias("size"),
        F.when(F.col("net") < 0, "odpływ").otherwise("dopływ").alias("kind"),
        F.try_divide(F.abs("net").cast("double"), F.col("incoming") + F.col("outgoing")).alias("frac"),
    )


def top_flows(flows: DataFrame, least: int = 5000) -> DataFrame:
    """The places of `flow` with `least` citations or more to and from them, the largest share |net| of all first, then by place."""
    kept = flows.where(F.col("incoming") + F.col("outgoing") >= least)
    return kept.orderBy(F.col("frac").desc(), "lat", "lon")


def mean_distances(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latY, lonY, distance) and (lat, lon, distance): means of what arrives and of what leaves; unknown places are left out."""
    known = lambda *c: " and ".join(f"{x} is not null" for x in c)
    into = edges.where(known("latY", "lonY")).groupBy("latY", "lonY").agg(edge_mean(edges, "distance").alias("distance"))
    return into, edges.where(known("lat", "lon")).groupBy("lat", "lon").agg(edge_mean(edges, "distance").alias("distance"))


def cite_kinds(edges: DataFrame, persons: DataFrame, region: str, from_year: int = FROM_YEAR) -> DataFrame:
    """Persons (doc, region, year, generator, synthesis): whether their document is cited, and cites, within and beyond a region.

    An edge is internal if both sides are in one region that is known. Flags are those of the document. Persons that are weighed keep their n.
    """
    inside = F.coalesce(F.col(region) == F.col(region + "Y"), F.lit(False))
    side = lambda c, k: F.struct(F.col(c).alias("doc"), F.lit(k).alias("side"))
    pairs = edges.groupBy("from", "to").agg(F.max(inside).alias("in"), F.max(~inside).alias("out"))
    ends = pairs.select("in", "out", F.explode(F.array(side("from", "g"), side("to", "s"))).alias("e"))
    flags = ends.groupBy("e.doc").agg(*[F.coalesce(F.max(F.when(F.col("e.side") == p, F.col(n))), F.lit(False)).alias(f"{p}_{n}") for p in "gs" for n in ("in", "out")])
    number = [c for c in ("n",) if c in persons.columns]
    out = persons.where(F.col("year") >= from_year).select("doc", region, "year", *number).join(flags, "doc", "left")
    out = out.fillna(False, [f"{p}_{n}" for p in "gs" for n in ("in", "out")])

    def label(p: str, none: str, verb: str) -> Column:
        a, b = F.col(f"{p}_in"), F.col(f"{p}_out")
        return F.when(a & b, f"{verb} w.&z.").when(a, f"{verb} wewn.").when(b, f"{verb} zewn.").otherwise(none)

    return out.select("doc", region, "year", *number, label("g", "nie cytowane", "cytowane").alias("generator"), label("s", "nie cytujące", "cytujące").alias("synthesis"))


def cite_kind_counts(kinds: DataFrame, region: str) -> DataFrame:
    return kinds.where(F.col(region).isNotNull()).groupBy(region, "year", "generator", "synthesis").agg((F.sum("n") if "n" in kinds.columns else F.count("*")).alias("size"))


def cite_correlations(counts: DataFrame, region: str) -> DataFrame:
    """(cited_citing, cited_all, citing_all): Pearson correlations over (region, year) of persons cited, citing, and all."""
    by = counts.groupBy(region, "year").agg(
        F.sum("size").alias("v"),
        F.sum(F.when(F.col("generator") != "nie cytowane", F.col("size")).otherwise(0)).alias("x"),
        F.sum(F.when(F.col("synthesis") != "nie cytujące", F.col("size")).otherwise(0)).alias("y"),
    )
    return by.agg(F.corr("x", "y").alias("cited_citing"), F.corr("x", "v").alias("cited_all"), F.corr("y", "v").alias("citing_all"))


def region_matrix(edges: DataFrame, region: str) -> DataFrame:
    """(region, regionY, yearY, size, distance): citations and, if the edges have it, mean distance; the count within a region is set to 0."""
    other = region + "Y"
    by = edges.where(F.col(region).isNotNull() & F.col(other).isNotNull()).groupBy(region, other, "yearY")
    out = by.agg(edge_count(edges).alias("size"), *[edge_mean(edges, c).alias(c) for c in ("distance",) if c in edges.columns])
    return out.withColumn("size", F.when(F.col(region) == F.col(other), F.lit(0)).otherwise(F.col("size")).cast("long"))


def region_order(matrix: DataFrame, region: str) -> DataFrame:
    """(region, total): the matrix's rows from the largest sum down; of equals by name."""
    return matrix.groupBy(region).agg(F.sum("size").alias("total")).orderBy(F.col("total").desc(), region)


def choropleth_cited(edges: DataFrame, region: str, years: tuple[int, int] = (2011, 2020)) -> DataFrame:
    """(year, region, size) of the cited side, from the first year to before the last."""
    kept = edges.where((F.col("year") >= years[0]) & (F.col("year") < years[1]) & F.col(region).isNotNull())
    return kept.groupBy("year", region).agg(edge_count(edges).alias("size"))


def choropleth_citing(edges: DataFrame, region: str, years: tuple[int, int] = (2011, 2020)) -> DataFrame:
    """(yearY, regionY, size) of the citing side, after the first year up to the last."""
    kept = edges.where((F.col("yearY") > years[0]) & (F.col("yearY") <= years[1]) & F.col(region + "Y").isNotNull())
    return kept.groupBy("yearY", region + "Y").agg(edge_count(edges).alias("size"))
