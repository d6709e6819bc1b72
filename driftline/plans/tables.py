"""The domain's tables out of a star schema: orders are documents, their suppliers persons, part types classes, nations places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.network import network, nodes, weighed
from ..operators.registers import section_counts
from ..session import written

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FROM_YEAR = 1996


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, application, grant)."""
    lines = table(spark, sf_dir, "lineitem")
    grants = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.min(F.to_date("l_shipdate")).alias("grant"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("application"))
    return orders.join(grants, "doc", "left")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, section): the type of each part that was ordered."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("section"))
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("doc"), "section")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pgid, wgid, lat, lon): a grid of points, one for each nation."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("pgid"),
        F.col("n_regionkey").alias("wgid"),
        (F.lit(50.0) + F.col("n_nationkey") % 5).alias("lat"),
        (F.lit(15.0) + 1.5 * F.floor(F.col("n_nationkey") / 5)).alias("lon"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, supp, pgid, wgid, lat, lon): the distinct suppliers of each order."""
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("pgid"))
    # dealt out by doc once, which is how they are made distinct, joined with what is known of documents, and counted
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("supp")).repartition("doc").distinct()
    return lines.join(who, "supp").join(F.broadcast(places(spark, sf_dir)), "pgid").select("doc", "supp", "pgid", "wgid", "lat", "lon")


def registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """persons with application, grant, year and the counts of their document's classes."""
    counts = section_counts(classes(spark, sf_dir), TYPES)
    return nodes(persons(spark, sf_dir).join(documents(spark, sf_dir), "doc").join(counts, "doc"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to): the order of a part and the next one of the same part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("to")).repartition("to").distinct()
    dated = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("to"), "o_orderdate"), "to")
    before = F.lag("to").over(Window.partitionBy("l_partkey").orderBy("o_orderdate", "to"))
    return dated.select(before.alias("from"), "to").where("`from` is not null").repartition("to").distinct()


def alike(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """registers as one row, with their number, for those of a document that are of one nation, or that agree in `columns`, which are then
    the only ones besides the document and its application. They are written, as the network reads them for the cited and for the citing side."""
    people = registers(spark, sf_dir).drop("supp")
    if columns is not None:
        people = people.select("doc", "application", "year", *columns)
    return written(weighed(people), "persons")


def edges(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Edges between persons that are `alike`."""
    return network(citations(spark, sf_dir), alike(spark, sf_dir, columns), sections=TYPES, from_year=FROM_YEAR)


def eav(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str], tag: str) -> DataFrame:
    """A table's columns as tagged values."""
    from ..operators.storage import Storage

    rows = table(spark, sf_dir, name).withColumns({"doc": F.col(key), "id": F.col(key)})
    return Storage("star", {name: rows}, {name: {c: [tag] for c in columns}}).melt(tag)


_COUNTS = ", ".join(f"count(*) FILTER (p_type = '{t}') AS clsf_{t}" for t in TYPES)
_BOTH = " + ".join(f"CAST(a.clsf_{t} > 0 AND b.clsf_{t} > 0 AS INT)" for t in TYPES)
_EITHER = " + ".join(f"CAST(a.clsf_{t} > 0 OR b.clsf_{t} > 0 AS INT)" for t in TYPES)


def km(a: str, b: str, c: str, d: str) -> str:
    """SQL for the sphere's distance."""
    half = lambda p, q: f"pow(sin(radians({q} - {p}) / 2), 2)"
    return f"(2 * 6371.0088 * asin(sqrt(least({half(a, c)} + cos(radians({a})) * cos(radians({c})) * {half(b, d)}, 1.0))))"


#: the same tables as SQL; a query goes on after it
BASE = f"""
WITH grants AS (SELECT l_orderkey AS doc, min(CAST(l_shipdate AS DATE)) AS granted FROM lineitem GROUP BY 1),
docs AS (SELECT o_orderkey AS doc, CAST(o_orderdate AS DATE) AS application, granted FROM orders LEFT JOIN grants ON doc = o_orderkey),
sects AS (SELECT l_orderkey AS doc, {_COUNTS} FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
places AS (SELECT n_nationkey AS pgid, n_regionkey AS wgid, CAST(50.0 + n_nationkey % 5 AS DOUBLE) AS lat, CAST(15.0 + 1.5 * (n_nationkey // 5) AS DOUBLE) AS lon FROM nation),
persons AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS supp, pgid, wgid, lat, lon
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN places ON pgid = s_nationkey),
regs AS (SELECT p.*, application, granted, year(application) AS year, s.* EXCLUDE (doc) FROM persons p JOIN docs USING (doc) JOIN sects s USING (doc)),
lagged AS (SELECT lag(o_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey) AS "from", o_orderkey AS "to"
  FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey),
cites AS (SELECT DISTINCT "from", "to" FROM lagged WHERE "from" IS NOT NULL),
pairs AS (SELECT "from", "to", x.application, y.application AS applicationY, year(x.application) AS year, year(y.application) AS yearY,
    y.application - x.application AS tapplication, y.granted - x.granted AS tgrant, ({_BOTH}) / nullif(CAST({_EITHER} AS DOUBLE), 0) AS Jaccard
  FROM cites JOIN docs x ON x.doc = "from" JOIN docs y ON y.doc = "to" JOIN sects a ON a.doc = "from" JOIN sects b ON b.doc = "to"
  WHERE y.application > x.application AND year(y.application) >= {FROM_YEAR}),
edges AS (SELECT q.*, x.pgid, x.wgid, x.lat, x.lon, y.pgid AS pgidY, y.wgid AS wgidY, y.lat AS latY, y.lon AS lonY, {km('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS distance
  FROM pairs q JOIN persons x ON x.doc = "from" JOIN persons y ON y.doc = "to")
"""
