"""Queries over the sources and the register chain: the driver's tables are written in a source's form and read back, or go through the chain's steps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citation, text
from ..functions.dates import FORMATS, mixed_date
from ..functions.geo import to_transverse_mercator
from ..operators import analytics, facts, index, names, network, regions, registers, search, storage
from ..session import own_dir, spread, written
from ..sources import readers, shred, sinks
from ..streaming.incremental import grow_index, read_index
from . import tables
from .tables import BASE, TYPES, eav, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, line, name: str) -> str:
    """A folder of text files with a line for each row."""
    path = _folder(df.sparkSession, name)
    df.select(line.alias("value")).write.text(path)
    return path


# ---- sources


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def xml_source(spark, d):
    line = F.format_string("<c><id>%d</id><name>%s</name><segment>%s</segment></c>", "c_custkey", "c_name", "c_mktsegment")
    path = _folder(spark, "xml")
    whole = table(spark, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("<r>"), F.concat_ws("", F.collect_list(line)), F.lit("</r>")).alias("value"))
    whole.write.partitionBy("c_nationkey").text(path)
    rows = readers.xml_documents(spark, path, "c", spark.createDataFrame([], "id long, name string, segment string").schema)
    return rows.where("filename like '%.txt'").select("id", "name", "segment")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def xml_split_source(spark, d):
    line = F.format_string('<?xml version="1.0"?><s><id>%d</id><name>%s</name></s>', "s_suppkey", "s_name")
    parts = readers.split_xml(spark, _lines(table(spark, d, "supplier"), line, "xmls"))
    return parts.select(F.xpath_long("xml", F.lit("s/id")).alias("id"), F.xpath_string("xml", F.lit("s/name")).alias("name"))


def _by_nation(spark, d, name: str, value) -> str:
    """A folder with one file for each nation."""
    path = _folder(spark, name)
    one = F.sort_array(F.collect_list(F.struct("c_custkey", "c_name")))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(one.alias("data"))
    rows.select("c_nationkey", value.alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return path


@query("SELECT c_custkey, c_name FROM customer")
def json_list_source(spark, d):
    path = _by_nation(spark, d, "json", F.to_json(F.struct("data")))
    return readers.json_list(spark, path, "data").select("c_custkey", "c_name")


@query("SELECT c_nationkey AS nation, count(*) AS size, min(c_custkey) AS least FROM customer GROUP BY 1")
def json_source(spark, d):
    path = _by_nation(spark, d, "json", F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.struct("data").alias("all"))))
    rows = readers.json_documents(spark, path)
    return rows.select(F.col("nation").cast("int").alias("nation"), F.size("all.data").cast("long").alias("size"), F.array_min("all.data.c_custkey").alias("least"))


_MICRO = "root array<struct<properties: struct<name: array<string>, no: array<string>, maker: array<struct<properties: struct<name: array<string>>>>>>>"


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, p_name AS name, CAST(p_size AS VARCHAR) AS no, p_brand AS maker FROM part")
def html_shred(spark, d):
    """Pages with microdata, read, shredded and named."""
    page = F.format_string(
        '<div itemscope itemtype="t/P"><h1 itemprop="name">%s</h1><meta itemprop="no" content="%d"><p itemprop="maker" itemscope>by <b itemprop="name">%s</b></p></div><p>end</p>',
        "p_name", "p_size", "p_brand",
    )
    pages = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("page"), page.alias("value"))
    found = readers.microdata(pages).select("page", F.transform("root", lambda x: F.from_json(x, _MICRO.partition("<")[2][:-1])).alias("root"))
    root = shred.ingest(found, "page", shred.Options(last_scalar=True))["root"]
    return root.select("doc", "name", "no", F.col("properties_name").alias("maker"))


@query("SELECT row_number() OVER (ORDER BY 'P' || o_orderkey, o_orderstatus) - 1 AS entry, o_orderkey AS entrydoc, o_orderstatus AS query FROM orders")
def citations_source(spark, d):
    orders = table(spark, d, "orders")
    code = F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))
    path = _folder(spark, "citations")
    orders.select(code.alias("P"), F.col("o_orderstatus").alias("query")).write.option("header", True).csv(path)
    return readers.citations_csv(spark, path, orders.select(code.alias("code"), F.col("o_orderkey").alias("doc")))


def _town(k):
    """A nation's number as a town's name."""
    return F.concat(F.lit("Łąka "), F.chr(65 + k))


def _gazetteer(spark, d) -> DataFrame:
    """Nations as towns; every fifth one is in two places, and every second also the name of a village."""
    path, k = _folder(spark, "gazetteer"), F.col("n_nationkey")
    row = lambda kind, up: F.struct(F.lit(kind).alias("type"), (F.lit(50.0 + up) + k % 5).alias("lat"))
    kinds = F.array_compact(F.array(row("miasto", 0), F.when(k % 5 == 0, row("miasto", -1)), F.when(k % 2 == 0, row("wieś", 3))))
    rows = table(spark, d, "nation").select(k.alias("teryt"), _town(k).alias("city"), F.explode(kinds).alias("t"), (F.lit(15.0) + k).alias("lon"))
    blank = [F.lit("x").alias(c) for c in ("gmina", "powiat", "województwo")]
    rows.select("teryt", "t.type", "city", *blank, "t.lat", "lon").write.option("header", True).csv(path)
    return readers.gazetteer_csv(spark, path, gid="teryt")


@query("""
SELECT c_custkey AS doc, 'LAKA ' || chr(CAST(65 + n_nationkey AS INT)) AS city, CAST(50 + n_nationkey % 5 - CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS lat, CAST(15 + n_nationkey AS DOUBLE) AS lon,
  CASE WHEN n_nationkey % 5 = 0 THEN 'ambiguous' ELSE 'unique' END AS loceval
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def places_found(spark, d):
    """Towns that customers' addresses name, looked up in a gazetteer."""
    where = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    named = where.select(F.col("c_custkey").alias("doc"), F.concat(F.lower(_town(F.col("n_nationkey"))), F.lit(", 00-"), F.col("c_custkey").cast("string")).alias("value"))
    return facts.places(named, _gazetteer(spark, d))


@query("SELECT n_name AS city, CAST(50 + n_nationkey % 5 AS DOUBLE) AS lat, CAST(15 + n_nationkey % 7 AS DOUBLE) AS lon FROM nation")
def gml_source(spark, d):
    """Places of a feature service in plane coordinates, back in degrees."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 nations
    at = lambda k: "%.6f %.6f" % to_transverse_mercator(50.0 + k % 5, 15.0 + k % 7)
    places = "".join(f"<m><name>{r.n_name}</name><pos>{at(r.n_nationkey)}</pos></m>" for r in rows)
    lines = spark.createDataFrame([(f"<c>{places}</c>",)], "value string").coalesce(1)
    found = readers.gazetteer_gml(spark, _lines(lines, F.col("value"), "gml"), "m", "pos", {"city": "name"})
    return found.select("city", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _squares(spark, d, key: str, kind: str) -> DataFrame:
    """Regions out of a GeoJSON file: a square for each nation, or a multi-polygon of them for each of the world's regions."""
    lon, lat = F.lit(15.0) + 2 * F.floor(F.col("n_nationkey") / 5), F.lit(50.0) + 2 * (F.col("n_nationkey") % 5)
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(point(lon, lat), point(lon + 1, lat), point(lon + 1, lat + 1), point(lon, lat + 1), point(lon, lat))
    shapes = table(spark, d, "nation").select(F.col(key).cast("string").alias("id"), F.array(ring).alias("p")).groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    one = F.when(F.size("ps") == 1, F.struct(F.lit("Polygon").alias("type"), F.to_json(F.col("ps")[0]).alias("coordinates")))
    geometry = F.coalesce(one, F.struct(F.lit("MultiPolygon").alias("type"), F.to_json("ps").alias("coordinates")))
    feature = F.struct(F.struct("id", F.concat(F.lit("Region "), "id").alias("n"), F.lit(kind).alias("t")).alias("properties"), geometry.alias("geometry"))
    doc = shapes.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    # coordinates are JSON, not strings of it
    doc = doc.select(F.regexp_replace(F.regexp_replace("value", r'"coordinates":"(\[[^"]*\])"', r'"coordinates":$1'), r"\\", "").alias("value"))
    return readers.regions_geojson(spark, _lines(doc, F.col("value"), "regions"), "id", "n", "t")


def _spots(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (F.lit(50.25) + k % 11).cast("double").alias("lat"), (F.lit(15.5) + k % 8).cast("double").alias("lon"))


_SPOTS = """
WITH c AS (SELECT c_custkey AS id, 50.25 + c_custkey % 11 AS lat, 15.5 + c_custkey % 8 AS lon FROM customer),
n AS (SELECT CAST(n_nationkey AS VARCHAR) AS pgid, CAST(n_regionkey AS VARCHAR) AS wgid, 15 + 2 * (n_nationkey // 5) AS x, 50 + 2 * (n_nationkey % 5) AS y FROM nation)
"""


@query(_SPOTS + "SELECT c.id, wgid, pgid FROM c LEFT JOIN n ON lon > x AND lon < x + 1 AND lat > y AND lat < y + 1")
def regions_mapped(spark, d):
    """Points in two levels of regions that were read from files."""
    found = regions.mapped(_spots(spark, d), _squares(spark, d, "n_regionkey", "w"), _squares(spark, d, "n_nationkey", "p"))
    return found.select("id", "wgid", "pgid")


@query(_SPOTS + "SELECT pgid, 'Region ' || pgid AS pgid_name, count(id) AS size FROM n LEFT JOIN c ON lon > x AND lon < x + 1 AND lat > y AND lat < y + 1 GROUP BY 1")
def regions_with_empty(spark, d):
    """Points in each region, also in those without any, by the region's name."""
    squares = _squares(spark, d, "n_nationkey", "p")
    found = regions.spatial_join(_spots(spark, d).where("id is not null"), squares, "pgid", "right")
    return regions.named(found.groupBy("pgid").agg(F.count("id").alias("size")), squares, ["pgid"]).select("pgid", "pgid_name", "size")


@query(BASE + """
SELECT wgid, wgidY, x.r_name AS wgid_name, y.r_name AS wgidY_name, CAST(sum(CASE WHEN wgid = wgidY THEN 0 ELSE 1 END) AS BIGINT) AS size
FROM edges JOIN region x ON x.r_regionkey = wgid JOIN region y ON y.r_regionkey = wgidY GROUP BY 1, 2, 3, 4
""")
def region_matrix_named(spark, d):
    matrix = network.region_matrix(tables.edges(spark, d, ["wgid"]), "wgid").groupBy("wgid", "wgidY").agg(F.sum("size").alias("size"))
    return regions.named(matrix, table(spark, d, "region").select(F.col("r_regionkey").alias("gid"), F.col("r_name").alias("name")), ["wgid", "wgidY"])


@query("SELECT r_regionkey AS gid, CAST(year(o_orderdate) AS INT) AS year, 'a/b/' || o_orderpriority || '/n' AS key, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN region ON r_regionkey = o_custkey % 5 GROUP BY ALL")
def statistics_source(spark, d):
    counts = table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("r"), F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count("*").alias("value"))
    known = table(spark, d, "region").select(F.col("r_regionkey").alias("gid"), F.col("r_name").alias("name"))
    rows = counts.join(known, F.col("r") == F.col("gid"))
    path = _folder(spark, "panel")
    columns = [F.lower("name").alias("region"), F.lit("a").alias("subject"), F.lit("b").alias("section"), F.col("o_orderpriority").alias("name"), F.lit("n").alias("var"), "year", "value"]
    rows.select(*columns).write.option("header", True).csv(path)
    return readers.statistics_csv(spark, path, known)


@query("SELECT n_nationkey, n_name FROM nation")
def memoised_table(spark, d):
    """Made once, then read."""
    path, made = _folder(spark, "memo"), table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.memoised(spark, path, lambda: made)
    return sinks.memoised(spark, path, lambda: made.where("false"))


@query(r"""
SELECT r_regionkey AS k, r_regionkey || ' & ' || r_name || ' & ' || printf('%.3f', r_regionkey / 4.0) || ' \\' AS line FROM region
UNION ALL SELECT * FROM (VALUES (-4, '\begin{tabular}{rlr}'), (-3, '\toprule'), (-2, 'r\_regionkey & r\_name & share \\'), (-1, '\midrule'), (100, '\bottomrule'), (101, '\end{tabular}'))
""")
def latex_lines(spark, d):
    rows = table(spark, d, "region").select(F.col("r_regionkey"), "r_name", (F.col("r_regionkey") / 4.0).alias("share")).orderBy("r_regionkey")
    lines = sinks.latex_table(rows).splitlines()
    numbers = [*range(-4, 0), *range(len(lines) - 6), 100, 101]
    return spark.createDataFrame(list(zip(numbers, lines, strict=True)), "k long, line string")


@query("SELECT * FROM (VALUES ('customer', 'c_custkey'), ('customer', 'c_name'), ('nation', 'n_name')) t(frame, col)")
def bindings_file(spark, d):
    """A file of tables and columns for tags to be filled in, read back."""
    shown = {"customer": table(spark, d, "customer").select("c_custkey", "c_name", F.lit(1).alias("id")), "nation": table(spark, d, "nation").select("n_name")}
    with tempfile.TemporaryDirectory() as folder:  # a person's file, written and read by the driver
        sinks.write_blank_bindings(shown, os.path.join(folder, "b.yaml"))
        found = sinks.read_bindings(os.path.join(folder, "b.yaml"))
    return spark.createDataFrame([(t, c) for t, columns in found.items() for c in columns], "frame string, col string")


@query("SELECT c_custkey AS doc, c_name FROM customer")
def empty_columns_dropped(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), "c_name", F.lit(None).cast("string").alias("note"), F.lit(None).cast("double").alias("x"))
    return shred.drop_empty(rows)


@query("""
SELECT 'root' AS frame, 'name' AS col, count(*) AS size FROM customer UNION ALL SELECT 'root', 'text', count(*) FROM customer
UNION ALL SELECT 'order', c, count(*) FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES ('key'), ('price')) t(c) GROUP BY c
""")
def ingestion_node(spark, d):
    """Customers with their orders as nested documents, ingested: the bound columns of each table and its rows."""
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.lit(None).cast("string").alias("none"))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(order).alias("order"))
    docs = table(spark, d, "customer").join(lists, F.col("o_custkey") == F.col("c_custkey"), "left")
    docs = docs.select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("text")).alias("segment"), "order")
    with tempfile.TemporaryDirectory() as folder:  # a person's file, written and read by the driver
        found = sinks.ingested(docs, "doc", _folder(spark, "ingested"), os.path.join(folder, "b.yaml"))
        bound = sinks.read_bindings(os.path.join(folder, "b.yaml"))
    return reduce(DataFrame.unionByName, [found[t].agg(F.count("*").alias("size")).select(F.lit(t).alias("frame"), F.explode(F.array(*map(F.lit, bound[t]))).alias("col"), "size") for t in sorted(found)])


@query(r"""
SELECT doc, value, count(*) AS score FROM (SELECT CAST(c_custkey AS VARCHAR) AS doc, upper(unnest(regexp_extract_all(c_name || ' ' || c_mktsegment, '\w+'))) AS value FROM customer) GROUP BY 1, 2
""")
def streamed_index(spark, d):
    """An index of words that grows by micro-batches of a stream of files."""
    values = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("value"))
    blank = [F.lit("x").alias(c) for c in ("repo", "frame", "col", "id", "assignement")]
    source, path = _folder(spark, "stream"), _folder(spark, "index")
    values.select(*blank, "doc", "value").repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    grow_index(stream, index.word_index, path, _folder(spark, "progress")).awaitTermination()
    return read_index(spark, path).select("doc", "value", "score")


# ---- storage, text, indexes


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc, c_name FROM customer WHERE c_custkey % 3 = 1")
def documents_subset(spark, d):
    rows = table(spark, d, "customer").withColumns({"doc": F.col("c_custkey").cast("string"), "id": F.col("c_custkey")})
    asked = rows.where("c_custkey % 3 = 1").select("doc").unionByName(rows.where("c_custkey = 1").select("doc"))
    return storage.Storage("star", {"customer": rows}, {}).of_docs(asked)["customer"].select("doc", "c_name")


@query("SELECT p_partkey AS id, substr(p_name, 1, 4) || '.' AS head, CASE WHEN p_partkey < 1000000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS code FROM part")
def name_heads(spark, d):
    """Heads of names, and the codes of files."""
    file = F.format_string("a/b/%06d_x1.xml", "p_partkey")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.name_head(F.col("p_name")).alias("head"), text.file_code(file).alias("code"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders")
def mixed_dates(spark, d):
    """Dates in all the forms that are known, one after the other by order."""
    forms = F.array(*[F.date_format("o_orderdate", f) for f in FORMATS])
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(forms, (F.col("o_orderkey") % len(FORMATS) + 1).cast("int")).alias("value"))
    return rows.select("id", mixed_date(F.concat(F.lit(" "), "value")).alias("date"))


@query("""
SELECT o_orderkey AS entry, CASE o_orderkey % 2 WHEN 0 THEN ['EP', 'PL'] ELSE ['PL'] END[1] AS first, CAST(1 + (o_orderkey + 1) % 2 AS INT) AS codes,
  CAST(o_orderkey + 100000 AS VARCHAR) AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INT) AS year
FROM orders
""")
def citation_months(spark, d):
    """Citations with months by name, Polish or English, with commas, and with one code or two. A short name before a number would be a code itself."""
    months = lambda group: F.array(*[F.lit(m[group if len(m) > group else 0]) for m in (citation.MONTHS_PL if group else citation.MONTHS_EN)])
    k = F.month("o_orderdate")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.element_at(months(0), k)).otherwise(F.element_at(months(1), k))
    day = F.date_format("o_orderdate", "dd")
    date = F.when((F.col("o_orderkey") % 5 == 0) & (F.length(name) > 4), F.concat_ws(" ", name, day, F.date_format("o_orderdate", "yyyy"))).otherwise(F.concat_ws(" ", day, name, F.date_format("o_orderdate", "yyyy")))
    number = (F.col("o_orderkey") + 100000).cast("string")
    second = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("EP 765432 A1; "))).otherwise(F.lit(""))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), F.concat(second, F.lit("Kowalski, Jan: PL "), number, F.lit(" B1, "), date).alias("query"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    rows = spread(rows).withColumn("q", citation.parsed(F.col("query")))
    # a reading of the day and year the other way round may be later than the given one
    return rows.select(
        "entry", F.col("q.codes")[0]["country"].alias("first"), F.size("q.codes").alias("codes"), F.element_at("q.numbers", -1).alias("number"),
        F.when(F.array_contains("q.dates", F.col("iso")), F.col("iso")).alias("day"), F.when(F.array_contains("q.years", F.substring("iso", 1, 4).cast("int")), F.substring("iso", 1, 4).cast("int")).alias("year"),
    )


@query("""
WITH w AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS doc, upper(unnest(regexp_extract_all(p_name, '\\w+'))) AS value FROM part),
q AS (SELECT CAST(doc AS BIGINT) AS entry, value FROM w WHERE CAST(doc AS BIGINT) % 100 = 0)
SELECT DISTINCT q.entry, w.doc FROM q JOIN w USING (value) WHERE q.entry % 200 <> 0
""")
def owners_left(spark, d):
    """Parts that a query's words are nearly the same as, without those that have one of its words; every second query's words have another letter at the end."""
    parts = eav(spark, d, "part", "p_partkey", ["p_name"], "title")
    asked = parts.where("cast(doc as bigint) % 100 = 0").select(F.col("doc").cast("long").alias("entry"), F.explode(text.words(F.col("value"), 1, "upper")).alias("value"))
    asked = asked.withColumn("value", F.when(F.col("entry") % 200 != 0, F.concat("value", F.lit("S"))).otherwise(F.col("value"))).distinct()
    exact = index.grouped_match(index.word_index(parts), asked)
    alike = index.grouped_gram_match(index.gram_index(parts, words=True), index.query_grams(asked), min_share=0.9)
    return alike.without(exact).rows().select("entry", "doc")


@query("SELECT o_orderkey AS id, 'q' || o_custkey AS query FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def queries_unasked(spark, d):
    asked = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("q"), "c_custkey").alias("query"))
    return search.unasked(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("q"), "o_custkey").alias("query")), asked)


# ---- the register chain


def _people(spark, d) -> tuple[storage.Storage, DataFrame]:
    """Orders as documents: a clerk's first and last name as inventor, a firm as assignee, the customer as applicant; and the firms' kinds."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").withColumns({
        "doc": k, "id": k, "first": F.concat(F.lit("Jan "), F.chr(65 + k % 7)), "last": F.concat(F.lit("Łoś"), F.chr(65 + k % 5)), "firm": F.concat(F.lit("Firma "), F.chr(65 + k % 3), F.lit(" Inc.")),
        "kind": F.when(k % 4 == 0, "LEGAL"), "who": F.concat(F.lit("Ewa "), F.chr(65 + k % 2)), "town": F.concat(F.lit("Kraków "), F.chr(65 + k % 4), F.lit(" 30-001")),
    })
    bound = {"orders": {"first": ["firstnames-inventor"], "last": ["lastnames-inventor"], "firm": ["names-assignee", "names-applicant"], "who": ["names-applicant"], "kind": ["type-name"], "town": ["city"]}}
    return storage.Storage("star", {"orders": rows}, bound), rows


_TAGS = ["firstnames-inventor", "lastnames-inventor", "names-assignee", "names-applicant"]
_CHAIN = """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, 'Jan ' || chr(CAST(65 + o_orderkey % 7 AS INT)) AS first, 'Łoś' || chr(CAST(65 + o_orderkey % 5 AS INT)) AS last,
    'Firma ' || chr(CAST(65 + o_orderkey % 3 AS INT)) || ' Inc.' AS firm, 'Ewa ' || chr(CAST(65 + o_orderkey % 2 AS INT)) AS who, 'KRAKOW ' || chr(CAST(65 + o_orderkey % 4 AS INT)) AS city,
    CASE WHEN o_orderkey % 4 = 0 THEN 'LEGAL' END AS type, CAST(o_orderdate AS DATE) AS application, o_orderkey FROM orders),
pulled AS (
  SELECT doc, city, upper(first || ' ' || replace(replace(last, 'Ł', 'L'), 'oś', 'os')) AS value, FALSE AS assignee, FALSE AS applicant, TRUE AS inventor FROM o
  UNION ALL SELECT doc, city, upper(firm), TRUE, TRUE, FALSE FROM o
  UNION ALL SELECT doc, city, upper(who), FALSE, TRUE, FALSE FROM o)
"""


@query(_CHAIN + """
SELECT doc, doc AS id, first AS value, 'firstnames' AS assignement, type FROM o UNION ALL SELECT doc, doc, last, 'lastnames', type FROM o
UNION ALL SELECT doc, doc, firm, 'names', type FROM o UNION ALL SELECT doc, doc, firm, 'names', type FROM o UNION ALL SELECT doc, doc, who, 'names', type FROM o
""")
def name_entries(spark, d):
    store, _ = _people(spark, d)
    return names.entries([(store, _TAGS)], type_tag="type-name")


def _pulled(spark, d) -> DataFrame:
    store, _ = _people(spark, d)
    return registers.pulled(store.melt_all(_TAGS), store.melt("city"))


@query(_CHAIN + "SELECT doc, value, city, assignee, applicant, inventor FROM pulled")
def register_pulled(spark, d):
    return _pulled(spark, d).drop("id")


_NAMED = _CHAIN + """
, named AS (SELECT *, value LIKE 'FIRMA%' AS organisation, CASE WHEN value LIKE 'FIRMA%' THEN NULL WHEN inventor THEN '' ELSE '' END AS none FROM pulled)
"""


def _named(spark, d) -> DataFrame:
    """Persons of the orders, classified by a dictionary of clerks' and firms' names."""
    known = [("JAN", "firstname"), ("EWA", "firstname")] + [(f"FIRMA {x} INC.", "orgname") for x in "ABC"] + [(f"LOS{x}", "lastname") for x in "ABCDE"] + [(x, "ambigname") for x in "ABCDEFG"]
    return names.classified(written(_pulled(spark, d), "pulled"), spark.createDataFrame(known, "value string, role string"))


@query(_NAMED + "SELECT doc, value, organisation, CASE WHEN NOT organisation THEN split_part(value, ' ', 1) END AS firstnames, CASE WHEN NOT organisation THEN CASE WHEN inventor THEN split_part(value, ' ', 3) ELSE '' END END AS lastnames FROM named")
def register_named(spark, d):
    return _named(spark, d).select("doc", "value", "organisation", "firstnames", "lastnames")


_SECTION = "chr(CAST(65 + l_suppkey % 8 AS INT))"


@query(_NAMED + f"""
, ev AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, min(CAST(l_shipdate AS DATE)) AS granted FROM lineitem GROUP BY 1),
s AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, count(*) FILTER ({_SECTION} = 'A') AS clsf_A, count(*) FILTER ({_SECTION} = 'H') AS clsf_H, array_to_string(list_sort(list(DISTINCT {_SECTION})), '') AS IPC FROM lineitem GROUP BY 1)
SELECT doc, value, organisation, CASE WHEN o_orderkey % 4 <> 3 THEN 50.0::DOUBLE + o_orderkey % 4 END AS lat, CASE WHEN o_orderkey % 4 <> 3 THEN 'unique' END AS loceval, application, granted AS "grant",
  least(application, granted) AS firstdate, coalesce(clsf_A, 0) AS clsf_A, coalesce(clsf_H, 0) AS clsf_H, coalesce(IPC, '') AS IPC
FROM named JOIN o USING (doc) LEFT JOIN ev USING (doc) LEFT JOIN s USING (doc)
""")
def register_placed(spark, d):
    """The whole chain: persons pulled, classified, and placed by town, date and class."""
    k = F.col("l_suppkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.concat(F.chr(65 + k % 8), F.lit("61K 31/00")).alias("symbol"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    dates = orders.select("doc", F.lit("date-application").alias("assignement"), F.col("day").alias("value")).unionByName(lines.select("doc", F.lit("date-grant").alias("assignement"), F.col("day").alias("value")))
    towns = orders.where("k % 4 <> 3").select("doc", F.concat(F.lit("KRAKOW "), F.chr(65 + F.col("k") % 4)).alias("city"), (F.lit(50.0) + F.col("k") % 4).alias("lat"), F.lit(19.0).alias("lon"), F.lit("unique").alias("loceval"))
    classes = facts.classes(lines.select("doc", F.lit("1").alias("id"), F.lit("IPC").alias("assignement"), F.col("symbol").alias("value")))
    out = registers.placed(_named(spark, d), towns, facts.events(dates), classes)
    return out.select("doc", "value", "organisation", "lat", "loceval", "application", "grant", "firstdate", "clsf_A", "clsf_H", F.coalesce(F.array_join("IPC", ""), F.lit("")).alias("IPC"))


@query(BASE + f"""SELECT doc, supp, pgid, wgid, lat, lon, application, granted AS "grant", {', '.join('clsf_' + t for t in TYPES)} FROM regs""")
def register_star(spark, d):
    """The star schema's registers, which the network queries read."""
    return tables.registers(spark, d).drop("year")


@query("SELECT p_partkey AS doc, 'IPCR' AS classification, p_brand[-1] AS section, lpad(CAST(p_size AS VARCHAR), 2, '0') AS class FROM part UNION ALL SELECT p_partkey, 'CPC', substr(p_type, 1, 1), CAST(p_size AS VARCHAR) FROM part")
def class_fields(spark, d):
    """Classifications given as symbols and as single fields."""
    part = table(spark, d, "part").withColumn("doc", F.col("p_partkey"))
    symbols = part.select("doc", F.lit("1").alias("id"), F.lit("CPC").alias("assignement"), F.concat(F.substring("p_type", 1, 1), "p_size", F.lit("K 31/00")).alias("value"))
    one = lambda tag, c: part.select("doc", F.lit("1").alias("id"), F.lit(tag).alias("assignement"), c.alias("value"))
    return facts.classes(symbols, one("IPCR-section", F.right("p_brand", F.lit(1))).unionByName(one("IPCR-class", F.lpad(F.col("p_size").cast("string"), 2, "0"))))


@query("SELECT c_custkey AS doc, n_name AS country, CAST(c_custkey + 100000 AS VARCHAR) AS number FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0")
def codes_of_countries(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation").where("n_nationkey % 3 <> 0")
    raw = customer.select(F.col("c_custkey").alias("doc"), F.concat(F.lit("P. "), (F.col("c_custkey") + 100000).cast("string")).alias("value"))
    countries = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("doc"), F.col("n_name").alias("value"))
    return facts.codes(raw, countries=countries)


# ---- distances, flows, profiles

#: the ellipsoid's distances of the grid of places by iterating the inverse formula, as SQL
_ELLIPSOID = """
, ax AS (SELECT 6378.137 AS a, 1 / 298.257223563 AS f),
grid AS (SELECT DISTINCT lat, lon FROM places),
pair AS (SELECT x.lat, x.lon, y.lat AS latY, y.lon AS lonY, radians(y.lon - x.lon) AS l, atan((1 - f) * tan(radians(x.lat))) AS u, atan((1 - f) * tan(radians(y.lat))) AS v, a, f FROM grid x, grid y, ax),
it AS (SELECT *, l AS lam, 0 AS n, 0.0::DOUBLE AS ss, 1.0::DOUBLE AS cs, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS ca, 0.0::DOUBLE AS cm FROM pair
  UNION ALL
  SELECT lat, lon, latY, lonY, l, u, v, a, f, l + (1 - c) * f * sa * (sig + c * ss * (cm + c * cs * (-1 + 2 * cm * cm))), n + 1, ss, cs, sig, ca, cm FROM (
    SELECT *, f / 16 * ca * (4 + f * (4 - 3 * ca)) AS c FROM (
      SELECT *, CASE WHEN ca = 0 THEN 0 ELSE cs - 2 * sin(u) * sin(v) / ca END AS cm FROM (
        SELECT *, 1 - sa * sa AS ca, atan2(ss, cs) AS sig FROM (
          SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u) * cos(v) * sin(lam) / ss END AS sa FROM (
            SELECT lat, lon, latY, lonY, l, u, v, a, f, lam, n, sqrt(pow(cos(v) * sin(lam), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(lam), 2)) AS ss,
              sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) AS cs FROM it WHERE n < 12))))) ),
town AS (SELECT lat, lon, latY, lonY, CASE WHEN ss = 0 THEN 0 ELSE a * (1 - f) * (1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))) * (sig - b * ss * (cm + b / 4 * (cs * (-1 + 2 * cm * cm) - b / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))) END AS km
  FROM (SELECT *, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS b FROM (SELECT *, ca * (1 / pow(1 - f, 2) - 1) AS k FROM it WHERE n = 12)))
"""


@query(BASE.replace("WITH ", "WITH RECURSIVE ", 1) + _ELLIPSOID + "SELECT lat, lon, latY, lonY, round(km, 5) AS distance FROM town")
def town_pairs(spark, d):
    """All pairs of towns with the ellipsoid's distance."""
    return facts.distances(tables.places(spark, d), None).withColumn("distance", F.round("distance", 5))


@query(BASE.replace("WITH ", "WITH RECURSIVE ", 1) + _ELLIPSOID + "SELECT CAST(yearY AS INT) AS yearY, count(*) AS size, round(sum(km), 1) AS km FROM edges JOIN town USING (lat, lon, latY, lonY) GROUP BY 1")
def network_of_towns(spark, d):
    """The network with distances that are looked up in a table of pairs of towns."""
    alike = written(network.weighed(tables.registers(spark, d).drop("supp")), "persons")
    towns = written(facts.distances(tables.places(spark, d), None), "towns")
    edges = network.network(tables.citations(spark, d), alike, towns, TYPES, tables.FROM_YEAR)
    return edges.groupBy("yearY").agg(network.edge_count(edges).alias("size"), F.round(F.sum(F.col("distance") * F.col("n") * F.col("nY")), 1).alias("km"))


@query(BASE + """
, i AS (SELECT latY AS lat, lonY AS lon, count(*) AS n FROM edges GROUP BY 1, 2), o AS (SELECT lat, lon, count(*) AS n FROM edges GROUP BY 1, 2),
u AS (SELECT lat, lon, coalesce(i.n, 0) AS a, coalesce(o.n, 0) AS b FROM i FULL JOIN o USING (lat, lon))
SELECT row_number() OVER (ORDER BY abs(a - b) / CAST(a + b AS DOUBLE) DESC, lat, lon) AS rank, lat, lon FROM u WHERE a + b >= 100
""")
def flow_top(spark, d):
    """The busiest places, the most one-sided first."""
    top = network.top_flows(network.flow(tables.edges(spark, d, ["lat", "lon"])), 100)
    from ..operators.relational import row_ids

    ranked = row_ids(top, [F.col("frac").desc(), F.col("lat"), F.col("lon")], "rank")
    return ranked.select((F.col("rank") + 1).alias("rank"), "lat", "lon")


@query(BASE + f"""
, t AS (SELECT lat, lon, {', '.join(f'CAST(sum(clsf_{t}) AS BIGINT) AS {t}' for t in TYPES[:2])} FROM regs GROUP BY 1, 2),
x AS (SELECT a.lat, a.lon, unnest([{{'s': '{TYPES[0]}', 'o': a.{TYPES[0]}, 'w': b.{TYPES[0]}}}, {{'s': '{TYPES[1]}', 'o': a.{TYPES[1]}, 'w': b.{TYPES[1]}}}]) AS w, {tables.km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM t a CROSS JOIN t b)
SELECT 'clsf_' || w.s AS section, lat, lon, CAST(NULL AS DOUBLE) AS radius, round(sum(d * w.w) / sum(w.w), 6) AS meandist FROM x WHERE w.o > 0 AND w.w > 0 GROUP BY 1, 2, 3 HAVING sum(d * w.w) <> 0
""")
def mean_distance_section(spark, d):
    names_ = [f"clsf_{t}" for t in TYPES[:2]]
    towns = tables.registers(spark, d).groupBy("lat", "lon").agg(*[F.sum(c).alias(c) for c in names_])
    return analytics.mean_distance_by(towns, names_, [None]).withColumn("meandist", F.round("meandist", 6))


@query("""
SELECT CAST(p_size % 3 AS INT) AS kmeans, unnest(['p_retailprice', 'p_size']) AS "column", round(unnest([avg(p_retailprice), avg(p_size)]), 6) AS value FROM part GROUP BY 1
""")
def cluster_profile(spark, d):
    """Means by clusters that are known."""
    rows = table(spark, d, "part").select((F.col("p_size") % 3).cast("int").alias("kmeans"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return analytics.cluster_means(rows, ["p_retailprice", "p_size"]).withColumn("value", F.round("value", 6))


@query("""
SELECT c_custkey % 3 AS cluster, count(*) AS size, round(avg(CAST(50 + 8 * (c_custkey % 3) + c_custkey % 7 / 50.0 AS DOUBLE)), 6) AS lat, round(avg(CASE WHEN c_custkey % 3 = 1 THEN 5 ELSE 1 END), 6) AS x FROM customer GROUP BY 1
""")
def kmeans_clusters(spark, d):
    """Places in three parts of the map, found again; clusters are numbered from the south."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select((50 + 8 * (k % 3) + k % 7 / 50.0).cast("double").alias("lat"), (15 + 6 * (k % 3) + k % 5 / 50.0).cast("double").alias("lon"), F.when(k % 3 == 1, 5).otherwise(1).alias("x"), F.lit(2).alias("y"))
    found = analytics.kmeans(rows, ["lat", "lon"], ["x", "y"], 3, inner=0.8)
    means = found.groupBy("kmeans").agg(F.count("*").alias("size"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("x"), 6).alias("x"))
    return means.withColumn("cluster", F.row_number().over(Window.orderBy("lat")).cast("long") - 1).drop("kmeans")


@query("""
WITH b AS (SELECT (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w FROM lineitem), p AS (SELECT w, pow(10, floor(log10(w))) AS p FROM b),
s AS (SELECT CASE WHEN p >= w * (1 - 1e-12) THEN p WHEN 2 * p >= w * (1 - 1e-12) THEN 2 * p WHEN 5 * p >= w * (1 - 1e-12) THEN 5 * p ELSE 10 * p END AS step FROM p)
SELECT floor(l_extendedprice / step) * step AS bin, count(*) AS size FROM lineitem, s GROUP BY 1
""")
def price_auto_histogram(spark, d):
    out = analytics.auto_histogram(table(spark, d, "lineitem"), "l_extendedprice")
    return out.withColumn("bin", F.col("bin").cast("double"))


@query(BASE.replace("WITH ", "WITH RECURSIVE ", 1) + """
, v AS (SELECT pgid, count(*) AS size FROM edges GROUP BY 1),
m AS (SELECT list({'n': 1.0::DOUBLE, 't': CAST(size AS DOUBLE)} ORDER BY size, pgid) AS c FROM v
  UNION ALL
  SELECT list_concat(list_concat(c[1:k - 1], [{'n': c[k].n + c[k + 1].n, 't': c[k].t + c[k + 1].t}]), c[k + 2:]) FROM (
    SELECT c, list_position(cost, list_min(cost)) AS k FROM (
      SELECT c, list_transform(range(1, len(c)), lambda i: c[i].n * c[i + 1].n / (c[i].n + c[i + 1].n) * pow(c[i].t / c[i].n - c[i + 1].t / c[i + 1].n, 2)) AS cost FROM m WHERE len(c) > 2))),
f AS (SELECT c[1].n AS first FROM m WHERE len(c) = 2)
SELECT pgid, size, CAST(CASE WHEN row_number() OVER (ORDER BY size, pgid) <= first THEN 0 ELSE 1 END AS INT) AS cluster FROM v, f
""")
def ward_split(spark, d):
    e = tables.edges(spark, d, ["pgid"])
    totals = e.groupBy("pgid").agg(network.edge_count(e).alias("size"))
    return analytics.ward_split(totals, "pgid", "size")


def _tagged(spark, d) -> dict[str, DataFrame]:
    """Parts as documents with a number, a date, a name, a title and a city."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").withColumns({
        "doc": k, "id": k, "number": F.concat(F.lit("P."), (k + 100000).cast("string")), "day": F.date_add(F.lit("2000-01-01").cast("date"), (k % 1000).cast("int")), "city": F.concat(F.lit("Town"), F.chr(65 + k % 5)),
    })
    bound = {"part": {"number": ["number"], "day": ["date"], "p_brand": ["name"], "p_name": ["title"], "city": ["city"]}}
    store = storage.Storage("star", {"part": rows.withColumn("p_brand", F.regexp_replace("p_brand", "#", ""))}, bound)
    return {t: store.melt(t) for t in ("number", "date", "name", "title", "city")}


@query("""
SELECT CAST(p_partkey AS BIGINT) AS entry, CAST(p_partkey AS VARCHAR) AS doc, 1.0::DOUBLE AS number, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS date,
  2.0::DOUBLE AS title, 1.0::DOUBLE AS name, 1.0::DOUBLE AS city, CASE WHEN p_partkey % 2 = 0 THEN 'exact-dated-supported' ELSE 'exact-supported' END AS level
FROM part WHERE p_partkey % 100 = 0
""")
def search_supported(spark, d):
    """Citations with names, titles and cities, a date in every second one, found among all parts."""
    k = F.col("p_partkey")
    day = F.when(k % 2 == 0, F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 1000).cast("int")), "', 'yyyy-MM-dd")).otherwise(F.lit(""))
    words = F.concat_ws(" ", F.regexp_replace("p_brand", "#", ""), "p_name", F.concat(F.lit("Town"), F.chr(65 + k % 5)))
    asked = table(spark, d, "part").where("p_partkey % 100 = 0").select(k.cast("long").alias("entry"), k.alias("entrydoc"), F.concat(F.lit("PL "), (k + 100000).cast("string"), F.lit(" B1"), day, F.lit(" :: "), words).alias("query"))
    tokens, _ = search.query_tables(asked)
    found = search.narrow(tokens, index.indexes(_tagged(spark, d), word_grams=True))
    return found.where("partial_title > 0").select("entry", "doc", "number", "date", "title", "name", "city", "level")
