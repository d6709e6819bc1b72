"""Readers of raw files. Schemas are inferred once and can be passed in afterwards."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..functions.geo import from_transverse_mercator, ring_edges
from ..operators.relational import row_ids
from ..session import checked_small


def json_list(spark: SparkSession, path: str, field: str = "data", schema: StructType | None = None) -> DataFrame:
    """Rows of the list in `field` of each JSON file, one file being one object."""
    files = spark.read.json(path, multiLine=True, schema=schema)
    return files.select(F.explode(field).alias("item")).select("item.*")


def json_documents(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A row for each JSON file."""
    return spark.read.json(path, multiLine=True, schema=schema)


def xml_documents(spark: SparkSession, path: str, row_tag: str, schema: StructType | None = None) -> DataFrame:
    """A row for each element row_tag, with the file's name in `filename`."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path).withColumn("filename", F.col("_metadata.file_path"))


def split_xml(spark: SparkSession, path: str) -> DataFrame:
    """(filename, part, xml): the documents of files that have several, one after the other, each with its declaration.

    A row is read for each document, not for each file; part grows within a file.
    """
    rows = spark.read.option("lineSep", "<?xml").text(path).select(F.col("_metadata.file_name").alias("filename"), "value")
    rows = rows.where(F.trim("value") != "").withColumn("part", F.monotonically_increasing_id())
    return rows.select("filename", "part", F.concat(F.lit("<?xml"), "value").alias("xml"))


class _Microdata(HTMLParser):
    """Items of a page: {"type", "properties"}; a property that is itself an item is nested."""

    VOID = {"meta", "link", "img", "br", "hr", "input", "source", "area", "base", "col", "embed", "param", "track", "wbr"}
    LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "embed": "src", "iframe": "src", "source": "src", "video": "src"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.open, self.scopes = [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        entry = {"tag": tag, "item": None, "props": (a.get("itemprop") or "").split(), "text": None, "owner": self.scopes[-1] if self.scopes else None}
        if "itemscope" in a:
            entry["item"] = {"type": a.get("itemtype") or "", "properties": {}}
            if entry["owner"] is not None and entry["props"]:
                self._put(entry, entry["item"])
            else:
                self.items.append(entry["item"])
        elif entry["props"]:
            value = a.get("content") if tag == "meta" else a.get("datetime") if tag == "time" and "datetime" in a else a.get(self.LINKS.get(tag, ""))
            if value is not None:
                self._put(entry, value)
            else:
                entry["text"] = []
        if tag in self.VOID:
            return
        self.open.append(entry)
        if entry["item"] is not None:
            self.scopes.append(entry["item"])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        for e in self.open:
            if e["text"] is not None:
                e["text"].append(data)

    def handle_endtag(self, tag):
        if not any(e["tag"] == tag for e in self.open):
            return
        while self.open:
            entry = self.open.pop()
            if entry["item"] is not None:
                self.scopes.pop()
            elif entry["text"] is not None:
                self._put(entry, " ".join("".join(entry["text"]).split()))
            if entry["tag"] == tag:
                return

    @staticmethod
    def _put(entry, value):
        if entry["owner"] is not None:
            for name in entry["props"]:
                entry["owner"]["properties"].setdefault(name, []).append(value)

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag(self.open[-1]["tag"])


def microdata_items(html: str | None) -> list[dict]:
    parser = _Microdata()
    parser.feed(html or "")
    parser.close()
    return parser.items


def microdata(pages: DataFrame, html: str = "value") -> DataFrame:
    """pages with `root`: an array of the JSON of each page's items. Read it with from_json and a schema of your own."""

    @F.pandas_udf("array<string>")
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: [json.dumps(i, ensure_ascii=False) for i in microdata_items(x)])

    return pages.withColumn("root", items(html))


def html_text(c: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; runs of blanks are one space."""
    bare = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def citations_csv(spark: SparkSession, path: str, documents: DataFrame, code: str = "P", query: str = "query") -> DataFrame:
    """(entry, entrydoc, query) of a CSV of citation texts; raises if a row's code is not that of a document (code, doc).

    Entries are numbered in order of code and text.
    """
    rows = spark.read.csv(path, header=True).select(F.col(code).alias("code"), F.col(query).alias("query"))
    known = documents.select(F.col("code").alias("known"), F.col("doc").alias("entrydoc")).dropDuplicates(["known"])
    joined = rows.join(known, rows["code"] == known["known"], "left")
    checked = F.when(F.col("entrydoc").isNull(), F.raise_error(F.concat(F.lit("no document has code "), F.coalesce("code", F.lit("null"))))).otherwise(F.col("entrydoc"))
    numbered = row_ids(joined, [F.col("code"), F.col("query")], "entry")
    return numbered.select("entry", checked.alias("entrydoc"), "query")


def gazetteer_csv(spark: SparkSession, path: str, **names: str) -> DataFrame:
    """(gid, type, city, gmina, powiat, województwo, lat, lon) of a table of places; names gives the file's column for each."""
    columns = ["gid", "type", "city", "gmina", "powiat", "województwo", "lat", "lon"]
    rows = spark.read.csv(path, header=True)
    return rows.select(*[F.col(f"`{names.get(c, c)}`").cast("double" if c in ("lat", "lon") else "string").alias(c) for c in columns])


def gazetteer_gml(spark: SparkSession, path: str, row_tag: str, position: str, fields: dict[str, str]) -> DataFrame:
    """Places of a feature service's GML: fields maps names to element columns; `position` is "northing easting" in EPSG:2180 metres."""
    rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    at = F.split(F.trim(F.col(position).cast("string")), r"\s+")
    rows = rows.withColumn("__at", from_transverse_mercator(at[0].cast("double"), at[1].cast("double")))
    return rows.select(*[F.col(source).alias(name) for name, source in fields.items()], "__at.lat", "__at.lon")


def regions_geojson(spark: SparkSession, path: str, gid: str, name: str, kind: str) -> DataFrame:
    """(gid, name, type, edges) of a GeoJSON feature collection in degrees; polygons and multi-polygons alike are their edges."""
    ring = "array<array<double>>"
    fields = ", ".join(f"`{x}`: string" for x in (gid, name, kind))
    schema = f"features array<struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    one = F.from_json("f.geometry.coordinates", f"array<{ring}>")
    many = F.flatten(F.from_json("f.geometry.coordinates", f"array<array<{ring}>>"))
    points = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    rings = F.transform(F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one), points)
    p = F.col("f.properties")
    return rows.select(p[gid].alias("gid"), p[name].alias("name"), p[kind].alias("type"), ring_edges(rings).alias("edges"))


def statistics_csv(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """The panel (gid, year, key, value) of a CSV with region, subject, section, name, var, year and value; regions by name in capitals."""
    rows = spark.read.csv(path, header=True).withColumn("year", F.col("year").cast("int")).withColumn("value", F.col("value").cast("double"))
    known = checked_small(regions.select("gid", F.upper("name").alias("__region")))
    rows = rows.withColumn("__region", F.upper("region")).join(known, "__region")
    return rows.select("gid", "year", F.concat_ws("/", "subject", "section", "name", "var").alias("key"), "value")


def masterfile(rows: DataFrame) -> DataFrame:
    """Columns that end in _dt as dates of the form 01jan2010, null if unreadable; pubno as jurisdiction, kind and number; appl_id to the point."""
    dates = {c: F.try_to_timestamp(F.initcap(F.col(c)), F.lit("ddMMMyyyy")).cast("date") for c in rows.columns if c.endswith("_dt")}
    out = rows.withColumns(dates) if dates else rows
    if "pubno" in rows.columns:
        pick = lambda p: F.nullif(F.regexp_extract("pubno", p, 1), F.lit(""))
        out = out.withColumns({"jurisdiction": pick(r"^([A-Z]{2})"), "kind": pick(r"([A-Z]\d?)$"), "number": text.digits(F.regexp_replace("pubno", r"[A-Z]\d?$", ""))})
    if "appl_id" in rows.columns:
        out = out.withColumn("appl_id", F.regexp_extract("appl_id", r"^(\d+)", 1))
    return out
