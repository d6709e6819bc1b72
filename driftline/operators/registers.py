"""Registers: persons and organisations of documents, in place and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strnorm

EVENTS = ["application", "grant", "nogrant", "publication", "decision", "regional", "exhibition"]
SECTIONS = list("ABCDEFGH")
KINDS = ["IPC", "IPCR", "CPC"]
ROLE_FLAGS = ["assignee", "applicant", "inventor"]
WINDOW = ("2011-01-01", "2020-12-31")


def pulled(names: DataFrame, cities: DataFrame) -> DataFrame:
    """(id, doc, value, city, assignee, applicant, inventor): a row for each person of a document and place.

    names is (doc, id, frame, col, value, assignement) with tags such as 'firstnames-inventor', 'lastnames-inventor' and
    'names-inventor'; cities is (doc, id, value). First and last names of one id are one person, first names first;
    each whole name is one. Who has several roles in a document has all their flags.
    """
    tagged = names.withColumn("part", F.split_part("assignement", F.lit("-"), F.lit(1))).withColumn("role", F.split_part("assignement", F.lit("-"), F.lit(2)))
    order = F.when(F.col("part") == "firstnames", 0).when(F.col("part") == "lastnames", 1).otherwise(2)
    alone = F.when(F.col("part") == "names", F.concat_ws("/", "frame", "col"))
    keyed = tagged.withColumn("k", order).withColumn("alone", alone)
    # names and towns are dealt out by document once; all that follows is done where they then are
    named = keyed.select("doc", "id", "frame", "col", "value", "role", "k", "alone", F.lit(None).cast("string").alias("town"))
    none = [F.lit(None).cast(t).alias(c) for c, t in dict(named.dtypes).items() if c not in ("doc", "id", "town")]
    towns = cities.select("doc", "id", strnorm(F.col("value"), True, True).alias("town"), *none)
    rows = named.withColumn("__name", F.lit(True)).unionByName(towns.withColumn("__name", F.lit(False))).repartition("doc")
    known = F.col("doc").isNotNull() & F.col("id").isNotNull()
    joined = rows.withColumn("city", F.when(known, F.min("town").over(Window.partitionBy("doc", "id")))).where("__name")
    listed = F.array_sort(F.collect_list(F.struct("k", "frame", "col", "value")))
    flags = [F.max(F.col("role") == r).alias(r) for r in ROLE_FLAGS]
    people = joined.groupBy("doc", "id", "alone", "role", "city").agg(F.concat_ws(" ", F.transform(listed, lambda x: x["value"])).alias("value"), *flags)
    people = people.withColumn("value", strnorm(F.col("value"), False, False))
    one = people.groupBy("doc", "value", "city").agg(*[F.max(r).alias(r) for r in ROLE_FLAGS])
    return one.withColumn("id", F.xxhash64("doc", "value", "city")).select("id", "doc", "value", "city", *ROLE_FLAGS)


def event_columns(events: DataFrame) -> DataFrame:
    """(doc, firstdate, one column per kind of event): the first date of each."""
    return events.groupBy("doc").agg(F.min("date").alias("firstdate"), *[F.min(F.when(F.col("event") == e, F.col("date"))).alias(e) for e in EVENTS])


def section_counts(classes: DataFrame, sections: list[str] = SECTIONS) -> DataFrame:
    """(doc, clsf_A ... clsf_H): how often each section is given."""
    return classes.groupBy("doc").agg(*[F.count(F.when(F.col("section") == s, 1)).alias(f"clsf_{s}") for s in sections])


def section_lists(classes: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """(doc, IPC, IPCR, CPC): the sorted distinct sections by classification."""
    return classes.groupBy("doc").agg(*[F.array_sort(F.collect_set(F.when(F.col("classification") == k, F.col("section")))).alias(k) for k in kinds])


def placed(named: DataFrame, geoloc: DataFrame, events: DataFrame, classes: DataFrame) -> DataFrame:
    """Registers with dates, coordinates of (doc, city), section counts (0 for none) and lists."""
    towns = geoloc.groupBy("doc", "city").agg(F.min(F.struct("lat", "lon", "loceval")).alias("at")).select("doc", "city", "at.lat", "at.lon", "at.loceval")
    sides = [event_columns(events), section_counts(classes), section_lists(classes)]
    out = reduce(lambda a, b: a.join(b, "doc", "left"), sides, named.join(towns, ["doc", "city"], "left"))
    return out.fillna(0, [f"clsf_{s}" for s in SECTIONS])


def selected(registers: DataFrame, window: tuple[str, str] = WINDOW) -> DataFrame:
    """Granted from the window's first day and applied for by its last; an unknown date is out."""
    return registers.where((F.col("grant") >= F.lit(window[0]).cast("date")) & (F.col("application") <= F.lit(window[1]).cast("date")))


def location_report(registers: DataFrame) -> DataFrame:
    """(loceval, size): how places were found; without one, whether a town was named at all."""
    kind = F.coalesce("loceval", F.when(F.col("city").isNotNull(), "not found").otherwise("not given"))
    return registers.groupBy(kind.alias("loceval")).agg(F.count("*").alias("size"))


def missing_report(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, size) of a table."""
    row = table.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), F.col("n").alias("size")) for c in columns])
    return row.select(F.inline(pairs))
