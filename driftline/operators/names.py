"""Dictionaries of names and the classification of persons and organisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, strnorm
from ..session import checked_small, written

# fixed values: what marks an organisation
ORG_PARTS = ["&", "INTERNAZIO", "INTERNATIO", "INC.", "ING.", "SP. Z O. O.", "S.P.A."]
ORG_KEYWORDS = [
    "THE", "INDIVIDUAL", "CORP", "COMPANY", "PRZEDSIEBIORSTWO", "FUNDACJA", "INSTYTUT", "INSTITUTE", "HOSPITAL", "SZPITAL", "SZKOLA", "LTD", "SPOLKA", "LIMITED",
    "GMBH", "ZAKLAD", "PPHU", "KOPALNIA", "SPOLDZIELNIA", "FABRYKA", "ENTERPRISE", "TECHNOLOGY", "LLC", "CORPORATION", "INC", "MIASTO", "GMINA", "URZAD", "GOVERNMENT",
    "RZAD", "AKTIENGESELLSCHAFT", "KOMMANDITGESELLSCHAFT", "UNIWERSYTET", "UNIVERSITY", "AKADEMIA", "ACADEMY", "POLITECHNIKA",
]
# from the weakest up: a word in several roles has the last of them
ROLES = ["orgname", "firstname", "lastname", "ambigname"]


def entries(sources: list[tuple], tags: tuple[str, ...] = ("names", "firstnames", "lastnames"), type_tag: str | None = None) -> DataFrame:
    """(doc, id, value, assignement, type) over storages: `tags` may be followed by a dash and a part; type_tag's value is joined by doc and id."""
    found = []
    for storage, assigned in sources:
        names = storage.melt_all(assigned).withColumn("assignement", F.split_part("assignement", F.lit("-"), F.lit(1)))
        names = names.where(F.col("assignement").isin(*tags)).select("doc", "id", "value", "assignement")
        if type_tag:
            types = storage.melt(type_tag).groupBy("doc", "id").agg(F.min("value").alias("type"))
            names = names.join(types, ["doc", "id"], "left")
        else:
            names = names.withColumn("type", F.lit(None).cast("string"))
        found.append(names)
    return reduce(DataFrame.unionByName, found)


def dictionary(names: DataFrame, parts: list[str] = ORG_PARTS, keywords: list[str] = ORG_KEYWORDS, literal: bool = True) -> DataFrame:
    """(value, role): what each name or word is known as.

    Whole names that have an organisation's part, or whose type is LEGAL, or that have a
    keyword, are organisations. Of the others, words of first and last names have that role; words of
    whole names, and those that are both, are ambiguous. The strongest role wins. literal=False
    takes the parts as patterns and the keywords anywhere in a name, not only as whole words.
    """
    names = names.select("value", "assignement", "type").distinct()  # roles don't depend on how often a name is given
    raw = names.withColumn("is_part", contains_any(F.upper("value"), parts, literal)).withColumn("value", strnorm(F.col("value")))
    padded = F.concat(F.lit(" "), F.col("value"), F.lit(" "))
    keyed = contains_any(padded, [f" {k} " for k in keywords]) if literal else contains_any(F.col("value"), keywords)
    legal = F.coalesce(F.upper("type") == "LEGAL", F.lit(False))
    marked = raw.withColumn("is_org", F.col("is_part") | legal | keyed)
    orgs = marked.where("is_org").select("value", F.lit("orgname").alias("role"))
    words = marked.where("not is_org").select("assignement", F.explode(F.split("value", " ")).alias("value")).where("value <> ''")
    by_word = words.groupBy("value").agg(
        *[F.max((F.col("assignement") == a).cast("int")).alias(k) for a, k in (("firstnames", "f"), ("lastnames", "l"), ("names", "n"), ("ambignames", "m"))]
    )
    ambiguous = (F.col("n") == 1) | (F.col("m") == 1) | ((F.col("f") == 1) & (F.col("l") == 1))
    role = F.when(ambiguous, "ambigname").when(F.col("l") == 1, "lastname").otherwise("firstname")
    known = by_word.select("value", role.alias("role"))
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    top = orgs.unionByName(known).where("value <> ''").groupBy("value").agg(F.max(F.struct(rank.alias("rank"), F.col("role").alias("role"))).alias("best"))
    return top.select("value", F.col("best.role").alias("role"))


def classified(pulled: DataFrame, known: DataFrame) -> DataFrame:
    """pulled with organisation, true, false or null, and firstnames and lastnames.

    A value that is in the dictionary as a whole is an organisation or a person; one whose
    words are all names of persons is a person; others are not known. Each different value is judged once.
    """
    roles = known.withColumnRenamed("role", "__role")
    values = pulled.select("value").distinct()
    whole = values.join(roles, "value", "left")
    one = lambda role: F.when(F.col("__role") == role, F.col("value"))
    sure = whole.where("__role is not null").select("value", (F.col("__role") == "orgname").alias("organisation"), one("firstname").alias("firstnames"), one("lastname").alias("lastnames"))
    rest = whole.where("__role is null").select("value")
    parts = rest.select("value", F.posexplode(F.filter(F.split("value", " "), lambda w: w != "")).alias("__k", "__word"))
    words = parts.join(roles.where("__role <> 'orgname'").withColumnRenamed("value", "__word"), "__word", "left")
    listed = lambda role: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("__role") == role, F.struct("__k", "__word")))), lambda x: x["__word"]))
    people = words.groupBy("value").agg(F.min(F.col("__role").isNotNull()).alias("all_known"), listed("firstname").alias("firstnames"), listed("lastname").alias("lastnames"))
    people = people.where("all_known").select("value", F.lit(False).alias("organisation"), "firstnames", "lastnames")
    judged = checked_small(written(sure.unionByName(people), "judged"))
    return pulled.join(judged, "value", "left").select(*pulled.columns, "organisation", "firstnames", "lastnames")
