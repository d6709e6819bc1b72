"""Text functions as column expressions; only general Unicode decomposition needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Upper-case letters below U+0250 that decompose to one base letter, and those letters; and the Polish L, which doesn't decompose."""
    found = {"Ł": "L"}
    for k in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(k):
            found[chr(k)] = base
    return "".join(found), "".join(found.values())


_FROM, _TO = _plain_letters()


def _decomposed(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
        return values.map(plain, na_action="ignore")

    return run(c)


def strnorm(c: Column, drop_inter: bool = True, drop_digit: bool = False, general: bool = False) -> Column:
    """Upper case without diacritics. Digits and punctuation become one space if asked for; with drop_inter the ends are trimmed.

    Latin letters are translated by expression; general=True decomposes every script with an
    Arrow UDF. Null stays null.
    """
    y = F.upper(c)
    y = F.translate(_decomposed(y), "Ł", "L") if general else F.regexp_replace(F.translate(y, _FROM, _TO), r"\p{M}", "")
    if drop_digit:
        y = F.regexp_replace(y, r"(?U)[\s\d]+", " ")
    if drop_inter:
        y = F.trim(F.regexp_replace(y, r"(?U)[\s\W]+", " "))
    return y


def digits(c: Column) -> Column:
    """All digits of a string, joined."""
    return F.regexp_replace(c, r"(?U)\D", "")


def words(c: Column, min_length: int = 1, case: str | None = None) -> Column:
    """Array of runs of word characters of at least min_length, in upper or lower case if asked for."""
    c = {"upper": F.upper, "lower": F.lower, None: lambda x: x}[case](c)
    found = F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.filter(found, lambda w: F.length(w) >= min_length)


def grams(c: Column, n: int = 3, prefix: bool = True, suffix: bool = False, pad: str = "_") -> Column:
    """Array of (gram, weight): each n characters, padded with as many signs as stand before (and after), so that the place counts.

    Weights add to 1; a shorter string gives an empty array, null gives null.
    """
    last = F.length(c) - n

    def gram(i: Column) -> Column:
        parts = ([F.repeat(F.lit(pad), i)] if prefix else []) + [F.substring(c, i + 1, F.lit(n))]
        return F.concat(*parts, *([F.repeat(F.lit(pad), last - i)] if suffix else []))

    one = lambda i: F.struct(gram(i).alias("gram"), (F.lit(1.0) / (last + 1)).alias("weight"))
    none = F.expr("cast(array() as array<struct<gram:string,weight:double>>)")
    return F.when(c.isNull(), F.lit(None)).when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(none)


def application_code(c: Column) -> Column:
    """struct(prefix, number) of an application code without punctuation, in upper case."""
    plain = F.upper(F.regexp_replace(c, r"(?U)\W+", ""))
    pick = lambda k: F.nullif(F.regexp_extract(plain, r"(\D+)(\d+)", k), F.lit(""))
    return F.struct(pick(1).alias("prefix"), pick(2).alias("number"))


def family_code(c: Column) -> Column:
    """struct(country, number): what stands before the first digit, and the first digits."""
    pick = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(pick(r"^(\D+)").alias("country"), pick(r"(\d+)").alias("number"))


def file_code(c: Column, extension: str = "xml") -> Column:
    """The first number of six digits, no more, in a file name; null without."""
    return F.nullif(F.regexp_extract(c, rf"(?<!\d)(\d{{6}})(?!\d).*\.{extension}", 1), F.lit(""))


def classification(c: Column) -> Column:
    """struct(section, class) of a classification symbol such as 'A61K 31/00'."""
    pick = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(pick(r"^(\w)").alias("section"), pick(r"^\w\s?(\d+)").alias("class"))


def city_names(c: Column) -> Column:
    """Array of place names in a field: parts between commas and semicolons, of them the runs of letters, normalised."""
    runs = lambda part: F.regexp_extract_all(part, F.lit(r"(?U)((?:[^\d\W]|\s)+)"), F.lit(1))
    found = F.flatten(F.transform(F.split(c, "[,;]"), runs))
    return F.filter(F.transform(found, lambda x: strnorm(x, True, True)), lambda x: x != "")


def tag_part(c: Column, k: int) -> Column:
    """Part k, from 1, of a tag such as 'date-grant'; '' beyond the last."""
    return F.split_part(c, F.lit("-"), F.lit(k))


def contains_any(c: Column, parts: list[str], literal: bool = True) -> Column:
    """Whether one of the parts (or patterns) is in the string; false for null. Parts are one pattern, so that c is read and made once."""
    if literal:
        return F.coalesce(c.rlike("|".join(rf"\Q{p}\E" for p in parts)), F.lit(False)) if parts else F.lit(False)
    found = F.lit(False)
    for p in parts:
        found = found | c.rlike(p)
    return F.coalesce(found, F.lit(False))


def name_pair(c: Column) -> Column:
    """Sorted array of the first and the last word of a name, one element if they are equal; null for no word."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    pair = F.array_sort(F.array_distinct(F.array(F.element_at(parts, 1), F.element_at(parts, -1))))
    return F.when(F.size(parts) > 0, pair)


def name_head(c: Column, n: int = 4) -> Column:
    """The first letters of a name and a full stop."""
    return F.concat(F.substring(c, 1, n), F.lit("."))


def two_flags(a: Column, b: Column, none: str, first: str, second: str, both: str) -> Column:
    """One of four labels for two flags; null counts as false."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(a & b, both).when(a, first).when(b, second).otherwise(none)
