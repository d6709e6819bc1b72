import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import dates, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "value,inter,digit,want",
    [
        ("Łódź", True, False, "LODZ"),
        ("Jan 3 Kowalski", True, False, "JAN 3 KOWALSKI"),
        ("Jan 3 Kowalski", True, True, "JAN KOWALSKI"),
        ("ACME, INC.", True, False, "ACME INC"),
        ("ACME, INC.", False, False, "ACME, INC."),
        ("Żółw-ąęś ", True, False, "ZOLW AES"),
        ("straße", True, False, "STRASSE"),
        ("e\u0301", True, False, "E"),
        (None, True, True, None),
        ("", True, True, ""),
    ],
)
def test_strnorm(spark, value, inter, digit, want):
    assert one(spark, value, lambda c: text.strnorm(c, inter, digit)) == want
    assert one(spark, value, lambda c: text.strnorm(c, inter, digit, general=True)) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cc", "Cs"]), max_size=20), min_size=1, max_size=20))
def test_strnorm_twice_is_once_and_agrees_with_decomposition(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    c = text.strnorm(F.col("v"), True, True)
    for r in df.select(c.alias("a"), text.strnorm(c, True, True).alias("b"), "v").collect():
        assert r.a == r.b
        assert not any(unicodedata.combining(ch) for ch in r.a)


def test_digits_words_and_parts(spark):
    assert one(spark, "PL 12-34/5", text.digits) == "12345"
    assert one(spark, "Zażółć gęślą-jaźń a", lambda c: text.words(c, 2, "upper")) == ["ZAŻÓŁĆ", "GĘŚLĄ", "JAŹŃ"]
    assert one(spark, "date-grant", lambda c: text.tag_part(c, 2)) == "grant"
    assert tuple(one(spark, "P.123456 ", text.application_code)) == ("P", "123456")
    assert tuple(one(spark, "EP1234567A1", text.family_code)) == ("EP", "1234567")
    assert one(spark, "raw/123456.xml", text.file_code) == "123456" and one(spark, "raw/12.xml", text.file_code) is None
    assert tuple(one(spark, "A61K 31/00", text.classification)) == ("A", "61")
    assert one(spark, "Warszawa, 00-950; Kraków", text.city_names) == ["WARSZAWA", "KRAKOW"]
    assert one(spark, "~", text.city_names) == []
    assert one(spark, "Jan Maria Kowalski", text.name_pair) == ["Jan", "Kowalski"] and one(spark, "Jan", text.name_pair) == ["Jan"]
    assert one(spark, " ", text.name_pair) is None and one(spark, "Warszawa", text.name_head) == "Wars."


def test_a_longer_number_is_no_code_of_a_file(spark):
    assert one(spark, "a/b/1000000_x1.xml", text.file_code) is None
    assert one(spark, "2000001/123456_x1.xml", text.file_code) == "123456"


def test_grams(spark):
    rows = one(spark, "KRAKOW", lambda c: text.grams(c, 3))
    assert [(r.gram, r.weight) for r in rows] == [("KRA", 0.25), ("_RAK", 0.25), ("__AKO", 0.25), ("___KOW", 0.25)]
    assert one(spark, "AB", lambda c: text.grams(c, 3)) == [] and one(spark, None, lambda c: text.grams(c, 3)) is None
    assert [tuple(r) for r in one(spark, "ABC", lambda c: text.grams(c, 3))] == [("ABC", 1.0)]
    assert [r.gram for r in one(spark, "ABCD", lambda c: text.grams(c, 3, True, True))] == ["ABC_", "_BCD"]


def test_labels_and_containment(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, None)], "a boolean, b boolean")
    got = [r[0] for r in df.select(text.two_flags(F.col("a"), F.col("b"), "none", "a", "b", "both")).collect()]
    assert got == ["both", "a", "b", "none"]
    assert one(spark, "VINCENT", lambda c: text.contains_any(c, ["INC."])) is False
    assert one(spark, "VINCENT", lambda c: text.contains_any(c, ["INC."], literal=False)) is True
    assert one(spark, None, lambda c: text.contains_any(c, ["x"])) is False


@pytest.mark.parametrize(
    "value,want",
    [("2014-03-01", "2014-03-01"), ("20140301", "2014-03-01"), ("03/04/2014", "2014-03-04"), ("31.12.2010", "2010-12-31"), ("01Jan2010", "2010-01-01"), ("31.02.2010", None), ("x", None), (None, None)],
)
def test_mixed_dates(spark, value, want):
    got = one(spark, value, dates.mixed_date)
    assert (got and got.isoformat()) == want
