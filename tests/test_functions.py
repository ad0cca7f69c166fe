from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sightings.functions import dates, text
from sightings.functions.register import register_functions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_iso_text(spark):
    assert one(spark, dates.seconds_to_iso8601(F.lit(1585846134))) == "2020-04-02T16:48:54Z"
    assert one(spark, dates.seconds_to_local_iso8601(F.lit(1585846134))) == "2020-04-02T16:48:54"
    assert one(spark, dates.millis_to_iso8601(F.lit(1585846134000))) == "2020-04-02T16:48:54Z"
    assert one(spark, dates.millis_to_iso8601(F.lit(1585846134001))) == "2020-04-02T16:48:54.001Z"
    assert one(spark, dates.millis_to_iso8601(F.lit(-1))) == "1969-12-31T23:59:59.999Z"
    assert one(spark, dates.seconds_to_iso8601(F.lit(None).cast("bigint"))) is None


def test_clean_delimiters(spark):
    cases = {"a\tb": "a b", "a\r\nb": "a  b", " \t a   ": "a", "\x00\x01a\x1f": "a", "": "", "a\u0085b\x0bc": "a b c"}
    for given, wanted in cases.items():
        assert one(spark, text.clean_delimiters(F.lit(given))) == wanted
    df = spark.createDataFrame([(given, wanted) for given, wanted in cases.items()], "g string, w string")
    register_functions(spark)
    df.createOrReplaceTempView("cleaned")
    assert spark.sql("SELECT * FROM cleaned WHERE cleanDelimiters(g) <> w").count() == 0


def test_arrays(spark):
    def array(*items):
        return F.array(*[F.lit(i).cast("string") for i in items])

    assert one(spark, text.clean_delimiters_array(array(" a\t", None, "\n"))) == ["a"]
    assert one(spark, text.clean_delimiters_array(array("\n"))) is None
    assert one(spark, text.remove_nulls(array(None))) is None
    assert one(spark, text.remove_null_strings(array("a", " ", None))) == ["a"]
    assert one(spark, text.join_array(array("a", "b"))) == "a;b"
    assert one(spark, text.join_array(F.array().cast("array<string>"))) is None
    assert one(spark, text.array_union_all(F.lit(None).cast("array<string>"), array("a"))) == ["a"]


@pytest.mark.parametrize("day,time,seconds", [
    ("2000", None, 366 * 86400), ("2001-02", None, 28 * 86400), ("2001-02-03", None, 86400), ("2001-02-03", "10:20", 60),
    ("2001-02-03", "10:20:30", 1), ("2001-02-03T10:20", None, 60), ("2001-02-03T10:20:30", None, 1), ("2000-01-01/2000-01-02", None, 2 * 86400),
    ("2000/2001", None, 731 * 86400), ("sometime", None, None)])
def test_temporal_uncertainty(spark, day, time, seconds):
    df = spark.createDataFrame([(day, time)], "d string, t string")
    assert df.select(dates.temporal_uncertainty("d", "t")).first()[0] == seconds


def test_lenient_dates(spark):
    for given, wanted in {"2001-2-3": "2001-02-03", "3.2.2001": "2001-02-03", "0000": "0001-01-01", "2001": "2001-01-01",
                          "2001-02-03T04:05:06Z": "2001-02-03", "20010203": "2001-02-03", "nonsense": None}.items():
        assert one(spark, F.date_format(dates.parse_lenient(F.lit(given)), "yyyy-MM-dd")) == wanted


def test_registered_names(spark):
    names = register_functions(spark)
    assert len(names) == len(set(names)) == 18
    for name in names:
        assert spark.catalog.functionExists(name)


def test_within_parses_each_text(spark):
    register_functions(spark)
    df = spark.createDataFrame([("POINT (1 2)", 2.0, 1.0), ("POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))", 1.0, 1.0), (None, 1.0, 1.0)], "w string, lat double, lon double")
    df.createOrReplaceTempView("w")
    assert [r[0] for r in spark.sql("SELECT Within(w, lat, lon) FROM w").collect()] == [True, True, False]
