from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sightings import model as m
from sightings.functions import text
from sightings.functions.dates import day_bounds, range_bounds, second_bounds
from sightings.operators import params
from sightings.operators.geologic import GeologicTime
from sightings.operators.predicates import IN_LIST_LIMIT, Filters, filter_in, merge_equals

EQ = {"type": "equals"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "Aves", ["A", "b"], 5, None), (2, None, [], None, None), (3, "aves", None, 7, 3.0), (4, "Pisces", ["C"], 9, 9000.0)],
        "id int, institutioncode string, recordedby array<string>, year int, distancefromcentroidinmeters double")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def kept(rows, p):
    return ids(Filters().apply(rows, p))


def test_equals_ignores_case_unless_asked(rows):
    assert kept(rows, {**EQ, "key": "INSTITUTION_CODE", "value": "AVES"}) == [1, 3]
    assert kept(rows, {**EQ, "key": "INSTITUTION_CODE", "value": "aves", "matchCase": True}) == [3]


def test_negation_leaves_out_records_without_the_field(rows):
    assert kept(rows, {"type": "not", "predicate": {**EQ, "key": "INSTITUTION_CODE", "value": "aves"}}) == [4]
    # an empty array counts as missing, too
    assert kept(rows, {"type": "not", "predicate": {**EQ, "key": "RECORDED_BY", "value": "a"}}) == [4]


def test_negated_conjunction_needs_every_field(rows):
    both = {"type": "and", "predicates": [{**EQ, "key": "INSTITUTION_CODE", "value": "x"}, {**EQ, "key": "YEAR", "value": "5"}]}
    assert kept(rows, {"type": "not", "predicate": both}) == [1, 3, 4]


def test_helpers_are_false_on_null(rows):
    flag = text.array_contains_text(F.col("recordedby"), "A", True)
    assert ids(rows.filter(~flag)) == [2, 3, 4]
    assert ids(rows.filter(~text.array_like_text(F.col("recordedby"), "?", False))) == [2, 3]


def test_missing_and_present(rows):
    assert kept(rows, {"type": "isNull", "key": "RECORDED_BY"}) == [2, 3]
    assert kept(rows, {"type": "isNotNull", "key": "YEAR"}) == [1, 3, 4]


def test_null_inclusive_only_without_an_upper_bound(rows):
    key = "DISTANCE_FROM_CENTROID_IN_METERS"
    assert kept(rows, {**EQ, "key": key, "value": "5000,*"}) == [1, 2, 4]
    assert kept(rows, {**EQ, "key": key, "value": "1,5000"}) == [3]
    assert kept(rows, {"type": "greaterThanOrEquals", "key": key, "value": "5000"}) == [1, 2, 4]


def test_nested_conditions_hold_on_one_element(spark):
    df = spark.createDataFrame(
        [(1, [(10.0, "a"), (99.0, "b")]), (2, [(99.0, "a")]), (3, [])], "id int, humboldt array<struct<duration:double,inventory:string>>")
    filters = Filters(m.EVENT_FIELDS)
    p = [{"type": "greaterThan", "key": "HUMBOLDT_EVENT_DURATION_VALUE_IN_MINUTES", "value": "50"},
         {**EQ, "key": "HUMBOLDT_INVENTORY_TYPES", "value": "a"}]
    assert ids(filters.apply(df, {"type": "and", "predicates": p})) == [2]
    assert ids(filters.apply(df, {"type": "or", "predicates": p})) == [1, 2]
    # no element may match, and there must be one
    assert ids(filters.apply(df, {"type": "not", "predicate": p[1]})) == []
    assert ids(filters.apply(df, {"type": "not", "predicate": {**EQ, "key": "HUMBOLDT_INVENTORY_TYPES", "value": "b"}})) == [2]


def test_missing_nested_values(spark):
    df = spark.createDataFrame([(1, [(None, "a")]), (2, [(1.0, "a")]), (3, []), (4, None)], "id int, humboldt array<struct<duration:double,inventory:string>>")
    key = "HUMBOLDT_EVENT_DURATION_VALUE_IN_MINUTES"
    assert ids(Filters(m.EVENT_FIELDS).apply(df, {"type": "isNull", "key": key})) == [1, 3, 4]
    assert ids(Filters(m.EVENT_FIELDS).apply(df, {"type": "isNotNull", "key": key})) == [2]


def test_several_geological_times(spark):
    df = spark.createDataFrame([(1, (3.0, 4.0)), (2, (100.0, 120.0)), (3, (300.0, 301.0))], "id int, geologicaltime struct<gt:double,lte:double>")
    filters = Filters(geologic=GeologicTime())
    assert ids(filters.apply(df, {"type": "in", "key": "GEOLOGICAL_TIME", "values": ["pliocene", "cretaceous"]})) == [1, 2]


def test_long_lists_use_a_key_table(spark):
    df = spark.range(3 * IN_LIST_LIMIT).select(F.col("id").cast("string").alias("k"))
    wanted = [str(n) for n in range(0, 2 * IN_LIST_LIMIT, 1)]
    listed = filter_in(df, F.col("k"), wanted)
    assert listed.count() == len(wanted)
    assert filter_in(df, F.col("k"), wanted[:5]).count() == 5
    assert filter_in(df, F.col("k"), wanted, match_case=True).count() == len(wanted)


def test_wildcards_quote_everything_else(spark):
    words = ["ab\\c?d*e", "ab\\c?d*eXfXXg", "^[abc].*x{1}$"]
    df = spark.createDataFrame([(words,)], "a array<string>")

    def likes(pattern, case):
        return df.select(text.array_like_text(F.col("a"), pattern, case)).first()[0]

    assert likes("a\\b\\\\c\\?d\\*E", False)
    assert likes("ab\\\\c\\?d\\*E?F*G", False)
    assert likes("ab\\\\c\\?d\\*e?f*g", True)
    assert likes("^[abc]\\.\\*x{1}$", False)
    assert not likes("^[abc].x{1}$", False)
    assert not likes("AB\\\\c\\?d\\*e", True)


def test_registered_wildcards_agree(spark):
    from sightings.functions.register import register_functions

    register_functions(spark)
    df = spark.createDataFrame([(["a.b", "x*y", "c\\d"],)], "a array<string>")
    for pattern in ["a?b", "A.B", "x\\*y", "x*", "c\\\\d", "z*", "a\\.b", "[ab]*"]:
        df.createOrReplaceTempView("likes")
        literal = pattern.replace("\\", "\\\\")
        for case in (True, False):
            mine = df.select(text.array_like_text(F.col("a"), pattern, case)).first()[0]
            theirs = spark.sql(f"SELECT StringArrayLike(a, '{literal}', {str(case).lower()}) FROM likes").first()[0]
            assert mine == theirs, pattern


def test_date_bounds():
    assert [d.isoformat() for d in day_bounds("2000")] == ["2000-01-01", "2001-01-01"]
    assert [d.isoformat() for d in day_bounds("2000-2")] == ["2000-02-01", "2000-03-01"]
    assert [d.isoformat() for d in day_bounds("2000-12-31")] == ["2000-12-31", "2001-01-01"]
    assert second_bounds("1970-01-01T00:00:10Z") == (10, 11)
    assert range_bounds("1980-02,*") == (second_bounds("1980-02")[0], None)
    assert range_bounds("1980-02,2021-09-16")[1] == second_bounds("2021-09-16")[1]
    with pytest.raises(ValueError):
        day_bounds("last summer")


def test_geological_time():
    time = GeologicTime()
    assert time.bounds("mesozoic,cenozoic") == time.bounds("cenozoic,mesozoic") == (0.0, 251.902)
    assert time.bounds("neogene,*") == (2.58, None)
    assert time.bounds("*,neogene") == (None, 23.03)
    assert time.bounds("burdigalian,pliocene") == (2.58, 20.44)
    assert time.bounds("miocene") == (5.333, 23.03)
    for contained in ("neogene,cenozoic", "cenozoic,neogene"):
        with pytest.raises(ValueError):
            time.bounds(contained)
    with pytest.raises(ValueError):
        time.bounds("nosuchtime")


def test_export_parameters():
    assert params.export_predicate({"YEAR": ["1999"]}) == {"type": "equals", "key": "YEAR", "value": "1999"}
    assert params.export_predicate({"YEAR": ["1999", "2000"]})["type"] == "in"
    mixed = params.export_predicate({"YEAR": ["1999", "2000,2002"]})
    assert mixed["type"] == "or" and mixed["predicates"][1]["type"] == "and"
    assert params.export_predicate({"ELEVATION": ["*,5"]}) == {"type": "lessThanOrEquals", "key": "ELEVATION", "value": "5"}
    assert params.export_predicate({"LOCALITY": ["*"]}) == {"type": "isNotNull", "key": "LOCALITY"}
    assert params.export_predicate({"nothing": ["1"]}) is None
    dated = params.export_predicate({"MODIFIED": ["1999-02,2000"]})
    assert [p["value"] for p in dated["predicates"]] == ["1999-02-01", "2000-12-31"]
    with pytest.raises(ValueError):
        params.export_predicate({"LOCALITY": ["1,2"]})


def test_search_parameters_and_ranges_with_values():
    p = params.search_predicate({"YEAR": ["1990,1995", "1998,2000", "1991", "1999"]})
    assert p["type"] == "and" and [q["type"] for q in p["predicates"]] == ["or", "in"]


def test_or_of_equals_becomes_in():
    p = {"type": "or", "predicates": [{**EQ, "key": "YEAR", "value": "1"}, {**EQ, "key": "YEAR", "value": "2"}, {**EQ, "key": "MONTH", "value": "3"}]}
    assert merge_equals(p) == {"type": "or", "predicates": [{"type": "in", "key": "YEAR", "values": ["1", "2"]}, {**EQ, "key": "MONTH", "value": "3"}]}


def test_durations():
    assert params.duration_minutes("2 hours") == "120"
    assert params.duration_minutes("1 day,*") == "1440,*"
    with pytest.raises(ValueError):
        params.duration_minutes("soon")


def test_issue_filter_of_a_checklist():
    filters = Filters()
    with pytest.raises(ValueError):
        filters.check_issues({**EQ, "key": "ISSUE", "value": "TAXON_MATCH_FUZZY"}, ["TAXON_MATCH_FUZZY"])


def test_json_text_and_parameter_names(rows):
    assert kept(rows, '{"type": "not", "predicate": {"type": "isNull", "parameter": "YEAR"}}') == [1, 3, 4]


def test_known_case_reaches_the_scan(spark):
    from conftest import SF_DIR

    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").withColumnRenamed("o_orderstatus", "countrycode")
    kept_rows = Filters().apply(orders, {"type": "or", "predicates": [{**EQ, "key": "COUNTRY", "value": "p"}, {**EQ, "key": "COUNTRY", "value": "f"}]})
    assert "In(o_orderstatus, [F,P])" in kept_rows._jdf.queryExecution().toString().replace("[P,F]", "[F,P]")
    assert kept_rows.count() == orders.filter("countrycode IN ('P', 'F')").count() > 0


def test_ranges_reach_the_scan(spark):
    from conftest import SF_DIR

    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").withColumnRenamed("l_linenumber", "year")
    plan = Filters().apply(lines, {**EQ, "key": "YEAR", "value": "2,4"}).select("year")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_linenumber,2)" in plan and "LessThanOrEqual(l_linenumber,4)" in plan
