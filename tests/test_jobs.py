from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightings.operators import citations
from sightings.operators.text_search import full_text, search, searchable_terms, suggest
from sightings.plans import exports, interpret, layouts, terms
from sightings.plans.user_sql import dialect, run_user_sql
from sightings.session import scratch_path, shared_folder
from sightings.sources import sinks, tables
from sightings.streaming import changes


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("raw,want", [
    (("2001", "2", "3", None, None, None), (2001, 2, 3)),
    (("2001", "2", None, "2001-02-03", None, None), (2001, 2, 3)),
    (("2001", "3", None, "2001-02-03", None, None), (2001, None, None)),
    (("2002", None, None, "2001-02-03", None, None), (None, None, None)),
    ((None, None, None, "2001-02-03/2001-02-20", None, None), (2001, 2, None)),
    (("2001", "2", "10", "2001-02-03/2001-03-20", None, None), (2001, None, None)),
    (("2001", "5", "10", "2001-02-03/2001-03-20", None, None), (2001, None, None)),
    (("2000", None, None, None, "60", "60"), (2000, 2, 29)),
    ((None, None, None, "1200-01-01", None, None), (None, None, None)),
    (("2001", "2", "30", None, None, None), (None, None, None)),
    ((None, None, None, "soon", None, None), (None, None, None)),
    (("abc", "2", "3", None, None, None), (None, None, None)),
])
def test_dates(spark, raw, want):
    df = spark.createDataFrame([raw], ", ".join(f"{c} string" for c in interpret.RAW_DATES))
    row = interpret.standardise_dates(df).first()
    assert (row.year, row.month, row.day) == want
    if want[2] is not None:
        assert row.epoch_to - row.epoch_from == 86399


def test_dates_keep_every_row(spark):
    df = spark.createDataFrame([("2001", None), ("2001", None), (None, "x")], "v_year string, v_eventdate string")
    for c in interpret.RAW_DATES:
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    assert interpret.standardise_dates(df).count() == 3


def test_countries(spark):
    names = spark.createDataFrame([("denmark", "DK"), ("dk", "DK"), ("norway", "NO")], "name string, country string")
    df = spark.createDataFrame([("Denmark", "DK"), ("Denmark", "Norway"), ("xx", "Norway"), ("xx", None), (None, ""), ("xx", "yy"), ("", "Norway")], "a string, b string")
    got = rows_of(interpret.standardise_country(df, ["a", "b"], names), "a", "b", "country", F.array_join("countryissues", ";"))
    assert {(a, b): (c, i) for a, b, c, i in got} == {
        ("Denmark", "DK"): ("DK", ""), ("Denmark", "Norway"): ("DK", "COUNTRY_MISMATCH"), ("xx", "Norway"): ("NO", "COUNTRY_INVALID"),
        ("xx", None): (None, "COUNTRY_INVALID"), (None, ""): (None, ""), ("xx", "yy"): (None, "COUNTRY_INVALID"), ("", "Norway"): ("NO", "")}


def _square(country, x, y, size=10.0):
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
    return (country, [{"x": float(a), "y": float(b)} for a, b in corners])


def test_coordinates(spark):
    layer = spark.createDataFrame([_square("IE", 0, 0), _square("GB", 10, 0), _square("FR", 30, 0), _square("GF", 60, -30)],
                                  "country string, ring array<struct<x:double,y:double>>")
    cases = [
        (5.0, 5.0, "IE", (5.0, 5.0, "IE", "")),
        (5.0, 5.0, None, (5.0, 5.0, "IE", "COUNTRY_DERIVED_FROM_COORDINATES")),
        (5.0, 15.0, "IE", (5.0, 15.0, "GB", "COUNTRY_DERIVED_FROM_COORDINATES")),
        (-25.0, 65.0, "FR", (-25.0, 65.0, "GF", "")),
        (-5.0, 5.0, "IE", (5.0, 5.0, "IE", "PRESUMED_NEGATED_LATITUDE")),
        (5.0, -5.0, "IE", (5.0, 5.0, "IE", "PRESUMED_NEGATED_LONGITUDE")),
        (-5.0, -5.0, "IE", (5.0, 5.0, "IE", "PRESUMED_NEGATED_LATITUDE;PRESUMED_NEGATED_LONGITUDE")),
        (35.0, 5.0, "FR", (5.0, 35.0, "FR", "PRESUMED_SWAPPED_COORDINATE")),
        (50.0, 100.0, "FR", (50.0, 100.0, "FR", "COUNTRY_COORDINATE_MISMATCH")),
        (-70.0, 100.0, None, (-70.0, 100.0, "AQ", "COUNTRY_DERIVED_FROM_COORDINATES")),
        (50.0, 100.0, None, (50.0, 100.0, None, "")),
        (None, 5.0, "IE", (None, None, "IE", "")),
    ]
    df = spark.createDataFrame([(n, a, b, c) for n, (a, b, c, _) in enumerate(cases)], "n int, lat double, lon double, country string")
    checked = interpret.validate_coordinates(df, layer)
    got = {r.n: (r.finallat, r.finallon, r.finalcountry, ";".join(r.coordinateissues)) for r in checked.collect()}
    assert got == {n: want for n, (_, _, _, want) in enumerate(cases)}
    dropped = {r.n: (r.keptlat, r.keptcountry) for r in interpret.drop_contradictions(checked).collect()}
    assert dropped[8] == (None, "FR") and dropped[2] == (5.0, "GB") and dropped[11] == (None, "IE")


def test_names_are_matched_in_order(spark):
    backbone = spark.createDataFrame(
        [("1", "Puma concolor (L.)", "Puma concolor", "SPECIES"), ("2", "Puma", "Puma", "GENUS"), ("3", "Felis catus", "Felis catus", "SPECIES")],
        "usagekey string, scientificname string, canonicalname string, taxonrank string")
    df = spark.createDataFrame([("PUMA concolor (L.)",), ("Puma concolor",), ("Puma concolr",), ("Puma yagou",), ("Canis lupus",), ("felis catus L.",), (None,)], "name string")
    got = dict((n, (k, t)) for n, k, t in rows_of(interpret.match_taxa(df, "name", backbone), "name", "usagekey", "matchtype"))
    assert got == {"PUMA concolor (L.)": ("1", "EXACT"), "Puma concolor": ("1", "CANONICAL"), "Puma concolr": ("1", "FUZZY"), "Puma yagou": ("2", "HIGHERRANK"),
                   "Canis lupus": (None, "NONE"), "felis catus L.": ("3", "CANONICAL"), None: (None, "NONE")}


def test_composed_names(spark):
    df = spark.createDataFrame([(" Aus  bus ", "L.", "x", None, None, None), ("Aus bus L.", "l.", None, None, None, None), (None, "L.", None, "Aus", "bus", " "), (None,) * 6],
                               "s string, a string, gn string, g string, e string, i string")
    composed = interpret.compose_name(*[F.col(c) for c in ("s", "a", "gn", "g", "e", "i")])
    assert [r[0] for r in df.select(composed).collect()] == ["Aus bus L.", "Aus bus L.", "Aus bus L.", None]


def test_numbers(spark):
    df = spark.createDataFrame([("10 m", "20"), ("10ft", None), ("x", "5"), (None, None)], "a string, b string")
    got = rows_of(interpret.standardise_range(df, "a", "b", "depth"), "depth", "depthaccuracy")
    assert got == [(15.0, 5.0), (pytest.approx(3.048), None), (5.0, None), (None, None)]


def test_place_names(spark):
    df = spark.createDataFrame([("NORTH  SHORE",), (" Le\tHavre ",), ("PLOT 7",), (None,)], "x string")
    assert [r[0] for r in df.select(interpret.clean_place_name(F.col("x"))).collect()] == ["North shore", "Le Havre", "PLOT 7", None]


# ---- layouts and exports ------------------------------------------------------------------------

def test_layouts_refuse_an_empty_checklist(spark):
    df = spark.createDataFrame([("1",)], "recordid string")
    with pytest.raises(ValueError):
        layouts.project_taxonomic(df, "", ["kingdom"])


def test_layout_lists():
    assert len(terms.MAP_OF_LIFE_TERMS) == len(set(terms.MAP_OF_LIFE_TERMS)) == 76
    assert len(terms.SIMPLE_TERMS) == 49 and len(terms.MEDIA_COLUMNS) == 14
    pairs = layouts.simple_with_verbatim_pairs()
    assert len(pairs) == len(set(pairs))


def test_missing_columns_become_typed_nulls(spark):
    df = spark.createDataFrame([("1",)], "recordid string")
    out = layouts.project_parquet(df, ["year", "eventdategte", "sex", "typestatus", "locality"], ["locality", "verbatimsrs"])
    assert out.dtypes == [("recordid", "string"), ("year", "int"), ("eventdategte", "timestamp"), ("sex", "string"),
                          ("typestatus", "array<string>"), ("locality", "string"), ("verbatimlocality", "string"), ("verbatimsrs", "string")]


def test_keys(spark):
    df = spark.createDataFrame([("d", "o", "i", "c", "n"), ("d", None, "i", "c", "n"), ("d", None, "i", None, "n"), (None, "o", "i", "c", "n")],
                               "datasetkey string, occurrenceid string, institutioncode string, collectioncode string, catalognumber string")
    assert [r[0] for r in df.select(layouts.record_key(df)).collect()] == ["d|o", "d|i|c|n|null", None, None]


def test_licences(spark):
    df = spark.createDataFrame([("a", "CC0_1_0"), ("a", "CC_BY_4_0"), ("b", "UNSPECIFIED"), ("b", None)], "k string, license string")
    assert dict(rows_of(citations.most_restrictive(df, "k"), "k", "license")) == {"a": "CC_BY_4_0", "b": "CC0_1_0"}
    assert citations.most_restrictive(df.filter("k = 'b'"), default="CC_BY_4_0").first().license == "CC_BY_4_0"
    with pytest.raises(ValueError):
        citations.most_restrictive(df, default="UNSPECIFIED")


def test_consistency_report_finds_faults(spark):
    good = spark.createDataFrame([("1", "d"), ("2", "d"), ("3", "e")], "recordid string, datasetkey string")
    cited = citations.citation(good, with_license=False)

    def report(verbatim, interpreted, citation):
        return dict(rows_of(exports.consistency_report(verbatim, interpreted, citation), "check", "holds"))

    assert all(report(good, good, cited).values())
    assert not report(good.filter("recordid <> '2'"), good, cited)["same records verbatim and interpreted"]
    moved = spark.createDataFrame([("d", 1), ("e", 2)], "datasetkey string, num_occurrences bigint")
    broken = report(good, good, moved)
    assert not broken["citation counts per dataset"] and broken["citation total"]
    lines = spark.createDataFrame([("a\tb",), ("a",)], "value string")
    assert not exports.column_count_report(lines, 2).first().holds


def test_text_files(spark):
    df = spark.createDataFrame([("1", None, 2.5), ("2", 'a"b', None)], "a string, b string, c double")
    path = scratch_path(spark, "t")
    sinks.write_tsv(df, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["1\t\t2.5", '2\ta"b\t']
    assert spark.read.text(f"{path}_header").first().value == "a\tb\tc"


def test_avro_falls_back_only_where_told(spark):
    df = spark.createDataFrame([("1", ["a"])], "recordid string, x array<string>")
    path = scratch_path(spark, "a")
    fmt = sinks.write_avro(df, path, fallback="orc")
    assert fmt == ("avro" if sinks.avro_available(spark) else "orc")
    if fmt == "orc":
        with pytest.raises(RuntimeError, match="spark-avro"):
            sinks.write_avro(df, path)
    assert spark.read.format(fmt).schema(df.schema).load(path).collect() == df.collect()


def test_publish_keeps_the_previous_version(spark):
    folder = shared_folder(spark)
    for n in (1, 2, 3):
        tables.publish(spark.range(n).toDF("x"), "published", folder)
    assert spark.table("published").count() == 3 and spark.table("old_published").count() == 2


def test_user_sql_takes_queries_only(spark):
    views = {"occurrence": spark.createDataFrame([("a", 1)], "k string, year int")}
    assert run_user_sql(spark, views, "SELECT \"k\", 'say \"hi\"' AS s FROM occurrence;").first().s == 'say "hi"'
    assert dialect("SELECT \"a\" FROM t WHERE b = 'x\"y'") == "SELECT `a` FROM t WHERE b = 'x\"y'"
    for command in ("DROP TABLE x", "CREATE VIEW v AS SELECT 1", "SELECT 1) t; DROP TABLE x; --"):
        with pytest.raises(Exception):
            run_user_sql(spark, views, command)


def test_search(spark):
    docs = spark.createDataFrame([(1, "The red fox", "fox"), (2, "A blue whale", None), (3, "Red whale, red!", "x")], "id int, text string, name string")
    found = search(docs, "red WHALE", F.col("text"), [(F.col("name"), 100)])
    assert {r.id: r.score for r in found.collect()} == {1: 1, 2: 1, 3: 2}
    assert search(docs, "fox", F.col("text"), [(F.col("name"), 100)]).first().score == 101
    assert search(docs, " ,", F.col("text")).count() == 0


def test_full_text_field(spark):
    df = spark.createDataFrame([("r1", "Aves", "Aves", 5, 2000, True, ["x"], "d1")],
                               "recordid string, class string, v_class string, individualcount int, year int, hascoordinate boolean, recordedby array<string>, datasetkey string")
    assert sorted(df.select(full_text(df)).first()[0]) == ["2000", "Aves"]


def test_suggestions_are_for_some_fields(spark):
    with pytest.raises(ValueError):
        suggest(spark.createDataFrame([("a",)], "datasetkey string"), "DATASET_KEY", "a")
    names = [n for n, _ in searchable_terms()]
    assert "SAMPLING_PROTOCOL" in names and names == sorted(names)


# ---- changes --------------------------------------------------------------------------------------

_DATASET = "key string, publishingorgkey string, projectid string, title string, networkkeys array<string>, category array<string>, installationkey string, license string, created timestamp, endpoints array<string>"
_OLD = ("d", "o", None, "t", ["a", "b"], None, "i", "CC0", dt.datetime(2020, 1, 1), ["EML"])


@pytest.mark.parametrize("place,value,changed", [
    (1, "o2", True), (2, "p", True), (3, None, True), (4, ["b", "a", "a"], False), (4, None, True), (5, [], False), (5, ["c"], True),
    (6, "i2", True), (7, "CC_BY", True), (9, ["FEED"], False)])
def test_dataset_changes(spark, place, value, changed):
    new = list(_OLD)
    new[place] = value
    rows = changes.snapshot_changes(spark.createDataFrame([_OLD], _DATASET), spark.createDataFrame([tuple(new)], _DATASET))
    at = F.lit("2020-01-02").cast("timestamp")
    assert rows.select(changes.dataset_requires_update("old", "new", at)).first()[0] is changed


def test_new_datasets_may_change_their_licence(spark):
    new = (*_OLD[:7], "CC_BY", *_OLD[8:])
    rows = changes.snapshot_changes(spark.createDataFrame([_OLD], _DATASET), spark.createDataFrame([new], _DATASET))
    for moment, changed in (("2020-01-01 00:02:59", False), ("2020-01-01 00:03:00", True)):
        assert rows.select(changes.license_changed("old", "new", F.lit(moment).cast("timestamp"))).first()[0] is changed


def test_actions(spark):
    old = spark.createDataFrame([_OLD, ("gone", *_OLD[1:]), ("feed", *_OLD[1:9], ["FEED"])], _DATASET)
    new = spark.createDataFrame([("d", "o2", *_OLD[2:]), ("born", *_OLD[1:]), ("feed", "o2", *_OLD[2:9], ["FEED"])], _DATASET)
    rows = changes.snapshot_changes(old, new)
    at = F.lit("2020-01-02").cast("timestamp")
    assert dict(rows_of(rows, "key", changes.dataset_actions(at))) == {"d": ["CRAWL", "METADATA"], "gone": ["DELETE"], "born": ["CRAWL"], "feed": []}


def test_organisations(spark):
    schema = "key string, country string, title string, endorsed boolean"
    old = spark.createDataFrame([("1", "DK", "t", True), ("2", "DK", "t", False), ("3", "DK", "t", True), ("4", "DK", "t", False)], schema)
    new = spark.createDataFrame([("1", "NO", "t", True), ("2", "DK", "t", True), ("3", "DK", "t", True), ("4", "NO", "x", False)], schema)
    rows = changes.snapshot_changes(old, new)
    assert dict(rows_of(rows, "key", changes.organisation_action())) == {"1": "METADATA+LOCATION", "2": "CRAWL", "3": None, "4": None}


def _passed(times, seconds):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= seconds:
            out.append(t)
            last = t
    return out


def test_stream_passes_once_per_window_and_survives_a_restart(spark):
    folder, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    base = 1_700_000_000
    batches = [[("a", 0), ("a", 3), ("b", 1), ("a", 4)], [("a", 5), ("a", 9), ("b", 7), ("b", 8)], [("a", 10), ("a", 30), ("a", 31), ("c", 31)]]
    kept = None
    for batch in batches:
        rows = spark.createDataFrame([(k, base + s) for k, s in batch], "k string, s bigint").select("k", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k string, ts timestamp").parquet(folder)
        kept = changes.first_per_window(stream, "k", "ts", 5)
        changes.run_to_table(kept, path, state)  # every batch is a run of its own: a restart
    got = spark.read.schema(kept.schema).parquet(f"{path}/batch=*").select("k", F.unix_seconds("ts").alias("s")).collect()
    want = []
    for key in "abc":
        want += [(key, s) for s in _passed([s for batch in batches for k, s in batch if k == key], 5)]
    assert sorted((r.k, r.s - base) for r in got) == want


def test_lines_meet_the_orders_where_they_are_spread(spark, tmp_path):
    """A table's own tables are joined to it first: the lines move by the order's key once, repeated orders stay."""
    from sightings.sources.driver import sighting

    tables = {
        "lineitem": ([(k, k % 4, k % 3, k % 7) for k in range(40)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "orders": ([(k, k % 5) for k in range(30)] + [(3, 1), (None, 2)], "o_orderkey long, o_custkey long"),
        "customer": ([(k, k % 2) for k in range(4)] + [(1, 0)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "A"), (1, "B")], "n_nationkey int, n_name string"),
        "part": ([(k, f"brand{k}") for k in range(4)], "p_partkey long, p_brand string"),
        "supplier": ([(k, k % 2) for k in range(2)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ("family", "countrycode", "publishingcountry", "taxonkey")
    nations = dict(tables["nation"][0])
    wanted = [
        (f"brand{p}", nations[cn], nations[sn], str(p))
        for o, p, s, _ in tables["lineitem"][0] for ok, c in tables["orders"][0] if ok == o
        for ck, cn in tables["customer"][0] if ck == c for sk, sn in tables["supplier"][0] if sk == s]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sighting(spark, str(tmp_path), *names)
        assert sorted(map(tuple, rows.collect())) == sorted(wanted)
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(o_custkey" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
