"""Operations on groups, with one key holding most rows, against plain Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sightings.operators import agents, cubes, events, facets, hot, media, paging, relations
from sightings.operators.predicates import Filters


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of 3000 rows share one key."""
    return spark.range(3000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("recordid"),
                                    F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"))


def digest(s):
    return hashlib.md5(s.encode()).hexdigest()


@pytest.mark.parametrize("hot_rows", [0, 500, 10_000])
def test_numbered_equals_a_plain_ranking(skewed, hot_rows):
    got = {(r.k, r.recordid): (r.place, r.total) for r in hot.numbered(skewed, ["k"], "recordid", hot_rows=hot_rows).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append(r.recordid)
    want = {}
    for k, members in groups.items():
        for place, member in enumerate(sorted(members, key=lambda s: (digest(s), s)), 1):
            want[(k, member)] = (place, len(members))
    assert got == want


def test_places_do_not_depend_on_the_buckets(skewed):
    few, many = (hot.numbered(skewed, ["k"], "recordid", digits=d, hot_rows=100).select("recordid", "place", "total") for d in (1, 3))
    assert few.exceptAll(many).count() == 0


def test_null_keys_are_a_group(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("recordid"), F.when(F.col("id") % 2 == 0, "k").alias("k"))
    for hot_rows in (0, 100):
        rows = hot.numbered(df, ["k"], "recordid", hot_rows=hot_rows).collect()
        assert sorted(r.place for r in rows if r.k is None) == list(range(1, 26)) and {r.total for r in rows} == {25}


def test_no_window_over_a_whole_group(skewed):
    """The only window by the key alone runs over bucket counts."""
    plan = hot.numbered(skewed, ["k"], "recordid", hot_rows=500)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [row_number" in line:
            assert "_bucket" in line


def test_id_sets_are_whole_and_bounded(skewed):
    rows = skewed.select("recordid", F.col("k").alias("v_recordedby"), F.when(F.col("k") == "k1", F.col("k")).alias("v_identifiedby"))
    parts = agents.agents(rows, max_ids=100).collect()
    hot_parts = [p for p in parts if p.agent == "hot"]
    assert len(hot_parts) == 20 and max(len(p.idsrecordedby) for p in hot_parts) < 150 and {p.part for p in hot_parts} == set(range(20))
    found = sorted(i for p in hot_parts for i in p.idsrecordedby)
    assert found == sorted(r.recordid for r in skewed.filter("k = 'hot'").collect())
    assert sum(p.totalrecordedby for p in hot_parts) == 2000
    whole = {p.agent: p for p in agents.agents(rows, max_ids=10_000).collect()}
    assert whole["hot"].part == 0 and len(whole["hot"].idsrecordedby) == 2000 and whole["hot"].idsidentifiedby == []
    assert whole["k1"].totalidentifiedby == whole["k1"].totalrecordedby


def test_id_sets_are_one_row_per_person_whatever_their_size(spark):
    """A person with a quarter of a million records, some of them named twice, and one with few."""
    n = 250_000
    rows = spark.range(n).select(
        F.concat(F.lit("r"), F.col("id") % (n - 10)).alias("recordid"), F.when(F.col("id") < 3, "few").otherwise("many").alias("v_recordedbyid"),
        F.when(F.col("id") % 2 == 0, "many").alias("v_identifiedbyid"))
    found = {r.identifier: r for r in agents.identifiers(rows).withColumns({
        "recorded": F.size("idsrecordedbyid"), "identified": F.size("idsidentifiedbyid"),
        "distinct": F.size(F.array_distinct("idsrecordedbyid"))}).drop("idsrecordedbyid", "idsidentifiedbyid").collect()}
    assert agents.identifiers(rows).count() == 2 and set(found) == {"few", "many"} and {r.part for r in found.values()} == {0}
    assert (found["many"].totalrecordedbyid, found["many"].totalidentifiedbyid) == (n - 3, n // 2)
    assert (found["many"].recorded, found["many"].distinct, found["many"].identified) == (n - 10, n - 10, n // 2 - 5)
    assert (found["few"].totalrecordedbyid, found["few"].recorded, found["few"].identified) == (3, 3, 0)


def test_related_records_are_limited_on_both_sides(spark):
    edges = spark.range(500).select(F.lit("hub").alias("id1"), F.format_string("x%04d", "id").alias("id2"), F.lit("A,B").alias("reasons"))
    rows = relations.related_records(edges).collect()
    hub = sorted(r.relatedid for r in rows if r.recordid == "hub")
    assert hub == [f"x{n:04d}" for n in range(100)]
    assert len(rows) == 600 and rows[0].reasons == ["A", "B"]


def test_media_chunks_and_pages(spark):
    records = spark.range(130).select(F.col("id").cast("string").alias("recordid"),
                                          F.create_map(F.lit("cl"), F.array(F.lit("animals"), (F.col("id") % 3).cast("string"))).alias("taxonkeys"))
    items = records.select("recordid", F.lit("StillImage").alias("type"), F.concat(F.lit("u"), "recordid").alias("identifier"),
                               *[F.lit(None).cast("string").alias(c) for c in ("title", "license", "created", "creator")])
    index = media.media_index(records, items, 50).cache()
    sizes = sorted((r.chunk, len(r["items"]), r.total) for r in index.filter("taxonkey = 'animals'").collect())
    assert sizes == [(0, 50, 130), (1, 50, 130), (2, 30, 130)]
    order = [str(n) for n in sorted(range(130), key=lambda n: digest(f"{n}|u{n}"))]
    page = media.media_page(index, "cl", "animals", "STILLIMAGE", limit=30, offset=40, chunk_size=50).orderBy("position").collect()
    assert [r.recordid for r in page] == order[40:70]
    assert media.media_page(index, "cl", "animals", "stillimage", limit=500, offset=0, chunk_size=50).count() == media.MAX_PAGE


def test_media_chunks_of_hot_taxa_do_not_depend_on_buckets(spark):
    keys = F.array(F.lit("animals"), F.when(F.col("id") % 2 == 0, "even"), (F.col("id") % 7).cast("string"))
    records = spark.range(600).select(F.col("id").cast("string").alias("recordid"),
                                      F.create_map(F.lit("a"), keys, F.lit("b"), F.array(F.lit("animals"))).alias("taxonkeys"))
    items = records.select("recordid", F.when(F.col("recordid") < "3", "Sound").otherwise("StillImage").alias("type"),
                           F.when(F.col("recordid") != "77", F.concat(F.lit("u"), "recordid")).alias("identifier"),
                           *[F.lit(None).cast("string").alias(c) for c in ("title", "license", "created", "creator")])

    def rows(**limits):
        found = media.media_index(records, items, 7, **limits).collect()
        return sorted((r.checklistkey, str(r.taxonkey), r.mediatype, r.chunk, r.total, [i.recordid for i in r["items"]]) for r in found)

    whole = rows()
    assert sum(len(r[-1]) for r in whole) == 600 * 4
    assert rows(hot_rows=60, task_rows=100) == whole
    assert rows(hot_rows=10, task_rows=3) == whole


def test_media_index_of_one_key_joins_and_counts_that_key_only(spark, monkeypatch):
    keys = F.array(F.lit("animals"), F.when(F.col("id") % 2 == 0, "even"), (F.col("id") % 7).cast("string"), F.lit("animals"))
    taxa = F.when(F.col("id") % 50 != 0, F.create_map(F.lit("a"), keys, F.lit("b"), F.when(F.col("id") % 3 == 0, F.array(F.lit("animals")))))
    rows = spark.range(400).union(spark.range(90, 120))  # some records stand twice
    records = rows.select(F.col("id").cast("string").alias("recordid"), taxa.alias("taxonkeys"))
    items = rows.select(F.col("id").cast("string").alias("recordid"), F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 4 == 0, "Sound").otherwise("StillImage")).alias("type"),
                        F.when(F.col("id") != 77, F.concat(F.lit("u"), (F.col("id") % 90).cast("string"))).alias("identifier"),
                        *[F.lit(None).cast("string").alias(c) for c in ("title", "license", "created", "creator")])
    sizes = []

    def noted(df, label, *rest):
        out = staged(df, label, *rest)
        sizes.extend([out.count()] if label == "media" else [])
        return out

    staged = media.staged
    monkeypatch.setattr(media, "staged", noted)

    def found(index):
        return sorted((*r[:5], [(i.recordid, str(i.identifier)) for i in r["items"]]) for r in index.select(*media.KEYS, "chunk", "total", "items").collect())

    for key in (("a", "animals", "StillImage"), ("a", "even", "SOUND"), ("b", "animals", "stillimage"), ("b", "even", "Sound"), ("c", "animals", "Sound")):
        of_key = (F.col("checklistkey") == key[0]) & (F.col("taxonkey") == key[1]) & (F.col("mediatype") == key[2].lower())
        wanted = found(media.media_index(records, items, 7).where(of_key))
        for limits in ({}, {"hot_rows": 20, "task_rows": 10}):
            assert found(media.media_index(records, items, 7, only=key, **limits)) == wanted
            assert sizes.pop() == sum(len(r[-1]) for r in wanted)


def test_media_page_brings_only_its_taxon_together(spark, monkeypatch):
    from conftest import SF_DIR
    from sightings.catalog import QUERIES

    staged, seen = media.staged, []
    monkeypatch.setattr(media, "staged", lambda df, label, *rest: seen.append((label, out := staged(df, label, *rest))) or out)
    page = QUERIES["AGG34"](spark, SF_DIR)
    assert {key for label, df in seen if label == "media" for r in df.collect() for keys in r.taxonkeys.values() for key in keys} <= {"PROMO"}
    assert page.columns == ["position", "total", "recordid", "identifier"]


def walk(parent, start, depth):
    seen, out, at = {start}, [], start
    while parent.get(at) is not None and parent[at] in parent and len(out) < depth:
        at = parent[at]
        if at in seen:
            break
        seen.add(at)
        out.append((start, at, len(out) + 1))
    return out


@pytest.mark.parametrize("depth", [300, 5, 1])
def test_lineage_with_cycles_and_unknown_parents(spark, depth):
    parent = {"a": None, "b": "a", "c": "b", "x": "y", "y": "z", "z": "x", "t": "x", "self": "self", "lost": "nowhere"}
    chain = {f"n{i}": (f"n{i - 1}" if i else "c") for i in range(40)}
    parent.update(chain)
    rows = spark.createDataFrame([("d", k, v) for k, v in parent.items()], "datasetkey string, eventid string, parenteventid string")
    got = {(r.eventid, r.ancestorid, r.distance) for r in events.lineage(rows, depth).collect()}
    want = {step for e in parent for step in walk(parent, e, depth)}
    assert got == want


def test_lineage_keeps_datasets_apart(spark):
    rows = spark.createDataFrame([("d1", "a", None), ("d1", "b", "a"), ("d2", "b", "a")], "datasetkey string, eventid string, parenteventid string")
    assert [tuple(r) for r in events.lineage(rows).collect()] == [("d1", "b", "a", 1)]


def test_facets_page_and_limits(spark):
    df = spark.createDataFrame([(["a", "a", "b"], 1), (["b"], 2), (None, 2), ([], 3)], "recordedby array<string>, year int")
    assert [tuple(r) for r in facets.facet(df, "RECORDED_BY").collect()] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in facets.facet(df, "YEAR", limit=1, offset=1).collect()] == [("1", 1)]
    assert facets.page_size(10, 5, 100) == 10
    with pytest.raises(ValueError):
        facets.page_size(None, 1_200_000, 1)


def test_facets_of_records_without_an_array(spark):
    df = spark.createDataFrame([(None, 2000), (["a"], 2000), ([], 2001)], "recordedby array<string>, year int")
    counts = facets.multi_select(df, ["YEAR", "RECORDED_BY"], {}, Filters()).collect()
    assert {(r.facet, r.term): r["count"] for r in counts} == {("YEAR", "2000"): 2, ("YEAR", "2001"): 1, ("RECORDED_BY", "a"): 1}


def test_multi_select_with_deep_pages(spark):
    df = spark.range(5000).select((F.col("id") % 2500).cast("string").alias("datasetkey"), (F.col("id") % 3 + 1990).cast("int").alias("year"))
    near = facets.multi_select(df, ["YEAR"], {"YEAR": ["1990"], "DATASET_KEY": ["1", "2"]}, Filters(), limit=10)
    deep = facets.multi_select(df, ["DATASET_KEY"], {"YEAR": ["1990"]}, Filters(), limit=1500, offset=10)
    assert sum(r["count"] for r in near.collect()) == 4
    assert deep.count() == 1500
    assert facets.post_filtered_hits(df, {"YEAR": ["1990"], "DATASET_KEY": ["1", "2"]}).count() == sum(
        1 for i in range(5000) if i % 3 == 0 and i % 2500 in (1, 2))


def test_cube_addresses(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "d1 string, d2 string")
    cube = cubes.cube_table(df, ["d1", "d2"])
    assert cubes.address_count(cube, ["d1", "d2"], {"d1": "a"}).first()["count"] == 2
    assert cubes.address_count(cube, ["d1", "d2"], {}).first()["count"] == 3
    assert cubes.address_count(cube, ["d1", "d2"], {"d1": "zz"}).first()["count"] == 0
    with pytest.raises(ValueError):
        cubes.address_count(cube, ["d1", "d2"], {"d3": "a"})


def test_pages_and_shuffles(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("recordid"), F.lit(2000).alias("year"), F.lit(None).cast("int").alias("month"))
    one = [r.recordid for r in paging.page(df, paging.shuffled_order("s"), 10, 20).collect()]
    again = [r.recordid for r in paging.page(df.repartition(5), paging.shuffled_order("s"), 10, 20).collect()]
    other = [r.recordid for r in paging.page(df, paging.shuffled_order("t"), 10, 20).collect()]
    assert one == again != other
    assert paging.page(df, paging.default_order(), 0, 5000).count() == paging.MAX_PAGE
    with pytest.raises(ValueError):
        paging.page(df, paging.default_order(), paging.MAX_RESULT_WINDOW, 1)


def test_export_slices_of_many_rows_are_cut_again(spark):
    df = spark.range(2000).select(F.format_string("%05d", "id").alias("recordid"))
    rows = paging.export_slices(df, 4, slice_rows=100).select("recordid", F.spark_partition_id().alias("p")).collect()
    sizes = [sum(r.p == p for r in rows) for p in {r.p for r in rows}]
    assert len(sizes) >= 15 and max(sizes) < 250
    assert [r.recordid for r in sorted(rows, key=lambda r: r.p)] == [f"{n:05d}" for n in reversed(range(2000))]


def test_a_single_file_is_spread_by_its_rows(spark, monkeypatch):
    from conftest import SF_DIR
    from sightings.sources import driver

    monkeypatch.setattr(driver, "TASK_ROWS", 500, raising=False)
    spread = driver.sighting(spark, SF_DIR, "recordid").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > spark.sparkContext.defaultParallelism and max(r["count"] for r in spread) < 1500


def test_export_slices_are_ranges(spark):
    df = spark.range(1000).select(F.format_string("%05d", "id").alias("recordid"))
    sliced = paging.export_slices(df, 4).select("recordid", F.spark_partition_id().alias("p")).collect()
    assert [r.recordid for r in sliced] == sorted((r.recordid for r in sliced), reverse=True)
