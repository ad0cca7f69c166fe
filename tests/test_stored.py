"""Pages, pyramids, shared buckets and version streams against their plain definitions."""

from __future__ import annotations

import random

import pytest

from sightings.operators.colocated import BucketedTables
from sightings.operators.cursors import SortedCopy, default_key, page_after
from sightings.operators.heatmap import heatmap
from sightings.operators.paging import default_order
from sightings.operators.pyramid import Pyramid
from sightings.session import scratch_path
from sightings.streaming import changes, versions


def _records(spark, n=900):
    rng = random.Random(1)
    rows = [(f"r{i:04d}", rng.choice([1998, 1999, 2000, None]), rng.choice([1, 2, None])) for i in range(n)]
    return spark.createDataFrame(rows, "recordid string, year int, month int")


def test_pages_of_a_copy_are_the_whole_order(spark):
    df = _records(spark)
    wanted = [r.recordid for r in df.orderBy(*default_order()).collect()]
    copy = SortedCopy.write(df, scratch_path(spark, "sorted"), default_key())
    assert copy.total() == len(wanted)
    assert [r.recordid for k in range(0, 900, 130) for r in copy.page(k, 130).collect()] == wanted
    assert copy.page(850, 500).count() == 50 and copy.page(5000, 10).count() == 0
    assert [r.recordid for part in copy.slices(7) for r in part.collect()] == wanted
    assert len(copy.page(890, 5).inputFiles()) <= 2 < len(copy.all().inputFiles())
    with pytest.raises(ValueError):
        copy.page(-1, 5)
    empty = SortedCopy.write(df.limit(0), scratch_path(spark, "sorted"), default_key())
    assert empty.total() == 0 and empty.page(0, 10).count() == 0


def test_cursors_go_through_ties_and_nulls(spark):
    df = _records(spark, 200).cache()
    wanted, got, cursor = [r.recordid for r in df.orderBy(*default_order()).collect()], [], None
    while True:
        page, cursor = page_after(df, default_key(), cursor, 37)
        got += [r.recordid for r in page.collect()]
        if cursor is None:
            break
    assert got == wanted


def test_pyramid_equals_direct_heatmaps(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.random() < 0.9) for _ in range(1500)] + [(rng.gauss(50, 0.5), rng.gauss(10, 0.5), True) for _ in range(800)]
    rows += [(90.0, 180.0, True), (-90.0, -180.0, True), (None, None, True), (0.0, 0.0, True), (45.0, 45.0, True)]
    df = spark.createDataFrame(rows, "decimallatitude double, decimallongitude double, hascoordinate boolean").cache()
    pyramid = Pyramid.write(df, scratch_path(spark, "pyramid"), zooms=11)

    def same(a, b):
        def rounded(frame):
            return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select(*sorted(frame.columns)).collect())

        assert rounded(a) == rounded(b)

    for zoom in (0, 2, 6, 10):
        for mode in ("GEO_BOUNDS", "GEO_CENTROID"):
            same(pyramid.heatmap(zoom, mode=mode), heatmap(df, zoom, mode=mode))
    for box in ((-100.0, -40.0, 60.0, 70.0), (170.0, -50.0, -120.0, 50.0), (9.8, 49.9, 10.1, 50.2), (0.0, 0.0, 45.0, 45.0), (10.0, 50.0, 10.0, 50.0)):
        for zoom in (0, 2, 4, 7):
            same(pyramid.heatmap(zoom, box, df), heatmap(df, zoom, box))
    with pytest.raises(ValueError):
        pyramid.heatmap(2, (0.0, 0.0, 1.0, 1.0))


def test_pyramid_rolls_up_several_lengths_by_one_shuffle(spark, monkeypatch):
    from sightings.operators import pyramid as module

    monkeypatch.setattr(module, "TASK_CELLS", 50, raising=False)
    rng = random.Random(4)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180), True) for _ in range(900)] + [(52.0, 13.0, True)] * 300
    df = spark.createDataFrame(rows, "decimallatitude double, decimallongitude double, hascoordinate boolean").cache()
    made = Pyramid.write(df, scratch_path(spark, "pyramid"))
    for zoom in (0, 4, 7, 10, 13, 15, 18):
        found = sorted((r.cell, r["count"]) for r in made.heatmap(zoom).collect())
        assert found == sorted((r.cell, r["count"]) for r in heatmap(df, zoom).collect())
    plan = made._rolled_up(10, [9, 8, 7])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_buckets_grow_with_the_rows():
    from sightings.operators.colocated import BUCKET_ROWS, buckets_for

    assert buckets_for(0) == buckets_for(8 * BUCKET_ROWS) == 8
    assert buckets_for(100 * BUCKET_ROWS) == 100


def test_bucketed_joins_move_no_side(spark):
    rng = random.Random(3)
    main = spark.createDataFrame([(f"r{i}", i % 5) for i in range(500)], "recordid string, kind int")
    extra = spark.createDataFrame([(f"r{rng.randrange(600)}", f"x{i}") for i in range(900)], "recordid string, remark string")
    folder = scratch_path(spark, "buckets")
    stored = BucketedTables(spark, folder, 4)
    stored.write("main", main, ["recordid"])
    stored.write("extra", extra.where("remark < 'x5'"), ["recordid"])
    stored.append("extra", extra.where("remark >= 'x5'"))
    wanted = sorted(map(tuple, main.where("kind = 2").join(extra, "recordid").collect()))

    def joined(tables):
        found = tables.join(tables.table("extra"), tables.table("main").where("kind = 2"), ["recordid"]).select("recordid", "kind", "remark")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(tuple, found.collect())) == wanted
        return plan

    joined(stored)
    assert len(stored.table("extra").inputFiles()) == 8
    stored.compact("extra")
    again = BucketedTables(spark, folder, 4)  # opened by another user of the folder
    joined(again)
    assert len(again.table("extra").inputFiles()) == 4
    with pytest.raises(LookupError):
        again.table("other")


def test_stream_of_versions_equals_the_batch(spark):
    """Late, repeated and deleted versions, under several cuts into micro-batches and after a restart."""
    rng, second = random.Random(4), 1_000_000
    schema = "objecttype string, key string, at bigint, object struct<title:string,n:int>"
    rows = []
    for t in range(120):
        key = f"k{rng.randrange(8)}"
        rows.append(("dataset" if rng.random() < 0.7 else "node", key, (1000 + 10 * t) * second, None if rng.random() < 0.25 else (rng.choice("abc"), t)))
    rows += [r for r in rows if rng.random() < 0.2]  # repeated
    rows = [r for _, r in sorted(((r[2] + rng.randrange(60 * second), r) for r in rows), key=lambda x: x[0])]  # up to a minute late
    wanted = sorted(map(tuple, versions.batch_changes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert {r[3] for r in wanted} == {"CREATED", "UPDATED", "DELETED"}
    end = [[("end", "end", 10**10 * (k + 1), None)] for k in range(2)]
    for cut in (7, 60):
        folder, path, state = (scratch_path(spark, x) for x in ("messages", "out", "state"))
        parts = [rows[k : k + cut] for k in range(0, len(rows), cut)]
        for turn, some in enumerate((parts[: len(parts) // 2], parts[len(parts) // 2 :] + end)):  # the second half after a restart
            for part in some:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
            changes.run_to_table(versions.object_changes(stream, "2 minutes"), path, state)
            assert turn or spark.read.parquet(f"{path}/batch=*").count() < len(wanted)
        got = spark.read.parquet(f"{path}/batch=*").where("objecttype <> 'end'").select("objecttype", "key", "at", "changetype", "oldjson", "newjson")
        assert sorted(map(tuple, got.collect()), key=str) == wanted


def test_versions_taken_in_order():
    take = versions.taken_in_order
    assert take(None, None, [(2, "b"), (1, "a"), (2, "b"), (3, None), (4, None)]) == (4, None, [(1, "CREATED", None, "a"), (2, "UPDATED", "a", "b"), (3, "DELETED", "b", None)])
    assert take(5, "x", [(5, "y"), (4, "z")]) == (5, "x", [])
