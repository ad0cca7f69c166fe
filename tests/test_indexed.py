"""Stored forms against their plain definitions: intervals, curve order, postings, dictionary, kept-up cube, versions."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightings.operators import cubes, curve, geo, postings
from sightings.operators import tree_intervals as trees
from sightings.operators.curve import ClusteredTable
from sightings.operators.dictionary import TermDictionary
from sightings.operators.maintained_cube import MaintainedCube
from sightings.operators.postings import PostingsIndex
from sightings.operators.shapes import parse_wkt
from sightings.operators.text_search import field_terms, suggest
from sightings.session import scratch_path
from sightings.sources import tables
from sightings.sources.versions import VersionConflict, VersionLog
from sightings.streaming import changes, versions


def _plan(df) -> str:
    """The plan with whole lists of filters, without the numbers of columns."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return re.sub(r"#\d+L?", "", df._jdf.queryExecution().toString())
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


# ---- intervals ---------------------------------------------------------------------------------------


def _numbered(parents):
    """Pre-order places of a forest, children by id, by walking it."""
    children, out, stack = {}, {}, []
    for node, parent in parents.items():
        children.setdefault(parent if parent in parents else None, []).append(node)

    def size(node):
        return 1 + sum(size(c) for c in children.get(node, []))

    def walk(node, first, depth):
        out[node] = (first, first + size(node) - 1, depth)
        first += 1
        for child in sorted(children.get(node, [])):
            walk(child, first, depth + 1)
            first += size(child)

    first = 1
    for root in sorted(children.get(None, [])):
        walk(root, first, 1)
        first += size(root)
    return out


def _tree(spark, parents):
    return spark.createDataFrame(list(parents.items()), "nodeid string, parentid string")


def test_tree_numbers_and_moved_subtree(spark):
    rng = random.Random(1)
    parents = {f"n{k:03d}": f"n{rng.randrange(k):03d}" if k and rng.random() < 0.97 else None for k in range(150)}
    parents["n149"] = "missing"
    for k in range(20):  # a chain, which doubling follows in few rounds
        parents[f"z{k:02d}"] = f"z{k - 1:02d}" if k else "n000"
    tree = trees.numbered_tree(_tree(spark, parents)).cache()
    wanted = _numbered(parents)
    assert {r.nodeid: (r.first, r.last, r.depth) for r in tree.toDF("nodeid", "parentid", "depth", "first", "last").collect()} == wanted
    with pytest.raises(ValueError):
        trees.numbered_tree(_tree(spark, {"a": "b", "b": "a", "c": None}))
    for node, parent in (("n001", "n000"), ("z05", "n003"), ("n003", "z19"), ("z03", "z00")):
        if wanted[parent][0] in range(wanted[node][0], wanted[node][1] + 1):
            with pytest.raises(ValueError):
                trees.move_subtree(tree, node, parent)
            continue
        moved, renumber = trees.move_subtree(tree, node, parent)
        rows = {r["nodeid"]: r for r in moved.collect()}
        places = sorted(r["first"] for r in rows.values())
        assert places == list(range(1, len(parents) + 1))
        new_parents = {**parents, node: parent}

        def is_below(x, top, new_parents=new_parents):
            while x in new_parents:
                if x == top:
                    return True
                x = new_parents[x]
            return False

        for top in rng.sample(sorted(parents), 25) + [node, parent]:
            inside = {x for x, r in rows.items() if rows[top]["first"] <= r["first"] <= rows[top]["last"]}
            assert inside == {x for x in parents if is_below(x, top)}
        again = tree.select("nodeid", renumber(F.col("first")).alias("place")).collect()
        assert all(rows[r.nodeid]["first"] == r.place for r in again)
        assert rows[node]["depth"] == rows[parent]["depth"] + 1 and rows[node]["parentid"] == parent


def test_intervals_reach_the_scan(spark, monkeypatch):
    parents = {"root": None, **{f"a{k}": "root" for k in range(6)}, **{f"a{k}b{j}": f"a{k}" for k in range(6) for j in range(5)}}
    tree = trees.numbered_tree(_tree(spark, parents)).cache()
    place = {r.nodeid: r["first"] for r in tree.collect()}
    rng = random.Random(2)
    rows = [(i, rng.choice([*parents, None])) for i in range(400)]
    path = scratch_path(spark, "placed")
    spark.createDataFrame([(i, place.get(n)) for i, n in rows], "id int, at bigint").write.parquet(path)
    stored = spark.read.parquet(path)
    wanted = {i for i, n in rows if n and (n[:2] in ("a2", "a4") or n == "a0b3")}
    chosen = F.col("nodeid").isin("a2", "a4", "a0b3", "a4b1")
    found = trees.below(stored, "at", tree, chosen)
    assert {r.id for r in found.collect()} == wanted
    assert re.search(r"PushedFilters: \[[^\n]*GreaterThanOrEqual\(at,", _plan(found))
    counts = {r.nodeid: r["count"] for r in trees.counts_above(stored, "at", tree, F.lit(True)).collect()}
    assert counts == Counter(x for _, n in rows if n for x in {n, "root", n if n == "root" else n[:2]})
    monkeypatch.setattr(trees, "RANGES", 1)  # too many ranges: a semi join
    assert {r.id for r in trees.below(stored, "at", tree, chosen).collect()} == wanted
    assert trees.below(stored, "at", tree, F.lit(False)).count() == 0


# ---- curve order -----------------------------------------------------------------------------------------


def test_curve_numbers_of_any_order_without_lambdas(spark):
    points = [(-90 + 180 * (y + 0.5) / 32, -180 + 360 * (x + 0.5) / 32) for x in range(32) for y in range(32)] + [(-1e300, 0.0), (None, 0.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for order in (1, 4, 5):
        number = curve.curve_number(F.col("lat"), F.col("lon"), order)
        assert "lambda" not in str(number)
        found = [r.d for r in df.select(number.alias("d")).collect()]
        assert found == [curve.cell_number(order, x >> 5 - order, y >> 5 - order) for x in range(32) for y in range(32)] + [None, None]


def test_curve_is_one_path_of_neighbours(spark):
    for level in (1, 2, 4):
        cells = {curve.cell_number(level, x, y): (x, y) for x in range(1 << level) for y in range(1 << level)}
        assert sorted(cells) == list(range(4**level))
        assert all(abs(cells[d][0] - cells[d + 1][0]) + abs(cells[d][1] - cells[d + 1][1]) == 1 for d in range(4**level - 1))
        for d, (x, y) in cells.items():
            assert curve.cell_number(level + 1, 2 * x, 2 * y) >> 2 == d
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (None, 1.0), (91.0, 0.0)]
    rows = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", curve.curve_number(F.col("lat"), F.col("lon")).alias("d")).collect()
    many = 1 << curve.ORDER
    for r in rows:
        if r.lat is None or abs(r.lat) > 90:
            assert r.d is None
        else:
            x, y = (min(many - 1, math.floor(v * many)) for v in ((r.lon + 180) / 360, (r.lat + 90) / 180))
            assert r.d == curve.cell_number(curve.ORDER, x, y)


SHAPES = [
    "POLYGON ((10 10, 30 12, 25 30, 12 28, 10 10))",
    "POLYGON ((0 0, 40 0, 40 40, 0 40, 0 0), (5 5, 35 5, 35 35, 5 35, 5 5))",
    "POLYGON ((170 -10, -170 -12, -165 10, 175 12, 170 -10))",
    "MULTIPOLYGON (((0 0, 5 0, 5 5, 0 0)), ((-100 -50, -90 -50, -95 -40, -100 -50)))",
    "POLYGON ((-120 -30, -120 30, 100 30, 100 -30, -120 -30))",
    "POINT (12 20)", "LINESTRING (0 0, 20 20, 40 20)",
]


def test_clustered_table_reads_the_files_of_a_shape(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(4000)] + [(5000 + k, 20.0, 12.0) for k in range(1500)] + [(9000, None, None), (9001, 10.0, 10.0)]
    df = spark.createDataFrame(points, "id int, decimallatitude double, decimallongitude double")
    stored = ClusteredTable.write(df, scratch_path(spark, "clustered"), files=40, spread="id")
    sizes = [r.n for r in stored.files().collect()]
    assert sum(sizes) == len(points) and max(sizes) < 1000  # rows of one place are cut
    lat, lon = F.col("decimallatitude"), F.col("decimallongitude")
    for wkt in SHAPES:
        ranges = curve.shape_ranges(parse_wkt(wkt))
        assert len(ranges) <= curve.RANGES
        found = stored.within(wkt)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in df.where(geo.within(wkt, lat, lon)).collect()), wkt
    small = stored.near(curve.shape_ranges(parse_wkt(SHAPES[0])))
    assert len(small.inputFiles()) < len(sizes) / 3 and "GreaterThanOrEqual(placekey" in _plan(small)
    for box in ((170.0, 10.0, -100.0, 50.0), (5.0, -20.0, 15.0, 25.0), (12.0, 20.0, 12.0, 20.0)):
        assert sorted(r.id for r in stored.box(*box).collect()) == sorted(r.id for r in df.where(geo.bounding_box(lat, lon, *box)).collect())
    assert stored.near([]).count() == 0


# ---- postings ------------------------------------------------------------------------------------------------


def _bm25(texts, words):
    lists = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts}
    mean = sum(map(len, lists.values())) / len(lists)
    out = Counter()
    for w in words:
        df = sum(w in x for x in lists.values())
        for i, x in lists.items():
            if tf := x.count(w):
                out[str(i)] += math.log(1 + (len(lists) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    return out


def test_postings_rank_like_bm25(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.choice([3, 8, 40, 200])))) for i in range(600)]
    texts += [(1000, None), (1001, ""), (1002, "Rare, W59 rare!")] + [(2000 + k, texts[3][1]) for k in range(5)]
    df = spark.createDataFrame(texts, "doc int, text string")
    path = scratch_path(spark, "postings")
    index = PostingsIndex(spark, path, buckets=8, block=16)
    for part in (df.where("doc % 3 = 0"), df.where("doc % 3 <> 0")):
        index.add(part, "doc", F.col("text"))
    index = PostingsIndex(spark, path, buckets=99)  # opened again, it keeps its measures
    assert (index.buckets, index.block) == (8, 16)
    for query, k in (("w0", 5), ("W59 rare", 3), ("w3 w7 w50", 12), ("w0 w1 w2", 1000), ("w58", 10)):
        scores = _bm25(texts, [w.lower() for w in query.split()])
        wanted = sorted(scores.items(), key=lambda x: (-round(x[1], postings.DIGITS), x[0]))[:k]
        got = [(r.docid, r.score) for r in index.search(query, k).collect()]
        assert [g[0] for g in got] == [w[0] for w in wanted] and all(abs(g[1] - w[1]) < 1e-8 for g, w in zip(got, wanted)), query
    assert index.search("nothing here") .count() == 0 and index.search(" ,").count() == 0
    read = index._read("postings", postings._POSTINGS, ["w3"])
    assert re.search(r"PartitionFilters: \[[^\]]*\(bucket = ", _plan(read)) and "EqualTo(term,w3)" in _plan(read)
    assert PostingsIndex(spark, scratch_path(spark, "empty")).search("a").count() == 0


def test_postings_move_as_lists(spark):
    """A term of a block is a few rows, whatever its documents, and an index of few files is made by all cores."""
    texts = [(i, f"Common common only{i % 10} \u0130stanbul") for i in range(200)] + [(900, None), (901, " ,")]
    index = PostingsIndex(spark, scratch_path(spark, "postings"), buckets=4, block=64)
    index.add(spark.createDataFrame(texts, "doc int, text string").coalesce(1), "doc", F.col("text"))
    rows = index._read("postings", postings._POSTINGS, ["common"]).collect()
    assert len(rows) < 200 and sum(r.df for r in rows) == sum(len(r.numbers) for r in rows) == 200
    assert {x for r in rows for x in r.tfs} == {2} and all(r.numbers == sorted(r.numbers) for r in rows)
    assert {(n - 1) // 64 == r.block for r in rows for n in r.numbers} == {True}
    bounds = index._read("bounds", postings._BOUNDS, ["only3"]).collect()
    assert sum(b.df for b in bounds) == 20 and {(b.tf, b.least_length) for b in bounds} == {(1, 5)}  # a lower-case dotted I is two words here
    assert postings._spread(spark.createDataFrame(texts, "doc int, text string").coalesce(1)).rdd.getNumPartitions() > 1


# ---- dictionary -------------------------------------------------------------------------------------------------


def test_dictionary_equals_the_table(spark):
    rng = random.Random(6)
    words = ["Plot", "17", "plots", "North", "north shore", "17b", "Plot 17", "Éire", "x-17"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3))) if rng.random() < 0.95 else None, [rng.choice(words), rng.choice(words)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, locality string, recordedby array<string>")
    path = scratch_path(spark, "terms")
    terms = TermDictionary(spark, path)
    terms.apply("a", ["LOCALITY", "RECORDED_BY"], new=df.where("id < 150"))
    terms.apply("b", ["LOCALITY", "RECORDED_BY"], new=df.where("id >= 100"))
    assert terms.apply("c", ["LOCALITY", "RECORDED_BY"], old=df.where("id >= 100 AND id < 150"))
    assert not terms.apply("c", ["LOCALITY", "RECORDED_BY"], old=df)  # a repeated batch changes nothing
    for turn in range(2):
        for query in ("17", "plot", "plot 17", "north", "nothing", "É", "x-17"):
            assert terms.field_terms("LOCALITY", query).collect() == field_terms(df, "LOCALITY", query).select("term", "count").collect(), query
            for parameter in ("LOCALITY", "RECORDED_BY"):
                assert terms.suggest(parameter, query, 5).collect() == suggest(df, parameter, query, 5).collect()
        if turn == 0:
            terms.compact()
            terms = TermDictionary(spark, path)
    plan = _plan(terms.suggest("LOCALITY", "plot"))
    assert "StringStartsWith(entry" in plan and "PartitionFilters" in plan
    with pytest.raises(ValueError):
        terms.field_terms("RECORDED_BY", "x")


# ---- kept-up cube --------------------------------------------------------------------------------------------------


def test_cube_after_random_changes_equals_a_rebuild(spark):
    rng = random.Random(7)
    dimensions = ["basis", "country", "year"]
    schema = "id int, basis string, country string, year int"

    def record(i):
        return (i, rng.choice("AB"), rng.choice(["DK", "SE", None]), rng.choice([1998, 1999, None]))

    path = scratch_path(spark, "cube")
    cube, rows = MaintainedCube(spark, path, dimensions), {}
    with pytest.raises(LookupError):
        cube.cells()
    for batch in range(6):
        gone = rng.sample(sorted(rows), min(len(rows), 6))
        old, new = [rows.pop(i) for i in gone], [record(i) for i in gone[:3]] + [record(100 * batch + k) for k in range(20)]
        rows |= {r[0]: r for r in new}
        frames = {"old": spark.createDataFrame(old, schema), "new": spark.createDataFrame(new, schema)}
        assert cube.apply(f"batch-{batch}", **frames)
        assert not cube.apply(f"batch-{batch}", **frames)
        if batch == 3:
            cube.compact()
            cube = MaintainedCube(spark, path, dimensions)
        df = spark.createDataFrame(list(rows.values()), schema)
        wanted = cubes.cube_table(df, dimensions).select("grouping", *dimensions, "count")
        key = lambda r: str(tuple(r))
        assert sorted(map(tuple, cube.cells().select("grouping", *dimensions, "count").collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str), key
    assert cube.count({"country": "DK", "year": 1999}).first()["count"] == sum(r[2] == "DK" and r[3] == 1999 for r in rows.values())
    assert cube.count({}).first()["count"] == len(rows)
    assert {r.year: r["count"] for r in cube.counts({"basis": "A"}, ["year"]).collect()} == Counter(r[3] for r in rows.values() if r[1] == "A")
    assert "PartitionFilters: [isnotnull(grouping), (grouping = 1)]" in _plan(cube.counts({"basis": "A", "country": "DK"}, []))
    with pytest.raises(ValueError):
        cube.count({"month": 1})


# ---- versions --------------------------------------------------------------------------------------------------------


def test_a_failed_publication_leaves_a_whole_version(spark, monkeypatch):
    folder = scratch_path(spark, "published")
    table = tables.PublishedTable(spark, "things", folder)
    with pytest.raises(LookupError):
        table.read()
    first = table.publish(spark.range(5).toDF("x"), None)
    pinned = table.read()
    monkeypatch.setattr(VersionLog, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.publish(spark.range(9).toDF("x"), first)
    monkeypatch.undo()
    again = tables.PublishedTable(spark, "things", folder)
    assert again.version == first and again.read().count() == 5
    second = again.publish(spark.range(7).toDF("y"), first)
    assert again.read().columns == ["y"] and again.read(first).count() == pinned.count() == 5
    with pytest.raises(VersionConflict):  # a writer who saw the first version only
        table.publish(spark.range(3).toDF("x"), first)
    assert again.version == second and again.read().count() == 7


def test_a_torn_entry_is_no_version(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))
    assert log.current() is None and log.commit({"a": 1}, None).number == 0
    (tmp_path / "log" / "000000000001.json").write_text('{"a": ')
    assert log.current().number == 0 and log.commit({"a": 2}, 0).number == 2 and log.current().entry == {"a": 2}
    with pytest.raises(VersionConflict):
        log.commit({"a": 3}, 0)
    assert json.loads((tmp_path / "log" / "000000000002.json").read_text()) == {"a": 2}


def test_versions_of_one_shard(spark):
    """Many objects of a shard are served by one call: more messages than shards, repeated and late ones among them."""
    rows = [("dataset", f"k{i}", at, f"v{at}" if at < 30 or i % 2 else None) for i in range(50) for at in (10, 20, 30)]
    rows += rows[:7] + [("other", None, 10, "x"), ("end", "end", 9_000, "e")]
    seconds = [(kind, key, at * 1_000_000, (value,) if value else None) for kind, key, at, value in rows]
    schema = "objecttype string, key string, at bigint, object struct<v: string>"
    messages, folder = spark.createDataFrame(seconds, schema), scratch_path(spark, "shard-messages")
    messages.where("at % 20000000 = 0").coalesce(1).write.mode("append").parquet(folder)
    messages.where("at % 20000000 <> 0").coalesce(1).write.mode("append").parquet(folder)
    ends = [("end", "end", at * 1_000_000, None) for at in (20_000, 20_001)]
    for end in ends:  # these only move the watermark
        spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = scratch_path(spark, "shard-changes")
    found = versions.object_changes(stream, "1 hour", shards=3)
    changes.run_to_table(found, path, scratch_path(spark, "shard-state"))
    got = spark.read.schema(found.schema).parquet(f"{path}/batch=*").where("objecttype <> 'end'")
    wanted = versions.batch_changes(messages).where("objecttype <> 'end'")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and got.count() == 151
