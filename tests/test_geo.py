from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightings.functions.register import points_in_shape
from sightings.operators import geo
from sightings.operators.grids import grid_cell, laea
from sightings.operators.heatmap import cell_indexes, geohash_text, heatmap
from sightings.operators.shapes import parse_wkt

SHAPES = [
    "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))",
    "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))",
    "MULTIPOLYGON (((0 0, 5 0, 5 5, 0 0)), ((-5 -5, -1 -5, -3 -1, -5 -5)))",
    "POLYGON ((170 -10, -170 -12, -165 10, 175 12, 170 -10))",
    "POLYGON ((-20 -20, -20 20, 20 20, 20 -20, -20 -20))",
    "LINESTRING (0 0, 5 5, 5 10)",
    "POINT (3 4)",
]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    free = np.column_stack([rng.integers(-30, 31, 400), rng.integers(-30, 31, 400)])
    far = np.column_stack([rng.integers(-25, 26, 200), np.where(rng.random(200) < 0.5, 1, -1) * rng.integers(160, 181, 200)])
    grid = np.array([(a, b) for a in range(-6, 12) for b in range(-6, 12)])
    both = np.vstack([free, far, grid]).astype(float)
    return spark.createDataFrame([(float(a), float(b)) for a, b in both], "lat double, lon double")


@pytest.mark.parametrize("wkt", SHAPES)
def test_columns_agree_with_the_batch_form(points, wkt):
    rows = points.select("lat", "lon", geo.within(wkt, F.col("lat"), F.col("lon")).alias("inside")).toPandas()
    expected = points_in_shape(parse_wkt(wkt), rows["lat"].to_numpy(), rows["lon"].to_numpy())
    assert rows["inside"].tolist() == expected.tolist()
    assert expected.any() and not expected.all()


def test_many_vertices(points):
    """A star of 3000 vertices, cut into bands, against the batch form."""
    import math

    angles = [2 * math.pi * n / 3000 for n in range(3000)]
    ring = [((20 + 8 * math.sin(17 * a)) * math.cos(a), (18 + 7 * math.cos(11 * a)) * math.sin(a)) for a in angles]
    wkt = "POLYGON ((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*ring, ring[0]]) + "))"
    rows = points.select("lat", "lon", geo.within(wkt, F.col("lat"), F.col("lon")).alias("inside")).toPandas()
    expected = points_in_shape(parse_wkt(wkt), rows["lat"].to_numpy(), rows["lon"].to_numpy())
    assert rows["inside"].tolist() == expected.tolist() and expected.any() and not expected.all()


def test_edges_count_and_holes_do_not(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 5.0), (5.0, 2.0), (5.0, 1.0), (None, 1.0), (91.0, 1.0)], "lat double, lon double")
    inside = [r[0] for r in df.select(geo.within(SHAPES[1], F.col("lat"), F.col("lon"))).collect()]
    assert inside == [True, False, True, True, False, False]


def test_dateline_and_clockwise_rectangles(spark):
    df = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0)], "lat double, lon double")

    def inside(wkt):
        return [r[0] for r in df.select(geo.within(wkt, F.col("lat"), F.col("lon"))).collect()]

    assert inside(SHAPES[3]) == [True, True, False]
    assert inside(SHAPES[4]) == [True, True, False]  # clockwise: the rest of the globe
    assert inside("POLYGON ((-20 -20, 20 -20, 20 20, -20 20, -20 -20))") == [False, False, True]


def test_other_shapes_are_refused():
    for wkt in ("GEOMETRYCOLLECTION (POINT (1 2))", "nonsense", "POLYGON ((0 0, 1 1, 0 0))"):
        with pytest.raises(ValueError):
            parse_wkt(wkt)


@pytest.mark.parametrize("lat,lon,close", [
    (0, 0.04, True), (0, 0.05, False), (0.04, 0, True), (0.05, 0, False)])
def test_distance_at_the_equator(spark, lat, lon, close):
    row = spark.range(1).select(geo.geo_distance(0.0, 0.0, "5km", F.lit(float(lat)), F.lit(float(lon)))).first()
    assert row[0] is close


@pytest.mark.parametrize("lat,lon,close", [
    (80, 0.04, True), (80, 0.25, True), (80, 0.26, False), (80.04, 0, True), (80.05, 0, False)])
def test_distance_in_the_north(spark, lat, lon, close):
    row = spark.range(1).select(geo.geo_distance(80.0, 0.0, "5km", F.lit(float(lat)), F.lit(float(lon)))).first()
    assert row[0] is close


def test_distance_over_the_dateline_and_pole(spark):
    row = spark.range(1).select(
        geo.geo_distance(0.0, 179.99, "5km", F.lit(0.0), F.lit(-179.99)),
        geo.geo_distance(89.99, 0.0, "5km", F.lit(89.99), F.lit(180.0)),
        geo.geo_distance(0.0, 0.0, "5km", F.lit(None).cast("double"), F.lit(0.0))).first()
    assert list(row) == [True, True, False]


def test_distance_units():
    assert geo.parse_distance("5km") == 5000 and geo.parse_distance("1mi") == pytest.approx(1609.344)
    with pytest.raises(ValueError):
        geo.parse_distance("5 parsec")


def test_projection_matches_the_published_example(spark):
    east, north = laea("lat", "lon")
    row = spark.createDataFrame([(50.0, 5.0)], "lat double, lon double").selectExpr(f"{east} AS e", f"{north} AS n").first()
    assert row.e == pytest.approx(3962799.45, abs=0.01) and row.n == pytest.approx(2999718.85, abs=0.01)


def test_cell_codes(spark):
    df = spark.createDataFrame([(38.8977, -77.0365), (60.0, 4.0), (85.0, 0.0), (None, 1.0)], "decimallatitude double, decimallongitude double")
    assert [r[0] for r in df.select(grid_cell("mgrs", 1)).collect()][0] == "18SUJ2339407395"
    assert [r[0] for r in df.select(grid_cell("mgrs", 100000)).collect()] == ["18SUJ", "32VKM", None, None]
    assert df.select(grid_cell("eqdgc", 2)).first()[0] == "W077N38BB"
    assert df.select(grid_cell("dmsg", 300)).first()[0] == "N38:50:00W077:05:00"
    with pytest.raises(ValueError):
        grid_cell("isea", 6)


def test_geohash(spark):
    x, y = cell_indexes(F.lit(57.64911), F.lit(10.40744), 9)
    df = spark.range(1).select(x.alias("x"), y.alias("y"))
    assert df.select(geohash_text(F.col("x"), F.col("y"), 9)).first()[0] == "u4pruydqq"


def test_heatmap_counts_every_point_once(spark):
    df = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (0.0, 0.0)], "decimallatitude double, decimallongitude double").withColumn("hascoordinate", F.lit(True))
    cells = {r.cell: r["count"] for r in heatmap(df, 0).collect()}
    assert cells == {"zz": 1, "00": 1, "s0": 2}
    with pytest.raises(ValueError):
        heatmap(df, 0, mode="GEO_HULL")


def test_displaced_points_stay_inside_and_repeat(spark):
    from sightings.operators.grids import displaced

    df = spark.range(500).select(F.col("id").cast("string").alias("recordid"), F.lit(50.0).alias("lat"), F.lit(179.999).alias("lon"))
    lat, lon = displaced(F.col("recordid"), F.col("lat"), F.col("lon"), F.lit(1000.0))
    moved = df.select(F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), lat.alias("a"), lon.alias("b"))
    far = moved.filter(geo.haversine_metres(F.col("lat0"), F.col("lon0"), F.col("a"), F.col("b")) > 1005)
    assert far.count() == 0 and moved.select("a", "b").distinct().count() == 500
    assert moved.filter("b < -180 OR b > 180").count() == 0


def test_layer_join_with_holes_and_parts(spark, points):
    from sightings.operators.spatial_join import join_layer

    def ring(*corners):
        return [{"x": float(x), "y": float(y)} for x, y in corners]

    shapes = {
        "holed": ("POLYGON ((-21 -21, 22 -20, 20 21, -20 20, -21 -21), (-5 -5, 6 -5, 6 6, -5 5, -5 -5))",
                  [ring((-21, -21), (22, -20), (20, 21), (-20, 20), (-21, -21)), ring((-5, -5), (6, -5), (6, 6), (-5, 5), (-5, -5))]),
        "parts": ("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0)), ((-9 -9, -1 -9, -3 -1, -9 -9)))",
                  [ring((0, 0), (9, 0), (9, 9), (0, 0)), ring((-9, -9), (-1, -9), (-3, -1), (-9, -9))]),
    }
    layer = spark.createDataFrame([(name, rings) for name, (_, rings) in shapes.items()], "country string, rings array<array<struct<x:double,y:double>>>")
    distinct = points.distinct()
    got = {(r.country, r.lat, r.lon) for r in join_layer(distinct, layer, "lat", "lon").collect()}
    want = set()
    for name, (wkt, _) in shapes.items():
        want |= {(name, r.lat, r.lon) for r in distinct.filter(geo.within(wkt, F.col("lat"), F.col("lon"))).collect()}
    assert got == want and want


def _brute(edges, lat, lon):
    """Even-odd rule over all edges, and the edge test, as the column expressions have it."""
    x0, y0, x1, y1 = edges.T
    spans = (y0 > lat) != (y1 > lat)
    crossed = spans & (lon < (x1 - x0) * (lat - y0) / np.where(y1 == y0, 1, y1 - y0) + x0)
    on = (x1 - x0) * (lat - y0) == (y1 - y0) * (lon - x0)
    on &= (np.minimum(x0, x1) <= lon) & (lon <= np.maximum(x0, x1)) & (np.minimum(y0, y1) <= lat) & (lat <= np.maximum(y0, y1))
    return bool(crossed.sum() % 2 == 1 or on.any())


def _star(rng, x, y, radius, corners, whole=False):
    """A closed ring of many corners around a place; with ``whole`` its corners stand on whole degrees."""
    turns = sorted(rng.random() for _ in range(corners))
    ring = [(x + (r := radius * rng.uniform(0.4, 1)) * math.cos(2 * math.pi * t), y + r * math.sin(2 * math.pi * t) / 2) for t in turns]
    ring = [(float(round(a)), float(round(b))) for a, b in ring] if whole else ring
    return [*ring, ring[0]]


def test_covering_equals_all_edges():
    from sightings.operators import covering as cov

    rng = random.Random(11)
    polygons = [
        [_star(rng, 10, 10, 60, 5000)],
        [_star(rng, -100, 20, 70, 400), _star(rng, -100, 20, 20, 300)],
        [_star(rng, 40, -30, 45, 40, whole=True)],
        [_star(rng, x, -60, 12, 30) for x in (-150, -120, -90, 0, 100)],
        [_star(rng, 80, 50, 0.02, 600)],
    ]
    for rings in polygons:
        arrays = [np.array(r) for r in rings]
        leaves, every = {}, np.vstack([np.hstack([a[:-1], a[1:]]) for a in arrays])
        for cell, level, inside, edges in cov.polygon_leaves(cov.ring_edges(arrays)):
            assert inside or len(edges) <= 3 * cov.EDGES + 1 or level + cov.STEP > cov.DEEPEST
            leaves[cell] = edges
        corners = [p for r in rings for p in rng.sample(r, 20)]
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        some = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(300)] + [(rng.uniform(min(xs), max(xs)), rng.uniform(min(ys), max(ys))) for _ in range(700)]
        some += corners + [(float(round(x)), float(round(y))) for x, y in some[:300]] + [(x, rng.choice(corners)[1]) for x, _ in some[:200]]
        some += [(180.0, 90.0), (-180.0, -90.0), (180.0, 0.0)]
        for lon, lat in some:
            found = False
            for level in range(cov.BASE, cov.DEEPEST + 1, cov.STEP):
                many = 1 << level
                place = [max(0, min(many - 1, math.floor(v * many))) for v in ((lon + 180) / 360, (lat + 90) / 180)]
                number = cov._number(level, *place)
                if number in leaves:
                    edges = leaves[number]
                    found |= edges is None or _brute(edges, lat, lon)
            assert found == _brute(every, lat, lon), (lon, lat)


def test_layer_join_over_the_dateline_and_with_a_hot_cell(spark):
    from sightings.operators.covering import covering
    from sightings.operators.spatial_join import join_covering

    def ring(*corners):
        return [{"x": float(x), "y": float(y)} for x, y in corners]

    layer = spark.createDataFrame(
        [("pacific", [ring((150, -50), (-140, -45), (-150, 40), (160, 30), (150, -50))]), ("pole", [ring((-180, -70), (-60, -65), (60, -72), (180, -70))]),
         ("none", None), ("empty", [])], "country string, rings array<array<struct<x:double,y:double>>>")
    leaves = covering(layer).cache()
    rows = [(0, 0.0, 170.0), (1, 0.0, -170.0), (2, 0.0, 0.0), (3, -80.0, 0.0), (4, -89.0, 179.0), (5, 60.0, 170.0), (6, None, 3.0), (7, 200.0, 3.0)]
    points = spark.createDataFrame(rows, "id int, lat double, lon double")
    got = {(r.id, r.country) for r in join_covering(points, leaves, "lat", "lon").collect()}
    assert got == {(0, "pacific"), (1, "pacific"), (3, "pole"), (4, "pole")}
    # a third of all rows in one cell: the adaptive planner cuts it
    many = spark.range(300_000).select("id", (F.rand(1) * 0.01).alias("lat"), (F.rand(2) * 0.01 + F.when(F.col("id") % 3 == 0, 170.0).otherwise(F.rand(3) * 20 + 157)).alias("lon"))
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        frame = join_covering(many.repartition(8), leaves, "lat", "lon")
        assert len(frame.toPandas()) == 300_000
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
