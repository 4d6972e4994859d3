"""Layers on rasters against brute force over pixel centres, and coordinate systems against published values."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mereling.functions import crs
from mereling.operators import rasterize, spatial
from mereling.operators.rasterize import Grid
from mereling.sources import features

LAYER = f"kind string, rings {rasterize.RINGS}"
SQUARE = [(6.0, 6.0), (34.0, 6.0), (34.0, 34.0), (6.0, 34.0)]


def layer(spark, *parts):
    return spark.createDataFrame(list(parts), LAYER)


def pixels(spans):
    out = set()
    for r in spans.collect():
        new = {(r.y, x) for x in range(r.x0, r.x1 + 1)}
        assert r.x0 <= r.x1 and not new & out, "spans are disjoint"
        out |= new
    return out


def sides(ring, closed):
    return list(zip(ring, ring[1:] + (ring[:1] if closed else []), strict=False)) or [(ring[0], ring[0])]


def brute(parts, grid, buffer=0.0):
    """Even-odd over all rings of a part with centres in (x0, x1] and [y0, y1) of raster space, or within the buffer."""
    out = set()
    for y in range(grid.height):
        for x in range(grid.width):
            cx, cy = grid.c + (x + 0.5) * grid.a, grid.f + (y + 0.5) * grid.e
            for kind, rings in parts:
                closed = kind.endswith("Polygon")
                odd = near = False
                for ring in rings:
                    for (ax, ay), (bx, by) in sides(ring, closed):
                        pa, pb = (ay - grid.f) / grid.e, (by - grid.f) / grid.e
                        if closed and (pa > y + 0.5) != (pb > y + 0.5):
                            qa, qb = (ax - grid.c) / grid.a, (bx - grid.c) / grid.a
                            odd ^= x + 0.5 <= qa + (y + 0.5 - pa) * (qb - qa) / (pb - pa)
                        n = (bx - ax) ** 2 + (by - ay) ** 2
                        t = min(1, max(0, ((cx - ax) * (bx - ax) + (cy - ay) * (by - ay)) / n)) if n else 0
                        near |= buffer > 0 and math.hypot(cx - ax - t * (bx - ax), cy - ay - t * (by - ay)) <= buffer + 1e-9
                if odd or near:
                    out.add((y, x))
    return out


def test_a_square_by_its_pixel_centres(spark):
    grid = Grid(6, 6, 10.0, 0.0, 10.0, 0.0)
    assert pixels(rasterize.spans(layer(spark, ("Polygon", [SQUARE])), grid)) == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_a_buffer_of_20_m_masks_13_pixels(spark):
    grid = Grid(40, 40, 10.0, 300_000.0, -10.0, 5_900_000.0)
    got = pixels(rasterize.spans(layer(spark, ("Point", [[(300_205.0, 5_899_795.0)]])), grid, 20.0))
    assert got == {(20 + dy, 20 + dx) for dy in range(-2, 3) for dx in range(-2, 3) if dx * dx + dy * dy <= 4} and len(got) == 13


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("shape", [(1.0, 1.0), (10.0, -10.0), (10.0, -25.0), (-3.0, 2.0)])
def test_shapes_against_brute_force(spark, seed, shape):
    """Polygons with holes and edges on pixel centres, lines and points, in and around the raster."""
    r = random.Random(seed)
    grid = Grid(24, 31, shape[0], 1000.0, shape[1], 2000.0)
    at = lambda: (grid.c + r.choice([r.uniform(-9, 40), r.randint(-5, 35) + r.choice([0, 0.5])]) * grid.a, grid.f + r.choice([r.uniform(-9, 33), r.randint(-5, 28) + r.choice([0, 0.5])]) * grid.e)
    ring = lambda n: [at() for _ in range(n)]
    parts = [("Polygon", [ring(r.randint(3, 9)) for _ in range(r.randint(1, 3))]) for _ in range(3)]
    assert pixels(rasterize.spans(layer(spark, *parts), grid)) == brute(parts, grid)
    thin = [("LineString", [ring(3)]), ("MultiLineString", [ring(2)]), ("Point", [ring(1)]), ("LineString", [[at()] * 2])]
    assert pixels(rasterize.spans(layer(spark, *thin), grid)) == set()
    buffer = 2.3 * abs(grid.a)
    assert pixels(rasterize.spans(layer(spark, *thin, *parts[:1]), grid, buffer)) == brute(thin + parts[:1], grid, buffer)


def test_work_follows_edges_not_extent(spark):
    """A polygon 20,000 pixels wide on a raster of 100: as many rows as a small one; its vertices outside cost nothing."""
    grid = Grid(100, 100)
    wide = [("Polygon", [[(-10_000.0, -10_000.0), (10_000.0, -10_000.0), (10_000.0, 10_000.0), (-10_000.0, 10_000.0)]])]
    every = rasterize.edges(layer(spark, *wide))
    assert rasterize.filled(every, grid).count() == 100 and rasterize.merged(rasterize.filled(every, grid)).count() == 100
    ring = [(50 + 9000 * math.cos(t), 50 + 9000 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 20_000, endpoint=False).tolist()]
    far = rasterize.edges(layer(spark, ("Polygon", [ring])))
    assert rasterize.filled(far, grid).count() == 100 and rasterize.stroked(far, grid, 3.0).count() == 0


def test_buffers_at_the_border(spark):
    """A part outside whose buffer reaches in counts, unless the box is taken without it."""
    grid, part = Grid(10, 10, 10.0, 0.0, -10.0, 0.0), ("LineString", [[(-8.0, 10.0), (-8.0, -110.0)]])
    assert pixels(rasterize.spans(layer(spark, part), grid, 20.0)) == {(y, 0) for y in range(10)}
    assert pixels(rasterize.spans(layer(spark, part), grid, 20.0, strict_bbox=True)) == set()


def test_buffer_formulas_are_evaluated_once_by_all_tasks(spark):
    """A filter pushed below the spans' ends repeated every formula in it; a layer of one file kept its edges in one task."""
    grid = rasterize.Grid(100, 100, 10.0, 0.0, -10.0, 1000.0)
    every = rasterize.edges(layer(spark, ("Polygon", [SQUARE])).coalesce(1))
    plan = rasterize.stroked(every, grid, 20.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") <= 3 and "RepartitionByExpression" in plan


def test_masks_in_both_layouts(spark):
    grid = Grid(40, 40, 10.0, 0.0, -10.0, 400.0)
    parts = [("Polygon", [[(33.0, 41.0), (350.0, 60.0), (300.0, 333.0), (51.0, 380.0)], [(100.0, 100.0), (200.0, 110.0), (190.0, 220.0)]])]
    want = brute(parts, grid)
    every = {(y, x) for y in range(40) for x in range(40)}
    pix = spark.range(1600).select(F.floor(F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"))
    spans = rasterize.spans(layer(spark, *parts), grid)
    assert {(r.y, r.x) for r in rasterize.meet(pix, spans, "left_semi", side=7).collect()} == want
    assert {(r.y, r.x) for r in spatial.outside_buffer(pix, layer(spark, *parts), 15.0, grid).collect()} == every - brute(parts, grid, 15.0)
    bounds = [(0, 14), (14, 27), (27, 40)]
    rows = [("f", r * 3 + c, y1 - y0, x1 - x0, [None if (y + x) % 11 == 0 else float(y * 40 + x) for y in range(y0, y1) for x in range(x0, x1)]) for r, (y0, y1) in enumerate(bounds) for c, (x0, x1) in enumerate(bounds)]
    blocks = spark.createDataFrame(rows, "file string, chunk int, h int, w int, px array<double>")
    for inside in (True, False):
        got = {v for b in rasterize.mask_blocks(blocks, spans, grid, 9, inside).collect() for v in b.px if v is not None}
        assert got == {float(y * 40 + x) for y, x in every if (y + x) % 11 and ((y, x) in want) != inside}
    assert rasterize.mask_blocks(blocks, spans.limit(0), grid, 9).orderBy("chunk").collect() == blocks.orderBy("chunk").collect()


def test_published_coordinates_and_round_trips(spark):
    """The worked example of the British grid; a zone there and back to below a millimetre, in Spark's columns."""
    lon, lat = crs.run(crs.system("EPSG:27700").inverse(), 651409.903, 313177.270)
    assert lat == pytest.approx(52 + 39 / 60 + 27.2531 / 3600, abs=1e-8) and lon == pytest.approx(1 + 43 / 60 + 4.5177 / 3600, abs=1e-8)
    assert crs.convert(3.0, 0.0, "EPSG:4326", "EPSG:32631") == pytest.approx((500_000.0, 0.0)) and crs.convert(3.0, 0.0, "EPSG:4326", "EPSG:32731")[1] == pytest.approx(10_000_000.0)
    # the meridian from the equator to the pole is 10,001,965.729 m on this ellipsoid
    assert crs.convert(3.0, 90.0, "EPSG:4326", "EPSG:32631")[1] / 0.9996 == pytest.approx(10_001_965.729, abs=2e-3)
    assert crs.convert(180.0, 0.0, "EPSG:4326", "EPSG:3857")[0] == pytest.approx(20_037_508.3428)
    rows = spark.createDataFrame([(lon / 10, lat / 2) for lon in range(0, 61, 3) for lat in range(-160, 169, 8)], "lon double, lat double")
    for target in ("EPSG:32631", "EPSG:3857", "EPSG:27700"):
        own = rows.where("lat > 0" if target != "EPSG:27700" else "lat > 49 and lat < 61 and lon < 3")
        there = own.withColumn("p", crs.point(F.col("lon"), F.col("lat"), "EPSG:4326", target))
        limit = 5e-9 if target != "EPSG:27700" else 1e-7  # heights are left out of a change of datum
        back = there.withColumn("q", crs.point(F.col("p.x"), F.col("p.y"), target, "EPSG:4326")).collect()
        assert len(back) > 10 and all(abs(r.q.x - r.lon) < limit and abs(r.q.y - r.lat) < limit for r in back)
        assert (back[0].p.x, back[0].p.y) == pytest.approx(crs.convert(back[0].lon, back[0].lat, "EPSG:4326", target), abs=1e-6)
    assert crs.normal("urn:ogc:def:crs:EPSG::27700") == "EPSG:27700" and crs.normal(None) == crs.normal("urn:ogc:def:crs:OGC:1.3:CRS84") == "EPSG:4326"
    with pytest.raises(ValueError, match="EPSG:2154"):
        crs.system("EPSG:2154")


def write(path, system, parts):
    shape = [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[*r, r[0]] for r in rings]}} for _, rings in parts]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": shape} | ({"crs": {"type": "name", "properties": {"name": system}}} if system else {})))


def test_a_layer_in_other_systems_masks_the_same(spark, tmp_path):
    """GeoJSON with holes in UTM, in degrees and on the British grid; the file says which."""
    grid = Grid(60, 70, 10.0, 420_000.0, -10.0, 5_800_000.0, "EPSG:32631")
    ring = [(420_103.3, 5_799_902.1), (420_604.7, 5_799_840.9), (420_551.9, 5_799_511.7), (420_130.1, 5_799_433.3)]
    hole = [(420_251.3, 5_799_752.9), (420_402.7, 5_799_741.7), (420_377.1, 5_799_604.3)]
    parts = [("Polygon", [ring, hole])]
    want = brute(parts, grid)
    for system in ("EPSG:32631", None, "urn:ogc:def:crs:EPSG::27700", "urn:ogc:def:crs:EPSG::3857"):
        target = crs.normal(system)
        moved = [("Polygon", [[crs.convert(x, y, grid.crs, target) for x, y in r] for r in (ring, hole)])]
        path = tmp_path / f"{target[5:]}.geojson"
        write(path, system, moved)
        rows = features.read_geojson(spark, str(path))
        assert {r.crs for r in rows.collect()} == {target} and len(rows.first().rings) == 2
        assert pixels(rasterize.spans(rows, grid, source=target)) == want, system
        box = crs.bounds(*grid.bounds, grid.crs, target)
        assert features.read_geojson(spark, str(path), box).count() == 1


def test_nearest_cells(spark):
    """Cells of 23 x 31 m on pixels of 10 m, and cells of degrees under a UTM raster; pixels outside stay."""
    grid = Grid(30, 40, 10.0, 500_000.0, -10.0, 5_900_000.0, "EPSG:32631")
    pix = spark.range(1200).select(F.floor(F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"))
    for cover in (Grid(9, 11, 23.0, 500_051.0, -31.0, 5_899_990.0, "EPSG:32631"), Grid(20, 20, 0.0002, crs.convert(500_000.0, 5_900_000.0, grid.crs, "EPSG:4326")[0], -0.0002, crs.convert(500_000.0, 5_900_000.0, grid.crs, "EPSG:4326")[1])):
        want = {}
        for y in range(30):
            for x in range(40):
                mx, my = crs.convert(500_005.0 + 10 * x, 5_899_995.0 - 10 * y, grid.crs, cover.crs)
                cx, cy = math.floor((mx - cover.c) / cover.a), math.floor((my - cover.f) / cover.e)
                want[y, x] = (cy if 0 <= cy < cover.height else None, cx if 0 <= cx < cover.width else None)
        assert {(r.y, r.x): (r.cover_y, r.cover_x) for r in rasterize.nearest_class(pix, grid, cover).collect()} == want
        classes = [(y, x, 20 if (y * 7 + x) % 3 == 0 else 1) for y in range(cover.height) for x in range(cover.width)]
        bad = {(y, x) for y, x, c in classes if c == 20}
        kept = rasterize.without_cover(pix, spark.createDataFrame(classes, "y int, x int, class int"), (20, 21), grid, cover)
        assert {(r.y, r.x) for r in kept.collect()} == {p for p, at in want.items() if at not in bad}
        y0, y1, x0, x1 = rasterize.window(grid, cover)
        assert all(cy is None or cx is None or y0 <= cy < y1 and x0 <= cx < x1 for cy, cx in want.values())
    big = Grid(100_000, 100_000, 10.0, 0.0, -10.0, 6_400_000.0, "EPSG:32631")
    assert rasterize.window(grid, big) == (49_999, 50_032, 49_999, 50_042)


def test_all_masks_in_order(spark):
    grid = Grid(20, 20, 10.0, 0.0, -10.0, 200.0, "EPSG:32631")
    pix = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"))
    river, land, lake = ("LineString", [[(0.0, 0.0), (200.0, 150.0)]]), ("Polygon", [[(20.0, -5.0), (205.0, -5.0), (205.0, 205.0), (20.0, 205.0)]]), ("Polygon", [[(101.0, 31.0), (142.0, 32.0), (139.0, 64.0)]])
    cover = [(y, x, 20 if x == 19 else 1) for y in range(20) for x in range(20)]
    got = spatial.mask_features(pix, {"rivers": layer(spark, river), "land": layer(spark, land), "reservoirs": layer(spark, lake), "land_cover": spark.createDataFrame(cover, "y int, x int, class int")}, grid)
    every = {(y, x) for y in range(20) for x in range(20)}
    assert {(r.y, r.x) for r in got.collect()} == {p for p in every - brute([river], grid, 20.0) - brute([lake], grid, 50.0) if p in brute([land], grid) and p[1] != 19}


def curve(order, d):
    """The cell at a place of the Hilbert curve, by its definition in quarters."""
    if not order:
        return 0, 0
    n, quarter = 1 << (order - 1), 4 ** (order - 1)
    q, rest = divmod(d, quarter)
    x, y = curve(order - 1, rest)
    return [(y, x), (x, y + n), (x + n, y + n), (2 * n - 1 - y, n - 1 - x)][q]


def test_hilbert_curve(spark):
    for order in (1, 2, 4):
        cells = spark.range(4**order).selectExpr(f"cast(floor(id / {2**order}) as long) as x", f"id % {2**order} as y")
        assert {r.d: (r.x, r.y) for r in cells.select("x", "y", features.hilbert(F.col("x"), F.col("y"), order).alias("d")).collect()} == {d: curve(order, d) for d in range(4**order)}


def test_a_box_reads_a_few_row_groups_of_the_store(spark, tmp_path):
    """Of 40,000 parts a small box scans a few hundred; all that meet it are found."""
    parts = spark.range(40_000).selectExpr("id", "double(pmod(hash(id), 100000)) as x", "double(pmod(hash(id, 7), 100000)) as y")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    rows = parts.select("id", F.lit("Polygon").alias("kind"), F.array(F.array(corner(0, 0), corner(40, 0), corner(0, 30))).alias("rings"))
    features.write_store(rows, str(tmp_path / "store"), files=8, group_bytes=64 << 10)
    box = (41_000.0, 63_000.0, 44_000.0, 65_000.0)
    got = features.read_store(spark, str(tmp_path / "store"), box)
    want = {r.id for r in parts.where("x + 40 >= 41000 and x <= 44000 and y + 30 >= 63000 and y <= 65000").collect()}
    assert {r.id for r in got.collect()} == want and 10 < len(want) < 60
    assert "PushedFilters: [IsNotNull(max_x)" in got._jdf.queryExecution().toString()
    plan = got._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().apply("numOutputRows").value() < 8000, "rows of the groups that the scan read"
    assert features.read_store(spark, str(tmp_path / "store")).count() == 40_000
    grid = Grid(200, 300, 10.0, 41_000.0, -10.0, 65_000.0)
    assert pixels(rasterize.spans(got, grid)) == pixels(rasterize.spans(rows, grid))
    features.write_store(rows.limit(0), str(tmp_path / "none"), files=2)
    assert features.read_store(spark, str(tmp_path / "none"), box).count() == 0
