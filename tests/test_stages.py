"""Sources, sinks, the stream of label events, and the four stages end to end."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mereling import schemas
from mereling.config import Settings
from mereling.operators import model, predictions
from mereling.plans import stages
from mereling.sources import features as vectors
from mereling.sources import images, lines, scenes
from mereling.streaming import label_events

HEADER = "chunk,reservoirs,water-bodies,reservoir-coordinates,,,,,water-body-coordinates"


def test_lines_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n\n1,0,0,,,,,\n")
    (tmp_path / "b.csv").write_text("x")
    got = lines.read(spark, str(tmp_path))
    assert got.count() == 4 and got.where("line_no = 1").first().value == ""
    lines.write(got, f"{tmp_path}/out")
    back = lines.read(spark, f"{tmp_path}/out/file=a.csv").orderBy("line_no").collect()
    assert [r.value for r in back] == [HEADER, "", "1,0,0,,,,,"]
    assert lines.or_seed(spark, f"{tmp_path}/none.csv", f"{tmp_path}/b.csv").first().value == "x"


def test_scene_catalogue(spark, tmp_path):
    name = "S2C_MSIL2A_20250331T110651_N0511_R137_T31UCU_20250331T143812.SAFE"
    for granule, band in (("L2A_1", "B03"), ("L2A_1", "B08"), ("L2A_2", "B04")):
        d = tmp_path / name / "GRANULE" / granule / "IMG_DATA" / "R10m"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"T31UCU_20250331T110651_{band}_10m.jp2").write_bytes(b"x")
    rows = scenes.catalogue(spark, str(tmp_path))
    assert {(r.band, r.resolution, r.fields.tile) for r in rows.collect()} == {("03", "10m", "T31UCU"), ("08", "10m", "T31UCU"), ("04", "10m", "T31UCU")}
    with pytest.raises(Exception, match="not one granule"):
        scenes.one_granule(rows).collect()
    assert scenes.one_granule(rows.where("granule = 'L2A_1'")).count() == 2
    assert scenes.default_scene(rows).first().scene == name


def test_png_and_parquet_patches(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(c, f"T-20250331-{i:04d}.png", 31, 32, r.integers(0, 256, 31 * 32).tolist()) for i, c in enumerate(["land", "sea", "land"])]
    df = spark.createDataFrame(rows, "class string, name string, h int, w int, px array<smallint>")
    images.write_png(df, str(tmp_path / "png"))
    got = {x.name: (x["class"], x.h, x.w, x.px) for x in images.read_png(spark, str(tmp_path / "png")).collect()}
    assert got == {x[1]: (x[0], x[2], x[3], x[4]) for x in rows}
    (tmp_path / "plain" / "sea").mkdir(parents=True)
    (tmp_path / "plain" / "sea" / "p.png").write_bytes(images.png([1, 2, 3, 4], 2, 2))
    assert [(x["class"], x.px) for x in images.read_png(spark, str(tmp_path / "plain")).collect()] == [("sea", [1, 2, 3, 4])]
    path = str(tmp_path / "parquet")
    images.write_parquet(df.withColumn("scene_prefix", F.lit("a")), path)
    images.write_parquet(df.limit(1).withColumn("scene_prefix", F.lit("b")), path)
    images.write_parquet(df.where("class = 'land'").limit(1).withColumn("scene_prefix", F.lit("a")), path)
    assert {(x["class"], x.scene_prefix): x.n for x in spark.read.parquet(path).groupBy("class", "scene_prefix").agg(F.count("*").alias("n")).collect()} == {("land", "a"): 1, ("sea", "a"): 1, ("land", "b"): 1}
    assert images.stale(df, 4) and not images.stale(df, 3)


def test_label_events_stream(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    first = [("T", 0, 1, t, "a", False), ("T", 1, 1, t, "b", False)]
    then = [("T", 1, 3, t, "b3", False), ("T", 1, 2, t, "late", False), ("T", 0, 2, t, None, True), ("U", 0, 1, t, "u", False)]
    spark.createDataFrame(first, schemas.LABEL_EVENTS).write.parquet(f"{tmp_path}/in")
    q = label_events.fold_to(label_events.read(spark, f"{tmp_path}/in"), f"{tmp_path}/now", f"{tmp_path}/check")
    q.processAllAvailable()
    assert label_events.latest(spark, f"{tmp_path}/now").count() == 2
    spark.createDataFrame(then, schemas.LABEL_EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    rows = {(r.tile, r.chunk): r.value for r in label_events.latest(spark, f"{tmp_path}/now").collect()}
    assert rows == {("T", 1): "b3", ("U", 0): "u"}
    batch = label_events.current(spark.createDataFrame(first + then, schemas.LABEL_EVENTS))
    assert {(r.tile, r.chunk): r.value for r in batch.collect()} == rows
    assert label_events.rate(spark.createDataFrame(first + then, schemas.LABEL_EVENTS)).where("tile = 'T'").first().n == 5


def test_four_stages(spark):
    """Two scenes of 4 chunks; water in one chunk's corner, cloud in another's."""
    side, k = 314, 2
    settings = Settings(n_chunks=k * k, n_images=2)
    r = np.random.default_rng(1)
    rows, cloud = [], []
    for s in range(2):
        green, nir = r.integers(900, 1100, (side, side)), r.integers(1900, 2100, (side, side))
        green[20:60, 20:60], nir[20:60, 20:60] = 3000, 500
        rows += [(f"s{s}", y, x, int(green[y, x]), int(nir[y, x])) for y in range(side) for x in range(side)]
    cloud += [("s0", y, x, 1) for y in range(0, 40) for x in range(0, 40)]
    bands = spark.createDataFrame(rows, "scene string, y int, x int, green int, nir int")
    index = stages.water_index(bands, spark.createDataFrame(cloud, "scene string, y int, x int, cls int"), settings)
    assert index.count() == side * side and index.where("v is null").isEmpty()
    blocks = stages.chunk_blocks(index.withColumn("file", F.lit("f")), side, side, settings).persist()
    assert {(b.chunk, b.h, b.w, len(b.px)) for b in blocks.collect()} == {(c, 157, 157, 157 * 157) for c in range(4)}
    text = [HEADER, "0,1,0,[ 25. 25. 50. 50.],,,,", "1,0,0,,,,,", "2,0,0,,,,,", "3,0,0,,,,,"]
    label_lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text)], "file string, line_no bigint, value string")
    patches = stages.label(label_lines, blocks).persist()
    assert {(p["class"], p.idx) for p in patches.collect()} == {("reservoirs", 0), ("land", 0), ("land", 1), ("land", 2)}
    many = patches.crossJoin(spark.range(12)).withColumn("key", F.concat_ws("-", "class", "idx", "id"))
    classifier, right = stages.train(many, settings, steps=25)
    assert right > 0.9
    runs = stages.sweep(many, (1, 20), settings=settings).collect()
    assert [x.epochs for x in runs] == [1, 20] and runs[1].accuracy > 0.9
    cut = stages.mini_chunks(blocks)
    assert cut.count() == 100
    got = stages.predict(cut, classifier, settings).persist()
    assert predictions.wide(got).count() == 4 and got.where("confidence < 25 or confidence > 100").isEmpty()
    metrics = {m["class"]: m for m in stages.evaluate(got, label_lines, settings).collect()}
    assert set(metrics) == {"land", "reservoirs", "sea", "water_bodies"}
    assert all(m.chunks == 4 and m.tp + m.tn + m.fp + m.fn == 100 for m in metrics.values())


def test_geojson(spark, tmp_path):
    import json

    geometry = lambda kind, c: {"type": "Feature", "properties": {"name": kind}, "geometry": {"type": kind, "coordinates": c}}
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    features = [geometry("Point", [1, 2]), geometry("LineString", [[0, 0], [1.5, 1]]), geometry("Polygon", [ring, [[1, 1], [2, 1], [1, 1]]]), geometry("MultiPolygon", [[ring], [[[10, 10], [12, 10], [12, 12], [10, 10]]]]),
                geometry("MultiLineString", [[[0, 0], [9, 9]], [[20, 20], [21, 21]]]), geometry("MultiPoint", [[5, 5], [6, 6]]), {"type": "Feature", "properties": {}, "geometry": None}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = vectors.read_geojson(spark, str(tmp_path)).collect()
    assert sorted((r.kind, [(v.x, v.y) for v in r.vertices]) for r in got) == sorted([
        ("Point", [(1, 2)]), ("LineString", [(0, 0), (1.5, 1)]), ("Polygon", [(0, 0), (4, 0), (4, 4)]), ("MultiPolygon", [(0, 0), (4, 0), (4, 4)]), ("MultiPolygon", [(10, 10), (12, 10), (12, 12)]),
        ("MultiLineString", [(0, 0), (9, 9)]), ("MultiLineString", [(20, 20), (21, 21)]), ("MultiPoint", [(5, 5)]), ("MultiPoint", [(6, 6)])])
    assert {r.kind for r in vectors.read_geojson(spark, str(tmp_path), (11, 11, 30, 30)).collect()} == {"MultiPolygon", "MultiLineString"}
    assert {r.kind for r in vectors.read_geojson(spark, str(tmp_path), (11, 11, 30, 30), strict=True).collect()} == {"MultiLineString"}
    assert json.loads(got[0].properties)["name"] == got[0].kind


def test_metadata_of_granules(spark, tmp_path):
    name = "S2C_MSIL2A_20250331T110651_N0511_R137_T31UCU_20250331T143812.SAFE"
    d = tmp_path / name / "GRANULE" / "L2A_1"
    d.mkdir(parents=True)
    sizes = "".join(f'<Size resolution="{r}"><NROWS>{109800 // r}</NROWS><NCOLS>{109800 // r}</NCOLS></Size>' for r in (10, 20, 60))
    places = "".join(f'<Geoposition resolution="{r}"><ULX>300000</ULX><ULY>5900040</ULY><XDIM>{r}</XDIM><YDIM>-{r}</YDIM></Geoposition>' for r in (10, 20, 60))
    (d / "MTD_TL.xml").write_text(f'<n1:Tile xmlns:n1="u"><n1:Geo><Tile_Geocoding><HORIZONTAL_CS_CODE>EPSG:32631</HORIZONTAL_CS_CODE>{sizes}{places}</Tile_Geocoding></n1:Geo></n1:Tile>')
    rows = {r.resolution: r for r in scenes.metadata(spark, str(tmp_path)).collect()}
    assert set(rows) == {10, 20, 60} and rows[20].crs == "EPSG:32631" and (rows[10].height, rows[60].width) == (10980, 1830)
    assert rows[20].scene == name and tuple(rows[20].transform) == (20.0, 300000.0, -20.0, 5900040.0)


def test_stored_mini_chunks_listing_and_models(spark, tmp_path):
    r = np.random.default_rng(0)
    blocks = spark.createDataFrame([("f", c, 10, 10, r.normal(size=100).tolist()) for c in range(3)], "file string, chunk int, h int, w int, px array<double>")
    path = str(tmp_path / "store")
    assert stages.stored_mini_chunks(spark, blocks, path, "a", 0.41).count() == 75
    first = sorted((tmp_path / "store").rglob("*.parquet"))
    assert stages.stored_mini_chunks(spark, blocks, path, "b", 0.41).count() == 75
    assert stages.stored_mini_chunks(spark, blocks, path, "a", 0.41).count() == 75 and set(first) < set((tmp_path / "store").rglob("*.parquet"))  # taken from the store
    more = blocks.union(blocks.selectExpr("file", "chunk + 3", "h", "w", "px"))
    assert stages.stored_mini_chunks(spark, more, path, "a", 0.41).count() == 150
    for n in ("ndwi chunk 2 minichunk 10.png", "other.png"):
        (tmp_path / n).write_bytes(b"x")
    assert {(x.name, x.chunk, x.minichunk) for x in images.listing(spark, str(tmp_path)).collect()} == {("ndwi chunk 2 minichunk 10.png", 2, 10), ("other.png", -1, -1)}
    rows = spark.createDataFrame([([float(k % 2), 0.0], k % 2) for k in range(40)], "px array<double>, label int")
    model.save(model.fit_perceptron(rows, hidden=3, steps=20), str(tmp_path / "models" / "ndwi model epochs-20"))
    again = model.load(spark, str(tmp_path / "models"), "epochs-20")
    assert model.predict_perceptron(again, rows).where("predicted <> label").isEmpty()
    with pytest.raises(ValueError, match="0 models"):
        model.load(spark, str(tmp_path / "models"), "epochs-21")
