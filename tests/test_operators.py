"""Operators on small tables: values by hand, NumPy, and properties."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mereling.operators import evaluation, labels, model, predictions, raster, spatial
from mereling.operators.rasterize import Grid, layer_of

LINES = ["chunk,reservoirs,water-bodies,reservoir-coordinates,,,,,water-body-coordinates", "0,0,1,,,,,,[  0.   0. 157. 157.]", "1,1,0,[ 10. 20. 30. 40.],,,,", "", "2,0,0,,,,,", "3,1,0,,,,,", "4,0,0,[ 1. 2. 3. 4.],,,,", "6,0,0,,,,,"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(LINES)], "file string, line_no bigint, value string")


def test_label_lines(lines):
    kept = labels.clean(lines)
    assert [r.line_no for r in kept.orderBy("line_no").collect()] == [0, 1, 2, 4, 5, 6, 7]
    assert [(r.chunk, r.next_chunk) for r in labels.gaps(kept).collect()] == [(4, 6)]
    assert labels.last_chunk(kept).first().resume_at == 7
    bad = {r.row: r for r in labels.incomplete(kept).collect()}
    assert set(bad) == {3, 4} and bad[3].res_missing and bad[4].res_extra
    got = {(r.line_no, r["class"], r.k): r.box for r in labels.boxes(kept).collect()}
    assert set(got) == {(1, "sea", 0), (2, "reservoirs", 0), (4, "land", 0), (5, "reservoirs", 0), (6, "land", 0), (7, "land", 0)}
    assert got[5, "reservoirs", 0] is None and tuple(got[4, "land", 0]) == pytest.approx((36.8, 36.8, 68.2, 68.2))
    assert labels.undo(kept, 2).count() == 5 and labels.undo(kept, 99).count() == 1


def test_corrections(spark, lines):
    new = spark.createDataFrame([("f", 3, "9,0,0,,,,,")], "file string, line_no bigint, value string")
    got = {r.line_no: r.value for r in labels.correct(lines, new).collect()}
    assert got[3] == "9,0,0,,,,," and got[1] == LINES[1] and len(got) == len(LINES)


def test_patches_and_alignment(spark):
    """A chunk without any value shifts what rows mean in 'ordinal', not in 'chunk'."""
    h = w = 157
    px = lambda v: [v] * (h * w)
    blocks = spark.createDataFrame([("f", 0, h, w, px(None)), ("f", 1, h, w, px(1.0)), ("f", 2, h, w, px(0.0))], "file string, chunk int, h int, w int, px array<double>")
    lines = spark.createDataFrame([("f", 0, LINES[0])] + [("f", i + 1, f"{i},0,0,,,,,") for i in range(3)], "file string, line_no bigint, value string")
    by_chunk = labels.patches(labels.boxes(lines), blocks).orderBy("idx").collect()
    assert [(r.idx, r.h, r.w, r.px[0]) for r in by_chunk] == [(0, 32, 32, 255), (1, 32, 32, 0)]
    by_place = labels.patches(labels.boxes(lines), blocks, align="ordinal").orderBy("idx").collect()
    assert [r.px[0] for r in by_place] == [255, 0] and len(by_place) == 2
    assert all(0 <= v <= 255 for r in by_chunk for v in r.px)


def test_composites(spark):
    values = [0.1, 0.5, None, -0.3, 0.9]
    rows = [("ndwi", 0, 0, v) for v in values] + [("ndwi", 0, 1, None)] + [("ndwi", 1, 0, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "index_name string, y int, x int, v double")
    got = {(r.y, r.x): r for r in raster.composite(df).collect()}
    assert (got[0, 0].p25, got[0, 0].median, got[0, 0].p75) == pytest.approx((0.0, 0.3, 0.6)) and got[0, 0].mean == pytest.approx(0.3)
    assert got[0, 1].median is None and got[0, 1].mean is None
    strict = {(r.y, r.x): r for r in raster.composite(df, strict=True).collect()}
    assert strict[0, 0].median is None and strict[0, 0].mean == pytest.approx(0.3) and strict[1, 0].median == 1.5
    for r in got.values():
        assert r.median is None or r.p25 <= r.median <= r.p75


def test_block_composite_equals_numpy(spark):
    r = np.random.default_rng(2)
    stack = np.where(r.random((7, 40)) < 0.3, np.nan, r.normal(size=(7, 40)))
    stack[:, 5] = np.nan
    rows = [("i", 0, f"s{k}", [None if np.isnan(v) else float(v) for v in line]) for k, line in enumerate(stack)]
    got = raster.composite_blocks(spark.createDataFrame(rows, "index_name string, chunk int, scene string, px array<double>")).first()
    seen = np.arange(40) != 5
    for name, want in zip(("p25", "median", "p75"), np.nanpercentile(stack[:, seen], [25, 50, 75], axis=0), strict=True):
        assert got[name][5] is None and np.array([v for v in got[name] if v is not None]) == pytest.approx(want)


def test_cloud_model_and_masks(spark):
    blocks = spark.createDataFrame([("s", 0, 2, 2, [1, 9, 1, 9], [1, 1, 1, 1], [5, 5, 5, 5])], "scene string, chunk int, h int, w int, red array<int>, green array<int>, nir array<int>")
    out = raster.cloud_classes(blocks, lambda stack: (stack[0] > 5).astype(int)).first()
    assert out.cls == [0, 1, 0, 1]


def test_spatial(spark):
    pix = spark.range(400).select((F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"))
    line = spark.createDataFrame([([(2.0, 3.0), (15.0, 11.0), (15.0, 18.0)],), ([(18.0, 1.0)],)], "vertices array<struct<x:double,y:double>>")

    def near(x, y, pts, d):
        best = 1e9
        for (ax, ay), (bx, by) in zip(pts, pts[1:] or pts, strict=False):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
            best = min(best, (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2)
        return best <= d * d

    plain = Grid(20, 20)
    got = {(r.y, r.x) for r in spatial.outside_buffer(pix, layer_of(line, "LineString"), 2.5, plain).collect()}
    assert got == {(y, x) for y in range(20) for x in range(20) if not near(x + 0.5, y + 0.5, [(2, 3), (15, 11), (15, 18)], 2.5) and not near(x + 0.5, y + 0.5, [(18, 1)], 2.5)}
    none = layer_of(line.limit(0), "Polygon")
    assert spatial.outside_buffer(pix, none, 2.5, plain).count() == 400 and spatial.covered(pix, none, plain).count() == 400
    polygon = [(1.25, 1.25), (12.25, 3.75), (6.25, 6.75), (13.25, 14.75), (2.25, 12.75)]

    def within(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    land = spark.createDataFrame([(polygon,)], "vertices array<struct<x:double,y:double>>")
    assert {(r.y, r.x) for r in spatial.covered(pix, layer_of(land, "Polygon"), plain).collect()} == {(y, x) for y in range(20) for x in range(20) if within(x + 0.5, y + 0.5)}


def test_predictions(spark):
    p = spark.createDataFrame([(1, 0.5, 0, "a"), (1, 0.9, 1, "b"), (1, 0.9, 2, "c"), (0, 0.1, 3, "d"), (None, 1.0, 4, "e"), (0, None, 5, "f")], "chunk int, confidence double, ord int, label string")
    assert [r.label for r in predictions.best_per_chunk(p).orderBy("chunk").collect()] == ["d", "b"]
    rows = spark.createDataFrame([(c, m, "LAND", 12.345) for c in (0, 1) for m in range(25) if (c, m) != (1, 0)] + [(-1, -1, "SEA", 1.0)], "chunk int, minichunk int, label string, confidence double")
    text = predictions.csv_lines(rows).orderBy("chunk").collect()
    assert text[0].value.startswith("0,LAND 12.35,") or text[0].value.startswith("0,LAND 12.34,")
    assert text[1].value.startswith("1,,LAND") and len(text) == 2
    back = predictions.read_csv_lines(spark.createDataFrame([(i, v) for i, v in enumerate(predictions.CSV_HEADER + [r.value for r in text])], "line_no bigint, value string"))
    assert back.count() == 49
    files = spark.createDataFrame([("b.png",), ("ndwi chunk 2 minichunk 10.png",), ("ndwi chunk 2 minichunk 9.png",), ("ndwi chunk 1 minichunk 20.png",)], "name string")
    assert [r.name[:13] for r in predictions.files_in_order(files).collect()] == ["ndwi chunk 1 ", "ndwi chunk 2 ", "ndwi chunk 2 ", "b.png"]
    assert predictions.in_order(rows).first().chunk == -1


@pytest.mark.parametrize("p,n,want", [(3, 1, (1, 22, 2, 0)), (1, 3, (1, 22, 0, 2)), (2, 2, (2, 23, 0, 0)), (0, 0, (0, 25, 0, 0))])
def test_counts(spark, p, n, want):
    pred = spark.createDataFrame([(0, p, 0, 0, 0)], "chunk int, p_land int, p_reservoirs int, p_sea int, p_water_bodies int")
    true = spark.createDataFrame([(0, n, 0, 0, 0)], "chunk int, n_land int, n_reservoirs int, n_sea int, n_water_bodies int")
    got = evaluation.confusion(pred, true).where("class = 'land'").first()
    assert (got.tp, got.tn, got.fp, got.fn) == want and sum(want) == 25


@pytest.mark.parametrize("tp,tn,fp,fn,want", [(0, 20, 0, 5, (80, 100, 0, 100, 0)), (0, 23, 1, 1, (92, 0, 0, 95.83, 100))])
def test_metrics(spark, tp, tn, fp, fn, want):
    r = evaluation.metrics(spark.createDataFrame([("x", tp, tn, fp, fn, 1)], "class string, tp int, tn int, fp int, fn int, chunks int")).first()
    assert (r.acc, r.prec, r.recall, r.spec, r.f1) == pytest.approx(want)


def test_cell_classes(spark):
    cells = [("RESERVOIRS 39.9", "land"), ("RESERVOIRS 40.0", "reservoirs"), (" water-bodies ", "water_bodies"), ("Sea 1", "sea"), ("LAND 0", "land"), ("?", None)]
    df = spark.createDataFrame(cells, "cell string, want string")
    assert all(r.got == r.want for r in df.select(evaluation.cell_class(F.col("cell"), 40.0).alias("got"), "want").collect())


def test_convolution_against_loops():
    r = np.random.default_rng(0)
    w = model.convolution_weights(4)
    image = r.integers(0, 256, (1, 31, 31)).astype(float)
    x = np.repeat(image[0][..., None] / 255, 3, axis=2)
    for kernel, bias in zip(w[0:6:2], w[1:6:2], strict=True):
        pad = np.pad(x, ((1, 1), (1, 1), (0, 0)))
        y = np.zeros((*x.shape[:2], kernel.shape[3]))
        for i in range(x.shape[0]):
            for j in range(x.shape[1]):
                y[i, j] = np.maximum(np.tensordot(pad[i : i + 3, j : j + 3], kernel, 3) + bias, 0)
        h = y.shape[0] // 2
        x = np.array([[y[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].max(axis=(0, 1)) for j in range(h)] for i in range(h)])
    want = np.maximum(x.ravel() @ w[6] + w[7], 0) @ w[8] + w[9]
    assert sum(a.size for a in w) == 97956
    assert model.convolution_forward(image, w)[0] == pytest.approx(want)


def test_split_is_stable_and_disjoint(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    a, b = model.split(rows, "key")
    assert a.count() + b.count() == 5000 and a.join(b, "key").isEmpty() and 0.17 < b.count() / 5000 < 0.23
    assert model.split(rows.repartition(9), "key")[1].join(b, "key", "left_anti").isEmpty()


def test_resize_keeps_flat_images_and_means():
    assert np.allclose(model.bilinear(np.full((32, 31), 7.0), 31), 7.0)
    assert np.allclose(model.bilinear(np.arange(12.0).reshape(3, 4), 4)[0, [0, 3]], [0, 3])


def test_blocks_that_lack_different_pixels(spark):
    r = np.random.default_rng(3)
    rows = [("i", f"s{s}", 0, y, x, float(r.normal())) for s in range(4) for y in range(3) for x in range(5) if r.random() < 0.6]
    df = spark.createDataFrame(rows, "index_name string, scene string, chunk int, y int, x int, v double")
    made = raster.composite_blocks(raster.to_blocks(df)).first()
    want = {(x.y, x.x): (x.median, x.mean) for x in raster.composite(df).collect()}
    got = {(p.y, p.x): (a, b) for p, a, b in zip(made["at"], made["median"], made["mean"], strict=True)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_filled_blocks(spark):
    df = spark.createDataFrame([("f", 0, 2, 2, [(3, 1.5), (0, 2.5)]), ("f", 1, 1, 2, None)], "file string, chunk int, h int, w int, cells array<struct<i:int,v:double>>")
    assert {r.chunk: r.px for r in raster.fill_blocks(df).collect()} == {0: [2.5, None, None, 1.5], 1: [None, None]}


def test_features_in_bounds_and_pixels(spark):
    f = spark.createDataFrame([(1, [(1.0, 1.0), (3.0, 3.0)]), (2, [(9.0, 9.0)]), (3, [(4.0, 4.0), (6.0, 6.0)])], "id int, vertices array<struct<x:double,y:double>>")
    assert [r.id for r in spatial.in_bounds(f, 0, 0, 5, 5).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in spatial.in_bounds(f, 0, 0, 5, 5, strict=True).collect()] == [1]
    t = F.struct(F.lit(10.0).alias("a"), F.lit(300.0).alias("c"), F.lit(-10.0).alias("e"), F.lit(500.0).alias("f"))
    moved = spatial.to_pixels(spark.createDataFrame([([(310.0, 480.0)],)], "vertices array<struct<x:double,y:double>>"), t).first()
    assert (moved.vertices[0].x, moved.vertices[0].y) == (1.0, 2.0)


def test_lengths_slices_and_extrema(spark):
    cells = spark.createDataFrame([(0, "LAND 50"), (1, "SEA 50")], "chunk int, cell string")
    true = spark.createDataFrame([(k, 0) for k in range(2)], "chunk int, n int")
    assert evaluation.check_lengths(cells, true).count() == 2 and evaluation.check_lengths(cells, true.limit(1)).count() == 2
    with pytest.raises(Exception, match="predicted chunks: 2, label rows: 3"):
        evaluation.check_lengths(cells, true.union(true.limit(1))).collect()
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(predictions.CSV_HEADER + ["0,LAND 1,", "1,SEA 2,"])], "line_no bigint, value string")
    assert predictions.read_csv_lines(lines).count() == 2 and predictions.read_csv_lines(lines, 1).first().chunk == 0
    history = spark.createDataFrame([(1, 0.5), (2, 0.2), (3, 0.2), (4, None), (5, 0.5)], "epoch int, loss double")
    assert tuple(evaluation.extrema(history, "loss").first()) == (0.2, 2, 0.5, 1)


def test_vegetation_and_names(spark):
    from mereling.functions import names, pixels

    row = spark.range(1).select(
        pixels.evi(F.lit(5000), F.lit(1000), F.lit(500)).alias("evi"), names.true_colour_file(F.lit("T31UCU_1"), F.lit("10m")).alias("tci"), names.label_file(F.lit("31UCU"), F.lit(5000)).alias("label")).first()
    assert row.evi == pytest.approx(2.5 * 4000 / (5000 + 6000 - 3750 + 1)) and (row.tci, row.label) == ("T31UCU_1_TCI_10m.jp2", "31UCU-5000chunks.csv")


def test_convolution_gradients_are_slopes():
    r = np.random.default_rng(5)
    w = model.convolution_weights(3, side=9)
    images, labels = r.uniform(0, 255, (4, 9, 9)), np.array([0, 2, 1, 1])
    dropped = (r.random((4, 1, 1, 64)) >= 0.3) / 0.7
    loss, gradients = model.convolution_gradients(images, labels, w, dropped)
    assert [g.shape for g in gradients] == [x.shape for x in w]
    for k in range(10):
        for place in r.integers(0, w[k].size, 4):
            at = np.unravel_index(place, w[k].shape)
            sides = []
            for d in (1e-6, -1e-6):
                moved = [x.copy() for x in w]
                moved[k][at] += d
                sides.append(model.convolution_gradients(images, labels, moved, dropped)[0])
            assert gradients[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-4)
    plain, _ = model.convolution_gradients(images, labels, w)
    logits = model.convolution_forward(images, w)
    assert plain == pytest.approx(float(sum(np.log(np.exp(z).sum()) - z[y] for z, y in zip(logits, labels, strict=True))))


def test_augmentation():
    r = np.random.default_rng(1)
    images = r.uniform(0, 255, (20, 31, 31))
    same = model.augment(images, np.random.default_rng(0), turn=0.0, zoom=0.0)
    assert all(np.allclose(a, b) or np.allclose(a, b[:, ::-1]) for a, b in zip(same, images, strict=True)) and not np.allclose(same, images)
    moved = model.augment(images, r)
    assert moved.shape == images.shape and moved.min() >= 0 and moved.max() <= 255 and not np.allclose(moved, images)
    assert np.allclose(model.augment(np.full((3, 31, 31), 7.0), r), 7.0)


def test_convolution_learns_and_keeps_its_weights(spark, tmp_path):
    from mereling.config import Settings

    r = np.random.default_rng(3)
    rows = []
    for k in range(120):
        px = r.uniform(0, 60, (15, 15))
        if k % 2:
            px[4:11, 4:11] += 150  # a bright middle
        rows.append((k, px.ravel().tolist(), k % 2, 15, 15))
    df = spark.createDataFrame(rows, "key long, px array<double>, label int, h int, w int")
    settings = Settings(patch_side=15, batch=40, learning_rate=0.003)
    weights = model.fit_convolution(df, 2, settings=settings, epochs=6, workers=4)
    got = model.predict_convolution(df, weights, side=15).collect()
    assert np.mean([int(np.argmax(x.logits)) == x.label for x in got]) > 0.95
    again = model.fit_convolution(df.repartition(7), 2, settings=settings, epochs=1, workers=4)
    assert [w.shape for w in again] == [w.shape for w in weights]
    model.save_weights(spark, weights, str(tmp_path / "net"))
    assert all((a == b).all() for a, b in zip(weights, model.load_weights(spark, str(tmp_path / "net")), strict=True))


def test_driver_gets_one_sum_of_gradients_a_batch(spark, monkeypatch):
    from mereling.config import Settings

    r = np.random.default_rng(3)
    df = spark.createDataFrame([(k, r.normal(size=81).tolist(), k % 2) for k in range(60)], "key long, px array<double>, label int")
    got, collect = [], type(df).collect

    def seen(self):
        got.append(collect(self))
        return got[-1]

    monkeypatch.setattr(type(df), "collect", seen)
    model.fit_convolution(df, 2, settings=Settings(patch_side=9, batch=20), epochs=2, workers=4)
    assert len(got) == 6 and all(len(rows) == 1 for rows in got) and sum(rows[0]["n"] for rows in got) == 120
    parts = [(w, 1 + w, np.array([0.1 * 3**w, 1e16 * (-1) ** w])) for w in range(4)]
    whole = [model._added(pa.table({"worker": [p[0] for p in order], "n": [p[1] for p in order], "sums": [p[2].tobytes() for p in order]})).to_pylist() for order in (parts, parts[::-1])]
    assert whole[0] == whole[1] == [{"n": 10, "sums": sum(p[2] for p in parts).tobytes()}]


def test_window_of_stored_blocks(spark, tmp_path):
    from mereling.config import Settings
    from mereling.plans import stages

    pix = spark.range(23 * 17).select((F.col("id") / 17).cast("int").alias("y"), (F.col("id") % 17).cast("int").alias("x"), F.col("id").cast("double").alias("v"), F.lit("f").alias("file"))
    stages.chunk_blocks(pix, 23, 17, Settings(n_chunks=16)).write.parquet(str(tmp_path / "b"))
    blocks = spark.read.parquet(str(tmp_path / "b"))
    for y0, y1, x0, x1 in ((0, 23, 0, 17), (5, 7, 3, 12), (22, 40, -3, 1), (6, 6, 0, 5), (11, 12, 16, 17)):
        got = raster.read_window(blocks, 23, 17, 16, y0, y1, x0, x1)
        assert {(r.y, r.x, r.v) for r in got.collect()} == {(y, x, float(y * 17 + x)) for y in range(max(y0, 0), min(y1, 23)) for x in range(max(x0, 0), min(x1, 17))}
    plan = raster.read_window(blocks, 23, 17, 16, 5, 7, 3, 12)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(chunk," in plan


def test_confusion_at_all_thresholds_is_that_of_each(spark):
    """Ties, cells without a confidence, chunks that only one side has."""
    names = ["LAND", "RESERVOIRS", "SEA", "WATER-BODIES", "odd", "reservoir x"]
    cells = spark.createDataFrame([(c, names[(c * 7 + m * 5 + m * m) % 6] + (f" {(c * 31 + m * 17) % 12 * 9.0}" if (c + m) % 9 else "")) for c in range(40) for m in range(25)], "chunk int, cell string")
    rows = spark.createDataFrame([(c, c % 7, c % 5, c % 11 == 0) for c in range(5, 60)], "chunk int, reservoirs int, water_bodies int, sea boolean")
    true = evaluation.true_counts(rows)
    steps = [-1.0, 0.0, 9.0, 10.0, 27.0, 40.0, 54.0, 90.0, 99.0, 100.0, 100.5]
    got = {(r.threshold, r["class"]): (r.tp, r.tn, r.fp, r.fn, r.chunks) for r in evaluation.confusion_by_threshold(cells, true, steps).collect()}
    assert len(got) == 4 * len(steps)
    for t in steps:
        for r in evaluation.confusion(evaluation.predicted_counts(cells, t), true).collect():
            assert got[t, r["class"]] == (r.tp, r.tn, r.fp, r.fn, r.chunks), (t, r["class"])
