"""Column functions on values worked out by hand, and by NumPy."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mereling.functions import grid, names, pixels


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("ulx", "uly", "lrx", "lry"), strict=True)))


@pytest.mark.parametrize("green,nir,want", [(3, 1, 0.5), (0, 0, None), (None, 1, None)])
def test_ndwi(spark, green, nir, want):
    assert one(spark, pixels.ndwi(F.lit(green).cast("int"), F.lit(nir).cast("int"))) == want


def test_ndwi_matches_float32(spark):
    r = np.random.default_rng(0)
    g, n = r.integers(0, 65536, 5000), r.integers(1, 65536, 5000)
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(g, n, strict=True))], "i int, g int, n int")
    got = [x.v for x in rows.select("i", pixels.ndwi(F.col("g"), F.col("n")).cast("float").alias("v")).orderBy("i").collect()]
    a, b = g.astype(np.float32), n.astype(np.float32)
    assert np.array_equal(np.array(got, np.float32), (a - b) / (a + b))


@pytest.mark.parametrize("v,low,high,want", [(None, 0, 1, 128), (0.2, 0.2, 0.9, 0), (5, 0.2, 0.9, 255), (3, 1, 1, 0), (0.5, 0, 1, 127), (-1, 0, 1, 0), (None, 1, 1, 128)])
def test_grey(spark, v, low, high, want):
    assert one(spark, pixels.to_grey(F.lit(v).cast("double"), F.lit(float(low)), F.lit(float(high)))) == want


@pytest.mark.parametrize("given_box,want", [((50, 50, 55, 55), (36.8, 36.8, 68.2, 68.2)), ((0, 0, 10, 10), (0, 0, 31.4, 31.4)), ((150, 150, 157, 157), (125.6, 125.6, 157, 157)), ((0, 0, 157, 157), (62.8, 62.8, 94.2, 94.2)), ((5, 5, 5, 9), None)])
def test_fixed_box(spark, given_box, want):
    got = one(spark, grid.fixed_box(box(*given_box)))
    assert got is None if want is None else tuple(got) == pytest.approx(want)


@pytest.mark.parametrize("given_box,shape", [((36.8, 36.8, 68.2, 68.2), (32, 32)), ((0, 0, 31.4, 31.4), (31, 31)), ((125.6, 125.6, 157, 157), (32, 32)), ((-5, 150, 3.9, 400), (7, 3))])
def test_pixel_box(spark, given_box, shape):
    w = one(spark, grid.pixel_box(box(*given_box), F.lit(157), F.lit(157)))
    assert (w.y1 - w.y0, w.x1 - w.x0) == shape


def test_mini_windows(spark):
    w = one(spark, grid.mini_windows(F.lit(157), F.lit(156)))
    assert [(m.y0, m.y1) for m in w[:5]] == [(0, 31), (31, 62), (62, 94), (94, 125), (125, 157)]
    assert [(m.x0, m.x1) for m in w[::5]] == [(0, 31), (31, 62), (62, 93), (93, 124), (124, 156)]
    assert w[1].minichunk == 1 and w[1].x0 == 0 and w[1].y0 == 31  # column 0, row 1


@pytest.mark.parametrize("n,k", [(10980, 70), (23, 5), (8, 3), (3, 5), (157, 1)])
def test_parts_are_those_of_array_split(spark, n, k):
    got = [r.p for r in spark.range(n).select(grid.part(F.col("id"), F.lit(n), k).alias("p"), "id").orderBy("id").collect()]
    assert got == [i for i, a in enumerate(np.array_split(np.arange(n), k)) for _ in a]
    starts = [r.s for r in spark.range(min(k, n)).select(grid.part_start(F.col("id"), F.lit(n), k).alias("s"), "id").orderBy("id").collect()]
    assert starts == [int(a[0]) for a in np.array_split(np.arange(n), k) if len(a)]
    assert grid.per_side(5000) ** 2 == 4900


@pytest.mark.parametrize("text,want", [("[ 10. 20. 30. 40.]", [10, 20, 30, 40]), ("[1 2]", [1, 2]), ("[a 2]", []), ("", []), (None, [])])
def test_coords(spark, text, want):
    assert one(spark, grid.coords(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("ndwi chunk 12 minichunk 3.png", (12, 3)), ("other.png", (-1, -1)), ("chunk 99999999999 minichunk 1", (-1, 1)), (None, (-1, -1))])
def test_chunk_key(spark, name, want):
    assert tuple(one(spark, names.chunk_key(F.lit(name).cast("string")))) == want


def test_scene_name(spark):
    f = names.scene_fields(F.lit("S2C_MSIL2A_20250331T110651_N0511_R137_T31UCU_20250331T143812.SAFE"))
    assert one(spark, names.scene_prefix(f)) == "T31UCU_20250331T110651"
    assert str(one(spark, names.sensed_at(f))) == "2025-03-31 11:06:51"
    assert one(spark, names.scene_fields(F.lit("a_b.SAFE"))) is None
    assert names.index_bands(False) == {"green": "03", "nir": "8A", "red": "04"}
    assert one(spark, names.patch_name(F.lit("T"), F.lit("20250331"), F.lit(7))) == "T-20250331-0007.png"
    assert one(spark, names.prediction_file(F.lit(5), F.lit(150), F.lit("T"))) == "P_5_150_T.csv"


@pytest.mark.parametrize("s,want", [(3661.9, (1, 1, 1)), (0, (0, 0, 0)), (-1, None), (360000.0, (100, 0, 0))])
def test_hms(spark, s, want):
    got = one(spark, names.hms(F.lit(float(s))))
    assert got is None if want is None else tuple(got) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-30, 30), min_size=4, max_size=4))
def test_softmax(spark, z):
    got = spark.createDataFrame([(z,)], "z array<double>").select(pixels.softmax(F.col("z")).alias("s"), pixels.best_class(F.col("z"), ("a", "b", "c", "d")).alias("c")).first()
    e = np.exp(np.array(z) - max(z))
    assert got.s == pytest.approx(list(e / e.sum())) and got.c == "ABCD"[int(np.argmax(z))]


def test_roi_and_bounds(spark):
    assert tuple(one(spark, grid.roi_to_pixels(F.lit(600.0), F.lit(-3.0), F.lit(250.0), F.lit(100.0), F.lit(157)))) == pytest.approx((78.5, 0, 157, 31.4))
    t = F.struct(F.lit(10.0).alias("a"), F.lit(3e5).alias("c"), F.lit(-10.0).alias("e"), F.lit(59e5).alias("f"))
    assert tuple(one(spark, grid.image_bounds(t, F.lit(100), F.lit(50)))) == (3e5, 59e5 - 500, 3e5 + 1000, 59e5)
