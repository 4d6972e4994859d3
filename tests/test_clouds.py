"""Stitched predictions against those of the whole image."""

import numpy as np
import pytest

from mereling.functions import grid
from mereling.operators import clouds


def box_mean(planes, reach=1):
    """A linear predictor with a neighbourhood: zeros beyond the patch, as a convolution pads."""
    n, h, w = planes.shape
    wide = np.pad(planes, ((0, 0), (reach, reach), (reach, reach)))
    mean = sum(wide[:, y : y + h, x : x + w] for y in range(2 * reach + 1) for x in range(2 * reach + 1)) / (2 * reach + 1) ** 2
    return np.stack((mean[0] - 2 * mean[1], mean[1] + planes[0], 0.5 * mean[0] + planes[1]))


def blocks_of(spark, images, k):
    h, w = images[0].shape[1:]
    rows, cols = clouds._cuts(h, k), clouds._cuts(w, k)
    out = []
    for s, image in enumerate(images):
        for r in range(k):
            for c in range(k):
                part = image[:, rows[r] : rows[r + 1], cols[c] : cols[c + 1]]
                out.append((f"s{s}", r * k + c, part.shape[1], part.shape[2], *[[None if np.isnan(v) else float(v) for v in plane.ravel()] for plane in part]))
    return spark.createDataFrame(out, "scene string, chunk int, h int, w int, red array<double>, nir array<double>")


def whole(rows, k, shape, n):
    height, width = shape
    ys, xs = clouds._cuts(height, k), clouds._cuts(width, k)
    out = np.full((n, height, width), np.nan)
    for r in rows:
        y, x = divmod(r.chunk, k)
        out[:, ys[y] : ys[y + 1], xs[x] : xs[x + 1]] = np.array(r.scores).reshape(n, r.h, r.w)
    return out


@pytest.mark.parametrize("k, overlap, reach", [(1, 0, 1), (3, 3, 1), (4, 5, 3), (3, 2, 0)])
def test_stitched_equals_the_whole_image(spark, k, overlap, reach):
    r = np.random.default_rng(k)
    images = [r.normal(size=(2, 23, 29)) for _ in range(2)]
    images[0][0, 5, 5] = np.nan
    rows = clouds.blended_classes(blocks_of(spark, images, k), lambda p: box_mean(p, reach), 3, 23, 29, k * k, overlap, ("red", "nir"), reach).collect()
    assert len(rows) == 2 * k * k
    for s, image in enumerate(images):
        want = box_mean(np.nan_to_num(image), reach)
        own = [x for x in rows if x.scene == f"s{s}"]
        assert np.allclose(whole(own, k, (23, 29), 3), want)
        assert all(np.array_equal(np.array(x.cls), np.array(x.scores).reshape(3, -1).argmax(axis=0)) for x in own)


def test_many_scenes_at_once(spark):
    """Scenes share batches, one lacks a block (zeros), the order of rows doesn't matter; no call to Python for each block."""
    r = np.random.default_rng(5)
    images = [r.normal(size=(2, 11, 13)) for _ in range(40)]
    images[7][:, 4:8, 5:9] = 0  # the block that is missing
    blocks = blocks_of(spark, images, 3).where("not (scene = 's7' and chunk = 4)")
    stitched = lambda df: clouds.blended_classes(df, box_mean, 3, 11, 13, 9, 3, ("red", "nir"))
    assert "FlatMapGroups" not in stitched(blocks)._jdf.queryExecution().optimizedPlan().toString()
    rows = {(x.scene, x.chunk): x for x in stitched(blocks).collect()}
    assert len(rows) == 360
    for s, image in enumerate(images):
        assert np.allclose(whole([x for (scene, _), x in rows.items() if scene == f"s{s}"], 3, (11, 13), 3), box_mean(image))
    again = stitched(blocks.repartition(3, "h").orderBy("w", "scene")).collect()
    assert all(x == rows[x.scene, x.chunk] for x in again)


def test_no_seams_of_predictors_that_differ_by_patch(spark):
    """Each patch is predicted as its own mean: across a border the blend moves in small steps, without a blend in one."""
    image = np.repeat(np.linspace(0, 90, 60)[None, :], 60, axis=0)[None].repeat(2, axis=0)
    level = lambda p: np.stack((np.full(p.shape[1:], p[0].mean()), np.zeros(p.shape[1:])))
    jump = {}
    for overlap in (0, 8):
        rows = clouds.blended_classes(blocks_of(spark, [image], 3), level, 2, 60, 60, 9, overlap, ("red", "nir")).collect()
        jump[overlap] = np.abs(np.diff(whole(rows, 3, (60, 60), 2)[0], axis=1)).max()
    assert jump[0] > 25 and jump[8] < 5


def test_parts_are_those_of_the_grid(spark):
    from pyspark.sql import functions as F

    for n, k in ((23, 4), (10980, 70), (5, 5)):
        cuts = [r.c for r in spark.range(k).select(grid.part_start(F.col("id"), F.lit(n), k).alias("c")).orderBy("c").collect()]
        assert cuts == clouds._cuts(n, k)[:-1].tolist()
    with pytest.raises(ValueError, match="overlap"):
        clouds.Patches(20, 20, 16, 6)
