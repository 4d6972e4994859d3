"""The grid of a scene: chunks, mini-chunks, boxes and crops, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sides of a chunk and of a patch box in pixels, mini-chunks along a side, and the
# placeholder box of land and sea patches.
CHUNK_SIDE, BOX_SIDE, MINI = 157.0, 31.4, 5
PLACEHOLDER = "[50.0 50.0 55.0 55.0]"
BOX = "struct<ulx:double,uly:double,lrx:double,lry:double>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def per_side(n_chunks: int) -> int:
    """Chunks along one side for a requested number of chunks."""
    return int(n_chunks**0.5)


def part(i: Column, n: Column, k: int) -> Column:
    """Which of k nearly equal parts of 0 .. n-1 has i, the longer parts first."""
    size, longer = F.floor(n / k).cast("bigint"), (n % k).cast("bigint")
    edge = longer * (size + 1)
    return F.when(i < edge, F.floor(i / (size + 1))).otherwise(longer + F.floor((i - edge) / F.greatest(size, F.lit(1)))).cast("bigint")


def part_start(p: Column, n: Column, k: int) -> Column:
    """The first of part p."""
    return (p * F.floor(n / k) + F.least(p, n % k)).cast("bigint")


def chunk_of(y: Column, x: Column, height: Column, width: Column, n_chunks: int) -> Column:
    """The row-major chunk of a pixel."""
    k = per_side(n_chunks)
    return part(y, height, k) * k + part(x, width, k)


def chunk_place(chunk: Column, k: int) -> Column:
    """(row, column) of a chunk."""
    return F.struct(F.floor(chunk / k).cast("int").alias("row"), (chunk % k).cast("int").alias("col"))


def mini_windows(height: Column, width: Column) -> Column:
    """The 25 windows of a chunk, as an array; index = column * 5 + row, bounds rounded down."""
    cut = lambda side, i: F.floor(side * i / MINI).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(MINI * MINI - 1)), lambda m: F.struct(
        m.alias("minichunk"), cut(height, m % MINI).alias("y0"), cut(height, m % MINI + 1).alias("y1"),
        cut(width, F.floor(m / MINI)).alias("x0"), cut(width, F.floor(m / MINI) + 1).alias("x1")))


def fixed_box(box: Column) -> Column:
    """A box of fixed side around the centre of another, shifted into the chunk; null where upper left isn't before lower right."""
    low = lambda a, b: F.least(F.greatest((a + b) / 2 - BOX_SIDE / 2, F.lit(0.0)), F.lit(CHUNK_SIDE - BOX_SIDE))

    def moved(box: Column) -> Column:
        x, y = low(box["ulx"], box["lrx"]), low(box["uly"], box["lry"])
        return F.when((box["ulx"] < box["lrx"]) & (box["uly"] < box["lry"]), F.struct(x.alias("ulx"), y.alias("uly"), (x + BOX_SIDE).alias("lrx"), (y + BOX_SIDE).alias("lry")))

    return let(box, moved)


def coords(text: Column) -> Column:
    """The numbers of a bracketed cell; an empty array if any isn't one."""
    parts = F.split(F.trim(F.translate(text, "[]", "")), r"\s+")
    none = F.array().cast("array<double>")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    return F.coalesce(let(numbers, lambda n: F.when(F.exists(n, lambda x: x.isNull()), none).otherwise(n)), none)


def box_of(numbers: Column) -> Column:
    """A box from four numbers; null for another count."""
    at = lambda n, i: F.get(n, F.lit(i))
    return let(numbers, lambda n: F.when(F.size(n) == 4, F.struct(at(n, 0).alias("ulx"), at(n, 1).alias("uly"), at(n, 2).alias("lrx"), at(n, 3).alias("lry"))))


def pixel_box(box: Column, height: Column, width: Column) -> Column:
    """The half-open pixel window of a box: truncated and clamped to the image."""
    clamp = lambda v, hi: F.least(F.greatest(v.cast("int"), F.lit(0)), hi.cast("int"))
    return F.struct(clamp(box["uly"], height).alias("y0"), clamp(box["lry"], height).alias("y1"), clamp(box["ulx"], width).alias("x0"), clamp(box["lrx"], width).alias("x1"))


def roi_to_pixels(x0: Column, y0: Column, x1: Column, y1: Column, side: Column, canvas: float = 500.0) -> Column:
    """A region drawn on a canvas: corners ordered, clamped to the canvas, scaled to the chunk."""
    scale = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(canvas)) * side / canvas
    return F.struct(scale(F.least(x0, x1)).alias("ulx"), scale(F.least(y0, y1)).alias("uly"), scale(F.greatest(x0, x1)).alias("lrx"), scale(F.greatest(y0, y1)).alias("lry"))


def image_bounds(transform: Column, width: Column, height: Column) -> Column:
    """(left, bottom, right, top) of an image with affine transform a, c, e, f."""
    return F.struct(transform["c"].alias("left"), (transform["f"] + height * transform["e"]).alias("bottom"), (transform["c"] + width * transform["a"]).alias("right"), transform["f"].alias("top"))


def crop_rows(block: Column, width: Column, window: Column) -> Column:
    """The pixels of a window of a row-major block, row-major."""
    return F.flatten(F.transform(
        F.when(window["y1"] > window["y0"], F.sequence(window["y0"], window["y1"] - 1)).otherwise(F.array().cast("array<int>")),
        lambda y: F.slice(block, y * width + window["x0"] + 1, window["x1"] - window["x0"])))


def _draw(key: Column, what: str, n: int) -> Column:
    """A number in 0 .. n-1 from a hash of a key: the same in every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(what))), 1, 6), 16, 10).cast("bigint") % n


def random_box(key: Column, low: int = 0, high: int = 157) -> Column:
    """A box with whole corners in low .. high, upper left before lower right."""
    span = high - low
    first = F.struct(_draw(key, "x0", span).alias("x"), _draw(key, "y0", span).alias("y"))

    def box(p: Column) -> Column:
        x1, y1 = p["x"] + 1 + _draw(key, "x1", 1 << 20) % (span - p["x"]), p["y"] + 1 + _draw(key, "y1", 1 << 20) % (span - p["y"])
        return F.struct(*((v + low).cast("double").alias(n) for n, v in (("ulx", p["x"]), ("uly", p["y"]), ("lrx", x1), ("lry", y1))))

    return let(first, box)


def nine_boxes(box: Column, key: Column, side: float = CHUNK_SIDE) -> Column:
    """A box's 3 x 3 parts, row by row, each moved by 0 to 2 pixels either way and clamped to the chunk."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(side))

    def part_box(box: Column, i: int) -> Column:
        width, height = (box["lrx"] - box["ulx"]) / 3, (box["lry"] - box["uly"]) / 3
        corner = F.struct((box["ulx"] + width * (i % 3) + _draw(key, f"dx{i}", 3)).alias("x"), (box["uly"] + height * (i // 3) + _draw(key, f"dy{i}", 3)).alias("y"))
        return let(corner, lambda c: F.struct(clamp(c["x"]).alias("ulx"), clamp(c["y"]).alias("uly"), clamp(c["x"] + width).alias("lrx"), clamp(c["y"] + height).alias("lry")))

    return let(box, lambda box: F.array(*(part_box(box, i) for i in range(9))))
