"""Label files: cleaning, checks, boxes, corrections, and the patches that labels cut out.

A file's lines are rows (file, line_no, value) with line 0 the header. Windows run within a file,
which has a line per chunk of one scene.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mereling.functions import grid, names, pixels

# The header of a label file, and where its boxes begin.
HEADER = "chunk,reservoirs,water-bodies,reservoir-coordinates,,,,,water-body-coordinates"
#: Fields of a line: chunk, two counts, five reservoir boxes, then any number of water-body boxes.
RESERVOIRS, BODIES = 3, 8


def fields(value: Column) -> Column:
    return F.split(F.rtrim(value), ",", -1)


def field(value: Column, i: int) -> Column:
    """Field i, from 0; null beyond the last."""
    return F.get(fields(value), F.lit(i))


def clean(lines: DataFrame) -> DataFrame:
    """Lines without the blank and malformed ones; the first two lines always stay. line_no is kept."""
    first = F.coalesce(field(F.col("value"), 0), F.lit(""))
    return lines.where((F.col("line_no") < 2) | first.rlike("^[0-9]+$") | F.contains(first, F.lit("chunk")))


def parse(lines: DataFrame) -> DataFrame:
    """Data lines as file, line_no, chunk, reservoirs, water_bodies and their raw cells."""
    cut = lines.where("line_no > 0").select("file", "line_no", fields(F.col("value")).alias("_f"))
    number = lambda i: F.get("_f", F.lit(i)).try_cast("int")
    return cut.select(
        "file", "line_no", number(0).alias("chunk"), F.coalesce(number(1), F.lit(0)).alias("reservoirs"), F.coalesce(number(2), F.lit(0)).alias("water_bodies"),
        F.slice("_f", RESERVOIRS + 1, BODIES - RESERVOIRS).alias("res_cells"), F.slice("_f", BODIES + 1, F.greatest(F.size("_f") - BODIES, F.lit(0))).alias("body_cells"))


def gaps(lines: DataFrame) -> DataFrame:
    """Rows after which the chunk doesn't go up by one: file, line_no, chunk, next_chunk."""
    order = Window.partitionBy("file").orderBy("line_no")
    rows = parse(lines).withColumn("next_chunk", F.lead("chunk").over(order))
    return rows.where("next_chunk - chunk <> 1").select("file", "line_no", "chunk", "next_chunk")


def last_chunk(lines: DataFrame) -> DataFrame:
    """Where to resume: one past the last line's chunk, per file."""
    return parse(lines).groupBy("file").agg((F.max_by("chunk", "line_no") + 1).alias("resume_at"))


def _given(cells: Column) -> Column:
    return F.coalesce(F.startswith(F.get(cells, F.lit(0)), F.lit("[")), F.lit(False))


def incomplete(lines: DataFrame) -> DataFrame:
    """Rows whose counts and coordinates disagree: file, row (from 0), and which way."""
    order = Window.partitionBy("file").orderBy("line_no")
    rows = parse(lines).withColumn("row", (F.row_number().over(order) - 1).cast("bigint"))
    res, body = _given(F.col("res_cells")), _given(F.col("body_cells"))
    marked = rows.select(
        "file", "row", ((F.col("reservoirs") != 0) & ~res).alias("res_missing"), ((F.col("reservoirs") == 0) & res).alias("res_extra"),
        ((F.col("water_bodies") != 0) & ~body).alias("body_missing"), ((F.col("water_bodies") == 0) & body).alias("body_extra"))
    return marked.where("res_missing or res_extra or body_missing or body_extra")


def is_sea(bodies: Column, first_cell: Column, single: bool = False) -> Column:
    """A water body over the whole chunk width; single: and it is the only one (the rule of evaluation)."""
    whole = grid.let(grid.coords(first_cell), lambda n: (F.get(n, F.lit(0)) == 0) & (F.try_element_at(n, F.lit(-1)) == grid.CHUNK_SIDE))
    return F.coalesce((bodies == 1 if single else bodies > 0) & whole, F.lit(False))


def boxes(lines: DataFrame) -> DataFrame:
    """One row per labelled box: file, line_no, chunk, class, k (from 0), box; land and sea have the placeholder.

    A count of n takes the first n cells of its kind; a row may feed both kinds; land has neither.
    A cell that isn't four numbers has a null box.
    """
    rows = parse(lines).withColumn("sea", is_sea(F.col("water_bodies"), F.get("body_cells", F.lit(0))))
    cells = lambda name, n: F.slice(name, 1, F.greatest(n, F.lit(0)))
    kinds = [
        ("reservoirs", F.col("reservoirs") > 0, cells("res_cells", F.col("reservoirs"))),
        ("water-bodies", (F.col("water_bodies") > 0) & ~F.col("sea"), cells("body_cells", F.col("water_bodies"))),
        ("sea", F.col("sea"), F.array(F.lit(grid.PLACEHOLDER))),
        ("land", (F.col("reservoirs") == 0) & (F.col("water_bodies") == 0), F.array(F.lit(grid.PLACEHOLDER))),
    ]
    none = F.array().cast("array<struct<class:string,k:int,cell:string>>")

    def listed(name: str, cells: Column) -> Column:
        return F.transform(cells, lambda cell, k: F.struct(F.lit(name).alias("class"), k.alias("k"), cell.alias("cell")))

    every = F.flatten(F.array(*(F.when(ok, listed(name, c)).otherwise(none) for name, ok, c in kinds)))
    out = rows.select("file", "line_no", "chunk", F.explode(every).alias("b"))
    return out.select("file", "line_no", "chunk", F.col("b.class").alias("class"), F.col("b.k").alias("k"), grid.fixed_box(grid.box_of(grid.coords(F.col("b.cell")))).alias("box"))


def correct(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """`lines` with the values of `corrections` (file, line_no, value) in their place."""
    new = corrections.select("file", "line_no", F.col("value").alias("_new"))
    return lines.join(new, ["file", "line_no"], "left").select("file", "line_no", F.coalesce("_new", "value").alias("value"))


def undo(lines: DataFrame, n: int) -> DataFrame:
    """`lines` without the last n data lines of each file."""
    last = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    return lines.join(last, "file").where(F.greatest(F.col("_last") - n, F.lit(0)) >= F.col("line_no")).drop("_last")


def to_line(values: Column) -> Column:
    """The text of a row: its values with commas."""
    return F.concat_ws(",", values)


def unique_sorted(arrays: Column) -> Column:
    """The distinct values of some arrays, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(arrays)))


def patches(box_rows: DataFrame, blocks: DataFrame, align: str = "chunk", share: float = pixels.LABEL_SHARE) -> DataFrame:
    """Grey patches: file, class, idx, h, w, px. blocks: (file, chunk, h, w, px array<double>) of one scene per file.

    Chunks without any value are dropped first. align: what a label row stands for. 'chunk': the
    chunk it names; 'ordinal': the row's place in the file, counted over the chunks that are left
    (how the published tables were cut; after a dropped chunk, it means another one). idx numbers
    the saved patches of a class of a file by line and box. Bounds are those of the file.
    """
    seen = blocks.where(F.exists("px", lambda v: v.isNotNull()))
    low_high = seen.groupBy("file").agg(F.min(F.array_min("px")).alias("low"), (F.lit(share) * F.max(F.array_max("px"))).alias("high"))
    if align == "ordinal":  # numbered without their pixels
        numbers = seen.select("file", "chunk", (F.row_number().over(Window.partitionBy("file").orderBy("chunk")) - 1).alias("ordinal"))
        seen = seen.join(numbers, ["file", "chunk"])
    key = "ordinal" if align == "ordinal" else "chunk"
    wanted = box_rows.where("box is not null").withColumn("_at", (F.col("line_no") - 1).cast("int") if align == "ordinal" else F.col("chunk"))
    cut = wanted.select("file", "line_no", "class", "k", "box", "_at").join(seen.select("file", F.col(key).alias("_at"), "h", "w", "px"), ["file", "_at"]).join(low_high, "file")
    cut = cut.withColumn("win", grid.pixel_box(F.col("box"), F.col("h"), F.col("w"))).where("win.y1 > win.y0 and win.x1 > win.x0")
    cut = cut.withColumn("px", pixels.grey_block(grid.crop_rows(F.col("px"), F.col("w"), F.col("win")), F.col("low"), F.col("high")))
    order = Window.partitionBy("file", "class").orderBy("line_no", "k")
    return cut.select("file", "class", (F.row_number().over(order) - 1).cast("bigint").alias("idx"), (F.col("win.y1") - F.col("win.y0")).alias("h"), (F.col("win.x1") - F.col("win.x0")).alias("w"), "px")


def named_patches(rows: DataFrame, tile: Column, date: Column) -> DataFrame:
    return rows.withColumn("name", names.patch_name(tile, date, F.col("idx")))
