"""Names of scenes, bands, patches and mini-chunks, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SCENE_FIELDS = ("satellite", "product_level", "sensing_time", "baseline", "orbit", "tile", "discriminator")
# Band numbers by resolution.
BANDS_10M = {"blue": "02", "green": "03", "red": "04", "nir": "08"}
BANDS_20M = {"blue": "02", "green": "03", "red": "04", "nir": "8A", "swir1": "11", "swir2": "12"}
SUFFIX = ".SAFE"


def scene_fields(name: Column) -> Column:
    """The seven fields of a scene name as a struct; null where there aren't seven."""
    bare = F.regexp_replace(name, r"\.SAFE$", "")
    parts = F.split(bare, "_")
    fields = [F.element_at(parts, i + 1).alias(f) for i, f in enumerate(SCENE_FIELDS)]
    return F.when(F.size(parts) == len(SCENE_FIELDS), F.struct(*fields))


def is_scene(name: Column) -> Column:
    """Whether a folder name is that of a scene: longer than 10 and with the suffix after the fifth character."""
    return (F.length(name) > 10) & F.contains(F.substring(name, 6, 1000), F.lit(SUFFIX))


def scene_prefix(fields: Column) -> Column:
    return F.concat_ws("_", fields["tile"], fields["sensing_time"])


def sensed_at(fields: Column) -> Column:
    return F.to_timestamp_ntz(fields["sensing_time"], F.lit("yyyyMMdd'T'HHmmss"))


def sensing_date(text: Column) -> Column:
    """The part before the T."""
    return F.substring_index(text, "T", 1)


def band_file(prefix: Column, band: Column, resolution: Column) -> Column:
    """The file of a band: {prefix}_B{band}_{resolution}.jp2."""
    return F.concat(prefix, F.lit("_B"), band, F.lit("_"), resolution, F.lit(".jp2"))


def true_colour_file(prefix: Column, resolution: Column) -> Column:
    """The file of the true-colour image: {prefix}_TCI_{resolution}.jp2."""
    return F.concat(prefix, F.lit("_TCI_"), resolution, F.lit(".jp2"))


def index_bands(high_res: bool) -> dict[str, str]:
    """The bands that the water index needs, by role."""
    table = BANDS_10M if high_res else BANDS_20M
    return {role: table[role] for role in ("green", "nir", "red")}


def patch_name(tile: Column, date: Column, index: Column) -> Column:
    """{tile}-{date}-{index, four digits}.png; longer indices keep all digits."""
    digits = index.cast("string")
    return F.concat(tile, F.lit("-"), date, F.lit("-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(".png"))


def chunk_key(name: Column) -> Column:
    """(chunk, minichunk) of a file name like `ndwi chunk 12 minichunk 3.png`; (-1, -1) for others."""
    pattern = r"chunk\s+(\d+)\s+minichunk\s+(\d+)"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).try_cast("int"), F.lit(-1))
    return F.struct(part(1).alias("chunk"), part(2).alias("minichunk"))


def prediction_file(chunks: Column, epochs: Column, tile: Column) -> Column:
    return F.concat(F.lit("P_"), chunks.cast("string"), F.lit("_"), epochs.cast("string"), F.lit("_"), tile, F.lit(".csv"))


def label_file(tile: Column, chunks: Column) -> Column:
    return F.concat(tile, F.lit("-"), chunks.cast("string"), F.lit("chunks.csv"))


def hms(seconds: Column) -> Column:
    """(hours, minutes, seconds) of a non-negative number of seconds, rounded down; null for others."""
    whole = F.floor(seconds).cast("bigint")
    return F.when(seconds >= 0, F.struct(F.floor(whole / 3600).cast("bigint").alias("hours"), F.floor(whole % 3600 / 60).cast("bigint").alias("minutes"), (whole % 60).alias("seconds")))
