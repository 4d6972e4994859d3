"""Pixel arithmetic, as column expressions. Null is no data; NaN never enters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masked classes, shares of the greatest value that is white (labels, predictions), and
# the grey of no data.
CLOUD_CLASSES, URBAN_CLASSES = (1, 2, 3), (20, 21)
LABEL_SHARE, PREDICT_SHARE, NO_DATA = 0.4, 0.41, 128


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return (a - b) / F.nullif(a + b, F.lit(0))


def ndwi(green: Column, nir: Column) -> Column:
    return ratio(green.cast("double"), nir.cast("double"))


def ndvi(nir: Column, red: Column) -> Column:
    return ratio(nir.cast("double"), red.cast("double"))


def evi2(nir: Column, red: Column) -> Column:
    nir, red = nir.cast("double"), red.cast("double")
    return 2.4 * (nir - red) / F.nullif(nir + red + 1, F.lit(0))


def evi(nir: Column, red: Column, blue: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, ground: float = 1.0) -> Column:
    """The enhanced vegetation index, with its usual coefficients; null where the denominator is 0."""
    nir, red, blue = (v.cast("double") for v in (nir, red, blue))
    return gain * (nir - red) / F.nullif(nir + c1 * red - c2 * blue + ground, F.lit(0.0))


def no_nan(v: Column) -> Column:
    return F.nanvl(v, F.lit(None).cast("double"))


def unless(hidden: Column, v: Column) -> Column:
    """v, or null where hidden."""
    return F.when(hidden, None).otherwise(v)


def to_grey(v: Column, low: Column, high: Column) -> Column:
    """0 .. 255 between low and high, rounded down; 0 where they are equal, 128 where v is null."""
    clipped = F.least(F.greatest(v, low), high)
    return F.when(v.isNull(), NO_DATA).when(low == high, 0).otherwise(F.floor((clipped - low) / F.nullif(high - low, F.lit(0)) * 255)).cast("int")


def unit_to_grey(v: Column) -> Column:
    """A value in 0 .. 1 as 0 .. 255."""
    return F.floor(255 * F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).cast("int")


def ndwi_block(green: Column, nir: Column) -> Column:
    """NDWI of two blocks of pixels."""
    return F.zip_with(green, nir, ndwi)


def mask_block(values: Column, classes: Column, hidden: tuple[int, ...] = CLOUD_CLASSES) -> Column:
    """A block with null where the block of classes is one of `hidden`."""
    return F.zip_with(values, classes, lambda v, c: F.when(c.isin(*hidden), None).otherwise(v))


def grey_block(values: Column, low: Column, high: Column) -> Column:
    return F.transform(values, lambda v: to_grey(v, low, high))


def softmax(logits: Column) -> Column:
    """The shares of an array of logits."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return F.transform(parts, lambda v: v / total)


def confidence(logits: Column) -> Column:
    """The largest share, in percent."""
    return 100 * F.array_max(softmax(logits))


def best_class(logits: Column, names: tuple[str, ...]) -> Column:
    """The name, in capitals, of the largest logit; the first of equals."""
    return F.upper(F.element_at(F.array(*map(F.lit, names)), F.array_position(logits, F.array_max(logits)).cast("int")))
