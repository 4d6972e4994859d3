"""Count-based confusion and metrics: per chunk and class, predicted against true counts of cells."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mereling.operators import labels

CELLS = 25
CLASSES = ("land", "reservoirs", "sea", "water_bodies")


def cell_class(cell: Column, threshold: float) -> Column:
    """The class that a cell counts for: reservoirs and water bodies below the threshold count as land."""
    text = F.replace(F.lower(F.trim(cell)), F.lit("-"), F.lit(" "))
    conf = F.coalesce(F.element_at(F.split(F.trim(cell), " "), -1).try_cast("double"), F.lit(100.0))
    sure = conf >= threshold
    has = lambda s: F.contains(text, F.lit(s))
    return F.when(has("reservoir"), F.when(sure, "reservoirs").otherwise("land")).when(has("water bod"), F.when(sure, "water_bodies").otherwise("land")).when(
        has("land"), "land").when(has("sea"), "sea")


def predicted_counts(cells: DataFrame, threshold: float) -> DataFrame:
    """(chunk, cell) -> a row per chunk with a count per class."""
    kind = cell_class(F.col("cell"), threshold)
    return cells.groupBy("chunk").agg(*(F.count_if(kind == c).alias(f"p_{c}") for c in CLASSES))


def true_counts(rows: DataFrame) -> DataFrame:
    """Label rows (chunk, reservoirs, water_bodies, sea) -> a count of cells per class."""
    n = {"land": CELLS - F.col("reservoirs") - F.col("water_bodies"), "reservoirs": F.col("reservoirs"), "sea": F.lit(0), "water_bodies": F.col("water_bodies")}
    return rows.select("chunk", *(F.when(F.col("sea"), CELLS if c == "sea" else 0).otherwise(n[c]).cast("bigint").alias(f"n_{c}") for c in CLASSES))


def responses(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Label lines (file, line_no, value) as (chunk by place, reservoirs, water_bodies, sea), the first `limit` of them (None: all)."""
    rows = labels.parse(lines if limit is None else lines.where(F.col("line_no") <= limit))
    sea = labels.is_sea(F.col("water_bodies"), F.get("body_cells", F.lit(0)), single=True)
    return rows.select((F.col("line_no") - 1).cast("int").alias("chunk"), "reservoirs", "water_bodies", sea.alias("sea"))


def confusion(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """One row per class: tp, tn, fp, fn over the chunks that both have, and how many those are."""
    both = predicted.join(true, "chunk")
    kinds = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("p"), F.col(f"n_{c}").alias("n")) for c in CLASSES))
    rows = both.select(F.explode(kinds).alias("k")).select("k.*")
    return rows.groupBy("class").agg(
        F.sum(F.least("p", "n")).alias("tp"), F.sum(CELLS - F.greatest("p", "n")).alias("tn"),
        F.sum(F.greatest(F.col("p") - F.col("n"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("n") - F.col("p"), F.lit(0))).alias("fn"), F.count(F.lit(1)).alias("chunks"))


def confusion_by_threshold(cells: DataFrame, true: DataFrame, thresholds: list[float]) -> DataFrame:
    """`confusion` at every threshold, in one pass over the cells: threshold, class, tp, tn, fp, fn, chunks.

    The r-th surest of a chunk's reservoirs counts while the threshold isn't above its confidence, as a hit if r is at
    most the true number, else as a false one; so a threshold's counts are the sums of a histogram of confidences
    from it on. Land gains the unsure cells, the least sure first: the same from the other end.
    """
    steps = sorted(set(map(float, thresholds)))
    text = F.replace(F.lower(F.trim("cell")), F.lit("-"), F.lit(" "))
    kind = F.when(F.contains(text, F.lit("reservoir")), "reservoirs").when(F.contains(text, F.lit("water bod")), "water_bodies").when(F.contains(text, F.lit("land")), "land").when(F.contains(text, F.lit("sea")), "sea")
    conf = F.coalesce(F.element_at(F.split(F.trim("cell"), " "), -1).try_cast("double"), F.lit(100.0))
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("conf")))  # how many thresholds it passes
    rows = cells.select("chunk", kind.alias("kind"), conf.alias("conf")).join(true, "chunk").withColumn("reached", reached)
    open_ = F.col("kind").isin("reservoirs", "water_bodies")
    chunk = Window.partitionBy("chunk")
    ranked = rows.select(
        "*", F.row_number().over(Window.partitionBy("chunk", "kind").orderBy(F.desc("conf"))).alias("place"), F.count_if(F.col("kind") == "land").over(chunk).alias("land"),
        F.count_if(open_).over(chunk.orderBy("conf").rowsBetween(Window.unboundedPreceding, 0)).alias("unsure"))
    own = F.when(F.col("kind") == "reservoirs", F.col("n_reservoirs")).otherwise(F.col("n_water_bodies"))
    marks = F.array(
        F.struct(F.col("kind").alias("class"), (F.col("place") <= own).alias("hit")), F.struct(F.lit("land").alias("class"), (F.col("land") + F.col("unsure") <= F.col("n_land")).alias("hit")))
    counted = ranked.where(open_).select("reached", F.explode(marks).alias("m")).groupBy("m.class", "m.hit", "reached").agg(F.count(F.lit(1)).alias("n"))  # at most 6 rows a threshold
    fixed = rows.groupBy("chunk").agg(*(F.count_if(F.col("kind") == c).alias(f"p_{c}") for c in ("land", "sea")), *(F.first(f"n_{c}").alias(f"n_{c}") for c in CLASSES))
    least = {"land": F.col("p_land"), "sea": F.col("p_sea"), "reservoirs": F.lit(0), "water_bodies": F.lit(0)}
    base = fixed.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"n_{c}").alias("n"), least[c].cast("bigint").alias("p")) for c in CLASSES))).alias("k")).select("k.*")
    base = base.groupBy("class").agg(F.sum(F.least("p", "n")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("n"), F.lit(0))).alias("fp"), F.sum("n").alias("true"), F.count(F.lit(1)).alias("chunks"))
    each = base.select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("i", "threshold"))
    counts = F.when(F.col("class") == "land", F.col("reached") <= F.col("i")).otherwise(F.col("reached") > F.col("i"))
    more = each.join(F.broadcast(counted), "class", "left")
    sums = more.groupBy("threshold", "class").agg(
        *(F.first(c).alias(c) for c in ("tp", "fp", "true", "chunks")), *(F.coalesce(F.sum(F.when(counts & (F.col("hit") == h), F.col("n"))), F.lit(0)).alias(a) for a, h in (("more_tp", True), ("more_fp", False))))
    tp, fp = F.col("tp") + F.col("more_tp"), F.col("fp") + F.col("more_fp")
    return sums.select("threshold", "class", tp.alias("tp"), (CELLS * F.col("chunks") - fp - F.col("true")).alias("tn"), fp.alias("fp"), (F.col("true") - tp).alias("fn"), "chunks")


def check_lengths(cells: DataFrame, true: DataFrame) -> DataFrame:
    """`cells` (chunk, cell), or an error where there are fewer chunks than label rows: a short file would shrink the counts unseen."""
    sizes = cells.agg(F.countDistinct("chunk").alias("p")).crossJoin(true.agg(F.count(F.lit(1)).alias("t")))  # one row each
    checked = cells.crossJoin(F.broadcast(sizes.select(F.when(F.col("p") < F.col("t"), F.raise_error(F.concat(F.lit("predicted chunks: "), "p", F.lit(", label rows: "), "t"))).otherwise(F.lit("")).alias("_ok"))))  # one row
    return checked.where(F.col("_ok") == "").drop("_ok")


def extrema(history: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The least and greatest value of a training history (epoch, value) and their epochs, the first of equals."""
    order = lambda best: best("epoch", F.struct(F.col(value), -F.col("epoch")) if best is F.max_by else F.struct(F.col(value), F.col("epoch")))
    rows = history.where(F.col(value).isNotNull()).groupBy(*by)
    return rows.agg(F.min(value).alias("least"), order(F.min_by).alias("least_epoch"), F.max(value).alias("greatest"), order(F.max_by).alias("greatest_epoch"))


def metrics(counts: DataFrame) -> DataFrame:
    """Percentages with two decimals; 100 where a denominator is 0; F1 from the rounded precision and recall."""
    share = lambda a, b: F.round(F.coalesce(100 * a / F.nullif(b, F.lit(0)), F.lit(100.0)), 2)
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"acc": share(tp + tn, F.col("chunks").cast("double") * CELLS), "prec": share(tp, tp + fp), "recall": share(tp, tp + fn), "spec": share(tn, tn + fp)})
    p, r = F.col("prec"), F.col("recall")
    return out.withColumn("f1", F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(100.0)), 2))


def class_totals(rows: DataFrame, by: str = "class") -> DataFrame:
    """The number of rows of each class, and of all (class null)."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"))


def mean_by_setting(runs: DataFrame, setting: str = "epochs", value: str = "accuracy") -> DataFrame:
    """The mean of repeated runs of each setting."""
    return runs.groupBy(setting).agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("runs"))
