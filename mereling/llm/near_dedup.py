"""MinHash near-dedup with BagMinHash: weighted-Jaccard signatures, bands, verified overlaps.

A text is the multiset of its runs of five words. For each register, BagMinHash keeps the first
point of a Poisson process that is the union of one process per shingle and unit of weight, so
two texts agree on a register with probability equal to their weighted Jaccard similarity. Unit
weights are grouped into the intervals (0, 1], (1, 2], (2, 4], (4, 8], ...; a point of an
interval is thinned down its halves to one unit and counts if the weight reaches it. All points
of a shingle come in order of time and stop at the latest first point of the text's registers.

Equal texts are one node from the start. Nodes that agree on all ROWS registers of one of BANDS
bands are candidates. In each bucket every node is compared with two centres, which is linear in
the bucket and links most of what belongs together. Nodes of buckets that still hold several
components are then compared exactly, across components only, by the prefix filter: with all
shingles in one order, rare ones first, two texts of overlap t or more share one of the first
n - ceil(t n) + 1. So no link between components is left untested, and a large group of copies
never makes all its pairs. A pair is a link if its multiset overlap is at least the threshold.
Of each component, one row stays.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mereling.llm import components, scratch, words

#: A pair at 0.8 is in no common bucket with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
WORDS, BANDS, ROWS, THRESHOLD = 5, 24, 4, 0.8
BEFORE = 16


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct runs of n words; a text of fewer words has one, all of them."""
    starts, ends, first = words.split(data, offsets)
    tokens = words.hashes(data, starts, ends)
    at, hashes = words.grams(tokens, first, n)
    own = words.owners(first)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    own = np.concatenate((own, short))
    hashes = np.concatenate((hashes, words.fold(tokens, first[short], first[short + 1])))
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    heads = np.flatnonzero(new)
    return own[heads], hashes[heads], np.diff(np.append(heads, len(own)))


def signatures(own: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: float32 first-point times, a row per text (infinite where a text has no shingle)."""
    sig = np.full(texts * registers, np.inf)
    latest = np.full(texts, np.inf)
    one = np.uint64(1)
    todo = []
    top = int(weights.max()) if len(weights) else 0
    k = 0
    while (low := 0 if k == 0 else 1 << (k - 1)) < top:
        here = np.flatnonzero(weights > low)
        todo.append((here, np.full(len(here), k, np.int64)))
        k += 1
    if not todo:
        return sig.reshape(texts, registers).astype(np.float32)
    item, level = (np.concatenate(x) for x in zip(*todo, strict=True))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)  # of the interval (low, low + width]
    seed = words.mix(hashes[item] ^ words.mix(level.astype(np.uint64) + one))
    text, weight, time = own[item], weights[item], np.zeros(len(item))
    step = 0
    while len(item):
        step = (step + 0x9E3779B97F4A7C15) % (1 << 64)
        r = words.mix(seed + np.uint64(step))
        time = time - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / (registers * width)
        live = time < latest[text]
        item, text, weight, low, width, seed, time, r = (x[live] for x in (item, text, weight, low, width, seed, time, r))
        s = words.mix(r)
        # thinning: one bit of `unit` per halving of the interval
        unit = low + ((s >> np.uint64(32)).astype(np.int64) & (width - 1))
        hit = unit < weight
        place = text[hit] * registers + ((s[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(sig, place, time[hit])
        touched = np.unique(text[hit])
        latest[touched] = sig.reshape(texts, registers)[touched].max(axis=1)
    return sig.reshape(texts, registers).astype(np.float32)


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """int64, a column per band; equal in a band with all registers equal and, but for hash collisions, in no other."""
    bits = np.ascontiguousarray(sig).view(np.uint32).astype(np.uint64).reshape(len(sig), bands, -1)
    out = words.mix(np.arange(bands, dtype=np.uint64) + np.uint64(11))[None, :].repeat(len(sig), 0)
    for r in range(bits.shape[2]):
        out = words.mix(out ^ bits[:, :, r]) + np.uint64(r)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, text) -> (id, node, size, bands); size: the number of shingles with their weights."""
    for batch in batches:
        sizes, bands = [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)]
        for i, j, data, offsets in words.pieces(batch.column(2)):
            own, hashes, weights = shingles(data, offsets)
            sizes.append(np.bincount(own, weights, j - i).astype(np.int64))
            bands.append(band_hashes(signatures(own, hashes, weights, j - i)))
        sizes, bands = np.concatenate(sizes), np.concatenate(bands)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), lists], ["id", "node", "size", "bands"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, shingles), where the k-th copy of a shingle has a hash of its own: sets for multisets."""
    for batch in batches:
        out = []
        for i, j, data, offsets in words.pieces(batch.column(1)):
            own, hashes, weights = shingles(data, offsets)
            copy = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
            each = words.mix(np.repeat(hashes, weights) + words.mix(copy.astype(np.uint64))).view(np.int64)
            cuts = np.concatenate(([0], np.cumsum(np.bincount(own, weights, j - i).astype(np.int64))))
            out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(each)))
        lists = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "shingles"])


def _verified(pairs: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multiset overlap is at least the threshold, and that overlap."""
    side = lambda n: lists.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.where(F.col("common") >= threshold * union).select("a", "b", (F.col("common") / union).alias("similarity"))


def _plausible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) whose sizes allow the threshold."""
    return pairs.where(F.least("xa", "xb") >= threshold * F.greatest("xa", "xb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links_across(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """All links between `nodes` (node, shingles, component) of different components, by the prefix filter.

    Shingles that only one component has come first in the order, for no such pair shares them;
    the others follow, rare ones first. A pair is formed only where what follows can still reach the
    overlap that both sizes ask for, and not where one of the last BEFORE shingles is common too, for
    then it is formed there or earlier; the few repeats that are left go by `distinct`.
    """
    nodes = scratch.keep(nodes.select("node", "component", F.size("shingles").alias("n"), "shingles"), "open-lists")
    each = nodes.select("node", "component", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(
        F.sum("k").alias("df"), F.max_by("component", F.struct("k", "component")).alias("most"), F.count(F.lit(1)).alias("c"))
    shared = scratch.keep(shared.where("c > 1").drop("c"), "shared-shingles")
    own = each.join(shared.select("shingle", "df"), "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    own = own.join(nodes.select("node", "component", "n"), "node").withColumn("lone", F.col("n") - F.size("own"))
    length = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1 - F.col("lone")
    own = own.where(length > 0).withColumn("own", F.transform(F.slice("own", 1, F.greatest(length, F.lit(0))), lambda s: s["shingle"]))
    rows = own.select("node", "component", "n", "lone", "own", F.posexplode("own").alias("i", "shingle")).select(
        "node", "component", "n", "shingle", (F.col("lone") + F.col("i")).alias("at"), F.slice("own", F.greatest(F.col("i") - BEFORE, F.lit(0)) + 1, F.least(F.col("i"), F.lit(BEFORE))).alias("before"))
    rows = scratch.keep(rows.join(shared.select("shingle", "most"), "shingle"), "prefixes")
    # of each shingle, all nodes meet those outside its most frequent component
    side = lambda df, n: df.select("shingle", *(F.col(c).alias(c + n) for c in ("node", "component", "n", "at", "before")))
    left, right = side(rows.where("component <> most"), "_a"), rows.select("shingle", "most", *(F.col(c).alias(c + "_b") for c in ("node", "component", "n", "at", "before")))
    need = threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = left.join(right, "shingle").where(
        (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("most")) | (F.col("node_a") < F.col("node_b")))
        & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need)
        & ~F.arrays_overlap("before_a", "before_b"))
    return scratch.keep(_verified(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), lists, threshold), "links-across")


def _node(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256, of which no two texts with equal bits are known."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def node_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct text: node, component (least node of its class), n (rows), least (id), links
    (verified ones of the text; not all pairs of a class are tested) and similarity (the greatest of these)."""
    rows = docs.select(F.col(id_col).alias("id"), _node(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = scratch.keep(rows.mapInArrow(_signed, f"id {kind}, node binary, size long, bands array<long>"), "signed")
    nodes = scratch.keep(signed.groupBy("node").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    buckets = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = scratch.keep(buckets.join(full.select("bucket"), "bucket", "left_semi"), "buckets")
    some = buckets.select("node").distinct()
    # the texts of candidates: the row of each node with the least id, for any row would do
    wanted = nodes.join(some, "node", "left_semi").select("node", F.col("least").alias("id"))
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & (rows["node"] == wanted["node"]), "left_semi").select("node", "text")
    lists = scratch.keep(texts.mapInArrow(_listed, "node binary, shingles array<long>").dropDuplicates(["node"]), "shingles")
    order = lambda seed: F.min(F.struct(F.xxhash64("node", F.lit(seed)), "node", "size"))
    centres = buckets.groupBy("bucket").agg(order(1).alias("o"), order(2).alias("p"))
    centres = centres.select("bucket", F.array_distinct(F.transform(F.array("o", "p"), lambda c: F.struct(c["node"].alias("a"), c["size"].alias("xa")))).alias("c"))
    star = buckets.select("bucket", F.col("node").alias("b"), F.col("size").alias("xb")).join(scratch.keep(centres, "centres"), "bucket")
    star = star.select("b", "xb", F.explode("c").alias("c")).select("b", "xb", "c.a", "c.xa").where("a <> b")
    links = scratch.keep(_verified(_plausible(star, threshold), lists, threshold), "star-links")
    labels = scratch.keep(components.components(links), "labels")
    labelled = scratch.keep(buckets.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "labelled")
    several = labelled.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("bucket")
    open_ = scratch.keep(labelled.join(several, "bucket", "left_semi").select("node", "component").distinct(), "open-nodes")
    more = _links_across(lists.join(open_, "node"), lists, threshold)
    if not more.isEmpty():
        stars = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = scratch.keep(components.components(stars.unionByName(more.select("a", "b"))), "labels")
    every = links.unionByName(more)
    counted = every.select(F.explode(F.array("a", "b")).alias("node"), "similarity").groupBy("node").agg(F.count(F.lit(1)).alias("links"), F.max("similarity").alias("similarity"))
    out = nodes.select("node", "least", "n").join(labels, "node", "left").join(counted, "node", "left")
    return out.withColumns({"component": F.coalesce("component", "node"), "links": F.coalesce("links", F.lit(0))})


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """One row per distinct text: node, class_id (the least id of the class), class_size, keeper (whether the class keeps this text), links, similarity."""
    with scratch.temporary():
        nodes = scratch.keep(node_classes(docs, id_col, text_col, threshold), "node-classes")
        first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("first")
        whole = scratch.keep(nodes.groupBy("component").agg(first, F.sum("n").alias("class_size")), "classes")
        return scratch.keep(nodes.join(whole, "component").select(
            "node", F.col("first.least").alias("class_id"), "class_size", (F.col("node") == F.col("first.node")).alias("keeper"), "links", "similarity"), "class-of-node", stays=True)


def _flagged(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """One row per input row: doc_id, node, class_id, class_size, kept, n_links, similarity."""
    of_node = _classes(docs, id_col, text_col, threshold)
    return docs.select(F.col(id_col).alias("doc_id"), _node(F.col(text_col)).alias("node")).join(of_node, "node").select(
        "doc_id", "node", "class_id", "class_size", (F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), F.col("links").alias("n_links"), "similarity")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept, n_links, similarity.

    A class is a connected component of texts whose multisets of five-word runs overlap by at
    least the threshold (sum of least over sum of greatest weights); its id is its least doc_id,
    whose row stays. A text of fewer than five words is one run; texts without words (null and
    empty ones too) are equal only when identical. Null ids are never kept unless their class
    has no other id. Where several texts of a class have the kept id, or all ids are null, the
    text of the least hash is kept. Rows that repeat the kept id and text are all kept
    (`drop_near_duplicates` leaves one). n_links: the verified links of the row's text to other texts
    (of a large class, not all pairs are tested); similarity: the greatest of these, null without one.
    Other columns are not read.
    """
    return _flagged(docs, id_col, text_col, threshold).drop("node")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that stay, one of each class, with all their columns; of rows that repeat id and text, any one."""
    flagged = _flagged(docs, id_col, text_col, threshold).where("kept")
    kept = scratch.keep(flagged.groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("_n")), "kept-rows")

    def rows(some: DataFrame) -> DataFrame:
        return docs.join(some, docs[id_col].eqNullSafe(some["_id"]) & (_node(docs[text_col]) == some["_node"]), "left_semi")

    repeated = kept.where("_n > 1")
    if repeated.isEmpty():
        return rows(kept)
    again = rows(repeated)
    again = again.select(_node(F.col(text_col)).alias("_node"), F.struct(*(again[c] for c in docs.columns)).alias("_row"))
    return rows(kept.where("_n = 1")).unionByName(again.groupBy("_node").agg(F.first("_row").alias("_row")).select("_row.*"))
