"""Benchmark decontamination: rare pairs of tokens find passages, Smith-Waterman scores them.

Texts are lower-case tokens. An item's seeds are its pairs of tokens that are neighbours or have one token between
them, and so are a text's; a seed is found whichever of the two it is in either. Where two matched tokens
follow each other in an alignment, what is skipped between them costs the greater of both sides' skips; so an
alignment of n tokens' item that reaches the share `least` of its score has at least least * n - 1 places where
that is 0 or 1, each of them a hit of a seed. Of an item's seeds the most frequent ones of the benchmark are left
out, less than half as many as the hits that an alignment has, so enough of the rarer ones are always hit. All
hits of an alignment lie within `drift` diagonals, the gaps that its score allows. Texts where no
such window of hits is, or where too few of the item's tokens occur, can't reach the score; the
others are aligned around the hits, as far as the drift goes. Nothing that reaches the score is lost.

A long item leaks in parts too. With `passage`, an item also matches where an alignment of its own
length reaches the score of so many matched tokens, each edit costing EDIT: it has at least
passage - 1 neighbours in place, and drifts half as far as the item is longer than the passage. An item of
fewer than N tokens matches only as a whole: where its tokens occur one after the other.

The benchmark is broadcast in blocks of at most BLOCK tokens; a larger one makes more passes
over the corpus. Texts themselves are never shuffled.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from mereling.llm import words

#: Items of fewer tokens match as a whole; tokens of a block.
N, BLOCK = 3, 1_000_000
MATCH, MISMATCH, GAP = 2.0, -1.0, 1.0
#: The least score, as a share of the item's score with itself.
SCORE = 0.5
#: The least matched tokens, net of edits, of a passage of an item of any length; and what an edit costs.
PASSAGE, EDIT = 25, MATCH * (N - 1)
#: Hits of seeds are spread over the items that have them in parts of about so many.
_PART = 1 << 20


def align(item: np.ndarray, text: np.ndarray, mismatch: float = MISMATCH, gap: float = GAP) -> tuple[float, int]:
    """Smith-Waterman: the best local score of two token sequences, and where it ends in `text`."""
    cols = np.arange(1, len(text) + 1) * gap
    last, best, end = np.zeros(len(text) + 1), 0.0, 0
    for token in item:
        here = np.maximum(last[:-1] + np.where(text == token, MATCH, mismatch), last[1:] - gap)
        here = np.maximum(here, 0.0)
        here = np.maximum.accumulate(here + cols) - cols  # gaps in the text's direction
        last[1:] = here
        if len(here) and here.max() > best:
            best, end = float(here.max()), int(here.argmax()) + 1
    return best, end


@dataclass(frozen=True)
class Block:
    """Some items: their tokens, and their seeds in order of hash."""

    ids: list
    tokens: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray  # of each seed
    offset: np.ndarray  # of each seed in its item
    hits: np.ndarray  # of each item: how many of its seeds an alignment hits at least
    drift: np.ndarray  # of each item: over how many diagonals
    first: np.ndarray  # first token of each item in `places`, and the end
    vocabulary: np.ndarray  # all distinct tokens, in order
    places: np.ndarray  # of all items' tokens in the vocabulary
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of tokens: hashes of items without a seed, in order, and the items


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in words.pieces(column):
        starts, ends, first, plain = words.tokens(data, offsets)
        yield i, j, words.hashes(plain, starts, ends), first


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, the tokens' hashes as bytes)."""
    for batch in batches:
        out = [tokens[a:b].tobytes() for _, _, tokens, first in _tokens(batch.column(1)) for a, b in zip(first, first[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "tokens"])


def blocks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", n: int = N, block: int = BLOCK, least: float = SCORE, passage: int | None = None) -> Iterator[Block]:
    """The benchmark in blocks of at most `block` tokens (one item at least), without items that have no token.

    Neither `docs` nor `text_col` is read: seeds don't depend on the corpus. Items are tokenized in
    tasks; the driver sees the tokens of one partition at a time and holds those of one block.
    """
    ids, tokens, size = [], [], 0
    kind = items.schema[item_id].dataType.simpleString()
    for row in items.select(item_id, item_text).mapInArrow(_item_tokens, f"id {kind}, tokens binary").toLocalIterator():
        own = np.frombuffer(row[1], np.uint64)
        if not len(own):
            continue
        if ids and size + len(own) > block:
            yield _block(ids, tokens, n, least, passage)
            ids, tokens, size = [], [], 0
        ids.append(row[0])
        tokens.append(own)
        size += len(own)
    if ids:
        yield _block(ids, tokens, n, least, passage)


def pairs(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all pairs of tokens of a text that are neighbours or have one between them."""
    at = [words.within(first, 2), words.within(first, 3)]
    return np.concatenate(at), np.concatenate([words.join(tokens[p], tokens[p + k]) for k, p in enumerate(at, 1)])


def _block(ids: list, tokens: list[np.ndarray], n: int, least: float = SCORE, passage: int | None = None) -> Block:
    sizes = np.array([len(own) for own in tokens])
    first = np.append(0, np.cumsum(sizes))
    few: dict[int, list[tuple[int, int]]] = {}
    for k, own in enumerate(tokens):
        if len(own) < n:
            few.setdefault(len(own), []).append((int(words.runs(own, len(own))[0]), k))
    at, seeds = pairs(np.concatenate(tokens), first)
    item = np.searchsorted(first, at, "right") - 1
    offset = at - first[item]
    hits = np.maximum(np.ceil(least * sizes - 1 - 1e-9).astype(np.int64), 1)
    drift = (2 * sizes * (1 - least) + 1e-9).astype(np.int64)
    if passage is not None:
        hits = np.where(sizes >= passage, np.minimum(hits, max(passage - 1, 1)), hits)
        drift = np.maximum(drift, (sizes - passage) // 2)
    # without the most frequent seeds of each item
    less = (hits - 1) // 2
    _, code, count = np.unique(seeds, return_inverse=True, return_counts=True)
    order = np.lexsort((offset, -count[code], item))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    stays = np.flatnonzero((place >= less[item]) & (sizes[item] >= n))
    order = stays[np.argsort(seeds[stays], kind="stable")]
    vocabulary, places = np.unique(np.concatenate(tokens), return_inverse=True)
    short = {m: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([k for _, k in sorted(x)])) for m, x in few.items()}
    return Block(ids, tokens, seeds[order], item[order], offset[order], hits - less, drift, first, vocabulary, places, short)


def _places(block: Block, tokens: np.ndarray) -> np.ndarray:
    """The place of each token in the block's vocabulary, or -1."""
    at = np.searchsorted(block.vocabulary, tokens)
    at[at == len(block.vocabulary)] = 0
    return np.where(block.vocabulary[at] == tokens, at, -1)


def _common(block: Block, known: np.ndarray, text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many tokens of each item occur anywhere in its text; known: sorted text * vocabulary + place."""
    size = block.first[item + 1] - block.first[item]
    edge = np.cumsum(size)
    at = np.repeat(block.first[item] - (edge - size), size) + np.arange(edge[-1])
    key = np.repeat(text, size) * len(block.vocabulary) + block.places[at]
    low = np.searchsorted(known, key)
    low[low == len(known)] = 0
    return np.add.reduceat((known[low] == key).astype(np.int64), edge - size)


def _parts(size: np.ndarray) -> Iterator[slice]:
    """Consecutive hits whose sizes come to about _PART, at least one hit each."""
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PART, "right")))
        yield slice(i, j)
        i = j


def search(block: Block, column: pa.Array, n: int = N, least: float = SCORE, passage: int | None = None) -> Iterator[tuple[int, int, float, int]]:
    """(row, item of the block, score, end token) of each text and item that reach `least` or have a passage; the best place of each pair."""
    for i, _, tokens, first in _tokens(column):
        yield from ((i + t, k, 1.0, e) for (t, k), e in sorted(_whole(block, tokens, first).items()))
        at, hashes = pairs(tokens, first)
        low = np.searchsorted(block.seeds, hashes)
        low[low == len(block.seeds)] = 0
        hit = np.flatnonzero(block.seeds[low] == hashes) if len(block.seeds) else np.zeros(0, np.int64)
        if not len(hit):
            continue
        hit = hit[np.argsort(at[hit], kind="stable")]
        place = _places(block, tokens)
        known = words.owners(first) * len(block.vocabulary) + place
        known = np.unique(known[place >= 0])
        size = np.searchsorted(block.seeds, hashes[hit], "right") - low[hit]
        best: dict[tuple[int, int], tuple[float, int]] = {}
        text = np.searchsorted(first, at[hit], "right") - 1
        for part in _parts(size):
            cut = [text[e] for e in (part.start, part.stop) if 0 < e < len(hit) and text[e - 1] == text[e]]
            _search(block, tokens, place, first, known, at[hit[part]], low[hit[part]], size[part], least, passage, cut, best)
        yield from ((i + t, k, s, e) for (t, k), (s, e) in sorted(best.items()))


def _whole(block: Block, tokens: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], int]:
    """(text, item) -> end of its first place, for items that are too short to have a seed."""
    out: dict[tuple[int, int], int] = {}
    for m, (known, items) in block.short.items():
        at, hashes = words.grams(tokens, first, m)
        low, high = np.searchsorted(known, hashes), np.searchsorted(known, hashes, "right")
        hit = np.flatnonzero(high > low)
        text = np.searchsorted(first, at[hit], "right") - 1
        for t, h, p in zip(text.tolist(), hit.tolist(), at[hit].tolist(), strict=True):
            for k in items[low[h] : high[h]].tolist():
                out.setdefault((t, k), p + m - int(first[t]))
    return out


def _dense(begin: np.ndarray, pair: np.ndarray, hits: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Which hits are among so many of their pair within the drift; begin is in order in each pair."""
    n = len(begin)
    last = np.arange(n) + hits - 1
    inside = last < n
    last = np.minimum(last, n - 1)
    head = inside & (pair[last] == pair) & (begin[last] - begin <= drift)
    edge = np.bincount(np.flatnonzero(head), minlength=n + 1) - np.bincount(last[head] + 1, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _search(block: Block, tokens: np.ndarray, places: np.ndarray, first: np.ndarray, known: np.ndarray, at: np.ndarray, low: np.ndarray, size: np.ndarray, least: float, passage: int | None, cut: list, best: dict) -> None:
    """Align around hits: token `at` of the texts begins the `size` seeds from `low` on; texts of `cut` have more hits than these."""
    seed = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    place = np.repeat(at, size)
    text = np.searchsorted(first, place, "right") - 1
    item, begin = block.item[seed], place - block.offset[seed]
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    pair = np.ones(len(order), bool)  # another text or item
    pair[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    need = np.ceil(least * np.diff(block.first) - 1e-9).astype(np.int64)  # matches of each item
    enough = need if passage is None else np.minimum(need, passage)
    keep = _dense(begin, np.cumsum(pair), block.hits[item], block.drift[item]) | np.isin(text, cut)
    text, item, begin, pair = text[keep], item[keep], begin[keep], np.cumsum(pair)[keep]
    if not len(text):
        return
    pair = np.append(True, pair[1:] != pair[:-1])
    heads = np.flatnonzero(pair)
    able = _common(block, known, text[heads], item[heads]) >= enough[item[heads]]
    able = np.repeat(able, np.diff(np.append(heads, len(text))))
    text, item, begin, pair = text[able], item[able], begin[able], pair[able]
    if not len(text):
        return
    new = pair.copy()  # or another place
    new[1:] |= np.diff(begin) > block.drift[item[1:]]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(text)) - 1
    for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
        own = block.tokens[item[h]]
        slack = int(block.drift[item[h]])
        a, b = max(int(first[text[h]]), int(begin[h]) - slack), min(int(first[text[h] + 1]), int(begin[t]) + len(own) + slack)
        mine = block.places[block.first[item[h]] : block.first[item[h] + 1]]
        common = np.isin(mine, places[a:b]).sum()
        found = (
            enough[item[h]] < need[item[h]] and common >= passage and align(own, tokens[a:b], -EDIT, EDIT)[0] >= MATCH * passage)
        if not found and common < need[item[h]]:
            continue
        score, end = align(own, tokens[a:b])
        score /= MATCH * len(own)
        key = (int(text[h]), int(item[h]))
        if (found or score >= least) and score > best.get(key, (0.0, 0))[0]:
            best[key] = score, a + end - int(first[text[h]])


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SCORE, passage: int | None = None) -> DataFrame:
    """One row per text and item that reach `least`, or have a passage of `passage` tokens (None: whole items only): doc_id, item_id, score (share of the item's score
    with itself), end_token (token of the text after the best alignment).

    Null texts, and items that are null or have no token, match nothing; items of fewer than N tokens
    match as a whole, with score 1. Ids may be of any type; null ones are carried as they are; repeated
    rows give repeated matches; equal scores keep the first place. Other columns are not read.
    """
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, score double, end_token long"
    item_type = to_arrow_type(items.schema[item_id].dataType)
    out = docs.sparkSession.createDataFrame([], kinds)
    for block in blocks(docs, items, item_id, item_text, text_col, least=least, passage=passage):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK tokens, or one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(search(shared.value, batch.column(1), least=least, passage=passage))
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([shared.value.ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())],
                    ["doc_id", "item_id", "score", "end_token"])

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(run, kinds))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SCORE, passage: int | None = None) -> DataFrame:
    """The rows of `docs` that match no item, with all their columns."""
    at, out = docs.columns.index(text_col), docs
    for block in blocks(docs, items, item_id, item_text, text_col, least=least, passage=passage):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in search(shared.value, batch.column(at), least=least, passage=passage)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
