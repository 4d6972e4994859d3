"""Token counts: a two-tier look-up on the map side, without a shuffle of pre-tokens.

First tier: a broadcast open-addressing table from frequent pre-tokens to their numbers of tokens,
of at most TABLE entries, compared by their bytes. Second tier: what the table misses is looked up
in a bounded cache of the worker, and only what is not there is encoded by the library. Neither
tier changes a result; they only save calls.

The table comes from a sample of bounded size: at most TASKS tasks, spread over the table, read the
first SAMPLE bytes of texts that each meets and return their most frequent pre-tokens. No task reads
on after that, and nothing is shuffled. The counting itself reads the texts once.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from mereling.llm import pretokens, words

#: Entries of the table and of a worker's cache, and bytes of a pre-token in the cache; longer ones (of texts without spaces) aren't kept.
TABLE, CACHE, LONG = 1 << 16, 300_000, 128
#: Of the sample that fills the table: tasks, bytes of text that each reads (a text at least), and pre-tokens that each returns.
TASKS, SAMPLE, SUMMARY = 32, 1 << 20, 8192
_state: dict = {}


def processor(model_file: str):
    """The model, once per worker."""
    if model_file not in _state:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if not pretokens.splits_at_spaces([sp.id_to_piece(i) for i in range(sp.get_piece_size())]):
            raise ValueError("a piece of this model crosses a word start; its texts can't be cut at spaces")
        _state[model_file] = sp
    return _state[model_file]


def encode_lengths(sp, tokens: list[bytes]) -> list[int]:
    """The number of tokens of each pre-token (a run of spaces and what follows)."""
    texts = [t[1:].decode("utf-8", "replace") for t in tokens]
    lengths = [len(x) for x in sp.encode(texts, num_threads=1)]
    return [1 if t == b" " else n for t, n in zip(tokens, lengths, strict=True)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    left = SAMPLE
    for batch in batches:
        for _, _, data, offsets in words.pieces(pretokens.spaced(batch.column(0)), SAMPLE):
            starts, ends, _ = pretokens.find(data, offsets)
            codes, each = words.distinct(data, starts, ends)
            for key, n in zip(each.to_pylist(), np.bincount(codes, minlength=len(each)).tolist(), strict=True):
                if n > 1 or key in seen:
                    seen[key] += n
            left -= len(data)
            if left <= 0:
                break
        if left <= 0:
            break
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])


def frequent(docs: DataFrame, text_col: str = "text", size: int = TABLE) -> list[bytes]:
    """At most `size` pre-tokens that are frequent in the sample, the most frequent first."""
    total: Counter[bytes] = Counter()
    for r in docs.select(text_col).coalesce(TASKS).mapInArrow(_summaries, "token binary, n long").collect():  # at most TASKS * SUMMARY rows
        total[bytes(r[0])] += r[1]
    return [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


class Table:
    """Pre-token -> number of tokens: slots of entries by hash, entries' bytes end to end; probing is done for many at once."""

    def __init__(self, tokens: list[bytes], lengths: list[int]):
        slots = 1 << max(4, (2 * len(tokens)).bit_length())
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.array(lengths, np.int32)
        self.hashes = words.hashes(self.data, self.starts, self.starts + self.sizes)
        self.slots, self.probes = np.full(slots, -1, np.int32), 1
        for entry, h in enumerate(self.hashes.tolist()):
            at, steps = h & (slots - 1), 1
            while self.slots[at] >= 0:
                at, steps = (at + 1) & (slots - 1), steps + 1
            self.slots[at], self.probes = entry, max(self.probes, steps)

    def get(self, keys: pa.Array) -> np.ndarray:
        """Lengths; -1 for a pre-token that the table lacks."""
        data, offsets = words.buffers(keys)
        starts, sizes = offsets[:-1], np.diff(offsets)
        hashes = words.hashes(data, starts, offsets[1:])
        mask = np.uint64(len(self.slots) - 1)
        out, open_ = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        at = hashes & mask
        for _ in range(self.probes):
            entry = self.slots[at]
            taken = entry >= 0
            open_, at, entry = open_[taken], at[taken], entry[taken]
            same = (self.hashes[entry] == hashes[open_]) & (self.sizes[entry] == sizes[open_])
            some = np.flatnonzero(same)
            if len(some):  # then the bytes decide
                e, k = entry[some], open_[some]
                equal = self.data[words.ragged(self.starts[e], self.sizes[e])] == data[words.ragged(starts[k], sizes[k])]
                same[some] = np.logical_and.reduceat(equal, np.cumsum(sizes[k]) - sizes[k])
            out[open_[same]] = self.values[entry[same]]
            open_, at = open_[~same], (at[~same] + np.uint64(1)) & mask
            if not len(open_):
                break
        return out


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has no bytes and no tokens. Ids are passed on, null and repeated ones
    too; other columns are not read. The model file must be at the same place on each worker.
    """
    spark = docs.sparkSession
    tokens = frequent(docs, text_col, table_size)
    table = spark.sparkContext.broadcast(Table(tokens, encode_lengths(processor(model_file), tokens)))  # at most table_size entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, first_tier = processor(model_file), table.value
        cache: dict[bytes, int] = _state.setdefault(("lengths", model_file), {})
        for batch in batches:
            n_tokens = []
            for _, _, data, offsets in words.pieces(pretokens.spaced(batch.column(1))):
                starts, ends, first = pretokens.find(data, offsets)
                codes, each = words.distinct(data, starts, ends)
                lengths = first_tier.get(each)
                missed = np.flatnonzero(lengths < 0)
                keys = each.take(pa.array(missed)).to_pylist()
                unknown = [k for k in keys if k not in cache]
                if len(cache) + len(unknown) > CACHE:
                    cache.clear()
                    unknown = keys
                fresh = dict(zip(unknown, encode_lengths(sp, unknown), strict=True))
                cache.update((k, n) for k, n in fresh.items() if len(k) <= LONG)
                lengths[missed] = np.fromiter((fresh[k] if k in fresh else cache[k] for k in keys), np.int32, len(keys))
                lengths = lengths[codes]
                total = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                sizes = np.diff(offsets) - 1
                n_tokens.append(np.where(sizes > 0, total[first[1:]] - total[first[:-1]], 0))
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n_tokens = np.concatenate(n_tokens) if n_tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
