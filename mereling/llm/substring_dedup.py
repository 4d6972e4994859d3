"""Substring dedup: words of windows of W words that start anywhere else too are removed.

1. Packs. Documents are packed, in the order in which they come, into compressed packs of a
   bounded number of bytes, written once. All later work is by pack, so a hot text, id or null
   is never a group of its own.
2. Phrases. The run of K words with the least hash in a window is its seed, so equal windows have
   equal seeds at equal places. Each pack sends its distinct seeds, as words, with a hash of the
   passage whose windows they stand for. Compared by their words, those that occur at least twice
   are the recurring phrases. A passage that occurs at least twice is confirmed whole.
3. Automata. A phrase goes to the packs that sent it (nowhere else can it occur, and all documents
   through all shards would be quadratic): each pack is one shard of bounded size. It compiles the
   phrases it was sent into an Aho-Corasick automaton over words (a word is a character), and its
   documents are streamed through it. The automaton alone says where phrases occur; a window is
   taken into account only if its seed's place was found.
4. Windows of passages confirmed whole are done. Those of the others, at the ends of passages and
   around edits, are counted by 128 bits of hash over their words, together with those of the
   confirmed passages of the same phrases, which one pack of each sends; at least two confirm them.
5. Each pack gets its confirmed windows back and removes the words that they cover.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mereling.llm import scratch, words

W, K = 35, 8
#: Bytes of text in a pack, at least one text.
PACK = 2 << 20
_SALT = 1
_LOW = np.uint64((1 << 32) - 1)
#: A word is its number among the phrases' words, in digits of this base; pyahocorasick searches a
#: state's successors one by one, so they must be few.
_DIGIT = 32


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def seeds(tokens: np.ndarray, first: np.ndarray, w: int = W, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, and the place of each window's seed; of equal hashes, the first place."""
    starts = words.within(first, w)
    if not len(starts):
        return starts, starts
    runs = words.runs(tokens, k)
    place = _least((runs & ~_LOW) | np.arange(len(runs), dtype=np.uint64), w - k + 1) & _LOW
    return starts, place.astype(np.int64)[starts]


def _passages(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds in order of place: their places, and the first and number of the windows they stand for;
    the hash of the passage from the first window's begin to the last one's end; window hashes at all places."""
    starts, place = seeds(tokens, first)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(place)))
    windows = words.runs(tokens, W)
    begin, at = starts[heads], place[heads]
    # the two windows overlap, so they cover the passage; the offset says how
    passage = words.join(words.join(windows[begin], windows[begin + size - 1]), ((at - begin) * W + size).astype(np.uint64))
    return at, begin, size, passage, windows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (pack, data): Arrow tables of a bounded size, each with a number of its own (equal rows make equal packs)."""
    context = TaskContext.get()
    pack = (context.partitionId() if context else 0) << 40
    for batch in batches:
        for i, j, _, _ in words.pieces(batch.column(1), PACK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(i, j - i))
            data = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([data], pa.binary())], ["pack", "data"])
            pack += 1


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """The rows of a batch, one at a time, for they are large."""
    for k in range(batch.num_rows):
        yield [c[k].as_py() for c in batch.columns]


def _unpacked(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a pack's texts."""
    batch = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]
    return batch.column(0), *_whole(batch.column(1))


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = list(words.pieces(column, 1 << 62))
    return parts[0][2], parts[0][3]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, data) -> (phrase, passage, pack, n): a pack's distinct seeds and their passages."""
    for batch in batches:
        for pack, data in _rows(batch):
            _, raw, offsets = _unpacked(data)
            starts, ends, first = words.split(raw, offsets)
            tokens = words.hashes(raw, starts, ends)
            at, _, _, passage, _ = _passages(tokens, first)
            if not len(at):
                continue
            key = words.join(words.runs(tokens, K)[at], passage)
            _, head, count = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [_joined(raw, starts, ends, at[head]), pa.array(passage[head].view(np.int64)), pa.array(np.full(len(head), pack)), pa.array(count.astype(np.int64))],
                ["phrase", "passage", "pack", "n"])


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    """The K words from each place on, joined by spaces."""
    pick = (at[:, None] + np.arange(K)).ravel()
    size = ends[pick] - starts[pick] + 1
    flat = words.ragged(starts[pick], size)
    body = np.append(raw, np.uint8(0x20))[flat]
    stops = np.cumsum(size)
    body[stops - 1] = 0x20
    whole = size.reshape(-1, K).sum(axis=1)
    keep = np.ones(len(body), bool)
    keep[stops[K - 1 :: K] - 1] = False
    offsets = np.concatenate(([0], np.cumsum(whole - 1)))
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[keep]))]).cast(pa.binary())


class Phrases:
    """An Aho-Corasick automaton over the words of some phrases of K words."""

    def __init__(self, phrases: list[bytes]):
        import ahocorasick

        raw = np.frombuffer(b" ".join(phrases), np.uint8)
        starts, ends, _ = words.split(raw, np.array([0, len(raw)]))
        codes, self.vocabulary = words.distinct(raw, starts, ends)
        self.digits = 1
        while _DIGIT**self.digits <= len(self.vocabulary):
            self.digits += 1
        stream, size = self._characters(codes), K * self.digits
        self.automaton = ahocorasick.Automaton()
        for i in range(len(phrases)):
            self.automaton.add_word(stream[i * size : (i + 1) * size], i)
        self.automaton.make_automaton()

    def _characters(self, codes: np.ndarray) -> str:
        """Words, by their numbers, as characters; -1 for a word that no phrase has."""
        places = _DIGIT ** np.arange(self.digits)
        return ((codes.astype(np.int64) + 1)[:, None] // places % _DIGIT + 0x30).astype(np.uint8).tobytes().decode("ascii")

    def occurrences(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all texts where a phrase begins, and its number."""
        if not len(self.automaton):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, found = words.distinct(raw, starts, ends)
        own = np.asarray(pc.fill_null(pc.index_in(found, value_set=self.vocabulary), -1))
        stream = self._characters(own[codes])
        ends_, values = [], []
        for end, value in self.automaton.iter(stream):
            ends_.append(end)
            values.append(value)
        end, values = np.array(ends_, np.int64) + 1, np.array(values, np.int64)
        aligned = end % self.digits == 0  # else it ends within a word
        at, values = end[aligned] // self.digits - K, values[aligned]
        text = words.owners(first)
        whole = text[at] == text[at + K - 1]
        return at[whole], values[whole]


#: What a pack is told of a passage of a recurring phrase: it occurs once, at least twice (and another pack
#: or nobody needs to send its windows), or at least twice and this pack sends its windows for the others.
ONCE, DONE, LEADS = b"\0", b"\1", b"\2"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, data, sent) -> (h1, h2, pack, n, runs): runs of confirmed windows in one row, which counts
    for two, and each other distinct window whose seed was found. runs: (begin, number) pairs, int32.

    sent: a byte for the state, eight for the passage, and the phrase.
    """
    for batch in batches:
        for pack, data, sent in _rows(batch):
            number: dict[bytes, int] = {}
            of = np.array([number.setdefault(x[9:], len(number)) for x in sent], np.int64)
            told = np.frombuffer(b"".join(x[:1] for x in sent), np.uint8)
            known = words.join(of.astype(np.uint64), np.frombuffer(b"".join(x[1:9] for x in sent), ">u8").astype(np.uint64))
            order = np.argsort(known)
            known, told = known[order], told[order]
            _, raw, offsets = _unpacked(data)
            starts, ends, first = words.split(raw, offsets)
            tokens = words.hashes(raw, starts, ends)
            at, begin, size, passage, windows = _passages(tokens, first)
            phrase = np.full(len(tokens), -1, np.int64)
            found, which = Phrases(list(number)).occurrences(raw, starts, ends, first)
            phrase[found] = which
            live = np.flatnonzero(phrase[at] >= 0)
            begin, size = begin[live], size[live]
            key = words.join(phrase[at[live]].astype(np.uint64), passage[live])
            place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            state = np.where(known[place] == key, told[place], ONCE[0]) if len(live) else np.zeros(0, np.uint8)
            done, open_ = np.flatnonzero(state != ONCE[0]), np.flatnonzero(state != DONE[0])
            weight = np.repeat(np.where(state[open_] == LEADS[0], 2, 1), size[open_])
            each = words.ragged(begin[open_], size[open_])
            h1, h2 = windows[each], words.runs(words.hashes(raw, starts, ends, _SALT), W)[each]
            order = np.lexsort((h2, h1))
            h1, h2, each, weight = h1[order], h2[order], each[order], weight[order]
            new = np.ones(len(order), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            heads = np.flatnonzero(new)
            count = np.diff(np.append(heads, len(order)))
            flat = np.stack((each, np.ones(len(each), np.int64)), axis=1).astype(np.int32)
            one = np.stack((begin[done], size[done]), axis=1).astype(np.int32)
            spread = words.mix(np.array([pack]).view(np.uint64))  # deals out the rows that only pass through
            rows = int(len(done) > 0)
            cuts = 8 * np.concatenate((np.zeros(rows, np.int64), [len(done)], len(done) + np.cumsum(count)))
            body = np.ascontiguousarray(np.concatenate((one, flat)))
            lists = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(body)]).cast(pa.binary())
            arrays = [np.concatenate((spread[:rows], h1[heads])).view(np.int64), np.concatenate((spread[:rows], h2[heads])).view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, arrays), pa.array(np.full(len(lists), pack, np.int64)), pa.array(np.concatenate((np.full(rows, 2), np.add.reduceat(weight, heads) if len(heads) else count))), lists], ["h1", "h2", "pack", "n", "runs"])


def confirmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack, data, runs): the packed documents, and the runs of recurring windows of each, as places among its words."""
    packs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_packed, "pack long, data binary")
    packs = scratch.keep(packs, "packs").where("pack is not null")  # a filter that one join would add; so both read one shuffle
    of = lambda *names: Window.partitionBy(*names)
    rows = packs.mapInArrow(_phrases, "phrase binary, passage long, pack long, n long").select(
        "*", F.sum("n").over(of("phrase")).alias("all"), (F.min("passage").over(of("phrase")) == F.max("passage").over(of("phrase"))).alias("one")).where("all > 1")
    rows = rows.select("*", F.sum("n").over(of("phrase", "passage")).alias("same"), F.min("pack").over(of("phrase", "passage")).alias("leader"))
    state = F.when(F.col("same") == 1, F.lit(ONCE)).when(F.col("one") | (F.col("leader") != F.col("pack")), F.lit(DONE)).otherwise(F.lit(LEADS))
    sent = rows.select("pack", F.concat(state, F.unhex(F.lpad(F.hex("passage"), 16, "0")), "phrase").alias("sent")).groupBy("pack").agg(F.collect_list("sent").alias("sent"))
    windows = packs.join(sent, "pack").select("pack", "data", "sent").mapInArrow(_windows, "h1 long, h2 long, pack long, n long, runs binary")
    windows = windows.select("pack", "runs", F.sum("n").over(of("h1", "h2")).alias("n")).where("n > 1")
    return packs.join(windows.groupBy("pack").agg(F.collect_list("runs").alias("runs")), "pack", "left").select("pack", "data", "runs")


def _kept(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, runs: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by spaces) of each text."""
    gone = np.zeros(len(starts) + 1, np.int64)
    np.add.at(gone, runs[:, 0], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1] - 1 + W, -1)
    stays = np.cumsum(gone[:-1]) == 0
    data = raw.tobytes()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        mine = np.flatnonzero(stays[a:b]) + a
        yield b - a, b - a - len(mine), b" ".join(data[s:e] for s, e in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, and text (the kept words joined by one space)
    or, with `digest`, kept_sha256 in its place.

    A word is a run of other characters than space, tab, line feed, vertical tab, form feed and
    carriage return. Null and empty texts have no words. Repeated rows are each other's copies, so
    their windows recur; null ids are documents too; ids may be of any type. Windows are judged on
    the input. Two windows are equal when their seeds' words are and either 128-bit hashes of all
    their words or, for passages confirmed whole, 64-bit hashes of the passages.
    """
    name = "kept_sha256" if digest else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, lists in _rows(batch):
                ids, raw, offsets = _unpacked(data)
                starts, ends, first = words.split(raw, offsets)
                runs = np.frombuffer(b"".join(lists or []), np.int32).reshape(-1, 2).astype(np.int64)
                rows = list(_kept(raw, starts, ends, first, runs))
                out = [hashlib.sha256(t).hexdigest() if digest else t.decode("utf-8", "replace") for _, _, t in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", name])

    kind = docs.schema[id_col].dataType.simpleString()
    return confirmed(docs, id_col, text_col).select("data", "runs").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, {name} string")
