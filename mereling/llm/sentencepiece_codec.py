"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The automaton holds the model's pieces. Reading a pre-token character by character, the state's
output links give every piece that ends there, and each relaxes the best score of its end. A
character that no piece covers falls back to its UTF-8 bytes, at a score below all pieces, or to the
unknown piece in a model without bytes. The
scores are the model's own, so the result is the segmentation with the highest total score; of
equal totals, the one whose last piece is longest, from the end.

A pre-token's pieces don't depend on what is around it (see `pretokens`), so each distinct one
of a batch, told apart by its bytes, is segmented once and its ids are copied to where it occurs;
a cache of the worker, bounded in bytes, keeps those of earlier batches.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from mereling.llm import pretokens, words

#: Of the cache, bytes in all and of one pre-token (longer ones, of texts without spaces, aren't kept); and of one id in it.
CACHE, LONG, ID = 64 << 20, 128, 36
#: Models mark pieces without a score (runs of spaces) by one below this; they rank last, above the bytes.
UNSCORED = -1e8
_state: dict = {}


class Codec:
    """The pieces, scores and automaton of a model file; once per worker."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        if not pretokens.splits_at_spaces(pieces):
            raise ValueError("a piece of this model crosses a word start; its texts can't be cut at spaces")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        lowest = min(sp.get_score(i) for i in plain if sp.get_score(i) > UNSCORED)
        self.score = {pieces[i]: (i, max(sp.get_score(i), lowest - 1.0)) for i in plain}
        self.fallback = lowest - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.score.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        # for decoding: the bytes of all pieces end to end
        raw = [b""] * n
        raw[self.unknown] = "\N{REPLACEMENT CHARACTER}".encode()
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        for i in plain:
            raw[i] = pieces[i].replace(pretokens.SPACE, " ").encode()
        self.sizes = np.fromiter(map(len, raw), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.held = 0  # bytes of the cache

    def segment(self, text: str) -> tuple[int, ...]:
        """The ids of one pre-token, whose spaces are given as the model's space sign."""
        n = len(text)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0], done, fallback = 0.0, 0, self.fallback
        for end, (size, score, piece) in self.automaton.iter(text):
            while done < end:  # no more pieces end at these places
                done += 1
                if best[done - 1] + fallback > best[done]:
                    best[done], back[done] = best[done - 1] + fallback, (1, -1)
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (size, piece)
        while done < n:
            done += 1
            if best[done - 1] + fallback > best[done]:
                best[done], back[done] = best[done - 1] + fallback, (1, -1)
        out: list[int] = []
        while n:
            size, piece = back[n]
            out += [piece] if piece >= 0 else [self.bytes[b] for b in reversed(text[n - 1].encode())] if self.bytes else [self.unknown]
            n -= size
        return tuple(reversed(out))

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one entry more)."""
        all_ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in words.pieces(pretokens.spaced(column)):
            starts, ends, first = pretokens.find(data, offsets)
            back, each = words.distinct(data, starts, ends)
            cache, found = self.cache, []
            for key in each.to_pylist():
                ids = cache.get(key)
                if ids is None:
                    ids = self.segment(key.decode("utf-8", "replace").replace(" ", pretokens.SPACE))
                    if len(key) <= LONG:
                        cache[key] = ids
                        self.held += len(key) + ID * len(ids) + 200
                found.append(ids)
            if self.held > CACHE:
                cache.clear()
                self.held = 0
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
            each = lengths[back]
            empty = np.flatnonzero(np.diff(offsets) == 1)  # a text of no characters has no tokens
            each[first[:-1][empty]] = 0
            all_ids.append(flat[words.ragged((np.cumsum(lengths) - lengths)[back], each)])
            total = np.concatenate(([0], np.cumsum(each)))
            sizes.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(all_ids), np.cumsum(np.concatenate(sizes))

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts end to end, and where each text's begin (one entry more)."""
        each = self.sizes[ids]
        data = self.raw[words.ragged(self.starts[ids], each)]
        total = np.concatenate(([0], np.cumsum(each)))[offsets]
        front = total[:-1][np.diff(total) > 0]  # the space that encoding puts in front
        data = np.delete(data, front)
        return data, np.concatenate(([0], np.cumsum(np.maximum(np.diff(total) - 1, 0))))


def codec(model_file: str) -> Codec:
    if model_file not in _state:
        _state[model_file] = Codec(model_file)
    return _state[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, n_tokens long, round_trip boolean.

    round_trip: whether decoding the ids gives the text back, byte by byte. A text with the model's
    space sign (U+2581) isn't given back, for it is read as a space, nor is one with a character that
    a model without byte pieces doesn't cover. Null and empty texts have no ids and are given back
    as ''. Ids of rows are passed on, null and repeated ones too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):  # a bounded number of ids at a time
                part = batch.slice(low, 512)
                ids, offsets = own.encode_batch(part.column(1))
                data, at = own.decode_batch(ids, offsets)
                whole, begins = words.buffers(pc.fill_null(part.column(1).cast(pa.large_string()), ""))
                same = [bool(np.array_equal(data[a:b], whole[c:d])) for a, b, c, d in zip(at, at[1:], begins, begins[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(offsets), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Null ids give ''; bytes that aren't UTF-8 give U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            ids = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            data, at = own.decode_batch(ids, offsets)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")
