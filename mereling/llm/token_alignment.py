"""Alignment of two tokenizers' tokens: a sweep over the byte offsets at which tokens of either end.

A, a byte-level BPE, reads a space and the text; B, a SentencePiece model, reads the text and adds that space
itself. Both see the same bytes, so a token is given by its id and the offset of its end. The events of both
tokenizers go in one table (`events`; a row holds up to PACK of one side's ends, as ids: sizes follow from
the vocabulary), are dealt by document, sorted by offset within the task and streamed through `Sweep`. Its
state is one open group: offsets where both sides end cut the stream into groups, and each two neighbouring
ends enclose one linked pair. Documents of any length pass in slabs of bounded size.

Tokens are found segment by segment. Both tokenizers start anew where a space follows a character that
isn't white space, so a text is cut there and each distinct segment is encoded once per worker, while the store
of segments is below STORE bytes.

How many documents hold a linked pair of ids is counted over the whole corpus by an aggregate of each document's
distinct pairs. The counts are looked up in parts of at most PART pairs, each broadcast; a vocabulary with more
linked pairs takes more passes over the pairs, and sums of the parts add up.

A text that is null or empty, or that either tokenizer doesn't give back byte by byte, has no tokens, groups or
links. Repeated rows and ids stay rows of their own; ids are passed on, other columns are not read.
"""

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mereling.llm import scratch, words

#: Events of a row, tokens of a slab, bytes of text encoded at a time, bytes of the store of segments, pairs of a broadcast part.
PACK, SLAB, TEXT, STORE, PART = 2048, 1 << 16, 1 << 22, 128 << 20, 1 << 20
A, B = 0, 1
_state: dict = {}

# UTF-8 of the white space beyond ASCII, by its last byte, the one before, and the one before that (0: any).
_WHITE = [(0x85, 0xC2, 0), (0xA0, 0xC2, 0), (0x80, 0x9A, 0xE1), (0x8E, 0xA0, 0xE1), *((b, 0x80, 0xE2) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x9F, 0x81, 0xE2), (0x80, 0x80, 0xE3)]
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, their tokens' bytes, and the store of encoded segments; once per worker."""

    def __init__(self, json_file: str, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(json_file), sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.a.encode_special_tokens = True
        signs, n = byte_signs(), self.b.get_piece_size()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        a_bytes = [bytes(signs[c] for c in e) if all(c in signs for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(a_bytes), n) > 1 << 16:
            raise ValueError("vocabularies of at most 65,536 entries")
        self.bytes = a_bytes, b_bytes
        self.space = [self.b.piece_to_id("▁")]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.right = np.zeros(0, bool)  # whether both sides give the segment back
        self.ids, self.starts = [np.zeros(0, np.uint16)] * 2, [np.zeros(1, np.int64)] * 2

    def size(self) -> int:
        return sum(map(len, self.known)) + 100 * len(self.known) + sum(x.nbytes for x in self.ids)

    def numbers(self, segments: list[bytes]) -> np.ndarray:
        """The number of each segment in the store, encoding those that are new."""
        if new := [s for s in segments if s not in self.known]:
            texts = [s.decode("utf-8", "replace") for s in new]
            encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
            both = [e.ids for e in encode(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
            both[B][:] = [self.space if s == b" " else x for s, x in zip(new, both[B], strict=True)]
            right = [all(b"".join(map(self.bytes[k].__getitem__, both[k][i])) == s for k in (A, B)) for i, s in enumerate(new)]
            for side in (A, B):
                sizes = np.fromiter(map(len, both[side]), np.int64, len(new))
                flat = np.fromiter((t for ids in both[side] for t in ids), np.uint16, int(sizes.sum()))
                self.starts[side] = np.concatenate((self.starts[side], self.starts[side][-1] + np.cumsum(sizes)))
                self.ids[side] = np.concatenate((self.ids[side], flat))
            self.right = np.concatenate((self.right, np.array(right, bool)))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each side: the ids of all texts end to end, and each text's number of tokens. Texts have the space in front."""
        starts, ends, first = segments(data, offsets)
        codes, each = words.distinct(data, starts, ends)
        number = self.numbers(each.to_pylist())[codes]
        wrong = np.concatenate(([0], np.cumsum(~self.right[number])))
        none = (wrong[first[1:]] > wrong[first[:-1]]) | (np.diff(offsets) == 1)
        live = ~np.repeat(none, np.diff(first))
        out = []
        for side in (A, B):
            begin = self.starts[side][number]
            sizes = np.where(live, self.starts[side][number + 1] - begin, 0)
            total = np.concatenate(([0], np.cumsum(sizes)))
            out.append((self.ids[side][words.ragged(begin, sizes)], total[first[1:]] - total[first[:-1]]))
        if self.size() > STORE:
            self.clear()
        return out


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first segment of each text (one entry more): cut before a space after what isn't white space."""
    begin = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero((data[1:] == 0x20) & ~_ASCII_WHITE[data[:-1]]) + 1
    last = data[at - 1]
    white = np.zeros(len(at), bool)
    wide = np.flatnonzero(last >= 0x80)
    two, three = data[np.maximum(at[wide] - 2, 0)], data[np.maximum(at[wide] - 3, 0)]
    for x, y, z in _WHITE:
        white[wide] |= (last[wide] == x) & (two == y) & ((three == z) if z else True)
    begin[at[~white]] = True
    begin[offsets[:-1]] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def tokenizers(json_file: str, model_file: str) -> Tokenizers:
    key = (json_file, model_file)
    if key not in _state:
        _state[key] = Tokenizers(*key)
    return _state[key]


def _lengths(own: Tokenizers) -> list[np.ndarray]:
    return [np.fromiter(map(len, x), np.int64, len(x)) for x in own.bytes]


def packed(batches: Iterator[pa.RecordBatch], own: Tokenizers, row: int) -> Iterator[pa.RecordBatch]:
    """Rows of (id, text), numbered from `row` on, as rows of `events`."""
    lengths = _lengths(own)
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        for i, j, data, offsets in words.pieces(texts, TEXT):
            for side, (ids, n) in enumerate(own.encode(data, offsets)):
                packs = np.maximum(-(-n // PACK), side == A)
                doc = np.repeat(np.arange(j - i), packs)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(packs) - packs, packs)
                first = (np.cumsum(n) - n)[doc]
                begin = first + place * PACK
                total = np.concatenate(([0], np.cumsum(lengths[side][ids])))
                rows = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.append(begin, len(ids)) * 2), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([pa.array(row + i + doc), batch.column(0).take(pa.array(i + doc)), pa.array(total[begin] - total[first]), pa.array(np.full(len(doc), side, np.int8)), rows.cast(pa.binary())], ["key", "doc_id", "at", "side", "ids"])
        row += batch.num_rows


def events(docs: DataFrame, json_file: str, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ends of all tokens: key (of the row), doc_id, at (offset where the row's first token begins), side (0 A, 1 B), ids (16 bits each).

    A document without tokens has one row without ids.
    """
    run = lambda batches: packed(batches, tokenizers(json_file, model_file), TaskContext.get().partitionId() << 40)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"key long, doc_id {kind}, at long, side byte, ids binary")


def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with a comma after it, in six bytes, and how many of these it takes."""
    ids = np.arange(1 << 16)
    size = np.char.str_len(ids.astype(str))
    text = np.full((len(ids), 6), ord(","), np.uint8)
    for k in range(5):
        has = size > k
        text[has, k] = ord("0") + ids[has] // 10 ** (size[has] - 1 - k) % 10
    return text, size + 1


class Document:
    """A document that is being swept."""

    def __init__(self, key: int, doc_id):
        self.key, self.doc_id, self.hash, self.counts = key, doc_id, None, np.zeros(3, np.int64)
        self.pairs: list[np.ndarray] = []  # pair << 32 | times

    def add(self, counts: np.ndarray, text, pairs: np.ndarray) -> None:
        """counts: A tokens, B tokens, groups; text: the groups, each with a semicolon after it."""
        self.counts += counts
        if len(text):
            if self.hash is None:
                self.hash = hashlib.sha256()
            else:
                self.hash.update(b";")
            self.hash.update(text[:-1])
            self.pairs.append(pairs)
            if len(self.pairs) > 64:
                self.pairs = [self.merged()]

    def merged(self) -> np.ndarray:
        if len(self.pairs) < 2:
            return self.pairs[0] if self.pairs else np.zeros(0, np.int64)
        every = np.concatenate(self.pairs)
        each, back = np.unique(every >> 32, return_inverse=True)
        return each << 32 | np.bincount(back, weights=every & 0xFFFFFFFF).astype(np.int64)


class Sweep:
    """Ends of both sides in order of key and offset; gives a row for each document that has ended."""

    names = ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def __init__(self, lengths: list[np.ndarray], id_kind: pa.DataType):
        self.lengths, (self.text, self.size) = lengths, _digits()
        self.open: Document | None = None
        self.tails = [np.zeros(0, np.uint16)] * 2
        self.schema = pa.schema(zip(self.names, [pa.int64(), id_kind, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64())], strict=True))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sides = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            data, offsets = words.buffers(batch.column(4).cast(pa.large_binary()))
            i = 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 2 * SLAB, "right")) - 1)
                yield self.rows(self.slab(keys[i:j], batch.column(1).slice(i, j - i), sides[i:j], data[offsets[i] : offsets[j]].view(np.uint16), np.diff(offsets[i : j + 1]) // 2))
                i = j
        if self.open is not None:
            yield self.rows([self.open])

    def rows(self, docs: list[Document]) -> pa.RecordBatch:
        n = [d.counts.tolist() for d in docs]
        pairs = [d.merged() for d in docs]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in pairs], dtype=np.int64))).astype(np.int32)
        columns = [[d.key for d in docs], [d.doc_id for d in docs], *([x[k] for x in n] for k in range(3)), [a + b - g for a, b, g in n], ["" if d.hash is None else d.hash.hexdigest() for d in docs]]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *pairs])))
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=False)), lists], schema=self.schema)

    def slab(self, keys: np.ndarray, ids: pa.Array, sides: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> list[Document]:
        """Take the next rows; the documents that ended."""
        docs = [] if self.open is None else [self.open]
        new = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if self.open is None else self.open.key) != 0)
        docs += [Document(int(keys[r]), ids[r].as_py()) for r in new.tolist()]
        number = np.searchsorted(new, np.arange(len(keys)), "right") - 1 + (self.open is not None)
        side_of = np.repeat(sides, sizes)
        each = [np.concatenate((self.tails[s], tokens[side_of == s])) for s in (A, B)]
        doc = [np.concatenate((np.zeros(len(self.tails[s]), np.int64), np.repeat(number[sides == s], sizes[sides == s]))) for s in (A, B)]
        ends = [np.cumsum(self.lengths[s][each[s]]) for s in (A, B)]
        # where both end: each end of B with the token of A that reaches it
        over = np.searchsorted(ends[A], ends[B])
        both = over < len(ends[A])
        both[both] = ends[A][over[both]] == ends[B][both]
        common = np.flatnonzero(both)
        done = (int(over[common[-1]]) + 1, int(common[-1]) + 1) if len(common) else (0, 0)
        self.tails = [each[s][done[s] :] for s in (A, B)]
        a, b = each[A][: done[A]], each[B][: done[B]]
        doc_a, doc_b = doc[A][: done[A]], doc[B][: done[B]]
        over, both = over[: done[B]], both[: done[B]]
        ends_group = np.zeros(len(a), bool)
        ends_group[over[both]] = True
        # links: a pair for each end, of the two tokens that the bytes before it are in
        alone = np.flatnonzero(~ends_group)
        under = np.searchsorted(ends[B], ends[A][alone])
        links = np.concatenate((doc_b << 32 | a[over].astype(np.int64) << 16 | b, doc_a[alone] << 32 | a[alone].astype(np.int64) << 16 | b[under]))
        links, times = np.unique(links, return_counts=True)
        pairs = (links & 0xFFFFFFFF) << 32 | times
        cuts = np.searchsorted(links, np.arange(len(docs) + 1) << 32)
        # the text of the groups: A's ids of a group, then B's
        group_a, group_b = np.cumsum(ends_group) - ends_group, np.cumsum(both) - both
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        whole = np.empty(len(a) + len(b), np.uint16)
        whole[place_a], whole[place_b] = a, b
        size = self.size[whole]
        text = self.text[whole]
        for place, last, sign in ((place_a, ends_group, "|"), (place_b, both, ";")):
            text[place[last], size[place[last]] - 1] = ord(sign)
        text = text[np.arange(6) < size[:, None]].tobytes()
        n = len(docs)
        counts = np.stack((np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n), np.bincount(doc_b[both], minlength=n)), axis=1)
        upto = np.cumsum(np.bincount(doc_a, weights=self.size[a], minlength=n) + np.bincount(doc_b, weights=self.size[b], minlength=n)).astype(np.int64)
        begin = 0
        for i, (own, end) in enumerate(zip(docs, upto.tolist(), strict=True)):
            own.add(counts[i], text[begin:end], pairs[cuts[i] : cuts[i + 1]])
            begin = end
        self.open = docs[-1]
        return docs[:-1]


def sweep(found: DataFrame, json_file: str, model_file: str) -> DataFrame:
    """`events` to a row per document: key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs.

    groups_sha256: of the groups as `a1,a2|b1;a3|b2,b3`, ids in decimal; '' without tokens. pairs: the distinct
    linked pairs, each as A's id << 48 | B's id << 32 | how many links have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizers(json_file, model_file))
        first = next(batches, None)
        if first is not None:
            yield from Sweep(lengths, first.schema.field(1).type).run(chain([first], batches))

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.repartition("key").sortWithinPartitions("key", "at", "side").mapInArrow(run, f"key long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>")


def pair_counts(swept: DataFrame) -> DataFrame:
    """pair (A's id << 16 | B's id), docs: how many documents hold it linked, best: whether no pair of its A id is in more."""
    counts = swept.select(F.explode("pairs").alias("_p")).groupBy(F.shiftright("_p", 32).alias("pair")).agg(F.count(F.lit(1)).alias("docs"))
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("docs").alias("most"))
    return counts.join(most, F.shiftright(counts["pair"], 16) == most["a"]).select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, json_file: str, model_file: str, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is in as many documents as any pair of its A id. count_sum: over all links, in how
    many documents the link's pair is. The files must be at the same places on each worker.
    """
    swept = scratch.keep(sweep(events(docs, json_file, model_file, id_col, text_col), json_file, model_file), "aligned")
    counts = scratch.keep(pair_counts(swept), "pairs")
    parts = max(1, -(-counts.count() // part))
    each = swept.select("key", F.explode("pairs").alias("_p")).select("key", F.shiftright("_p", 32).alias("pair"), F.col("_p").bitwiseAND(0xFFFFFFFF).alias("times"))
    sums = None
    for k in range(parts):  # at most about `part` pairs at a time
        own = each.join(F.broadcast(counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k)), "pair")
        own = own.groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        sums = own if sums is None else sums.union(own)
    if parts > 1:
        sums = sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return swept.drop("pairs").join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
