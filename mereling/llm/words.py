"""Words, spans and hashes of a whole Arrow batch of texts at once, in NumPy.

Texts are UTF-8 bytes laid end to end. A word is a run of bytes other than space, tab, line
feed, vertical tab, form feed and carriage return; these are single bytes in UTF-8, so words
never cut a character.

A word's hash joins its bytes eight at a time, a run's hash joins those of runs half as long, with a
mixing step at each join: unlike sums of powers, no pattern of letters or words makes two meet. Where
equality has to be exact, `distinct` numbers words by their bytes (Arrow's dictionary).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are worked on in pieces of about so many bytes, at least one text each.
PIECE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair of hashes, in this order."""
    out = mix(a + np.uint64(0x9E3779B97F4A7C15))
    out ^= b * np.uint64(0xD1342543DE82EF95)
    return mix(out)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on, for all places that have so many after them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, have, power, size = hashes[:0], 0, hashes, 1
    while True:
        if n & size:
            m = len(hashes) - have - size + 1
            out = join(out[:m], power[have : have + m]) if have else power
            have += size
        if 2 * size > n:
            return out if n > 1 else mix(out)
        power = join(power[:-size], power[size:])
        size *= 2


def fold(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of words [start, end); the work follows the longest."""
    out = mix((ends - starts).astype(np.uint64) + np.uint64(1))
    for k in range(int((ends - starts).max()) if len(starts) else 0):
        live = np.flatnonzero(starts + k < ends)
        out[live] = join(out[live], hashes[starts[live] + k])
    return out


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `size` bytes; null is ''."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    n = len(column)
    if not n:
        return
    data, offsets = buffers(column)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a large string or binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and first word of each text (one more entry than texts)."""
    black = ~WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = black[:-1]
    starts = np.flatnonzero(black & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = black[1:]
    ends = np.flatnonzero(black & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each span's bytes among the distinct ones, and those; spans are in order and don't overlap."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1  # where a span ends and the next begins, the two cancel
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    body = data if inside.all() else data[inside]
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    coded = spans.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, joined eight at a time; those of another salt are independent."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    out = mix(left.astype(np.uint64) + np.uint64(1 + (salt << 32)))
    live, at = np.arange(len(starts)), starts
    for _ in range(LONG // 8):
        live = live[left > 0] if len(live) else live
        if not len(live):
            return out
        at, left = at[left > 0], left[left > 0]
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (np.minimum(left, 8) * 8).astype(np.uint64))
        out[live] = join(out[live], eight[at] & keep)
        at, left = at + 8, left - 8
    raw = memoryview(data)
    for k in live[left > 0].tolist():  # the rare longer ones
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]], salt)
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the first word of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(first: np.ndarray, n: int) -> np.ndarray:
    """The places from which n words are in one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    own = owners(first)
    return np.flatnonzero(own[: total - n + 1] == own[n - 1 :])


def grams(tokens: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of all runs of n words within a text."""
    at = within(first, n)
    return at, runs(tokens, n)[at] if len(at) else np.zeros(0, np.uint64)


LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`split` into runs of ASCII letters, digits and non-ASCII bytes, and the bytes with A-Z lowered."""
    plain = np.where(LETTER[data], LOWER[data], np.uint8(0x20))
    return *split(plain, offsets), plain
