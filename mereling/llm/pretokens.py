"""Pre-tokens of a SentencePiece model whose pieces never cross a word start.

Such a model (checked by `splits_at_spaces`) sees a text as U+2581 in place of each space and
one more in front. No piece holds U+2581 after another character, so the best or merged pieces
of a text are those of its pre-tokens, each a run of spaces with what follows up to the next
space, one after the other. Texts are given here with that space in front (see `spaced`).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"


def splits_at_spaces(pieces: list[str]) -> bool:
    """Whether no piece has the space sign after another character."""
    return not any(SPACE in p.lstrip(SPACE) for p in pieces)


def spaced(column: pa.Array) -> pa.Array:
    """Each text with a space in front; null is ''; the space sign counts as a space, as in the model."""
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), SPACE, " ")
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string()))


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first pre-token of each text (one entry more), for `spaced` texts."""
    space = data == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offsets[:-1]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)
