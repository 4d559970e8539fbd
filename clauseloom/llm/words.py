"""Words of texts in blocks of bounded size, for work with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a block holds; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class Block:
    """The texts of a batch from ``lo`` to ``hi``: their words in one column, text by text;
    text i has the words ``ends[i]`` to ``ends[i + 1]``."""

    def __init__(self, lo: int, words: list[list[bytes]] | pa.Array, ends: np.ndarray | None = None):
        if ends is None:
            ends, words = np.cumsum([0, *map(len, words)]), pa.array([w for text in words for w in text], pa.large_binary())
        self.lo, self.hi = lo, lo + len(ends) - 1
        self.ends, self.values = ends, words

    @cached_property
    def words(self) -> list[bytes]:
        """The words as Python has them, which takes far more room."""
        return self.values.cast(pa.large_binary()).to_pylist()

    def ids(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, equal for equal words of the block; and the words by number."""
        coded = self.values.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        ids, distinct = self.ids()
        return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[ids]

    def row(self) -> np.ndarray:
        """The text, from 0, that each word belongs to."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.ends))


def split(text: str | None) -> list[bytes]:
    """UTF-8 words between blanks and U+0009 to U+000D; none in a null text."""
    return text.encode().split() if text else []  # on bytes, split knows these six alone


def _cut(lo: int, texts: pa.Array) -> Block:
    """The block of ``texts``, without an object for each word."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))  # knows the six bytes of WORD's blanks alone
    at = lists.offsets.to_numpy()
    values = lists.values.slice(at[0], at[-1] - at[0])
    filled = pc.greater(pc.binary_length(values), 0)  # blanks at a text's ends make empty words
    ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[at - at[0]]
    return Block(lo, values.filter(filled), ends)


def blocks(texts: pa.Array | list[str | None]) -> Iterator[Block]:
    """Cuts a batch of texts into blocks. A block is no longer held here once it is out."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_string())
    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > lo and size + n > BLOCK_BYTES:
            yield _cut(lo, texts.slice(lo, i - lo))
            lo, size = i, 0
        size += n
    if len(texts):
        yield _cut(lo, texts.slice(lo))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of stretches of words that are put together from two."""
    x = left * _ODD[0] + right * _ODD[1]
    x ^= x >> np.uint64(31)
    x *= _ODD[2]
    return x ^ (x >> np.uint64(29))


def doubled(h: np.ndarray, step: int) -> np.ndarray:
    """From the hashes of all stretches of ``step`` words those of twice that."""
    return joined(h[:-step], h[step:]) if len(h) > step else h[:0]
