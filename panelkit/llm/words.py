"""Words between ASCII white space, as columns and as hashes of whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)
# The first so many of eight bytes, as they are loaded.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in UTF-8 bytes, and where each word starts.

    A word is cut into pieces of eight bytes; each goes through a bijection that depends on
    its place, and the sum through another. Words of up to eight bytes of one length never
    collide, and no pattern of letters makes longer ones collide more often than chance.
    """
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = ends - starts
    pieces = (sizes + 7) // 8
    firsts = np.cumsum(pieces) - pieces
    place = np.arange(pieces.sum()) - np.repeat(firsts, pieces)
    at = np.repeat(starts, pieces) + 8 * place
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    eight = eight & _FIRST[np.minimum(8, np.repeat(ends, pieces) - at)]
    value = mix(mix(eight ^ STEP) + place.astype(np.uint64) * STEP)
    return mix(np.add.reduceat(value, firsts) ^ mix(sizes.astype(np.uint64))), starts


def text_blocks(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column with at most so many bytes (or one row):
    first row, row after the last, the bytes with a line feed after each row, and each
    row's start in them. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(n, max(first + 1, last))
        own = offsets[first:last + 1]
        part = raw[own[0]:own[-1]]
        sizes = np.diff(own)
        starts = own[:-1] - own[0] + np.arange(last - first)
        out = np.full(len(part) + (last - first), 10, np.uint8)
        keep = np.ones(len(out), bool)
        keep[starts + sizes] = False
        out[keep] = part
        yield first, last, out, starts
        first = last


def block_words(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a run of rows, and for each row the index of its first word
    (with one more entry at the end)."""
    hashes, at = word_hashes(data, lower)
    return hashes, np.append(np.searchsorted(at, starts, "left"), len(hashes))
