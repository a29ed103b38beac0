"""Words of many texts at once: byte positions and 64-bit hashes of words by numpy, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64


@dataclass
class Words:
    """The words of some texts.  ``start``/``end``: byte positions in ``data``; ``row``: which text; ``first``: for each text its first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # len(texts) + 1


def pieces(column: pa.Array, max_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each; a longer text stands alone."""
    offsets = _offsets(column)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        upto = min(upto, len(column))
        yield at, upto
        at = upto


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    return np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def binary(column: pa.Array) -> pa.Array:
    """Texts as binary without nulls."""
    return column.cast(pa.binary()).fill_null(b"")


def words_of(column: pa.Array, lo: int, hi: int, fold: np.ndarray | None = None) -> Words:
    """Words of the texts ``lo`` to ``hi``; ``fold`` maps every byte first."""
    offsets = _offsets(column)[lo : hi + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    if fold is not None:
        data = fold[data]
    offsets = offsets - offsets[0]
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that have bytes
    begins[edges] = solid[edges]
    tails = edges[1:] - 1
    ends[tails] = solid[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(data, start, end, row, first)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(words: Words, base: int) -> np.ndarray:
    """A hash of each word's bytes; ``base`` is odd and names the hash function."""
    n = len(words.data)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((words.data.astype(U64) + U64(1)) * _powers(base, n), out=sums[1:], dtype=U64)
    shift = _powers(pow(base, -1, 1 << 64), n)[words.start] if n else np.zeros(0, U64)
    return mixed((sums[words.end] - sums[words.start]) * shift)


def gram_hashes(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words, one for each start; those that run over the end of a text are for the caller to leave out."""
    if len(hashes) < n:
        return hashes[:0]
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= U64(base)
        out += hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)


def range_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the words from ``begin`` to before ``end``."""
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * _powers(base, len(hashes)), out=sums[1:], dtype=U64)
    value = (sums[end] - sums[begin]) * _powers(pow(base, -1, 1 << 64), len(hashes))[begin]
    return mixed(value + mixed((end - begin).astype(U64)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - span :])
    return out
