"""Texts as bounded batches of distinct segments, which tokenizers may treat one by one.

A segment begins at a space that follows another character and ends before the next such space.  Both kinds of tokenizer
used here have a token boundary there and look at nothing beyond it: a piece model has no piece with a space inside or at
its end, and the byte-level pattern takes a space only together with what follows it.  So the tokens of a text are those of
its segments in order, and a batch encodes each distinct segment once.  Every segment stands for itself with one space
in front of it, as every text does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters from which a text is cut between two words into several parts.
LONG = 4 << 20
#: The mark by which piece models write a space; in a text it is one.
MARK = "▁"


def _cuts(text: str) -> list[str]:
    """Parts of a long text; the space between two of them is the one that every part has in front."""
    between, parts, at = re.compile(f"(?<=[^ {MARK}]) (?=[!-~])"), [], 0
    while len(text) - at > LONG:
        cut = between.search(text, at + LONG)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.end()
    return [*parts, text[at:]]


def batches(texts: pa.Array, batch_bytes: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each part, parts) of all texts that are neither null nor empty, about ``batch_bytes`` at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(sizes)
    group = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]) // batch_bytes if len(rows) else rows
    for g in np.unique(group):
        own = rows[group == g]
        found = texts.take(pa.array(own)).cast(pa.string())
        if sizes[own].max() <= LONG:
            yield own, found
            continue
        at, parts = [], []
        for row, text in zip(own, found.to_pylist(), strict=True):
            for part in _cuts(text) if len(text) > LONG else [text]:
                if part:
                    at.append(row)
                    parts.append(part)
                if sum(map(len, parts[-8:])) > LONG:
                    yield np.array(at), pa.array(parts, pa.string())
                    at, parts = [], []
        if at:
            yield np.array(at), pa.array(parts, pa.string())


def segments(texts: pa.Array, any_start: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(where each text begins in the list of segments, distinct segments without their first space, their numbers).

    With ``any_start`` every space after another character cuts (right for piece models); otherwise only one
    before a character that surely is no white space, so that the byte-level pattern cuts there too.
    """
    words = pc.split_pattern(texts, " ")
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    offsets = offsets - offsets[0]
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    filled = np.diff(ends) > 0
    starts = np.empty(len(flat), bool)
    starts[1:] = filled[:-1]
    if not any_start:
        data = np.frombuffer(flat.buffers()[2], np.uint8)
        lead = data[np.minimum(ends[:-1], len(data) - 1)] if len(data) else np.zeros(len(flat), np.uint8)
        # white space beyond ASCII begins with one of four bytes: U+0085, U+00A0, U+1680, U+2000 and so on, U+3000
        plain = filled & (((lead > 0x20) & (lead < 0x7F)) | ((lead >= 0xC3) & ~np.isin(lead, [0xE1, 0xE2, 0xE3])))
        starts[1:] &= plain[1:]
    starts[offsets[:-1]] = True
    if not starts.all():
        first = np.flatnonzero(starts)
        flat = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), flat), " ")
        offsets = np.append(np.cumsum(starts) - starts, len(first))[offsets]
    coded = flat.dictionary_encode()
    return offsets, coded.dictionary, coded.indices.to_numpy()
