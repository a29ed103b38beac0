"""License scans: MinHash bands over overlapping text windows, then exact containment.

Words are runs of letters and digits, lower-cased; shingles are five words.  A template of n shingles belongs to the
class of windows of n shingles.  In a document, windows of that width start every ``width // 8`` shingles, so a window
lies within a sixteenth of its width of any place where the template may stand.  Each window is hashed by ``BANDS * ROWS``
minima; one equal band retrieves the template.  A retrieved template is verified exactly: the share of its distinct
shingles in the window and half a width on either side, which must be ``containment`` or more.

What is verified is containment, so the bands are set for the least Jaccard similarity of a window that this allows: a
copy with edits down to a containment of 0.8 has one of about 0.6 with its best window, and one that insertions spread over
the whole region about 0.25.  With 20 bands of one row a window of similarity s is retrieved with probability
1 - (1 - s)^20: above 0.9999 at 0.6 and 0.996 at 0.25, and several windows cover each place.  The tests measure recall on
edited, shortened and interspersed copies against brute force.

A minimum that equals a template's is a shingle of the template, so windows without any such shingle are left out before
hashing; nothing is lost by that.  Templates are a fixed, small list and go to the tasks; documents are not shuffled.

Defined cases: null, empty and short texts (under five words) match nothing; templates under five words are refused;
overlapping matches of one template are one match, the one with the highest containment, then the first; templates that
are parts of others are reported beside them; null doc_ids and repeated rows are reported like any other; a very long
text is hashed whole, in memory of some tens of bytes a byte; empty in, empty out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyra.llm.license_texts import TEMPLATES
from papyra.llm.words import binary, gram_hashes, mixed, pieces, word_hashes, words_of

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 20, 1
_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_FOLD = np.full(256, 0x20, dtype=np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def band_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that at least one band is equal."""
    return 1 - (1 - similarity**rows) ** bands


def _shingles(column: pa.Array, lo: int, hi: int):
    words = words_of(column, lo, hi, _FOLD)
    hashes = gram_hashes(word_hashes(words, _BASE), SHINGLE, _GRAM)
    inside = words.row[: len(hashes)] == words.row[SHINGLE - 1 :] if len(hashes) else np.zeros(0, bool)
    return words, hashes, inside


def _minima(shingles: np.ndarray) -> tuple[int, ...]:
    seeds = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    return tuple(mixed(shingles[None, :] ^ seeds[:, None]).min(axis=1).tolist())


def _index(templates: dict[str, str]) -> tuple[dict[int, dict], dict[str, np.ndarray]]:
    """By width of window: band keys to templates; and each template's distinct shingles."""
    sets, index = {}, {}
    for name, text in templates.items():
        column = pa.array([text.encode()], pa.binary())
        _, hashes, inside = _shingles(column, 0, 1)
        if not len(hashes):
            raise ValueError(f"{name} has fewer than {SHINGLE} words")
        sets[name] = np.unique(hashes[inside])
        minima, keys = _minima(hashes), index.setdefault(len(hashes), {})
        for band in range(BANDS):
            keys.setdefault((band, *minima[band * ROWS : band * ROWS + ROWS]), []).append(name)
    return index, sets


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, license, template, start_word, end_word, containment)``: one row per match."""
    templates = TEMPLATES if templates is None else templates
    index, sets = _index(templates)
    known = np.unique(np.concatenate(list(sets.values()))) if sets else np.zeros(0, np.uint64)
    maybe = np.zeros(1 << 16, dtype=bool)  # by the last 16 bits, to look up few shingles in full
    maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    names = ["doc_id", "license", "template", "start_word", "end_word", "containment"]

    def matches(hashes: np.ndarray, hits: np.ndarray) -> dict[str, list[tuple[float, int, int]]]:
        """Of one document: verified windows by template."""
        found: dict[str, list[tuple[float, int, int]]] = {}
        for width, keys in index.items():
            stride = max(1, width // 8)
            starts: set[int] = set()
            for p in hits.tolist():  # windows on the stride that hold p
                low = max(0, p - width + 1)
                starts.update(range(-(-low // stride) * stride, p + 1, stride))
            for start in sorted(starts):
                part = hashes[start : start + width]
                minima = _minima(part)
                for name in {n for band in range(BANDS) for n in keys.get((band, *minima[band * ROWS : band * ROWS + ROWS]), ())}:
                    low, high = max(0, start - width // 2), start + width + width // 2
                    near = np.flatnonzero(np.isin(hashes[low:high], sets[name]))
                    share = len(np.unique(hashes[low:high][near])) / len(sets[name])
                    if share >= containment:
                        found.setdefault(name, []).append((share, low + int(near[0]), low + int(near[-1]) + SHINGLE))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out = binary(batch.column(1)), [[] for _ in names]
            for lo, hi in pieces(text):
                words, hashes, inside = _shingles(text, lo, hi)
                some = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] & inside)
                some = some[np.isin(hashes[some], known)]
                for k in np.unique(words.row[some]).tolist():
                    first, last = int(words.first[k]), int(words.first[k + 1])
                    own = matches(hashes[first : last - SHINGLE + 1], some[words.row[some] == k] - first)
                    for name in sorted(own):
                        kept: list[tuple[float, int, int]] = []
                        for share, a, b in sorted(own[name], key=lambda m: (-m[0], m[1], m[2])):
                            if all(b <= x or a >= y for _, x, y in kept):
                                kept.append((share, a, b))
                        for share, a, b in sorted(kept, key=lambda m: m[1]):
                            for column, value in zip(out, (batch.column(0)[lo + k].as_py(), name.split("/")[0], name, a, b, round(share, 6)), strict=True):
                                column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id long, license string, template string, start_word long, end_word long, containment double")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_license_minhash": op5_licenses}
