"""Encoders and pair scorers that are plugged in, vectors that are reused, and exact Unicode normalisation.

An encoder is anything with ``encode(texts) -> array``; a factory makes one in each Python worker, once, so a model is loaded
there and not shipped.  The default hashes words into a vector and needs no model.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from papyra.functions.text import ACCENTED, MISSING, PLAIN, STOP_WORDS


@lru_cache(maxsize=200_000)
def _slot(word: str, dim: int) -> tuple[int, float]:
    h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    return h % dim, 1.0 - 2.0 * (h // dim % 2)


class HashingEncoder:
    """Words of Latin letters, each a signed one at the place of its MD5; vectors of length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall("[a-z]+", text.lower()):
                at, sign = _slot(word, self.dim)
                row[at] += sign
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encoded(rows: DataFrame, key: str, text: str = "text", factory: Callable[[], object] = HashingEncoder, batch: int = 64) -> DataFrame:
    """``(key, embedding)`` of every row, so many texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({key: part.iloc[:, 0], "embedding": list(encoder.encode(part.iloc[:, 1].fillna("").tolist()))})

    return rows.select(key, F.col(text).cast("string").alias("_text")).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def content_key(identity: str, *parts: Column) -> Column:
    """What a vector depends on: the encoder and the content."""
    return F.sha2(F.concat_ws("\x1f", F.lit(identity), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def reuse(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``(doc_id, action)`` of ``current(doc_id, content)`` against ``stored(doc_id, content)``: reuse, encode a changed one, encode a new one, drop."""
    both = current.join(stored.select("doc_id", F.col("content").alias("_was")), "doc_id", "full")
    action = F.when(F.col("content").isNull(), "drop").when(F.col("_was").isNull(), "new").when(F.col("content") == F.col("_was"), "reuse").otherwise("changed")
    return both.select("doc_id", action.alias("action"))


class OverlapScorer:
    """Share of the query's terms that the text has."""

    def __init__(self):
        import regex

        self.words, self.fold, self.stop = regex.compile(r"[\p{L}\p{N}_]{2,}"), str.maketrans(ACCENTED, PLAIN), set(STOP_WORDS)

    def terms(self, text: str) -> set[str]:
        return {w for w in self.words.findall((text if text.strip(" ") else MISSING).lower().translate(self.fold)) if w not in self.stop}

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        pairs = ((self.terms(q), self.terms(t)) for q, t in zip(queries, texts, strict=True))
        return [len(q & t) / len(q) if q else 0.0 for q, t in pairs]


def pair_scorer(factory: Callable[[], object] = OverlapScorer) -> Callable[[Column, Column], Column]:
    """A scorer of (query, text) for ``fusion.rerank``; the factory is called once for each task."""

    @pandas_udf(DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = factory()
        for queries, texts in batches:
            yield pd.Series(scorer.score(queries.fillna("").tolist(), texts.fillna("").tolist()))

    return scored


@pandas_udf(StringType())
def exact_title(titles: pd.Series) -> pd.Series:
    """NFKC, case folding, everything but letters and digits as one blank."""
    import regex

    other = regex.compile(r"[^\p{L}\p{N}]+")
    return titles.map(lambda t: None if t is None else other.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip())
