"""Language identification by nearest centroid.

A text becomes a vector of hashed n-grams (2 to 4 UTF-8 bytes, ASCII and Latin-1 letters lower-cased, everything else one
blank), weighted (1 + ln tf) * idf and scaled to length one.  Every language has up to ``clusters`` centroids; the language
of the nearest one by cosine is the prediction and the cosine its score.

A text that is too far from that centroid is rejected.  A short text cannot come near any centroid, so closeness is the
cosine over the root of the number of distinct n-grams below ``full_grams``.  Rows that the centroids have not seen are held
back for each language; the least closeness that is accepted is ``slack`` times the ``quantile`` of theirs.  So a text is
rejected that is far beyond nearly all unseen texts of its language: another language, another script, program code; a
strange or repetitive text in a known language stays.

The document frequencies come from all labelled rows.  The centroids are fitted on a bounded sample: the
``sample_rows`` labelled rows of each language with the least hashes of their doc_id, clustered in one small group per
language, and as many again are held back.  A count per language gives a bound on the hash that few rows pass, so no task
ranks a language.  The model has at most ``max_languages`` * clusters * ``buckets`` numbers, whatever the corpus, and goes
to the tasks as such.  Prediction is a map over whole texts: no shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; rows with a null doc_id are
never learned from and not held out; rows with a null lang are predicted only; repeated rows count as often as they
are there; without any labelled row everything is ``und``; more than ``max_languages`` labels are refused; ties go to the
language first by name; a very long text is counted whole, some millions of bytes at a time; other columns are ignored by
``identify`` and kept by ``accepted``, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.words import _offsets, binary
from papyra.operators.samples import SPACE

BUCKETS = 4096
ORDERS = (2, 3, 4)
SAMPLE_ROWS = 300
CLUSTERS = 4
QUANTILE, SLACK = 0.01, 0.65
MAX_LANGUAGES = 512
FULL_GRAMS = 200
#: Bytes of folded text whose n-grams are counted at once.
CHUNK = 4_000_000
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray  # (centroids, buckets)
    floors: np.ndarray  # least closeness that is accepted, of each centroid
    idf: np.ndarray


def _pieces(column: pa.Array, max_bytes: int = 2_000_000, max_rows: int = 256) -> Iterator[tuple[int, int]]:
    offsets, at = _offsets(column), 0
    while at < len(column):
        upto = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        upto = min(max(at + 1, upto), at + max_rows, len(column))
        yield at, upto
        at = upto


def _counts(column: pa.Array, lo: int, hi: int, buckets: int) -> np.ndarray:
    """n-gram counts, one row per text."""
    offsets = _offsets(column)[lo : hi + 1]
    buffer = column.buffers()[2]
    raw = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(offsets))
    data = _FOLD[raw]
    if len(raw) > 1:  # capitals of the Latin-1 supplement
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        data[1:][capital] += 0x20
    blank = data == 0x20
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    data, row = data[keep], row[keep]
    out = np.zeros((hi - lo) * buckets, dtype=np.float32)
    for at in range(0, len(data), CHUNK):
        part, rows = data[at : at + CHUNK + max(ORDERS) - 1].astype(np.uint32), row[at : at + CHUNK + max(ORDERS) - 1]
        code = part
        for n in range(2, max(ORDERS) + 1):
            count = min(CHUNK, len(part) - n + 1)  # n-grams that start in this chunk
            if count < 1:
                break
            code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
            if n in ORDERS:
                inside = rows[:count] == rows[n - 1 : n - 1 + count]
                slot = ((code[:count] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)
                out += np.bincount(rows[:count][inside].astype(np.int64) * buckets + slot[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(hi - lo, buckets)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    seen = counts > 0
    x = np.zeros_like(counts)
    x[seen] = 1 + np.log(counts[seen])
    x *= idf.astype(np.float32)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norms, 1e-12)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")


def document_frequencies(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """Of all learnable rows: how many have each n-gram bucket, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            text = binary(batch.column(0))
            n += len(text)
            for lo, hi in _pieces(text):
                total += (_counts(text, lo, hi, buckets) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(buckets), -1)), pa.array(np.append(total, n))], names=["bucket", "df"])

    rows = _learnable(docs).select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    found = {r["bucket"]: r["df"] for r in rows}  # one number a bucket
    return np.array([found.get(k, 0) for k in range(buckets)]), found.get(-1, 0)


def _cluster(x: np.ndarray, clusters: int) -> np.ndarray:
    """Centroids by spherical k-means.

    It starts from rows at even steps of the likeness to the mean; a cluster of less than a tenth of an even share
    is dropped, so that one odd row is no centroid.
    """
    order = np.argsort(x @ x.sum(axis=0), kind="stable")
    k = min(clusters, len(x))
    centroids = x[order[(np.arange(k) * 2 + 1) * len(x) // (2 * k)]]
    for _ in range(12):
        mine = np.argmax(x @ centroids.T, axis=1)
        sizes = np.bincount(mine, minlength=len(centroids))
        stay = np.flatnonzero(sizes >= max(1, len(x) / (10 * k)))
        sums = np.stack([x[mine == c].sum(axis=0) for c in stay])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def _closeness(counts: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    return cosines / np.sqrt(np.clip((counts > 0).sum(axis=1) / FULL_GRAMS, 1e-12, 1.0))


def _sample(docs: DataFrame, sample_rows: int, max_languages: int) -> DataFrame:
    """``(lang, text, id, hash)``: about four times the rows asked for of each language, those with the least hashes."""
    rows = _learnable(docs).where("text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("hash", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fit")), F.lit(SPACE)))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("least")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    bounds = {lang: max(least, SPACE * 8 * sample_rows // n) for lang, (n, least) in sizes.items()}
    table = docs.sparkSession.createDataFrame([*bounds.items()] or [("", 0)], "lang string, bound long")
    return rows.join(F.broadcast(table), "lang").where("hash <= bound").drop("bound")  # a row a language


def fit(docs: DataFrame, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS, slack: float = SLACK, quantile: float = QUANTILE, max_languages: int = MAX_LANGUAGES) -> Model:
    frequencies, n = document_frequencies(docs, buckets)
    idf = np.log((1 + n) / (1 + frequencies)) + 1

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hash", "id", "text"]).head(2 * sample_rows)
        texts = pa.array([t.encode() for t in rows["text"]], pa.binary())
        counts = np.concatenate([_counts(texts, lo, hi, buckets) for lo, hi in _pieces(texts)])[[_has_letter(t.as_py()) for t in texts]]
        if not len(counts):
            return pd.DataFrame({"lang": [], "floor": [], "centroid": []})
        x = _vectors(counts, idf)
        seen = np.arange(len(x)) % 2 == 0
        centroids = _cluster(x[seen], clusters)
        back = ~seen if len(x) > 1 else seen
        floor = np.quantile(_closeness(counts[back], (x[back] @ centroids.T).max(axis=1)), quantile)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "floor": floor * slack, "centroid": [c.tolist() for c in centroids.astype(np.float32)]})

    sample = _sample(docs, sample_rows, max_languages)
    fitted = sorted(sample.groupBy("lang").applyInPandas(group, "lang string, floor double, centroid array<float>").collect(), key=lambda r: (r["lang"], r["centroid"]))  # bounded
    languages = sorted({r["lang"] for r in fitted})
    of = np.array([languages.index(r["lang"]) for r in fitted], dtype=np.int64)
    centroids = np.array([r["centroid"] for r in fitted], dtype=np.float32).reshape(len(fitted), buckets)
    return Model(languages, of, centroids, np.array([r["floor"] for r in fitted]), idf)


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and rejections of an array of texts."""
    raw = binary(texts)
    names, scores, out = [UNKNOWN] * len(raw), np.zeros(len(raw)), np.ones(len(raw), dtype=bool)
    if not len(model.of):
        return names, scores, out
    for lo, hi in _pieces(raw):
        counts = _counts(raw, lo, hi, model.centroids.shape[1])
        cosines = _vectors(counts, model.idf) @ model.centroids.T
        best = np.argmax(cosines, axis=1)
        near = _closeness(counts, cosines[np.arange(hi - lo), best])
        for k in range(lo, hi):
            if _has_letter(raw[k].as_py()):
                names[k] = model.languages[model.of[best[k - lo]]]
                scores[k] = min(1.0, max(0.0, float(cosines[k - lo, best[k - lo]])))
                out[k] = near[k - lo] < model.floors[best[k - lo]]
    return names, scores, out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, out = predict(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(out)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns."""
    names = docs.columns
    at, plain = names.index("text"), docs.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = predict(batch.column(at), model)[2]
            yield batch.filter(pa.array(~out))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))


QUERIES = {"op2_language_centroids": op2_language}
