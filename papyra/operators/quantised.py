"""Approximate nearest neighbours by quantised codes: two-level lists, distance tables, exact rescoring.

A vector belongs to the list of its nearest centroid in each half of its dimensions, so ``side`` centroids a half give side * side
lists, and lists go on growing with the root of the table although both codebooks come from a bounded sample.  Each vector is
kept as a code of one byte for every few dimensions.  A query visits the lists nearest to it, scores their codes by adding up
numbers from its own table (its inner products with all code centroids), and only what may be among the best k by these
estimates is scored by the vectors themselves.

How many lists are visited and how far below the k-th estimate a candidate is kept are calibrated on the sample, so that true
neighbours within the sample are met at the wanted recall.  Nothing that passes is cut: both are thresholds, not caps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.dense import _matrix, dot, normalised
from papyra.operators.ranking import top_k
from papyra.operators.samples import least_hashed
from papyra.workspace import Workspace

SAMPLE, CODES, CODE_DIMS, LIST_ROWS = 20_000, 256, 4, 5_000


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids, from rows at even steps; empty ones stay."""
    centroids = x[np.linspace(0, len(x) - 1, max(1, min(k, len(x)))).astype(int)].copy()
    for _ in range(rounds):
        mine = nearest(x, centroids)
        n = np.bincount(mine, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (x @ centroids.T), axis=1)


@dataclass
class Codebook:
    halves: list[np.ndarray]
    pieces: list[np.ndarray]
    probes: int = 1
    margin: float = 0.0

    @property
    def side(self) -> int:
        return len(self.halves[0])

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, 2, axis=1)

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.pieces), axis=1)

    def lists(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(h, c) for h, c in zip(self.split(x), self.halves, strict=True))
        return a * self.side + b

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, c) for p, c in zip(self.cut(x), self.pieces, strict=True)], axis=1).astype(np.uint8)

    def order(self, q: np.ndarray, first: int) -> np.ndarray:
        """The ``first`` lists of each query by the distance of both halves.

        Of a half only centroids among the first can belong to them, so no more than first * first sums are looked at.
        """
        far = [(c**2).sum(1) - 2 * (h @ c.T) for h, c in zip(self.split(q), self.halves, strict=True)]
        few = min(self.side, first)
        near = [np.argsort(d, axis=1, kind="stable")[:, :few] for d in far]
        sums = np.take_along_axis(far[0], near[0], 1)[:, :, None] + np.take_along_axis(far[1], near[1], 1)[:, None, :]
        best = np.argsort(sums.reshape(len(q), -1), axis=1, kind="stable")[:, :first]
        return np.take_along_axis(near[0], best // few, 1) * self.side + np.take_along_axis(near[1], best % few, 1)

    def estimates(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries and codes by tables."""
        out = np.zeros((len(q), len(codes)))
        for k, (part, centroids) in enumerate(zip(self.cut(q), self.pieces, strict=True)):
            out += (part @ centroids.T)[:, codes[:, k]]
        return out


def fit(x: np.ndarray, n: int, k: int, recall: float, lists_per_root: float, asked_rows: int = 256) -> Codebook:
    """Codebooks of one half of the unit vectors of a sample of a table of ``n``, calibrated on the half that they have not seen."""
    seen, x = (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    side = max(1, min(int(np.ceil((lists_per_root * n**0.5) ** 0.5)), len(seen) // 8 or 1))
    book = Codebook([_means(h, side) for h in np.array_split(seen, 2, axis=1)], [_means(p, CODES) for p in np.array_split(seen, max(1, -(-x.shape[1] // CODE_DIMS)), axis=1)])
    asked = x[:asked_rows]
    exact, guess = asked @ x.T, book.estimates(asked, book.codes(x))
    own = np.arange(len(asked))
    exact[own, own] = guess[own, own] = -np.inf
    wanted = min(k, len(x) - 1)
    if wanted < 1:
        return book
    best = np.argsort(-exact, axis=1, kind="stable")[:, :wanted]
    order = book.order(asked, book.side**2)
    turn = np.argsort(order, axis=1, kind="stable")
    turns = np.sort(np.take_along_axis(turn, book.lists(x)[best], axis=1).ravel())
    # the k-th estimate may lie above the k-th score, and the estimate of a neighbour below its own: both at once
    above = np.sort(np.sort(guess, axis=1)[:, -wanted] - np.take_along_axis(exact, best, axis=1)[:, -1])
    below = np.sort((np.take_along_axis(exact, best, axis=1) - np.take_along_axis(guess, best, axis=1)).ravel())
    share = recall**0.5  # each of both steps may lose so much
    level = lambda x: x[min(len(x) - 1, int(np.ceil(share * len(x))))]
    book.probes, book.margin = int(level(turns)) + 1, max(0.0, float(level(above) + level(below)))
    return book


@dataclass
class Search:
    """``neighbours``: query_id, doc_id, score, rank; ``work``: one row of lists, probes, estimated and rescored pairs."""

    neighbours: DataFrame
    work: DataFrame


def quantised_top_k(vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.94, lists_per_root: float = 2.0, sample: int = SAMPLE) -> Search:
    """The k nearest of ``vectors(doc_id, embedding)`` to each of ``queries(query_id, embedding)``; a query's own id is left out."""
    spark, work, n = vectors.sparkSession, Workspace(vectors.sparkSession, "quantised"), vectors.count()
    rows = least_hashed(vectors.select("embedding", "doc_id"), "doc_id", sample, "codebook").toPandas()
    if not len(rows):
        empty = spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        return Search(empty, spark.createDataFrame([(0, 0, 0, 0)], "lists long, probes long, estimated long, rescored long"))
    book = fit(_matrix(rows["embedding"]), n, k, recall, lists_per_root)
    shared = spark.sparkContext.broadcast(book)  # centroids of both halves and of the pieces

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                unit, own = _matrix(batch.column(1).to_pandas()), shared.value
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.lists(unit)), pa.array([c.tobytes() for c in own.codes(unit)], pa.binary())], names=["doc_id", "list", "code"])

    def visits(batches):
        for batch in batches:
            own = shared.value
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                unit = _matrix(part.column(1).to_pandas())
                found = own.order(unit, own.probes)
                width = found.shape[1]
                unit = np.repeat(unit, width, axis=0)
                ends = pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(part)), width))), pa.array(found.ravel()), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], names=["query_id", "list", "unit"])

    lists = work.table(vectors.where("doc_id is not null").select("doc_id", "embedding").mapInArrow(coded, "doc_id long, list long, code binary"), "lists")
    parts = lists.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))  # a long list is dealt into parts
    lists = lists.join(parts, "list").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)")).drop("parts")
    asked = queries.where("query_id is not null").select("query_id", "embedding").mapInArrow(visits, "query_id long, list long, unit array<double>")
    asked = asked.join(parts, "list").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")

    def estimated(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """What may be among the best k of this part by its estimates, and how many pairs were estimated."""
        names = ["query_id", "doc_id", "guess", "seen"]
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            own, docs = shared.value, right.column("doc_id").to_numpy()
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(docs), -1)
            for low in range(0, left.num_rows, 256):
                some = left.slice(low, 256)
                ids = some.column("query_id").to_numpy()
                guess = own.estimates(np.stack(some.column("unit").to_pandas().to_numpy()), codes)
                guess[ids[:, None] == docs[None, :]] = -np.inf
                least = np.partition(guess, -min(k, len(docs)), axis=1)[:, -min(k, len(docs))] - own.margin
                row, col = np.nonzero((guess >= least[:, None]) & np.isfinite(guess))
                first = np.append(True, row[1:] != row[:-1])[: len(row)]
                for column, found in zip(out, (ids[row], docs[col], guess[row, col], np.where(first, len(docs), 0)), strict=True):
                    column.append(found)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=names)

    found = asked.groupBy("list", "part").cogroup(lists.groupBy("list", "part")).applyInArrow(estimated, "query_id long, doc_id long, guess double, seen long")
    found = work.table(found, "estimated")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("guess").desc(), "doc_id"))
    level = found.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg((F.min("guess") - book.margin).alias("least"))
    close = work.table(found.join(level, "query_id").where("guess >= least").select("query_id", "doc_id"), "candidates")
    unit = queries.select("query_id", normalised(F.col("embedding")).alias("asked"))
    exact = close.join(vectors.select("doc_id", "embedding"), "doc_id").join(unit, "query_id").select("query_id", "doc_id", F.round(dot(F.col("asked"), normalised(F.col("embedding"))), 6).alias("score"))
    done = found.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("estimated")).crossJoin(close.agg(F.count("*").alias("rescored")))  # one row each
    return Search(top_k(exact, k), done.select(F.lit(book.side**2).cast("long").alias("lists"), F.lit(book.probes).cast("long").alias("probes"), "estimated", "rescored"))
