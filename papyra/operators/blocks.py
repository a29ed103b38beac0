"""Sparse search in blocks of documents: the rows of ``ranking.tfidf`` and ``ranking.bm25`` for many queries over many documents.

A row of the index is a block of documents: their ids and lengths, the distinct terms of the block in order with their frequencies in
it, and for each term the documents and counts.  Frequencies and norms come from these arrays by grouped sums, so no posting is a row
of a shuffle.  A search reads the index once, keeps the terms that are asked for, and multiplies each block of documents with each block
of queries; a task keeps the best k per query of what it has read, so what is shuffled grows with the queries and not with the pairs.
Neither the driver nor a task holds all queries or all documents.  Terms are 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import tokens
from papyra.operators.ranking import B, K1, bm25_idf, top_k
from papyra.workspace import Workspace

#: Words of a block, documents read at once, index entries of a bucket of terms, queries of a block, bytes of blocks that a task holds,
#: products summed at once, blocks handed to a task's code at once, asked terms read at once.
BLOCK_WORDS, ARROW_ROWS, BUCKET_ROWS, QUERY_BLOCK, HELD_BYTES, PRODUCTS, BLOCKS_AT_ONCE, TERMS_AT_ONCE = 400_000, 500, 2_000_000, 1024, 48 << 20, 2_000_000, 4, 65_536
#: A term in more than this share of a block's queries has a row of a matrix (so many at most), and if it is in more than this share of a
#: block's documents, both sides have; another term of more products than this is multiplied by itself.
DENSE, ROWS, FULL, SINGLE = 0.03, 2048, 0.15, 4096

INDEX = "block long, docs array<long>, dl array<int>, terms array<long>, counts array<int>, doc array<int>, tf array<int>"
LISTS = ["docs", "dl", "terms", "counts", "doc", "tf"]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The term of a pair of neighbours from the hashes of both words."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def _counted(sizes: np.ndarray, words: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of documents of so many words each: ``(term, document, count)`` in the order of term and document."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    if pairs and len(words) > 1:
        inside = owner[1:] == owner[:-1]
        terms = np.concatenate([words, pair_hash(words[:-1], words[1:])[inside]])
        owner = np.concatenate([owner, owner[1:][inside]])
    else:
        terms = words
    order = np.lexsort((owner, terms))
    terms, owner = terms[order], owner[order]
    first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])]) if len(terms) else np.zeros(0, np.int64)
    return terms[first], owner[first], np.diff(np.r_[first, len(terms)]).astype(np.int32)


def _lists(*values: np.ndarray) -> list[pa.ListArray]:
    """Each array as a column of one row."""
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values]


def _row(batch: pa.RecordBatch | pa.Table, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _written(work: Workspace, rows: DataFrame, name: str, at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """A table of what tasks make from so many rows at once."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", work.spark.conf
    before = conf.get(key)
    conf.set(key, str(at_once))
    try:
        return work.fresh(rows, name)
    finally:
        conf.set(key, before)


@dataclass
class Blocks:
    table: DataFrame
    work: Workspace
    n: DataFrame  # one row: n
    pairs: bool
    _norms: DataFrame | None = None

    @property
    def norms(self) -> DataFrame:
        """``(block, norms)``: the lengths of the TF-IDF vectors of a block's documents."""
        if self._norms is None:
            self._norms = _written(self.work, _norms(self), "norms")
        return self._norms

    @property
    def numbers(self) -> DataFrame:
        """One row: n, avgdl."""
        dl = self.table.select(F.explode("dl").alias("dl")).agg(F.avg("dl").alias("avgdl"))
        return self.n.crossJoin(dl).select("n", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)).alias("avgdl"))  # one row


def word_hashes(rows: DataFrame, key: str) -> DataFrame:
    words = rows.select(key, tokens(F.col("text")).alias("_words"))
    return words.select(key, F.transform("_words", lambda w: F.xxhash64(w)).alias("words"))


def build(docs: DataFrame, pairs: bool = True, work: Workspace | None = None) -> Blocks:
    """``docs(doc_id, text)``; ``pairs`` adds the pairs of neighbours, which TF-IDF counts."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, words, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            each, rows = np.concatenate(ids), np.concatenate(sizes)
            docs_, place = np.unique(each, return_inverse=True)  # rows of one id lie together
            dl = np.bincount(place, weights=rows, minlength=len(docs_)).astype(np.int32)
            term, doc, tf = _counted(rows, np.concatenate(words), pairs)
            if len(docs_) < len(each):
                doc = place[doc].astype(np.int32)
                key = np.lexsort((doc, term))
                term, doc, tf = term[key], doc[key], tf[key]
                first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
                term, doc, tf = term[first], doc[first], np.add.reduceat(tf, first).astype(np.int32) if len(first) else tf
            start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            values = _lists(docs_, dl, term[start], np.diff(np.r_[start, len(term)]).astype(np.int32), doc, tf)
            return pa.RecordBatch.from_arrays([pa.array([int(docs_[0])], pa.int64()), *values], names=["block", *LISTS])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, key = batch.column("words"), batch.column("doc_id").to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if held and held + len(flat) > BLOCK_WORDS and key[0] != ids[-1][-1]:
                yield block()
                ids, sizes, words, held = [], [], [], 0
            ids.append(key), sizes.append(size), words.append(flat)
            held += len(flat)
        if ids:
            yield block()

    rows = docs.where("doc_id is not null").select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    table = _written(work, word_hashes(rows, "doc_id").mapInArrow(run, INDEX), "blocks", ARROW_ROWS)
    return Blocks(table, work, work.table(docs.agg(F.count("*").alias("n")), "n"), pairs)


def _norms(index: Blocks) -> DataFrame:
    """Each term's postings of all blocks meet in one bucket, where its frequency is known; a bucket gives back one sum per document."""
    entries = index.table.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    n, buckets = index.n.first()["n"], max(1, -(-entries // BUCKET_ROWS))
    edges = np.linspace(-(2.0**63), 2.0**63, buckets + 1)[1:-1].astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, counts, doc, tf = (_row(batch, c, i) for c in ("terms", "counts", "doc", "tf"))
                cut, end = np.r_[0, np.searchsorted(terms, edges), len(terms)], np.r_[0, np.cumsum(counts)]
                size = len(batch.column("docs")[i])
                for b in range(buckets):
                    t, p = slice(cut[b], cut[b + 1]), slice(end[cut[b]], end[cut[b + 1]])
                    head = [pa.array([b], pa.int32()), pa.array([batch.column("block")[i].as_py()], pa.int64()), pa.array([size], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*head, *_lists(terms[t], counts[t], doc[p], tf[p])], names=["bucket", "block", "size", "terms", "counts", "doc", "tf"])

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        parts = [[_row(group, c, i) for c in ("terms", "counts")] for i in range(group.num_rows)]
        terms, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        _, place = np.unique(terms, return_inverse=True)
        idf = np.log((1 + n) / (1 + np.bincount(place, weights=counts))) + 1 if len(terms) else np.zeros(0)
        idf, at, sums = idf[place] if len(terms) else idf, 0, []
        for i in range(group.num_rows):
            own = idf[at : at + len(parts[i][0])]
            at += len(own)
            w = (1 + np.log(_row(group, "tf", i))) * np.repeat(own, parts[i][1])
            sums.append(np.bincount(_row(group, "doc", i), weights=w * w, minlength=group.column("size")[i].as_py()))
        return pa.table({"block": group.column("block"), "sums": pa.array(sums, pa.list_(pa.float64()))})

    def total(group: pa.Table) -> pa.Table:
        sums = sum(_row(group.combine_chunks(), "sums", i) for i in range(group.num_rows))
        return pa.table({"block": group.column("block")[:1], "norms": pa.array([np.sqrt(sums)], pa.list_(pa.float64()))})

    dealt = index.table.mapInArrow(deal, "bucket int, block long, size int, terms array<long>, counts array<int>, doc array<int>, tf array<int>")
    return dealt.groupBy("bucket").applyInArrow(meet, "block long, sums array<double>").groupBy("block").applyInArrow(total, "block long, norms array<double>")


def _folder(work: Workspace, rows: DataFrame, label: str) -> str:
    """Where tasks find the rows."""
    name = f"{label}-{uuid.uuid4().hex[:12]}"
    work.table(rows, name)
    return work.path(name)


def rows_in(folder: str, at_once: int = 1, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, so many at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with store.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(at_once, columns=columns)


def _places(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms that both have lie in either; both are in order."""
    at = np.searchsorted(terms, wanted)
    inside = np.flatnonzero(at < len(terms))
    hit = inside[terms[at[inside]] == wanted[inside]]
    return at[hit], hit


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def frequencies(index: Blocks, terms: DataFrame) -> DataFrame:
    """``(term, df)`` of those ``terms(term)`` that the index has."""
    folder = _folder(index.work, terms.select("term").distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(_row(batch, "terms", i), _row(batch, "counts", i)) for i in range(batch.num_rows)]
            for asked in rows_in(folder, TERMS_AT_ONCE, ["term"]):
                asked = np.sort(asked.column(0).to_numpy(zero_copy_only=False))
                for t, n in own:
                    at, _ = _places(t, asked)
                    yield pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(n[at].astype(np.int64))], names=["term", "df"])

    found = index.table.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return _written(index.work, found, "frequencies")


def asked_terms(index: Blocks, queries: DataFrame) -> DataFrame:
    """``(query_id, term, tf)`` of ``queries(query_id, text)``."""
    pairs = index.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("words"), batch.column("query_id").to_numpy(zero_copy_only=False)
            term, row, tf = _counted(np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), pairs)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(term), pa.array(tf)], names=["query_id", "term", "tf"])

    hashed = word_hashes(queries.where("query_id is not null"), "query_id")
    rows = _written(index.work, hashed.mapInArrow(run, "query_id long, term long, tf int"), "asked", ARROW_ROWS)
    return rows.groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))


def trimmed(index: Blocks, asked: DataFrame) -> DataFrame:
    """The index with those terms alone that ``asked(term)`` has, each block with its norms where the index has pairs."""
    folder = _folder(index.work, asked.select("term").distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_row(batch, "terms", i) for i in range(batch.num_rows)]
            kept = [[np.zeros(0, np.int64)] for _ in own]
            for terms in rows_in(folder, TERMS_AT_ONCE, ["term"]):
                terms = np.sort(terms.column(0).to_numpy(zero_copy_only=False))
                for i, t in enumerate(own):
                    kept[i].append(_places(t, terms)[0])
            for i, t in enumerate(own):
                at, counts = np.sort(np.concatenate(kept[i])), _row(batch, "counts", i)
                starts = np.cumsum(counts) - counts
                p = _spans(starts[at], counts[at].astype(np.int64))
                values = _lists(_row(batch, "docs", i), _row(batch, "dl", i), t[at], counts[at], _row(batch, "doc", i)[p], _row(batch, "tf", i)[p])
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), *values], names=["block", *LISTS])

    blocks = index.table.count()
    parts = max(1, min(blocks, max(int(index.work.spark.conf.get("spark.sql.shuffle.partitions")), blocks // 8)))
    found = index.table.mapInArrow(run, INDEX)
    found = found.join(index.norms, "block") if index.pairs else found
    return _written(index.work, found.repartition(parts, "block"), "trimmed")


def _packed(asked: DataFrame, skip: DataFrame | None, work: Workspace) -> str:
    """The folder of the queries in blocks: their ids, terms in order with their queries and weights, and documents to leave out."""
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERY_BLOCK))
    dealt = F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)").alias("deal")
    skip = asked.select("query_id", F.lit(0).cast("long").alias("doc_id")).limit(0) if skip is None else skip.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id")).where("query_id is not null and doc_id is not null").distinct()

    def pack(rows: pa.Table, left_out: pa.Table) -> pa.Table:
        ids, terms, weights = (rows.column(c).to_numpy() for c in ("query_id", "term", "weight"))
        queries, place = np.unique(ids, return_inverse=True)
        order = np.lexsort((place, terms))
        terms, place, weights = terms[order], place[order].astype(np.int32), weights[order]
        start = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        out_q, out_doc = left_out.column("query_id").to_numpy(), left_out.column("doc_id").to_numpy()
        known = np.isin(out_q, queries)
        values = _lists(queries, terms[start], np.diff(np.r_[start, len(terms)]).astype(np.int32), place, weights, np.searchsorted(queries, out_q[known]).astype(np.int32), out_doc[known])
        return pa.Table.from_arrays(values, names=["queries", "terms", "counts", "q", "w", "out_q", "out_doc"])

    left, right = asked.select("query_id", "term", "weight", dealt).groupBy("deal"), skip.select("query_id", "doc_id", dealt).groupBy("deal")
    schema = "queries array<long>, terms array<long>, counts array<int>, q array<int>, w array<double>, out_q array<int>, out_doc array<long>"
    return _folder(work, left.cogroup(right).applyInArrow(pack, schema), "packed")


def prepared(queries: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A block of queries with the weights of its most common terms as rows of a matrix; ``line`` is a term's row in it, or -1."""
    n, counts = len(queries["queries"]), queries["counts"]
    starts = np.cumsum(counts, dtype=np.int64) - counts
    common = np.flatnonzero(counts > DENSE * n)
    common = np.sort(common[np.argsort(-counts[common], kind="stable")[:ROWS]])
    line, matrix = np.full(len(counts), -1), np.zeros((len(common), n))
    line[common] = np.arange(len(common))
    p = _spans(starts[common], counts[common].astype(np.int64))
    matrix[np.repeat(line[common], counts[common]), queries["q"][p]] = queries["w"][p]
    return queries | {"starts": starts, "line": line, "matrix": matrix}


def product(docs: dict[str, np.ndarray], queries: dict[str, np.ndarray]) -> np.ndarray:
    """``(queries, documents)``: the sums over common terms of weight and part."""
    nq, m = len(queries["queries"]), len(docs["docs"])
    out = np.zeros(nq * m)
    table = out.reshape(nq, m)
    at, asked = _places(docs["terms"], queries["terms"])
    dn, qn, ds, qs = docs["counts"][at].astype(np.int64), queries["counts"][asked].astype(np.int64), docs["starts"][at], queries["starts"][asked]
    line, pairs = queries["line"][asked], dn * qn
    both = np.flatnonzero((line >= 0) & (dn > FULL * m))  # common on both sides: a product of matrices
    for some in np.array_split(both, -(-len(both) // 256)) if len(both) else ():
        right, p = np.zeros((len(some), m)), _spans(ds[some], dn[some])
        right[np.repeat(np.arange(len(some)), dn[some]), docs["doc"][p]] = docs["part"][p]
        table += queries["matrix"][line[some]].T @ right
    common = np.flatnonzero((line >= 0) & (dn <= FULL * m))  # common in queries: rows of the matrix for each document
    if len(common):
        p, row = _spans(ds[common], dn[common]), np.repeat(line[common], dn[common])
        doc = docs["doc"][p]
        order = np.argsort(doc, kind="stable")
        part, row, sums = docs["part"][p][order], row[order], np.zeros((m, nq))
        ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=m))]
        for i in np.flatnonzero(np.diff(ends)):
            sums[i] = part[ends[i] : ends[i + 1]] @ queries["matrix"][row[ends[i] : ends[i + 1]]]
        table += sums.T
    for i in np.flatnonzero((line < 0) & (pairs > SINGLE)):
        q, d = slice(qs[i], qs[i] + qn[i]), slice(ds[i], ds[i] + dn[i])
        table[np.ix_(queries["q"][q], docs["doc"][d])] += np.outer(queries["w"][q], docs["part"][d])
    few = np.flatnonzero((line < 0) & (pairs <= SINGLE))
    for some in np.split(few, np.searchsorted(np.cumsum(pairs[few]), np.arange(PRODUCTS, pairs[few].sum() if len(few) else 0, PRODUCTS))):
        p = _spans(qs[some], qn[some])  # postings of queries, each with the postings of documents of its term
        size = np.repeat(dn[some], qn[some])
        d = _spans(np.repeat(ds[some], qn[some]), size)
        cell = np.repeat(queries["q"][p].astype(np.int64) * m, size) + docs["doc"][d]
        value = np.repeat(queries["w"][p], size) * docs["part"][d]
        if len(cell) * 8 > len(out):
            out += np.bincount(cell, weights=value, minlength=len(out))
        else:
            np.add.at(out, cell, value)
    return table


def parts(index: Blocks, asked: DataFrame, part: Callable[[dict], np.ndarray]) -> DataFrame:
    """``(doc_id, term, part)``: a row for each posting of the terms of ``asked(term)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = _read(batch, i, part)
                yield pa.RecordBatch.from_arrays([pa.array(d["docs"][d["doc"]]), pa.array(np.repeat(d["terms"], d["counts"])), pa.array(d["part"])], names=["doc_id", "term", "part"])

    return _written(index.work, trimmed(index, asked).mapInArrow(run, "doc_id long, term long, part double"), "parts")


def _read(batch: pa.RecordBatch, i: int, part: Callable[[dict], np.ndarray]) -> dict[str, np.ndarray]:
    d = {c: _row(batch, c, i) for c in batch.schema.names if c != "block"}
    return d | {"starts": np.cumsum(d["counts"], dtype=np.int64) - d["counts"], "part": part(d)}


def best_k(row: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by score, then id."""
    order = np.lexsort((doc, -score, row))
    row, doc, score = row[order], doc[order], score[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k
    return row[keep], doc[keep], score[keep]


def search(index: Blocks, asked: DataFrame, part: Callable[[dict], np.ndarray], k: int, exclusions: DataFrame | None = None) -> DataFrame:
    """The best k of ``asked(query_id, term, weight)``; ``part`` gives what each posting of a block counts."""
    asked = index.work.fresh(asked.select("query_id", "term", "weight"), "weights")
    folder = _packed(asked, exclusions, index.work)

    def found(held: list[dict]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(folder):
            q = prepared({c: _row(batch, c, 0) for c in batch.schema.names})
            nq = len(q["queries"])
            best, floor = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(nq)
            for d in held:
                s, m = product(d, q), len(d["docs"])
                at, hit = _places(d["docs"], np.unique(q["out_doc"])) if len(q["out_doc"]) else (np.zeros(0, np.int64), None)
                if len(at):
                    out = np.flatnonzero(np.isin(q["out_doc"], d["docs"][at]))
                    s[q["out_q"][out], np.searchsorted(d["docs"], q["out_doc"][out])] = 0.0
                open_ = np.flatnonzero(floor == 0)
                least = floor.copy()
                if len(open_) and m > k:
                    least[open_] = np.partition(s[open_], m - k, axis=1)[:, m - k]
                row, col = np.nonzero((s > 0) & (s >= (least - 2e-6)[:, None]))
                best = best_k(*(np.concatenate([a, b]) for a, b in zip(best, (row, d["docs"][col], np.round(s[row, col], 6)), strict=True)), k)
                full = np.bincount(best[0], minlength=nq) >= k
                last = np.zeros(nq)
                last[best[0]] = best[2]  # in order, so the last of a query is its least
                floor = np.where(full, last, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(q["queries"][best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(_read(batch, i, part))
                size += sum(x.nbytes for x in held[-1].values())
                if size > HELD_BYTES:
                    yield from found(held)
                    held, size = [], 0
        if held:
            yield from found(held)

    rows = trimmed(index, asked).mapInArrow(run, "query_id long, doc_id long, score double")
    return top_k(_written(index.work, rows, "found"), k)


def tfidf_asked(index: Blocks, queries: DataFrame) -> DataFrame:
    """``(query_id, term, qw, idf, length)``: weights of the queries' terms, and the length of each query."""
    terms = index.work.fresh(asked_terms(index, queries), "terms")
    idf = frequencies(index, terms).crossJoin(F.broadcast(index.n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    rows = terms.join(idf, "term").select("query_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("qw"), "idf")
    return rows.withColumn("length", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("query_id"))))


def cosine_part(d: dict) -> np.ndarray:
    return (1 + np.log(d["tf"])) / d["norms"][d["doc"]]


def bm25_asked(index: Blocks, queries: DataFrame) -> DataFrame:
    """``(query_id, term, weight)``; a query is a set of words."""
    words = word_hashes(queries.where("query_id is not null"), "query_id").select("query_id", F.explode_outer("words").alias("term")).where("term is not null").distinct()
    words = index.work.fresh(words, "terms")
    df = frequencies(index, words).crossJoin(F.broadcast(index.n))  # one row
    return words.join(df, "term").select("query_id", "term", bm25_idf(F.col("df"), F.col("n")).alias("weight"))


def bm25_part(index: Blocks, k1: float = K1, b: float = B) -> Callable[[dict], np.ndarray]:
    avgdl = index.numbers.first()["avgdl"]
    return lambda d: d["tf"] * (k1 + 1) / (d["tf"] + k1 * (1 - b + b * d["dl"][d["doc"]] / avgdl))


def tfidf(index: Blocks, queries: DataFrame, k: int, exclusions: DataFrame | None = None) -> DataFrame:
    """The rows of ``ranking.tfidf``."""
    asked = tfidf_asked(index, queries).select("query_id", "term", (F.col("qw") / F.col("length") * F.col("idf")).alias("weight"))
    return search(index, asked, cosine_part, k, exclusions)


def bm25(index: Blocks, queries: DataFrame, k: int, exclusions: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """The rows of ``ranking.bm25``."""
    return search(index, bm25_asked(index, queries), bm25_part(index, k1, b), k, exclusions)
