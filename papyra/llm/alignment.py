"""Cross-tokenizer alignment: identity map as the fast path, pair shuffle for the rest.

Tokenizer A is byte-level BPE (a ``tokenizers`` file), B a sentencepiece model with byte fallback.  The offsets where tokens of both
end cut a text into groups; every A token of a group is linked with every B token of it.

An array as long as A's vocabulary gives for each A id the B id of the same bytes.  A link of such a pair (all exact one-to-one groups
are such links) is counted in a vector of that length.  Only the other pairs are counted by a shuffle: each block of documents sends
a pair once, with the number of its documents.  The first pass encodes the distinct segments of a block and writes per document
its links, packed, and per block its pairs; the second brings the corpus-wide counts back to the blocks.

Defined cases: texts that are null or empty, or whose joined token bytes differ from space + text (those with U+2581), have no tokens and
no links; strings of special tokens are plain text; very long texts are blocks of their own and are encoded in parts cut between
words; groups of many tokens are linked by distinct ids with their products, which is the same; repeated rows count as documents of
their own, null ids too; columns named like the result's give way to them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from papyra.llm import segments
from papyra.llm.rows import columns
from papyra.workspace import Workspace

ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: Links of a group from which they are counted by distinct ids.
WIDE = 1024
#: Words that a tokenizer gets at once, and segments of texts whose links are counted at once.
AT_ONCE, WORDS = 10_000, 150_000
#: Words in one text for tokenizer A, which has a cost for each text.
JOINED = 32
#: Bytes of text in a block, and bytes whose distinct segments are encoded at once.
BLOCK_BYTES, BATCH_BYTES = 4 << 20, 2 << 20
#: Rows that Spark hands over at once; blocks gather them.
ARROW_ROWS = 1000
#: Columns of documents and of blocks between the passes, for Arrow and for Spark.
FACTS = [pa.field(c, t) for c, t in (("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("same_n", pa.int32()), ("other_n", pa.int32()), ("same", pa.binary()), ("other", pa.binary()))]
LISTS = [pa.field(c, pa.list_(pa.int32())) for c in ("pair_a", "pair_b", "pair_docs", "same_a", "same_docs")]


def byte_alphabet() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of their tokens; the files are given by what they hold."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        ids = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(segments.MARK, " ").encode())
        by_bytes: dict[bytes, int] = {}
        for i, x in enumerate(b_bytes):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (x not in by_bytes or self.b.is_byte(by_bytes[x])):
                by_bytes[x] = i
        self.twin = np.array([by_bytes.get(x, -1) for x in a_bytes], np.int64)
        self.bytes = [pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes)]
        self.names = [pa.array([str(i) for i in range(len(t))]) for t in (a_bytes, b_bytes)]


class Encoded(NamedTuple):
    """Distinct segments: which are whole, their tokens, groups and links, links as (pair, times) by segment, groups as text."""

    whole: np.ndarray
    facts: np.ndarray
    start: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    text: pa.Array


def _flat(texts: list[str], ids: Callable[[list[str]], list[list[int]]], at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, their ids), from ``at_once`` texts at a time: what the libraries return is large."""
    sizes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(texts), at_once):
        some = ids(texts[k : k + at_once])
        sizes.append(np.fromiter(map(len, some), np.int64, len(some)))
        found.append(np.fromiter(chain.from_iterable(some), np.int64, int(sizes[-1].sum())))
    return np.concatenate(sizes), np.concatenate(found)


def _same_bytes(pair: Pair, k: int, n: np.ndarray, ids: np.ndarray, want: pa.Array) -> np.ndarray:
    """Which segments' tokens, joined, are the segment's bytes."""
    own = pair.bytes[k].take(pa.array(ids))
    joined = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), own)
    return pc.equal(pc.binary_join(joined, b""), want.cast(pa.binary())).to_numpy(zero_copy_only=False)


def _of_a(pair: Pair, words: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``plain`` words follow one another in texts of ``JOINED`` words, which A cuts before each."""
    spaced = [" " + w for w in words]
    texts = ["".join(spaced[k : min(k + JOINED, plain)]) for k in range(0, plain, JOINED)]
    _, ids = _flat(texts, lambda some: [e.ids for e in pair.a.encode_batch_fast(some, add_special_tokens=False)], AT_ONCE // JOINED)
    ends, tokens = np.cumsum([len(w.encode()) for w in spaced[:plain]]), np.cumsum(pair.sizes[0][ids])
    n = np.diff(np.append(0, np.searchsorted(tokens, ends, "right")))
    n_rest, rest = _flat(spaced[plain:], lambda some: [e.ids for e in pair.a.encode_batch_fast(some, add_special_tokens=False)], AT_ONCE)
    return np.append(n, n_rest), np.append(ids, rest)


def plain_first(words: pa.Array) -> tuple[np.ndarray, int]:
    """An order that puts words that begin with a printable ASCII character first, and their number."""
    plain = pc.match_substring_regex(words, "^[!-~]").to_numpy(zero_copy_only=False)
    return np.argsort(~plain, kind="stable"), int(plain.sum())


def encode(pair: Pair, words: pa.Array, plain: int) -> Encoded:
    given = words.to_pylist()
    n_a, a = _of_a(pair, given, plain)
    n_b, b = _flat(given, lambda some: pair.b.encode(some, num_threads=1), AT_ONCE)
    want = pc.binary_join_element_wise("", words, " ")
    whole = _same_bytes(pair, 0, n_a, a, want) & _same_bytes(pair, 1, n_b, b, want)
    if not whole.all():
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = n_a * whole, n_b * whole
    ends_a, ends_b = np.cumsum(pair.sizes[0][a]), np.cumsum(pair.sizes[1][b])
    total = int(ends_a[-1]) if len(ends_a) else 0
    in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    in_a[ends_a], in_b[ends_b] = True, True
    cut_a, cut_b = np.flatnonzero(in_b[ends_a]) + 1, np.flatnonzero(in_a[ends_b]) + 1  # where groups end in the tokens
    begin_a, begin_b = np.append(0, cut_a)[:-1], np.append(0, cut_b)[:-1]
    g_a, g_b = cut_a - begin_a, cut_b - begin_b
    groups = np.diff(np.append(0, np.searchsorted(cut_a, np.cumsum(n_a), "right")))
    segment = np.repeat(np.arange(len(groups)), groups)
    links = np.bincount(segment, g_a * g_b, len(groups)).astype(np.int64)
    # every token of A in a group, once for each token of B in it
    narrow = g_a * g_b <= WIDE
    of_a = np.repeat(np.arange(len(g_a))[narrow], g_a[narrow])
    left = a[np.repeat(narrow, g_a)]
    each = g_b[of_a]
    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    key = (np.repeat(left, each) << 32) | b[np.repeat(begin_b[of_a], each) + place]
    owner, times = np.repeat(segment[of_a], each), np.ones(len(key), np.int64)
    for g in np.flatnonzero(~narrow):
        x, y = Counter(a[begin_a[g] : cut_a[g]].tolist()), Counter(b[begin_b[g] : cut_b[g]].tolist())
        more = [((i << 32) | j, m * n) for i, m in x.items() for j, n in y.items()]
        key, times = np.append(key, [k for k, _ in more]), np.append(times, [n for _, n in more])
        owner = np.append(owner, np.full(len(more), segment[g]))
    if not narrow.all():
        order = np.argsort(owner, kind="stable")
        key, times, owner = key[order], times[order], owner[order]

    def joined(k: int, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        at = pa.array(np.append(begin, len(ids)).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(at, pair.names[k].take(pa.array(ids))), ",")

    text = pc.binary_join_element_wise(joined(0, a, begin_a), joined(1, b, begin_b), "|")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(groups)).astype(np.int32)), text), ";")
    start = np.append(0, np.cumsum(np.bincount(owner, minlength=len(groups))))
    return Encoded(whole, np.stack([n_a, n_b, groups, links]), start, key, times, text)


def pack(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and how often each occurs, as compressed bytes."""
    steps = np.diff(numbers, prepend=0)
    return pa.compress(np.concatenate([steps, times]).astype("<i4").tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def unpack(packed: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(pa.decompress(packed, size * 8, codec="zstd", asbytes=True), "<i4").astype(np.int64)
    return np.cumsum(both[:size]), both[size:]


class Block:
    """The documents of a block: their facts, the hashes of their groups, and their links, all in numbers of the block."""

    def __init__(self, pair: Pair, texts: pa.Array):
        n, self.pair = len(texts), pair
        self.facts, self.whole = np.zeros((4, n), np.int64), np.ones(n, bool)
        hashes, found = [None] * n, []
        marked = pc.fill_null(pc.match_substring(texts, segments.MARK), False)
        for rows, parts in segments.batches(pc.if_else(marked, "", texts), BATCH_BYTES):
            offsets, distinct, index = segments.segments(parts, any_start=False)
            order, plain = plain_first(distinct)
            coded = encode(pair, distinct.take(pa.array(order)), plain)
            index = np.argsort(order)[index]
            self.whole[rows[~np.logical_and.reduceat(coded.whole[index], offsets[:-1])]] = False
            np.add.at(self.facts, (slice(None), rows), np.add.reduceat(coded.facts[:, index], offsets[:-1], axis=1))
            for low in range(0, len(rows), 256):
                at = offsets[low : low + 257]
                lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), coded.text.take(pa.array(index[at[0] : at[-1]])))
                for row, text in zip(rows[low : low + 256], pc.binary_join(lists, ";"), strict=True):
                    if hashes[row] is None:
                        hashes[row] = hashlib.sha256()
                    else:
                        hashes[row].update(b";")
                    hashes[row].update(text.as_buffer())
            found += self._links(rows, offsets, index, coded)
        self.hash = [h.hexdigest() if h and ok else "" for h, ok in zip(hashes, self.whole, strict=True)]
        self.facts[:, ~self.whole] = 0
        doc, key, times = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        kept = self.whole[doc]
        self._number(doc[kept], key[kept], times[kept])

    @staticmethod
    def _links(rows: np.ndarray, offsets: np.ndarray, index: np.ndarray, coded: Encoded) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, times), some texts at a time: each segment of a text taken once with its count."""
        width, (pairs, own) = len(coded.start) - 1, np.unique(coded.pair, return_inverse=True)
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + WORDS, "right")) - 1)
            at = offsets[low : high + 1]
            seen, often = np.unique(np.repeat(np.arange(high - low), np.diff(at)) * width + index[at[0] : at[-1]], return_counts=True)
            text, segment = np.divmod(seen, width)
            n = np.diff(coded.start)[segment]
            place = np.repeat(coded.start[segment] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            code, times = np.repeat(text, n) * len(pairs) + own[place], coded.times[place] * np.repeat(often, n)
            order = np.argsort(code)
            code, times = code[order], times[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
            if len(first):
                text, pair = np.divmod(code[first], len(pairs))
                yield rows[low + text], pairs[pair], np.add.reduceat(times, first)
            low = high

    def _number(self, doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        a, b = key >> 32, key & 0xFFFFFFFF
        same = self.pair.twin[a] == b
        width = len(self.pair.twin)
        self.pairs, own = np.unique(key[~same], return_inverse=True)
        code = a
        code[~same] = width + own
        span = width + len(self.pairs)
        order = np.argsort(doc * span + code)
        code, doc, times = code[order], doc[order], times[order]
        first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(code) != 0))[: len(doc)])
        self.times = np.add.reduceat(times, first) if len(first) else times
        self.doc, self.code, self.width = doc[first], code[first], width
        self.docs = np.bincount(self.code, minlength=span)

    def rows(self, block: int, given: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each document and one for the block."""
        n = len(given)
        at = np.searchsorted(self.doc, np.arange(n + 1))
        same, other, sizes = [], [], np.zeros((2, n), np.int32)
        for i in range(n):
            code, times = self.code[at[i] : at[i + 1]], self.times[at[i] : at[i + 1]]
            cut = int(np.searchsorted(code, self.width))
            sizes[:, i] = cut, len(code) - cut
            same.append(pack(code[:cut], times[:cut]))
            other.append(pack(code[cut:] - self.width, times[cut:]))
        ids = [None] * 5
        docs = [pa.array(np.full(n, block)), given, *map(pa.array, self.facts), pa.array(self.hash), pa.array(sizes[0]), pa.array(sizes[1]), pa.array(same, pa.binary()), pa.array(other, pa.binary())]
        yield pa.RecordBatch.from_arrays([*docs, *(pa.nulls(n, f.type) for f in list(schema)[-5:])], schema=schema)
        seen = np.flatnonzero(self.docs[: self.width])
        ids = [self.pairs >> 32, self.pairs & 0xFFFFFFFF, self.docs[self.width :], seen, self.docs[seen]]
        own = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in ids]
        yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.nulls(1, f.type) for f in list(schema)[1:-5]), *own], schema=schema)


@dataclass
class Alignment:
    """``documents``: the rows with the columns in ``ADDED``; ``pairs``: a, b, docs for every linked pair of ids."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, kept: list[str] | None = None) -> Alignment:
    """``kept`` columns of ``docs`` (all by default).  Both files are of fixed size, read by the driver, and travel with the job."""
    spark, work, files = docs.sparkSession, Workspace(docs.sparkSession, "alignment"), []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(spark.sparkContext.broadcast(f.read()))
    names = [c for c in (docs.columns if kept is None else kept) if c not in ADDED]
    given = docs.select(F.struct(*columns(names)).alias("row") if names else F.lit(0).alias("row"), F.col("text").cast("string").alias("text"))
    between = [T.StructField(f.name, from_arrow_type(f.type)) for f in (*FACTS, *LISTS)]
    first = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", given.schema["row"].dataType), *between])

    def encode_blocks(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = Pair(files[0].value, files[1].value), TaskContext.get().partitionId() << 32
        schema, texts, rows, size = None, [], [], 0
        for batch in arrived:
            if schema is None:
                schema = pa.schema([pa.field("block", pa.int64()), batch.schema.field(0), *FACTS, *LISTS])
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (size + np.cumsum(sizes) - sizes) // BLOCK_BYTES  # a block ends with the row that fills it
            for g in np.unique(group):
                if g and texts:
                    yield from Block(pair, pa.concat_arrays(texts)).rows(block, pa.concat_arrays(rows), schema)
                    block, texts, rows, size = block + 1, [], [], 0
                low, high = np.searchsorted(group, [g, g + 1])
                texts.append(batch.column(1).slice(low, high - low))
                rows.append(batch.column(0).slice(low, high - low))
                size += int(sizes[low:high].sum())
        if texts:
            yield from Block(pair, pa.concat_arrays(texts)).rows(block, pa.concat_arrays(rows), schema)

    at_once = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    try:
        coded = work.table(given.mapInArrow(encode_blocks, first), "blocks")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    blocks = coded.where("pair_a is not null")
    sent = blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("at", "p"))
    sent = sent.select("block", "at", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_docs").alias("docs"))
    counts = work.table(sent.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "pairs")
    same = blocks.select(F.explode(F.arrays_zip("same_a", "same_docs")).alias("p")).groupBy(F.col("p.same_a").alias("a")).agg(F.sum("p.same_docs").alias("docs"))
    # both have a row for each id of A's vocabulary at most
    twins, most = same.collect(), counts.groupBy("a").agg(F.max("docs").alias("docs")).collect()
    pair = Pair(files[0].value, files[1].value)
    vector, best = np.zeros(len(pair.twin), np.int64), np.zeros(len(pair.twin), np.int64)
    for r in twins:
        vector[r.a] = best[r.a] = r.docs
    for r in most:
        best[r.a] = max(best[r.a], r.docs)
    vectors = spark.sparkContext.broadcast((vector, best))

    def judge(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        vector, best = vectors.value
        at = pairs.column("at").to_numpy()
        count, top = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        count[at] = pairs.column("docs").to_numpy()
        top[at] = pairs.column("docs").to_numpy() == best[pairs.column("a").to_numpy()]
        n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for i, (same, n, other, m) in enumerate(zip(*(docs.column(c).to_pylist() for c in ("same", "same_n", "other", "other_n")), strict=True)):
            a, x = unpack(same, n)
            k, y = unpack(other, m)
            total[i] = vector[a] @ x + count[k] @ y
            n_best[i] = x[vector[a] == best[a]].sum() + y[top[k]].sum()
        return docs.drop_columns(["block", "same", "same_n", "other", "other_n"]).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total))

    back = sent.drop("docs").join(counts, ["a", "b"]).select(F.col("block").alias("home"), "at", "a", "docs")
    facts = coded.where("pair_a is null").select("block", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "other", "other_n")
    last = T.StructType([f for f in facts.schema if f.name not in ("block", "same", "same_n", "other", "other_n")] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])
    judged = facts.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(judge, last)
    twin = spark.createDataFrame([(int(a), int(pair.twin[a]), int(vector[a])) for a in np.flatnonzero(vector)], "a int, b int, docs long")
    return Alignment(judged.select(*(["row.*"] if names else []), *ADDED), counts.unionByName(twin))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"]).documents


QUERIES = {"op12_identity_map_alignment": op12_alignment}
