"""Token counts: rank-synchronous merging of ragged arrays.

The pre-tokens of a batch are one array of symbols with the places where each begins.  In every round each
pre-token applies its lowest-ranked pair; what has no pair left is counted and leaves.  The rounds are numpy calls over all
pre-tokens at once, and their number is that of the merges of the longest one, not that of the words.

The ranks come from a sentencepiece model with byte fallback, and the counts are those of the library: the best score first, the
leftmost pair of equal ones first.  A merge may open a pair that ranks before it; where the model has such a pair only the
leftmost place of a pre-token is merged in a round, otherwise all places that do not overlap.  Text is cut into pre-tokens before
spaces and between characters that no piece holds side by side, since no merge crosses these.

Defined cases: null and empty texts have 0 bytes and 0 tokens; the strings of special tokens are plain text; a very long text is cut
between words into parts of a bounded size; a pre-token of more than ``ROUNDS`` characters is merged by a queue in time
n log n, with the same result; repeated rows and null ids are counted row by row; an empty table gives an empty result; columns
named like the result's give way to them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm import segments
from papyra.llm.rows import columns

LIMIT = 4096
#: Characters from which a pre-token is merged by a queue instead of rounds.
ROUNDS = 2000
#: Bytes of text whose distinct pre-tokens are merged at once.
BATCH_BYTES = 16 << 20
NONE = np.int32(2**31 - 1)


class Merges:
    """The pairs of a sentencepiece model of kind BPE as arrays; the model is given as bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = known.get_piece_size()
        plain = [i for i in range(n) if not (known.is_control(i) or known.is_byte(i) or known.is_unknown(i) or known.is_unused(i))]
        pieces = {known.id_to_piece(i): i for i in plain}
        letters = sorted({c for p in pieces for c in p})
        ids = dict(pieces)
        for c in letters:  # letters of pieces that are no pieces themselves: they may merge, and alone they fall to bytes
            ids.setdefault(c, n + len(ids))
        unknown = n + len(ids) + 4
        #: tokens that a symbol is in the end; the last four are letters of no piece, by their bytes
        self.weight = np.ones(unknown + 4, np.int64)
        for c in letters:
            if c not in pieces:
                self.weight[ids[c]] = len(c.encode())
        self.weight[unknown:] = [1, 2, 3, 4]
        point = np.arange(0x110000)
        self.symbol = (unknown + (point > 0x7F).astype(np.int32) + (point > 0x7FF) + (point > 0xFFFF)).astype(np.int32)
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(letters, 1):
            self.symbol[ord(c)], self.letter[ord(c)] = ids[c], k
        self.span, self.letters = len(self.weight), len(letters) + 1
        scores = sorted({known.get_score(i) for i in plain}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        rank = {i: rank[known.get_score(i)] for i in plain}
        made = [(ids[p[:k]] * self.span + ids[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        made.sort()
        self.keys, self.made = np.array([k for k, _ in made]), np.array([i for _, i in made], np.int32)
        self.rank = np.array([rank[i] for _, i in made], np.int32)
        #: ranks of which a merge never opens a pair of the same rank or one before it
        self.safe = np.ones(len(scores), bool)
        for key, i in made:
            for part in divmod(key, self.span):
                if part in rank and rank[i] <= rank[part]:
                    self.safe[rank[part]] = False
        self.sides = np.unique(np.array([self.letter[ord(a)] * self.letters + self.letter[ord(b)] for p in pieces for a, b in zip(p, p[1:])], np.int64))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair in ``keys``, the number of keys where there is none."""
        key = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, len(self.keys)).astype(np.int32)

    def counts(self, words: pa.Array) -> np.ndarray:
        """The tokens of each word, which has one space in front of it; spaces may be anywhere else in it."""
        text = "".join(segments.MARK + w.replace(" ", segments.MARK) for w in words.to_pylist())
        if not text:
            return np.zeros(len(words), np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        ends = np.cumsum(sizes)
        letter = self.letter[points].astype(np.int64)
        side = letter[:-1] * self.letters + letter[1:]
        at = np.searchsorted(self.sides, side)
        last = np.ones(len(points), bool)
        last[:-1] = self.sides[np.minimum(at, len(self.sides) - 1)] != side
        last[ends - 1] = True
        found = self._merged(self.symbol[points], last)
        total = np.append(0, np.cumsum(found))  # tokens of pre-tokens, then of words
        upto = np.append(0, np.cumsum(last))[np.append(0, ends)]
        return np.diff(total[upto])

    def _merged(self, sym: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; ``last`` marks where they end."""
        sizes = np.diff(np.append(-1, np.flatnonzero(last)))
        result = np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(sizes > ROUNDS):
            upto = int(sizes[: k + 1].sum())
            result[k] = self._queued(sym[upto - sizes[k] : upto].tolist())
        owner = np.flatnonzero(sizes <= ROUNDS)
        mine = np.repeat(sizes <= ROUNDS, sizes)
        sym, last, sizes = sym[mine], last[mine], sizes[owner]
        pair = np.full(len(sym), len(self.keys), np.int32)
        inner = np.flatnonzero(~last)
        pair[inner] = self.pairs(sym[inner], sym[inner + 1])
        ranks = np.append(self.rank, NONE)
        rank = ranks[pair]
        while len(owner):
            first = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, first)
            live = low < NONE
            if not live.all():
                over = ~live
                weight = np.add.reduceat(self.weight[sym], first)
                result[owner[over]] = weight[over]
                stay = np.repeat(live, sizes)
                sym, last, pair, rank = sym[stay], last[stay], pair[stay], rank[stay]
                owner, sizes, low = owner[live], sizes[live], low[live]
                if not len(owner):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            whose = np.searchsorted(np.cumsum(sizes), at, "right")
            ahead = np.append(True, whose[1:] != whose[:-1])  # the leftmost place of a pre-token
            begun = np.maximum.accumulate(np.where(ahead | np.append(True, np.diff(at) > 1), at, 0))
            take = ahead | (self.safe[low[whose]] & ((at - begun) % 2 == 0))
            at, whose = at[take], whose[take]
            sym[at] = self.made[pair[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, last, pair, rank = sym[stay], last[stay], pair[stay], rank[stay]
            sizes = sizes - np.bincount(whose, minlength=len(sizes))
            at = at - np.arange(len(at))
            pair[at] = len(self.keys)
            before = at[at > 0] - 1
            near = np.concatenate([at, before])
            near = near[~last[near]]
            pair[near] = self.pairs(sym[near], sym[near + 1])
            rank[at] = NONE
            rank[near] = ranks[pair[near]]
        return result

    def _queued(self, sym: list[int]) -> int:
        """The same for one long pre-token: places by rank and from the left, links to the next symbol."""
        index = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        before, after, queue = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1], []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (found := index.get(sym[i] * self.span + sym[j])):
                heapq.heappush(queue, (found[0], i, found[1], sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return int(sum(self.weight[s] for s in sym if s >= 0))


def counter(model: bytes) -> Callable[[pa.Array], np.ndarray]:
    """Counts the tokens of an array of texts."""
    merges = Merges(model)

    def count(texts: pa.Array) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        for rows, parts in segments.batches(texts, BATCH_BYTES):
            offsets, distinct, index = segments.segments(pc.replace_substring(parts, segments.MARK, " "), any_start=True)
            np.add.at(total, rows, np.add.reduceat(merges.counts(distinct)[index], offsets[:-1]))
        return total

    return count


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, kept: list[str] | None = None) -> DataFrame:
    """``kept`` columns (all by default) with n_bytes, n_tokens and over_limit of ``text``.

    The model, a file of fixed size, is read by the driver and travels with the job.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in (docs.columns if kept is None else kept) if c not in ("n_bytes", "n_tokens", "over_limit")]
    given = docs.select(F.struct(*columns(names)).alias("row") if names else F.lit(0).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.value)
        for batch in arrived:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(count(texts))], names=["row", "n_bytes", "n_tokens"])

    found = given.mapInArrow(run, schema)
    return found.select(*(["row.*"] if names else []), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), kept=["doc_id"])


QUERIES = {"op13_rank_synchronous_counts": op13_merging}
