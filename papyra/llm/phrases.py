"""Removal of repeated passages by sharded Aho-Corasick automata.

A window is ``window`` consecutive words of one document.  A word goes if a window over it also starts earlier.

1. Each window has an anchor: of the runs of ``anchor`` words in it, the one with the least hash.  Equal windows have
   equal anchors, and neighbouring windows mostly share theirs, so a document has one anchor in about seven words.
   Windows whose anchor occurs once in all the corpus occur once themselves; they are done with.
2. Around the anchors that recur, the windows that chose them are cut out as segments.  Equal segments collapse to one
   row with the earliest place, so a passage that a third of the documents share is a handful of rows from here on.
3. Recurring passages are confirmed: 128-bit digests of the windows of the distinct segments, counted with the
   earliest place of each.  Windows that occur once are dropped.
4. The confirmed windows are dealt into shards by their anchors.  Each task compiles the automaton of its shard over
   exact word numbers (pyahocorasick) and streams through it all segments whose anchors belong to that shard: text from
   elsewhere cannot match.  Each match is an occurrence of a window together with its earliest place.  Windows that lie
   in one distinct segment only are located already: their occurrences are that segment's own.
5. Every occurrence of a segment takes over its matches, starts that are not the earliest are gathered by document, and
   the documents are read once more to leave those words out.

A shard is bounded by ``shard_windows`` on average, whatever the corpus; the number of shards grows instead.  Joins on
keys that may be hot have plain exchanges on both sides, so Spark can split them.

Defined cases: a null, empty or blank text has no words (digest of the empty string); rows with a null doc_id count as
earlier than all others; rows with the same doc_id and the same text are one document, so none of them is earlier; rows
with the same doc_id and other texts are told apart by a hash of the text, which also orders them; other columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.words import Words, binary, gram_hashes, pieces, range_hashes, sliding_min, word_hashes, words_of
from papyra.workspace import Workspace

WINDOW = 20
ANCHOR = 8
SHARD_WINDOWS = 20_000
SENT_DIGESTS = 200_000
#: Odd multipliers of the hash functions: two for words, then for runs of words.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_PLACE = np.uint64((1 << 28) - 1)
_PLACE_SQL = "struct<doc:long,ver:int,at:int>"


def _anchors(hashes: np.ndarray, row: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``anchor`` words; starts of the windows inside one text; the anchor's place of each window."""
    runs = gram_hashes(hashes, anchor, _BASES[2])
    if len(hashes) < window:
        return runs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(runs), dtype=np.uint64)
    least = sliding_min((runs & ~_PLACE) | place, window - anchor + 1)
    starts = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    return runs, starts, (least[starts] & _PLACE).astype(np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), doc.alias("doc"), F.hash(text).alias("ver"))


def anchor_table(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(anchor, doc, ver, at)``: every place in ``_identified`` documents that some window chose as its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, doc, ver = binary(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for lo, hi in pieces(text):
                words = words_of(text, lo, hi)
                runs, _, place = _anchors(word_hashes(words, _BASES[0]), words.row, window, anchor)
                place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
                row = words.row[place]
                columns = [runs[place].view(np.int64), doc[lo:hi][row], ver[lo:hi][row], (place - words.first[row]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "doc", "ver", "at"])

    return docs.select("text", "doc", "ver").mapInArrow(run, "anchor long, doc long, ver int, at int")


def segment_table(docs: DataFrame, places: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(anchor, doc, ver, at, a, b, words)``: the windows that chose a recurring anchor: digest and words.

    The words are null where the same task has sent them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # digests whose words this task has sent lately
        for batch in batches:
            text, doc, ver, wanted = binary(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3)
            lists, ends = np.asarray(wanted.flatten()), np.cumsum([len(x) for x in wanted])
            for lo, hi in pieces(text):
                words = words_of(text, lo, hi)
                hashes = word_hashes(words, _BASES[0])
                runs, starts, place = _anchors(hashes, words.row, window, anchor)
                head = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
                tail = np.append(head[1:], len(place))
                # places asked for, as places in this piece
                mine = lists[(ends[lo - 1] if lo else 0) : ends[hi - 1]] + np.repeat(words.first[:-1], np.diff(np.append(ends[lo - 1] if lo else 0, ends[lo:hi])))
                chosen = np.isin(place[head], mine)
                head, tail = head[chosen], tail[chosen]
                if not len(head):
                    continue
                begin, finish, where = starts[head], starts[tail - 1] + window, place[head]
                row = words.row[begin]
                one, two = (range_hashes(h, begin, finish, base).view(np.int64) for h, base in ((hashes, _BASES[3]), (word_hashes(words, _BASES[1]), _BASES[2])))
                joined, wstart, wend = bytes(words.data), words.start, words.end
                if len(sent) > SENT_DIGESTS:
                    sent.clear()
                parts = []
                for key, p, q in zip(zip(one.tolist(), two.tolist(), strict=True), begin.tolist(), finish.tolist(), strict=True):
                    parts.append(None if key in sent else b" ".join([joined[i:j] for i, j in zip(wstart[p:q].tolist(), wend[p:q].tolist(), strict=True)]))
                    sent.add(key)
                columns = [runs[where].view(np.int64), doc[lo:hi][row], ver[lo:hi][row], (begin - words.first[row]).astype(np.int32), one, two]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], names=["anchor", "doc", "ver", "at", "a", "b", "words"])

    asked = docs.join(places.hint("shuffle_hash"), ["doc", "ver"]).select("text", "doc", "ver", "places")
    return asked.mapInArrow(run, "anchor long, doc long, ver int, at int, a long, b long, words binary")


def window_places(segments: DataFrame, window: int) -> DataFrame:
    """``(w1, w2, n, doc, ver, start, shift)``: digests of the windows of each distinct segment, with the window's earliest place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, rest = binary(batch.column(0)), [np.asarray(batch.column(k)) for k in range(1, 5)]
            for lo, hi in pieces(text):
                words = words_of(text, lo, hi)
                starts = np.flatnonzero(words.row[: len(words.row) - window + 1] == words.row[window - 1 :])
                one, two = (gram_hashes(word_hashes(words, b), window, _BASES[3])[starts].view(np.int64) for b in _BASES[:2])
                row = words.row[starts]
                shift = (starts - words.first[row]).astype(np.int32)
                n, doc, ver, at = (c[lo:hi][row] for c in rest)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, [one, two, n, doc, ver, at + shift, shift])), names=["w1", "w2", "n", "doc", "ver", "start", "shift"])

    return segments.select("words", "n", "first.doc", "first.ver", "first.at").mapInArrow(run, "w1 long, w2 long, n long, doc long, ver int, start int, shift int")


_MATCHES = "array<struct<shift:int,doc:long,ver:int,at:int>>"


def _locate(window: int):
    """A task over rows sorted by shard, patterns first: each segment's matches with the earliest place of what matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        shard, number, anchors, docs, vers, ats, automaton = None, {}, set(), [], [], [], None
        for batch in batches:
            rows, upto = [], [0]
            shift, doc, ver, at = [], [], [], []
            shards, is_text, words, anchor, first, shifts = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6, 7))
            for k in range(batch.num_rows):
                if shards[k] != shard:
                    shard, number, anchors, docs, vers, ats, automaton = shards[k], {}, set(), [], [], [], None
                if not is_text[k]:
                    if automaton is None:
                        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
                    anchors.add(anchor[k])
                    key = tuple([number.setdefault(w, len(number) + 1) for w in words[k].split(b" ")])
                    for n in shifts[k]:
                        automaton.add_word(key[n : n + window], len(docs))
                        docs.append(first[k]["doc"])
                        vers.append(first[k]["ver"])
                        ats.append(first[k]["at"] + n)
                elif anchor[k] in anchors:
                    if automaton.kind != ahocorasick.AHOCORASICK:
                        automaton.make_automaton()
                    for end, n in automaton.iter(tuple([number.get(w, 0) for w in words[k].split(b" ")])):
                        shift.append(end - window + 1)
                        doc.append(docs[n])
                        ver.append(vers[n])
                        at.append(ats[n])
                    if len(shift) > upto[-1]:
                        rows.append(k)
                        upto.append(len(shift))
            if rows:
                found = pa.StructArray.from_arrays([pa.array(shift, pa.int32()), pa.array(doc, pa.int64()), pa.array(ver, pa.int32()), pa.array(at, pa.int32())], names=["shift", "doc", "ver", "at"])
                yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(rows)), batch.column(5).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), found)], names=["a", "b", "matches"])

    return run


def repeated_starts(docs: DataFrame, work: Workspace, window: int = WINDOW, anchor: int = ANCHOR, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``(doc, ver, starts)``: starts of the windows of ``_identified`` documents that also start earlier."""
    anchors = work.table(anchor_table(docs, window, anchor), "anchors")
    often = work.table(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "recurring")
    places = work.table(anchors.join(often.hint("shuffle_hash"), "anchor").groupBy("doc", "ver").agg(F.collect_list("at").alias("places")), "places")
    work.drop("anchors", "recurring")
    segments = work.table(segment_table(docs, places, window, anchor), "segments")
    work.drop("places")
    first = F.min(F.struct("doc", "ver", "at")).alias("first")
    distinct = segments.groupBy("a", "b").agg(F.first("anchor").alias("anchor"), F.max("words").alias("words"), F.count("*").alias("n"), first)
    distinct = work.table(distinct, "distinct")
    earliest = F.min(F.struct("doc", "ver", "start", "shift")).alias("e")
    confirmed = window_places(distinct, window).groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.count("*").alias("segments"), earliest).where("n > 1")
    several = F.col("segments") > 1
    confirmed = confirmed.groupBy("e.doc", "e.ver", (F.col("e.start") - F.col("e.shift")).alias("at")).agg(F.collect_list(F.when(several, F.col("e.shift"))).alias("shifts"), F.collect_list(F.when(~several, F.col("e.shift"))).alias("own"))
    confirmed = work.table(confirmed, "confirmed")
    passages = distinct.join(confirmed.hint("shuffle_hash"), (F.col("first.doc") == F.col("doc")) & (F.col("first.ver") == F.col("ver")) & (F.col("first.at") == F.col("at")))
    passages = work.table(passages.select("anchor", "words", "a", "b", "first", "shifts", "own"), "passages")
    work.drop("confirmed")
    total = passages.agg(F.sum(F.size("shifts"))).first()[0] or 0
    shards = max(4096, -(-total // shard_windows))
    shard = F.expr(f"cast(pmod(xxhash64(anchor), {shards}) as int)").alias("shard")
    none = F.lit(None)
    patterns = passages.where("size(shifts) > 0").select(shard, F.lit(0).alias("is_text"), "words", "anchor", none.cast("long").alias("a"), none.cast("long").alias("b"), "first", "shifts")
    texts = distinct.select(shard, F.lit(1).alias("is_text"), "words", "anchor", "a", "b", none.cast(_PLACE_SQL).alias("first"), none.cast("array<int>").alias("shifts"))
    routed = patterns.unionByName(texts).repartition("shard").sortWithinPartitions("shard", "is_text")
    located = work.table(routed.mapInArrow(_locate(window), f"a long, b long, matches {_MATCHES}"), "located")
    work.drop("distinct")
    alone = passages.where("size(own) > 0").select("a", "b", F.expr("transform(own, s -> named_struct('shift', s, 'doc', first.doc, 'ver', first.ver, 'at', first.at + s))").cast(_MATCHES).alias("matches"))
    matches = work.table(located.union(alone), "matches")
    work.drop("passages", "located")
    later = F.expr("transform(filter(matches, m -> not (m.doc = doc and m.ver = ver and m.at = at + m.shift)), m -> at + m.shift)")
    moved = segments.select("a", "b", "doc", "ver", "at").join(matches.hint("shuffle_hash"), ["a", "b"]).select("doc", "ver", later.alias("starts")).where("size(starts) > 0")
    found = work.table(moved.groupBy("doc", "ver").agg(F.flatten(F.collect_list("starts")).alias("starts")), "starts")
    work.drop("segments", "matches")
    return found


def _kept(words: Words, starts: pa.Array, window: int) -> tuple[np.ndarray, list[bytes]]:
    """For each text the number of words removed, and the kept words joined by one space."""
    n = len(words.start)
    lists = np.asarray(starts.flatten())
    sizes = np.fromiter((len(x) if x.is_valid else 0 for x in starts), dtype=np.int64, count=len(starts))
    change = np.zeros(n + window + 1, dtype=np.int64)
    at = np.unique(lists + np.repeat(words.first[:-1], sizes))
    change[at] += 1
    change[at + window] -= 1
    stay = np.cumsum(change)[:n] == 0
    removed = np.bincount(words.row[~stay], minlength=len(starts))
    begin, end, row = words.start[stay], words.end[stay], words.row[stay]
    edge = np.zeros(len(words.data) + 1, dtype=np.int8)
    edge[begin] += 1
    edge[end] -= 1  # words never touch, so no place is both
    solid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    gaps = end[:-1][row[1:] == row[:-1]] if len(end) else end
    data = words.data.copy()
    data[gaps] = 0x20
    solid[gaps] = True
    upto = np.append(0, np.cumsum(np.bincount(row, weights=end - begin, minlength=len(starts)).astype(np.int64) + np.maximum(np.bincount(row, minlength=len(starts)) - 1, 0)))
    joined = data[solid].tobytes()
    return removed, [joined[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_windows: int = SHARD_WINDOWS, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept_text])`` for every row of ``docs``."""
    docs = _identified(docs)
    starts = repeated_starts(docs, Workspace(docs.sparkSession, "phrases"), window, anchor, shard_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = binary(batch.column(1))
            for lo, hi in pieces(text):
                words = words_of(text, lo, hi)
                removed, kept = _kept(words, batch.column(2).slice(lo, hi - lo), window)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    both = docs.join(starts.hint("shuffle_hash"), ["doc", "ver"], "left").select("doc_id", "text", "starts")
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_repeated_phrases": op1_phrases}
