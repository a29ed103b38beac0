"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become canonical words: lower-cased words without punctuation, in which numbers, names (capitalised words inside
a sentence) and units (right after a number) are typed placeholders.  Windows of ``window`` canonical words, the templates,
are hashed on both sides and joined.  A window with placeholders has a second hash, of its plain words, so that a copy in
capitals or in lower case, which shows no names, still has the windows of the item.  A window of placeholders alone stands for its
plain words only: tables of numbers do not hold each other, a verbatim copy does.

A document holds a benchmark item if it has at least ``containment`` of the item's template windows and the slots agree:
every value in the item's placeholders goes with one value in the document's (the same one in a copy, another one in a
question with new numbers and names), for at least ``containment`` of the slots.  A window may stand in many places of a
document and of an item, so both are asked of alignments: for each shift at which any window stands, the nearest place of
every window, out to each distance that holds enough windows; and the first place of every window.  One alignment that
meets both is enough.

The benchmark side is broadcast only while its windows, counted first, are at most ``broadcast_rows``; a larger benchmark
is joined by exchanges on both sides, which Spark may split where a window is hot.  Document windows are matched before
anything is shuffled or grouped, so only matches move.  Candidates are a written table, so Spark knows its size when it
chooses how to fetch their texts.  Values are read from those texts alone.

Defined cases: null, empty or wordless texts and items match nothing; a text of fewer words than a window has one
window, all of it, so an item that short is found only in a document that is nothing else; rows with the same doc_id and
text are one document and rows with the same doc_id and other texts are judged apart (a doc_id is reported once per item,
with its best text; ``without_benchmark`` leaves out the bad texts only); null doc_ids are judged too, as one id; an item_id
that is repeated is one item per distinct text; a very long text costs one row of numbers a word and is not cut; ties
between alignments go to the greater containment, then to more consistent slots; empty tables give an empty result; other
columns are ignored and kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.rows import columns
from papyra.workspace import Workspace

WINDOW = 5
CONTAINMENT = 0.8
BROADCAST_ROWS = 500_000
PAIR = ("doc", "ver", "item")
#: Units that make a placeholder after a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl dl l gal s sec min h hr hrs hz khz mhz ghz kb mb gb tb w kw v a j kj n pa kpa bar k c f percent usd eur gbp dollar dollars euro euros cent cents "
    "second seconds minute minutes hour hours day days week weeks month months year years metre metres meter meters kilometre kilometres kilometer kilometers mile miles gram grams kilogram kilograms litre litres liter liters"
).split()
NUMBER, NAME, UNIT = "#number", "#name", "#unit"
#: Marks before a unit and before a name; they sort before digits, and digits before letters.
_UNIT, _NAME = "\x01", "\x02"
#: A capitalised word after a word or a comma, which is inside a sentence, over any white space between them.
_NAMED = r"(?=\p{Lu})(?<=[\p{L}\p{N},;]\s{1,8})(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
_UNITED = rf"(\d[\s-]{{0,4}})((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{N}}])"
_WORD = r"[\x01\x02]?\p{L}[\p{L}\p{N}]*|\p{N}[\p{L}\p{N}]*(?:[.,]\p{N}+)*"


def words_column(text: Column) -> Column:
    """Lower-cased words in order; units and names carry their marks."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(F.contains(plain, F.lit(_UNIT)) | F.contains(plain, F.lit(_NAME)), F.translate(plain, _UNIT + _NAME, "  ")).otherwise(plain)
    marked = F.regexp_replace(F.regexp_replace(plain, F.lit(_NAMED), F.lit(_NAME + "$1")), F.lit(_UNITED), F.lit(f"$1{_UNIT}$2"))
    return F.regexp_extract_all(F.lower(marked), F.lit(_WORD), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _forms(words: Column) -> Column:
    """The canonical and the plain words as fields canon and plain."""
    canon = F.transform(words, lambda w: F.when(w >= ":", w).when(w >= "0", NUMBER).when(w >= _NAME, NAME).otherwise(UNIT))
    plain = F.transform(words, lambda w: F.when(w >= "0", w).otherwise(F.substring(w, 2, 1 << 30)))
    return F.struct(canon.alias("canon"), plain.alias("plain"))


def _canonised(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with the canonical and the plain words of ``text``."""
    return rows.select(*keys, _let(words_column(F.col("text")), _forms).alias("x")).select(*keys, "x.canon", "x.plain")


def _hashes(words: Column, window: int) -> Column:
    last = F.greatest(F.size(words) - window, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, window)).alias("h")))


def _canon_hashes(forms: Column, window: int) -> Column:
    """Hashes of canonical windows; one of placeholders alone says nothing, so it goes by its plain words."""
    last = F.greatest(F.size(forms["canon"]) - window, F.lit(0))
    cut = lambda words, i: F.slice(words, i + 1, window)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.when(F.array_max(cut(forms["canon"], i)) < ":", F.xxhash64(cut(forms["plain"], i))).otherwise(F.xxhash64(cut(forms["canon"], i))).alias("h")))


def _templates(forms: Column, window: int) -> Column:
    """Place and hash of each window of canonical words, and of its plain words where those are others."""
    none = F.array().cast("array<struct<at:int,h:bigint>>")
    other = lambda c, p: F.filter(F.zip_with(c, p, lambda x, y: F.when(x["h"] != y["h"], y)), lambda y: y.isNotNull())
    both = _let(_canon_hashes(forms, window), lambda c: F.concat(c, other(c, _hashes(forms["plain"], window))))
    return F.when(F.size(forms["canon"]) == 0, none).when(forms["canon"] == forms["plain"], _hashes(forms["canon"], window)).otherwise(both)


def _windows(rows: DataFrame, window: int, *keys: str) -> DataFrame:
    """``keys`` with the place and hash of each template window of ``text``.

    The outer form of the generator spares a filter on its input, for which Spark would compute all of it twice.
    """
    found = _let(words_column(F.col("text")), lambda words: _let(_forms(words), lambda forms: _templates(forms, window)))
    return rows.select(*keys, F.inline_outer(found)).where("h is not null")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and doc, ver: what tells documents apart."""
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("ver"))


def _places(texts: DataFrame, pairs: DataFrame, parts: DataFrame, facts: DataFrame, small: bool, window: int) -> DataFrame:
    """For each pair every place in the document of each item window, as a shift against the item, with its slots' values."""
    held = _windows(texts, window, *PAIR[:2]).join(F.broadcast(parts) if small else parts, "h").join(pairs.select(*PAIR), list(PAIR), "left_semi")
    both = held.join(texts.select("doc", "ver", F.col("plain").alias("words")), ["doc", "ver"]).join(F.broadcast(facts.drop("item_id")) if small else facts.drop("item_id"), "item")
    slots = F.expr(f"""filter(transform(sequence(0, {window - 1}),
        o -> case when get(item_canon, item_at + o) in ('{NUMBER}', '{NAME}', '{UNIT}') and get(words, at + o) is not null
             then named_struct('i', item_at + o, 'a', get(item_words, item_at + o), 'b', get(words, at + o)) end), x -> x is not null)""")
    return both.select(*PAIR, "item_at", (F.col("at") - F.col("item_at")).cast("long").alias("shift"), slots.alias("slots")).distinct()


def _alignments(places: DataFrame) -> DataFrame:
    """``PAIR``, origin, picked: for each shift in a pair the place of each item window that is nearest to it, and how far away that is.

    The origin below all shifts takes the first place of each window.  Two sorts of places and origins, no pairs of places.
    """
    start = -(2**40)
    origins = places.groupBy(*PAIR).agg(F.collect_set("shift").alias("shifts"), F.collect_set("item_at").alias("asked"))
    origins = origins.withColumn("item_at", F.explode("asked")).withColumn("origin", F.explode(F.concat("shifts", F.array(F.lit(start).cast("long")))))
    place = F.struct("shift", "slots")
    both = places.select(*PAIR, "item_at", F.col("shift").alias("pos"), place.alias("place"), F.lit(None).cast("long").alias("origin"))
    both = both.unionByName(origins.select(*PAIR, "item_at", F.col("origin").alias("pos"), "origin"), allowMissingColumns=True)
    one = Window.partitionBy(*PAIR, "item_at").rowsBetween(Window.unboundedPreceding, 0)
    is_origin = F.col("origin").isNotNull()
    both = both.withColumn("before", F.last("place", ignorenulls=True).over(one.orderBy("pos", is_origin)))
    both = both.withColumn("after", F.last("place", ignorenulls=True).over(one.orderBy(F.col("pos").desc(), is_origin))).where(is_origin)
    earlier = F.col("after").isNull() | (F.col("origin") - F.col("before.shift") <= F.col("after.shift") - F.col("origin"))
    nearest = both.withColumn("best", F.when(F.col("before").isNotNull() & earlier, F.col("before")).otherwise(F.col("after")))
    away = F.abs(F.col("best.shift") - F.col("origin"))
    return nearest.groupBy(*PAIR, "origin").agg(F.collect_list(F.struct(away.alias("away"), F.col("best.slots").alias("slots"))).alias("picked"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, containment: float, broadcast_rows: int) -> DataFrame:
    """One row per document text and item that is in it, with the best alignment."""
    item_text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    asked = benchmark.select("item_id", item_text.alias("text"), F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), item_text).alias("item")).dropDuplicates(["item"])
    items = _canonised(asked, "item_id", "item").where("size(canon) > 0")
    parts = _windows(asked, window, "item").select("item", "h", F.col("at").alias("item_at")).distinct()
    sizes = items.select("item", F.expr(f"greatest(size(canon) - {window}, 0) + 1").alias("n_windows"))
    small = parts.limit(broadcast_rows + 1).count() <= broadcast_rows
    facts = items.select("item_id", "item", F.col("plain").alias("item_words"), F.col("canon").alias("item_canon"))
    documents = _keyed(docs, F.col("doc_id"), F.col("text"))
    hits = _windows(documents, window, "doc", "ver").join(F.broadcast(parts) if small else parts, "h").select(*PAIR, "item_at").distinct()
    hits = hits.groupBy(*PAIR).agg(F.count("*").alias("n_found"))
    pairs = hits.join(F.broadcast(sizes) if small else sizes, "item").where(F.col("n_found") >= containment * F.col("n_windows")).drop("n_found")
    work = Workspace(docs.sparkSession, "decontamination")
    pairs = work.table(pairs, "pairs")
    wanted = pairs.select("doc", "ver").distinct()
    texts = work.table(_canonised(documents.join(wanted, ["doc", "ver"], "left_semi").dropDuplicates(["doc", "ver"]), "doc_id", "text", "doc", "ver"), "texts")
    places = _places(texts, pairs, parts, facts, small, window)
    both = _alignments(places).join(pairs, list(PAIR))
    near = "filter(picked, p -> p.away <= radius)"
    reached = F.expr(f"filter(array_distinct(transform(picked, p -> p.away)), r -> size(filter(picked, p -> p.away <= r)) >= {containment} * n_windows)")
    both = both.withColumn("radius", F.explode(reached)).withColumn("n_found", F.expr(f"size({near})")).withColumn("slots", F.expr(f"array_distinct(flatten(transform({near}, p -> p.slots)))"))
    consistent = F.expr("size(filter(slots, x -> size(filter(slots, y -> y.a = x.a and y.b <> x.b)) = 0))")
    same = F.expr("size(filter(slots, x -> x.a <> x.b)) = 0")
    both = both.withColumn("n_slots", F.size("slots")).withColumn("n_consistent", consistent).where(F.col("n_consistent") >= containment * F.col("n_slots"))
    share = F.round(F.col("n_found") / F.col("n_windows"), 6).alias("containment")
    best = both.select(*PAIR, "n_windows", "n_found", share, "n_slots", "n_consistent", same.alias("same"))
    best = best.groupBy(*PAIR).agg(F.max(F.struct("containment", "n_found", "n_consistent", "n_slots", "same", "n_windows")).alias("x"))
    named = best.join(texts.select("doc", "ver", "doc_id"), ["doc", "ver"]).join(F.broadcast(facts.select("item", "item_id")) if small else facts.select("item", "item_id"), "item")
    return work.table(named, "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_found, containment, n_slots, n_consistent, kind)``; kind: exact or template."""
    found = _found(docs, benchmark, window, containment, broadcast_rows)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("x", "doc_id", "item_id")).alias("y")).select("y.x.*", "y.doc_id", "y.item_id")
    kind = F.when(F.col("same"), F.lit("exact")).otherwise(F.lit("template")).alias("kind")
    return best.select("doc_id", "item_id", "n_windows", "n_found", "containment", "n_slots", "n_consistent", kind)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with their own columns."""
    bad = _found(docs, benchmark, window, containment, broadcast_rows).select("doc", "ver").distinct()
    rows = _keyed(docs, F.struct(*columns(docs.columns)).alias("row"))
    return rows.join(bad, ["doc", "ver"], "left_anti").select("row.*")


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op9_template_decontamination": op9_templates}
