"""Batches of provider records against a catalogue: identifiers, matching, merging, versions, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import scalars as S

#: The scheme under which a source's own ids are identifiers.
OWN_SCHEME = {"openalex": "openalex", "semantic_scholar": "s2", "crossref": "doi", "arxiv": "arxiv"}


def identifiers(records: DataFrame) -> DataFrame:
    """``(doc_id, scheme, value)`` of ``records(doc_id, source, external_id, identifiers)``, normalised; the source's own id counts
    as one unless the record names another of that scheme; blank ones are dropped."""
    own = F.create_map(*[F.lit(x) for pair in OWN_SCHEME.items() for x in pair])[F.col("source")]
    listed = F.map_entries("identifiers")
    given = F.exists(listed, lambda e: (F.lower(e["key"]) == own) & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    both = F.when(own.isNotNull() & ~given, F.concat(listed, F.array(F.struct(own.alias("key"), F.col("external_id").alias("value"))))).otherwise(listed)
    flat = records.select("doc_id", F.explode(both).alias("e")).select("doc_id", F.lower("e.key").alias("scheme"), S.normalize_identifier(F.col("e.key"), F.col("e.value")).alias("value"))
    return flat.where("trim(coalesce(value, '')) <> ''").distinct()


def matched(records: DataFrame, source_records: DataFrame, works: DataFrame, schemes: tuple[str, ...] = ("doi", "arxiv")) -> DataFrame:
    """``(doc_id, how, work)``: the work of each record by the first way that finds one.

    By the source's own record; by each of ``schemes`` in order, where two works are a conflict; by title and year if only one work
    has them; else the record is new.  ``works(work, title, year, *schemes)``, ``source_records(source, external_id, work)``.
    """
    out = records.join(source_records.groupBy("source", "external_id").agg(F.min("work").alias("_source")), ["source", "external_id"], "left")
    for scheme in schemes:
        known = works.where(F.col(scheme).isNotNull()).groupBy(scheme).agg(F.min("work").alias(f"_{scheme}"), F.count_distinct("work").alias(f"_n_{scheme}"))
        out = out.join(known, scheme, "left")
    titles = works.where("title <> ''").groupBy("title", "year").agg(F.count_distinct("work").alias("_n"), F.min("work").alias("_title")).where("_n = 1").drop("_n")
    out = out.join(titles, ["title", "year"], "left")
    how, work = F.when(F.col("_source").isNotNull(), "source record"), F.when(F.col("_source").isNotNull(), F.col("_source"))
    for scheme in schemes:
        several = F.col(f"_n_{scheme}") > 1
        how = how.when(several, "conflict").when(F.col(f"_{scheme}").isNotNull(), scheme)
        work = work.when(several, None).when(F.col(f"_{scheme}").isNotNull(), F.col(f"_{scheme}"))
    return out.select("doc_id", how.when(F.col("_title").isNotNull(), "title").otherwise("new").alias("how"), work.otherwise(F.col("_title")).alias("work"))


def merged_identifiers(found: DataFrame, by: str, order: Column, drop: tuple[str, ...] = ("crossref",)) -> DataFrame:
    """``(by, identifiers)``: of each scheme the value of the last record in ``order``."""
    last = found.where(~F.col("scheme").isin(*drop)).groupBy(by, "scheme").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scheme", "value")))).alias("identifiers"))


def latest(rows: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """The values of the last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_x")).select(*keys, "_x.*")


def location_versions(locations: DataFrame) -> DataFrame:
    """One row per (work, url) of ``locations(work, place, url, version, is_best)``: the best one, of several the later; else the first."""
    order = Window.partitionBy("work", "url").orderBy(F.col("is_best").desc(), F.when(F.col("is_best"), -F.col("place")).otherwise(F.col("place")))
    return locations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def open_access(works: DataFrame, versions: DataFrame) -> DataFrame:
    """``works(work, doi, pdf)`` with what the lookup of their DOI changed, and a status."""
    best = versions.groupBy("work").agg(F.max_by("url", F.struct("is_best", -F.col("place"))).alias("url"), F.max(F.col("is_best")).alias("has_best"))
    status = F.when(F.coalesce("doi", F.lit("")) == "", "no_doi").when(F.col("url").isNull(), "not_found").when(F.col("pdf").isNotNull(), "kept_pdf").when(F.col("has_best"), "filled").otherwise("filled_other")
    joined = works.join(best, "work", "left").withColumn("status", status)
    found = F.col("status").isin("kept_pdf", "filled", "filled_other")
    return joined.select("work", "status", found.alias("is_open_access"), F.when(found, F.coalesce("pdf", "url")).otherwise(F.col("pdf")).alias("pdf"))


def pending(works: DataFrame, attempts: DataFrame, terminal: list[str], k: int) -> DataFrame:
    """The first ``k`` works that have no terminal attempt; ``attempts(work, status)``."""
    done = attempts.where(F.col("status").isin(terminal)).select("work").distinct()
    return works.join(done, "work", "left_anti").orderBy("work").limit(k)


def gate(counts: DataFrame, target: int, name: str = "name", found: str = "n") -> DataFrame:
    """Counts that must equal a target: what is short or too much, and whether it passes."""
    return counts.select(name, F.col(found).alias("found"), F.lit(target).alias("expected"), (F.col(found) - target).alias("off"), (F.col(found) == target).alias("passed"))


def inherited_units(planned: DataFrame, before: DataFrame, invariant: list[str]) -> DataFrame:
    """``(provider, query, status)`` of planned units: inherited from an earlier run if that is done and no invariant field changed."""
    was = before.select("provider", "query", *[F.col(c).alias(f"_{c}") for c in invariant], F.col("done").alias("_done"))
    both = planned.join(was, ["provider", "query"], "left")
    same = F.lit(True)
    for c in invariant:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_done").isNull(), "new").when(~same, "changed").when(F.col("_done"), "inherited").otherwise("unfinished")
    return both.select("provider", "query", status.alias("status"))
