"""Citation graphs: ``edges(citing, ref, cited)``, cited null where the reference is outside the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.components import connected_components
from papyra.operators.ranking import top_k
from papyra.workspace import Workspace


def component_sizes(edges: DataFrame, work: Workspace) -> DataFrame:
    """Weak components over the resolved edges between different documents."""
    pairs = edges.where("cited is not null and cited <> citing").select(F.col("citing").alias("u"), F.col("cited").alias("v"))
    return connected_components(pairs, work).groupBy("component").agg(F.count("*").alias("size"))


def structure(edges: DataFrame, n_documents: DataFrame) -> DataFrame:
    """Coverage and degrees of the graph; ``n_documents`` is one row."""
    inside = F.col("cited").isNotNull() & (F.col("cited") != F.col("citing"))
    incident = edges.where(inside).select(F.explode(F.array("citing", "cited")).alias("d")).agg(F.count_distinct("d").alias("incident_documents"))
    refs = edges.groupBy("ref").agg(F.count_distinct("citing").alias("citers")).agg(F.count(F.when(F.col("citers") >= 2, 1)).alias("shared_references"))
    total = edges.agg(F.count("*").alias("edges"), F.count_distinct("citing").alias("citing_documents"), F.count(F.when(inside, 1)).alias("internal_edges"), F.count_distinct("ref").alias("references"))
    one = total.crossJoin(incident).crossJoin(refs).crossJoin(n_documents)  # one row each
    return one.select("*", F.round(F.col("internal_edges") / F.col("edges"), 6).alias("internal_rate"), F.round(F.col("citing_documents") / F.col("n_documents"), 6).alias("outgoing_coverage"), F.round(F.col("edges") / F.col("citing_documents"), 6).alias("mean_references"))


def closure_candidates(edges: DataFrame, least: int, cap: int) -> DataFrame:
    """Unresolved references with at least ``least`` citers: the ``cap`` most cited, ranked."""
    counted = edges.where("cited is null").groupBy("ref").agg(F.count_distinct("citing").alias("citers")).where(F.col("citers") >= least)
    cut = counted.orderBy(F.col("citers").desc(), "ref").limit(cap).withColumn("all", F.lit(1))
    return top_k(cut, cap, by="all", score="citers", tie="ref").select("ref", "citers", "rank")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Documents that a seed cites or that cite it, once each.  ``seeds(query_id, seed, weight)``."""
    inside = edges.where("cited is not null and cited <> citing").select("citing", "cited")
    links = inside.select(F.col("citing").alias("seed"), F.col("cited").alias("doc_id")).union(inside.select(F.col("cited"), F.col("citing"))).distinct()
    return seeds.join(links, "seed").select("query_id", "seed", "weight", "doc_id", F.lit(1.0).alias("signal"))


def coupling(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Shared references over the root of the product of both numbers of references; only pairs that start at a seed."""
    refs = edges.select("citing", "ref").distinct()
    n = refs.groupBy("citing").agg(F.count("*").alias("n"))
    own = seeds.join(refs, seeds["seed"] == refs["citing"]).select("query_id", "seed", "weight", "ref")
    shared = own.join(refs, "ref").where("citing <> seed").groupBy("query_id", "seed", "weight", F.col("citing").alias("doc_id")).agg(F.count("*").alias("shared"))
    return _scaled(shared, n.withColumnRenamed("citing", "key"))


def cocitation(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Shared citers over the root of the product of both numbers of citers."""
    inside = edges.where("cited is not null and cited <> citing").select("citing", "cited").distinct()
    n = inside.groupBy(F.col("cited").alias("key")).agg(F.count("*").alias("n"))
    own = seeds.join(inside, seeds["seed"] == inside["cited"]).select("query_id", "seed", "weight", "citing")
    shared = own.join(inside, "citing").where("cited <> seed").groupBy("query_id", "seed", "weight", F.col("cited").alias("doc_id")).agg(F.count("*").alias("shared"))
    return _scaled(shared, n)


def _scaled(shared: DataFrame, n: DataFrame) -> DataFrame:
    a, b = n.select(F.col("key").alias("seed"), F.col("n").alias("n_a")), n.select(F.col("key").alias("doc_id"), F.col("n").alias("n_b"))
    both = shared.join(a, "seed").join(b, "doc_id")
    return both.select("query_id", "seed", "weight", "doc_id", (F.col("shared") / F.sqrt(F.col("n_a") * F.col("n_b"))).alias("signal"))


def seed_search(edges: DataFrame, seeds: DataFrame, k: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Weighted sum of the three signals over weighted seeds; seeds themselves are left out, ties go to the id as a string."""
    parts = [f(edges, seeds).select("query_id", "doc_id", (F.col("weight") * F.col("signal") * w).alias("part")) for f, w in zip((neighbours, coupling, cocitation), weights, strict=True)]
    scored = parts[0].union(parts[1]).union(parts[2]).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    scored = scored.join(seeds.select("query_id", F.col("seed").alias("doc_id")), ["query_id", "doc_id"], "left_anti")
    return top_k(scored.withColumn("_tie", F.col("doc_id").cast("string")), k, tie="_tie").drop("_tie")
