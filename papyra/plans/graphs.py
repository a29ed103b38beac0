"""Citation graph queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import graph
from papyra.plans import views as V
from papyra.workspace import Workspace


def _seeds(spark, sf_dir):
    return V.table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.expr("array(named_struct('s', p_partkey, 'w', 1.0D), named_struct('s', p_partkey + 1, 'w', 0.5D))")).alias("x")).select("query_id", F.col("x.s").alias("seed"), F.col("x.w").alias("weight"))


def k1_adjacency(spark, sf_dir):
    e = V.edges(spark, sf_dir)
    inside = F.col("cited").isNotNull() & (F.col("cited") != F.col("citing"))
    return e.groupBy("citing").agg(F.count("*").alias("references"), F.count(F.when(inside, 1)).alias("internal"))


def k2_neighbours(spark, sf_dir):
    return graph.neighbours(V.edges(spark, sf_dir), _seeds(spark, sf_dir)).groupBy("query_id", "seed").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))


def k3_coupling(spark, sf_dir):
    return graph.coupling(V.edges(spark, sf_dir), _seeds(spark, sf_dir)).select("query_id", "seed", "doc_id", F.round("signal", 6).alias("signal"))


def k4_cocitation(spark, sf_dir):
    return graph.cocitation(V.edges(spark, sf_dir), _seeds(spark, sf_dir)).select("query_id", "seed", "doc_id", F.round("signal", 6).alias("signal"))


def k5_seed_search(spark, sf_dir):
    return graph.seed_search(V.edges(spark, sf_dir), _seeds(spark, sf_dir), 20, (1.0, 0.8, 0.6))


def g9_components(spark, sf_dir):
    """Over all edges; recursive SQL is too slow for that, so the operator is tested on small graphs instead."""
    return graph.component_sizes(V.edges(spark, sf_dir), Workspace(spark, "components"))


def g10_structure(spark, sf_dir):
    return graph.structure(V.edges(spark, sf_dir), V.table(spark, sf_dir, "part").agg(F.count("*").alias("n_documents")))


def g13_metadata_edges(spark, sf_dir):
    """References listed with the citer, exploded, marked internal."""
    listed = V.edges(spark, sf_dir).groupBy("citing").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    flat = listed.select("citing", F.explode("refs").alias("ref"))
    known = V.table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("ref"), F.lit(1).alias("known"))
    return flat.join(known, "ref", "left").groupBy("citing").agg(F.count("*").alias("n"), F.count("known").alias("internal"))


def g14_closure(spark, sf_dir):
    return graph.closure_candidates(V.edges(spark, sf_dir), 2, 100)


def g15_thresholds(spark, sf_dir):
    n = V.edges(spark, sf_dir).where("cited is null").groupBy("ref").agg(F.count_distinct("citing").alias("c"))
    return n.agg(*[F.count(F.when(F.col("c") >= k, 1)).alias(f"at_least_{k}") for k in (2, 3, 5, 10, 20)])


QUERIES = {f.__name__: f for f in (k1_adjacency, k2_neighbours, k3_coupling, k4_cocitation, k5_seed_search, g9_components, g10_structure, g13_metadata_edges, g14_closure, g15_thresholds)}

_S = "seeds AS (SELECT p_partkey AS query_id, p_partkey + s AS seed, CASE WHEN s = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM part, (VALUES (0), (1)) v(s) WHERE p_partkey % 100 = 0)"
_I = f"{V.EDGES}, {_S}, inside AS (SELECT DISTINCT citing, cited FROM edges WHERE cited IS NOT NULL AND cited <> citing)"
_N = "nb AS (SELECT query_id, seed, weight, doc_id, 1.0::DOUBLE AS signal FROM seeds JOIN (SELECT citing AS seed, cited AS doc_id FROM inside UNION SELECT cited, citing FROM inside) USING (seed))"
_C = """refs AS (SELECT DISTINCT citing, ref FROM edges), nr AS (SELECT citing, count(*) AS n FROM refs GROUP BY 1),
    sc AS (SELECT query_id, seed, weight, b.citing AS doc_id, count(*) AS shared FROM seeds JOIN refs a ON a.citing = seed JOIN refs b ON b.ref = a.ref AND b.citing <> seed GROUP BY ALL),
    cp AS (SELECT query_id, seed, weight, doc_id, shared / sqrt(a.n * b.n) AS signal FROM sc JOIN nr a ON a.citing = seed JOIN nr b ON b.citing = doc_id)"""
_O = """nc AS (SELECT cited, count(*) AS n FROM inside GROUP BY 1), so AS (SELECT query_id, seed, weight, b.cited AS doc_id, count(*) AS shared FROM seeds JOIN inside a ON a.cited = seed JOIN inside b ON b.citing = a.citing AND b.cited <> seed GROUP BY ALL),
    co AS (SELECT query_id, seed, weight, doc_id, shared / sqrt(a.n * b.n) AS signal FROM so JOIN nc a ON a.cited = seed JOIN nc b ON b.cited = doc_id)"""

ORACLES = {
    "k1_adjacency": f'WITH {V.EDGES} SELECT citing, count(*) AS "references", count(*) FILTER (cited <> citing) AS internal FROM edges GROUP BY citing',
    "k2_neighbours": f"WITH {_I}, {_N} SELECT query_id, seed, count(*) AS n, min(doc_id) AS least, max(doc_id) AS greatest FROM nb GROUP BY ALL",
    "k3_coupling": f"WITH {_I}, {_C} SELECT query_id, seed, doc_id, round(signal, 6) AS signal FROM cp",
    "k4_cocitation": f"WITH {_I}, {_O} SELECT query_id, seed, doc_id, round(signal, 6) AS signal FROM co",
    "k5_seed_search": f"""WITH {_I}, {_N}, {_C}, {_O}, parts AS (SELECT query_id, doc_id, weight * signal AS part FROM nb UNION ALL SELECT query_id, doc_id, weight * signal * 0.8 FROM cp UNION ALL SELECT query_id, doc_id, weight * signal * 0.6 FROM co),
        s AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM parts p WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = p.query_id AND x.seed = p.doc_id) GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "g10_structure": f"""WITH {V.EDGES}, t AS (SELECT count(*) AS edges, count(DISTINCT citing) AS citing_documents, count(*) FILTER (cited <> citing) AS internal_edges, count(DISTINCT ref) AS "references" FROM edges),
        i AS (SELECT count(DISTINCT d) AS incident_documents FROM (SELECT unnest([citing, cited]) AS d FROM edges WHERE cited <> citing)), r AS (SELECT count(*) FILTER (c >= 2) AS shared_references FROM (SELECT count(DISTINCT citing) AS c FROM edges GROUP BY ref)),
        p AS (SELECT count(*) AS n_documents FROM part)
        SELECT *, round(internal_edges * 1.0 / edges, 6) AS internal_rate, round(citing_documents * 1.0 / n_documents, 6) AS outgoing_coverage, round(edges * 1.0 / citing_documents, 6) AS mean_references FROM t, i, r, p""",
    "g13_metadata_edges": f"WITH {V.EDGES} SELECT citing, count(*) AS n, count(p_partkey) AS internal FROM edges LEFT JOIN part ON ref = 'part:' || p_partkey GROUP BY citing",
    "g14_closure": f"WITH {V.EDGES}, c AS (SELECT ref, count(DISTINCT citing) AS citers FROM edges WHERE cited IS NULL GROUP BY ref HAVING count(DISTINCT citing) >= 2) SELECT * FROM (SELECT *, row_number() OVER (ORDER BY citers DESC, ref) AS rank FROM c) WHERE rank <= 100",
    "g15_thresholds": f"WITH {V.EDGES}, c AS (SELECT count(DISTINCT citing) AS c FROM edges WHERE cited IS NULL GROUP BY ref) SELECT {', '.join(f'count(*) FILTER (c >= {k}) AS at_least_{k}' for k in (2, 3, 5, 10, 20))} FROM c",
}
