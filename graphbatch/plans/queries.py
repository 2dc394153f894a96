"""The registered graph queries and their DuckDB statements, one pair an operator; doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbatch.functions.hashing import hash_uniform, sql_uniform
from graphbatch.functions.lineage import cut, scratch_path
from graphbatch.operators import batches as B
from graphbatch.operators import evaluation as E
from graphbatch.operators import influence as P
from graphbatch.operators import merge as M
from graphbatch.operators import ordering as O
from graphbatch.operators import partition as D
from graphbatch.operators import prep as G
from graphbatch.operators import sampling as R
from graphbatch.operators import scoring as N
from graphbatch.plans import fixtures as X
from graphbatch.plans.fixtures import with_ctes
from graphbatch.sources import io as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_ctes(sql, **ctes)
        return f

    return add


def six(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long_form(x: DataFrame, *keys: str) -> DataFrame:
    """Vectors as one row a place."""
    return x.select(*keys, F.posexplode("x").alias("k", "v")).select(*keys, F.col("k").cast("long").alias("k"), six("v").alias("v"))


# ---- sources and sinks


@query("SELECT e.src, e.dst, split FROM edges e JOIN splits ON node_id = src")
def s1_read_graph(spark, d):
    at = scratch_path(spark, "graph")
    X.nodes(spark, d).write.parquet(f"{at}/nodes")
    X.edges(spark, d).write.parquet(f"{at}/edges")
    X.splits(spark, d).write.parquet(f"{at}/splits")
    _, edges, splits = S.read_graph(spark, f"{at}/nodes", f"{at}/edges", f"{at}/splits")
    return edges.join(splits.withColumnRenamed("node_id", "src"), "src").select("src", "dst", "split")


@query("SELECT node_id, split FROM splits")
def s2_splits_from_masks(spark, d):
    masks = X.splits(spark, d).select("node_id", *((F.col("split") == s).alias(f"{s}_mask") for s in ("train", "val", "test")))
    return S.splits_from_masks(masks)


@query("SELECT src, dst, round(weight, 6) AS weight FROM sym")
def s3_adjacency_files(spark, d):
    at = scratch_path(spark, "adj")
    S.write_adjacency(G.normalize_adj(X.edges(spark, d), "sym"), at)
    return S.read_adjacency(spark, at).select("src", "dst", six("weight").alias("weight"))


@query("SELECT source, node, round(score, 6) AS score, 'val' AS split FROM ppr")
def s4_ppr_files(spark, d):
    at = scratch_path(spark, "ppr")
    S.write_ppr(X.two_step(spark, d).withColumn("split", F.lit("val")), at)
    return S.read_ppr(spark, at, "val").select("source", "node", six("score").alias("score"), "split")


@query("SELECT batch_id, node_id, is_output, 'fixed' AS method, 'val' AS split FROM batch_nodes")
def s5_batch_files(spark, d):
    at = scratch_path(spark, "batches")
    S.write_batches(X.batch_nodes(spark, d).withColumns({"method": F.lit("fixed"), "split": F.lit("val")}), at)
    return S.read_batches(spark, at, "fixed", "val")


@query("""SELECT node_id AS src, node_id AS dst, round((SELECT count(DISTINCT batch_id) FROM batch_nodes) / coalesce(c, 0.1)::DOUBLE / (SELECT count(*) FROM nodes), 6) AS norm FROM nodes LEFT JOIN (SELECT node_id, count(*) AS c FROM batch_nodes GROUP BY 1) USING (node_id)
    UNION ALL SELECT e.src, e.dst, round(CASE WHEN m.e IS NULL THEN 0.1 ELSE coalesce(c, 0) / m.e END::DOUBLE, 6) FROM edges e LEFT JOIN (SELECT src, dst, count(*) AS e FROM batch_edges GROUP BY 1, 2) m ON m.src = e.src AND m.dst = e.dst
    LEFT JOIN (SELECT node_id, count(*) AS c FROM batch_nodes GROUP BY 1) k ON k.node_id = e.src""")
def s6_cached_norms(spark, d):
    at, key = scratch_path(spark, "norms"), {"graph": d, "roots": 100, "walk_length": 2, "coverage": 1}

    def make():
        n, rows = X.nodes(spark, d), X.batch_nodes(spark, d)
        of_node, of_edge = R.walk_norms(rows, B.induced_subgraphs(rows, G.normalize_adj(X.edges(spark, d))), n, X.edges(spark, d), n.count())
        return of_node.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), "norm").union(of_edge.select("src", "dst", "norm"))

    S.cached_norms(spark, at, key, make)
    return S.cached_norms(spark, at, key, make).select("src", "dst", six("norm").alias("norm"))


METRIC_ROWS = "SELECT (node_id % 3)::VARCHAR AS run_id, split, 'full' AS loader, 'share' AS metric, avg(label)::DOUBLE AS value FROM labels JOIN splits USING (node_id) GROUP BY 1, 2"


def _metrics(spark, d):
    rows = X.labels(spark, d).join(X.splits(spark, d), "node_id")
    return rows.groupBy((F.col("node_id") % 3).cast("string").alias("run_id"), "split").agg(F.avg("label").alias("value")).select("run_id", "split", F.lit("full").alias("loader"), F.lit("share").alias("metric"), "value")


@query("SELECT run_id, split, loader, metric, round(value, 6) AS value FROM m UNION ALL SELECT run_id, split, loader, metric, round(value, 6) FROM m", m=METRIC_ROWS)
def s7_append_metrics(spark, d):
    at = scratch_path(spark, "metrics")
    for _ in range(2):
        S.append_metrics(_metrics(spark, d), at)
    return S.read_metrics(spark, at).withColumn("value", six("value"))


@query("SELECT run_id, split, loader, metric, round(value, 6) AS value FROM m", m=METRIC_ROWS)
def s7_append_metrics_keyed(spark, d):
    """A job that is run again under its key counts once."""
    at = scratch_path(spark, "metrics")
    for _ in range(2):
        S.append_metrics(_metrics(spark, d), at, "job 7")
    return S.read_metrics(spark, at).withColumn("value", six("value"))


# ---- preparation


@query("SELECT src, dst FROM raw UNION SELECT node_id, node_id FROM nodes")
def g1_add_self_loops(spark, d):
    return G.add_self_loops(X.raw_edges(spark, d), X.nodes(spark, d))


@query("SELECT src, dst FROM raw UNION SELECT dst, src FROM raw")
def g2_to_undirected(spark, d):
    return G.to_undirected(X.raw_edges(spark, d))


@query("SELECT src, dst, count(*)::DOUBLE AS weight FROM raw GROUP BY 1, 2")
def g3_coalesce_edges(spark, d):
    return G.coalesce_edges(X.raw_edges(spark, d).withColumn("weight", F.lit(1.0)), "sum")


@query("SELECT node_id, label FROM labels")
def g4_clean_labels(spark, d):
    return G.clean_labels(X.nodes(spark, d)).select("node_id", "label")


@query(f"""SELECT node_id, split FROM splits WHERE split <> 'train' UNION ALL
    SELECT node_id, split FROM (SELECT *, row_number() OVER (ORDER BY {sql_uniform(2021, 'node_id')}, node_id) AS rn, count(*) OVER () AS n FROM splits WHERE split = 'train') WHERE rn <= floor(n * 0.3)""")
def g5_subsample_train(spark, d):
    return G.subsample_train(X.splits(spark, d), 0.3)


@query("SELECT DISTINCT src, dst FROM raw r WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE b.src = r.dst AND b.dst = r.src)")
def g6_directed_violations(spark, d):
    return G.directed_violations(X.raw_edges(spark, d))


@query("SELECT node_id, deg FROM deg")
def g7_degrees(spark, d):
    return G.degrees(X.edges(spark, d))


@query("SELECT src, dst, round(weight, 6) AS weight FROM rw")
def g8_normalize_rw(spark, d):
    return G.normalize_adj(X.edges(spark, d), "rw").withColumn("weight", six("weight"))


@query("SELECT src, dst, round(weight, 6) AS weight FROM sym")
def g9_normalize_sym(spark, d):
    return G.normalize_adj(X.edges(spark, d), "sym").withColumn("weight", six("weight"))


@query("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM raw) AND node_id NOT IN (SELECT dst FROM raw)")
def g10_isolated_nodes(spark, d):
    return G.isolated_nodes(X.nodes(spark, d), G.to_undirected(X.raw_edges(spark, d)))


@query("SELECT node_id, split = 'val' AS in_val, split = 'test' AS in_test, false AS overlap FROM splits WHERE split <> 'train'")
def g11_val_test_partition(spark, d):
    return G.val_test_partition(X.splits(spark, d))


# ---- influence

ALPHA, EPS, PUSH_ROUNDS = 0.25, 5.0013e-4, 30


def _push_ctes() -> dict[str, str]:
    out = {"p0": f"SELECT node_id AS source, node_id AS node, 0.0::DOUBLE AS p, {ALPHA}::DOUBLE AS r, true AS act FROM outputs"}
    for k in range(1, PUSH_ROUNDS + 1):
        prev = f"p{k - 1}"
        out[f"p{k}"] = f"""SELECT source, node, p, r, r >= {ALPHA * EPS}::DOUBLE * deg AS act FROM (SELECT source, node, sum(p) AS p, sum(r) AS r FROM (
            SELECT source, node, CASE WHEN act THEN p + r ELSE p END AS p, CASE WHEN act THEN 0 ELSE r END AS r FROM {prev}
            UNION ALL SELECT source, dst, 0, {1 - ALPHA}::DOUBLE * r / deg FROM {prev} JOIN edges ON src = node JOIN deg ON deg.node_id = node WHERE act) GROUP BY 1, 2) JOIN deg ON deg.node_id = node"""
    return out


@query(f"SELECT source, node, round(p, 6) AS score FROM p{PUSH_ROUNDS} WHERE p > 0", **_push_ctes())
def p1_ppr_push(spark, d):
    return P.ppr_push(X.edges(spark, d), X.outputs(spark, d), ALPHA, EPS).withColumn("score", six("score"))


@query(f"SELECT source, node, round(p, 6) AS score FROM p{PUSH_ROUNDS} WHERE p > 0", **X.WHOLE, **_push_ctes())
def p1_ppr_push_all(spark, d):
    """Over the graph of all line items."""
    return P.ppr_push(X.edges(spark, d, 0), X.outputs(spark, d), ALPHA, EPS).withColumn("score", six("score"))


@query(f"SELECT source, node, round(p, 6) AS score FROM p{PUSH_ROUNDS} WHERE p > 0", **X.HUBS, **_push_ctes())
def p1_ppr_push_hubs(spark, d):
    """Every user joins every hub: hubs in blocks of 16 users, sources in slices of 100."""
    edges, outputs = X.hub_graph(spark, d)
    return P.ppr_push(edges, outputs, ALPHA, EPS, per_block=16, per_slice=100).withColumn("score", six("score"))


@query("SELECT source, node FROM (SELECT source, node, row_number() OVER (PARTITION BY source ORDER BY round(score, 12) DESC, node) AS rn FROM ppr) WHERE rn <= 8 UNION SELECT source, source FROM ppr")
def p2_topk_neighbors(spark, d):
    return P.topk_neighbors(X.two_step(spark, d), 8)


@query("SELECT source, node, round(sqrt(a.deg) * score / sqrt(b.deg), 6) AS score FROM ppr JOIN deg a ON a.node_id = source JOIN deg b ON b.node_id = node")
def p3_normalize_ppr_sym(spark, d):
    return P.normalize_ppr(X.two_step(spark, d), G.degrees(X.edges(spark, d)), "sym").withColumn("score", six("score"))


@query("SELECT source, node, round(a.deg * score / b.deg, 6) AS score FROM ppr JOIN deg a ON a.node_id = source JOIN deg b ON b.node_id = node")
def p3_normalize_ppr_col(spark, d):
    return P.normalize_ppr(X.two_step(spark, d), G.degrees(X.edges(spark, d)), "col").withColumn("score", six("score"))


@query("SELECT source, node, round(score, 6) AS score FROM ppr WHERE node IN (SELECT node_id FROM outputs)")
def p4_restrict_to_outputs(spark, d):
    return P.restrict_to_outputs(X.two_step(spark, d), X.outputs(spark, d)).withColumn("score", six("score"))


@query("SELECT greatest(source, node) AS i, least(source, node) AS j, round(sum(score), 6) AS weight FROM ppr WHERE source <> node GROUP BY 1, 2")
def p5_influence_pairs(spark, d):
    return P.influence_pairs(X.two_step(spark, d)).withColumn("weight", six("weight"))


def _power_ctes(rounds: int) -> dict[str, str]:
    out = {"t": "SELECT part_id AS batch_id, node_id AS node, 1.0::DOUBLE / count(*) OVER (PARTITION BY part_id) AS t FROM parts JOIN outputs USING (node_id)", "x0": "SELECT batch_id, node, t AS score FROM t"}
    for k in range(1, rounds + 1):
        out[f"x{k}"] = f"SELECT batch_id, node, sum(score) AS score FROM (SELECT batch_id, src AS node, {1 - ALPHA} * score * weight AS score FROM x{k - 1} JOIN rw ON dst = node UNION ALL SELECT batch_id, node, {ALPHA} * t FROM t) GROUP BY 1, 2"
    return out


@query("SELECT batch_id, node, round(score, 6) AS score FROM x4", **_power_ctes(4))
def p6_batch_ppr(spark, d):
    return P.batch_ppr(G.normalize_adj(X.edges(spark, d)), B.outputs_of_parts(X.hash_parts(spark, d), X.outputs(spark, d)), ALPHA, 4).withColumn("score", six("score"))


@query("SELECT batch_id, node, round(score, 6) AS score FROM x50", **X.WHOLE, **_power_ctes(50))
def p6_batch_ppr_all(spark, d):
    """Fifty iterations over the graph of all line items, hubs in blocks of 32."""
    return P.batch_ppr(G.normalize_adj(X.edges(spark, d, 0)), B.outputs_of_parts(X.hash_parts(spark, d), X.outputs(spark, d)), ALPHA, 50, per_block=32).withColumn("score", six("score"))


POWER_TOLERANCE = 1e-5


@query(f"SELECT batch_id, count(*) AS n_far, 0::BIGINT AS n_beyond FROM x50 WHERE score > {2 * POWER_TOLERANCE / ALPHA} GROUP BY 1", **_power_ctes(50))
def p6_batch_ppr_push(spark, d):
    """Per set, the nodes of fifty full iterations with a score of twice the bound or more, and how many nodes the pushed scores miss by more than the bound."""
    adj, sets = cut(G.normalize_adj(X.edges(spark, d))), B.outputs_of_parts(X.hash_parts(spark, d), X.outputs(spark, d))
    bound = POWER_TOLERANCE / ALPHA
    full, fast = P.batch_ppr(adj, sets, ALPHA, 50), P.batch_ppr_push(adj, sets, ALPHA, POWER_TOLERANCE, sets_a_slice=2)
    both = full.withColumnRenamed("score", "a").join(fast.withColumnRenamed("score", "b"), ["batch_id", "node"], "full_outer")
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.groupBy("batch_id").agg(F.count(F.when(F.col("a") > 2 * bound, 1)).alias("n_far"), F.count(F.when(gap > bound + 1e-6, 1)).alias("n_beyond"))


@query("SELECT source AS batch_id, node AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 12) DESC, node) AS rn FROM ppr WHERE score > 0) WHERE rn <= 5 UNION SELECT node_id, node_id FROM outputs")
def p7_topk_per_batch(spark, d):
    own = X.outputs(spark, d).select(F.col("node_id").alias("batch_id"), "node_id")
    return P.topk_per_batch(X.two_step(spark, d).withColumnRenamed("source", "batch_id"), 5, own)


@query(f"SELECT ceil(0.1::DOUBLE * count(*) / {X.PARTS})::BIGINT AS k FROM nodes")
def p8_batch_topk(spark, d):
    return X.nodes(spark, d).agg(P.batch_topk(F.count("*"), X.PARTS, 0.1).alias("k"))


@query("SELECT DISTINCT node AS node_id FROM ppr WHERE score > 0.05")
def p9_influential_nodes(spark, d):
    return P.influential_nodes(X.two_step(spark, d), 0.05)


@query("""SELECT bin, count(*) AS n, round(lo + bin * (hi - lo) / 50, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 50, 6) AS high FROM (
    SELECT lo, hi, least(floor((x - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin FROM l, (SELECT min(x) AS lo, max(x) AS hi FROM l)) GROUP BY bin, lo, hi""", l="SELECT round(log10(score), 9) AS x FROM ppr WHERE score > 0")
def p10_ppr_log_histogram(spark, d):
    return P.ppr_log_histogram(X.two_step(spark, d)).withColumns({"low": six("low"), "high": six("high")})


# ---- batches


@query("SELECT ceil(count(*) / ceil(count(*) / 100.0))::BIGINT AS size FROM outputs")
def m1_even_batch_size(spark, d):
    return X.outputs(spark, d).agg(M.even_batch_size(F.count("*"), 100).alias("size"))


def _output_pairs(spark, d):
    return P.influence_pairs(P.restrict_to_outputs(X.two_step(spark, d), X.outputs(spark, d)))


@query()
def m2_merge_by_outputs(spark, d):
    return M.merge_by_outputs(_output_pairs(spark, d), X.outputs(spark, d), 20, finish_rows=1000)


@query()
def m3_pack_small_groups(spark, d):
    return M.pack_small_groups(M.merge_by_outputs(_output_pairs(spark, d), X.outputs(spark, d), 20), 50)


@query()
def m4_merge_by_aux(spark, d):
    return M.merge_by_aux(_output_pairs(spark, d), X.neighbors(spark, d), X.outputs(spark, d), 60)


@query()
def m5_pack_small_aux(spark, d):
    groups = X.outputs(spark, d).select("node_id", F.col("node_id").alias("group_id"))
    return M.pack_small_aux(groups, X.neighbors(spark, d), 60, finish_rows=1000)


@query("SELECT batch_id, node_id, is_output FROM batch_nodes")
def m6_node_wise_batches(spark, d):
    return B.node_wise_batches(B.cut_outputs(X.outputs(spark, d), X.PER_BATCH, 2021), X.neighbors(spark, d))


@query()
def m7_partition_graph(spark, d):
    return D.partition_graph(X.edges(spark, d), X.nodes(spark, d), X.PARTS, coarse_nodes=1000)


@query("""SELECT part_id, size, coalesce(inn, 0)::BIGINT AS "inner", coalesce(c, 0)::BIGINT AS cut FROM (SELECT part_id, count(*) AS size FROM parts GROUP BY 1) LEFT JOIN (
    SELECT a.part_id, sum((a.part_id = b.part_id)::INT) AS inn, sum((a.part_id <> b.part_id)::INT) AS c FROM edges JOIN parts a ON a.node_id = src JOIN parts b ON b.node_id = dst WHERE src <> dst GROUP BY 1) USING (part_id)""")
def m8_partition_quality(spark, d):
    return D.partition_quality(X.edges(spark, d), X.hash_parts(spark, d))


@query("""SELECT batch_id, node_id, max(o) = 1 AS is_output FROM (SELECT batch_id, node AS node_id, 0 AS o FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY round(score, 12) DESC, node) AS rn FROM x50) WHERE rn <= 50
    UNION ALL SELECT part_id, node_id, 1 FROM parts JOIN outputs USING (node_id)) GROUP BY 1, 2""", **_power_ctes(50))
def m9_batch_wise_batches(spark, d):
    return B.batch_wise_batches(X.hash_parts(spark, d), X.outputs(spark, d), G.normalize_adj(X.edges(spark, d)), 50, ALPHA)


@query("SELECT part_id AS batch_id, p.node_id, o.node_id IS NOT NULL AS is_output FROM parts p LEFT JOIN outputs o ON o.node_id = p.node_id WHERE part_id IN (SELECT part_id FROM parts JOIN outputs USING (node_id))")
def m10_cluster_batches(spark, d):
    return B.cluster_batches(X.hash_parts(spark, d), X.outputs(spark, d))


@query("""SELECT batch_id, node_id, max(o) = 1 AS is_output FROM (SELECT part_id AS batch_id, node AS node_id, 0 AS o FROM parts p JOIN neighbors ON source = p.node_id
    UNION ALL SELECT part_id, node_id, 1 FROM parts JOIN outputs USING (node_id)) GROUP BY 1, 2""")
def m11_partition_neighbor_batches(spark, d):
    return B.partition_neighbor_batches(X.hash_parts(spark, d), X.outputs(spark, d), X.neighbors(spark, d))


@query("SELECT batch_id, node_id, is_output FROM batch_nodes")
def m12_random_fixed_batches(spark, d):
    return X.batch_nodes(spark, d)


def _epoch_groups(seed: str, size: str) -> str:
    return f"SELECT ((row_number() OVER (ORDER BY {sql_uniform(seed, 'node_id')}, node_id) - 1) // {size})::BIGINT AS group_id, node_id FROM outputs"


@query("""SELECT batch_id, node_id, max(o) = 1 AS is_output FROM (SELECT group_id AS batch_id, node AS node_id, 0 AS o FROM g JOIN neighbors ON source = node_id UNION ALL SELECT group_id, node_id, 1 FROM g) GROUP BY 1, 2""", g=_epoch_groups("2021-3", "100"))
def m13_random_epoch_batches(spark, d):
    return B.random_epoch_batches(X.outputs(spark, d), X.neighbors(spark, d), 100, 3)


@query("SELECT group_id AS batch_id, node_id AS output_id, node AS node_id, node_id = node AS is_output FROM g JOIN neighbors ON source = g.node_id", g=_epoch_groups("2021-3", "100"))
def m14_disjoint_copy_batches(spark, d):
    return B.disjoint_copy_batches(X.outputs(spark, d), X.neighbors(spark, d), 100, 3)


@query("SELECT g.group_id AS batch_id, g.node_id AS output_id, node AS node_id, o.node_id IS NOT NULL AS is_output FROM g JOIN neighbors ON source = g.node_id LEFT JOIN g o ON o.group_id = g.group_id AND o.node_id = node", g=_epoch_groups("2021-3", "100"))
def m14_disjoint_copies_all_flags(spark, d):
    """Every copy of an output is flagged."""
    return B.disjoint_copy_batches(X.outputs(spark, d), X.neighbors(spark, d), 100, 3, flag_all_copies=True)


@query("SELECT batch_id // 2 AS batch_id, node_id, max(is_output::INT) = 1 AS is_output FROM batch_nodes GROUP BY 1, 2")
def m15_combine_batches(spark, d):
    return B.combine_batches(X.batch_nodes(spark, d), 2)


@query("SELECT batch_id, b.node_id, g.node_id IS NOT NULL AS is_output FROM batch_nodes b LEFT JOIN groups g ON g.group_id = batch_id AND g.node_id = b.node_id")
def m16_output_mask(spark, d):
    own = B.cut_outputs(X.outputs(spark, d), X.PER_BATCH, 2021).withColumnRenamed("group_id", "batch_id")
    return B.output_mask(X.batch_nodes(spark, d), own)


@query("SELECT CASE WHEN node_id % 2 = 0 THEN 'missing' ELSE 'not auxiliary' END AS problem, node_id FROM outputs WHERE node_id % 2 = 0 OR node_id % 5 = 0")
def m17_check_batches(spark, d):
    """On batches that are broken on purpose: even outputs left out, and multiples of five not among the auxiliary nodes."""
    rows = X.batch_nodes(spark, d)
    own = rows.where("is_output AND node_id % 2 <> 0")
    return B.check_batches(rows.where("node_id % 5 <> 0"), own, X.outputs(spark, d))


@query("SELECT batch_id, src, dst, round(weight, 6) AS weight FROM batch_edges")
def m18_induced_subgraphs(spark, d):
    return B.induced_subgraphs(X.batch_nodes(spark, d), G.normalize_adj(X.edges(spark, d))).withColumn("weight", six("weight"))


@query("SELECT batch_id, src, dst, round(weight, 6) AS weight FROM batch_edges", **X.WHOLE)
def m18_induced_subgraphs_all(spark, d):
    """Over the graph of all line items."""
    edges, own = cut(X.edges(spark, d, 0)), X.outputs(spark, d).withColumnRenamed("node_id", "src")
    near = edges.join(own, "src", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("node"))
    return B.induced_subgraphs(B.random_fixed_batches(X.outputs(spark, d), near, X.PER_BATCH), G.normalize_adj(edges)).withColumn("weight", six("weight"))


@query("""SELECT batch_id, src, dst, a.local_id AS src_local, b.local_id AS dst_local, round(weight, 6) AS weight FROM batch_edges e JOIN loc a USING (batch_id) JOIN loc b USING (batch_id) WHERE a.node_id = src AND b.node_id = dst""",
       loc="SELECT batch_id, node_id, (row_number() OVER (PARTITION BY batch_id ORDER BY node_id) - 1)::INT AS local_id FROM batch_nodes")
def m19_ready_batches(spark, d):
    """Ready batches written, read back, cut into subgraphs and given local ids."""
    at = scratch_path(spark, "ready")
    S.write_batches(X.batch_nodes(spark, d).withColumns({"method": F.lit("fixed"), "split": F.lit("val")}), at)
    rows = S.read_batches(spark, at, "fixed", "val").select("batch_id", "node_id", "is_output")
    cuts = B.induced_subgraphs(rows, G.normalize_adj(X.edges(spark, d)))
    return B.relabel_batch_edges(cuts, B.relabel_batch_nodes(rows)).select("batch_id", "src", "dst", "src_local", "dst_local", six("weight").alias("weight"))


@query("""SELECT a.batch_id, a.output_id, src, dst, round(weight, 6) AS weight FROM rw JOIN cp a ON a.node_id = src JOIN cp b ON b.node_id = dst AND b.batch_id = a.batch_id AND b.output_id = a.output_id""",
       g=_epoch_groups("2021-3", "100"), cp="SELECT g.group_id AS batch_id, g.node_id AS output_id, node AS node_id FROM g JOIN neighbors ON source = g.node_id")
def m14_disjoint_copy_edges(spark, d):
    return B.disjoint_copy_edges(B.disjoint_copy_batches(X.outputs(spark, d), X.neighbors(spark, d), 100, 3), G.normalize_adj(X.edges(spark, d))).select("batch_id", "output_id", "src", "dst", six("weight").alias("weight"))


@query("SELECT batch_id, node_id, is_output, (row_number() OVER (PARTITION BY batch_id ORDER BY node_id) - 1)::INT AS local_id FROM batch_nodes")
def m19_relabel_batch_nodes(spark, d):
    return B.relabel_batch_nodes(X.batch_nodes(spark, d))


@query("SELECT batch_id, node_id, label, k::BIGINT AS k, round(features[k + 1], 6) AS v FROM batch_nodes JOIN labels USING (node_id), (SELECT unnest(range(4)) AS k)")
def m20_gather_batch_features(spark, d):
    rows = B.gather_batch_features(X.batch_nodes(spark, d), X.labels(spark, d))
    return long_form(rows.withColumnRenamed("features", "x"), "batch_id", "node_id", "label")


# ---- sampling

WALK_CTES = {
    "num": "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM edges",
    "w0": "SELECT group_id AS sample_id, node_id AS walk_id, 0 AS step, node_id FROM groups",
    **{f"w{s}": f"SELECT sample_id, walk_id, {s} AS step, dst AS node_id FROM w{s - 1} w JOIN deg USING (node_id) JOIN num ON src = w.node_id AND k = least(floor({sql_uniform('2021-walk', 'sample_id', 'walk_id', str(s))} * deg), deg - 1)" for s in (1, 2)},
    "walks": "SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2",
    "wn": "SELECT sample_id AS batch_id, w.node_id, o.node_id IS NOT NULL AS is_output FROM (SELECT DISTINCT sample_id, node_id FROM walks) w LEFT JOIN outputs o ON o.node_id = w.node_id",
    "we": "SELECT a.batch_id, src, dst, weight FROM rw JOIN wn a ON a.node_id = src JOIN wn b ON b.node_id = dst AND b.batch_id = a.batch_id",
    "wc": "SELECT node_id, coalesce(c, 0)::DOUBLE AS c FROM nodes LEFT JOIN (SELECT node_id, count(*) AS c FROM wn GROUP BY 1) USING (node_id)",
    "nn": "SELECT node_id, (SELECT count(DISTINCT batch_id) FROM wn) / (CASE WHEN c = 0 THEN 0.1 ELSE c END)::DOUBLE / (SELECT count(*) FROM nodes) AS norm FROM wc",
    "en": "SELECT e.src, e.dst, CASE WHEN m.e IS NULL THEN 0.1 ELSE c / m.e END::DOUBLE AS norm FROM edges e LEFT JOIN (SELECT src, dst, count(*) AS e FROM we GROUP BY 1, 2) m ON m.src = e.src AND m.dst = e.dst LEFT JOIN wc ON wc.node_id = e.src",
}


def _walks(spark, d):
    roots = B.cut_outputs(X.outputs(spark, d), X.PER_BATCH, 2021).select(F.col("group_id").alias("sample_id"), F.col("node_id").alias("walk_id"), "node_id")
    return R.random_walks(X.edges(spark, d), roots, 2)


def _walk_graphs(spark, d):
    return R.walk_subgraphs(_walks(spark, d), G.normalize_adj(X.edges(spark, d)), X.outputs(spark, d))


def _norms(spark, d):
    nodes = X.nodes(spark, d)
    rows, links = _walk_graphs(spark, d)
    return rows, links, *R.walk_norms(rows, links, nodes, X.edges(spark, d), nodes.count())


@query("SELECT sample_id, walk_id, step, node_id FROM walks", **WALK_CTES)
def r1_random_walks(spark, d):
    return _walks(spark, d)


@query("SELECT batch_id, node_id, is_output FROM wn", **{
    "numbered": f"SELECT node_id, row_number() OVER (ORDER BY floor({sql_uniform('root-order', 'node_id')} * 64), node_id) - 1 AS k FROM nodes",
    "roots": f"SELECT sample_id, walk_id, node_id FROM (SELECT a AS sample_id, b AS walk_id, floor({sql_uniform('2021-root', 'a', 'b')} * (SELECT count(*) FROM nodes))::BIGINT AS k FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(50)) AS b)) JOIN numbered USING (k)",
    **WALK_CTES,
    "w0": "SELECT sample_id, walk_id, 0 AS step, node_id FROM roots",
})
def r2_walk_subgraphs(spark, d):
    """Training samples: roots drawn with replacement over all nodes."""
    roots = R.uniform_roots(X.nodes(spark, d), 4, 50)
    return R.walk_subgraphs(R.random_walks(X.edges(spark, d), roots, 2), G.normalize_adj(X.edges(spark, d)), X.outputs(spark, d))[0]


@query("SELECT 'node' AS kind, node_id AS src, node_id AS dst, round(norm, 6) AS norm FROM nn UNION ALL SELECT 'edge', src, dst, round(norm, 6) FROM en", **WALK_CTES)
def r3_walk_norms(spark, d):
    _, _, node, edge = _norms(spark, d)
    return node.select(F.lit("node").alias("kind"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"), six("norm").alias("norm")).union(edge.select(F.lit("edge"), "src", "dst", six("norm")))


COVERAGE_CTES = {
    "numbered": f"SELECT node_id, row_number() OVER (ORDER BY floor({sql_uniform('root-order', 'node_id')} * 64), node_id) - 1 AS k FROM nodes",
    "roots": f"SELECT sample_id, walk_id, node_id FROM (SELECT a AS sample_id, b AS walk_id, floor({sql_uniform('2021-root', 'a', 'b')} * (SELECT count(*) FROM nodes))::BIGINT AS k FROM (SELECT unnest(range((SELECT count(*) // 20 + 2 FROM nodes))) AS a), (SELECT unnest(range(50)) AS b)) JOIN numbered USING (k)",
    **{k: WALK_CTES[k] for k in ("num", "w0", "w1", "w2", "walks")},
    "w0": "SELECT sample_id, walk_id, 0 AS step, node_id FROM roots",
    "every": "SELECT DISTINCT sample_id, node_id FROM walks",
    "kept": "SELECT sample_id FROM (SELECT sample_id, coalesce(sum(c) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT sample_id, count(*) AS c FROM every GROUP BY 1)) WHERE b < (SELECT count(*) FROM nodes)",
    "wn": "SELECT sample_id AS batch_id, w.node_id, o.node_id IS NOT NULL AS is_output FROM (SELECT * FROM every WHERE sample_id IN (SELECT sample_id FROM kept)) w LEFT JOIN outputs o ON o.node_id = w.node_id",
    **{k: WALK_CTES[k] for k in ("we", "wc", "nn", "en")},
}


@query("SELECT 'node' AS kind, node_id AS src, node_id AS dst, round(norm, 6) AS norm FROM nn UNION ALL SELECT 'edge', src, dst, round(norm, 6) FROM en", **COVERAGE_CTES)
def r3_walk_norms_coverage(spark, d):
    """Norms over samples that are drawn until their nodes add up to all nodes."""
    nodes, edges = X.nodes(spark, d), cut(X.edges(spark, d))
    rows = cut(R.samples_until_coverage(nodes, edges, X.outputs(spark, d), 50, 2, 1.0))
    node, edge = R.walk_norms(rows, B.induced_subgraphs(rows, G.normalize_adj(edges)), nodes, edges, nodes.count())
    return node.select(F.lit("node").alias("kind"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"), six("norm").alias("norm")).union(edge.select(F.lit("edge"), "src", "dst", six("norm")))


@query("""SELECT 'node' AS kind, batch_id, node_id AS src, node_id AS dst, round(norm / sum(norm) OVER (PARTITION BY batch_id), 6) AS v FROM wn JOIN nn USING (node_id) WHERE is_output
    UNION ALL SELECT 'edge', batch_id, we.src, we.dst, round(weight * norm, 6) FROM we JOIN en ON en.src = we.src AND en.dst = we.dst""", **WALK_CTES)
def r4_apply_walk_norms(spark, d):
    node, edge = R.apply_walk_norms(*_norms(spark, d))
    return node.select(F.lit("node").alias("kind"), "batch_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), six("node_norm").alias("v")).union(edge.select(F.lit("edge"), "batch_id", "src", "dst", six("weight")))


@query("SELECT DISTINCT w.sample_id AS batch_id, w.node_id, g.node_id IS NOT NULL AS is_output FROM walks w LEFT JOIN groups g ON g.group_id = w.sample_id AND g.node_id = w.node_id", **WALK_CTES)
def r5_walk_eval_batches(spark, d):
    return R.walk_eval_batches(X.outputs(spark, d), X.edges(spark, d), G.normalize_adj(X.edges(spark, d)), 2, X.PER_BATCH)[0]


def _layer_ctes(sizes: list[int]) -> dict[str, str]:
    out = {"l0": "SELECT group_id AS batch_id, node_id FROM groups"}
    for k, size in enumerate(sizes):
        out[f"pi{k}"] = f"SELECT batch_id, dst AS node_id, sum(weight * weight) AS pi FROM l{k} l JOIN sym ON src = l.node_id GROUP BY 1, 2"
        out[f"l{k + 1}"] = f"SELECT batch_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY round(-ln({sql_uniform(f'2021-layer-{k}', 'batch_id', 'node_id')}) / pi, 12), node_id) AS rn FROM pi{k}) WHERE rn <= {size} UNION SELECT batch_id, node_id FROM l0"
        out[f"le{k}"] = f"SELECT a.batch_id, {len(sizes) - 1 - k} AS layer, src, dst, weight FROM l{k} a JOIN sym ON src = a.node_id JOIN l{k + 1} b ON b.batch_id = a.batch_id AND b.node_id = dst"
    return out


@query("SELECT batch_id, layer, src, dst, round(weight, 6) AS weight FROM le0 UNION ALL SELECT batch_id, layer, src, dst, round(weight, 6) FROM le1", **_layer_ctes([60, 80]))
def r6_layer_importance_sample(spark, d):
    own = B.cut_outputs(X.outputs(spark, d), X.PER_BATCH, 2021).select(F.col("group_id").alias("batch_id"), "node_id")
    return R.layer_importance_sample(own, G.normalize_adj(X.edges(spark, d), "sym"), [60, 80])[1].withColumn("weight", six("weight"))


def _hop_ctes(fanouts: list[int]) -> dict[str, str]:
    out = {"h0": "SELECT group_id AS batch_id, node_id FROM groups"}
    for k, f in enumerate(fanouts):
        out[f"he{k}"] = f"SELECT batch_id, {len(fanouts) - 1 - k} AS layer, src, dst, weight FROM (SELECT h.batch_id, src, dst, weight, row_number() OVER (PARTITION BY h.batch_id, src ORDER BY {sql_uniform(f'2021-hop-{k}', 'h.batch_id', 'src', 'dst')}, dst) AS rn FROM h{k} h JOIN sym ON src = h.node_id) WHERE rn <= {f}"
        out[f"h{k + 1}"] = f"SELECT batch_id, node_id FROM h{k} UNION SELECT batch_id, dst FROM he{k}"
    return out


@query("SELECT batch_id, layer, src, dst, round(weight, 6) AS weight FROM he0 UNION ALL SELECT batch_id, layer, src, dst, round(weight, 6) FROM he1", **_hop_ctes([2, 3]))
def r7_neighbor_sample(spark, d):
    own = B.cut_outputs(X.outputs(spark, d), X.PER_BATCH, 2021).select(F.col("group_id").alias("batch_id"), "node_id")
    return R.neighbor_sample(own, G.normalize_adj(X.edges(spark, d), "sym"), [2, 3])[1].withColumn("weight", six("weight"))


def _draw_ctes(fanouts: list[int], per_block: int) -> dict[str, str]:
    """Each draw is a rank among the numbers that are still free; three draws at most."""
    out = {
        "num": f"SELECT src, dst, weight, deg, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN deg <= {per_block} THEN 0 ELSE floor({sql_uniform('block', 'dst')} * ceil(deg / {per_block}::DOUBLE)) END, dst) - 1 AS k FROM sym JOIN deg ON node_id = src",
        "h0": "SELECT group_id AS batch_id, node_id FROM groups",
    }
    for k, f in enumerate(fanouts):
        rank = lambda j: f"least(floor({sql_uniform(f'2021-draw-{k}-{j}', 'batch_id', 'node_id')} * (deg - {j})), deg - {j + 1})::BIGINT"  # noqa: E731,B023
        out[f"a{k}"] = f"SELECT batch_id, node_id, deg, {', '.join(f'{rank(j)} AS r{j}' for j in range(f))} FROM h{k} JOIN deg USING (node_id)"
        second = f"SELECT *, r0 AS t0, r1 + (r0 <= r1)::INT AS t1 FROM a{k}"
        third = f"SELECT *, CASE WHEN lo <= r2 THEN r2 + 1 + (hi <= r2 + 1)::INT ELSE r2 END AS t2 FROM (SELECT *, least(t0, t1) AS lo, greatest(t0, t1) AS hi FROM ({second}))"
        out[f"d{k}"] = " UNION ALL ".join(f"SELECT batch_id, node_id, t{j} AS k FROM ({third if f == 3 else second}) WHERE {j} < deg" for j in range(f))
        out[f"he{k}"] = f"SELECT batch_id, {len(fanouts) - 1 - k} AS layer, src, dst, weight FROM d{k} JOIN num ON src = d{k}.node_id AND num.k = d{k}.k"
        out[f"h{k + 1}"] = f"SELECT batch_id, node_id FROM h{k} UNION SELECT batch_id, dst FROM he{k}"
    return out


@query("SELECT batch_id, layer, src, dst, round(weight, 6) AS weight FROM he0 UNION ALL SELECT batch_id, layer, src, dst, round(weight, 6) FROM he1", **X.WHOLE, **_draw_ctes([2, 3], 16))
def r7_neighbor_draws_all(spark, d):
    """Over the graph of all line items: neighbours drawn by number, adjacency in blocks of 16."""
    own = B.cut_outputs(X.outputs(spark, d), X.PER_BATCH, 2021).select(F.col("group_id").alias("batch_id"), "node_id")
    return R.neighbor_draws(own, G.normalize_adj(X.edges(spark, d, 0), "sym"), [2, 3], per_block=16)[1].withColumn("weight", six("weight"))


@query("SELECT group_id, node_id FROM g", g=_epoch_groups("2021-1", "(SELECT ceil(count(*) / 7.0)::BIGINT FROM outputs)"))
def r8_fixed_count_batches(spark, d):
    return B.fixed_count_batches(X.outputs(spark, d), 7, 1)


# ---- order of batches

DIST_CTES = {
    "cnt": "SELECT group_id AS batch_id, label, count(*) AS c FROM groups JOIN labels USING (node_id) WHERE label >= 0 GROUP BY 1, 2",
    "dist": f"SELECT batch_id, label, c / sum(c) OVER (PARTITION BY batch_id) AS p FROM (SELECT b.batch_id, l.label, coalesce(cnt.c, 0) + 1.0::DOUBLE AS c FROM (SELECT DISTINCT group_id AS batch_id FROM groups) b CROSS JOIN (SELECT unnest(range({X.CLASSES})) AS label) l LEFT JOIN cnt ON cnt.batch_id = b.batch_id AND cnt.label = l.label)",
    "kl": "SELECT a.batch_id AS batch_a, b.batch_id AS batch_b, CASE WHEN a.batch_id = b.batch_id THEN 0 ELSE sum((a.p - b.p) * ln(a.p / b.p)) + 1e-5 END AS distance FROM dist a JOIN dist b ON a.label = b.label GROUP BY 1, 2",
}


def _batch_outputs(spark, d):
    return B.cut_outputs(X.outputs(spark, d), X.PER_BATCH, 2021).withColumnRenamed("group_id", "batch_id")


def _distance(spark, d, kind="kl"):
    return O.batch_distance(O.batch_label_distribution(_batch_outputs(spark, d), X.labels(spark, d), X.CLASSES), kind)


@query("SELECT batch_id, label, round(p, 6) AS p FROM dist", **DIST_CTES)
def o1_batch_label_distribution(spark, d):
    return O.batch_label_distribution(_batch_outputs(spark, d), X.labels(spark, d), X.CLASSES).withColumn("p", six("p"))


@query("SELECT batch_a, batch_b, round(distance, 6) AS distance FROM kl", **DIST_CTES)
def o2_batch_distance_kl(spark, d):
    return _distance(spark, d).withColumn("distance", six("distance"))


@query("SELECT a.batch_id AS batch_a, b.batch_id AS batch_b, round(CASE WHEN a.batch_id = b.batch_id THEN 0 ELSE sum(abs(a.p - b.p)) + 1e-5 END, 6) AS distance FROM dist a JOIN dist b ON a.label = b.label GROUP BY 1, 2", **DIST_CTES)
def o2_batch_distance_l1(spark, d):
    return _distance(spark, d, "l1").withColumn("distance", six("distance"))


@query()
def o3_order_batches(spark, d):
    return O.order_batches(_distance(spark, d))


ORDER_SQL = f"SELECT (row_number() OVER (ORDER BY {sql_uniform('2021-1', 'batch_id')}, batch_id) - 1)::INT AS position, batch_id FROM (SELECT DISTINCT group_id AS batch_id FROM groups)"


@query("SELECT round(sum(distance), 6) AS total FROM ord a JOIN ord b ON b.position = (a.position + 1) % (SELECT count(*) FROM ord) JOIN kl ON batch_a = a.batch_id AND batch_b = b.batch_id", **DIST_CTES, ord=ORDER_SQL)
def o4_tour_length(spark, d):
    return O.tour_length(_distance(spark, d), O.random_batch_order(_batch_outputs(spark, d), 1)).withColumn("total", six("total"))


SCHEDULE_SQL = f"""SELECT seed, epoch, position, batch_id FROM (WITH RECURSIVE steps AS (
    SELECT unnest([1, 2])::BIGINT AS seed, 0 AS t, (SELECT min(batch_a) FROM kl) AS last, []::BIGINT[] AS used, (SELECT count(DISTINCT batch_id) FROM dist) AS n
    UNION ALL SELECT seed, t + 1, arg_min(batch_b, key), list_append(used, arg_min(batch_b, key)), n FROM (
        SELECT seed, t, n, used, batch_b, -ln({sql_uniform('schedule', 'seed', 't // n', 't % n', 'batch_b')}) / distance AS key
        FROM (SELECT seed, t, last, n, CASE WHEN t % n = 0 THEN []::BIGINT[] ELSE used END AS used FROM steps WHERE t < 3 * n) JOIN kl ON batch_a = last WHERE distance > 0 AND NOT list_contains(used, batch_b)) GROUP BY seed, t, used, n)
    SELECT seed, ((t - 1) // n)::INT AS epoch, ((t - 1) % n)::INT AS position, last AS batch_id FROM steps WHERE t > 0)"""


@query(SCHEDULE_SQL, **DIST_CTES)
def o5_weighted_batch_schedule(spark, d):
    return O.weighted_batch_schedule(_distance(spark, d), 3, [1, 2])


@query("SELECT position, batch_id FROM ord", ord=ORDER_SQL)
def o6_random_batch_order(spark, d):
    return O.random_batch_order(_batch_outputs(spark, d), 1)


# ---- scoring

W_LOGITS = X.weight_matrix(9, "logits", 4, X.CLASSES)
HEADS, WIDTH = 2, 2
ATT_L, ATT_R = X.weight_matrix(0, "att_l", HEADS, WIDTH), X.weight_matrix(0, "att_r", HEADS, WIDTH)


def _sql_array(a: np.ndarray) -> str:
    return "[" + ", ".join(_sql_array(x) if x.ndim else f"{float(x)!r}::DOUBLE" for x in a) + "]"


def _dims(expr: str) -> str:
    return ", ".join(expr.replace("#", str(k)) for k in range(1, 5))


UNNEST = "SELECT {keys}, k::BIGINT AS k, round(v[k + 1], 6) AS v FROM ({table}), (SELECT unnest(range({n})) AS k)"
LOGITS = f"SELECT node_id, c::BIGINT AS c, list_sum(list_transform(range(4), lambda i: features[i + 1] * ({_sql_array(W_LOGITS)})[i + 1][c + 1])) AS z FROM nodes, (SELECT unnest(range({X.CLASSES})) AS c)"
LOGP = "SELECT node_id, c, z - m - ln(sum(exp(z - m)) OVER (PARTITION BY node_id)) AS lp, z, m FROM (SELECT *, max(z) OVER (PARTITION BY node_id) AS m FROM logits)"
PRED = "SELECT node_id, min(c) AS pred FROM logp WHERE z = m GROUP BY 1"
MODEL = {"logits": LOGITS, "logp": LOGP, "pred": PRED}


def _x(spark, d):
    return X.nodes(spark, d).select("node_id", F.col("features").alias("x"))


def _logits(spark, d):
    return N.dense_layer(_x(spark, d), W_LOGITS)


@query(UNNEST.format(keys="node_id", n=4, table=f"SELECT src AS node_id, [{_dims('sum(weight * features[#])')}] AS v FROM sym JOIN nodes ON node_id = dst GROUP BY 1"))
def n1_aggregate_sum(spark, d):
    return long_form(N.aggregate_sum(G.normalize_adj(X.edges(spark, d), "sym"), _x(spark, d)), "node_id")


@query(UNNEST.format(keys="node_id", n=4, table=f"SELECT src AS node_id, [{_dims('avg(features[#]) + 1e-9')}] AS v FROM edges JOIN nodes ON node_id = dst GROUP BY 1"))
def n2_aggregate_mean(spark, d):
    # Means of few-digit numbers often end in a 5 at the seventh place; the shift keeps both engines' rounding alike.
    mean = N.aggregate_mean(X.edges(spark, d), _x(spark, d))
    return long_form(mean.withColumn("x", F.transform("x", lambda v: v + 1e-9)), "node_id")


@query(UNNEST.format(keys="node_id", n=4, table=f"SELECT src AS node_id, [{_dims('sum(weight * features[#])')}] AS v FROM sym JOIN nodes ON node_id = dst GROUP BY 1"), **X.WHOLE)
def n1_aggregate_sum_all(spark, d):
    """Over the graph of all line items."""
    return long_form(N.aggregate_sum(G.normalize_adj(X.edges(spark, d, 0), "sym"), _x(spark, d)), "node_id")


@query("SELECT src, dst, round(weight, 6) AS weight FROM sym", **X.WHOLE)
def g9_normalize_sym_all(spark, d):
    """Over the graph of all line items."""
    return G.normalize_adj(X.edges(spark, d, 0), "sym").withColumn("weight", six("weight"))


ATT_CTES = {
    "dots": "SELECT node_id, h, " + ", ".join(f"list_sum(list_transform(range({WIDTH}), lambda i: features[h * {WIDTH} + i + 1] * ({_sql_array(a)})[h + 1][i + 1])) AS {n}" for n, a in (("l", ATT_L), ("r", ATT_R))) + f" FROM nodes, (SELECT unnest(range({HEADS})) AS h)",
    "att": "SELECT src, dst, h, exp(e - max(e) OVER w) / sum(exp(e - m)) OVER w AS a FROM (SELECT *, max(e) OVER (PARTITION BY src, h) AS m FROM (SELECT src, dst, a.h, CASE WHEN a.r + b.l >= 0 THEN a.r + b.l ELSE 0.2 * (a.r + b.l) END AS e FROM edges JOIN dots a ON a.node_id = src JOIN dots b ON b.node_id = dst AND a.h = b.h)) WINDOW w AS (PARTITION BY src, h)",
}


@query("SELECT src, dst, h::BIGINT AS k, round(a, 6) AS v FROM att", **ATT_CTES)
def n3_attention_scores(spark, d):
    return long_form(N.attention_scores(X.edges(spark, d), _x(spark, d), ATT_L, ATT_R).withColumnRenamed("scores", "x"), "src", "dst")


@query(f"SELECT src AS node_id, (h * {WIDTH} + i)::BIGINT AS k, round(sum(a * features[h * {WIDTH} + i + 1]), 6) AS v FROM att JOIN nodes ON node_id = dst, (SELECT unnest(range({WIDTH})) AS i) GROUP BY 1, 2", **ATT_CTES)
def n4_aggregate_attention(spark, d):
    x = _x(spark, d)
    return long_form(N.aggregate_attention(N.attention_scores(X.edges(spark, d), x, ATT_L, ATT_R), x, HEADS, True), "node_id")


@query(UNNEST.format(keys="node_id", n=4, table=f"SELECT src AS node_id, [{_dims('sum(weight * features[#])')}] AS v FROM sym JOIN nodes ON node_id = dst GROUP BY 1"), **X.WHOLE)
def n1_aggregate_grid_all(spark, d):
    """Over the graph of all line items, by blocks and slices of two columns."""
    grid = N.grid_blocks(G.normalize_adj(X.edges(spark, d, 0), "sym"), 3, 4)
    return long_form(N.aggregate_grid(*grid, _x(spark, d), slice_width=2), "node_id")


@query(f"SELECT src AS node_id, (h * {WIDTH} + i)::BIGINT AS k, round(sum(a * features[h * {WIDTH} + i + 1]), 6) AS v FROM att JOIN nodes ON node_id = dst, (SELECT unnest(range({WIDTH})) AS i) GROUP BY 1, 2", **X.WHOLE, **ATT_CTES)
def n4_attention_grid_all(spark, d):
    """Over the graph of all line items, by blocks with a weight a head."""
    x = _x(spark, d)
    grid = N.grid_blocks(N.attention_scores(cut(X.edges(spark, d, 0)), x, ATT_L, ATT_R), 3, 4, "scores")
    return long_form(N.aggregate_grid(*grid, x), "node_id")


@query("SELECT node_id, c AS k, round(z, 6) AS v FROM logits", **MODEL)
def n5_dense_layer(spark, d):
    return long_form(_logits(spark, d), "node_id")


@query(f"SELECT node_id, c AS k, round(greatest((z - avg(z) OVER w) / sqrt(var_pop(z) OVER w + {N.NORM_EPS}), 0), 6) AS v FROM logits WINDOW w AS (PARTITION BY node_id)", **MODEL)
def n6_layer_norm_relu(spark, d):
    return long_form(N.row_wise(_logits(spark, d), N.chain(N.layer_norm(), N.relu)), "node_id")


HIDDEN, LAYERS = 8, 3


def _gcn_weights():
    sizes = [4] + [HIDDEN] * LAYERS
    return [X.weight_matrix(k, "gcn", a, b) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))], (X.weight_matrix(LAYERS, "gcn", HIDDEN, X.CLASSES), np.zeros(X.CLASSES))


def _sage_weights():
    sizes = [4] + [HIDDEN] * LAYERS
    return [(X.weight_matrix(k, "l", a, b), np.zeros(b), X.weight_matrix(k, "r", a, b)) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))], (X.weight_matrix(LAYERS, "sage", HIDDEN, X.CLASSES), np.zeros(X.CLASSES))


def _gat_weights():
    sizes, out = [4, HIDDEN, HIDDEN], [HIDDEN, HIDDEN, HEADS * X.CLASSES]
    return [{"w": X.weight_matrix(k, "gat", a, b), "att_l": X.weight_matrix(k, "al", HEADS, b // HEADS), "att_r": X.weight_matrix(k, "ar", HEADS, b // HEADS)} for k, (a, b) in enumerate(zip(sizes, out, strict=True))]


def _scored(spark, d):
    return X.splits(spark, d).where("split <> 'train'").select("node_id")


def _sql_linear(x: str, w: np.ndarray) -> str:
    return "[" + ", ".join(" + ".join(f"{x}[{i + 1}] * {float(w[i, c])!r}::DOUBLE" for i in range(len(w))) for c in range(w.shape[1])) + "]"


def _sql_normed(x: str, act: str = "greatest(#, 0)") -> str:
    """Layer norm of a list, then ``act`` of each value ``#``."""
    normed = f"list_transform({x}, lambda v: (v - list_avg({x})) / sqrt(list_aggregate({x}, 'var_pop') + {N.NORM_EPS}))"
    return f"list_transform({normed}, lambda z: {act.replace('#', 'z')})"


def _sql_sums(form: str, n: int) -> str:
    return "[" + ", ".join(form.replace("#", str(k + 1)) for k in range(n)) + "]"


SCORED = {"scored": "SELECT node_id FROM splits WHERE split <> 'train'"}


def _gcn_ctes(keys: str, start: str, links: str, kept: str) -> dict[str, str]:
    """``start`` gives (keys, x), ``links`` (keys but node_id, src, dst, weight); only nodes of ``kept`` come out of the last layer."""
    (layers, (last, _)), batch = _gcn_weights(), "a.batch_id, " if "batch_id" in keys else ""
    out, x = {"g0": start}, "x"
    for k, w in enumerate(layers):
        out[f"h{k}"] = f"SELECT {keys}, {_sql_linear('x', w)} AS x FROM (SELECT {keys}, {x} AS x FROM g{k})"
        same = " AND a.batch_id = h.batch_id" if batch else ""
        only = f" WHERE ({batch}a.src) IN (SELECT {'batch_id, ' if batch else ''}node_id FROM {kept})" if k == len(layers) - 1 else ""
        out[f"g{k + 1}"] = f"SELECT {batch}a.src AS node_id, {_sql_sums('sum(a.weight * h.x[#])', w.shape[1])} AS x FROM {links} a JOIN h{k} h ON h.node_id = a.dst{same}{only} GROUP BY ALL"
        x = _sql_normed("x")
    return out | {"gout": f"SELECT {keys}, {_sql_linear('x', last)} AS v FROM (SELECT {keys}, {x} AS x FROM g{len(layers)})"}


GCN = SCORED | _gcn_ctes("node_id", "SELECT node_id, features AS x FROM nodes", "sym", "scored")


def _sage_ctes() -> dict[str, str]:
    layers, (last, _) = _sage_weights()
    out = {"s0": "SELECT node_id, features AS x FROM nodes"}
    for k, (w_l, _, w_r) in enumerate(layers):
        only = " WHERE src IN (SELECT node_id FROM scored)" if k == len(layers) - 1 else ""
        out[f"near{k}"] = f"SELECT src AS node_id, {_sql_sums('avg(x[#])', len(w_l))} AS near FROM edges JOIN s{k} ON node_id = dst{only} GROUP BY 1"
        both = f"SELECT node_id, {_sql_linear('c', np.vstack([w_l, w_r]))} AS y FROM (SELECT node_id, list_concat(near, x) AS c FROM near{k} JOIN s{k} USING (node_id))"
        out[f"s{k + 1}"] = f"SELECT node_id, {_sql_normed('y')} AS x FROM ({both})"
    return SCORED | out | {"sout": f"SELECT node_id, {_sql_linear('x', last)} AS v FROM s{len(layers)}"}


def _gat_ctes() -> dict[str, str]:
    out, layers = {"t0": "SELECT node_id, features AS x FROM nodes"}, _gat_weights()
    for k, p in enumerate(layers):
        final, (heads, width) = k == len(layers) - 1, p["att_l"].shape
        dot = lambda a, h: " + ".join(f"x[{h * width + i + 1}] * {float(a[h, i])!r}::DOUBLE" for i in range(width))  # noqa: E731,B023
        each = lambda form: ", ".join(form.replace("#", str(h)) for h in range(heads))  # noqa: E731,B023
        out[f"th{k}"] = f"SELECT node_id, {_sql_linear('x', p['w'])} AS x FROM t{k}"
        out[f"td{k}"] = f"SELECT node_id, {', '.join(f'{dot(p[n], h)} AS {n[-1]}{h}' for h in range(heads) for n in ('att_l', 'att_r'))} FROM th{k}"
        only = " WHERE src IN (SELECT node_id FROM scored)" if final else ""
        raw = f"SELECT src, dst, {each('a.r# + b.l# AS e#')} FROM edges JOIN td{k} a ON a.node_id = src JOIN td{k} b ON b.node_id = dst{only}"
        leaky = f"SELECT src, dst, {each('CASE WHEN e# >= 0 THEN e# ELSE 0.2 * e# END AS e#')} FROM ({raw})"
        exps = f"SELECT src, dst, {each('exp(e# - max(e#) OVER (PARTITION BY src)) AS z#')} FROM ({leaky})"
        out[f"tp{k}"] = f"SELECT src, dst, {each('z# / sum(z#) OVER (PARTITION BY src) AS p#')} FROM ({exps})"
        sums = "[" + ", ".join(f"sum(p{c // width} * x[{c + 1}])" for c in range(heads * width)) + "]"
        out[f"ts{k}"] = f"SELECT src AS node_id, {sums} AS y FROM tp{k} JOIN th{k} ON node_id = dst GROUP BY 1"
        mean = "[" + ", ".join("(" + " + ".join(f"y[{h * width + c + 1}]" for h in range(heads)) + f") / {heads}" for c in range(width)) + "]"
        out[f"t{k + 1}"] = f"SELECT node_id, {mean if final else _sql_normed('y', 'CASE WHEN # > 0 THEN # ELSE exp(#) - 1 END')} AS x FROM ts{k}"
    return SCORED | out


@query(UNNEST.format(keys="node_id", n=X.CLASSES, table="SELECT * FROM gout"), **GCN)
def n7_gcn_forward(spark, d):
    return long_form(N.gcn_forward(_x(spark, d), G.normalize_adj(X.edges(spark, d), "sym"), *_gcn_weights(), outputs=_scored(spark, d)), "node_id")


@query(UNNEST.format(keys="node_id", n=X.CLASSES, table="SELECT * FROM sout"), **_sage_ctes())
def n8_sage_forward(spark, d):
    return long_form(N.sage_forward(_x(spark, d), X.edges(spark, d), *_sage_weights(), outputs=_scored(spark, d)), "node_id")


@query(UNNEST.format(keys="node_id", n=X.CLASSES, table=f"SELECT node_id, x AS v FROM t{len(_gat_weights())}"), **_gat_ctes())
def n9_gat_forward(spark, d):
    return long_form(N.gat_forward(_x(spark, d), X.edges(spark, d), _gat_weights(), outputs=_scored(spark, d)), "node_id")


@query(UNNEST.format(keys="batch_id, node_id", n=X.CLASSES, table="SELECT * FROM gout"), **{"own": "SELECT batch_id, node_id FROM batch_nodes WHERE is_output"}, **_gcn_ctes("batch_id, node_id", "SELECT batch_id, node_id, features AS x FROM batch_nodes JOIN nodes USING (node_id)", "batch_edges", "own"))
def n10_batch_forward(spark, d):
    rows = X.batch_nodes(spark, d)
    return long_form(N.batch_forward(rows, B.induced_subgraphs(rows, G.normalize_adj(X.edges(spark, d))), X.nodes(spark, d), N.gcn_forward, *_gcn_weights()), "batch_id", "node_id")


@query("SELECT node_id, c AS k, round(lp, 6) AS v, pred FROM logp JOIN pred USING (node_id)", **MODEL)
def n11_log_softmax(spark, d):
    out = N.predict(_logits(spark, d))
    return long_form(out.withColumnRenamed("logp", "x"), "node_id", "pred")


@query("SELECT round(avg(-lp), 6) AS loss FROM logp JOIN labels USING (node_id) WHERE label = c", **MODEL)
def n12_nll_loss(spark, d):
    return N.nll_loss(N.predict(_logits(spark, d)), X.labels(spark, d)).select(six("loss").alias("loss"))


@query("SELECT batch_id, round(sum(-lp * c2), 6) AS loss FROM (SELECT batch_id, b.node_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY batch_id) AS c2 FROM batch_nodes b WHERE is_output) JOIN logp USING (node_id) JOIN labels USING (node_id) WHERE label = c GROUP BY 1", **MODEL)
def n12_nll_loss_weighted(spark, d):
    """Losses of a batch's outputs, weighted by norms that add up to 1 in the batch."""
    own = cut(X.batch_nodes(spark, d).where("is_output"))
    norms = own.join(own.groupBy("batch_id").agg(F.count("*").alias("n")), "batch_id").select("batch_id", "node_id", (1.0 / F.col("n")).alias("node_norm"))
    logits = own.select("batch_id", "node_id").join(_logits(spark, d), "node_id").select("batch_id", "node_id", "x")
    return N.nll_loss(N.predict(logits), X.labels(spark, d), norms).select("batch_id", six("loss").alias("loss"))


# ---- evaluation


def _pred(spark, d):
    return N.predict(_logits(spark, d)).select(F.lit("full").alias("loader"), "node_id", "pred")


ACCURACY = "SELECT split, 'full' AS loader, round(avg((pred = label)::INT), 6) AS accuracy, count(*) AS n FROM j GROUP BY 1"
MACRO_F1 = """SELECT split, 'full' AS loader, round(avg(2.0 * h / (p + t)), 6) AS f1 FROM (SELECT split, class, sum(p) AS p, sum(t) AS t, sum(h) AS h FROM (
    SELECT split, pred AS class, 1 AS p, 0 AS t, (pred = label)::INT AS h FROM j UNION ALL SELECT split, label, 0, 1, 0 FROM j) GROUP BY 1, 2) GROUP BY 1"""
JUDGED = {"j": "SELECT split, pred, label FROM pred JOIN labels USING (node_id) JOIN splits USING (node_id)"}


@query(ACCURACY, **MODEL, **JUDGED)
def e1_accuracy(spark, d):
    return E.accuracy(_pred(spark, d), X.labels(spark, d), X.splits(spark, d)).withColumn("accuracy", six("accuracy"))


@query(MACRO_F1, **MODEL, **JUDGED)
def e2_macro_f1(spark, d):
    return E.macro_f1(_pred(spark, d), X.labels(spark, d), X.splits(spark, d)).withColumn("f1", six("f1"))


@query("SELECT split, loader, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM m GROUP BY 1, 2, 3", m=METRIC_ROWS)
def e3_metric_summary(spark, d):
    return E.metric_summary(_metrics(spark, d)).withColumns({"mean": six("mean"), "std": six("std")})


@query("SELECT epoch, phase, round(sum(loss * n) / sum(n), 6) AS loss, round(sum(r) / sum(n), 6) AS accuracy FROM b GROUP BY 1, 2", **MODEL,
       b="SELECT node_id % 2 AS epoch, split AS phase, node_id % 5 AS batch, avg(-lp) AS loss, count(*) AS n, sum((pred = label)::INT) AS r FROM logp JOIN labels USING (node_id) JOIN pred USING (node_id) JOIN splits USING (node_id) WHERE c = label GROUP BY 1, 2, 3")
def e4_epoch_loss_accuracy(spark, d):
    rows = N.predict(_logits(spark, d)).join(X.labels(spark, d).select("node_id", "label"), "node_id").join(X.splits(spark, d), "node_id")
    loss = -F.element_at("logp", (F.col("label") + 1).cast("int"))
    per = rows.groupBy((F.col("node_id") % 2).alias("epoch"), F.col("split").alias("phase"), F.col("node_id") % 5).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("n_right"))
    return E.epoch_loss_accuracy(per).withColumns({"loss": six("loss"), "accuracy": six("accuracy")})


# ---- whole workloads


@query()
def w1_node_wise(spark, d):
    """Scores, top-k, greedy merge, packing, auxiliary nodes and subgraphs of the validation nodes."""
    from graphbatch.plans.workloads import node_wise_workload

    return node_wise_workload(X.edges(spark, d), X.outputs(spark, d), topk=8, cap=50, alpha=ALPHA, eps=EPS)[1].withColumn("weight", six("weight"))


@query()
def w2_batch_wise(spark, d):
    """Partition, power iteration and the best nodes of each part."""
    from graphbatch.plans.workloads import batch_wise_workload

    return batch_wise_workload(X.edges(spark, d), X.nodes(spark, d), X.outputs(spark, d), parts=X.PARTS, ratio=0.2, alpha=ALPHA)


@query()
def w4_influential_parts(spark, d):
    """Batches of the parts of those nodes only that matter to some validation node."""
    from graphbatch.plans.workloads import influential_part_workload

    return influential_part_workload(X.edges(spark, d), X.outputs(spark, d), X.PARTS, topk=8, alpha=ALPHA, eps=EPS)[1]


@query("SELECT split, accuracy, n, f1 FROM acc JOIN mf USING (split)", **GCN, pred="SELECT node_id, list_position(v, list_max(v)) - 1 AS pred FROM gout", **JUDGED, acc=ACCURACY, mf=MACRO_F1)
def w3_full_scoring(spark, d):
    """Logits of the whole graph layer by layer, and accuracy and F1 of each split."""
    from graphbatch.plans.workloads import full_scoring_workload

    out = full_scoring_workload(_x(spark, d), X.edges(spark, d), X.labels(spark, d), X.splits(spark, d), *_gcn_weights())
    return out.withColumns({"accuracy": six("accuracy"), "f1": six("f1")})


@query(f"SELECT src, count(*) AS n, round(min({sql_uniform('f2', 'src', 'dst')}), 6) AS u FROM s GROUP BY 1", s=f"SELECT DISTINCT l_suppkey + {X.SHIFT} AS src, l_partkey AS dst FROM lineitem")
def f2_supplier_part(spark, d):
    return X.supplier_part(spark, d).groupBy("src").agg(F.count("*").alias("n"), six(F.min(hash_uniform("f2", "src", "dst"))).alias("u"))


@query("SELECT dst AS node_id, count(*) AS deg FROM s GROUP BY 1", s=f"SELECT DISTINCT user_id AS src, {X.SHIFT} + k AS dst FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)")
def f3_user_event_degrees(spark, d):
    return G.degrees(X.user_event(spark, d), "dst")


@query("SELECT vec_id AS src, (vec_id + s) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings, (SELECT unnest([1, 7, 31]) AS s)")
def f4_ring(spark, d):
    return X.ring(spark, d)
