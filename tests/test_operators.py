"""Sequential operators against plain one-by-one versions on small random graphs, and properties of the rest."""

from __future__ import annotations

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphbatch.operators import batches as B
from graphbatch.operators import evaluation as E
from graphbatch.operators import influence as P
from graphbatch.operators import merge as M
from graphbatch.operators import ordering as O
from graphbatch.operators import partition as D
from graphbatch.operators import prep as G
from graphbatch.operators import scoring as N


def graph(seed: int, n: int = 40, m: int = 70) -> tuple[list[int], set[tuple[int, int]]]:
    r = random.Random(seed)
    links = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    return list(range(n)), links | {(b, a) for a, b in links} | {(v, v) for v in range(n)}


def edges_df(spark, links):
    return spark.createDataFrame(sorted(links), "src long, dst long")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id long")


def exact_ppr(n, links, s, alpha):
    a = np.zeros((n, n))
    for u, v in links:
        a[u, v] = 1
    walk = a / a.sum(1, keepdims=True)
    return alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * walk.T)[:, s], a.sum(1)


def test_push_keeps_its_bound(spark):
    n, links = graph(1)
    got = P.ppr_push(edges_df(spark, links), ids_df(spark, [0, 3, 7]), 0.25, 1e-3).collect()
    for s in (0, 3, 7):
        exact, deg = exact_ppr(len(n), links, s, 0.25)
        p = np.zeros(len(n))
        for r in got:
            if r.source == s:
                p[r.node] = r.score
        assert (exact - p >= -1e-12).all() and (exact - p <= 1e-3 * deg + 1e-12).all() and p.sum() <= 1 + 1e-9


def pairs_of(seed, n=30, m=80):
    r = random.Random(seed)
    return [(i, j, r.choice([0.1, 0.2, 0.3, 0.4])) for i, j in sorted({(max(p), min(p)) for p in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if p[0] != p[1]})]


def greedy(n, pairs, fits, join):
    group, state = {v: v for v in range(n)}, {v: join(None, v) for v in range(n)}
    for i, j, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        a, b = sorted((group[i], group[j]))
        if a != b and fits(state[a], state[b]):
            state[a] = join(state[a], state[b])
            group = {v: a if g == b else g for v, g in group.items()}
    return group


@pytest.mark.parametrize("finish", [0, 50_000])
def test_merge_by_outputs_is_the_greedy_pass(spark, finish):
    pairs = pairs_of(5)
    want = greedy(30, pairs, lambda a, b: len(a) + len(b) <= 6, lambda a, b: {b} if a is None else a | b)
    got = M.merge_by_outputs(spark.createDataFrame(pairs, "i long, j long, weight double"), ids_df(spark, range(30)), 6, finish_rows=finish)
    assert {r.node_id: r.group_id for r in got.collect()} == want


@pytest.mark.parametrize(("finish", "cap", "spread"), [(0, 18, 5), (40, 18, 5), (200_000, 18, 5), (0, 2000, 900), (20_000, 2000, 900)])
def test_merge_by_aux_is_the_greedy_pass(spark, finish, cap, spread):
    """Rounds only, some components in tasks, all in tasks; from a cap of 2,000 on unions are counted for sums of sizes just above it."""
    pairs, r = pairs_of(9), random.Random(2)
    aux = {v: {v} | {r.randrange(12 * spread) for _ in range(spread)} for v in range(30)}
    if cap == 2000:
        aux |= {pairs[0][0]: set(range(1000)), pairs[0][1]: set(range(999, 2000)), pairs[1][0]: set(range(1000)), pairs[1][1]: set(range(5000, 6001))}
    want = greedy(30, pairs, lambda a, b: len(a) + len(b) <= int(cap * 1.0005) and len(a | b) <= cap, lambda a, b: set(aux[b]) if a is None else a | b)
    near = spark.createDataFrame([(s, v) for s, a in aux.items() for v in a], "source long, node long")
    got = M.merge_by_aux(spark.createDataFrame(pairs, "i long, j long, weight double"), near, ids_df(spark, range(30)), cap, finish_rows=finish)
    assert {x.node_id: x.group_id for x in got.collect()} == want


def test_packing_joins_the_two_smallest(spark):
    r = random.Random(3)
    groups = [(v, r.randrange(12)) for v in range(40)]
    first = {}
    for v, g in groups:
        first[g] = min(v, first.get(g, v))
    named = [(v, first[g]) for v, g in groups]
    sizes = [sum(g == x for _, g in named) for x in set(first.values())]
    heapq.heapify(sizes)
    while len(sizes) > 1:
        a, b = heapq.heappop(sizes), heapq.heappop(sizes)
        if a + b > 9:
            sizes += [a, b]
            break
        heapq.heappush(sizes, a + b)
    got = M.pack_small_groups(spark.createDataFrame(named, "node_id long, group_id long"), 9)
    assert sorted(x.c for x in got.groupBy("group_id").agg(F.count("*").alias("c")).collect()) == sorted(sizes)


def heap_of_sets(sets: dict[int, set[int]], cap: int) -> dict[int, int]:
    """Textbook version: the two smallest sets by (size, id) are joined until one union doesn't fit."""
    order = [(len(v), g, [g], v) for g, v in sets.items() if len(v) < cap]
    heapq.heapify(order)
    while len(order) > 1:
        one, two = heapq.heappop(order), heapq.heappop(order)
        if len(one[3] | two[3]) > cap:
            order += [one, two]
            break
        heapq.heappush(order, (len(one[3] | two[3]), min(one[1], two[1]), one[2] + two[2], one[3] | two[3]))
    return {g: g for g in sets} | {m: g for _, g, members, _ in order for m in members}


@pytest.mark.parametrize(("seed", "finish_rows"), [(4, 50_000), (4, 0), (5, 0), (6, 15), (7, 0)])
def test_packing_by_aux_equals_the_heap(spark, seed, finish_rows):
    r = random.Random(seed)
    sets = {g: set(r.sample(range(30), r.randrange(1, 9))) for g in r.sample(range(100), 24)}
    groups = spark.createDataFrame([(g, g) for g in sets], "node_id long, group_id long")
    near = spark.createDataFrame([(g, v) for g, vs in sets.items() for v in vs], "source long, node long")
    got = {x.node_id: x.group_id for x in M.pack_small_aux(groups, near, 14, finish_rows).collect()}
    assert got == heap_of_sets(sets, 14)


@pytest.mark.parametrize("kind", ["nested", "apart", "mixed"])
def test_packing_by_aux_needs_few_rounds(spark, monkeypatch, kind):
    """Sets that hold one another join in a chain, sets apart in pairs; rounds grow with the logarithm of the groups."""
    make = {"nested": lambda i: set(range(i)), "apart": lambda i: {100 * i + x for x in range(i)}, "mixed": lambda i: set(range(i)) if i % 2 else {100 * i + x for x in range(i)}}[kind]
    sets = {(7 * i) % 41: make(i) for i in range(1, 41)}
    rounds, rank = [], M.sorted_rank
    monkeypatch.setattr(M, "sorted_rank", lambda *a: rounds.append(1) or rank(*a))
    groups = spark.createDataFrame([(g, g) for g in sets], "node_id long, group_id long")
    near = spark.createDataFrame([(g, v) for g, vs in sets.items() for v in vs], "source long, node long")
    for cap in (30, 300):
        rounds.clear()
        got = {x.node_id: x.group_id for x in M.pack_small_aux(groups, near, cap, 0).collect()}
        assert got == heap_of_sets(sets, cap)
        assert len(rounds) <= 12


def test_packing_steps_give_the_sizes_of_the_heap():
    r = random.Random(8)
    for _ in range(500):
        cap = r.randrange(2, 40)
        counts = {s: r.randrange(1, 12) for s in r.sample(range(1, cap), r.randrange(1, min(cap, 8)))}
        sizes = [s for s, n in counts.items() for _ in range(n)]
        heapq.heapify(sizes)
        while len(sizes) > 1:
            a, b = heapq.heappop(sizes), heapq.heappop(sizes)
            if a + b > cap:
                sizes += [a, b]
                break
            heapq.heappush(sizes, a + b)
        steps = M.packing_steps(counts, cap)
        ends: dict[tuple[int, int], int] = {}
        for s, n in counts.items():
            for k in range(n):
                at = (s, k)
                while (x := next((x for x in steps if x.size == at[0] and x.first <= at[1] < x.last), None)) is not None:
                    at = (x.to_size, x.to_first + (at[1] - x.first) // x.together)
                ends[at] = ends.get(at, 0) + s
        assert sorted(ends.values()) == sorted(sizes) and all(at[0] == total for at, total in ends.items())


def test_packing_by_aux_keeps_the_cap(spark):
    r = random.Random(4)
    near = [(v, r.randrange(30)) for v in range(12) for _ in range(4)]
    groups = spark.createDataFrame([(v, v) for v in range(12)], "node_id long, group_id long")
    got = {x.node_id: x.group_id for x in M.pack_small_aux(groups, spark.createDataFrame(near, "source long, node long"), 10).collect()}
    assert set(got) == set(range(12)) and len(set(got.values())) < 12
    for g in set(got.values()):
        assert len({v for s, v in near if got[s] == g}) <= 10


def test_partition_covers_all_and_cuts_less_than_chance(spark):
    n, links = 200, set()
    for c in range(4):
        r = random.Random(c)
        links |= {(50 * c + r.randrange(50), 50 * c + r.randrange(50)) for _ in range(200)}
    links |= {(b, a) for a, b in links}
    e, nodes = edges_df(spark, links), ids_df(spark, range(n))
    parts = D.partition_graph(e, nodes, 4, slack=0.6).cache()
    assert parts.count() == parts.select("node_id").distinct().count() == n
    quality = D.partition_quality(e, parts).collect()
    assert max(q["size"] for q in quality) <= 1.6 * n / 4
    assert sum(q["cut"] for q in quality) < 0.75 * len([1 for a, b in links if a != b])


def test_power_iteration_is_personalised_pagerank_of_the_set(spark):
    n, links = graph(2)
    sets = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "batch_id long, node_id long")
    got = P.batch_ppr(G.normalize_adj(edges_df(spark, links)), sets, 0.25, 40, cut_every=5).collect()
    a = np.zeros((len(n), len(n)))
    for u, v in links:
        a[u, v] = 1
    a /= a.sum(1, keepdims=True)
    for b, members in ((0, [1, 2]), (1, [5])):
        t = np.zeros(len(n))
        t[members] = 1 / len(members)
        x = t
        for _ in range(40):
            x = 0.75 * a @ x + 0.25 * t
        y = np.zeros(len(n))
        for r in got:
            if r.batch_id == b:
                y[r.node] = r.score
        assert np.allclose(x, y)


def test_small_tours_are_the_longest(spark):
    r = random.Random(1)
    m = np.zeros((6, 6))
    for i, j in itertools.combinations(range(6), 2):
        m[i, j] = m[j, i] = r.random()
    dist = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(6)], "batch_a long, batch_b long, distance double")
    order = O.order_batches(dist)
    best = max(sum(m[a, b] for a, b in zip(p, [*p[1:], p[0]], strict=True)) for p in itertools.permutations(range(6)))
    assert abs(O.tour_length(dist, order).first().total - best) < 1e-9


def test_larger_tours_beat_the_given_order(spark):
    r = np.random.default_rng(3)
    m = r.random((20, 20))
    m = (m + m.T) * (1 - np.eye(20))
    dist = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(20) for j in range(20)], "batch_a long, batch_b long, distance double")
    order = O.order_batches(dist)
    assert sorted(x.batch_id for x in order.collect()) == list(range(20))
    assert O.tour_length(dist, order).first().total > sum(m[i, (i + 1) % 20] for i in range(20))


def test_tours_end_where_no_exchange_helps(spark):
    """Ids with gaps, two lengths of tours: each batch once, the smallest first, no 2-opt exchange left, and the same tour however the rows lie."""
    for n, seed in ((9, 5), (31, 6)):
        r = np.random.default_rng(seed)
        m = r.random((n, n))
        m = (m + m.T) * (1 - np.eye(n))
        dist = spark.createDataFrame([(7 * i - 40, 7 * j - 40, float(m[i, j])) for i in range(n) for j in range(n)], "batch_a long, batch_b long, distance double")
        order = O.order_batches(dist, starts=4)
        t = [(x.batch_id + 40) // 7 for x in order.orderBy("position").collect()]
        assert sorted(t) == list(range(n)) and t[0] == 0
        leg = lambda i, j: m[t[i % n], t[j % n]]  # noqa: B023,E731
        gains = [leg(i, j) + leg(i + 1, j + 1) - leg(i, i + 1) - leg(j, j + 1) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1)]
        assert max(gains) <= 1e-9
        assert abs(O.tour_length(dist, order).first().total - sum(leg(i, i + 1) for i in range(n))) < 1e-9
        again = O.order_batches(dist.repartition(5), starts=4)
        assert [(x.batch_id + 40) // 7 for x in again.orderBy("position").collect()] == t
    assert O.order_batches(dist.where("false")).count() == 0
    assert [x.batch_id for x in O.order_batches(dist.where("batch_a < -30 AND batch_b < -30")).orderBy("position").collect()] == [-40, -33]


def test_schedules_use_each_batch_once_an_epoch(spark):
    dist = spark.createDataFrame([(i, j, 0.0 if i == j else 1.0 + i + j) for i in range(5) for j in range(5)], "batch_a long, batch_b long, distance double")
    got = O.weighted_batch_schedule(dist, 3, [1, 2]).toPandas()
    for _, epoch in got.groupby(["seed", "epoch"]):
        used = epoch.sort_values("position")["batch_id"].tolist()
        assert len(used) == len(set(used)) >= 4
    assert O.weighted_batch_schedule(dist.where("batch_a = 0 AND batch_b = 0"), 2, [1]).count() == 0
    again = O.weighted_batch_schedule(dist.repartition(7), 3, [1, 2]).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))


def test_schedules_draw_by_distance(spark):
    """From batch 0, the first draw of many seeds falls on the others in proportion to their distances."""
    dist = spark.createDataFrame([(i, j, 0.0 if i == j else float(1 + j)) for i in range(4) for j in range(4)], "batch_a long, batch_b long, distance double")
    first = [x.batch_id for x in O.weighted_batch_schedule(dist, 1, list(range(900))).where("position = 0").collect()]
    for b in (1, 2, 3):
        assert abs(first.count(b) / 900 - (1 + b) / 9) < 0.06


def dense_graph(spark):
    n, links = graph(11, 15, 25)
    adj = G.normalize_adj(edges_df(spark, links), "sym")
    a = np.zeros((15, 15))
    for u, v in links:
        a[u, v] = 1
    deg = a.sum(0)
    r = np.random.default_rng(0)
    x = r.normal(size=(15, 4))
    return adj, a, a / np.sqrt(np.outer(deg, deg)), x, spark.createDataFrame([(i, x[i].tolist()) for i in n], "node_id long, x array<double>"), r


def stacked(df):
    return np.array([r.x for r in df.orderBy("node_id").collect()])


def test_gcn_equals_dense_numpy(spark):
    adj, _, s, x, df, r = dense_graph(spark)
    ws, last = [r.normal(size=(4, 5)), r.normal(size=(5, 5))], (r.normal(size=(5, 3)), r.normal(size=3))
    h = x
    for w in ws:
        h = N.relu(N.layer_norm()(s @ (h @ w)))
    assert np.allclose(stacked(N.gcn_forward(df, adj, ws, last)), h @ last[0] + last[1])
    few = ids_df(spark, [2, 5])
    assert np.allclose(stacked(N.gcn_forward(df, adj, ws, last, outputs=few)), (h @ last[0] + last[1])[[2, 5]])


def test_sage_equals_dense_numpy(spark):
    adj, a, _, x, df, r = dense_graph(spark)
    layers, last = [(r.normal(size=(4, 5)), r.normal(size=5), r.normal(size=(4, 5)))], (r.normal(size=(5, 3)), np.zeros(3))
    w_l, b, w_r = layers[0]
    h = (a @ x / a.sum(1, keepdims=True)) @ w_l + b + x @ w_r
    for unit in (False, True):
        want = N.relu(N.layer_norm()(N.unit_rows(h) if unit else h)) @ last[0]
        assert np.allclose(stacked(N.sage_forward(df, adj, layers, last, normalize=unit)), want)


def test_gat_equals_dense_numpy(spark):
    adj, a, _, x, df, r = dense_graph(spark)
    layers = [{"w": r.normal(size=(4, 6)), "att_l": r.normal(size=(2, 3)), "att_r": r.normal(size=(2, 3)), "bias": r.normal(size=6)}, {"w": r.normal(size=(6, 4)), "att_l": r.normal(size=(2, 2)), "att_r": r.normal(size=(2, 2))}]
    h = x
    for k, p in enumerate(layers):
        v = (h @ p["w"]).reshape(15, 2, -1)
        e = (v * p["att_r"]).sum(2)[:, None, :] + (v * p["att_l"]).sum(2)[None, :, :]
        e = np.where(e >= 0, e, 0.2 * e)
        z = np.where(a[:, :, None] > 0, np.exp(e - e.max()), 0)
        z /= z.sum(1, keepdims=True)
        out = np.einsum("uvh,vhw->uhw", z, v)
        h = out.reshape(15, -1) + p["bias"] if k == 0 else out.mean(1)
        if k == 0:
            h = N.elu(N.layer_norm()(h))
    assert np.allclose(stacked(N.gat_forward(df, adj, layers)), h)


def test_batches_score_like_their_own_graph(spark):
    adj, _, s, x, df, r = dense_graph(spark)
    ws, last = [r.normal(size=(4, 5))], (r.normal(size=(5, 3)), np.zeros(3))
    rows = spark.createDataFrame([(0, v, v < 3) for v in range(8)] + [(1, v, v == 9) for v in range(5, 12)], "batch_id long, node_id long, is_output boolean")
    nodes = df.withColumnRenamed("x", "features")
    got = {(q.batch_id, q.node_id): q.x for q in N.batch_forward(rows, B.induced_subgraphs(rows, adj), nodes, N.gcn_forward, ws, last).collect()}
    assert set(got) == {(0, 0), (0, 1), (0, 2), (1, 9)}
    for (b, v), logits in got.items():
        inside = list(range(8)) if b == 0 else list(range(5, 12))
        h = s[np.ix_([v], inside)] @ x[inside] @ ws[0]
        assert np.allclose(logits, N.relu(N.layer_norm()(h)) @ last[0])


def test_f1_and_accuracy_by_hand(spark):
    pred = spark.createDataFrame([("f", 1, 0), ("f", 2, 1), ("f", 3, 1)], "loader string, node_id long, pred long")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 2)], "node_id long, label long")
    splits = spark.createDataFrame([(i, "test") for i in (1, 2, 3)], "node_id long, split string")
    assert abs(E.accuracy(pred, labels, splits).first().accuracy - 1 / 3) < 1e-12
    assert abs(E.macro_f1(pred, labels, splits).first().f1 - (2 / 3 + 0 + 0) / 3) < 1e-12


def test_empty_tables(spark):
    none_e, none_n = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "node_id long")
    assert G.normalize_adj(none_e).count() == 0 and G.add_self_loops(none_e, none_n).count() == 0
    assert P.ppr_push(none_e, none_n).count() == 0
    near = spark.createDataFrame([], "source long, node long")
    assert B.random_fixed_batches(none_n, near, 5).count() == 0
    assert D.partition_graph(none_e, none_n, 3, rounds=1).count() == 0
    assert M.merge_by_outputs(spark.createDataFrame([], "i long, j long, weight double"), none_n, 3).count() == 0
    assert M.even_batch_size(0, 5) == 0 and M.even_batch_size(11, 5) == 4


def test_results_do_not_depend_on_partitions(spark):
    _, links = graph(3)
    out = ids_df(spark, range(0, 40, 2))
    near = edges_df(spark, links).join(out.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("node"))
    one = {tuple(r) for r in B.random_fixed_batches(out.repartition(1), near, 7).collect()}
    assert one == {tuple(r) for r in B.random_fixed_batches(out.repartition(9), near.repartition(5), 7).collect()}
    assert B.check_batches(B.random_fixed_batches(out, near, 7), B.random_fixed_batches(out, near, 7).where("is_output"), out).count() == 0
