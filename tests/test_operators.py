import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import params as P
from spanlake.operators import attention as A
from spanlake.operators import clustering as C
from spanlake.operators import prompts, textgen
from spanlake.operators.retrieval import PageCache, cluster_tiles, page_gate, replay, select_clusters
from spanlake.operators.updates import Centroids, fold


def test_cluster_counts():
    assert P.cluster_counts(0, 0) == (1,) and P.cluster_counts(8, 0) == (1,) and P.cluster_counts(40, 0) == (3,)  # 2.5 rounds away from zero
    assert P.cluster_counts(500, 0) == (31,) and P.cluster_counts(2000, 0) == (125,)
    assert P.cluster_counts(500, 2) == (32, 32) and P.cluster_counts(131072, 2) == (90, 90)
    assert P.cluster_counts(500, 4) == (2,) * 4 and P.cluster_counts(2000, 4) == (3,) * 4
    assert P.cluster_counts(500, 2, override=(4, 5, 6, 7)) == (4, 5)
    with pytest.raises(ValueError):
        P.cluster_counts(10, 3)


def test_budgets():
    b = P.budget(125, 2000, 0.02)
    assert (b.probes, b.tokens, b.buffer_pages) == (2, 40, 5)  # 2.5 rounds to even
    assert P.budget(10, 0, 0.0).tokens == 1 and P.budget(10, 100, 5.0).probes == 10
    assert P.list_capacity(100, 20, 50, 40) == 0
    assert P.hot_capacity(10, 0.3) == 3 and P.hot_capacity(1, 0.1) == 1 and P.hot_capacity(10, 2) == 10
    assert P.prefetch_clusters(8, 0, 10) == 0 and P.prefetch_clusters(8, 0.01, 10) == 1


def clusters(spark, sizes):
    return spark.createDataFrame([(0, i, 1.0, s) for i, s in enumerate(sizes)], "head int, cluster_id long, similarity double, size long")


def test_selection_edges(spark):
    """Equal similarities go by id; the cluster that crosses the budget stays; a total right on it ends the selection."""
    ids = lambda budget: [r["cluster_id"] for r in select_clusters(clusters(spark, [10, 0, 10, 10, 5]), 10, budget).orderBy("rank").collect()]
    assert ids(20) == [0, 2] and ids(21) == [0, 2, 3] and ids(1) == [0]


def test_page_gate_and_tiles(spark):
    sel = select_clusters(clusters(spark, [16, 8, 40, 8, 100, 8]), 10, 1 << 40)
    assert [r["cluster_id"] for r in page_gate(sel, 3).orderBy("rank").collect()] == [0, 1]
    assert [(r["cluster_id"], r["tile"]) for r in cluster_tiles(sel, 5).orderBy("rank").collect()] == [(0, 0), (1, 0), (2, 1), (3, 2)]  # the oversize one ends it


def test_page_cache_order():
    c = PageCache(4, 2)
    assert c.step([(1, 1), (2, 1), (3, 0)], 10) == ([], [(1, 1), (2, 1)])
    assert list(c.cold) == [1, 2]
    assert c.step([(1, 1)], 10) == ([(1, 1)], []) and list(c.hot) == [1]
    assert c.step([(2, 1), (5, 1)], 10) == ([(2, 1)], [(5, 1)]) and list(c.hot) == [1, 2]
    c.step([(5, 1)], 10)
    assert list(c.hot) == [2, 5] and list(c.cold) == [1]  # the hot tail fell
    c.step([(6, 2)], 10)
    assert list(c.cold) == [6] and list(c.hot) == [2, 5]  # the cold tail went first
    c.step([(7, 4)], 10)
    assert c.used() == 4 and list(c.cold) == [7] and not c.hot
    assert c.step([(8, 3), (9, 3)], 5)[1] == [(8, 3)]  # the page buffer stops the step
    c = PageCache(4, 1)
    c.step([(1, 3)], 9)
    c.step([(1, 3)], 9)
    assert list(c.cold) == [1] and not c.hot  # larger than the hot tier
    assert PageCache.of(4, 1, c.state()).state() == c.state()


def test_replay_is_the_fold(spark):
    rng = np.random.default_rng(0)
    rows = [(g, s, o, int(c), int(1 + c % 3)) for g in range(3) for s in range(30) for o, c in enumerate(rng.choice(12, 4, replace=False))]
    df = spark.createDataFrame(rows, "group long, step long, ord int, cluster_id long, pages long").repartition(4)
    got = {(r["group"], r["step"]): (r["hits"], r["misses"]) for r in replay(df, 10, 3, 8).collect()}
    for g in range(3):
        cache = PageCache(10, 3)
        for s in range(30):
            h, m = cache.step([(c, p) for gg, ss, _, c, p in rows if (gg, ss) == (g, s)], 8)
            assert got[g, s] == (len(h), len(m))


def test_lloyd_edges():
    c, label, inertia = C.lloyd(np.ones((10, 4)), 3, 5, 1)
    assert np.allclose(c, 1) and inertia[-1] == 0 and set(label) == {0}
    c, label, _ = C.lloyd(np.arange(6.0).reshape(3, 2), 8, 5, 1)
    assert len(c) == 3 and sorted(label) == [0, 1, 2]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    _, _, inertia = C.lloyd(x, 7, 20, 42)
    assert all(b <= a + 1e-9 for a, b in zip(inertia, inertia[1:]))


def test_index_of_trained_codebook(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(h, i, rng.normal(size=8).tolist()) for h in (0, 1) for i in range(120)], "head int, token_pos long, key array<double>")
    for parts in (0, 2, 4):
        idx = C.build_index(df, 8, parts, {0: (5,), 2: (3, 3), 4: (2, 2, 2, 2)}[parts])
        lists = idx.lists.orderBy("head", "list_pos").collect()
        assert [r["list_pos"] for r in lists] == list(range(120)) * 2
        assert {len(r["centroid"]) for r in idx.clusters.collect()} == {8}


def test_sampling_filters(spark):
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate([2.0, 1.0, 2.0, -1.0])], "row long, token int, logit double")
    assert A.greedy(df).first()["token"] == 0
    assert [r["token"] for r in A.filtered(df, top_k=3).orderBy("rank").collect()] == [0, 2, 1]
    p = A.filtered(df, top_p=0.5).collect()
    assert sum(r["p"] for r in p) == pytest.approx(1) and len(p) == 2


def test_tiles_merge_exactly(spark):
    rng = np.random.default_rng(5)
    kv = spark.createDataFrame([(0, i, (rng.normal(size=4) * 9).tolist()) for i in range(50)], "head int, token_pos long, key array<double>").selectExpr("*", "key as value")
    q = spark.createDataFrame([(0, rng.normal(size=4).tolist())], "head int, query array<double>")
    a = A.attend(kv, q, 4, 0.5).first()["out"]
    b = A.attend_tiled(kv, q, 4, 0.5, kv.token_pos % 7).first()["out"]
    assert a == pytest.approx(b)


@pytest.mark.parametrize("threshold", [3, 4, 5])
def test_incremental_threshold(spark, threshold):
    """Just below, at and above the number of keys that one cluster gets in a batch of four."""
    start = np.array([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]])
    c = Centroids(start, np.array([2, 3, 0]), threshold, 4)
    keys = [[1.0, 0.2]] * 4
    assert c.add(keys[0]) == [] and [c.add(k) for k in keys[1:]][-1] == [0, 0, 0, 0]  # the empty cluster never wins
    assert c.n.tolist() == ([6, 3, 0] if threshold <= 4 else [2, 3, 0]) and c.pending[0] == (0 if threshold <= 4 else 4)
    tokens = spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "head int, token_pos long, key array<double>")
    table = spark.createDataFrame([(0, i, n, v.tolist()) for i, (n, v) in enumerate(zip([2, 3, 0], start))], "head int, cluster_id long, size long, centroid array<double>")
    got = {r["cluster_id"]: r for r in fold(tokens, table, threshold, 4).collect()}
    assert [got[i]["size"] for i in range(3)] == c.n.tolist() and np.allclose([got[i]["centroid"] for i in range(3)], c.c)


def test_distractors_fill_up(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_idx long, text string")
    questions = spark.createDataFrame([(0, [3], [4, 5]), (1, [0, 1], None), (2, [9], list(range(9)))], "q long, context array<long>, more_context array<long>")
    for size, found in ((4, 4), (10, 10), (30, 10)):
        rows = textgen.with_distractors(questions, docs, size).collect()
        for q, gold, kin in ((0, {3}, {4, 5}), (1, {0, 1}, set()), (2, {9}, set(range(9)))):
            mine = [r for r in rows if r["q"] == q]
            assert len({r["doc_idx"] for r in mine}) == len(mine) == found
            assert {r["doc_idx"] for r in mine if r["gold"]} == gold
            assert sorted(r["place"] for r in mine) == list(range(1, found + 1))
            assert kin <= {r["doc_idx"] for r in mine} or len(kin) + len(gold) > found


@pytest.mark.parametrize("noises, chains, hops", [(12, 2, 4), (3, 1, 4), (1, 1, 9)])
def test_tracking_prompts_can_be_solved(spark, noises, chains, hops):
    for r in prompts.tracking_prompts(spark.range(5).withColumnRenamed("id", "sample"), noises, chains, hops).collect():
        start = re.search(r"assigned the value (\d+) in", r["input"]).group(1)
        found, values = [], {}
        for var, number, other in re.findall(r"VAR ([A-P]{5}) = (?:(\d+)|VAR ([A-P]{5}))", r["input"].split("Question:")[0]):
            values[var] = number or values[other]
            found += [var] if values[var] == start else []
        assert found == list(r["outputs"]) and len(found) == min(hops + 1, 5 if noises == 1 else 99)


def test_running_sums_and_fitting_units(spark):
    rows = [(k, i * 7 % 1000, "w " * (i % 4)) for k, n in (("a", 150), (None, 60), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at long, text string")
    got = textgen.running_sums(df.withColumn("n", F.size(F.split(F.trim("text"), " +"))), "k", "at", {"upto": F.col("n")}, width=50).collect()
    got_units = {r["k"]: (r["units"], r["tokens"]) for r in textgen.fitting_units(df, 100, 9, 10, "k", "at").collect()}
    for k in ("a", None, "b"):
        mine = sorted((r["at"], r["n"], r["upto"]) for r in got if r["k"] == k)
        assert [u for _, _, u in mine] == list(itertools.accumulate(n for _, n, _ in mine))
        lengths = [len(t.split()) for _, _, t in sorted(r for r in rows if r[0] == k)]
        n = used = 0
        for take in [*range(10, len(lengths), 10), len(lengths)]:
            if sum(lengths[:take]) + 9 > 100:
                break
            n, used = take, sum(lengths[:take])
        assert got_units[k] == (n, used)
