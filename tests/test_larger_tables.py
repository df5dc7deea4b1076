"""Queries on embeddings other than the given ones, against their SQL."""

import duckdb
import numpy as np
import pytest
from compare import same

from spanlake import plans


def vectors(path, spark, labels, ids=None, seed=3, gone=()):
    """An embeddings table of these labels and, unless given, ids from 0; some vectors are null or copies of the first."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(len(labels), 64)).astype(np.float32)
    x[3:40:3] = x[0]
    ids = range(len(labels)) if ids is None else ids
    rows = [(int(i), None if n in gone else v.tolist(), int(c)) for n, (i, v, c) in enumerate(zip(ids, x, labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    return con


def equal(spark, con, path, name):
    left, right = same(plans.queries()[name](spark, str(path)), con, plans.oracle_sql()[name])
    assert left == right
    return left


@pytest.mark.parametrize("sizes", [[3300, 3400], [3300, 60, 40], [30, 3300, 50]])
def test_tiles_without_oversize_clusters(spark, tmp_path, sizes):
    con = vectors(tmp_path, spark, np.repeat(np.arange(len(sizes)), sizes))
    equal(spark, con, tmp_path, "cluster_tiles_invariants")
    equal(spark, con, tmp_path, "cluster_tiles")


@pytest.fixture
def small_cells(monkeypatch):
    """Cells of 40 keys and 20 queries, so that small tables need many."""
    from spanlake.operators import attention, retrieval

    for module in (attention, retrieval):
        inner = module.meet
        monkeypatch.setattr(module, "meet", lambda *args, inner=inner: inner(*args[:7], 40, 20))


@pytest.mark.parametrize("name", ["attention_causal", "attention_chunked", "recall_at_budget", "gemm_softmax"])
def test_cells_of_pairs(spark, tmp_path, small_cells, name):
    """One head has most tokens, ids are far apart, some vectors are null or copies of each other."""
    labels = np.random.default_rng(1).permutation([0] * 300 + [1] * 50 + [2])
    con = vectors(tmp_path, spark, labels, ids=[n * 7 if n % 2 else n * 60 + 100000 for n in range(len(labels))], gone={7, 8, 40, 100})
    equal(spark, con, tmp_path, name)


@pytest.mark.parametrize("name", ["attention_causal", "attention_chunked", "recall_at_budget", "gemm_softmax"])
def test_pairs_are_no_rows(spark, name):
    """Only cells of vectors are exchanged: no join of all keys of a head with all its queries."""
    from conftest import SMALL

    plan = plans.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with(key" not in plan and "zip_with(qv" not in plan


def test_words_of_odd_documents(spark, tmp_path):
    """Documents that share an id or have none, empty and null texts; texts are exchanged and not their words."""
    texts = [(1, "b a  a\tc"), (1, "a d\n"), (2, ""), (3, None), (4, "x \u2028"), (None, "z y z"), (5, " ".join(f"w{i}" for i in range(40)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert len(equal(spark, con, tmp_path, "cwe_task")) == 12 + 6 + 6 + 60
    assert "Generate" not in plans.queries()["cwe_task"](spark, str(tmp_path))._jdf.queryExecution().toString()
