from collections import Counter

from compare import plain
from plain_versions import components, frame, rows, rule_counts, without_repeats

import corpus_pipeline as P
from spanlake.llm.factorization_machine import fit_quality, score_quality

DATA = rows()


def labels_dir(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages(spark, tmp_path):
    d = labels_dir(spark, tmp_path)
    docs = frame(spark, extra=True)
    kept = P.quality(spark, docs, d)
    assert kept.columns == docs.columns
    model = fit_quality(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = Counter((r["doc_id"], r["text"]) for r in score_quality(docs, model, score_col="p").where("p >= 0.3").collect())
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want

    one = P.near_duplicates(spark, docs, d)
    assert one.columns == docs.columns
    first = {(i, c) for i, _, c in components([(i, t) for i, t, *_ in DATA])}
    stay = {i for i, c in first if i is None or i == c}
    mine = Counter((r["doc_id"], r["text"]) for r in one.collect())
    assert mine == Counter({(i, t) for i, t, *_ in DATA if i in stay})

    less = P.repeated_passages(spark, docs, d)
    assert less.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in less.collect()) == Counter((i, b.decode("utf-8", "ignore")) for i, *_, b in without_repeats([(i, t) for i, t, *_ in DATA]))
    assert all(r["n_chars"] == len(r["text"]) for r in less.collect())

    mix = P.mixed(spark, docs, d)
    assert mix.columns == docs.columns
    copies = Counter((r["doc_id"], r["text"]) for r in mix.collect())
    assert set(copies) <= {(i, t) for i, t, *_ in DATA} and max(copies.values()) <= 4
    total = sum(rule_counts(t)[0] for _, t, *_ in DATA)
    assert 0.6 * total <= sum(n * rule_counts(t)[0] for (_, t), n in copies.items()) <= 2 * total

    packs = P.packed(spark, docs, d)
    assert sum(r["n_words"] for r in packs.collect()) == total


def test_run(spark):
    from conftest import SMALL

    out = P.run(spark, SMALL)
    r = [tuple(plain(x) for x in row) for row in out.collect()]
    assert r and [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixed", "packed"]


def test_no_documents(spark, tmp_path):
    d = labels_dir(spark, tmp_path)
    docs = frame(spark, [])
    for _, stage in P.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0


def test_quality_is_fitted_in_a_task(spark, tmp_path, monkeypatch):
    """The driver, which has the least memory, doesn't fit the model."""
    from spanlake.llm import factorization_machine

    def here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(factorization_machine, "descend", here)
    d = labels_dir(spark, tmp_path)
    b, w, v = fit_quality(frame(spark), spark.read.parquet(f"{d}/labels.parquet"))
    assert w.any() and v.shape == (len(w), 8)
