import json

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanlake.operators.retrieval import replay
from spanlake.operators.scoring import evaluate
from spanlake.operators.updates import Centroids
from spanlake.sources import jsonl, questions, tasks
from spanlake.streaming.ingest import ChunkLog, ChunkOrderError, ingest
from spanlake.streaming.state import cache_hits, centroid_updates
from spanlake.streaming.windows import windowed


def test_jsonl_round_trip_and_resume(spark, tmp_path):
    rows = [(i, f"in {i} é", [f"o{i}"], i) for i in range(10)]
    df = spark.createDataFrame(rows, jsonl.SAMPLE)
    jsonl.write_jsonl(df, f"{tmp_path}/s")
    jsonl.write_jsonl(df.where("index < 2"), f"{tmp_path}/s", append=True)
    back = jsonl.read_jsonl(spark, f"{tmp_path}/s")
    assert back.count() == 12 and jsonl.read_jsonl(spark, f"{tmp_path}/s", first=3).count() == 3
    done = df.where("index % 2 = 0").select("index")
    assert sorted(r["index"] for r in jsonl.unfinished(df, done).collect()) == [1, 3, 5, 7, 9]


def test_chunk_files_merge(spark, tmp_path):
    for name, ids in (("vt-0", [1, 2]), ("vt-1", [3]), ("cwe-0", [4])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"index": i, "pred": f"p{i}"}) + "\n" for i in ids))
    (tmp_path / "vt.jsonl").write_text(json.dumps({"index": 9}) + "\n")
    got = jsonl.with_defaults(jsonl.merge_chunks(spark, str(tmp_path))).collect()
    assert sorted((r["task"], r["chunk"], r["index"]) for r in got) == [("cwe", 0, 4), ("vt", 0, 1), ("vt", 0, 2), ("vt", 1, 3)]
    assert {r["truncation"] for r in got} == {-1} and {str(r["others"]) for r in got} == {"{}"}


def test_question_readers(spark, tmp_path):
    squad = {"data": [{"title": "T", "paragraphs": [{"context": c, "qas": [{"id": "1", "question": f"q{c}", "is_impossible": False, "answers": [{"text": "a"}, {"text": "a"}]}, {"id": "2", "question": "no", "is_impossible": True, "answers": []}]} for c in ("bb", "aa")]}]}
    (tmp_path / "s.json").write_text(json.dumps(squad))
    docs, qas = questions.read_paragraph_questions(spark, str(tmp_path / "s.json"))
    assert sorted((r["doc_idx"], r["text"]) for r in docs.collect()) == [(0, "aa"), (1, "bb")]
    assert sorted((r["query"], r["outputs"], r["context"], r["more_context"]) for r in qas.collect()) == [("qaa", ["a"], [0], [1]), ("qbb", ["a"], [1], [0])]
    hops = [{"question": "q", "answer": "a", "context": [{"title": "B", "sentences": ["x", "y"]}, {"title": "A", "sentences": ["z"]}]}]
    (tmp_path / "h.json").write_text(json.dumps(hops))
    docs, qas = questions.read_hop_questions(spark, str(tmp_path / "h.json"))
    assert sorted((r["doc_idx"], r["text"]) for r in docs.collect()) == [(0, "A\nz"), (1, "B\nxy")]
    assert qas.first()["context"] == [1, 0]


def test_reports(spark, tmp_path):
    p = spark.createDataFrame([("vt", 0, ": The Answer.", ["answer", "none"]), ("vt", 1, "\x01 ", ["x"]), ("qa", 0, "both", None)], "task string, index long, pred string, outputs array<string>")
    s = evaluate(p)
    assert sorted((r["task"], r["score"], r["nulls"]) for r in s.collect()) == [("qa", 0.0, "0/1"), ("vt", 25.0, "1/2")]
    tasks.write_summary(s, f"{tmp_path}/sum")
    assert {r["Tasks"]: r["vt"] for r in spark.read.csv(f"{tmp_path}/sum", header=True).collect()} == {"Score": "25.0", "Nulls": "1/2"}
    tasks.write_submission(p, f"{tmp_path}/sub")
    assert spark.read.csv(f"{tmp_path}/sub", header=True).columns == ["Task", "ID", "Prediction"]
    assert tasks.task_table(spark).count() == 13


def test_chunk_order():
    log = ChunkLog()
    log.accept(0, 0, 5, False)
    for bad in ((0, 5, 1, False), (2, 5, 1, False), (1, 6, 1, False)):
        with pytest.raises(ChunkOrderError):
            log.accept(*bad)
    log.accept(1, 5, 2, True)
    with pytest.raises(ChunkOrderError):
        log.accept(2, 7, 1, False)


def chunks(spark, path, ids):
    for c in ids:
        rows = [(c, c * 4, c == 2, i) for i in range(c * 4, c * 4 + 4)]
        spark.createDataFrame(rows, "chunk_id long, token_offset long, is_last boolean, token_pos long").coalesce(1).write.mode("append").parquet(path)


def test_stream_ingest(spark, tmp_path):
    chunks(spark, f"{tmp_path}/in", [0, 1, 2])
    stream = spark.readStream.schema("chunk_id long, token_offset long, is_last boolean, token_pos long").parquet(f"{tmp_path}/in")
    ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["token_pos"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(12))
    chunks(spark, f"{tmp_path}/in2", [0, 2])
    stream = spark.readStream.schema("chunk_id long, token_offset long, is_last boolean, token_pos long").parquet(f"{tmp_path}/in2")
    with pytest.raises(Exception, match="expected"):
        ingest(stream, f"{tmp_path}/out2", f"{tmp_path}/cp2").awaitTermination()


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_windows_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    e.write.parquet(f"{tmp_path}/e")
    run(windowed(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")), "win", "append")
    done = {(r["start"], r["event_type"]): r["n"] for r in spark.table("win").collect()}
    batch = {(r["start"], r["event_type"]): r["n"] for r in e.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert done and all(batch[k] == n for k, n in done.items()) and len(done) >= len(batch) - 10  # the last day stays open


def test_stream_cache_equals_replay(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(g, s, o, int(c), int(1 + c % 2)) for s in range(20) for g in range(2) for o, c in enumerate(rng.choice(9, 3, replace=False))]
    kind = "group long, step long, ord int, cluster_id long, pages long"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 10 == k], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    run(cache_hits(stream, 6, 2, 5), "hits", "append")
    got = sorted((r["group"], r["step"], r["hits"], r["misses"]) for r in spark.table("hits").collect())
    assert got == sorted((r["group"], r["step"], r["hits"], r["misses"]) for r in replay(spark.createDataFrame(rows, kind), 6, 2, 5).collect())


def test_stream_centroids(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(0, i, rng.normal(size=3).tolist()) for i in range(10)]
    kind = "head int, token_pos long, key array<double>"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 5 == k], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/k")
    start = {0: (np.eye(3).tolist(), [1, 1, 1])}
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/k")
    run(centroid_updates(stream, start, 2, 4), "cents", "update")
    want = Centroids(np.eye(3), np.ones(3), 2, 4)
    for _, _, v in rows:
        want.add(v)
    last = {r["cluster_id"]: r for r in spark.table("cents").where("waiting = 2").collect()}
    assert [last[i]["size"] for i in range(3)] == want.n.tolist() and [last[i]["pending"] for i in range(3)] == want.pending.tolist()


def test_submission_holds_every_task(spark, tmp_path):
    from spanlake.plans.corpora import submission_union

    spark.createDataFrame([(1, "a", "de"), (2, "b", "it"), (3, "c", None), (4, "d", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r["ID"] for r in submission_union(spark, str(tmp_path)).collect()) == [1, 2, 3]
