"""Ticket logs, the JSON sink and pruned search against brute force."""

from __future__ import annotations

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import pivots, retrieval, tickets
from lodestone.sources import json_sink


# ---- tickets ---------------------------------------------------------------
def test_replay_equals_a_loop(spark):
    rng = random.Random(5)
    log, now = [], {}
    for seq in range(600):
        kind = rng.choice(["add", "update", "update", "update", "delete"]) if seq not in (150, 151, 400) else "clear"
        row = (None if kind == "clear" else rng.choice([1, 1, 1, 2, 3, 4]), kind, seq, rng.choice([None, "Open", "Closed"]), rng.choice([None, "P0", "P1"]))
        log.append(row)
        i, _, _, status, priority = row
        if kind == "clear":
            now = {}
        elif kind == "delete":
            now.pop(i, None)
        elif kind == "add":
            now[i] = {"status": status, "priority": priority}
        elif i in now:
            now[i] |= {k: v for k, v in (("status", status), ("priority", priority)) if v is not None}
    rng.shuffle(log)
    got = tickets.replay(spark.createDataFrame(log, "id long, kind string, seq long, status string, priority string")).collect()
    assert {r.id: {"status": r.status, "priority": r.priority} for r in got} == now
    assert tickets.replay(spark.createDataFrame([], "id long, kind string, seq long, status string")).count() == 0


def test_update_folds_or_refuses_several_changes(spark):
    old = spark.createDataFrame([(1, "Open", "P1"), (2, "Open", "P2")], "id long, status string, priority string")
    new = spark.createDataFrame([(1, 1, "Held", None), (1, 3, None, "P0"), (1, 2, "Closed", None), (9, 1, "Lost", None)], "id long, seq long, status string, priority string")
    assert sorted(tuple(r) for r in tickets.update(old, new, "seq").collect()) == [(1, "Closed", "P0"), (2, "Open", "P2")]
    with pytest.raises(Exception, match="several changes of ticket 1"):
        tickets.update(old, new.drop("seq")).collect()
    assert tickets.update(old, new.where("seq = 3").drop("seq")).count() == 2


# ---- the JSON sink ---------------------------------------------------------
def test_json_arrays_commit_at_once(spark, tmp_path):
    json_sink.register(spark)
    path = tmp_path / "out"
    rows = spark.createDataFrame([(i, f"Füße {i} \"q\"\n", [(1, "á")], None) for i in range(25)], "id long, text string, sections array<struct<level:int,text:string>>, gone string")
    rows.repartition(4).write.format("json_array").mode("overwrite").save(str(path))
    files = sorted(path.glob("*.json"))
    found = [x for f in files for x in json.loads(f.read_text())]
    assert len(files) == 4 and sorted(x["id"] for x in found) == list(range(25))
    assert found[0]["sections"] == [{"level": 1, "text": "á"}] and found[0]["gone"] is None
    assert files[0].read_text() == json.dumps(json.loads(files[0].read_text()), ensure_ascii=False, indent=2) + "\n"
    # a task that fails leaves the old array, and nothing beside it
    with pytest.raises(Exception, match="boom"):
        bad = rows.repartition(4).withColumn("text", F.when(F.col("id") == 13, F.raise_error(F.lit("boom"))).otherwise(F.col("text")))
        bad.write.format("json_array").mode("overwrite").save(str(path))
    assert sorted(path.glob("*.json")) == files and [p.name for p in Path(tmp_path).iterdir()] == ["out"]
    rows.limit(0).write.format("json_array").mode("overwrite").save(str(path))
    assert [x for f in path.glob("*.json") for x in json.loads(f.read_text())] == [] and [p.name for p in Path(tmp_path).iterdir()] == ["out"]
    with pytest.raises(Exception, match="append"):
        rows.write.format("json_array").mode("append").save(str(path))


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path, monkeypatch):
    import pyspark

    class Task:
        partitionId = taskAttemptId = lambda self: 3

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Task))
    writer = json_sink._Writer(str(tmp_path / "out"), ["id"])
    writer.abort([None])
    with pytest.raises(OSError):
        writer.write(iter([(1,)]))
    assert list(tmp_path.iterdir()) == []


# ---- pruned search ---------------------------------------------------------
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_pruned_search_equals_the_full_scan(spark, tmp_path, metric):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 6)) * 10
    v = np.concatenate([centres[i % 20] + rng.normal(size=6) * 0.05 for i in range(400)] + [centres[0]] * 150 + [np.zeros(6)]).reshape(-1, 6)  # a third are copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = index.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pivots.lay_out(index, str(tmp_path / "ix"), 12, metric)
    read: list = []
    got = pivots.top_k(spark, str(tmp_path / "ix"), asked, 4, metric, read=read)
    want = retrieval.top_k(index, asked, 4, metric)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want) and read[0][0] < 0.6 * read[0][1]
    # fewer vectors than asked for
    assert pivots.top_k(spark, str(tmp_path / "ix"), asked.limit(1), 1000, metric).count() == 551
    pivots.lay_out(index.limit(0), str(tmp_path / "none"), 4, metric)
    assert pivots.top_k(spark, str(tmp_path / "none"), asked, 3, metric).count() == 0


# ---- uploads as they come --------------------------------------------------
def test_each_content_once(spark, tmp_path):
    from lodestone.sources import uploads

    (tmp_path / "in").mkdir()

    def put(name, data):
        (tmp_path / "in" / name).write_bytes(data)

    def run():
        out = uploads.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), limit=50)
        return sorted((r.name, r.reject_reason, r.text if not (r.text or "").startswith("Error") else "Error") for r in out.collect())

    put("a.txt", "één\n".encode())
    put("b.json", b'{"k": 1}')
    put("long.txt", b"x" * 51)
    first = [("a.txt", None, "één\n"), ("b.json", None, '{\n  "k": 1\n}'), ("long.txt", "too_large", None)]
    assert run() == first
    put("copy.txt", "één\n".encode())
    put("bad.txt", b"\xff\xfe")
    put("x.zip", b"zip")
    later = sorted([*first, ("bad.txt", None, "Error"), ("x.zip", "unsupported_type", None)])
    assert run() == later
    assert run() == later  # nothing new


def test_packed_files_are_taken_as_files(spark, tmp_path):
    from lodestone.sources import uploads

    def run(*files):
        uploads.pack(spark.createDataFrame(list(files), "path string, content binary"), f"{tmp_path}/in")
        out = uploads.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", limit=50, packed=True)
        return sorted((r.name, r.size, r.reject_reason, r.text if not (r.text or "").startswith("Error") else "Error") for r in out.collect())

    first = [("a.txt", 5, None, "één"), ("long.txt", 51, "too_large", None)]
    assert run(("in/a.txt", "één".encode()), ("in/long.txt", b"x" * 51)) == first
    assert run(("in/copy.txt", "één".encode()), ("in/bad.txt", b"\xff\xfe"), ("in/none.txt", b"")) == sorted([*first, ("bad.txt", 2, None, "Error"), ("none.txt", 0, None, "")])
    assert len(list((tmp_path / "in").glob("*.parquet"))) < 9  # a stream lists packs, not files


# ---- embedders and variants ------------------------------------------------
def test_an_embedder_loads_once_a_task(spark, tmp_path):
    from lodestone.plans import jobs

    folder = str(tmp_path)

    def load():
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).touch()

        def model(text):
            if text == "bad":
                raise ValueError("no")
            return [len(text)]

        return model

    rows = spark.range(0, 1000, 1, 2).select("id", F.when(F.col("id") == 7, "bad").when(F.col("id") == 8, None).otherwise(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.id: r.v for r in rows.select("id", jobs.loading_embedder(load)(F.col("text")).alias("v")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(list(Path(folder).iterdir())) == 2  # ten batches a task
    assert got[7] is None and got[8] is None and got[9] == [9.0] and len(got) == 1000


def test_variants(spark):
    from lodestone.functions import variants

    rows = spark.createDataFrame([(1, '{"k": 5, "a": [1, {"z": "y"}]}'), (2, '{"k": "five"}'), (3, "{broken"), (4, None), (5, "null"), (6, "[]")], "id long, text string")
    v = rows.withColumn("v", variants.parse(F.col("text")))
    got = {r.id: tuple(r)[1:] for r in v.select("id", F.col("v").isNotNull(), variants.read(F.col("v"), "$.k", "int"), variants.read(F.col("v"), "$.a[1].z", "string"), variants.shape(F.col("v"))).collect()}
    assert got[1] == (True, 5, "y", "OBJECT<a: ARRAY<VARIANT>, k: BIGINT>") and got[2] == (True, None, None, "OBJECT<k: STRING>")
    assert got[3] == got[4] == (False, None, None, None) and got[6][0] and got[6][1] is None
