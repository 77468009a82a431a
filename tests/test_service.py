"""The message service as a stream, effects that happen once, and bounded model calls."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.operators import index
from quillspark.plans import phases
from quillspark.sources import readers
from quillspark.streaming import service, sinks


def event(i, text, user="u1", kind="text"):
    return json.dumps({"header": {"event_type": "im.message.receive_v1"}, "event": {"message": {"message_type": kind, "message_id": i, "content": json.dumps({"text": text})}, "sender": {"sender_id": {"open_id": user}}}})


def add(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(lines) + "\n")
    os.rename(folder / f".{name}", folder / name)


def drive(spark, tmp_path, stores, answer):
    query = service.run(service.payloads(spark, str(tmp_path / "in")), stores, answer, str(tmp_path / "cp"))
    query.awaitTermination()


def replies(spark, stores):
    return sorted((r["message_id"], r["reply"]) for r in sinks.read_log(spark, stores.replies, service.REPLY).collect())


def test_each_message_has_one_reply_after_a_failed_batch_and_a_restart(spark, tmp_path):
    stores = service.Stores(*(str(tmp_path / n) for n in ("replies", "turns", "edges")))
    seen = []

    def answer(rows):
        seen.append(1)
        return rows.withColumn("answer", F.concat(F.lit(f"{len(seen)}:"), "text"))

    add(tmp_path / "in", "1", event("m1", "hello"), event("m1", "hello"), event("m2", "@_user_1 what"), event("m3", "x", kind="image"), "broken", event("", "no id"))
    real = service.Stores.tables

    def failing(self, spark):
        if len(seen) == 1:
            raise RuntimeError("store is down")  # after the replies were sent
        return real(self, spark)

    service.Stores.tables = failing
    try:
        with pytest.raises(Exception, match="store is down"):
            drive(spark, tmp_path, stores, answer)
    finally:
        service.Stores.tables = real
    assert len(replies(spark, stores)) == 3  # sent, though the batch was not done
    drive(spark, tmp_path, stores, answer)  # the batch is tried again
    assert replies(spark, stores) == [("", "2:no id"), ("m1", "2:hello"), ("m2", "2:what")]
    turns, _ = stores.tables(spark)
    assert {r["message_id"]: r["answer"] for r in turns.read(spark).collect()} == {"m1": "2:hello", "m2": "2:what"}
    drive(spark, tmp_path, stores, answer)  # nothing new
    add(tmp_path / "in", "2", event("m1", "hello"), event("m4", "删除记忆：2"), event("m5", "清空记忆"))
    drive(spark, tmp_path, stores, answer)
    assert [m for m, _ in replies(spark, stores)] == ["", "m1", "m2", "m4", "m5"]
    assert dict(replies(spark, stores))["m4"] == service.CLEARED["2"] and dict(replies(spark, stores))["m5"] == service.HELP
    assert turns.read(spark).count() == 0
    log = str(tmp_path / "log")
    for _ in range(2):
        service.evaluate(spark, stores, log, str(tmp_path / "cp2")).awaitTermination()
    schema = "id string, at timestamp, query string, answer string, faithfulness double, context_precision double"
    assert sinks.read_log(spark, log, schema).count() == 0  # their turns are forgotten


def test_a_batch_is_appended_once_and_half_written_ones_are_not_seen(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.createDataFrame([(1,), (2,)], "x int")
    for _ in range(2):
        sinks.append_once(rows, path, "w", 0)
    sinks.append_once(rows, path, "w", 1)
    sinks.append_once(rows, path, "v", 0)
    os.remove(tmp_path / "log" / "writer=w" / "batch=1" / "_SUCCESS")
    got = sinks.read_log(spark, path, "x int").collect()
    assert sorted((r["writer"], r["batch"], r["x"]) for r in got) == [("v", 0, 1), ("v", 0, 2), ("w", 0, 1), ("w", 0, 2)]
    assert sinks.read_log(spark, str(tmp_path / "none"), "x int").count() == 0


def test_bounded_calls_overlap_up_to_the_bound_in_order():
    now, most, lock, tried = [0], [0], threading.Lock(), []

    def call(task, payload):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tried.append(payload)
        time.sleep(0.4 if payload == "slow" else 0.03)
        with lock:
            now[0] -= 1
        if payload == "bad":
            raise RuntimeError("down")
        return payload.upper()

    sent = [f"p{i}" for i in range(20)] + ["bad", "slow"]
    out = models.bounded(call, in_flight=4, seconds=0.2)("t", sent)
    assert out[:20] == [f"P{i}" for i in range(20)] and 1 < most[0] <= 4
    assert isinstance(out[20], RuntimeError) and tried.count("bad") == 2 and isinstance(out[21], models.Busy)
    assert models.bounded(call)("t", []) == []
    assert [s for _, s in models._answers("t", ["a", "bad"], models.bounded(call))] == ["ok", "error"]


def test_tasks_go_to_their_tiers():
    tiers = {"small": models.Tier("s"), "large": models.Tier("l", (("thinking", True),))}
    model = models.tiered(lambda tier, task, payload: f"{tier.name}{dict(tier.options).get('thinking', '')}", tiers)
    assert (model("route", ["x"]), model("community", ["x"]), model("other", ["x"])) == (["s"], ["lTrue"], ["s"])


def test_lazy_models_are_made_once():
    made = []
    model = models.lazy("test", lambda: made.append(1) or (lambda task, payloads: payloads))
    assert model("t", ["a"]) == ["a"] and model("t", ["b"]) == ["b"] and made == [1]


def test_bounded_models_in_tasks(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "i int, p string")
    model = models.bounded(lambda task, payload: payload[::-1] if payload != "p7" else 1 / 0, 3)
    got = {r["i"]: tuple(r["x"]) for r in rows.select("i", models.complete("t", F.col("p"), model).alias("x")).collect()}
    assert got[7] == (None, "error") and got[12] == ("21p", "ok")


def test_files_with_equal_headings_have_their_own_context(spark, tmp_path):
    files = spark.createDataFrame([("a", "第一章 甲\nAnna。\n"), ("b", "第一章 甲\nBert。\n")], "path string, text string")
    asked = phases.ingest_files(spark, files, str(tmp_path / "chunks"), lambda task, payloads: [json.loads(p)["document"] for p in payloads])
    assert {r["original_text"]: r["context_prefix"] for r in asked.collect()} == {"Anna。": "Anna。", "Bert。": "Bert。"}


def test_failed_extractions_are_counted(spark, tmp_path):
    def model(task, payloads):
        if any("Bert" in p for p in payloads):
            raise RuntimeError("down")
        return models.rules(task, payloads)

    rows = [(f"c{i}", "", "", "", 0, t, t, "") for i, t in enumerate(["Anna met Carl", "Bert", "Dora Bert", "Emil saw Fred"])]
    spark.createDataFrame(rows, readers.CHUNK).write.json(str(tmp_path / "chunks"))
    r = phases.build_graph(spark, str(tmp_path / "chunks"), str(tmp_path / "edges"), model=model).first()
    assert (r["succeeded"], r["failed"], r["nodes"], r["edges"], r["failures"]) == (2, 2, 4, 2, ["c1", "c2"])
    assert index.at(spark, str(tmp_path / "no")).n == 0
