"""The stateful event-stream parser as a running query."""

import json
import os
import random
import re
import time

from pyspark.sql import functions as F

from tracelake.operators.metrics import rollup
from tracelake.operators.traffic import sse_events
from tracelake.sources.driver_tables import samples
from tracelake.streaming import rollup as stored
from tracelake.streaming.sse import BLOCK_LIMIT, MARKED, Parser, sse_frames

SCHEMA = "stream_id string, seq long, chunk string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_running_parser_agrees_with_the_batch_form(spark, tmp_path):
    text = {"a": 'event: start\r\ndata: {"x":1}\r\n\r\n: note\n\ndata: one\ndata: two\n\ndata: [DONE]\n\n', "b": "data: é\r\rdata: y\n\n"}
    rows = [(k, i, t[i * 5 : i * 5 + 5]) for k, t in text.items() for i in range(-(-len(t) // 5))]
    # Two files are two batches: blocks stay open from one to the next.
    for part in (0, 1):
        (tmp_path / "in").mkdir(exist_ok=True)
        with open(tmp_path / "in" / f"{part}.json", "w") as f:
            f.writelines(json.dumps({"stream_id": s, "seq": q, "chunk": c}) + "\n" for s, q, c in rows if (q >= 6) == bool(part))
        os.utime(tmp_path / "in" / f"{part}.json", (1_700_000_000 + part * 60,) * 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts alone would run it for ever
    try:
        chunks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = sse_frames(chunks).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("stream_id", "event", "data").collect() if r.data]
    batch = sse_events(spark.createDataFrame(rows, SCHEMA), "stream_id", "seq", "chunk").filter(F.col("data") != "")
    assert len(found) == 5
    assert sorted((a, b or "", c) for a, b, c in found) == sorted((r.stream_id, r.event or "", r.data) for r in batch.collect())


def whole(text):
    """Events of a whole text by plain rules."""
    out, own, last, retry = [], [], None, None
    for line in re.split(r"\r\n|\r|\n", text.removeprefix("\ufeff"))[:-1]:
        if line:
            own.append(line)
            continue
        fields = [(n, v[1:] if v[:1] == " " else v) for n, _, v in (x.partition(":") for x in own)]
        data, events = [v for n, v in fields if n == "data"], [v for n, v in fields if n == "event"]
        last = next((v for n, v in reversed(fields) if n == "id"), last)
        retry = next((int(v) for n, v in reversed(fields) if n == "retry" and v.isdigit()), retry)
        if data or events:
            out.append((len(out), events[-1] if events else None, "\n".join(data), last, retry, False, False))
        own = []
    return out


def test_parser_at_random_cuts():
    rng = random.Random(6)
    parts = ["data: x\r\n", "data:  y\n", "data\r", "event: e\n", "id: 7\r\n", "id\n", "retry: 50\n", "retry: no\n", ": c\n", "\r\n", "\n", "\r", "\n\n", "data: é\n\n", "odd\n"]
    for k in range(400):
        text = ("\ufeff" if k % 3 == 0 else "") + "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        p, out, at = Parser(), [], 0
        while at < len(text):
            step = rng.randint(1, 4)
            out += p.push(text[at : at + step])
            p, at = Parser(p.scalars(), list(p.lines), list(p.tail)), at + step
        assert out == whole(text), repr(text)


def test_parser_limits_and_linear_time():
    p = Parser()
    assert [e[5] for e in p.push("data: " + "x" * (MARKED - 6) + "\n\n")] == [False] and [e[5] for e in p.push("data: " + "x" * (MARKED - 5) + "\n\n")] == [True]
    p, began = Parser(), time.time()
    for _ in range(BLOCK_LIMIT // 5):
        assert not p.push("abcde")
    assert time.time() - began < 20 and not p.failed
    assert p.push("abcdef\n\n")[-1][-1] and p.push("data: x\n\n") == []


def test_idle_streams_drop_the_open_block_only(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put(("a", 0, "id: 9\nretry: 40\ndata: one\n\ndata: lost"), ("b", 0, "data: kept\n"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = sse_frames(stream, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not (query.recentProgress and any(p["numInputRows"] for p in query.recentProgress)):
            time.sleep(1)
        time.sleep(12)
        put(("a", 1, " gone\n\ndata: two\n\n"))
        got = []
        while time.time() < deadline and len(got) < 2:
            time.sleep(2)
            got = spark.read.schema(sse_frames(stream).schema).parquet(str(tmp_path / "out")).orderBy("stream_id", "pos").collect()
    finally:
        query.stop()
    assert [(r.stream_id, r.pos, r.data, r.id, r.retry) for r in got] == [("a", 0, "one", "9", 40), ("a", 1, "two", "9", 40)]


def test_rollup_restarts_without_counting_twice(spark, sf_dir, tmp_path):
    """A batch that ran but was not committed runs again; late rows count; a base stands for its batches."""
    rows = samples(spark, sf_dir)
    source, path, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    parts = rows.repartitionByRange(3, F.hash("id"))
    for k in range(3):
        parts.filter(F.spark_partition_id() == k).coalesce(1).write.mode("append").parquet(source)
    run = lambda: stored.write_partials(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), path, ck).awaitTermination()
    run()
    want = sorted(map(str, rollup(rows).select("granularity", "window_ord", "protocol", "requests", "total_tokens", "buckets").collect()))
    got = lambda: sorted(map(str, stored.stored_rollups(spark, path).select("granularity", "window_ord", "protocol", "requests", "total_tokens", "buckets").collect()))
    assert got() == want
    os.remove(f"{ck}/commits/2")  # killed between write and commit
    if os.path.exists(f"{ck}/commits/.2.crc"):
        os.remove(f"{ck}/commits/.2.crc")
    run()
    assert got() == want
    stored.compact(spark, path, 1)
    assert got() == want
    stored.compact(spark, path, 1)
    stored.compact(spark, path, 2)
    assert got() == want


def test_scopes_of_a_stream_are_the_sessions_of_the_batch(spark, sf_dir, tmp_path):
    from tracelake.operators.frames import idle_sessions
    from tracelake.sources.driver_tables import requests
    from tracelake.streaming.scopes import conversation_scopes

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = requests(spark, sf_dir).filter("session_id is not null").select(F.col("session_id").alias("key"), F.col("ts_secs").alias("ts"), "id")
    edge = rows.approxQuantile("ts", [0.5], 0.01)[0]
    source = str(tmp_path / "in")
    for part in (rows.filter(F.col("ts") < edge), rows.filter(F.col("ts") >= edge)):
        part.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # kept state alone would run it for ever
    try:
        query = conversation_scopes(stream, 86_400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("key", "scope").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("requests"))
    want = idle_sessions(rows, "key", "ts", 86_400)
    plain = lambda f: sorted(tuple(r) for r in f.select("key", "first_ts", "last_ts", "requests").collect())
    assert plain(got) == plain(want) and len(plain(want)) > 3
