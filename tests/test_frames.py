"""Placeholders across frames, held calls and JSON bodies on small tables."""

import codecs
import hashlib
import json
import random

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tracelake.operators import frames, text_streams
from tracelake.plans import frames as streams_of_frames
from tracelake.plans import streams

TOKEN = "__PII_1_0123abcd__"


def test_restore_frames_at_every_cut(spark):
    text = f"a_{TOKEN}b__PII_2_ffffffff__{TOKEN}{TOKEN}__PII_x_ __"
    want = text.replace(TOKEN, "Ann")
    rows = [(k, i, part) for k in range(1, len(text)) for i, part in enumerate([text[:k], "", text[k:]])]
    rows += [(1_000, i, c) for i, c in enumerate(text)] + [(1_001, 0, None)]
    cut = spark.createDataFrame(rows, "stream long, seq long, delta string")
    known = cut.select("stream").distinct().withColumn("placeholders", F.create_map(F.lit(TOKEN), F.lit("Ann")))
    found = {}
    for r in sorted(frames.restore_frames(cut, known).collect(), key=lambda r: (r.stream, r.seq is None, r.seq)):
        found[r.stream] = found.get(r.stream, "") + r.text
    assert found.pop(1_001) == "" and set(found.values()) == {want} and len(found) == len(text)
    assert frames.restore_frames(cut.limit(0), known).count() == 0


def test_held_calls(spark):
    CALLS = [
        (1, 0, 1, "bash", "rm -"), (1, 0, 3, None, "build"), (1, 0, 2, None, "rf "), (1, 0, 2, None, "rf "), (1, 1, 4, "bash", "ls"), (2, 0, 1, None, '{"a"'), (2, 0, 2, "read", ":1}"),
    ]

    found = {(r.stream, r["index"]): r for r in frames.held_calls(spark.createDataFrame(CALLS, "stream long, index long, seq long, name string, args string")).collect()}
    assert found[1, 0].args == "rm -rf build" and found[1, 0].verdict == "block" and found[1, 0].released_at is None
    assert found[1, 1].verdict == "allow" and found[1, 1].released_at == 4
    assert found[2, 0].name == "read" and json.loads(found[2, 0].args) == {"a": 1}


def test_restore_json_escapes_and_keeps_colliding_keys(spark):
    inner = json.dumps({"x": TOKEN})
    body = json.dumps({TOKEN: [TOKEN, 1, None], 'a"b': 2, "s": inner})
    rows = spark.createDataFrame([(1, body), (2, f"plain {TOKEN}"), (3, None), (4, "{" + TOKEN)], "id long, body string")
    known = F.create_map(F.lit(TOKEN), F.lit('a"b'))
    found = {r.id: r.b for r in rows.select("id", frames.restore_json(F.col("body"), known).alias("b")).collect()}
    value = json.loads(found[1])
    assert value[TOKEN] == ['a"b', 1, None] and value['a"b'] == 2 and json.loads(value["s"]) == {"x": 'a"b'}
    assert found[2] == 'plain a"b' and found[3] is None and found[4] == '{a"b'


def test_restore_json_enters_bodies_of_any_size(spark):
    names = {f"__PII_{k}_0123abcd__": k for k in range(20_000)}
    body = json.dumps({"pad": "x" * (1 << 20), "t": TOKEN, "n": names, "s": json.dumps([TOKEN, "y" * (1 << 20)])})
    found = spark.createDataFrame([(body,)], "b string").select(frames.restore_json(F.col("b"), F.from_json(F.lit(json.dumps({t: f'a"{k}' for t, k in names.items()})), "map<string,string>")).alias("b")).first().b
    value = json.loads(found)
    assert value["t"] == 'a"1' and value["n"] == {f'a"{k}': k for k in range(20_000)} and json.loads(value["s"])[0] == 'a"1'


def test_concurrency_and_sessions(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 12), ("b", 1, 1)], "k string, s long, e long")
    assert {r.k: r.most for r in frames.most_concurrent(rows, "k", "s", "e").collect()} == {"a": 2, "b": 0}
    times = spark.createDataFrame([("a", 0), ("a", 10), ("a", 21), ("a", 21)], "k string, t long")
    assert [tuple(r) for r in frames.idle_sessions(times, "k", "t", 10).orderBy("session").collect()] == [("a", 1, 0, 10, 2), ("a", 2, 21, 21, 2)]


def test_restore_json_runs_on_slices_of_arrow_arrays(spark):
    """Bodies are not turned into Python strings by whole batches, as a pandas function does."""
    known = F.create_map(F.lit("__PII_1_0123abcd__"), F.lit('a"b'))
    body = F.when(F.col("id") % 3 > 0, '{"t":["__PII_1_0123abcd__"]}').when(F.col("id") % 2 == 0, "x __PII_1_0123abcd__")
    restored = spark.range(60).select("id", frames.restore_json(body, known).alias("b"))
    assert {r.id: r.b for r in restored.collect()} == {k: '{"t":["a\\"b"]}' if k % 3 else None if k % 2 else 'x a"b' for k in range(60)}
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\n" in restored._jdf.queryExecution().optimizedPlan().toString()


def test_stitched_chunks_equal_an_incremental_decoder(spark):
    """Cuts at every place, bytes that are no UTF-8, streams that end within a character, and nulls."""
    rng = random.Random(5)
    streams = {0: "aé東\U0001f600".encode(), 1: b"ab\xc3", 2: b"\xa9b", 3: b"\xe0\x80x\xf0\x9f\x98", 4: b"", 5: b"\xff\xc3\xa9"}
    streams |= {k: b"".join(rng.choice([b"a", "é".encode(), "東".encode(), "\U0001f600".encode(), b"\xff" if k % 3 == 0 else b"b"]) for _ in range(40)) for k in range(6, 60)}
    rows, want = [], {}
    for k, data in streams.items():
        at, seq, own = 0, 0, codecs.getincrementaldecoder("utf-8")("replace")
        while at < len(data):
            size = rng.randint(0, 5)
            rows.append((k, seq, bytearray(data[at : at + size]) if size or seq % 2 else None))
            want[k, seq] = own.decode(data[at : at + size])
            at, seq = at + size, seq + 1
        want[k, None] = own.decode(b"", True)
    found = text_streams.stitched(spark.createDataFrame(rows, "k long, seq int, c binary"), "k", "seq", "c")
    assert {(r.k, r.seq): r.text for r in found.collect()} == {at: t for at, t in want.items() if t}
    assert found.filter("false").count() == 0


def test_chunks_of_a_text_do_not_carry_the_text(spark, sf_dir):
    plan = streams._stitched(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(transform(" in next(line for line in plan.splitlines() if "Generate " in line)


def test_stitched_texts_keep_empty_ones(spark, monkeypatch):
    texts = {1: None, 2: "", 3: "a", 4: "1234567", 5: "abcdef\U0001f600", 6: "\u6771" * 50}
    monkeypatch.setattr(streams, "table", lambda s, d, name: spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(map(tuple, streams._stitched(spark, "").collect())) == [(k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in texts.items()]


def test_restore_frames_over_many_streams_and_batches(spark):
    """Frames of all sizes, marks everywhere, streams without a map or without frames, and a key that is null."""
    rng = random.Random(6)
    frame_rows, maps, want = [], [], {}
    for k in [*range(80), None]:
        text = "".join(rng.choice(["_", "__PII_", TOKEN, "a", "bc ", "__PII_2_89abcdef__"]) for _ in range(rng.randint(0, 40)))
        at = seq = 0
        while at < len(text):
            size = rng.randint(1, 9)
            frame_rows.append((k, seq, text[at : at + size]))
            at, seq = at + size, seq + 1
        known = {TOKEN: "é1"} if k is not None and k % 4 else None
        if k is not None:
            maps.append((k, known))
        if text:
            want[k] = text.replace(TOKEN, "é1") if known else text
    maps.append((1_000, {TOKEN: "x"}))
    cut = spark.createDataFrame(frame_rows, "stream long, seq int, delta string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = frames.restore_frames(cut, spark.createDataFrame(maps, "stream long, placeholders map<string,string>")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in sorted(found, key=lambda r: (r.seq is None, r.seq)):
        got[r.stream] = got.get(r.stream, "") + r.text
    assert got == want and len(found) == len(frame_rows) + len(want)


def test_the_round_trip_redacts_once(spark, sf_dir):
    plan = streams_of_frames._stitched(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "parquet" not in plan.lower()
