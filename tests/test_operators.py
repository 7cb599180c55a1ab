"""Golden cases and brute-force versions of single operators."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.functions.histogram import BOUNDS, p95, p95_saturated
from tracelake.functions.hmac import hmac_sha256
from tracelake.functions.text import strip_partial_tokens
from tracelake.functions.timewin import civil_day, parse_range, window_key
from tracelake.operators import audit, metrics, pii, secrets, traffic
from tracelake.plans.audit import CALLS, POLICY
from tracelake.streaming.rollup import exact_rollup, latest_batches, write_batches
from tracelake.streaming.sse import take_blocks


def brute_p95(buckets):
    total = sum(buckets)
    if not total:
        return 0
    rank, seen = math.ceil(total * 0.95), 0
    for i, c in enumerate(buckets):
        if c and seen + c >= rank:
            if i == len(BOUNDS):
                return BOUNDS[-1]
            low = (0, *BOUNDS)[i]
            return min(BOUNDS[i], low + (BOUNDS[i] - low) * (2 * (rank - seen) - 1) // (2 * c))
        seen += c


def test_p95(spark):
    rng = random.Random(5)
    cases = [[0] * 12, [0] * 11 + [3], [1] + [0] * 11] + [[rng.choice([0, 0, 1, 7, 300]) for _ in range(12)] for _ in range(80)]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(cases)], "i int, b array<bigint>").select("i", p95(F.col("b")).alias("p"), p95_saturated(F.col("b")).alias("s")).orderBy("i").collect()
    assert [r.p for r in got] == [brute_p95(b) for b in cases]
    assert got[1].s and not got[0].s


def test_windows_round_down(spark):
    rows = spark.createDataFrame([(-1,), (0,), (299,), (86_400,)], "t bigint")
    got = [tuple(r) for r in rows.select(window_key(F.col("t"), "m"), civil_day(F.col("t"))).collect()]
    assert got == [("m-1", "1969-12-31"), ("m0", "1970-01-01"), ("m0", "1970-01-01"), ("m288", "1970-01-02")]
    assert parse_range(" 24H ")[0] == "24h"
    with pytest.raises(ValueError):
        parse_range("2h")


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("héllo",)], "v string").select(hmac_sha256(key, F.col("v"))).first()[0]
        assert got == hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()


def test_strip_partials(spark):
    cases = {"see __PII_1_": "see ", "__PII_1_0a1b2c3d__": "__PII_1_0a1b2c3d__", "__PIXEL": "__PIXEL", "__CRED_000123__PI": "__CRED_000123__PI", "a __PI.": "a ."}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", strip_partial_tokens(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in got} == cases


def brute_hits(text):
    union = re.compile("(?P<protected>" + pii.PROTECTED + ")|" + "|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()))
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in union.finditer(text)]


def test_raw_hits_have_the_offsets_of_the_union_pattern(spark, sf_dir):
    texts = ["", "mail ann@example.org, card 4111111111111111.", "é ü 8.8.8.8 13800138000 ", "__PII_1_0a1b2c3d__ sk-abcdefghijklmnopqrst 2001:4860::8888"]
    texts += [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(150).collect() if r[0]]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pii.raw_hits(F.col("t")).alias("h")).orderBy("i").collect()
    assert [[tuple(h) for h in r.h] for r in got] == [brute_hits(t.replace("", "�")) for t in texts]


def test_an_address_before_a_full_stop(spark):
    texts = ["mail ann@mail7.example.</title>", "ann@example.org. Bob", "ann@example.org.", "ann@example.org.2", "ann@example.org-", "ann@example.org_", "ann@example.org.."]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.raw_hits(F.col("t")).alias("h")).orderBy("i").collect()
    assert [[h.value for h in r.h] for r in got] == [["ann@mail7.example"], ["ann@example.org"], ["ann@example.org"], [], [], [], []]


def test_an_address_that_is_cut_after_a_letter(spark):
    texts = ["mail ann@mail7.example.c</h1>", "ann@mail7.example.c", "ann@example.org.A Bob", "ann@example.org.c1", "ann@example.org.c-", "ann@mail7.example.co", "ann@mail7.e"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.raw_hits(F.col("t")).alias("h")).orderBy("i").collect()
    assert [[h.value for h in r.h] for r in got] == [["ann@mail7.example"], ["ann@mail7.example"], ["ann@example.org"], [], [], ["ann@mail7.example.co"], []]


def test_redact_restores(spark):
    rows = [(1, "a@b.io and a@b.io, 8.8.8.8"), (2, None), (3, ""), (4, "nothing")]
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), b"s").withColumn("back", pii.restore(F.col("redacted"), F.col("placeholders"))).collect()}
    assert "a@b.io" not in got[1].redacted and got[1].back == rows[0][1]
    assert (got[1].n_new, got[1].n_seen) == (2, 1)
    assert got[4].redacted == "nothing" and got[3].redacted == ""


def test_arbitration(spark):
    hits = [[("a", "x", 5, 9), ("b", "y", 0, 6), ("c", "z", 0, 3), ("d", "w", 6, 7)], []]
    got = spark.createDataFrame([(h,) for h in hits], f"h {f"array<{pii.ONE_HIT}>"}").select(pii.arbitrate(F.col("h")).alias("k")).collect()
    assert [[x.kind for x in r.k] for r in got] == [["b", "d"], []]


def test_danger(spark):
    got = spark.createDataFrame(CALLS, "tool string, args string").withColumn("r", audit.danger_reason(F.col("tool"), F.col("args"), POLICY)).collect()
    safe = {r.args for r in got if r.r is None}
    assert safe == {"ls -la /tmp", "rm build", "add user", "curl http://svc.internal/x", "/etc/passwd", "./shutdown.sh", None}


def test_min_gap(spark):
    rng = random.Random(3)
    hits = [(rng.randint(1, 4), rng.randint(0, 400)) for _ in range(300)]
    want = {}
    for k in {k for k, _ in hits}:
        last, n = None, 0
        for t in sorted(t for key, t in hits if key == k):
            if last is None or t - last >= 7:
                last, n = t, n + 1
        want[k] = n
    got = metrics.min_gap_admit(spark.createDataFrame(hits, "k long, t long"), "k", "t", 7).collect()
    assert {r.k: r.admitted for r in got} == want


def test_page_guards():
    for bad in ({"offset": 10_001}, {"status": "3xx"}, {"session_prefix": "abc"}, {"session_scope": "x"}):
        with pytest.raises(ValueError):
            metrics.RequestFilter(**bad)


SAMPLES = "id long, ts_secs long, protocol string, latency_ms long, prompt_tokens long, completion_tokens long, total_tokens long, cached_read long, cached_write long, truncated_mode string"


def test_stream_rollup_equals_batch(spark, tmp_path):
    rows = [(i, i * 100, "chat", i % 900, 1, 2, 3, 0, 0, None) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], SAMPLES).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_batches(exact_rollup(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    keys = ["granularity", "window_ord", "protocol"]
    got = latest_batches(spark.read.parquet(str(tmp_path / "out")), keys).select(*keys, "requests", "buckets")
    want = metrics.rollup(spark.createDataFrame(rows, SAMPLES)).select(*keys, "requests", "buckets")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sse_blocks_equal_batch(spark):
    text = "﻿data: a\r\n\r\n: note\n\nevent: e\ndata: b\ndata: c\n\ndata: d\r\r"
    chunks = [("s", i, text[i * 5 : i * 5 + 5]) for i in range(len(text) // 5 + 1)]
    frame = spark.createDataFrame(chunks, "stream_id string, seq long, chunk string")
    want = [(r.event, r.data) for r in traffic.sse_events(frame, "stream_id", "seq", "chunk").orderBy("pos").collect()]
    assert want == [(None, "a"), ("e", "b\nc"), (None, "d")]
    held, seen = "", []
    for _, _, c in chunks:
        blocks, held = take_blocks(held, c)
        seen += blocks
    assert seen + take_blocks(held, "\n")[0] == want


def test_paths_and_command_lines_in_one_form(spark):
    from tracelake.functions import shell

    paths = {"/../a": "/a", "a/../..": "..", "a/b/./../c//d/": "a/c/d", "/": "/", "": ".", "../../x": "../../x", "a/..": ".", "../a/../../b": "../../b"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", shell.plain_path(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in got} == paths
    lines = {
        r"\x72m -rf b": "rm -rf b", r"café \ud83d \q \\n": r"café \ud83d \q \n", "X=rm; $X ${X} $Y ${Y": "X=rm; rm rm $Y ${Y", "A=1; A=2; $A": "A=1; A=2; 2", "l /tmp": "ls /tmp", "ll": "ls -l", "lla": "lla",
        "/bin/ls x;/bin/rm y": "ls x;rm y", "find . -name x --delete; ls": "rm -rf . -name x; ls", "find . ; find /t -delete": "find . ; rm -rf /t", "cat /a/../b": "cat /b",
    }
    got = spark.createDataFrame([(p,) for p in lines], "p string").select("p", shell.canonical(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in got} == lines
    got = spark.createDataFrame([("a; b && c || d | e & f 'x;y' \"p|\\\"q\"; ",)], "p string").select(shell.chain(F.col("p")).alias("q")).first().q
    assert got == ["a", "b", "c", "d", "e & f 'x;y' \"p|\\\"q\""]


def test_danger_rules_see_through_disguise(spark):
    calls = [("bash", "X=rm; $X -rf build"), ("bash", r"\x72m -rf build"), ("bash", "echo hi > /tmp/../etc/motd"), ("write", '{"path": "/tmp/../etc/passwd"}'), ("bash", "echo fine"), ("bash", "ls /etc")]
    got = spark.createDataFrame(calls, "t string, a string").select(audit.danger_reason(F.col("t"), F.col("a")).isNotNull().alias("bad")).collect()
    assert [r.bad for r in got] == [True] * 4 + [False] * 2


@pytest.mark.parametrize("kind", ["plain", "quoted", "tail", "separators", "flags", "hosts", "ups", "colons"])
def test_danger_rules_on_a_mebibyte(spark, kind):
    text = {
        "plain": "echo " + "word " * 210_000, "quoted": "echo '" + "ab c;" * 210_000 + "'", "tail": "echo '" + "ab c;" * 210_000 + "'; rm -rf /tmp/x", "separators": ";" * (1 << 20), "flags": "rm" + " -a" * 350_000,
        "hosts": "echo " + "a." * 500_000, "ups": "/.." * 350_000, "colons": "echo " + ":" * (1 << 20),
    }[kind]
    began = __import__("time").time()
    reason = spark.createDataFrame([("bash", text)], "t string, a string").select(audit.danger_reason(F.col("t"), F.col("a")).alias("r")).first().r
    assert (reason is not None) == (kind == "tail") and __import__("time").time() - began < 60


@pytest.mark.parametrize("text", [":" * (1 << 20), "1" * (1 << 20), "1." * (1 << 19), "a@" * (1 << 19), "ann@example.org 8.8.8.8 " * 20_000, "%41" * 300_000])
def test_recogniser_on_long_texts(spark, text):
    began = __import__("time").time()
    row = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").select("redacted", "placeholders", "n_new", "n_seen").first()
    assert __import__("time").time() - began < 60
    if text.startswith("ann"):
        assert (row.n_new, row.n_seen) == (2, 39_998)
        back = spark.createDataFrame([(row.redacted, row.placeholders)], "t string, m map<string,string>").select(pii.restore(F.col("t"), F.col("m")).alias("b")).first().b
        assert back == text
    elif not text.startswith("1."):
        assert row.redacted == text


def test_custom_rules_and_names(spark):
    rows = spark.createDataFrame([(1, "order A-12 for Ann Lee and Annabel; code A-12x 张三说 X张三"), (2, None), (3, "")], "id long, text string")
    rules = [("order", r"A-\d+"), ("again", r"A-\d+"), ("empty", "x*")]
    names = [("Ann", "name"), ("Ann Lee", "name"), ("张三", "name"), ("code", "term"), ("A", "term")]
    found = pii.with_hits(rows, rules=rules, names=names).select("id", F.explode("pii_hits").alias("h")).select("id", "h.*").collect()
    # A name may be followed by letters but not by other writing; other types stand alone.
    want = {("order", "A-12", 6), ("order", "A-12", 41), ("name", "Ann Lee", 15), ("name", "Ann", 27), ("term", "code", 36), ("term", "A", 6), ("term", "A", 41), ("empty", "x", 45)}
    assert {(r.kind, r.value, r.start) for r in found} == want
    assert all(rows.first().text[r.start : r.end] == r.value for r in found)
    redacted = pii.redact(rows, b"k", "id", rules=rules, names=names).filter("id = 1").first().redacted
    assert "Ann" not in redacted and "A-12" not in redacted and "张三说" in redacted
    assert pii.with_hits(rows, names=names, strict=False).count() == 3


def test_names_pattern_has_no_limit(spark):
    from tracelake.functions.lookup import names_pattern

    names = [f"name{i}" for i in range(30_000)]
    assert re.findall(names_pattern(names), "name7 name29999x name30000") == ["name7", "name29999", "name3000"]


def test_tool_calls_of_all_shapes(spark):
    import json

    from tracelake.operators.toolcalls import tool_calls

    cases = [
        ({"choices": [{"message": {"content": "x"}}, {"index": 1, "message": {"tool_calls": [{"id": "c", "function": {"name": "bash", "arguments": {"a": 1}}}, {"function": {"name": "b"}}]}}]}, [(65536, "c", "bash", '{"a":1}', False), (65537, "call_stable_65537", "b", "", True)]),
        ({"choices": [{"delta": {"function_call": {"name": "old", "arguments": "{}"}, "custom_tool_call": [{"call_id": "q", "tool_name": "t", "input": "i"}, {}]}}]}, [(0, "call_stable_0", "old", "{}", True), (0, "q", "t", "i", False)]),
        ({"type": "content_block_start", "index": 2, "content_block": {"type": "tool_use", "id": "t1", "name": "bash", "input": {}}}, [(2, "t1", "bash", "", False)]),
        ({"type": "content_block_delta", "index": 2, "delta": {"type": "input_json_delta", "partial_json": '{"a"'}}, [(2, "call_stable_2", None, '{"a"', True)]),
        ({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "hello"}}, []),
        ({"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "t1", "name": "bash", "input": {"cmd": "rm -rf /"}}]}, [(1, "t1", "bash", '{"cmd":"rm -rf /"}', False)]),
        ({"type": "response.function_call_arguments.done", "item_id": "i1", "output_index": 3, "arguments": "{}", "name": "f"}, [(3, "i1", "f", "{}", False)]),
        ({"type": "response.shell_call_command.done", "output_index": 1, "command": "ls"}, [(1, "call_stable_1", "shell", "ls", True)]),
        ({"type": "response.web_search_call.completed", "item_id": "w", "action": {"query": "q"}}, [(0, "w", "web_search", "q", False)]),
        ({"type": "response.output_item.added", "output_index": 4, "item": {"type": "file_search_call", "id": "k"}}, [(4, "k", "file_search", "", False)]),
        ({"output": [{"type": "message", "content": []}, {"type": "function_call", "call_id": "k", "name": "web", "arguments": "{}"}]}, [(1, "k", "web", "{}", False)]),
        ({}, []),
    ]
    frame = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(cases)] + [(98, "no json"), (99, None)], "i int, b string")
    got = {r.i: r.c and [tuple(c) for c in r.c] for r in frame.select("i", tool_calls(F.col("b")).alias("c")).collect()}
    assert got == {**{i: want for i, (_, want) in enumerate(cases)}, 98: [], 99: None}


def test_redacted_json_searches_equal_strings_once_and_each_by_itself(spark, monkeypatch):
    card = "4111111111111111"
    inner = json.dumps({"t": f"pay {card}", "u": "see /a?id=1234567890123"})
    body = {"a": "see /a?id=1234567890123", "b": f"pay {card}", "c": ["ann@example.org"] * 40, "d": inner, "e": "", "f": "plain\x00 end"}
    searched, search = [], pii.with_hits
    monkeypatch.setattr(secrets, "with_hits", lambda rows, text, **own: searched.append(rows.agg(F.max(F.length(text))).first()[0]) or search(rows, text, **own), raising=False)
    frame = spark.createDataFrame([(1, json.dumps(body)), (2, None), (3, '{"a": "b"}')], "doc_id long, body string")
    got = {r.doc_id: r for r in secrets.redact_json(frame, b"salt", "doc_id").collect()}
    made = json.loads(got[1].redacted)
    tokens = {value: token for token, value in got[1].placeholders.items()}
    assert set(tokens) == {card, "ann@example.org"} and made["b"] == f"pay {tokens[card]}" and made["c"] == [tokens["ann@example.org"]] * 40
    assert json.loads(made["d"]) == {"t": f"pay {tokens[card]}", "u": "see /a?id=1234567890123"} and made["f"] == "plain\ufffd end"
    assert (got[1].n_new, got[1].n_seen) == (2, 40) and got[2].redacted is None and got[3].redacted == '{"a": "b"}'
    assert searched and searched[0] < 600


def test_redacted_json_of_a_large_body_is_searched_by_its_strings(spark):
    card = "4111111111111111"
    body = json.dumps({"pad": "x " * (1 << 19), "n": int(card), "s": "to\nann@example.org", "c": card})
    frame = spark.createDataFrame([(1, body)], "doc_id long, body string")
    got = secrets.redact_json(frame, b"salt", "doc_id").drop("body").first()
    tokens = {value: token for token, value in got.placeholders.items()}
    assert json.loads(got.redacted) == json.loads(body) | {"s": "to\n" + tokens["ann@example.org"], "c": tokens[card]}
