"""The span index of JSON texts, and edits on it."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.functions import jsonspan as js


def built(text):
    """The value that the index stands for."""
    found = js.index(text)
    if found is None:
        return None

    def value(i):
        n = found.nodes[i]
        if n.kind == "object":
            return {found.nodes[c].key: value(c) for c in found.below[i]}
        return [value(c) for c in found.below[i]] if n.kind == "array" else json.loads(text[n.start : n.end])

    return [value(0)]


def made(rng, depth=4):
    kind = rng.choice("oas ntdb") if depth else rng.choice("sntd")
    if kind == "o":
        return {rng.choice(["a", "b", 'q"', "é\n", "type", "index", "x/y"]): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if kind == "a":
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([0, -1.5, 1e30, None, True, "", "a\"b\\c", " é\U0001f600", "{\"k\": [1]}", "}{", "__PII_1_0a1b2c3d__"])


def test_index_agrees_with_a_parser():
    rng = random.Random(1)
    for _ in range(600):
        v = made(rng)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert built(text) == [v] and built("﻿" + text + " \n") == [v]
        broken = list(text)
        broken[rng.randrange(len(broken))] = rng.choice('{}[],:"0x\\')
        broken = "".join(broken)
        try:
            want = [json.loads(broken, parse_constant=lambda c: 1 / 0)]
        except (ValueError, ZeroDivisionError):
            want = None
        assert built(broken) == want, broken
    for text in ("", " ", "{", "[1,]", "{,}", '{"a"}', '{"a":}', "1 2", "01", "[1 2]", '{"a":1,}', "nul", '"\x01"', "[" * 5):
        assert js.index(text) is None
    assert len(js.index("[" * 100_000 + "]" * 100_000).nodes) == 100_000


def test_usage_option_sees_the_top_level_only():
    one = js.usage_option
    assert one('{"meta":{"stream_options":{}},"stream":true}') == '{"meta":{"stream_options":{}},"stream":true,"stream_options":{"include_usage":true}}'
    assert one('{"t":"\\"stream_options\\":{}","stream" : true , "n":1.50}') == '{"t":"\\"stream_options\\":{}","stream" : true , "n":1.50,"stream_options":{"include_usage":true}}'
    assert one('{"stream":true,"stream_options":{"a":{"include_usage":1}}}') == '{"stream":true,"stream_options":{"include_usage":true,"a":{"include_usage":1}}}'
    for same in ('{"stream":"true"}', '{"a":{"stream":true}}', '{"stream":true,"stream_options":null}', '{"stream":true,"stream_options":{"include_usage":false}}', "[1]", "no", ""):
        assert one(same) == same
    assert one('{"stream":true,"stream_options":[1,{"x":2}]}') == '{"stream":true,"stream_options":{"include_usage":true}}'
    assert one('{"stream":true}', "responses") == '{"stream":true}'


@pytest.mark.parametrize(
    ("protocol", "body", "want"),
    [
        ("chat", '{"meta":{"messages":[]},"messages":[{"role":"user","content":"say N"}]}', '{"meta":{"messages":[]},"messages":[{"role":"system","content":"N"},{"role":"user","content":"say N"}]}'),
        ("chat", '{"messages":[]}', '{"messages":[{"role":"system","content":"N"}]}'),
        ("chat", '{"messages":[{"role":"system","content":"be kind"}],"n":1.0}', '{"messages":[{"role":"system","content":"be kind\\n\\nN"}],"n":1.0}'),
        ("chat", '{"messages":[{"role":"system","content":[{"type":"text","text":"x"}]}]}', '{"messages":[{"role":"system","content":[{"type":"text","text":"x"},{"type":"text","text":"N"}]}]}'),
        ("chat", '{"messages":[{"role":"system","content":"is N there"}]}', None),
        ("chat", '{"messages":[{"role":"system"}]}', '{"messages":[{"role":"system","content":"N"}]}'),
        ("chat", '{"messages":"none"}', None),
        ("chat", '{"input":[]}', None),
        ("anthropic", '{"messages":[]}', '{"messages":[],"system":"N"}'),
        ("anthropic", '{"system":"a","x":{"system":1}}', '{"system":"a\\n\\nN","x":{"system":1}}'),
        ("anthropic", '{"system":[]}', '{"system":[{"type":"text","text":"N"}]}'),
        ("anthropic", '{"system":3}', None),
        ("anthropic", '{"system":[{"text":"with N"}]}', None),
        ("responses", '{"input":"ask","instructions":[{"role":"user"}]}', '{"input":"ask\\n\\nN","instructions":[{"role":"system","content":"N"},{"role":"user"}]}'),
        ("responses", '{"input":7,"instructions":""}', '{"input":7,"instructions":"N"}'),
        ("responses", '{"x":{"input":"a"}}', None),
        ("none", '{"messages":[]}', None),
        ("chat", "not json", None),
    ],
)
def test_note_by_protocol_once_and_at_its_place(protocol, body, want):
    out = js.noted(body, "N", protocol)
    assert out == (body if want is None else want)
    assert js.noted(out, "N", protocol) == out
    assert js.noted("﻿" + body, "N", protocol).removeprefix("﻿") == out


def test_rewriting_leaves_all_else_byte_for_byte():
    text = '{"a" : 1.50, "k1":"x T", "in":"{\\"deep\\": [\\"T\\", 1e2]}", "T":{"é":"\\u00e9"}}'
    got = js.rewritten(text, lambda s: s.replace("T", 'q"\n'))
    assert got == '{"a" : 1.50, "k1":"x q\\"\\n", "in":"{\\"deep\\": [\\"q\\\\\\"\\\\n\\", 1e2]}", "q\\"\\n":{"é":"\\u00e9"}}'
    assert js.rewritten('{"a":1,"b":"a"}', lambda s: "b") == '{"a":1,"b":"b"}'
    assert js.rewritten("plain a", lambda s: s.upper()) == "PLAIN A"


def test_structure_is_walked_to_depth_five():
    inner = '{"v": "T", "l": [1, null]}'
    for _ in range(4):
        inner = json.dumps({"in": inner, "n": [1.50]})
    assert js.isomorphic(inner, js.rewritten(inner, lambda s: s.replace("T", 'a"b')))
    assert not js.isomorphic(inner, inner.replace("T", '"'))
    assert not js.isomorphic('{"a":[1]}', '{"a":[1,2]}') and not js.isomorphic('{"a":1}', '{"a":"1"}') and not js.isomorphic('{"a":"[1]"}', '{"a":"[1"}')
    assert js.isomorphic("no json", "{") and js.isomorphic('{"a":1}', '{"b":2}')


def test_paths_tell_parallel_calls_apart():
    frame = '{"id":"c","choices":[{"index":0,"delta":{"tool_calls":[{"index":1,"id":"x","function":{"name":"f","arguments":"{\\"p"}},{"id":"y","function":{"arguments":"a"}}]}}]}'
    paths = {frame[a:b]: p for a, b, p in js.string_paths(frame)}
    assert paths == {"f": ("choices", "i=0", "delta", "tool_calls", "i=1", "function", "name"), '{\\"p': ("choices", "i=0", "delta", "tool_calls", "i=1", "function", "arguments"), "a": ("choices", "i=0", "delta", "tool_calls", "m=y", "function", "arguments")}
    event = '{"type":"content_block_delta","index":2,"delta":{"type":"text_delta","text":"hi"},"l":["a","b"]}'
    assert js.string_paths(event)[0][2] == ("t=content_block_delta", "i=2", "delta", "t=text_delta", "text")
    assert [p[-1] for _, _, p in js.string_paths(event)[1:]] == ["#0", "#1"]
    assert js.string_paths('{"a":"x","a":{"text":"y"}}') == [(6, 7, ("a",)), (22, 23, ("text",))]


def test_summary_and_columns(spark):
    body = '{"model":"m","user":"secret","top_p":0.50,"messages":[{"role":"user","content":[{"type":"text","text":"one"},{"type":"image"}]},{"content":"two"}],"input":"three"}'
    assert json.loads(js.summary_json(body)) == {"model": "m", "top_p": 0.5, "text": "one\ntwo\nthree"}
    assert js.summary_json('{"user":"x"}') is None and js.summary_json("[1]") is None
    long = json.dumps({"input": ["é" * 5_000, "x" * 9_000]})
    assert len(json.loads(js.summary_json(long))["text"].encode()) <= 8_192
    frame = spark.createDataFrame([(body, "chat"), (None, "chat"), ("{}", None)], "b string, p string")
    rows = frame.select(js.with_note(F.col("b"), "N", F.col("p")).alias("n"), js.keeps_structure(F.col("b"), F.col("b")).alias("k"), js.request_summary(F.col("b")).alias("s")).collect()
    assert '"content":"N"' in rows[0].n and rows[0].k and rows[1].n is None and rows[1].k is None and rows[2].n == "{}" and rows[2].s is None


def test_edits_take_one_python_worker_and_a_slice_at_a_time(spark, monkeypatch):
    from tracelake.plans import pump

    monkeypatch.setattr(pump, "turns", lambda s, d: spark.createDataFrame([(f"s{k}", p, k % 2 and "system" or "user", "ä" * k) for k, p in enumerate(("chat", "anthropic", "responses") * 3)], "stream string, protocol string, role string, text string"))
    plan = pump._bodies(spark, "")
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in plan.collect():
        again = js.edited_twice(r.body, r.protocol, pump.NOTE)
        assert r.once and r.same and again == {"body": r.body, "again": r.body, "same": True}
    texts = pa.array(["x" * 10, None, "y" * (2 * js.SLICE), "z"])
    assert [len(a) for a, _ in js._slices((texts, texts))] == [2, 1, 1]
