"""The loop of answer streams: against a plain version at every cut, its budgets, its end, and its streaming form."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracelake.functions import jsonspan
from tracelake.operators import pump as p
from tracelake.operators import toolcalls, traffic
from tracelake.streaming.pump import pump_stream

TOKENS = {"__PII_1_0a1b2c3d__": 'Ann "x"\n', "__PII_22_deadbeef__": "Bob", "__CRED_000123__": "s3cret"}
KNOWN = json.dumps(TOKENS)


def chat(delta, finish=None, choice=0):
    return "", json.dumps({"id": "c1", "model": "m", "choices": [{"index": choice, "delta": delta, "finish_reason": finish}]})


def call(index, args, name=None):
    return {"tool_calls": [{"index": index, "id": f"t{index}" if name else None, "function": {"name": name, "arguments": args}}]}


def rows_of(stream, frames, protocol="chat", ended=True):
    rows = [(stream, k, 100 + k, protocol, event, data, KNOWN if k == 0 else None, False) for k, (event, data) in enumerate(frames)]
    return rows + ([(stream, len(rows), 100 + len(rows), protocol, None, None, None, True)] if ended else [])


def run(rows, **own):
    """The batch stages in plain Python; nothing is judged dangerous but ``rm -rf``."""
    said = {"type": None, "index": None, "number": None, "id": None, "model": None, "finish": None, "terminal": False, "clean_end": False, "due_now": False, "output": False, "prompt": None, "completion": None, "total": None, "calls": []}
    hold, pump = p.Hold(**own), p.Pump()
    for stream, seq, at, protocol, event, data, known, ended in rows:
        row = said | {"stream": stream, "seq": seq, "at": at, "protocol": protocol, "event": event, "data": data, "known": known, "ended": ended}
        if data and data.startswith("{"):
            v = json.loads(data)
            for c in v.get("choices", []):
                row["due_now"] |= bool(c.get("finish_reason"))
                for t in c["delta"].get("tool_calls", []):
                    row["calls"] = [*row["calls"], {"index": t["index"], "id": t["id"] or f"s{t['index']}", "id_synth": not t["id"], "name": t["function"].get("name"), "args": t["function"]["arguments"] or ""}]
        due, release, buffered, overflow, _ = hold.step(row)
        reject = p.OVERFLOW if overflow else p.BLOCKED if any("rm -rf" in a for _, _, a in due) else None
        pump.step(row | {"release": release, "buffered": buffered, "reject": reject, "approvals": 0})
    return pump.taken()


def values(out):
    """Text of each place of a stream: (choice, key or call) to all its text."""
    found = {}
    for _, _, kind, _, data, _, _, _ in out:
        if kind == "frame" and data.startswith("{"):
            for c in json.loads(data)["choices"]:
                for k, v in c["delta"].items():
                    for place, text in [((c["index"], k), v)] if isinstance(v, str) else [((c["index"], t["index"]), t["function"]["arguments"]) for t in v or []]:
                        found[place] = found.get(place, "") + text
    return found


def restored(text):
    return re.sub("|".join(TOKENS), lambda m: TOKENS[m[0]], text)


def test_two_interleaved_calls_at_every_cut():
    """A placeholder cut inside one of two interleaved calls is restored in the right one, wherever the cut lies."""
    one, two = "a __PII_1_0a1b2c3d__ b __CRED_000123__", "c __PII_22_deadbeef____PII_1_0a1b2c3d__ _"
    for a in range(len(one) + 1):
        for b in range(0, len(two) + 1, 5):
            frames = [chat(call(0, one[:a], "f")), chat(call(1, two[:b], "g")), chat({"content": one[:a]}), chat({"content": two[:b]}, choice=1), chat(call(0, one[a:])), chat(call(1, two[b:])), chat({"content": one[a:]}), chat({"content": two[b:]}, choice=1), chat({}, "tool_calls"), ("", "[DONE]")]
            got = values(run(rows_of("s", frames)))
            want = {(0, 0): restored(one), (0, 1): restored(two), (0, "content"): restored(one), (1, "content"): restored(two)}
            assert got == want, (a, b)


def test_random_cuts_against_the_whole_text():
    rng = random.Random(2)
    alphabet = [*TOKENS, "__PII_9_00000000__", "__PII_", "_", "__", "x", " ", "__CRED_", "\\", '"', "é", "__PII_1_0a1b2c3d_"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        parts, at = [], 0
        while at < len(text):
            step = rng.randint(1, 9)
            parts.append(text[at : at + step])
            at += step
        out = run(rows_of("s", [chat({"content": t}) for t in parts] + [chat({}, "stop"), ("", "[DONE]")]))
        assert values(out).get((0, "content"), "") == restored(text), parts
        assert [o[2] for o in out].count("log") == 1 and sum(o[4] == "[DONE]" for o in out) == 1


@pytest.mark.parametrize("at", range(5))
def test_each_budget_just_at_and_just_beyond(at):
    frames = [chat(call(k, "ab" if k % 2 else "", "f")) for k in range(8)]
    around = sum(len(data.encode()) for _, data in frames) - 8
    just = [8, 8, 4, around, 8]
    wide = [99, 9_999, 99, 99_999, 99]
    bounds = wide[:at] + just[at : at + 1] + wide[at + 1 :]
    tail = [chat({}, "tool_calls"), ("", "[DONE]")]
    out = run(rows_of("s", frames + tail), bounds=tuple(bounds))
    assert [o[2] for o in out] == ["frame"] * 10 + ["log"] and out[-1][-1]["rejected"] is None
    bounds[at] -= 1
    out = run(rows_of("s", frames + tail), bounds=tuple(bounds))
    assert [o[2] for o in out] == ["block", "log"] and out[-1][-1]["rejected"] == p.OVERFLOW


def test_order_at_the_close():
    """Unfinished calls are audited, or dropped and counted; carried text goes only from a clean end; one terminal."""
    text = chat({"content": "hi __PII_1"})
    for frames, terminal, truncated, kinds in (
        ([text, chat({}, "stop")], "synthesized", None, ["frame", "frame", "frame", "done", "log"]),
        ([text], "synthesized", "open_ended", ["frame", "done", "log"]),
        ([text, chat(call(0, "ls", "bash"))], "synthesized", "open_ended", ["frame", "done", "log"]),
        ([text, chat(call(0, "rm -rf x", "bash"))], "blocked", None, ["frame", "block", "log"]),
        ([text, ("", "[DONE]"), text, ("", "[DONE]")], "upstream", None, ["frame", "frame", "frame", "log"]),
        ([], "empty", "open_ended", ["empty", "log"]),
    ):
        out = run(rows_of("s", frames))
        log = out[-1][-1]
        assert ([o[2] for o in out], log["terminal"], log["truncated"]) == (kinds, terminal, truncated), frames
        assert log["dropped"] == (1 if '"ls"' in str(frames) else 0)


def mixed():
    rng, rows = random.Random(5), []
    for k in range(12):
        text = " ".join(rng.choice([*TOKENS, "word", "x_"]) for _ in range(9))
        at = sorted(rng.sample(range(1, len(text)), 5))
        parts = [text[a:z] for a, z in zip([0, *at], [*at, len(text)])]
        command = "rm -rf x" if k % 4 == 1 else "ls"
        if k % 3 == 0:
            frames = [chat({"content": t}) for t in parts] + [chat(call(0, command[:2], "bash")), chat(call(0, command[2:]))] + ([] if k % 4 == 2 else [chat({}, "tool_calls"), ("", "[DONE]")])
            rows += rows_of(f"s{k}", frames, ended=k % 2 == 0)
        elif k % 3 == 1:
            e = lambda kind, **v: (kind, json.dumps({"type": kind, **v}))
            frames = [e("message_start", message={"id": "m", "usage": {"input_tokens": 5}})] + [e("content_block_delta", index=0, delta={"type": "text_delta", "text": t}) for t in parts]
            frames += [e("content_block_start", index=1, content_block={"type": "tool_use", "id": "t", "name": "bash"}), e("content_block_delta", index=1, delta={"type": "input_json_delta", "partial_json": command}), e("content_block_stop", index=1), e("message_stop")]
            rows += rows_of(f"s{k}", frames, "anthropic")
        else:
            e = lambda kind, **v: (kind, json.dumps({"type": kind, **v}))
            frames = [e("response.output_text.delta", item_id="i", output_index=0, sequence_number=n, delta=t) for n, t in enumerate(parts)]
            frames += [e("response.function_call_arguments.delta", item_id="j", output_index=1, sequence_number=9, delta=command), e("response.function_call_arguments.done", item_id="j", output_index=1, arguments=command), e("error" if k % 4 == 2 else "response.completed", message="bad")]
            rows += rows_of(f"s{k}", frames, "responses", ended=k % 2 == 1)
    return rows


def test_streaming_form_equals_batch_form(spark, tmp_path):
    """Typed state over three micro-batches and a timer give the rows of one batch pass."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frame = spark.createDataFrame(mixed(), p.FRAME)
    batch = p.pump(frame)
    want = sorted(str(r) for r in batch.collect())
    logs = p.stream_logs(batch).collect()
    assert len(logs) == 12 and {r.terminal for r in logs} >= {"upstream", "blocked", "synthesized", "error"}
    source = str(tmp_path / "in")
    for low, high in ((0, 3), (3, 7), (7, 99)):
        frame.filter(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = pump_stream(stream, idle_seconds=20).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    until, got = time.time() + 150, []
    try:
        while time.time() < until and query.isActive and len(got) < len(want):
            time.sleep(3)
            if any(f.suffix == ".parquet" for f in (tmp_path / "out").glob("*")):
                got = spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).select(*batch.columns).collect()
    finally:
        query.stop()
    assert sorted(str(r) for r in got) == want


def test_frames_of_a_turn_are_built_once(spark, sf_dir):
    """All frames of a turn were built again for each of them, to number the last one."""
    from tracelake.plans import pump as plans

    made = plans.frames(spark, sf_dir)
    above = made._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "[DONE]" not in above


def test_frames_without_placeholders_are_not_parsed(monkeypatch):
    """Nor are those whose texts end in what begins none; the others are parsed once, and once as they leave."""
    parsed, parse = [], jsonspan.index
    for where in (jsonspan, p):
        monkeypatch.setattr(where, "index", lambda text: parsed.append(text) or parse(text))
    row = dict.fromkeys("known at id model finish prompt completion total number type calls reject release terminal clean_end output buffered ended due_now event".split()) | {"protocol": "chat", "approvals": 0}
    loop = p.Pump(known={"__PII_1_0123abcd__": "Ann"})
    frames = ['{"choices":[{"delta":{"content":"%s"}}]}' % t for t in ("plain", "snake_case", "see __PII_1_01", "23abcd__ and", "__PII_1_0123abcd__")]
    for data, most in zip(frames, (0, 0, 1, 3, 2)):
        loop.step(row | {"data": data})
        assert len(parsed) <= most
        parsed.clear()
    assert "".join(json.loads(t[4])["choices"][0]["delta"]["content"] for t in loop.taken()) == "plainsnake_casesee Ann andAnn"


def test_names_that_are_escaped_or_in_single_quotes_are_found(spark):
    bodies = [
        '{"id":"x","model":"m","usage":{"prompt_tokens":1}}', '{"\\u0069d":"x","m\\u006fdel":"m","us\\u0061ge":{"prompt\\u005ftokens":1}}', "{'id':'x','model':'m','usage':{'prompt_tokens':1}}",
        '{"response":{"id":"x","model":"m","usage":{"input_tokens":1}}}', '{"id":"","message":{"id":"x","model":"m","usage":{"input_tokens":1}}}',
    ]
    b = F.col("b")
    made = spark.createDataFrame([(t,) for t in bodies], "b string").select(traffic.conversation_id(b).alias("i"), traffic.stream_model(b).alias("m"), traffic.usage(b)["prompt"].alias("p"))
    assert [tuple(r) for r in made.collect()] == [("x", "m", 1)] * len(bodies)
    calls = ['{"content_block":{"type":"tool_use","name":"f","input":{}}}', '{"content_block":{"type":"\\u0074ool_use","\\u006eame":"f","inp\\u0075t":{}}}', '{"type":"content_block_delta","delta":{"text":"x"}}', None]
    found = spark.createDataFrame([(t,) for t in calls], "b string").select(toolcalls.tool_calls(b).alias("c")).collect()
    assert [r.c if r.c is None else [c.name for c in r.c] for r in found] == [["f"], ["f"], [], None]
