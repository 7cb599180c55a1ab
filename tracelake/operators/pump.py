"""The loop of an answer stream: hold and audit tool calls, stitch and restore placeholders, end it once.

Frames are (stream, seq, at, protocol, event, data, known, ended): ``known`` is the stream's map of
placeholders as JSON, on any row before they are needed; ``ended`` marks the close, whose ``data`` may
be the parser's residue.  Three stages, the same in batch and in streaming:

1. ``facts``: what an event says, as column expressions.
2. ``Hold``: fragments of tool calls are gathered by slot under five budgets; an event that completes
   calls carries them along (``due``), and says which held frames may leave.
3. ``judged``: the danger rules decide on complete calls, as column expressions.
4. ``Pump``: in order guards, rejection, release of held frames, carry of cut placeholders by path,
   restoring under a guard of structure, and the terminal, of which a stream gets one at most.
   ``written_out`` turns markers for blocks and terminals into their frames.

State is bounded by the budgets and by the stream's map of placeholders.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonspan import Index, edited, index, isomorphic, rewritten, string_paths
from . import traffic
from .audit import Policy, danger_reason
from .folds import fold_sorted
from .records import block_frames
from .toolcalls import blocked_call, tool_calls

#: Budgets of what is held (frames, bytes of arguments, frames without any, bytes around
#: them, slots), longest beginning of a placeholder and how many of them are carried.
MOST_FRAMES, MOST_BYTES, MOST_EMPTY, MOST_AROUND, MOST_SLOTS = 65_536, 1 << 20, 4_096, 8 << 20, 4_096
CARRY_LENGTH, CARRIES = 64, 16
#: Reasons of a rejection, and seconds of silence that end a stream.
BLOCKED, OVERFLOW = "audit-policy-block", "audit-hold-overflow"
IDLE_SECONDS = 30
#: Events that complete a slot, a block, and a response or message.
SLOT_DONE = (
    "response.output_item.done", "response.function_call_arguments.done", "response.code_interpreter_call_code.done", "response.shell_call_command.done",
    "response.mcp_call_arguments.done", "response.custom_tool_call_input.done",
)
INDEX_DONE = ("content_block_stop", "item_done")
ENDS = ("message_stop", "response.completed", "response.failed", "response.incomplete")
#: How a whole placeholder is written, and the beginnings of one at the end of a text.
WHOLE = re.compile(r"__(?:PII_\d+_[0-9a-fA-F]{8}|CRED_\d{4,})__")
BEGUN = re.compile(r"_(?:_(?:P(?:I(?:I(?:_(?:\d+(?:_(?:[0-9a-fA-F]*_?)?)?)?)?)?)?|C(?:R(?:E(?:D(?:_(?:\d+_?)?)?)?)?)?)?)?\Z")

#: The same before the end of a JSON string; a frame without it, or a whole one, keeps all its texts.
CUT = re.compile(BEGUN.pattern.removesuffix(r"\Z") + '"')

CALLS = "array<struct<index:bigint,name:string,args:string>>"
HELD = "due array<struct<index:bigint,name:string,args:string>>, release long, buffered boolean, overflow boolean, unfinished long"
FACTS = "type string, index long, number long, id string, model string, finish string, terminal boolean, clean_end boolean, due_now boolean, output boolean, prompt long, completion long, total long"
FRAME = "stream string, seq long, at long, protocol string, event string, data string, known string, ended boolean"
LOG = "struct<conv_id:string,model:string,finish:string,terminal:string,truncated:string,rejected:string,frames:bigint,dropped:bigint,approvals:bigint,prompt:bigint,completion:bigint,total:bigint,ttft_ms:bigint,carried:bigint>"
OUT = f"stream string, place long, protocol string, kind string, event string, data string, cursor long, head boolean, log {LOG}"


def facts(frames: DataFrame) -> DataFrame:
    """Frames with what each says; nulls and false where it says nothing."""
    body = F.when(F.ltrim("data").startswith("{") & ~F.coalesce("ended", F.lit(False)), F.col("data"))
    at = lambda path: traffic.member(body, path)
    kind, chat, responses = at("$.type"), F.col("protocol") == "chat", F.col("protocol") == "responses"
    finish = traffic.finish_reason(body)
    chat_finish = F.coalesce(at("$.choices[0].finish_reason"), at("$.choices[1].finish_reason"))
    error = chat & at("$.error").isNotNull() & at("$.choices").isNull()
    terminal = error | (~chat & kind.isin(*ENDS)) | ((F.col("protocol") == "anthropic") & (kind == "error"))
    said = {
        "type": F.when(error, "error").otherwise(kind), "index": F.coalesce(at("$.index"), at("$.output_index")).try_cast("bigint"), "number": at("$.sequence_number").try_cast("bigint"), "id": traffic.conversation_id(body),
        "model": traffic.stream_model(body), "finish": F.when(chat, chat_finish).otherwise(finish), "terminal": F.coalesce(terminal, F.lit(False)),
        "clean_end": F.coalesce((~chat & ~responses & (kind == "message_stop")) | (responses & (kind == "response.completed")), F.lit(False)),
        "due_now": F.coalesce(F.when(chat, chat_finish != "").otherwise(kind.isin(*ENDS)), F.lit(False)), "output": traffic.carries_output(body),
        "usage": traffic.usage(body), "calls": tool_calls(body),
    }
    rows = frames.select("stream", "seq", "at", "protocol", "event", "data", "known", F.coalesce("ended", F.lit(False)).alias("ended"), *[c.alias(n) for n, c in said.items()])
    return rows.select("*", "usage.prompt", "usage.completion", "usage.total").drop("usage")


class Hold:
    """What is gathered of a stream's tool calls and not yet audited."""

    def __init__(self, slots: dict | None = None, frames: list | None = None, counts: dict | None = None, bounds: tuple[int, ...] = (MOST_FRAMES, MOST_BYTES, MOST_EMPTY, MOST_AROUND, MOST_SLOTS)):
        self.slots: dict[str, dict] = {} if slots is None else slots  # index, name, done, next number and parts by number
        self.frames: list[tuple[list[int], int, int]] = [] if frames is None else frames  # slots, payload and what is around it
        self.counts = counts or {"protocol": None, "bytes": 0, "payload": 0, "empty": 0, "around": 0, "rejected": False, "ended": False}
        self.bounds = bounds

    def _reject(self) -> None:
        self.slots.clear()
        self.frames.clear()
        self.counts |= {"bytes": 0, "payload": 0, "empty": 0, "around": 0, "rejected": True}

    def _size(self, key: str) -> int:
        return sum(len(p.encode()) for p in self.slots[key]["parts"].values())

    def _push(self, call: dict, number: int | None, responses: bool, slot_done: bool) -> None:
        key = call["id"] if responses and call["id"] and not call["id_synth"] else f"#{call['index']}"
        slot = self.slots.setdefault(key, {"index": call["index"], "name": None, "done": not responses, "next": 0, "parts": {}})
        slot["name"] = slot["name"] or call["name"]
        if slot_done and responses:
            slot["done"] = True
            if call["args"]:
                self.counts["bytes"] += len(call["args"].encode()) - self._size(key)
                slot["parts"] = {0: call["args"]}
            return
        at = number if responses and number is not None else slot["next"]
        slot["next"] = max(slot["next"], at + 1)
        if at not in slot["parts"]:
            slot["parts"][at] = call["args"]
            self.counts["bytes"] += len(call["args"].encode())

    def _take(self, keys: list[str]) -> list[tuple[int, str, str]]:
        out = []
        for k in keys:
            self.counts["bytes"] -= self._size(k)
            slot = self.slots.pop(k)
            out.append((slot["index"], slot["name"] or "", "".join(slot["parts"][p] for p in sorted(slot["parts"]))))
        return out

    def _count(self, frames: list[tuple[list[int], int, int]], sign: int) -> None:
        for _, payload, around in frames:
            for k, v in (("payload", payload), ("empty", int(not payload)), ("around", around)):
                self.counts[k] += sign * v

    def step(self, row: dict) -> tuple[list[tuple[int, str, str]], int | None, bool, bool, int]:
        """(due calls, slots to release: -1 all, buffered, overflow, unfinished frames at the end)."""
        self.counts["protocol"] = self.counts["protocol"] or row["protocol"]
        if row["ended"]:
            due = [] if self.counts["ended"] else self._take([k for k in self.slots if self.slots[k]["done"]] + [k for k in self.slots if not self.slots[k]["done"]])
            self.counts["ended"] = True
            return due, None, False, False, len(self.frames)
        calls, responses = row["calls"] or [], row["protocol"] == "responses"
        slot_done, index_done = row["type"] in SLOT_DONE, row["type"] in INDEX_DONE
        buffered = bool(calls) and not (row["due_now"] or slot_done or index_done)
        if self.counts["rejected"]:
            return [], None, buffered, False, 0
        for call in calls:
            self._push(call, row["number"], responses, slot_done)
            if self.counts["bytes"] > self.bounds[1] or len(self.slots) > self.bounds[4]:
                self._reject()
                return [], None, buffered, True, 0
        due: list[tuple[int, str, str]] = []
        release = -1 if row["due_now"] else row["index"] if slot_done or index_done else None
        if row["due_now"] and responses:
            due += self._take([k for k, s in self.slots.items() if not s["done"]])
        if row["due_now"] or slot_done:
            due += self._take([k for k, s in self.slots.items() if s["done"]])
        elif index_done:
            due += self._take([k for k, s in self.slots.items() if s["index"] == row["index"]])
        if release is not None and self.frames:
            going = [f for f in self.frames if release < 0 or release in f[0]]
            self.frames[:] = [f for f in self.frames if not (release < 0 or release in f[0])]
            self._count(going, -1)
        if buffered:
            payload = sum(len(c["args"].encode()) for c in calls)
            self.frames.append((sorted({c["index"] for c in calls}), payload, len(row["data"].encode()) - payload))
            self._count(self.frames[-1:], 1)
            if any(held > most for held, most in zip((len(self.frames), *(self.counts[k] for k in ("payload", "empty", "around"))), self.bounds)):
                self._reject()
                return due, release, buffered, True, 0
        return due, release, buffered, False, 0


def judged(held: DataFrame, mode: str, policy: Policy, approvers: tuple[str, ...]) -> DataFrame:
    """Rows with ``reject`` (why the stream is blocked here) and ``approvals`` (calls that wait for one)."""
    first = F.when(F.size("due") > 0, blocked_call(F.col("due"), lambda name, args: danger_reason(name, args, policy))["reason"])
    waits = mode == "approve" and bool(approvers)
    danger = F.when(F.lit(mode == "off"), F.lit(None).cast("string")).otherwise(first)
    reject = F.when(F.col("overflow"), F.lit(OVERFLOW)).when(danger.isNotNull() & F.lit(not waits), F.lit(BLOCKED))
    return held.withColumn("reject", reject).withColumn("approvals", F.when(danger.isNotNull() & F.lit(waits), 1).otherwise(0).cast("long")).drop("overflow")


def begun_at(text: str) -> int:
    """Where the beginning of a placeholder stands at the end of a text; its length if there is none."""
    whole = max((m.end() for m in WHOLE.finditer(text, max(0, len(text) - 2 * CARRY_LENGTH))), default=0)
    found = BEGUN.search(text, max(whole, len(text) - CARRY_LENGTH))
    return found.start() if found else len(text)


class Pump:
    """What a stream has sent, holds back and knows."""

    def __init__(self, flags: dict | None = None, carry: dict | None = None, held: list | None = None, known: dict | None = None):
        self.f = flags or {
            "place": 0, "state": "open", "rejected": None, "any": False, "head": False, "failed": False, "conv": None, "first": None, "model": None, "finish": None, "chat_finish": False,
            "truncated": None, "cursor": None, "frames": 0, "dropped": 0, "approvals": 0, "prompt": None, "completion": None, "total": None, "began": None, "token": None, "carried": 0, "over": False, "protocol": None,
        }
        self.carry: dict[tuple[str, ...], str] = {} if carry is None else carry
        self.held: list[tuple[list[int], str, str]] = [] if held is None else held
        self.known: dict[str, str] = {} if known is None else known
        self.out: list[tuple] = []

    def _emit(self, kind: str, event: str | None, data: str | None, cursor: int | None = None, log: dict | None = None) -> None:
        f = self.f
        self.out.append((f["place"], f["protocol"], kind, event, data, cursor, f["head"], log))
        f["place"] += 1
        if kind != "log":
            f["any"] = True
            f["frames"] += 1

    def _restored(self, data: str, whole: bool, found: Index | None = None) -> str:
        """Data (and its index, where there is one) with known placeholders restored; as it was if that would break its structure."""
        if not WHOLE.search(data):
            return data
        swap = lambda s: WHOLE.sub(lambda m: self.known.get(m[0], m[0]), s)
        found = found or (index(data) if whole else None)
        made = rewritten(data, swap, whole=found) if whole else swap(data)
        return made if made == data or isomorphic(data, made, whole=found) else data

    def _stitched(self, data: str, absorb: bool, found: Index) -> str:
        """Data with carried beginnings put before the next value of their path, and new ones taken off."""
        edits = []
        for start, end, path in string_paths(data, found):
            had = self.carry.pop(path, "")
            text = had + data[start:end]
            at = len(text)
            if had and len(text) > len(had) and len(text) <= CARRY_LENGTH and BEGUN.fullmatch(text):
                at = 0
            elif absorb and text:
                at = begun_at(text)
            if at < len(text):
                if len(self.carry) < CARRIES:
                    self.carry[path] = text[at:]
                else:
                    at = len(text)
                    self.f["carried"] += 1
            if text[:at] != data[start:end]:
                edits.append((start, end, text[:at]))
        return edited(data, edits)

    def _release(self) -> None:
        """What is carried goes out in small frames of its own."""
        for path, text in list(self.carry.items()):
            event, data = release_frame(self.f, path, text)
            if data is not None:
                self._emit("frame", event, self._restored(data, True))
        self.carry.clear()

    def _block(self, reason: str) -> None:
        f = self.f
        f["rejected"] = f["rejected"] or reason
        self.held.clear()
        if f["state"] == "open":
            self._emit("block", f["conv"], reason, f["cursor"])
            f["state"] = "blocked"

    def step(self, row: dict) -> None:
        f = self.f
        f["protocol"] = f["protocol"] or row["protocol"]
        if row["known"]:
            self.known.update(json.loads(row["known"]))
        if f["over"]:
            return
        if row["at"] is not None and f["began"] is None:
            f["began"] = row["at"]
        f["approvals"] += row["approvals"]
        if row["ended"]:
            self._finish(row)
            return
        data, responses = row["data"] or "", f["protocol"] == "responses"
        if not data:
            return
        done = data.strip() == "[DONE]"
        f["conv"] = row["id"] or f["conv"]
        f["first"] = f["first"] or row["id"]
        f["model"], f["finish"] = row["model"] or f["model"], row["finish"] or f["finish"]
        f["chat_finish"] = f["chat_finish"] or (f["protocol"] == "chat" and row["due_now"])
        for k in ("prompt", "completion", "total"):
            if row[k] is not None:
                f[k] = max(f[k] or 0, row[k])
        if row["number"] is not None:
            f["cursor"] = max(f["cursor"] or 0, row["number"])
        error = row["type"] == "error"
        if error and not responses and f["state"] == "open":
            f["truncated"] = "upstream_error"
        # Guards: a rejected stream sends nothing more of the call or its end; a response fails once.
        if f["rejected"] and (done or row["terminal"] or row["calls"] or row["due_now"]):
            return
        if f["state"] != "open":
            return
        if responses and (error or row["type"] == "response.failed"):
            if error:
                self._emit("failed", f["first"] or f["conv"], data, row["number"])
                f["state"], f["truncated"], f["failed"] = "error", "synthesized_failed", True
                return
            f["failed"] = True
        if row["reject"]:
            self._block(row["reject"])
            return
        if done:
            if f["protocol"] == "chat":
                f["state"] = "upstream"
                self._release()
                self._emit("frame", row["event"], "[DONE]")
            return
        if row["release"] is not None:
            going = [h for h in self.held if row["release"] < 0 or row["release"] in h[0]]
            self.held[:] = [h for h in self.held if not (row["release"] < 0 or row["release"] in h[0])]
            for _, event, text in going:
                self._emit("frame", event, text)
        if row["clean_end"]:
            self._release()
        if row["terminal"]:
            f["state"] = "upstream"
        made = data
        if self.carry or CUT.search(data) or WHOLE.search(data):
            found = index(data)
            if found is not None:
                made = self._stitched(data, not row["clean_end"], found)
            made = self._restored(made, found is not None, found if made == data else None)
        if row["output"] and f["token"] is None:
            f["token"] = row["at"]
        if row["buffered"]:
            self.held.append((sorted({c["index"] for c in row["calls"]}), row["event"], made))
            return
        self._emit("frame", row["event"], made)
        f["head"] = f["head"] or row["type"] == "message_start"

    def _finish(self, row: dict) -> None:
        """The fixed order at the close: audit, unfinished frames, carry, residue, terminal, log row."""
        f = self.f
        f["over"] = True
        broken = f["state"] == "open" and bool(row["event"] == "broken")
        if row["reject"] and not f["rejected"]:
            self._block(row["reject"])
        unfinished = len(self.held)
        f["dropped"] += unfinished
        self.held.clear()
        broken = broken or unfinished > 0
        if not broken and f["chat_finish"] and f["state"] == "open":
            self._release()
        payload = (row["data"] or "").strip().removeprefix("data:").strip()
        if f["state"] == "open" and payload[:1] in ("{", "[") and index(payload) is not None:
            self._emit("frame", "", self._restored(payload, True))
        if f["state"] == "open" and not f["rejected"] and (f["any"] or broken) and (f["any"] or f["protocol"] != "responses"):
            if f["protocol"] == "chat":
                f["truncated"] = f["truncated"] if f["chat_finish"] else "open_ended"
                self._emit("done", "", "[DONE]")
                f["state"] = "synthesized"
            elif f["protocol"] == "responses":
                f["truncated"] = "synthesized_failed"
                self._emit("failed", f["conv"], None, None if f["cursor"] is None else f["cursor"] + 1)
                f["state"] = "synthesized"
            else:
                f["truncated"] = "open_ended"
        if f["state"] == "open" and not f["any"] and not f["rejected"]:
            f["truncated"] = "synthesized_failed" if f["protocol"] == "responses" else "open_ended"
            self._emit("empty", f["conv"], None)
            f["state"] = "empty"
        self.carry.clear()
        total = f["total"] if f["total"] is not None or f["prompt"] is None else f["prompt"] + (f["completion"] or 0)
        log = {k: f[k] for k in ("model", "finish", "truncated", "rejected", "frames", "dropped", "approvals", "prompt", "completion", "carried")}
        log |= {"conv_id": f["conv"], "terminal": f["state"], "total": total, "ttft_ms": None if f["token"] is None or f["began"] is None else f["token"] - f["began"]}
        self._emit("log", None, None, None, log)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def release_frame(f: dict, path: tuple[str, ...], text: str) -> tuple[str, str | None]:
    """(event, data) of a frame that carries a text to its path."""
    names = [p for p in path if "=" not in p and not p.startswith("#")]
    last = names[-1] if names else ""
    mark = lambda tag: next((p[2:] for p in path if p.startswith(tag + "=")), None)
    after = lambda name: next((path[i + 1].partition("=")[2] for i, p in enumerate(path[:-1]) if p == name), "")
    number = lambda v: int(v) if v and v.isdigit() else 0
    if f["protocol"] == "chat":
        own = {"tool_calls": [{"index": number(after("tool_calls")), "function": {last: text}}]} if "tool_calls" in names and last in ("arguments", "name") else None
        delta = own or {"reasoning_content" if last.startswith("reasoning") else "refusal" if last == "refusal" else "content": text}
        body: dict[str, Any] = {"id": f["conv"] or "", "object": "chat.completion.chunk", "model": f["model"] or "", "choices": [{"index": number(after("choices")), "delta": delta}]}
        return "", json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    if f["protocol"] == "anthropic":
        kind = {"partial_json": "input_json_delta", "thinking": "thinking_delta"}.get(last, "text_delta")
        body = {"type": "content_block_delta", "index": number(mark("i")), "delta": {"type": kind, {"input_json_delta": "partial_json", "thinking_delta": "thinking"}.get(kind, "text"): text}}
        return "content_block_delta", json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    if f["protocol"] == "responses":
        own_kind = mark("t") or ""
        kind = own_kind if own_kind.endswith(".delta") else "response.output_text.delta"
        body = {"type": kind, "item_id": mark("m") or "", "output_index": number(mark("o")), "content_index": number(mark("c")), "delta": text}
        return kind, json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    return "", None


def written_out(rows: DataFrame) -> DataFrame:
    """Markers turned into frames: (stream, place, part, event, data); log rows left out."""
    own = "array<struct<event:string,data:string>>"
    frame = lambda event, *fields: F.struct(F.lit(event).alias("event"), F.to_json(F.struct(F.lit(event).alias("type"), *fields)).alias("data"))
    blocks = block_frames(F.col("protocol"), F.col("data"), F.coalesce("event", F.lit("")), F.col("cursor"))
    message = F.coalesce(F.get_json_object("data", "$.message"), F.get_json_object("data", "$.error.message"), F.lit("stream ended early"))
    failed = F.array(frame("response.failed", F.col("cursor").alias("sequence_number"), F.struct(F.coalesce("event", F.lit("")).alias("id"), F.lit("failed").alias("status"), F.struct(message.alias("message")).alias("error")).alias("response")))
    done = F.array(F.struct(F.lit("").alias("event"), F.lit("[DONE]").alias("data")))
    empty = F.when(F.col("protocol") == "chat", done).when(F.col("protocol") == "responses", failed).otherwise(F.array(frame("message_start"), frame("message_stop")))
    kept = F.when((F.col("protocol") == "anthropic") & F.col("head"), F.slice(blocks, F.lit(2), F.size(blocks))).otherwise(blocks)
    each = (
        F.when(F.col("kind") == "block", kept).when(F.col("kind") == "failed", failed).when(F.col("kind") == "done", done).when(F.col("kind") == "empty", empty)
        .otherwise(F.array(F.struct(F.coalesce("event", F.lit("")).alias("event"), F.col("data").alias("data"))))
    ).cast(own)
    return rows.filter("kind <> 'log'").select("stream", "place", F.posexplode(each).alias("part", "f")).select("stream", "place", "part", "f.event", "f.data")


def stream_logs(rows: DataFrame) -> DataFrame:
    """The one log row of each stream."""
    return rows.filter("kind = 'log'").select("stream", "protocol", "log.*")


def held_rows(frames: DataFrame, bounds: tuple[int, ...] | None = None) -> DataFrame:
    """Frames with facts, due calls and verdict on what is held, in batch form; a stream without a close gets one."""
    said = facts(frames)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in said.schema.fields) + ", " + HELD
    names = said.columns

    def step(h: Hold, row: dict) -> tuple | None:
        if h.counts["ended"]:
            return None
        return tuple(row[n] for n in names) + h.step(row)

    def last(stream: str, h: Hold) -> list:
        if h.counts["ended"]:
            return []
        row = dict.fromkeys(names) | closing(stream, h.counts["protocol"])
        return [tuple(row[n] for n in names) + h.step(row)]

    make = (lambda: Hold(bounds=bounds)) if bounds else Hold
    return fold_sorted(said, "stream", ("seq",), schema, make, step, last)


def closing(stream: str, protocol: str | None, seq: int = (1 << 62)) -> dict:
    """The row that closes a stream which nothing else has closed."""
    no = ("terminal", "clean_end", "due_now", "output")
    return {"stream": stream, "seq": seq, "protocol": protocol, "event": "broken", "ended": True} | dict.fromkeys(no, False)


def pump(frames: DataFrame, mode: str = "block", policy: Policy = Policy(), approvers: tuple[str, ...] = (), bounds: tuple[int, ...] | None = None) -> DataFrame:
    """All that streams send, by ``place``, and their log rows, in batch form: see ``written_out`` and ``stream_logs``.

    A stream is one task at a time, and its state is bounded; rows of one stream may be any number.
    """

    def step(p: Pump, row: dict) -> list:
        p.stream = row["stream"]
        p.step(row)
        return [(p.stream, *t) for t in p.taken()]

    rows = judged(held_rows(frames, bounds), mode, policy, approvers).drop("due", "unfinished")
    return fold_sorted(rows, "stream", ("seq",), OUT, Pump, step)


__all__ = ["Hold", "Pump", "closing", "facts", "held_rows", "judged", "pump", "stream_logs", "written_out"]
