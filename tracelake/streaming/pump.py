"""The loop of answer streams as two stateful operators with typed state, and the danger rules between them.

The first gathers tool calls (a value, a map of slots, a list of held frames) and closes a stream by a
timer when it falls silent; the second sends, carries and restores (a value, a map of carried texts, a
map of placeholders, a list of held frames).  Steps are those of the batch form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import Policy
from ..operators.pump import HELD, IDLE_SECONDS, OUT, Hold, Pump, closing, facts, judged

#: How long a closed stream is remembered, so that late frames are not taken for a new one.
REMEMBERED_MS = 24 * 3_600 * 1_000
COUNTS = "protocol string, bytes long, payload long, empty long, around long, rejected boolean, ended boolean"
SLOT = "index long, name string, done boolean, next long, parts array<struct<number:bigint,text:string>>"
FLAGS = (
    "place long, state string, rejected string, any boolean, head boolean, failed boolean, conv string, first string, model string, finish string, chat_finish boolean, truncated string, cursor long, "
    "frames long, dropped long, approvals long, prompt long, completion long, total long, began long, token long, carried long, over boolean, protocol string"
)
HELD_PLAIN = "due array, release long, buffered boolean, overflow boolean, unfinished long"
SENT = "place protocol kind event data cursor head log".split()


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _kept(state: Any, before: list, now: list) -> None:
    """Bring a list state from ``before`` to ``now``: appended to where it only grew."""
    if now[: len(before)] == before:
        for v in now[len(before) :]:
            state.appendValue(v)
    elif now:
        state.put(now)
    else:
        state.clear()


class HoldProcessor(StatefulProcessor):
    def __init__(self, names: list[str], idle_seconds: int, bounds: tuple[int, ...] | None):
        self.names, self.idle, self.bounds = names, idle_seconds, bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS, REMEMBERED_MS)
        self.slots = handle.getMapState("slots", "slot string", SLOT)
        self.frames = handle.getListState("frames", "slots array<bigint>, payload long, around long")

    def _loaded(self) -> Hold:
        counts = dict(zip(_names(COUNTS), self.counts.get())) if self.counts.exists() else None
        slots = {}
        for key, (at, name, done, following, parts) in self.slots.iterator():
            slots[key[0]] = {"index": at, "name": name, "done": done, "next": following, "parts": {p[0]: p[1] for p in parts}}
        frames = [(list(s), p, a) for s, p, a in self.frames.get()]
        return Hold(slots, frames, counts, *([self.bounds] if self.bounds else []))

    def _run(self, rows: list[dict]) -> Iterator[Row]:
        h = self._loaded()
        before, frames = set(h.slots), list(h.frames)
        touched = {}
        for row in rows:
            if h.counts["ended"]:
                break
            due, *rest = h.step(row)
            yield Row(**{n: row[n] for n in self.names}, **dict(zip(_names(HELD_PLAIN), ([dict(zip(("index", "name", "args"), d)) for d in due], *rest))))
            touched |= h.slots
        for key in before - set(h.slots):
            self.slots.removeKey((key,))
        for key in set(touched) & set(h.slots):
            s = h.slots[key]
            self.slots.updateValue((key,), (s["index"], s["name"], s["done"], s["next"], list(s["parts"].items())))
        _kept(self.frames, frames, h.frames)
        self.counts.update(tuple(h.counts[n] for n in _names(COUNTS)))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.ended = h.counts["ended"]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from self._run(sorted((r.asDict(True) for r in rows), key=lambda r: r["seq"]))
        if not self.ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1_000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        protocol = self.counts.get()[0] if self.counts.exists() else None
        yield from self._run([dict.fromkeys(self.names) | closing(key[0], protocol)])

    def close(self) -> None:
        pass


class PumpProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", FLAGS, REMEMBERED_MS)
        self.carry = handle.getMapState("carry", "path string", "text string")
        self.known = handle.getMapState("known", "token string", "value string")
        self.held = handle.getListState("held", "slots array<bigint>, event string, data string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        flags = dict(zip(_names(FLAGS), self.flags.get())) if self.flags.exists() else None
        carry = {tuple(json.loads(k[0])): v[0] for k, v in self.carry.iterator()}
        known = {k[0]: v[0] for k, v in self.known.iterator()}
        held = [(list(s), e, d) for s, e, d in self.held.get()]
        p = Pump(flags, dict(carry), list(held), dict(known))
        for row in sorted((r.asDict(True) for r in rows), key=lambda r: r["seq"]):
            p.step(row)
            for sent in p.taken():
                yield Row(stream=key[0], **dict(zip(SENT, sent)))
        if p.f["over"]:
            p.known.clear()
        for state, before, now, spelt in ((self.carry, carry, p.carry, lambda k: json.dumps(k)), (self.known, known, p.known, lambda k: k)):
            for k in before.keys() - now.keys():
                state.removeKey((spelt(k),))
            for k, v in now.items():
                if before.get(k) != v:
                    state.updateValue((spelt(k),), (v,))
        _kept(self.held, held, p.held)
        self.flags.update(tuple(p.f[n] for n in _names(FLAGS)))

    def close(self) -> None:
        pass


def pump_stream(
    frames: DataFrame, mode: str = "block", policy: Policy = Policy(), approvers: tuple[str, ...] = (), idle_seconds: int = IDLE_SECONDS, bounds: tuple[int, ...] | None = None
) -> DataFrame:
    """All that streams send and their log rows, in append mode, as ``operators.pump.pump`` makes them.

    Frames of a stream must come in order across micro-batches; within one any order will do.  A stream
    without a close is closed after ``idle_seconds`` of silence; frames behind a close are dropped.  The
    state store must be RocksDB.
    """
    said = facts(frames)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in said.schema.fields) + ", " + HELD
    held = said.groupBy("stream").transformWithState(HoldProcessor(said.columns, idle_seconds, bounds), schema, "Append", "ProcessingTime")
    rows = judged(held, mode, policy, approvers)
    return rows.groupBy("stream").transformWithState(PumpProcessor(), OUT, "Append", "ProcessingTime")
