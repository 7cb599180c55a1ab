"""Server-sent events of unfinished streams: a stateful operator that keeps the open block of each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds after which an open block is dropped, and the bytes beyond which an event is
#: marked and beyond which a stream fails.
IDLE_SECONDS = 30
MARKED, BLOCK_LIMIT = 1 << 20, 8 << 20
#: How long a silent stream is remembered.
REMEMBERED_MS = 24 * 3_600 * 1_000
OUTPUT = "stream_id string, pos long, event string, data string, id string, retry long, oversize boolean, failed boolean"
_END = re.compile(r"\r\n|\r|\n")


class Parser:
    """Events of a stream that comes in chunks; each character is looked at once.

    ``id`` and ``retry`` are carried from event to event.  A line end of two characters may be cut.  A
    block beyond the limit fails the stream: it gives one last row, and nothing after it.
    """

    NAMES = ("pos", "id", "retry", "size", "cut", "begun", "failed")
    START = (0, None, None, 0, False, False, False)

    def __init__(self, scalars: tuple | None = None, lines: list[str] | None = None, tail: list[str] | None = None):
        for name, value in zip(self.NAMES, scalars or self.START):
            setattr(self, name, value)
        self.lines = lines or []  # whole ones of the open block
        self.tail = tail or []  # pieces of the line that is not yet ended

    def scalars(self) -> tuple:
        return tuple(getattr(self, n) for n in self.NAMES)

    def reset(self) -> None:
        """Forget the open block, and nothing else."""
        self.lines, self.tail, self.size, self.cut = [], [], 0, False

    def push(self, chunk: str) -> list[tuple]:
        out: list[tuple] = []
        if self.failed or not chunk:
            return out
        if not self.begun:
            self.begun, chunk = True, chunk.removeprefix("\ufeff")
        if self.cut:
            chunk = chunk.removeprefix("\n")
        self.cut = chunk.endswith("\r")
        *whole, rest = _END.split(chunk)
        for line in whole:
            self._line("".join([*self.tail, line]), len(line), out)
            self.tail = []
        if rest:
            self.tail.append(rest)
            self._grow(len(rest.encode()))
        if self.failed:
            out.append((self.pos, None, None, self.id, self.retry, True, True))
            self.reset()
        return out

    def _grow(self, n: int) -> None:
        self.size += n
        self.failed = self.failed or self.size > BLOCK_LIMIT

    def _line(self, line: str, new: int, out: list[tuple]) -> None:
        if line:
            self.lines.append(line)
            self._grow(new)
            return
        event, data = None, []
        for own in self.lines:
            name, _, value = own.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            elif name == "event":
                event = value
            elif name == "id" and "\0" not in value:
                self.id = value
            elif name == "retry" and value.isascii() and value.isdigit():
                self.retry = int(value[:18])
        if (data or event is not None) and not self.failed:
            out.append((self.pos, event, "\n".join(data), self.id, self.retry, self.size > MARKED, False))
            self.pos += 1
        self.lines, self.size = [], 0


def take_blocks(held: str, chunk: str) -> tuple[list[tuple[str | None, str]], str]:
    """Complete (event, data) blocks of what is held and new, and what stays open.

    A carriage return at the very end stays open, since a line feed may follow.
    """
    text = held + chunk
    tail = "\r" if text.endswith("\r") else ""
    lines = text.removesuffix("\r").replace("\r\n", "\n").replace("\r", "\n").split("\n\n")
    found = []
    for block in lines[:-1]:
        event, data = None, []
        for line in block.removeprefix("\ufeff").split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            elif name == "event":
                event = value
        if data or event is not None:
            found.append((event, "\n".join(data)))
    return found, lines[-1].lstrip("\n") + tail


class _Processor(StatefulProcessor):
    """Numbers and the last id as a value, lines and pieces of the open block as lists that only grow."""

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", "pos long, id string, retry long, size long, cut boolean, begun boolean, failed boolean", REMEMBERED_MS)
        self.lines = handle.getListState("lines", "line string")
        self.tail = handle.getListState("tail", "piece string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        lines, tail = [r[0] for r in self.lines.get()], [r[0] for r in self.tail.get()]
        p = Parser(tuple(self.scalars.get()) if self.scalars.exists() else None, list(lines), list(tail))
        for row in sorted(rows, key=lambda r: r["seq"]):
            for found in p.push(row["chunk"] or ""):
                yield Row(**dict(zip(OUTPUT_NAMES, (key[0], *found))))
        for state, before, now in ((self.lines, lines, p.lines), (self.tail, tail, p.tail)):
            if now[: len(before)] == before:
                for v in now[len(before) :]:
                    state.appendValue((v,))
            elif now:
                state.put([(v,) for v in now])
            else:
                state.clear()
        self.scalars.update(p.scalars())
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if p.lines or p.tail:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1_000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.scalars.exists():
            p = Parser(tuple(self.scalars.get()))
            p.reset()
            self.scalars.update(p.scalars())
        self.lines.clear()
        self.tail.clear()
        return iter(())

    def close(self) -> None:
        pass


OUTPUT_NAMES = [part.split()[0] for part in OUTPUT.split(", ")]


def sse_frames(chunks: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """(stream_id, seq, chunk) rows of a stream to events; append mode, with a RocksDB state store.

    Chunks come in order across micro-batches; within one any order will do.  After ``idle_seconds`` of
    silence the open block is dropped; positions, the last id and retry stay.
    """
    return chunks.groupBy("stream_id").transformWithState(_Processor(idle_seconds), OUTPUT, "Append", "ProcessingTime")
