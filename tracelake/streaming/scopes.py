"""The scope of each conversation, as a stream: the same one until the conversation falls idle."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.frames import IDLE

OUTPUT = "key string, ts long, id long, scope long, opened boolean"


class _Scopes(StatefulProcessor):
    """The number of the scope and the last request, kept for twice the idle time beyond it."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scope", "scope long, last long", 2 * self.idle * 1_000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        scope, last = self.state.get() if self.state.exists() else (0, None)
        for row in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            opened = last is None or row["ts"] - last > self.idle
            scope, last = scope + opened, row["ts"] if last is None else max(last, row["ts"])
            yield Row(key=key[0], ts=row["ts"], id=row["id"], scope=scope, opened=opened)
        self.state.update((scope, last))

    def close(self) -> None:
        pass


def conversation_scopes(requests: DataFrame, idle: int = IDLE) -> DataFrame:
    """Requests (key, ts, id) with the number of their conversation's scope, from 1; append mode.

    A scope ends after ``idle`` seconds without a request.  State goes by itself once a conversation is
    silent for twice as long, and numbers then begin anew; the state store must be RocksDB.
    """
    return requests.groupBy("key").transformWithState(_Scopes(idle), OUTPUT, "Append", "ProcessingTime")
