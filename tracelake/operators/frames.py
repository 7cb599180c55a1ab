"""Frames of answer streams: placeholders across frames, held tool calls, sessions and overlaps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType

from ..functions.jsonspan import as_column, rewritten
from .audit import Policy, danger_reason, verdict
from .pii import TOKEN

#: Most characters of a placeholder's beginning that are held back, and seconds without
#: a request that end a conversation.
CARRY = 64
IDLE = 1_800
_BEGUN = re.compile(r"_(?:_(?:P(?:I(?:I(?:_(?:\d+(?:_(?:[0-9a-f]{0,8}_?)?)?)?)?)?)?)?)?$")
_WHOLE = re.compile(TOKEN)


def restore_frames(frames: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Frames (stream, seq, delta) with the placeholders of their stream (stream, placeholders) restored.

    The beginning of a placeholder at the end of a frame is held back and put before the next
    frame; what is left at the end of a stream comes as a last frame with a null ``seq``.  Unknown
    placeholders stay.  The texts of a stream's frames, one after the other, are those of the
    restored whole text.
    """
    # The map goes once, as a row before the first frame of its stream.
    absent = F.lit(None).cast("string").alias
    maps = placeholders.select("stream", F.lit(0).alias("_k"), F.lit(None).cast(frames.schema["seq"].dataType).alias("seq"), absent("delta"), F.to_json("placeholders").alias("known"))
    rows = frames.select("stream", F.lit(1).alias("_k"), F.col("seq").cast("long").alias("seq"), "delta", absent("known")).unionByName(maps.withColumn("seq", F.col("seq").cast("long")))
    kind = frames.schema["stream"].dataType.simpleString().replace("bigint", "long")
    types = to_arrow_schema(rows.select("stream", "seq", F.col("delta").alias("text")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, held, known = None, False, "", {}  # ``begun``: the stream has a frame

        for b in batches:
            if not b.num_rows:
                continue
            stream, frame = b.column("stream"), b.column("_k").to_numpy() == 1
            delta = pc.fill_null(b.column("delta"), "")
            first = np.append(True, np.diff(stream.dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0)
            # Frames without a mark leave as they are, but for the one after a frame that holds something back.
            marked = np.flatnonzero(first | ~frame | pc.match_substring(delta, "_").to_numpy(zero_copy_only=False)).tolist()
            changed, made, ends = np.zeros(b.num_rows, bool), [], []
            i, at = -1, 0
            while held and 0 <= i < b.num_rows - 1 or at < len(marked):
                i = i + 1 if held and i >= 0 else marked[at]
                while at < len(marked) and marked[at] <= i:
                    at += 1
                if first[i] and (i or stream[i].as_py() != current):
                    if begun or i and frame[i - 1]:
                        ends.append((current, None, held))
                    current, begun, held, known = stream[i].as_py(), False, "", {}
                if not frame[i]:
                    known = json.loads(b.column("known")[i].as_py() or "{}")
                    continue
                begun = True
                text = held + delta[i].as_py()
                whole_end = max((m.end() for m in _WHOLE.finditer(text)), default=0)
                cut = _BEGUN.search(text, max(whole_end, len(text) - CARRY))
                upto = cut.start() if cut else len(text)
                held = text[upto:]
                changed[i] = True
                made.append(_WHOLE.sub(lambda m: known.get(m[0], m[0]), text[:upto]))
            begun = begun or bool(frame[-1])
            texts = pc.replace_with_mask(delta, pa.array(changed), pa.array(made, delta.type))
            yield pa.RecordBatch.from_arrays([stream, b.column("seq"), texts], schema=types).filter(pa.array(frame))
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ends), types)], schema=types)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((current, None, held), types)], schema=types)

    return rows.repartition("stream").sortWithinPartitions("stream", "_k", "seq").mapInArrow(run, f"stream {kind}, seq long, text string")


def held_calls(frames: DataFrame, mode: str = "block", policy: Policy = Policy(), approvers: tuple[str, ...] = ()) -> DataFrame:
    """Verdict on each tool call of a stream (stream, index, seq, name, args), once its frames are joined.

    Arguments are the fragments by ``seq``, of which repeated ones count once; the name is the first
    given.  The frames may go out from ``released_at`` on; a blocked call's never do.
    """
    parts = frames.groupBy("stream", "index", "seq").agg(F.min(F.struct("name", "args")).alias("f"))
    calls = parts.groupBy("stream", "index").agg(
        F.array_sort(F.collect_list(F.struct("seq", "f.name", "f.args"))).alias("parts"), F.min_by("f.name", F.when(F.col("f.name").isNotNull(), F.col("seq"))).alias("name"), F.max("seq").alias("end")
    )
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["args"], F.lit(""))), "")
    judged = calls.select("stream", "index", "name", text.alias("args"), "end").withColumn("reason", danger_reason(F.col("name"), F.col("args"), policy))
    decided = judged.withColumn("verdict", verdict(mode, F.col("reason"), approvers))
    return decided.select("stream", "index", "name", "args", "reason", "verdict", F.when(F.col("verdict") == "allow", F.col("end")).alias("released_at"))


def idle_sessions(requests: DataFrame, key: str, ts: str, idle: int = IDLE) -> DataFrame:
    """Stretches of a key's requests without a pause of more than ``idle`` seconds."""
    order = Window.partitionBy(key).orderBy(ts)
    opens = F.coalesce(F.col(ts) - F.lag(ts).over(order) > idle, F.lit(True))
    numbered = requests.select(key, ts).withColumn("session", F.sum(opens.cast("long")).over(order))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("requests"))


def most_concurrent(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The most intervals [start, end) of a key that overlap; changes at one moment are summed first."""
    steps = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    changes = steps.groupBy(key, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return changes.select(key, running.alias("n")).groupBy(key).agg(F.max("n").alias("most"))


def restore_json(body: Column, placeholders: Column) -> Column:
    """A body whose strings and keys have known placeholders restored, as JSON that still parses.

    JSON texts inside strings are entered too, to a fixed depth; a body that is no JSON is restored
    as plain text; a null stays null.
    """

    def one(text: str, known: str | None) -> str:
        table = json.loads(known or "{}")
        return rewritten(text, lambda s: _WHOLE.sub(lambda m: table.get(m[0], m[0]), s))

    return as_column("string", one)(body, F.to_json(placeholders))


@F.pandas_udf(StringType())
def canonical_json(bodies: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys; null for a null or for what does not parse."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in bodies], dtype=object)
