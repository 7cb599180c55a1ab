"""Text out of byte chunks."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def _texts(held: bytes, data: bytes, ends: np.ndarray) -> tuple[bytes, np.ndarray, bytes]:
    """UTF-8 of the texts of chunks that end at ``ends`` in ``data``, where each ends, and the bytes that wait.

    ``held`` are the bytes that waited before.
    """
    raw = held + data
    try:
        whole = codecs.utf_8_decode(raw, "strict", False)[1]  # without a character that is cut at the end
    except UnicodeDecodeError:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        decoder.decode(held)
        cuts = [0, *ends.tolist()]
        made = [decoder.decode(data[a:z]).encode() for a, z in zip(cuts, cuts[1:])]
        return b"".join(made), np.cumsum([len(m) for m in made]), decoder.getstate()[0]
    # A chunk that ends within a character ends before it.
    octets = np.frombuffer(raw + b"\0", np.uint8)
    at = np.minimum(ends + len(held), whole)
    for _ in range(3):
        at = at - ((octets[at] & 0xC0) == 0x80)
    return raw[:whole], at, raw[whole:]


def stitched(chunks: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    """Text (key, seq, text) of each byte chunk of a stream, in order; empty texts are left out.

    The bytes of a character that is cut wait for the next chunk; bytes that are no UTF-8 become
    U+FFFD, and so does what is left at a stream's end, in a last row with a null ``seq``.  The chunks of
    a stream in a batch are decoded at once.
    """
    kinds = [chunks.schema[c].dataType.simpleString() for c in (key, seq)]
    rows = chunks.select(key, seq, chunk).repartition(key).sortWithinPartitions(key, seq)
    types = to_arrow_schema(rows.selectExpr(f"`{key}`", f"`{seq}`", "'' as text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, b""

        def left() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((current, None, held.decode(errors="replace")), types)], schema=types)

        for b in batches:
            if not b.num_rows:
                continue
            given = pc.fill_null(b.column(chunk).cast(pa.large_binary()), b"")
            offsets = np.frombuffer(given.buffers()[1], np.int64)[given.offset : given.offset + len(given) + 1]
            data = given.buffers()[2].to_pybytes() if given.buffers()[2] else b""
            codes = b.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
            parts, ends, size = [], [np.zeros(1, np.int64)], 0
            for low, high in zip(cuts, cuts[1:]):
                name = b.column(key)[low].as_py()
                if held and name != current:
                    yield left()
                    held = b""
                current = name
                text, at, held = _texts(held, data[offsets[low] : offsets[high]], offsets[low + 1 : high + 1] - offsets[low])
                parts.append(text)
                ends.append(at + size)
                size += len(text)
            texts = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(np.concatenate(ends)), pa.py_buffer(b"".join(parts))).cast(pa.string())
            made = pa.RecordBatch.from_arrays([b.column(key), b.column(seq), texts], schema=types)
            yield made.filter(pc.greater(pc.binary_length(texts), 0))
        if held:
            yield left()

    return rows.mapInArrow(run, f"{key} {kinds[0]}, {seq} {kinds[1]}, text string")
