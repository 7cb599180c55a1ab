"""Periodic runs of words, found by matching aligned blocks and extended exactly.

A run is a stretch of words with smallest period q that has ``max(least, times * q)`` words at least
and that no neighbouring word continues.

1. Words are numbered by their bytes, slice by slice.  Within a run every eight words in a row occur
   twice in their document at least (three times the period and 24 words are enough for that), so
   only stretches of such words are searched; they are found by ranking pairs, fours and eights.
2. For each power of two B from 8 on, the stretch is cut into aligned blocks of B words.  The distinct
   blocks are the keys (integer sequences) of an automaton, which reports where they stand in the
   stretch.  A run with a period from B to 2B - 1 holds a whole aligned block that stands again one
   period later; for B = 8 the periods from 1 on are taken too.
3. A block and its occurrence at such a distance are a seed, extended word by word in both directions.
   Seeds go by rising period; those within a run already known have a smaller period and are left out,
   so long runs take linear time at each scale.  Automata are built for 65,536 words of blocks at a time.

Defined results: null and empty texts, and texts without words, have no runs; equal rows have equal
results; rows without an id keep a null id; other columns are ignored; an empty table gives an empty
result.  Memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import slices, word_bounds, word_codes

LEAST = 24
TIMES = 3
SMALLEST = 8
#: Words whose aligned blocks are keys of one automaton (more where the blocks themselves are longer).
GROUP = 1 << 16
SLICE = 1 << 22

Run = tuple[int, int, int]  # start, length, period


def _equal(w: np.ndarray, at: int, q: int, limit: int, step: int) -> int:
    """Words from ``at`` on, in the direction ``step``, that equal those q before (1) or behind (-1)."""
    done, size = 0, 32
    while done < limit:
        size = min(size, limit - done)
        low = at + done if step > 0 else at - done - size + 1
        same = w[low : low + size] == w[low - step * q : low - step * q + size]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done, size = done + size, 2 * size
    return done


def _seeds(w: np.ndarray, low: int, high: int, size: int, reach: np.ndarray) -> list[tuple[int, int]]:
    """(period, block start) for aligned blocks that occur again at a distance of this scale."""
    shortest, longest = (1 if size == SMALLEST else size), 2 * size - 1
    group, out = max(GROUP, 4 * size), []
    for begin in range(low, high - size + 1, group):
        keys: dict[tuple[int, ...], int] = {}
        key_at: dict[int, int] = {}
        for x in range(begin, min(begin + group, high - size + 1), size):
            if reach[x] < x + 3 * size:  # else all that starts here lies within a run with a smaller period
                key_at[x] = keys.setdefault(tuple(w[x : x + size].tolist()), len(keys))
        if not keys:
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for block, k in keys.items():
            automaton.add_word(block, k)
        automaton.make_automaton()
        recent: dict[int, list[int]] = defaultdict(list)
        for end, k in automaton.iter(tuple(w[begin : min(high, begin + group + 3 * size)].tolist())):
            y = begin + end - size + 1
            if held := recent[k]:
                while held and y - held[0] > longest:
                    held.pop(0)
                out += [(y - x, x) for x in held if y - x >= shortest]
            if key_at.get(y) == k:
                held.append(y)
    return sorted(out)


def runs_within(w: np.ndarray, low: int, high: int) -> list[Run]:
    """Runs of the document ``w`` (word numbers) that lie in the stretch ``low`` to ``high``."""
    out: list[Run] = []
    reach = np.zeros(len(w) + 1, np.int64)  # end of a known run that covers a place
    size = SMALLEST
    while high - low >= max(LEAST, TIMES * (1 if size == SMALLEST else size)):
        for q, x in _seeds(w, low, high, size, reach):
            if reach[x] >= x + q + size:
                continue
            start = x - _equal(w, x - 1, q, x, -1)
            end = x + q + size + _equal(w, x + q + size, q, len(w) - x - q - size, 1)
            if end - start >= max(LEAST, TIMES * q) and reach[start] < end:
                out.append((start, end - start, q))
                np.maximum(reach[start:end], end, out=reach[start:end])
        size *= 2
    return out


def stretches(code: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of stretches that may hold runs: all eights of words in them occur twice in their document."""
    if len(code) < LEAST:
        return []
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank, often = document * (int(code.max()) + 1) + code, np.zeros(0)
    for width in (1, 2, 4, 8):
        if width > 1:
            # A row of words that crosses documents holds ranks of both, so it occurs once.
            rank = rank[: -width // 2] * len(code) + rank[width // 2 :]
        _, rank, count = np.unique(rank, return_inverse=True, return_counts=True)
        often = count[rank] > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
    bounds = zip(edge[::2].tolist(), (edge[1::2] + SMALLEST - 1).tolist())
    return [(a, z) for a, z in bounds if z - a >= LEAST]


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """The words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def looped(code: np.ndarray, doc_id: int) -> np.ndarray:
    """The words of every tenth document, by checksum of its id, with a loop from some place on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(code)
    if h % 10 or not n:
        return code
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return np.append(code[:a], code[a + np.arange(n - a) % p])


def scan(texts: pa.Array, ids: list[int | None], loops: bool) -> Iterator[tuple[list[Run], int, bytes]]:
    """Runs by start and period, number of words, and the kept words joined by one space, of each text."""
    for row, _, data, offsets in slices(texts, SLICE):
        starts, ends, first = word_bounds(data, offsets)
        code, words = word_codes(data, starts, ends)
        names = np.array(words.cast(pa.large_binary()).to_pylist() + [None], object)
        if loops:
            for k in range(len(first) - 1):
                if ids[row + k] is not None:
                    code[first[k] : first[k + 1]] = looped(code[first[k] : first[k + 1]], ids[row + k])
        by_document: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for low, high in stretches(code, first):
            by_document[int(np.searchsorted(first, low, side="right")) - 1].append((low, high))
        for k in range(len(first) - 1):
            own = code[first[k] : first[k + 1]]
            runs: set[Run] = set()
            for low, high in by_document.get(k, ()):
                runs.update(runs_within(own, low - int(first[k]), high - int(first[k])))
            found = sorted(runs, key=lambda r: (r[0], r[2]))
            kept = own[~dropped(len(own), found)] if found else own
            yield found, len(own), b" ".join(names[kept])


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text"))


def collapse_runs(documents: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words) and the text with one period of each run kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            rows = [([dict(zip(("start", "length", "period"), r)) for r in runs], kept.decode()) for runs, _, kept in scan(b.column("text"), [None] * b.num_rows, False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "runs", "collapsed"])

    return _columns(documents).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(documents: DataFrame, loops: bool = True) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, and digests of all runs and of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(7)]
            for runs, _, kept in scan(b.column("text"), b.column("doc_id").to_pylist(), loops):
                best = None
                for r in runs:  # by start, then period
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                values = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                for c, v in zip(columns, values):
                    c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *DIGESTS])

    return _columns(documents).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in DIGESTS))


DIGESTS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
