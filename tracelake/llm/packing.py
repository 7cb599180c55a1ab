"""Best-fit packing planned on the length histogram.

Documents become pieces of at most ``capacity`` tokens.  Which lengths share a sequence depends only
on how many pieces there are of each length, at most ``capacity`` counts: best-fit decreasing runs
on those counts, moving whole groups of equal sequences at a time.  The plan says, for runs of rank
within a length, which sequences and offset they take; pieces find their slots by joining on length
and rank, in stretches of 65,536 ranks, so that a common length is many keys.  Ranks come from per-task counts and their running sums, so no length is gathered in one
task.

Defined results: a null or empty text is a document of the end token alone; a text longer than the
capacity is cut into full pieces and a rest; repeated rows (even with equal ``doc_id``) are packed
one by one; a null ``doc_id`` is passed through; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut
from .text import batches_of, slices

#: Space, tab and line ends are the same blank; the tokenizer lower-cases anyway.
BLANK = np.arange(256, dtype=np.uint8)
BLANK[[0x09, 0x0A, 0x0D]] = 0x20
BLANK[0x41:0x5B] += 0x20
#: ASCII letters and digits, and the other visible ASCII characters.
WORDLIKE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))
SIGN = ~WORDLIKE & (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)


def blanked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one kind of blank, and a blank between a letter or digit and a sign.

    The tokenizer always ends a token there, and looks at nothing before a token's start.
    """
    data = BLANK[data]
    before = np.flatnonzero(WORDLIKE[data[:-1]] & SIGN[data[1:]]) + 1
    return np.insert(data, before, 0x20), offsets + np.searchsorted(before, offsets)


#: Letters that stay one token run through the normaliser: small ones of ASCII and Latin-1.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> list[str]:
    """The visible characters that stand for the 256 bytes in the vocabulary, in the usual byte-level order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Ids by the ``tokenizers`` library, memoised by blank-separated chunk.

    The tokenizer file drops white space and never joins across it, so a text's ids are those of
    its chunks one after the other.  A chunk of letters alone is one word and goes to the library's
    model at once; others pass its whole chain.  Texts that hold the string of a special token go to
    the library whole, since it cuts them there first.  The memo has two halves of a fixed size: when
    the newer is full it replaces the older, so that frequent chunks, which move to the newer, stay known.
    """

    def __init__(self, path: str, memo: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.letters = byte_letters()
        self.limit = memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word_ids(self, word: str) -> bytes:
        """Ids of a word of letters."""
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those not known yet go to the library."""
        found = list(map(self.memo.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if len(self.memo) + len(missing) > self.limit // 2:
            self.memo, self.older = {}, self.memo
        memo, older, letters, unknown = self.memo, self.older, LETTERS.fullmatch, []
        for i in missing:
            chunk = chunks[i]
            ids = older.get(chunk)
            if ids is None:
                if not letters(chunk):
                    unknown.append(i)
                    continue
                ids = self.word_ids(chunk)
            found[i] = memo[chunk] = ids
        for low in range(0, len(unknown), 2_000):
            part = unknown[low : low + 2_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)):
                found[i] = memo[chunks[i]] = array("I", e.ids).tobytes()
        return found

    def texts_ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        special = pc.fill_null(pc.match_substring_regex(column, self.special), False)
        if not pc.any(special).as_py():
            yield from self.plain_ids(column)
            return
        plain = self.plain_ids(column.filter(pc.invert(special)))
        for text, whole in zip(column.to_pylist(), special.to_pylist()):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4") if whole else next(plain)

    def plain_ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of texts without special strings: the distinct chunks of a slice are encoded once, and gathered."""
        for _, _, data, offsets in slices(column, 1 << 20):
            data, offsets = blanked(data, offsets)
            buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
            parts = pc.split_pattern(pa.LargeStringArray.from_buffers(len(offsets) - 1, buffers[1], buffers[2]), " ")
            chunks = parts.flatten().dictionary_encode()
            encoded = self.chunk_ids(chunks.dictionary.to_pylist())
            size = np.fromiter(map(len, encoded), np.int64, len(encoded)) >> 2
            table = np.frombuffer(b"".join(encoded), "<u4")
            index = chunks.indices.to_numpy()
            n = size[index]
            before = np.append(0, np.cumsum(n))
            at = np.repeat((np.cumsum(size) - size)[index] - before[:-1], n) + np.arange(before[-1])
            flat = table[at]
            edge = before[np.asarray(parts.offsets)]
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield flat[low:high]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


#: Ranks within a length are joined in stretches of two to this power.
STRETCH = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def cut_pieces(documents: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces with their checksum, and their rank among the pieces of that length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = tokenizer(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches_of(batches, 1 << 20, "text"):
            rows: list[tuple] = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), words.texts_ids(batch.column("text"))):
                ids = found.tobytes() + end
                for k, low in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[low : low + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, k, low // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * 7
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"]).mapInArrow(run, PIECES)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: rows (length, first rank, pieces, first sequence, offset).

    Open sequences are kept as runs of consecutive numbers by the room they have left.  The next
    pieces always go where the least room remains that holds them; new sequences are opened only
    when no room does.  Rooms are integers up to ``capacity``, so the plan stays small.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []  # sorted rooms that have open sequences
    sequences = 0

    def reopen(room: int, first: int, n: int) -> None:
        if room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    rooms.pop(k)
                take = min(n, left)
                if take < n:
                    reopen(room, first + take, n - take)
                plan.append((length, rank, take, first, capacity - room))
                reopen(room - length, first, take)
                rank, left = rank + take, left - take
            else:  # as many new sequences as are filled with this length alone, then the rest
                per = capacity // length
                full, rest = divmod(left, per)
                for n, deep in ((full, per), (1 if rest else 0, rest)):
                    for j in range(deep if n else 0):
                        plan.append((length, rank, n, sequences, j * length))
                        rank += n
                    if n:
                        reopen(capacity - deep * length, sequences, n)
                        sequences += n
                left = 0
    return plan


def pack(documents: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = documents.sparkSession
    pieces = cut(cut_pieces(documents, path, capacity, end_id))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.select(
        "length", "task",
        (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    # At most ``capacity`` rows reach the driver, and the plan that goes back is bounded by them.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    rows = plan_slots(histogram, capacity)
    plan = spark.createDataFrame(
        pa.table(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)],
            ["p_length", "first_rank", "n", "first_sequence", "slot_offset"],
        )
    )
    last = F.col("first_rank") + F.col("n") - 1
    plan = plan.withColumn("p_stretch", F.explode(F.sequence(F.shiftright("first_rank", STRETCH), F.shiftright(last, STRETCH))))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    ranked = ranked.withColumn("stretch", F.shiftright("rank", STRETCH))
    same = (F.col("length") == F.col("p_length")) & (F.col("stretch") == F.col("p_stretch"))
    inside = same & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") <= last)
    placed = ranked.join(F.broadcast(plan) if len(rows) <= 500_000 else plan, inside)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("slot_offset").alias("offset"),
    )
