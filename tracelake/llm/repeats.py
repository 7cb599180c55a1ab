"""Distribution of the search for repeated fixed-length windows; the search itself is the caller's.

Shared by the byte-level and the word-level substring removal.  A text is a sequence of symbols
(bytes or words); a *window* is ``length`` consecutive symbols of one text.  The method chooses an
*anchor* for each window, a shorter gram inside it, by the window's symbols alone, so that equal
windows have equal anchors at equal places.  Consecutive windows with the same anchor form a *unit*,
and units with the same symbols and anchor place are of one *kind*.

* A unit whose anchor occurs once in the corpus has no repeated window (most of the corpus).
* All windows of a kind that occurs twice are repeated (copies, common passages).
* Kinds that share an anchor and differ are compared: one unit of each travels, as a packed string,
  to the bucket of its anchor, where the method finds equal windows by sorting.

A bucket with more than ``most`` kinds is dealt out anew by longer anchors: windows that reach far to
the left of the anchor get it lengthened to the left, the others to the right.  Equal windows stay
together, and an anchor as long as a window leaves one kind in its bucket, so a few rounds of the
same method bound every bucket, whatever its size.

Kinds are told apart by a 64-bit hash among the units of one anchor; what is compared is compared by
its symbols.  Rows are identified by ``doc_id`` and a hash of the text, so rows that repeat (id and
text alike) count as separate occurrences and get equal results; two of them are searched, however
many there are.  A text may have up to 2**28 symbols; a longer one stops the job with a message.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut, stored
from .text import U64, batches_of, mix, powers, run_hashes

NO_ID = -(1 << 63)
POSITION_BITS = U64(28)
POSITION = (U64(1) << POSITION_BITS) - U64(1)
#: Bytes of packed strings that are compared at a time, where buckets allow.
FLUSH_BYTES = 1 << 18


@dataclass(frozen=True)
class Method:
    """What tells the two removals apart."""

    length: int
    gram: int
    #: (values of symbols, offsets of texts in symbols) of a slice of a column, and where it starts.
    symbols: Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray]]]
    #: (gram hashes, window starts) -> place of each window's anchor; starts rise.
    anchors: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: The symbols of a text, cut out of it by (first, count): packed strings.
    pack: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]
    #: Part of a packed string, from symbol to symbol.
    part: Callable[[bytes, int, int], bytes]
    #: (packed strings, anchor offsets, anchor lengths, windows) -> flag of each window.
    repeated: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` symbols from each place on."""
    n = len(values)
    if n < gram:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n), out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * powers(n + 1, inverse=True)[: n - gram + 1])


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of the ``width`` hashes from each place on stands (the first, of equal ones)."""
    least = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & POSITION).astype(np.int64)


def code(first: np.ndarray, offset: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A unit within its text: first window, place of the anchor in it, windows; the last two below 256."""
    return (first << 16) | (offset << 8) | windows


def units(values: np.ndarray, offsets: np.ndarray, method: Method) -> tuple[np.ndarray, ...]:
    """(text, code, anchor hash, content hash) of each unit of a slice."""
    length = method.length
    size = np.diff(offsets)
    usable = np.flatnonzero(size >= length)
    empty = np.zeros(0, np.int64)
    if not len(usable):
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    if len(values) >= 1 << 28:
        raise ValueError("a text of 2**28 symbols or more can't be searched for repeats")
    h = gram_hashes(values, method.gram)
    count = size[usable] - length + 1
    first = offsets[usable]
    text = np.repeat(usable, count)
    starts = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
    anchor = method.anchors(h, starts)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    edge = np.flatnonzero(new)
    windows = np.diff(np.append(edge, len(anchor)))
    begin, at, owner = starts[edge], anchor[edge], text[edge]
    content = run_hashes(values, begin, begin + windows - 1 + length) + mix((at - begin).astype(np.uint64) + U64(1))
    return owner, code(begin - offsets[owner], at - begin, windows), h[at], content


def dense_suffix_ranks(values: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Suffix array as ranks: order of the string from each place to its end, ``length`` symbols at most.

    ``ends`` gives for each place the end of its string; equal ranks mean equal strings.  Symbols are
    small numbers; as many as a 64-bit number holds are ranked at once, then prefixes double.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n)
    bits = max(1, int(values.max() + 1).bit_length())
    span = min(length, 63 // bits)
    padded = np.append(values.astype(np.uint64) + U64(1), np.zeros(span, np.uint64))
    packed = np.zeros(n, np.uint64)
    for i in range(span):
        packed = (packed << U64(bits)) | np.where(place + i < ends, padded[i : i + n], U64(0))
    rank = np.unique(packed, return_inverse=True)[1]
    longest = min(length, int((ends - place).max()))
    while span < longest:
        step = min(span, length - span)
        after = np.append(rank + 1, np.zeros(step, rank.dtype))[step : step + n]
        after[place + step >= ends] = 0
        rank = np.unique(rank.astype(np.uint64) * U64(n + 1) + after.astype(np.uint64), return_inverse=True)[1]
        span += step
    return rank


def _unit_rows(docs: DataFrame, method: Method) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, values, offsets in method.symbols(b.column("text")):
                owner, at, anchor, content = units(values, offsets, method)
                for low in range(0, len(owner), 1 << 16):
                    some = slice(low, low + (1 << 16))
                    take = pa.array(owner[some] + row)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc").take(take), b.column("h").take(take), pa.array(at[some]), pa.array(anchor[some].view(np.int64)), pa.array(content[some].view(np.int64))],
                        ["doc", "h", "at", "anchor", "content"],
                    )

    return docs.mapInArrow(run, "doc long, h long, at long, anchor long, content long")


#: Kinds on their way to comparison: where the unit stands (its code counts from the unit's own
#: first window), how long its anchor is, whether it is already known to be repeated, and its symbols.
KIND = "doc long, h long, at long, anchor long, gram int, known boolean, packed binary"
KIND_NAMES = [f.split()[0] for f in KIND.split(", ")]


def _packed(chosen: DataFrame, method: Method) -> DataFrame:
    """Packed strings of the units that must be compared: one row per unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1 << 20, "text"):
            for i in range(b.num_rows):
                wanted = b.column("wanted")[i].as_py()
                at = np.array([m["at"] for m in wanted], np.int64)
                strings = method.pack(b.column("text")[i].as_py().encode(), at >> 16, (at & 255) - 1 + method.length)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, b.column("doc")[i].as_py())), pa.array(np.full(n, b.column("h")[i].as_py())), pa.array(at),
                        pa.array([m["anchor"] for m in wanted], pa.int64()), pa.array(np.full(n, method.gram, np.int32)),
                        pa.array([m["known"] for m in wanted], pa.bool_()), pa.array(strings, pa.binary()),
                    ],
                    KIND_NAMES,
                )

    return chosen.mapInArrow(run, KIND)


def lengthened(packed: bytes, first: int, offset: int, windows: int, gram: int, method: Method) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """A unit as at most two with longer anchors: (first, offset, windows, gram, anchor, packed).

    A window reaches ``left`` symbols to the left of its anchor, from 0 to length - gram.
    """
    slack = method.length - gram
    reach = (slack + 1) // 2
    # Windows from 0 to offset - reach have at least ``reach`` symbols to the left.
    far = max(0, min(windows, offset - reach + 1))
    if far:
        at = offset - reach
        yield first, at, far, gram + reach, b"<" + method.part(packed, at, offset + gram), method.part(packed, 0, far - 1 + method.length)
    if far < windows:
        at, more = offset - far, slack - reach + 1
        rest = method.part(packed, far, windows - 1 + method.length)
        yield first + far, at, windows - far, gram + more, b">" + method.part(rest, at, at + gram + more), rest


def _dealt_anew(kinds: DataFrame, method: Method) -> DataFrame:
    """Kinds of large buckets under longer anchors; of equal ones a single one stays, known if two were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1 << 20, "packed"):
            rows = []
            for doc, h, at, _, gram, known, packed in zip(*(b.column(c).to_pylist() for c in KIND_NAMES)):
                for first, offset, windows, longer, anchor, part in lengthened(packed, at >> 16, (at >> 8) & 255, at & 255, gram, method):
                    rows.append((doc, h, (first << 16) | (offset << 8) | windows, anchor, longer, known, part))
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], KIND_NAMES)

    parts = kinds.mapInArrow(run, KIND.replace("anchor long", "anchor binary"))
    return parts.withColumn("anchor", F.xxhash64("anchor"))


def _once_each(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one unit of each kind, units that are repeated as a whole because their kind occurs twice)."""
    offset = F.shiftright("at", 8).bitwiseAND(255).alias("offset")
    each = kinds.groupBy("anchor", "gram", offset, "packed").agg(
        F.min(F.struct("doc", "h", "at")).alias("one"), F.count("*").alias("n"), F.max("known").alias("known"), F.count_if(~F.col("known")).alias("unknown")
    )
    held = cut(each)
    one = held.select("one.doc", "one.h", "one.at", "anchor", "gram", (F.col("known") | (F.col("n") > 1)).alias("known"), "packed")
    several = held.filter("n > 1 and unknown > 0").select("anchor", "gram", "offset", "packed")
    told = kinds.withColumn("offset", offset).join(several, ["anchor", "gram", "offset", "packed"], "left_semi").filter(~F.col("known"))
    return one, told.select("doc", "h", "at")


def _runs(flagged: np.ndarray, first: int) -> list[int]:
    """Flagged windows as run codes (start * 256 + windows), windows at most 255."""
    places = np.flatnonzero(flagged)
    if not len(places):
        return []
    edge = np.flatnonzero(np.append(True, np.diff(places) != 1))
    return ((places[edge] + first) * 256 + np.diff(np.append(edge, len(places)))).tolist()


def _compared(kinds: DataFrame, method: Method) -> DataFrame:
    """Runs of repeated windows of kinds that occur once; rows must come sorted by anchor."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        doc, h, at, _, gram, known, packed = zip(*rows)
        codes = np.array(at, np.int64)
        windows = codes & 255
        flags = method.repeated(list(packed), (codes >> 8) & 255, np.array(gram, np.int64), windows)
        end = np.cumsum(windows)
        found = [(doc[i], h[i], r) for i in range(len(rows)) if not known[i] and (r := _runs(flags[end[i] - windows[i] : end[i]], int(codes[i] >> 16)))]
        columns = list(zip(*found)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], ["doc", "h", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for b in batches_of(batches, 1 << 20, "packed"):
            for row in zip(*(b.column(c).to_pylist() for c in KIND_NAMES)):
                if size > FLUSH_BYTES and row[3] != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
                last = row[3]
        if rows:
            yield flush(rows)

    return kinds.mapInArrow(run, "doc long, h long, runs array<long>")


def member_bits(rows: DataFrame) -> np.ndarray | None:
    """A bitmap of fixed size (1 MB) of the column ``p`` (below 2**23) of ``rows``; none for no rows."""
    filled = rows.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("v")).collect()
    if not filled:
        return None
    bitmap = np.zeros(1 << 20, np.uint8)
    for bucket, bits in filled:
        bitmap[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return bitmap


def _place() -> Column:
    return F.pmod(F.xxhash64("doc", "h"), F.lit(1 << 23)).alias("p")


def _rows_with(docs: DataFrame, bitmap: np.ndarray, bit: int) -> DataFrame:
    """Rows (doc, h, text) of ``docs`` whose bit is ``bit``, so that only texts in question travel."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array(b.column("p").to_numpy(zero_copy_only=False), np.int64)
            found = (shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            yield b.select(["doc", "h", "text"]).filter(pa.array(found == bit))

    return docs.select("doc", "h", "text", _place()).mapInArrow(run, "doc long, h long, text string")


def _twice_at_most(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, h, text), of those repeated with id and text two each, and one each.

    Two occurrences make a window repeated, and more change nothing, so results stay exact.
    """
    bitmap = member_bits(docs.groupBy("doc", "h").agg(F.count("*").alias("n")).filter("n > 1").select(_place()))
    if bitmap is None:
        return docs, docs
    several = _rows_with(docs, bitmap, 1).groupBy("doc", "h").agg(F.min("text").alias("text"), F.least(F.count("*"), F.lit(2)).cast("int").alias("n"))
    single = _rows_with(docs, bitmap, 0)
    doubled = several.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc", "h", "text")
    return single.unionByName(doubled), single.unionByName(several.select("doc", "h", "text"))


def repeated_windows(documents: DataFrame, method: Method, most: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(documents keyed by doc and h, with their text and doc_id; runs of repeated windows by doc and h).

    Rows without an id share the key of the least id; their runs go by the text, so they may.
    A run is coded as first window * 256 + number of windows.  ``most`` bounds the kinds of a bucket.
    """
    text = F.coalesce(documents["text"], F.lit(""))
    own = documents["doc_id"].cast("long")
    docs = documents.select(F.coalesce(own, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"), own.alias("doc_id"))
    held, distinct = _twice_at_most(docs.select("doc", "h", "text"))
    rows = _unit_rows(held, method)
    # Stored, so that a common anchor makes a skewed join of two exchanges, which adaptive execution splits.
    seen = stored(
        rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        .filter("n > 1").select(F.col("anchor").alias("a"), (F.col("lo") != F.col("hi")).alias("differ"))
    )
    # Of units that agree with all others under their anchor, the place is enough.
    differ = lambda name: F.when(F.col("differ"), F.col(name)).alias(name)
    hits = stored(rows.join(seen, F.col("anchor") == F.col("a")).select("doc", "h", "at", differ("anchor"), differ("content")))
    run = (F.shiftright("at", 16) * 256 + F.col("at").bitwiseAND(255)).alias("run")
    agreed = hits.filter("anchor is null").select("doc", "h", run)
    differing = hits.filter("anchor is not null")
    kinds = stored(
        differing.groupBy("anchor", "content").agg(F.min(F.struct("doc", "h", "at")).alias("one"), (F.count("*") > 1).alias("known"))
    )
    # Null for units whose kind occurs once: those are compared.
    copies = differing.join(kinds.select("anchor", "content", "known"), ["anchor", "content"]).select("doc", "h", F.when(F.col("known"), run).alias("run"))

    chosen = kinds.groupBy("one.doc", "one.h").agg(F.collect_list(F.struct("one.at", "anchor", "known")).alias("wanted"))
    wanted = member_bits(chosen.select(_place()))
    if wanted is None:
        return docs, agreed.groupBy("doc", "h").agg(F.collect_list("run").alias("runs"))
    ready = _packed(_rows_with(distinct, wanted, 1).join(chosen, ["doc", "h"]), method)
    compared, told = [], []
    while True:
        ready = stored(ready)
        large = ready.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("anchor")
        large = cut(large)
        if large.isEmpty():
            compared.append(ready)
            break
        compared.append(ready.join(large, "anchor", "left_anti"))
        ready, whole = _once_each(cut(_dealt_anew(ready.join(large, "anchor", "left_semi").select(*KIND_NAMES), method)))
        told.append(whole.select("doc", "h", run))
    settled = [_compared(c.select(*KIND_NAMES).repartition("anchor").sortWithinPartitions("anchor"), method) for c in compared]
    singles = agreed.unionByName(copies)
    for t in told:
        singles = singles.unionByName(t)
    gathered = singles.groupBy("doc", "h").agg(F.collect_list("run").alias("runs"))
    for s in settled:
        gathered = gathered.unionByName(s)
    return docs, gathered.groupBy("doc", "h").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def covered(runs: list[int] | None, n: int, length: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a repeated window."""
    steps = np.zeros(n + 1, np.int64)
    codes = np.array(runs or [], np.int64)
    first = codes >> 8
    np.add.at(steps, first, 1)
    np.add.at(steps, first + (codes & 255) - 1 + length, -1)
    return np.cumsum(steps[:n]) > 0
