"""Names and secrets kept in a table: found in texts, and replaced, whatever the size of the table.

A small table (by a check of its bytes) becomes an automaton in each task.  A larger one is joined: of
each name's widest grams (the whole name up to eight code points) the one that is rarest in the texts
stands for it.  Texts are dealt into chunks of a few megabytes, and a chunk meets the names whose gram it
holds, each once however often it stands there; they become the automaton of that chunk alone.  Where
places are few, each goes to its text instead.  All ways give the same hits, and the plan does not grow
with the table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Most bytes of names that a task takes as a whole; as an automaton they take some forty times that.
MOST_BYTES = 1 << 20
#: Bytes of texts of a chunk, and bytes of texts for each place where a name may begin from which on places are few.
CHUNK, FEW = 2 << 20, 1 << 10
#: Code points of grams; a name's is the widest that it holds, three quarters of it at least up to 64.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64)
#: Bytes of texts that a task holds as Python strings at a time, and a sixteenth as many candidates.
SLICE = 1 << 18
#: Bits of the bitmap of grams: for each gram, fewest (1 MB) and most (64 MB), and how many of them stand for a gram.
BITS_A_GRAM, BITS, MOST_BITS, PROBES = 32, 1 << 23, 1 << 29, 6
HITS = "array<struct<start:int,end:int,name:string,value:string>>"
_HIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("value", pa.string())])
_PLAIN, _PERSON = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("name", "person")
#: Makes other grams of whole names that must stand free on both sides; texts hold them only where they do.
_FREE = np.uint64(0xA24BAED4963EE407)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _wide(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯"


def free(text: str, start: int, end: int, kind: str | None, strict: bool) -> bool:
    """Whether a name stands free: by no ASCII letter or digit, a person's name also not before other writing."""
    before, after = text[start - 1 : start], text[end : end + 1]
    plain = lambda c: c.isascii() and c.isalnum()
    if kind is None:
        return True
    person = kind in _PERSON
    if plain(before) or plain(after) and (not person or strict):
        return False
    return not person or not (_wide(after) or (strict and _wide(before)))


def chosen(hits: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of overlapping hits the earlier, of equal starts the longer."""
    out, done = [], 0
    for h in sorted(hits, key=lambda h: (h[0], -h[1])):
        if h[0] >= done:
            out.append(h)
            done = h[1]
    return out


def _keys(points: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, 64-bit keys of the grams of that width at each place), for widths up to ``most``.

    A gram's key is made of the keys of its two ends, which together cover it.
    """
    key, width = (points.astype(np.uint64) + _ODD[0]) * _ODD[1], 1
    key ^= key >> np.uint64(29)
    for w in WIDTHS:
        if w > most or w > len(points):
            return
        if w > width:
            n, skip = len(points) - w + 1, w - width
            key = ((key[:n] ^ np.uint64(w)) * _ODD[2]) ^ (key[skip : skip + n] * _ODD[3])
            key = (key ^ (key >> np.uint64(31))) * _ODD[0]
            key ^= key >> np.uint64(29)
            width = w
        yield w, key


def _width(length: int) -> int:
    """The widest gram of a name."""
    return WIDTHS[bisect_right(WIDTHS, length) - 1]


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _few(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``limit`` bytes of a string column, or elements of a list; a larger value is a batch of its own."""
    for b in batches:
        values = b.column(column)
        count = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
        ends = np.cumsum(pc.fill_null(count(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low, done = 0, 0
        while low < b.num_rows:
            high = min(max(low + 1, int(np.searchsorted(ends, done + limit, side="right"))), b.num_rows)
            yield b.slice(low, high - low)
            low, done = high, int(ends[high - 1])


def _plain(points: np.ndarray) -> np.ndarray:
    """Which code points are ASCII letters or digits."""
    low = points | np.uint32(32)
    return ((points >= 48) & (points <= 57)) | ((low >= 97) & (low <= 122))


def _bits(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the column ``gram``, whose size follows the ``count`` of grams: rows of 4 KB, 64 MB at most.

    Every gram sets ``PROBES`` bits, so that few places of texts pass which no name shares.
    """
    bits = min(max(BITS, 1 << (BITS_A_GRAM * count - 1).bit_length()), MOST_BITS)
    within = lambda c: c.bitwiseAND(F.lit(bits - 1).cast("long"))
    low, step = within(F.col("gram")), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    at = keys.select(F.explode(F.array(*[within(low + step * i) + 1 for i in range(PROBES)])).alias("p"))
    found = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("v")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for bucket, filled in found:
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(filled, np.uint8)
    return out


def _set(bitmap: np.ndarray, key: np.ndarray, probe: int) -> np.ndarray:
    """Whether a bit that stands for each gram is set; see ``_bits``."""
    most = np.uint64(8 * len(bitmap) - 1)
    p = (((key & most) + (key >> np.uint64(32) | np.uint64(1)) * np.uint64(probe)) & most if probe else key & most).astype(np.int64)
    return ((bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)


def _places(rows: DataFrame, bitmap: np.ndarray, widths: set[int], counts: bool) -> DataFrame:
    """(chunk, gram, n) counted by slice, or (id, at, gram), of the grams of texts that are in the bitmap."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # 64 MB at most
    most = max(widths, default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            first = np.cumsum(size) - size
            left = np.repeat(first + size, size) - np.arange(size.sum())  # code points to the end of the text
            ats, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            points = _points(texts)
            plain = np.append(_plain(points), False)
            inner = np.append(False, plain[:-1])  # after an ASCII letter or digit of the same text
            inner[first[size > 0]] = False
            for width, key in _keys(points, most):
                if width in widths:
                    within = left[: len(key)] >= width
                    ends = np.flatnonzero(within & ~inner[: len(key)])
                    ends = ends[~plain[ends + width] | (left[ends] == width)]
                    for at, own in ((np.flatnonzero(_set(shared.value, key, 0) & within), key), (ends, key ^ _FREE)):
                        for probe in range(PROBES):
                            at = at[_set(shared.value, own[at], probe)]
                        ats.append(at)
                        grams.append(own[at])
            at, gram = np.concatenate(ats), np.concatenate(grams)
            of = np.repeat(np.arange(len(texts)), size)[at]
            if counts:
                chunk = b.column("chunk").to_numpy()[of]
                for c in np.unique(chunk):
                    own, n = np.unique(gram[chunk == c], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(own), c)), "gram": pa.array(own.view(np.int64)), "n": pa.array(n.astype(np.int64))})
            else:
                yield pa.RecordBatch.from_pydict({"id": b.column("id").take(pa.array(of)), "at": pa.array((at - first[of]).astype(np.int32)), "gram": pa.array(gram.view(np.int64))})

    kind = rows.schema["id"].dataType.simpleString().replace("bigint", "long")
    return rows.mapInArrow(run, "chunk long, gram long, n long" if counts else f"id {kind}, at int, gram long")


def _name_grams(names: DataFrame) -> DataFrame:
    """(name, value, kind, width, gram, off) for every gram of each name of its widest width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, "name"):
            listed = b.column("name").to_pylist()
            size = np.array([len(n) for n in listed], np.int64)
            first = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(listed)), size)
            left = first[owner] + size[owner] - np.arange(len(owner))
            own = np.array([_width(n) for n in size.tolist()])[owner]
            alone = np.array([k is not None and k not in _PERSON for k in b.column("kind").to_pylist()], bool)
            of, off, wide, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for width, key in _keys(_points(listed), int(own.max(initial=0))):
                at = np.flatnonzero((own[: len(key)] == width) & (left[: len(key)] >= width))
                of.append(owner[at])
                off.append(at - first[owner[at]])
                wide.append(np.full(len(at), width))
                gram.append(np.where(alone[owner[at]] & (size[owner[at]] == width), key[at] ^ _FREE, key[at]))
            take = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_pydict(
                {c: b.column(c).take(take) for c in ("name", "value", "kind")} | {"width": pa.array(np.concatenate(wide).astype(np.int32)), "gram": pa.array(np.concatenate(gram).view(np.int64)), "off": pa.array(np.concatenate(off).astype(np.int32))}
            )

    return names.mapInArrow(run, "name string, value string, kind string, width int, gram long, off int")


def _automaton(names: list[tuple[str, str | None, str | None]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for name, value, kind in names:
        automaton.add_word(name, (name, value, kind))
    automaton.make_automaton()
    return automaton


def _scanned(b: pa.RecordBatch, automaton: ahocorasick.Automaton, strict: bool) -> pa.RecordBatch:
    """The batch with the hits of its texts: ``chosen`` of those that are ``free``, without a call for each."""
    out = []
    for text in b.column("text").to_pylist():
        hits, size = [], len(text or "")
        for last, (name, value, kind) in automaton.iter(text) if text and len(automaton) else ():
            end = last + 1
            start = end - len(name)
            if kind is not None:
                if start and text[start - 1] in _PLAIN:
                    continue
                if kind in _PERSON:
                    if not free(text, start, end, kind, strict):
                        continue
                elif end < size and text[end] in _PLAIN:
                    continue
            hits.append((start, -end, name, value))
        hits.sort()  # no two have the same start and end
        own, done = [], 0
        for start, end, name, value in hits:
            if start >= done:
                done = -end
                own.append((start, done, name, value))
        out.append(own)
    return _batch(b, out)


def _by_automaton(rows: DataFrame, names: DataFrame, strict: bool) -> DataFrame:
    table = names.toArrow().to_pylist()  # bounded by the caller's check
    shared = rows.sparkSession.sparkContext.broadcast([(r["name"], r["value"], r["kind"]) for r in table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for b in _few(batches, "text"):
            yield _scanned(b, automaton, strict)

    return rows.mapInArrow(run, _schema(rows))


def _batch(b: pa.RecordBatch, hits: list[list[tuple]]) -> pa.RecordBatch:
    columns = list(zip(*(h for own in hits for h in own))) or [()] * 4
    fields = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIT)], fields=list(_HIT))
    ends = pa.array(np.cumsum([0, *map(len, hits)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.ListArray.from_arrays(ends, fields)], ["id", "text", "hits"])


def _schema(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString().replace('bigint', 'long')}, text string, hits {HITS}"


def _chunked(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (id, text) with a ``chunk``, and the bytes of all texts."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(-(-size // CHUNK), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))), size


def _keyed(chunked: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, set[int]]:
    """(name, value, kind, gram, off, n): the gram that stands for each name and its places; (chunk, gram, n); and the widths of grams."""
    grams = _name_grams(names)
    widths = dict(map(tuple, grams.groupBy("width").count().collect()))  # a few tens at most
    held = checkpointed(_places(chunked.repartition("chunk"), _bits(grams, sum(widths.values())), set(widths), True).groupBy("chunk", "gram").agg(F.sum("n").alias("n")))
    seen = held.groupBy("gram").agg(F.sum("n").alias("n"))
    # A name with a gram that no text has is in none.
    rarest = grams.join(seen, "gram", "left").groupBy("name", "value", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "off")).alias("r"))
    return checkpointed(rarest.filter("r.n > 0").select("name", "value", "kind", "r.gram", "r.off", "r.n")), held, set(widths)


def _meeting(rows: DataFrame, keys: DataFrame, widths: set[int]) -> DataFrame:
    found = _places(rows, _bits(keys, keys.count()), widths, False).join(keys, "gram")
    return found.select("id", F.struct((F.col("at") - F.col("off")).alias("start"), "name", "value", "kind").alias("c")).filter("c.start >= 0")


def _candidates(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(id, c): where a name may begin in a text, told by the gram that stands for it."""
    keys, _, widths = _keyed(_chunked(rows)[0], names)
    return _meeting(rows, keys, widths)


def _by_chunk(chunked: DataFrame, own: DataFrame, strict: bool) -> DataFrame:
    """Hits of the texts of each chunk by the names (chunk, name, value, kind) that it meets, which come before its texts."""
    absent = lambda name: F.lit(None).cast(chunked.schema[name].dataType).alias(name)
    none = F.lit(None).cast("string").alias
    both = own.select("chunk", F.lit(0).alias("_k"), absent("id"), absent("text"), "name", "value", "kind").unionByName(
        chunked.select("chunk", F.lit(1).alias("_k"), "id", "text", none("name"), none("value"), none("kind"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, automaton = None, [], None
        for b in _few(batches, "text"):
            chunk = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if chunk[low] != current:
                    current, names, automaton = chunk[low], [], None
                part = b.slice(low, high - low)
                texts = int(np.count_nonzero(part.column("_k").to_numpy()))
                listed = part.slice(0, part.num_rows - texts)
                names += zip(*(listed.column(c).to_pylist() for c in ("name", "value", "kind")))
                if texts:
                    if automaton is None:
                        automaton, names = _automaton(names), []
                    yield _scanned(part.slice(part.num_rows - texts), automaton, strict)

    return both.repartition("chunk").sortWithinPartitions("chunk", "_k").mapInArrow(run, _schema(chunked))


def _by_join(rows: DataFrame, names: DataFrame, strict: bool) -> DataFrame:
    chunked, size = _chunked(rows)
    keys, held, widths = _keyed(chunked, checkpointed(names))
    if (keys.agg(F.sum("n")).first()[0] or 0) * FEW > size:
        return _by_chunk(chunked, held.select("chunk", "gram").join(keys, "gram"), strict)
    wanted = _meeting(rows, keys, widths).groupBy(F.col("id").alias("of")).agg(F.collect_list("c").alias("cs"))
    placed = rows.join(wanted, F.col("id") == F.col("of"), "left").select("id", "text", "cs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for large in _few(batches, "text") for c in _few(iter([large]), "cs", SLICE // 16)):
            out = []
            for text, cs in zip(b.column("text").to_pylist(), b.column("cs").to_pylist()):
                hits = [(c["start"], c["start"] + len(c["name"]), c["name"], c["value"], c["kind"]) for c in cs or () if text.startswith(c["name"], c["start"])]
                out.append(chosen([h[:4] for h in hits if free(text, h[0], h[1], h[4], strict)]))
            yield _batch(b, out)

    return placed.mapInArrow(run, _schema(rows))


def table_hits(documents: DataFrame, key: str, text: str, names: DataFrame, strict: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, text, hits) of every row: names (name, value, kind) left to right without overlaps, the longest at each place.

    ``kind`` says what may stand beside a name (see ``free``); null asks for nothing.  Of a name listed
    twice the least value counts; empty names are none.  ``key`` must be distinct; offsets are code points.
    """
    once = names.filter("name <> ''").groupBy("name").agg(F.min(F.struct("value", "kind")).alias("v")).select("name", "v.value", "v.kind")
    rows = documents.select(documents[key].alias("id"), documents[text].alias("text"))
    size = once.agg(F.sum(F.octet_length("name") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0] or 0
    return _by_automaton(rows, once, strict) if size <= most_bytes else _by_join(rows, once, strict)


def table_replaced(documents: DataFrame, key: str, text: str, vault: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, replaced): texts with the names of a vault (name, value) as their values; nothing that was put in is scanned again."""
    found = table_hits(documents, key, text, vault.select("name", "value", F.lit(None).cast("string").alias("kind")), most_bytes=most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, "text"):
            out: list[str | None] = []
            for given, hits in zip(b.column("text").to_pylist(), b.column("hits").to_pylist()):
                parts, done = [], 0
                for h in hits:
                    parts += [given[done : h["start"]], h["value"] or ""]
                    done = h["end"]
                out.append("".join(parts) + given[done:] if hits else given)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "replaced"])

    return found.mapInArrow(run, _schema(found).split(", text")[0] + ", replaced string")
