"""SpotSigs document fingerprints.

A spot signature is a common word (the anchor) with the two content words that follow it.  A text's
fingerprint is the set of its signatures, written as base64 of the sorted 32-bit hashes; two
fingerprints are compared by Jaccard likeness.  So that texts without common words get signatures
too, content words whose hash is divisible by 4 act as anchors everywhere, and the first and last
words of a text, padded, always do.

``neighbour_likeness`` compares each document with an edited copy of itself and with the next
document by descending ``doc_id``.  The order is global without a global task: ids are cut into
ranges at quantiles that are themselves ids, so the one row a range needs from its neighbour is
known beforehand and travels with the range.  All rows of one id, and all rows without one, lie in one
range and so in one task.

``matching_pairs`` is the join.  Rows with equal sets are one class, keyed by a hash of the set;
``class_members`` names the class of every row.  Sets are partitioned by length, and only those whose
lengths allow the likeness, and which share a signature in their prefixes, come into one block.
Prefixes take rare signatures first.  A block is compared exactly, by a matrix product of its chunks,
and gives the pairs that match.

Defined results: a null text counts as empty; an empty text has the empty fingerprint, and two
empty fingerprints have likeness 1; equal ids are ordered by text, and a null ``doc_id`` comes
last; repeated rows each get a row; an empty table gives an empty result; other input columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bradley_terry import FUNCTION_WORDS
from .licenses import NOT_WORD
from .session import cut
from .text import BYTE_VALUE, LOWER, U64, mix, run_hashes, slices, word_bounds

LEAST = -(1 << 63)
_P = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


def _anchors() -> np.ndarray:
    raw = [w.encode() for w in FUNCTION_WORDS]
    ends = np.cumsum([len(w) for w in raw])
    return np.unique(run_hashes(BYTE_VALUE[np.frombuffer(b"".join(raw), np.uint8)], ends - [len(w) for w in raw], ends))


def signatures(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 32-bit spot signatures of each text."""
    common, out = _anchors(), []
    for _, _, data, offsets in slices(column):
        lower = LOWER[data]
        starts, ends, first = word_bounds(lower, offsets, NOT_WORD)
        h = run_hashes(BYTE_VALUE[lower], starts, ends)
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(first))
        is_common = np.isin(h, common)
        anchor = is_common | (h % U64(4) == 0)
        anchor[first[:-1][np.diff(first) > 0]] = True
        content = np.flatnonzero(~is_common)
        # Content words of a text, two pads after its last one.
        last = np.searchsorted(content, first[1:])
        at = np.flatnonzero(anchor)
        nxt = np.searchsorted(content, at, side="right")
        end = last[owner[at]]
        padded = np.append(h[content], [U64(0), U64(0)])
        pad = U64(0x27D4EB2F165667C5)
        one = np.where(nxt < end, padded[np.minimum(nxt, len(content))], pad)
        two = np.where(nxt + 1 < end, padded[np.minimum(nxt + 1, len(content))], pad)
        sig = (mix(h[at] * _P[0] + one * _P[1] + two * _P[2]) >> U64(32)).astype(np.uint64)
        key = np.unique((owner[at].astype(np.uint64) << U64(32)) | sig)
        cut = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U64(32))
        low = (key & U64(0xFFFFFFFF)).astype("<u4")
        out += [low[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return out


def fingerprint(sig: np.ndarray) -> str:
    return base64.b64encode(sig.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted signature sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(rows: list[tuple], follow: list[str]) -> pa.RecordBatch:
    """Result rows for (doc_id, text) with the text that follows each."""
    texts = [r[1] for r in rows]
    edited = [_edited(t, f) for t, f in zip(texts, follow)]
    own = signatures(pa.array(texts, pa.large_string()))
    changed = signatures(pa.array(edited, pa.large_string()))
    after = signatures(pa.array(follow[-1:], pa.large_string()))
    # The text that follows is the next row's own, except for the last one.
    nxt = [own[i + 1] if i + 1 < len(rows) and follow[i] is texts[i + 1] else None for i in range(len(rows))]
    nxt[-1] = after[0]
    nxt = [s if s is not None else signatures(pa.array([follow[i]], pa.large_string()))[0] for i, s in enumerate(nxt)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([fingerprint(s) for s in own]),
            pa.array([fingerprint(s) for s in changed]),
            pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, nxt)], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch], chunk: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Stream ranges in order; each own row is completed by the row after it in its range."""
    pending: list[tuple] = []  # (doc_id, text, range, own)
    size = 0
    for b in batches:
        for piece in range(0, b.num_rows, 512):
            part = b.slice(piece, 512)
            for row in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("range").to_pylist(), part.column("own").to_pylist()):
                pending.append(row)
                size += len(row[1])
                if size > chunk and len(pending) > 1:
                    yield from _flush(pending)
                    pending, size = pending[-1:], len(row[1])
    if pending:
        yield from _flush(pending)


def _flush(pending: list[tuple]) -> Iterator[pa.RecordBatch]:
    rows = [(a[0], a[1], b[1]) for a, b in zip(pending, pending[1:]) if a[3] and a[2] == b[2]]
    if rows:
        yield _compare([r[:2] for r in rows], [r[2] for r in rows])


def neighbour_likeness(documents: DataFrame, ranges_per_partition: int = 4) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the two likenesses."""
    spark = documents.sparkSession
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce(documents["text"], F.lit("")).alias("text"))
    rank = F.coalesce(F.col("doc_id"), F.lit(LEAST))
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    n = ranges_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(rank.alias("rank"))
    # At most n + 1 numbers, whatever the corpus; each is an id that occurs.
    quantiles = F.percentile_approx("rank", [(i + 1) / n for i in range(n)], 20 * n)
    found, top = ids.agg(quantiles, F.max("rank")).first()
    if top is None:
        return spark.createDataFrame([], schema)
    cuts = np.array(sorted({*found, top}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.array(b.column("rank").to_numpy(zero_copy_only=False), np.int64)
            at = np.searchsorted(cuts, key)
            # A range runs from its highest id down; the highest also closes the range above it,
            # and the highest of all closes the lowest range.
            guest = np.flatnonzero(cuts[at] == key)
            take = np.concatenate([np.arange(len(key)), guest])
            into = np.concatenate([at, (at[guest] + 1) % len(cuts)])
            own = np.concatenate([np.ones(len(key), bool), np.zeros(len(guest), bool)])
            moved = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(into, pa.int32()), pa.array(own)], ["doc_id", "text", "rank", "range", "own"])

    dealt = docs.select("doc_id", "text", rank.alias("rank")).mapInArrow(deal, "doc_id long, text string, rank long, range int, own boolean")
    ordered = dealt.repartition("range").sortWithinPartitions("range", F.desc("own"), F.desc("rank"), "text")
    return ordered.mapInArrow(_walk, schema)


def _sign(documents: DataFrame) -> DataFrame:
    """doc_id, k1 and k2 (128-bit hash of the signature set), n (its size) and sigs of every row."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce(documents["text"], F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 1000) for b in batches for low in range(0, b.num_rows, 1000)):
            packed = [s.tobytes() for s in signatures(b.column("text"))]
            keys = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in packed), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "k1", "k2", "n", "sigs"],
            )

    return docs.mapInArrow(sign, "doc_id long, k1 long, k2 long, n long, sigs binary")


def _class(k1: str, k2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(k1), 16, "0"), F.lpad(F.hex(k2), 16, "0")))


def class_members(documents: DataFrame) -> DataFrame:
    """(doc_id, class, n_signatures) of every row; rows with equal fingerprints have one class."""
    return _sign(documents).select("doc_id", _class("k1", "k2").alias("class"), F.col("n").alias("n_signatures"))


def _common_spots(sets: DataFrame, share: float) -> np.ndarray:
    """Signatures in more than about ``share`` of the sets, rarest first.

    A signature with that share overall has it in some batch, so batches report only theirs; the
    list is bounded by signatures per set / share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, count = np.unique(np.frombuffer(b"".join(b.column("sigs").to_pylist()), "<u4"), return_counts=True)
            often = count >= max(2, share * b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(sig[often].astype(np.int64)), pa.array(count[often].astype(np.int64))], ["sig", "n"])

    total = sets.count()
    found = sets.select("sigs").mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= max(20, share * total / 2)).toArrow()
    return rows["sig"].to_numpy()[np.lexsort((rows["sig"].to_numpy(), rows["n"].to_numpy()))].astype(np.uint32)


def _blocks_of(sets: DataFrame, threshold: float, common_share: float, chunk: int) -> DataFrame:
    """(leader, i, j, own, k1, k2): sets that may match meet in a block (leader, i, j).

    The sets that share a prefix signature and a band of sizes follow the least of them; the followers
    of a leader are cut into chunks, and blocks hold the pairs of chunks.
    """
    common = _common_spots(sets, common_share)
    by_sig = np.argsort(common)
    shared = sets.sparkSession.sparkContext.broadcast((common[by_sig], by_sig))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for b in batches:
            out = []
            for p in b.column("sigs").to_pylist():
                s = np.frombuffer(p, "<u4")
                keep = len(s) - math.ceil(len(s) * threshold - 1e-9) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    last = known[at] == s
                    s = np.concatenate([s[~last], s[last][np.argsort(rank[at[last]])]])
                out.append(s[:keep].astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("n"), pa.array(out, pa.list_(pa.int64()))], ["k1", "k2", "n", "prefix"])

    rows = sets.select("k1", "k2", "n", "sigs").mapInArrow(prefixes, "k1 long, k2 long, n long, prefix array<long>")
    # One number for size and place keeps the shuffled rows narrow.
    postings = rows.select("k1", "k2", "n", F.posexplode("prefix").alias("place", "sig")).select("sig", "k1", "k2", (F.shiftleft("n", 31) + F.col("place")).alias("at"))
    often = postings.groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("sig").alias("s"))
    found = postings.join(often, F.col("sig") == F.col("s"), "left_semi").select(
        "sig", "k1", "k2", F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND((1 << 31) - 1).alias("place")
    )
    band = F.floor(F.log("n") / math.log(1.0001 / threshold)).cast("int")
    placed = cut(found.select("*", F.explode(F.array(band, band + 1)).alias("cell")))
    least = placed.groupBy("sig", "cell").agg(F.min("n").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
    # At the first signature in common, either set must have enough left for the overlap it needs.
    need = F.ceil((F.col("n") + F.col("least")) * (threshold / (1 + threshold)) - 1e-6)
    able = placed.join(least, ["sig", "cell"]).filter(F.col("place") <= F.col("n") - need).select("sig", "cell", "k1", "k2", "n")
    leaders = able.groupBy("sig", "cell").agg(F.min("k1").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = cut(able.join(leaders, ["sig", "cell"]).select("leader", "k1", "k2", "n").distinct())
    chunks = F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") / (1 << 21))).cast("int")
    sizes = members.groupBy("leader").agg(chunks.alias("chunks")).withColumnRenamed("leader", "l")
    spread = members.join(sizes, F.col("leader") == F.col("l")).withColumn("own", F.pmod(F.xxhash64("k1", "k2", F.lit(1)), F.col("chunks")).cast("int"))
    other = spread.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.select("leader", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "k1", "k2")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None, columns: int = 2048) -> np.ndarray:
    """Signatures that each set of ``left`` has in common with each of ``right`` (or with the others of ``left``)."""
    a = np.concatenate(left)
    b = a if right is None else np.concatenate(right)
    if right is None:
        sig, count = np.unique(a, return_counts=True)
        useful = sig[count > 1]
    else:
        useful = np.intersect1d(a, b)

    def entries(sets: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        inside = np.isin(values, useful)
        rows, col = rows[inside], np.searchsorted(useful, values[inside])
        by = np.argsort(col, kind="stable")
        return rows[by], col[by]

    sides = [(len(left), *entries(left, a))]
    sides.append(sides[0] if right is None else (len(right), *entries(right, b)))
    out = np.zeros((sides[0][0], sides[1][0]), np.int32)
    for low in range(0, len(useful), columns):
        dense = []
        for m, rows, col in sides[: 1 if right is None else 2]:
            p, q = np.searchsorted(col, [low, low + columns])
            block = np.zeros((m, min(columns, len(useful) - low)), np.float32)
            block[rows[p:q], col[p:q] - low] = 1
            dense.append(block)
        out += (dense[0] @ dense[-1].T).astype(np.int32)
    return out


def _block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a1, a2, b1, b2, likeness) of each matching pair of a block's chunks; rows come sorted by block."""
    names = ["a1", "a2", "b1", "b2", "likeness"]

    def compare(key: tuple, rows: list[tuple]) -> Iterator[list[np.ndarray]]:
        i, j = key[1:]
        sides = [[r for r in rows if r[3] == own] for own in ((i,) if i == j else (i, j))]
        if not all(sides):
            return
        sets = [[np.frombuffer(r[6], "<u4") for r in side] for side in sides]
        keys = [np.array([r[4:6] for r in side], np.int64) for side in sides]
        both = overlaps(*sets)
        size = [np.array([len(s) for s in side], np.int64) for side in sets]
        for at in range(0, len(both), 256):
            part = both[at : at + 256]
            near = part / (size[0][at : at + 256, None] + size[-1][None, :] - part)
            x, y = np.nonzero(near >= threshold - 1e-12)
            if i == j:
                x, y = x[x + at < y], y[x + at < y]
            a, b = keys[0][x + at], keys[-1][y]
            swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
            a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            yield [a[:, 0], a[:, 1], b[:, 0], b[:, 1], near[x, y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list[np.ndarray]] = []
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("leader", "i", "j", "own", "k1", "k2", "sigs"))))
        for key, rows in groupby(stream, key=lambda r: r[:3]):
            for found in compare(key, list(rows)):
                if len(found[0]):
                    made.append(found)
                if sum(len(m[0]) for m in made[-64:]) > 50_000 or len(made) > 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names)
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names)

    return blocks.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long, likeness double")


def matching_pairs(documents: DataFrame, threshold: float = 0.8, common_share: float = 0.001, chunk: int = 512) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints have a likeness of ``threshold`` or more, a < b.

    A class is the rows with equal fingerprints, whatever their ids; ``class_members`` names its rows,
    and the pairs never expand it.  The empty fingerprint matches no other.
    """
    sets = cut(_sign(documents).filter("n > 0").select("k1", "k2", "n", "sigs").dropDuplicates(["k1", "k2"]))
    placed = _blocks_of(sets, threshold, common_share, chunk)
    blocks = placed.join(sets.select("k1", "k2", "sigs"), ["k1", "k2"]).select("leader", "i", "j", "own", "k1", "k2", "sigs")
    pairs = _block_pairs(blocks.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j"), threshold).distinct()
    a, b = _class("a1", "a2"), _class("b1", "b2")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "likeness")


def classes_and_pairs(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The members (doc_id, class) of ``class_members`` and the pairs (class, other, likeness) of ``matching_pairs``."""
    members = class_members(documents).select("doc_id", "class", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("likeness"))
    pairs = matching_pairs(documents, threshold)
    return members.unionByName(pairs.select(F.lit(None).cast("long").alias("doc_id"), F.col("a").alias("class"), F.col("b").alias("other"), "likeness"))
