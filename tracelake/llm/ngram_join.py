"""N-gram Jaccard join by a blocked sparse matrix product.

Documents by n-grams is a sparse 0/1 matrix; its product with its transpose holds the overlap of
every pair.  Only small, dense blocks of that product are computed:

1. Equal sets form a class; one row stands for it (copies are never expanded into pairs).
2. Two sets alike enough share an n-gram in their prefixes, the first ``n - ceil(t n) + 1`` n-grams
   in any order common to all.  The order is by hash, with n-grams found in more than a fixed share
   of the documents last, so that passages common to unrelated documents join nothing.  That list is
   bounded by the share, not by the corpus.  Those that then stand in many prefixes come last too (the
   most frequent, a bounded list), so that blocks do not grow with the corpus; the prefixes that held one
   are made anew.
3. N-grams in one prefix alone go.  The rest are dealt by size band (linked sets lie in the same or
   in neighbouring bands) and count only where what follows in the set can still reach the bound.
   The least document of an n-gram and band is its leader;
   documents that follow a leader, and the leader, are one block.  A large one (by members or by
   n-grams) is cut into chunks, each with a few members common to all chunks; near copies of one text
   link through these, and each travels once.  Members that are then not yet in the largest component
   of their leader are held against all its chunks.  Bitmaps of the sets travel to their blocks first, and bound the overlaps; the texts of sets that
   may still be linked follow, compressed.
4. In a block, columns of the incidence matrix are multiplied in turn, overlaps accumulate, and rows
   whose pairs can no longer reach the bound that their sizes set are dropped.  A block returns a
   spanning star of each linked group, not its pairs.
5. Stars are merged into components by alternating large-star and small-star steps.

Defined results: a text without words has an empty set and is its own component; with fewer words
than ``n`` the whole sequence is the one n-gram; rows with equal ``doc_id`` are one node, each with
its own row and set; rows without ``doc_id`` are nodes by a 64-bit hash of their text, never give a
component its id where an id is there, and a component of such rows alone has a null id; an empty table gives an empty result; other
columns are ignored by the join and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import gram_hashes
from .session import cut, removed, stored, stored_at
from .text import LOWER, U64, batches_of, mix, run_hashes, slices, word_bounds, word_hashes

TOP = (1 << 63) - 1
#: Members that all chunks of a large block have in common, about.
PIVOTS = 32
#: Most dropped rows whose numbers go to all tasks.
BROADCAST = 1 << 20
#: Prefix n-grams of a round, about, and most rounds; what is shuffled of a round goes before the next.
POSTINGS, ROUNDS = 1 << 22, 8
#: N-grams in more prefixes than this are crowded, and most of them that go to all tasks (8 MB).
CROWD, CROWDED = 16, 1 << 20


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out = []
    for _, _, data, offsets in slices(column):
        lower = LOWER[data]
        starts, ends, first = word_bounds(lower, offsets)
        h = word_hashes(lower, starts, ends)
        grams = gram_hashes(h, n)
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < n))
        whole = dict(zip(short.tolist(), run_hashes(h, first[short], first[short + 1])))
        for i, (a, c) in enumerate(zip(first.tolist(), count.tolist())):
            out.append(np.unique(grams[a : a + c - n + 1]) if c >= n else np.array([whole[i]], np.uint64) if c else np.zeros(0, np.uint64))
    return out


def _text(documents: DataFrame) -> Column:
    return F.coalesce(documents["text"], F.lit(""))


def _node(documents: DataFrame) -> Column:
    return F.coalesce(documents["doc_id"].cast("long"), F.xxhash64(_text(documents)))


def _base(documents: DataFrame) -> DataFrame:
    named = documents["doc_id"].cast("long").isNotNull()
    return documents.select(_node(documents).alias("node"), named.alias("named"), _text(documents).alias("text"))


def common_grams(docs: DataFrame, n: int, share: float) -> np.ndarray:
    """Hashes of n-grams in more than about ``share`` of the documents, sorted.

    A gram with that share overall has it in some batch, so batches report only theirs.  The list
    holds at most (n-grams per document) / share * 2 entries of 8 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1 << 21, "text"):
            sets = shingle_sets(b.column("text"), n)
            grams, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = count >= max(2, share * b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["gram", "n"])

    total = docs.count()
    found = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= max(20, share * total / 2)).select("gram").toArrow()
    return np.sort(rows["gram"].to_numpy().astype(np.int64).view(np.uint64))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table, which is not empty."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def crowded_grams(reps: DataFrame) -> np.ndarray:
    """N-grams that stand in more than ``CROWD`` prefixes, sorted; the most frequent if they are more than ``CROWDED``."""
    counts = cut(reps.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD))
    least, total = CROWD + 1, 0
    for m, k in counts.groupBy("m").agg(F.count("*")).orderBy(F.desc("m")).collect():
        total += k
        if total > CROWDED:
            least = m + 1
            break
    rows = counts.filter(F.col("m") >= least).select("gram").toArrow()
    return np.sort(rows["gram"].to_numpy().astype(np.int64).view(np.uint64))


def _crowded(reps: DataFrame, crowded: np.ndarray) -> DataFrame:
    """Nodes of the prefixes that hold a crowded n-gram."""
    shared = reps.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = b.column("prefix")
            found = _among(prefixes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), shared.value)
            upto = np.concatenate([[0], np.cumsum(found)])
            ends = np.cumsum(prefixes.value_lengths().to_numpy(zero_copy_only=False))
            held = upto[ends] > upto[np.concatenate([[0], ends[:-1]])] if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("node").filter(pa.array(held))], ["m"])

    return reps.select("node", "prefix").mapInArrow(run, "m long")


def _prefix_rows(docs: DataFrame, n: int, threshold: tuple[int, int], common: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common)  # bounded, see common_grams
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1 << 20, "text"):
            size, k1, k2, prefixes = [], [], [], []
            for s in shingle_sets(b.column("text"), n):
                size.append(len(s))
                k1.append(int(mix(s ^ U64(0x51ED270B7F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(s + U64(0x3C6EF372FE94F82B)).sum(dtype=np.uint64).view(np.int64)))
                keep = len(s) - (num * len(s) + den - 1) // den + 1 if len(s) else 0
                if len(shared.value):
                    last = _among(s, shared.value)
                    s = np.concatenate([s[~last], s[last]])
                prefixes.append(s[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("named"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["node", "named", "n", "k1", "k2", "prefix"],
            )

    return docs.mapInArrow(run, "node long, named boolean, n long, k1 long, k2 long, prefix array<long>")


def _followers(reps: DataFrame, threshold: tuple[int, int], postings: int = POSTINGS) -> DataFrame:
    """(leader, node, n) rows: sets that may be linked share a leader.

    All that is told by an n-gram is told within its round, so rounds only bound the disk.
    """
    total = reps.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rounds = min(ROUNDS, total // postings + 1)
    found = [cut(_followers_in(reps, threshold, rounds, k)) for k in range(rounds)]
    return reduce(DataFrame.unionByName, found).distinct()


def _followers_in(reps: DataFrame, threshold: tuple[int, int], rounds: int, turn: int) -> DataFrame:
    """The followers told by the n-grams of one round.

    At the first n-gram that two linked sets have in common, either set must have enough n-grams
    left to reach the overlap that the two sizes need; the least size in a group of postings bounds
    what a posting needs at all.
    """
    num, den = threshold
    # One number for size and place keeps the shuffled rows narrow.
    own = F.pmod("gram", F.lit(rounds)) == turn
    postings = reps.select("node", "n", F.posexplode("prefix").alias("place", "gram")).filter(own).select(
        "gram", "node", (F.shiftleft("n", 31) + F.col("place")).alias("at")
    )
    often = postings.groupBy("gram").agg(F.count("*").cast("int").alias("m")).filter("m > 1").select(F.col("gram").alias("g"))
    shared = postings.join(often, F.col("gram") == F.col("g"), "left_semi").select(
        "gram", "node", F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND((1 << 31) - 1).alias("place")
    )
    band = F.floor(F.log("n") / math.log(den / num * 1.0001)).cast("int")
    placed = cut(shared.select("*", F.explode(F.array(band, band + 1)).alias("cell")))
    least = placed.groupBy("gram", "cell").agg(F.min("n").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
    need = F.ceil(num * (F.col("n") + F.col("least")) / (num + den) - 1e-9)
    able = placed.join(least, ["gram", "cell"]).filter(F.col("place") <= F.col("n") - need).select("gram", "cell", "node", "n")
    leaders = able.groupBy("gram", "cell").agg(F.min("node").alias("leader"), F.max("node").alias("top")).filter("leader < top").drop("top")
    return able.join(leaders, ["gram", "cell"]).filter("node <> leader").select("leader", "node", "n").distinct()


#: Rows of a block that are held against all others at a time; keeps a task's temporaries small.
ROWS = 256


def least_overlap(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The overlap that sets of sizes ``a`` (down) and ``b`` (across) need: o / (a + b - o) >= num / den."""
    num, den = threshold
    return (num * (a[:, None] + b[None, :]) + num + den - 1) // (num + den)


def linked_groups(sets: list[np.ndarray], threshold: tuple[int, int], columns: int = 2048) -> np.ndarray:
    """Group number of each set, groups being joined by Jaccard likeness of ``threshold`` or more."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(m), size)
    gram, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Columns by falling document frequency; those of one document alone count for nothing.
    order = np.argsort(-df, kind="stable")
    column = np.empty(len(gram), np.int64)
    column[order] = np.arange(len(gram))
    useful = int((df > 1).sum())
    col = column[inverse]
    rows, col = rows[col < useful], col[col < useful]
    by = np.argsort(col, kind="stable")
    rows, col = rows[by], col[by]
    rest = np.bincount(rows, minlength=m)
    overlap = np.zeros((m, m), np.float32)
    alive = np.arange(m)
    for low in range(0, useful, columns):
        a, z = np.searchsorted(col, [low, low + columns])
        r, c = rows[a:z], col[a:z] - low
        rest -= np.bincount(r, minlength=m)
        place = np.full(m, -1)
        place[alive] = np.arange(len(alive))
        inside = place[r] >= 0
        block = np.zeros((len(alive), min(columns, useful - low)), np.float32)
        block[place[r[inside]], c[inside]] = 1
        if len(alive) == m:
            overlap += block @ block.T
        else:
            overlap[np.ix_(alive, alive)] += block @ block.T
        if low + columns < useful:
            hopeful = np.zeros(len(alive), bool)
            for at in range(0, len(alive), ROWS):
                some = alive[at : at + ROWS]
                reach = overlap[np.ix_(some, alive)] + np.minimum(rest[some][:, None], rest[alive][None, :])
                possible = reach >= least_overlap(size[some], size[alive], threshold)
                possible[np.arange(len(some)), at + np.arange(len(some))] = False
                hopeful[at : at + ROWS] = possible.any(axis=1)
            alive = alive[hopeful]
            if not len(alive):
                break
    linked = np.zeros((m, m), bool)
    for at in range(0, m, ROWS):
        linked[at : at + ROWS] = overlap[at : at + ROWS] >= least_overlap(size[at : at + ROWS], size, threshold)
    group = np.full(m, -1)
    for i in range(m):
        if group[i] < 0:
            group[i] = i
            frontier = np.array([i])
            while len(frontier):
                reached = linked[frontier].any(axis=0) & (group < 0)
                group[reached] = i
                frontier = np.flatnonzero(reached)
    return group


def _block_stars(blocks: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, nodes, packed in _blocks(batches):
            texts = [unpack(p).decode() for p in packed]
            group = linked_groups(shingle_sets(pa.array(texts, pa.large_string()), n), threshold)
            ids = np.array(nodes, np.int64)
            least = np.full(len(ids), TOP)
            np.minimum.at(least, group, ids)
            center = least[group]
            far = center != ids
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(center[far]), pa.array(ids[far])], ["u", "v"])

    return blocks.mapInArrow(run, "u long, v long")


def sketch(grams: np.ndarray) -> bytes:
    """Number of n-grams and a bitmap of their low bits, with four to eight bits for each."""
    bits = np.zeros(1 << max(3, (4 * len(grams) - 1).bit_length()), np.uint8)
    bits[(grams & U64(len(bits) - 1)).astype(np.int64)] = 1
    return len(grams).to_bytes(4, "little") + np.packbits(bits, bitorder="little").tobytes()


def able_sets(sketches: list[bytes], threshold: tuple[int, int], columns: int = 512) -> np.ndarray:
    """Whether each set may be linked with another, by an upper bound of their overlap.

    Common n-grams fall on common bits, and share a bit at most as often as bits are shared within
    either set.  Linked sets have bitmaps of the same size or of twice the size, which is folded.
    """
    count = np.array([int.from_bytes(s[:4], "little") for s in sketches], np.int64)
    size = np.array([len(s) - 4 for s in sketches])
    able = np.zeros(len(sketches), bool)
    for width in np.unique(size):
        one, two = np.flatnonzero(size == width), np.flatnonzero(size == 2 * width)
        raw = np.frombuffer(b"".join(sketches[k][4:] for k in one), np.uint8).reshape(len(one), width)
        if len(two):
            halves = np.frombuffer(b"".join(sketches[k][4:] for k in two), np.uint8).reshape(len(two), 2, width)
            raw = np.vstack([raw, halves[:, 0] | halves[:, 1]])
        both = np.concatenate([one, two])
        common, filled = np.zeros((len(one), len(both)), np.float32), np.zeros(len(both), np.int64)
        for low in range(0, width, columns):
            block = np.unpackbits(raw[:, low : low + columns], axis=1).astype(np.float32)
            common += block[: len(one)] @ block.T
            filled += block.sum(axis=1).astype(np.int64)
        spare = count[both] - filled
        for at in range(0, len(one), ROWS):
            some = np.arange(at, min(at + ROWS, len(one)))
            bound = common[some] + np.minimum(spare[some, None], spare[None, :])
            possible = bound >= least_overlap(count[one[some]], count[both], threshold)
            possible[np.arange(len(some)), some] = False
            able[one[some]] |= possible.any(axis=1)
            able[both] |= possible.any(axis=0)
    return able


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], list[bytes]]]:
    """(leader, i, j), nodes and values of each block; rows come sorted by block."""

    def stream() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("leader", "i", "j", "node", "value")))

    for key, block in groupby(stream(), key=lambda r: r[:3]):
        nodes, values = zip(*[r[3:] for r in block])
        yield key, list(nodes), list(values)


def _able_members(blocks: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, i, j), nodes, sketches in _blocks(batches):
            kept = np.array(nodes, np.int64)[able_sets(sketches, threshold)]
            if len(kept):
                same = [np.full(len(kept), v) for v in (leader, i, j)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same[0], pa.int64()), pa.array(same[1], pa.int32()), pa.array(same[2], pa.int32()), pa.array(kept)], ["leader", "i", "j", "m"]
                )

    return blocks.mapInArrow(run, "leader long, i int, j int, m long")


def _compressed(texts: pa.Array) -> list[bytes]:
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack(t.encode()) for t in texts.to_pylist()]


def _in_blocks(placed: DataFrame, docs: DataFrame, value: Callable[[pa.Array], list[bytes]]) -> DataFrame:
    """Rows (leader, i, j, node, value) of ``placed`` (leader, i, j, m), block by block.

    A bitmap of fixed size (1 MB) keeps texts that no block needs out of the shuffle.
    """
    bits = placed.select(F.pmod(F.xxhash64("m"), F.lit(1 << 23)).alias("p"))
    rows = bits.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("v")).collect()
    bitmap = np.zeros(1 << 20, np.uint8)
    for bucket, filled in rows:
        bitmap[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(filled, np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array(b.column("p").to_numpy(zero_copy_only=False), np.int64)
            kept = b.filter(pa.array((wanted.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            for part in batches_of([kept], 1 << 20, "text"):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(value(part.column("text")), pa.binary())], ["node", "value"])

    place = F.pmod(F.xxhash64("node"), F.lit(1 << 23)).alias("p")
    values = docs.select("node", "text", place).mapInArrow(run, "node long, value binary")
    blocks = placed.join(values, F.col("m") == F.col("node")).select("leader", "i", "j", "node", "value")
    return blocks.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")


def _marks(rows: DataFrame, name: str) -> DataFrame:
    """2**23 bits, those of the nodes in ``name`` set: a table of 131,072 rows of 16 bytes at most."""
    bits = rows.select(F.pmod(F.xxhash64(name), F.lit(1 << 23)).alias("p"))
    return bits.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: whether the bit of ``node`` is set."""
    placed = rows.withColumn("p", F.pmod(F.xxhash64("node"), F.lit(1 << 23)))
    hit = F.expr("coalesce(shiftright(bits, cast(p & 63 as int)) & 1L, 0L) = 1L")
    return placed.join(F.broadcast(marks), F.shiftright("p", 6) == F.col("word"), "left").withColumn("hit", hit)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes of ``edges`` (u, v): the least node reachable, in few rounds."""
    edges = cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = None
    while True:
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), "m")
        joined = large.join(least, F.col("v") == F.col("c"))
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(joined.select(F.col("m").alias("u"), "v"))
        edges = cut(small.filter("u <> v").distinct())
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = after


def _chunks(members: Column, grams: Column, chunk: int, chunk_grams: int) -> Column:
    return F.greatest(F.ceil(members / chunk), F.ceil(grams / chunk_grams)).cast("int")


def _part(seed: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts)).cast("int")


def _stars(placed: DataFrame, docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (u, v) found in the blocks ``placed`` (leader, i, j, m)."""
    able = cut(_able_members(_in_blocks(placed, docs, lambda texts: [sketch(s) for s in shingle_sets(texts, n)]), threshold))
    return cut(_block_stars(_in_blocks(able, docs, _compressed), n, threshold))


def _apart(large: DataFrame, stars: DataFrame, chunk: int, chunk_grams: int) -> DataFrame:
    """Blocks (leader, i, j, m) of large leaders for members not yet linked to the most of the others."""
    found = components(stars).select(F.col("node").alias("f"), "component")
    linked = large.join(found, F.col("node") == F.col("f"), "left").select("leader", "node", "n", F.coalesce("component", "node").alias("c"))
    linked = cut(linked)
    main = linked.groupBy("leader", "c").agg(F.count("*").alias("k")).groupBy("leader").agg(F.max(F.struct("k", "c"))["c"].alias("main"))
    rest = linked.join(main, "leader").filter("c <> main")
    of_rest = rest.groupBy("leader").agg(_chunks(F.count("*"), F.sum("n"), chunk // 2 or 1, chunk_grams // 2).alias("rests"))
    of_all = linked.groupBy("leader").agg(_chunks(F.count("*"), F.sum("n"), chunk // 2 or 1, chunk_grams // 2).alias("alls"))
    both = of_rest.join(of_all, "leader")
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    ones = rest.join(both, "leader").select("leader", _part(2, "rests").alias("i"), upto("alls").alias("j"), F.col("node").alias("m"))
    others = linked.join(both, "leader").select("leader", upto("rests").alias("i"), _part(3, "alls").alias("j"), F.col("node").alias("m"))
    return ones.unionByName(others).distinct()


def _linked(docs: DataFrame, n: int, threshold: tuple[int, int], common_share: float, chunk: int, chunk_grams: int = 1 << 19) -> DataFrame:
    """node, named, n (set size) and c (least node of the component) of every row of ``docs`` (node, named, text)."""
    common = common_grams(docs, n, common_share)
    wide, folder = stored_at(_prefix_rows(docs, n, threshold, common))
    sets = cut(wide.drop("prefix"))
    classes = sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("node").alias("rep"))
    owners = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep")
    same: Column = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    owning = lambda rows: rows.filter("n > 0").join(owners, same & (F.col("node") == F.col("rep")), "left_semi").select("node", "n", "prefix")
    reps, held = stored_at(owning(wide))
    removed(docs.sparkSession, folder)
    crowded = crowded_grams(reps)
    if len(crowded):
        marks = cut(_marks(_crowded(reps, crowded), "m"))
        again = _prefix_rows(_marked(docs, marks).filter("hit").select("node", "named", "text"), n, threshold, np.union1d(common, crowded))
        lighter = stored(_marked(reps, marks).filter("not hit").select("node", "n", "prefix").unionByName(owning(again)))
        removed(docs.sparkSession, held)
        reps = lighter
    followers = cut(_followers(reps, threshold))
    leaders = followers.select(F.col("leader").alias("l")).distinct()
    leading = reps.join(leaders, F.col("node") == F.col("l"), "left_semi").select(F.col("node").alias("leader"), "node", "n").distinct()
    members = followers.unionByName(leading)
    sizes = members.groupBy("leader").agg(_chunks(F.count("*"), F.sum("n"), chunk, chunk_grams).alias("chunks"), F.count("*").alias("k"))
    every = F.greatest(F.ceil(F.col("k") / PIVOTS), F.col("chunks")).cast("int")
    spread = cut(members.join(sizes.select("leader", "chunks", every.alias("every")), "leader").withColumn("own", _part(1, "chunks")))
    pivots = spread.filter("chunks > 1").filter(_part(4, "every") == 0).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("x <> own")
    own = spread.select("leader", F.col("own").alias("i"), F.col("own").alias("j"), F.col("node").alias("m"))
    stars = _stars(own.unionByName(pivots.select("leader", F.col("x").alias("i"), F.col("x").alias("j"), F.col("node").alias("m"))), docs, n, threshold)
    large = spread.filter("chunks > 1").select("leader", "node", "n")
    if not large.isEmpty():
        apart = cut(_apart(large, stars, chunk, chunk_grams))
        if not apart.isEmpty():
            stars = stars.unionByName(_stars(apart, docs, n, threshold))
    found = components(stars)
    owned = owners.join(found.withColumnRenamed("node", "r"), F.col("rep") == F.col("r"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("c"))
    alone = sets.filter("n = 0").select("node", "named", "n", F.col("node").alias("c"))
    return sets.filter("n > 0").join(owned, same).select("node", "named", "n", "c").unionByName(alone)


def _node_components(documents: DataFrame, n: int, threshold: tuple[int, int], common_share: float, chunk: int) -> DataFrame:
    """node, named (has an id), n (set size), c (component) and any_named of every row."""
    result = _linked(_base(documents), n, threshold, common_share, chunk)
    if documents.filter(documents["doc_id"].cast("long").isNull()).isEmpty():
        return result.withColumn("any_named", F.lit(True))
    result = cut(result)
    named = F.min(F.when(F.col("named"), F.col("node")))
    least = result.groupBy(F.col("c").alias("old")).agg(F.coalesce(named, F.min("node")).alias("least"), F.max("named").alias("any_named"))
    return result.join(least, F.col("c") == F.col("old")).select("node", "named", "n", F.col("least").alias("c"), "any_named")


def near_duplicate_components(
    documents: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), common_share: float = 0.001, chunk: int = 1024
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    result = _node_components(documents, n, threshold, common_share, chunk)
    return result.select(
        F.when(F.col("named"), F.col("node")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("any_named"), F.col("c")).alias("component_id")
    )


def _own_nodes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` (row, id, text) with a node, which rows of one id and text share and no others, and whether it is the id.

    It is the id where each row has one of its own; else a hash, under a seed for which no two
    different rows have the same.
    """
    if rows.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1 or id is null").isEmpty():
        return rows.withColumn("node", F.col("id")), True
    seed = 0
    while True:
        keyed = rows.withColumn("node", F.xxhash64(F.lit(seed), "id", F.col("id").isNull(), "text"))
        told = F.struct("id", F.length("text").alias("size"), F.xxhash64("text", F.lit(seed)).alias("own"))
        if keyed.groupBy("node").agg(F.min(told).alias("a"), F.max(told).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
            return stored(keyed.dropDuplicates(["node"])), False
        seed += 1


def _without(keyed: DataFrame, losers: DataFrame) -> DataFrame:
    """Rows whose node is no ``loser``.  Up to ``BROADCAST`` losers go to all tasks (8 MB); beyond that only
    rows that share a bit with one, of 2**23, are shuffled.
    """
    if losers.count() <= BROADCAST:
        return keyed.join(F.broadcast(losers), F.col("node") == F.col("loser"), "left_anti")
    marked = _marked(keyed, _marks(losers, "loser"))
    names = keyed.columns
    unsure = marked.filter("hit").join(losers, F.col("node") == F.col("loser"), "left_anti")
    return marked.filter("not hit").select(*names).union(unsure.select(*names))


def drop_near_duplicates(
    documents: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), common_share: float = 0.001, chunk: int = 1024
) -> DataFrame:
    """The documents, all columns, with one row of each component: that of its least id.

    A row is told by its id and text together, so texts that are not linked stay whatever ids they
    share, and of linked ones under one id one stays (the first by a hash).  Rows without an id come
    last.  Rows without words are in no group and all stay.  Columns may have any name.
    """
    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select(F.struct("*").alias("row"), documents["doc_id"].cast("long").alias("id"), text.alias("text"))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    keyed, by_id = _own_nodes(rows.filter(worded))
    found = _linked(keyed.select("node", F.lit(True).alias("named"), "text"), n, threshold, common_share, chunk).select(F.col("node").alias("of"), "c")
    if by_id:
        gone = found.filter("of <> c").select(F.col("of").alias("loser"))
    else:
        placed = cut(found.join(keyed.select("node", "id"), F.col("of") == F.col("node")).select("node", "id", "c"))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))["node"]
        kept = placed.groupBy("c").agg(first.alias("kept"), F.count("*").alias("m")).filter("m > 1").select("c", "kept")
        gone = placed.join(kept, "c").filter("node <> kept").select(F.col("node").alias("loser"))
    once = _without(keyed, cut(gone.distinct())).select("row.*")
    return once.union(rows.filter(~worded).select("row.*"))
