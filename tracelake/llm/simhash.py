"""SimHash groups by meet-in-the-middle ball hashing.

1. A fingerprint's bit is set where over half of the hashes of a text's shingles, repeats included,
   have it.  Equal fingerprints are one row from then on.
2. Every fingerprint emits all variants within half the radius: itself and, for radius 2, each of the
   64 with one other bit.  Two fingerprints at most two bits apart have a variant in common.
3. Variants are shuffled.  Those that emitted one variant differ from it in one bit at most, so a
   variant's state is one mask of 64 bits and a flag, however many there are, and at most 65
   fingerprints meet.  All of them are at most two bits apart, so links to the least of them keep
   every component; they are deduplicated and verified.
4. Links are merged into components by large-star and small-star steps; a component has the least
   ``doc_id`` among its documents.

Defined results: a text without words has fingerprint zero and is linked like any other; with fewer
words than a shingle the whole sequence is the one shingle; rows without an id keep a null id and give
a component its id only where no row of it has one, which is then null; repeated rows each have their
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collocations import share_join
from .ngram_join import components
from .session import stored
from .text import LOWER, slices, word_bounds

SEED = 42
SPACE = 0x20
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def _shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice's texts, and how many each text has."""
    length = ends - starts
    begins = np.append(0, np.cumsum(length + 1))  # of the words, joined by one space
    joined = np.full(int(begins[-1]), SPACE, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[begins[1:] - 1] = False
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    joined[inside] = data[np.cumsum(change[:-1], dtype=np.int8) > 0]
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    at = np.repeat(first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(at + n, np.repeat(first[1:], count))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([digest(view[a:z], SEED) for a, z in zip(begins[at].tolist(), (begins[last] - 1).tolist())], np.uint64), count


def fingerprints(texts: pa.Array, n: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offsets in slices(texts):
        lower = LOWER[data]
        starts, ends, first = word_bounds(lower, offsets)
        h, count = _shingle_hashes(lower, starts, ends, first, n)
        owner = np.repeat(np.arange(len(count)), count)
        sums = np.zeros((len(count), 64), np.int64)
        for low in range(0, len(h), BLOCK):
            bits = np.unpackbits(h[low : low + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[low : low + BLOCK]
            edge = np.append(0, np.flatnonzero(np.diff(own)) + 1)
            sums[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
        out.append(np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out)


def _fingerprinted(documents: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text"), n).view(np.int64))], ["doc_id", "f"])

    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text"))
    return docs.mapInArrow(run, "doc_id long, f long")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) between fingerprints ``f`` at most two bits apart; each is linked with the least of every ball it meets in."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit")
    one: Column = F.expr("shiftleft(1L, bit)")
    flip = F.when(F.col("bit") == 64, F.lit(0).cast("long")).otherwise(one)
    variants = distinct.select("f", bit).select(F.col("f").bitwiseXOR(flip).alias("v"), flip.alias("flip"), (F.col("bit") == 64).alias("own"))
    met = variants.groupBy("v").agg(F.bit_or("flip").alias("flips"), F.max("own").alias("own")).filter(F.bit_count("flips") + F.col("own").cast("int") > 1)
    flipped = F.expr("transform(filter(sequence(0, 63), b -> (shiftright(flips, b) & 1L) = 1L), b -> v ^ shiftleft(1L, b))")
    members = F.when(F.col("own"), F.concat(flipped, F.array("v"))).otherwise(flipped)
    pairs = met.select(members.alias("members")).select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
    return pairs.filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).distinct()


def simhash_components(documents: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    rows = stored(_fingerprinted(documents, n))
    classes = stored(rows.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")))
    found = components(links(classes.select("f")))
    placed = stored(classes.join(found, F.col("f") == F.col("node"), "left").select("f", "least", "m", F.coalesce("component", "f").alias("c")))
    every = placed.agg(F.count("*"), F.sum("m")).first()
    groups = placed.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    # Components and fingerprints above a thousandth of the rows are a thousand at most.
    named = share_join(placed.select("f", "c", "m"), groups, ["c"], F.col("k") * 1000 > (every[0] or 0)).select("f", "m", "component_id")
    result = share_join(rows, stored(named), ["f"], F.col("m") * 1000 > (every[1] or 0))
    return result.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
