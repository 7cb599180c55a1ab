"""Phrase collocations by contiguous pattern growth (PrefixSpan without gaps).

1. Words are counted exactly by language.  A word's number is its 64-bit hash, under a seed for which
   no two words of one language have the same number; that is checked over the whole vocabulary.
2. Pairs of frequent words are counted.  Frequent words, and then frequent pairs, are known to the
   tasks by a bitmap of fixed size (4 MB); words that share a bit are counted too and go afterwards.
3. Every place where a frequent pair begins is an occurrence of that prefix.  It is projected on the
   words that follow it, as far as the pairs stay frequent; equal projections of a slice are one row
   with a count.
4. One task a prefix: its rows come sorted, and the prefix grows to the right depth first, a row range
   standing for the pointers of each longer prefix.  A prefix with more than ``most`` rows is not one
   task: a distributed count grows it by one word, and each of its longer prefixes is a task of its own.
5. Parts of a phrase are phrases that occur as often at least, so their counts are all there; they are
   joined, those of parts above a thousandth of all words by broadcast (a few thousand at most).
6. The best of a language are cut out by a histogram of its scores, then sorted.

Defined results: null and empty texts have no words; a null language is ``und``; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import stored
from .text import LOWER, U64, mix, slices, word_bounds, word_codes

PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATOR = PIECE_END.copy()
SEPARATOR[[0x20, 0x09]] = True
#: Bits of the bitmaps of frequent words and pairs.
BITS = 1 << 25
SLICE = 1 << 22
LONGEST = 5
WORDS = [f"w{i}" for i in range(LONGEST)]


def _hash(word: bytes | str, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed)


class _Slice:
    """Words of some whole texts: numbers, languages, and where a piece begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, names: list[str], seed: int):
        lower = LOWER[data]
        starts, ends, first = word_bounds(lower, offsets, SEPARATOR)
        self.code, words = word_codes(lower, starts, ends, SEPARATOR)
        self.words, self.names = words.cast(pa.large_binary()).to_pylist(), names
        self.id = np.array([_hash(w, seed) for w in self.words], np.uint64)
        self.lang = np.repeat(lang, np.diff(first))
        self.lang_hash = np.array([_hash(x, seed) for x in names], np.uint64)[self.lang] if len(names) else np.zeros(0, np.uint64)
        piece = np.append(0, np.cumsum(PIECE_END[lower]))[starts]
        self.joined = np.zeros(len(starts), bool)  # with the next word
        self.joined[:-1] = piece[1:] == piece[:-1]
        last = first[1:] - 1
        self.joined[last[(last >= first[:-1]) & (last >= 0)]] = False

    def frequent(self, bitmap: np.ndarray) -> np.ndarray:
        return _marked(bitmap, place(self.lang_hash, self.id[self.code]))

    def frequent_pairs(self, bitmap: np.ndarray) -> np.ndarray:
        out = self.joined.copy()
        at = np.flatnonzero(out)
        out[at] = _marked(bitmap, place(self.lang_hash[at], self.id[self.code[at]], self.id[self.code[at + 1]]))
        return out


def place(lang: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """The bit of a word or of a pair of words in a bitmap."""
    x = mix(first + lang * U64(0x9E3779B97F4A7C15))
    if second is not None:
        x = mix(x * U64(0xD6E8FEB86659FD93) + second)
    return (x & U64(BITS - 1)).astype(np.int64)


def _marked(bitmap: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def _mapped(docs: DataFrame, rows: Callable[[_Slice], dict[str, pa.Array] | None], schema: str, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            lang, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary.to_pylist()
            for low, high, data, offsets in slices(b.column("text"), SLICE):
                part = _Slice(data, offsets, lang[low:high], names, seed)
                if len(part.code) and (found := rows(part)):
                    yield pa.RecordBatch.from_pydict(found)

    return docs.mapInArrow(run, schema)


def _ids(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64(), mask=mask)


def _names(part: _Slice, lang: np.ndarray) -> pa.Array:
    return pa.array(part.names, pa.string()).take(pa.array(lang))


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id and n of every word."""

    def rows(part: _Slice) -> dict[str, pa.Array]:
        key, n = np.unique(part.lang * len(part.words) + part.code, return_counts=True)
        lang, code = key // len(part.words), key % len(part.words)
        words = pa.array(part.words, pa.binary()).cast(pa.string()).take(pa.array(code))
        return {"lang": _names(part, lang), "word": words, "id": _ids(part.id[code]), "n": pa.array(n)}

    found = _mapped(docs, rows, "lang string, word string, id long, n long", seed)
    return stored(found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")))


def _bitmap(frequent: DataFrame, names: list[str], seed: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([_hash(x, seed) for x in b.column("lang").to_pylist()], np.uint64)
            ids = [b.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for name in names]
            yield pa.RecordBatch.from_pydict({"p": pa.array(place(lang, *ids) + 1)})

    bits = frequent.select("lang", *names).mapInArrow(run, "p long")
    rows = bits.groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("v")).collect()  # 1,024 rows of 4 KB at most
    bitmap = np.zeros(BITS // 8, np.uint8)
    for bucket, filled in rows:
        bitmap[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(filled, np.uint8)
    return bitmap


def frequent_pairs(docs: DataFrame, words: np.ndarray, least: int, seed: int) -> DataFrame:
    """lang, w0, w1 and a of the pairs that occur ``least`` times or more."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # 4 MB

    def rows(part: _Slice) -> dict[str, pa.Array]:
        often, size = part.frequent(shared.value), len(part.words)
        at = np.flatnonzero(part.joined[:-1] & often[:-1] & often[1:])
        key, n = np.unique((part.lang[at] * size + part.code[at]) * size + part.code[at + 1], return_counts=True)
        return {"lang": _names(part, key // size // size), "w0": _ids(part.id[key // size % size]), "w1": _ids(part.id[key % size]), "n": pa.array(n)}

    found = _mapped(docs, rows, "lang string, w0 long, w1 long, n long", seed)
    return stored(found.groupBy("lang", "w0", "w1").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))


def projections(docs: DataFrame, pairs: np.ndarray, seed: int) -> DataFrame:
    """lang, w0 to w4 and c: the occurrences of frequent pairs with the words behind them, one at least."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)  # 4 MB

    def rows(part: _Slice) -> dict[str, pa.Array] | None:
        good, size = part.frequent_pairs(shared.value), len(part.words) + 1
        after = np.append(good, np.zeros(LONGEST, bool))
        at = np.flatnonzero(good & after[1 : len(good) + 1])
        if not len(at):
            return None
        code = np.append(part.code, np.zeros(LONGEST, np.int64))
        key, inside, columns = part.lang[at] * size + code[at], np.ones(len(at), bool), [code[at]]
        for k in range(1, LONGEST):
            inside = inside & after[at + k - 1]
            columns.append(np.where(inside, code[at + k], -1))
            key = np.unique(key * size + columns[-1] + 1, return_inverse=True)[1]
        _, one, n = np.unique(key, return_index=True, return_counts=True)
        out = {"lang": _names(part, part.lang[at[one]])}
        for name, column in zip(WORDS, columns):
            out[name] = _ids(part.id[column[one]], mask=column[one] < 0)
        return out | {"c": pa.array(n)}

    return stored(_mapped(docs, rows, "lang string, " + "".join(f"{w} long, " for w in WORDS) + "c long", seed))


def grow(columns: list[np.ndarray], there: list[np.ndarray], count: np.ndarray, low: int, high: int, prefix: tuple[int, ...], least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Frequent extensions of a prefix that the sorted rows ``low`` to ``high`` share, depth first.

    Row ranges are the projected pointers; rows that end with the prefix come first.
    """
    depth = len(prefix)
    low += int((~there[depth][low:high]).sum())
    if low == high:
        return
    column = columns[depth][low:high]
    bounds = np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1)
    sums = np.add.reduceat(count[low:high], bounds)
    ends = np.append(bounds[1:], high - low)
    for k in np.flatnonzero(sums >= least).tolist():
        longer = (*prefix, int(column[bounds[k]]))
        yield longer, int(sums[k])
        if depth + 1 < LONGEST:
            yield from grow(columns, there, count, low + int(bounds[k]), low + int(ends[k]), longer, least)


def _grown(tasks: DataFrame, least: int) -> DataFrame:
    """lang, words and a of the frequent phrases of all tasks; rows have level, the length of their prefix."""

    def complete(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang = rows["lang"].combine_chunks().dictionary_encode()
        code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
        level, count = rows["level"].to_numpy(), rows["c"].to_numpy()
        there = [rows[w].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for w in WORDS]
        columns = [rows[w].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for w in WORDS]
        low, out = 0, []
        for high in [*_task_starts(rows)[1:].tolist(), len(code)]:
            prefix = tuple(int(columns[k][low]) for k in range(level[low]))
            if (a := int(count[low:high].sum())) >= least:
                if len(prefix) > 2:
                    out.append((names[code[low]], prefix, a))
                out += [(names[code[low]], words, n) for words, n in grow(columns, there, count, low, high, prefix, least)]
            low = high
        if out:
            langs, words, n = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["lang", "words", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if _task(b, b.num_rows - 1) != _task(held[0], 0):  # else all that is held is one task
                rows = pa.Table.from_batches(held).combine_chunks()
                last = int(_task_starts(rows)[-1])
                yield from complete(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held:
            yield from complete(pa.Table.from_batches(held).combine_chunks())

    return tasks.mapInArrow(run, "lang string, words array<long>, a long")


def _task(rows: pa.RecordBatch, i: int) -> list:
    level = rows["level"][i].as_py()
    return [level, rows["lang"][i].as_py(), *(rows[w][i].as_py() for w in WORDS[:level])]


def _task_starts(rows: pa.Table) -> np.ndarray:
    """First row of each task."""
    lang = rows["lang"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    level = rows["level"].to_numpy()
    new = np.ones(len(lang), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (level[1:] != level[:-1])
    for k, w in enumerate(WORDS[:-1]):
        x = rows[w].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        new[1:] |= (level[1:] > k) & (x[1:] != x[:-1])
    return np.flatnonzero(new)


def long_phrases(rows: DataFrame, least: int, most: int) -> DataFrame:
    """lang, words and a of the frequent phrases of three words and more."""
    tasks, counted = [], []
    for level in range(2, LONGEST):
        prefix = ["lang", *WORDS[:level]]
        sizes = rows.groupBy(*prefix).agg(F.count("*").alias("rows"), F.sum("c").alias("a"))
        large = stored(sizes.filter((F.col("rows") > most) & (F.col("a") >= least)).select(*[F.col(p).alias(f"_{p}") for p in prefix], "a"))
        none = large.isEmpty()
        same = [F.col(p) == F.col(f"_{p}") for p in prefix]
        small = rows if none else rows.join(large, same, "left_anti")
        tasks.append(small.withColumn("level", F.lit(level)).withColumn("task", F.xxhash64(F.lit(level), *prefix)))
        if none:
            break
        if level > 2:
            counted.append(large.select(F.col("_lang").alias("lang"), F.array(*[f"_{w}" for w in WORDS[:level]]).alias("words"), "a"))
        rows = rows.join(large, same, "left_semi").filter(F.col(WORDS[level]).isNotNull())
    else:
        whole = rows.groupBy("lang", *WORDS).agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
        counted.append(whole.select("lang", F.array(*WORDS).alias("words"), "a"))
    every = tasks[0]
    for t in tasks[1:]:
        every = every.unionByName(t)
    found = _grown(every.repartition("task").sortWithinPartitions("level", "lang", *WORDS).drop("task"), least)
    for c in counted:
        found = found.unionByName(c)
    return found


def share_join(left: DataFrame, right: DataFrame, keys: list[str], large: Column) -> DataFrame:
    """Inner join with ``right``, unique by ``keys``; its rows marked ``large``, of bounded number, are broadcast."""
    few, rest = F.broadcast(right.filter(large)), right.filter(~large)
    return left.join(few, keys).unionByName(left.join(few, keys, "left_anti").join(rest, keys))


def scored(phrases: DataFrame, totals: DataFrame, every: int) -> DataFrame:
    """lang, words, a, l, r, n and score of the candidates that no longer one stands for."""
    longer = phrases.filter(F.size("words") > 2)
    inner = [F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)]
    # An occurrence of a longer phrase is one of each of its parts, so counts are the same where parts stand in it only.
    within = longer.select("lang", F.explode(F.array(*inner)).alias("words"), F.col("a").alias("above"))
    whole = phrases.filter(F.size("words") > 1)
    candidates = whole.join(within.groupBy("lang", "words").agg(F.max("above").alias("above")), ["lang", "words"], "left").filter("above is null or above < a").drop("above")
    cuts = stored(candidates.withColumnRenamed("words", "phrase").select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", F.explode(F.array(F.lit(True), F.lit(False))).alias("first")).select(
        "lang", "phrase", "a", "k", "first",
        F.when(F.col("first"), F.slice("phrase", F.lit(1), F.col("k"))).otherwise(F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))).alias("words"),
    ))
    parts = share_join(cuts, phrases.select("lang", "words", F.col("a").alias("f")), ["lang", "words"], F.col("f") * 1000 > every)
    both = [F.max(F.when((F.col("k") == k) & (F.col("first") == side), F.col("f"))).alias(f"{name}{k}") for k in range(1, LONGEST) for name, side in (("l", True), ("r", False))]
    wide = parts.groupBy("lang", "phrase", "a").agg(*both).join(totals, "lang")
    # Exact: a and n have 17 digits at most, so 1000 * a * n has 38.
    whole_number = lambda c: F.col(c).cast("decimal(17,0)")
    above = (whole_number("a") * whole_number("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")

    def cut(k: int) -> Column:
        below = (whole_number(f"l{k}") * whole_number(f"r{k}")).cast("decimal(35,0)")
        score = F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)"))
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    least = F.array_min(F.array(*[cut(k) for k in range(1, LONGEST)]))
    return wide.withColumn("cut", least).select("lang", F.col("phrase").alias("words"), "a", "cut.l", "cut.r", "n", "cut.score")


def best(rows: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase."""
    rows = stored(rows.withColumn("bucket", F.floor(F.log2(F.col("score") + F.lit(1.0)) * 16).cast("int")))
    sizes = rows.groupBy("lang", "bucket").agg(F.count("*").alias("m"))
    above = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("bucket"))) - F.col("m")
    bound = sizes.withColumn("above", above).filter(F.col("above") < top).groupBy("lang").agg(F.min("bucket").alias("bound"))
    few = rows.join(bound, "lang").filter("bucket >= bound").drop("bucket", "bound")
    spelled = few.select("*", F.posexplode("words").alias("at", "id")).join(names.select("lang", "id", "word"), ["lang", "id"])
    parts = F.array_sort(F.collect_list(F.struct("at", "word")))  # five at most
    phrase = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(parts.alias("parts")).withColumn("phrase", F.array_join("parts.word", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrase.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_collocations(documents: DataFrame, least: int = 100, top: int = 2000, most: int = 200_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language."""
    docs = documents.select(F.coalesce(documents["lang"], F.lit("und")).alias("lang"), F.coalesce(documents["text"], F.lit("")).alias("text"))
    seed = 0
    while True:
        words = vocabulary(docs, seed)
        if words.groupBy("lang", "id").agg(F.count("*").alias("m")).filter("m > 1").isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.filter(F.col("n") >= least)
    pairs = frequent_pairs(docs, _bitmap(often, ["id"], seed), least, seed)
    rows = projections(docs, _bitmap(pairs, ["w0", "w1"], seed), seed)
    singles = often.select("lang", F.array("id").alias("words"), F.col("n").alias("a"))
    twos = pairs.select("lang", F.array("w0", "w1").alias("words"), "a")
    phrases = stored(long_phrases(rows, least, most).unionByName(singles).unionByName(twos))
    every = totals.agg(F.sum("n")).first()[0] or 0
    return best(scored(phrases, totals, every), often, top)
