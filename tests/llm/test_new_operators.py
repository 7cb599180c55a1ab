"""Collocations, periodic runs and SimHash groups against brute-force versions."""

import os
import random
import sys
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tracelake.llm import collocations, periodic_runs, simhash  # noqa: E402
from tracelake.llm import queries as q  # noqa: E402

OP11 = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def table(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=lambda r: tuple((v is None, v) for v in r))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_op11(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select("lang", "text").collect()]
    got = table(q.op11_collocations(spark, sf_dir), *OP11)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(q.ORACLE_SQL["op11_collocations"])
    columns = [c[0] for c in found.description]
    assert columns == OP11 and got == brute.op11(rows) == sorted(found.fetchall())


@pytest.mark.parametrize(("least", "top", "most"), [(5, 40, 200_000), (3, 2000, 6), (8, 300, 1)])
def test_op11_small_counts_and_prefixes_that_are_split(documents, least, top, most):
    few = documents.filter("n_chars < 4000")
    rows = [tuple(r) for r in few.select("lang", "text").collect()]
    assert table(collocations.phrase_collocations(few, least, top, most), *OP11) == brute.op11(rows, least, top)


def test_op11_odd(spark):
    """Null languages and texts, ties, one word, pieces, hot phrases, clashing columns."""
    rows = [("en", "a b c a b c. a b\tc; A B C\nc a " * 30), (None, "x y " * 50), ("und", "x y! " * 60), ("en", None), ("de", ""), ("", "é É é É " * 40), ("fr", "w " * 300), ("en", "of the p" + " q of the" * 90)]
    frame = spark.createDataFrame([(lang, text, 1, "a", 2) for lang, text in rows], "lang string, text string, w0 int, words string, c int")
    for most in (200_000, 2):
        assert table(collocations.phrase_collocations(frame, 20, 5, most), *OP11) == brute.op11(rows, 20, 5)
    assert collocations.phrase_collocations(frame.limit(0)).count() == 0
    rng = np.random.default_rng(3)
    rows = [("en", " ".join(rng.choice(list("abcd"), 400))) for _ in range(6)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    for most in (200_000, 30):
        assert table(collocations.phrase_collocations(frame, 4, 2000, most), *OP11) == brute.op11(rows, 4)


OP12 = ["doc_id", *periodic_runs.DIGESTS]


def test_op12(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.filter("n_chars < 20000").select("doc_id", "text").collect()]
    got = [r for r in table(q.op12_periodic_runs(spark, sf_dir), *OP12) if r[0] in {i for i, _ in rows}]
    assert got == brute.op12(rows)


def test_op12_runs_of_all_kinds():
    """Random words over few letters, loops of all periods, runs within and beside others, long runs."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        parts = []
        for _ in range(rng.integers(1, 6)):
            base = rng.integers(0, rng.integers(2, 6), rng.integers(1, 40))
            parts += [np.resize(base, rng.integers(1, 7 * len(base))), rng.integers(0, 3, rng.integers(0, 30))]
        w = np.concatenate(parts).astype(np.int64)
        found = {r for a, z in periodic_runs.stretches(w, np.array([0, len(w)])) for r in periodic_runs.runs_within(w, a, z)}
        assert sorted(found, key=lambda r: (r[0], r[2])) == brute.runs_of(w.tolist())
    long = np.resize(rng.integers(0, 9, 3), 300_000)
    assert periodic_runs.runs_within(long, 0, len(long)) == [(0, 300_000, 3)]
    wide = np.resize(rng.integers(0, 1 << 30, 70_000), 260_000)
    assert periodic_runs.runs_within(wide, 0, len(wide)) == [(0, 260_000, 70_000)]


def test_op12_odd(spark):
    rows = [(1, "a b " * 30), (2, None), (3, ""), (4, " \n"), (None, "x y z " * 9), (None, None), (5, "É " * 24), (6, "É " * 23), (7, "u " * 10 + "a b c d e f g h i " * 3 + "a"), (7, "t t"), (10, "w " * 50)]
    frame = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, start int, runs string, n_runs int")
    for loops in (True, False):
        assert table(periodic_runs.run_digests(frame, loops), *OP12) == brute.op12(rows, loops)
    got = {r.doc_id: r for r in periodic_runs.collapse_runs(frame).filter("doc_id is not null").collect()}
    assert got[1].collapsed == "a b" and got[1].runs[0].asDict() == {"start": 0, "length": 60, "period": 2}
    assert got[2].collapsed == "" and got[2].runs == [] and got[6].collapsed.count("É") == 23
    assert periodic_runs.run_digests(frame.limit(0)).count() == 0


OP13 = ["doc_id", "fingerprint", "component_id"]


def test_op13(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert table(q.op13_simhash(spark, sf_dir), *OP13) == brute.op13(rows)


def test_op13_balls(spark):
    """All pairs at distance one and two, chains, dense balls and signed values."""
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    values = {0, (1 << 64) - 1, 1 << 63}
    for s in seeds.tolist():
        for _ in range(rng.integers(1, 12)):
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                s ^= 1 << b
            values.add(s)
    values |= {1 << b for b in range(64)} | {3 << b for b in range(20)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {}
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "f long")).collect():
        assert ((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= 2
        parent[root(r.u)] = root(r.v)
    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                assert root(a) == root(b)
            found.setdefault(root(a), set()).add(a)


def test_op13_odd(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base), (2, base.replace("word7 ", "other ")), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "ONE two"), (8, "É x"), (9, "é x"), (10, base), (10, base), (None, base), (None, None), (12, "x y z " * 4000)]
    frame = spark.createDataFrame([(i, t, 1, "a", 2, "b") for i, t in rows], "doc_id long, text string, f int, c string, m int, component_id string")
    assert table(simhash.simhash_components(frame), *OP13) == brute.op13(rows)
    assert simhash.simhash_components(frame.filter("doc_id is null")).filter("component_id is null").count() == 2
    assert simhash.simhash_components(frame.limit(0)).count() == 0
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    assert format(int(simhash.fingerprints(pa.array([long, "a"]))[0]), "016x") == brute.simhash(long)


def test_what_is_cut_leaves_no_shuffle_files(spark):
    from tracelake.llm import session

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows, setting = spark.range(10_000).withColumn("k", F.col("id") % 97), spark.conf.get(name)
    for keep in (session.cut, session.stored):
        before = shuffled()
        out = keep(rows.repartition(7, "k").groupBy("k").agg(F.count("*").alias("n")))
        until = time.time() + 5
        while shuffled() - before and time.time() < until:  # they go a moment later
            time.sleep(0.1)
        assert not shuffled() - before and spark.conf.get(name) == setting
        assert {r.k: r.n for r in out.collect()} == {k: len(range(k, 10_000, 97)) for k in range(97)}


def test_followers_do_not_depend_on_the_rounds(spark):
    from tracelake.llm import ngram_join

    rng = random.Random(5)
    listed = [(k, 40, sorted(rng.sample(range(-300, 300), 9))) for k in range(200)]
    reps = spark.createDataFrame(listed, "node long, n long, prefix array<long>")
    once, often = ({tuple(r) for r in ngram_join._followers(reps, (4, 5), most).collect()} for most in (1 << 22, 300))
    assert once == often and len(once) > 200
