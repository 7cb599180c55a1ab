"""Names in a table: both ways against brute force and against the pattern of the small list."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.operators import dictionary as d
from tracelake.operators import pii


def brute(text, names, strict):
    hits = []
    for name, value, kind in names:
        at = (text or "").find(name)
        while at >= 0:
            if d.free(text, at, at + len(name), kind, strict):
                hits.append((at, at + len(name), name, value))
            at = text.find(name, at + 1)
    return d.chosen(hits)


@pytest.mark.parametrize("strict", [False, True])
def test_both_ways_equal_brute_force(spark, strict):
    rng = random.Random(8)
    letters = "abAB01 é東京\U0001f600-"
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.choice([None, "name", "org"]) for _ in range(300)}
    listed = [(n, f"v{i}", k) for i, (n, k) in enumerate(names.items())]
    texts = [None, "", "a"] + ["".join(rng.choice([*letters, rng.choice(listed)[0]]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    table = spark.createDataFrame([*listed, (listed[0][0], "z", None), ("", "x", None)], "name string, value string, kind string")
    want = {k: brute(t, listed, strict) for k, t in enumerate(texts)}
    for most in (1 << 20, 0):
        got = {r.id: [tuple(h) for h in r.hits] for r in d.table_hits(frame, "k", "t", table, strict, most).collect()}
        assert got == want
    vault = table.select("name", "value")
    plain = {k: brute(t, [(n, v, None) for n, v, _ in listed], False) for k, t in enumerate(texts)}
    for most in (1 << 20, 0):
        for r in d.table_replaced(frame, "k", "t", vault, most).collect():
            t, out, done = texts[r.id], "", 0
            for a, z, _, v in plain[r.id]:
                out, done = out + t[done:a] + v, z
            assert r.replaced == (None if t is None else out + t[done:])


def test_same_hits_as_the_pattern_of_a_short_list(spark):
    names = [("Ann", "name"), ("Anna", "name"), ("ACME", "org"), ("王芳", "person")]
    texts = ["Ann, Anna; xAnn Annx ACME ACME1 a王芳b 王芳東", "AnnaACME 王芳. ACME東"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    table = spark.createDataFrame([(n, None, k) for n, k in names], "name string, value string, kind string")
    for strict in (False, True):
        own = {r.k: [(h.start, h.end) for h in r.h] for r in frame.select("k", pii.dictionary_hits(F.col("t"), names, strict).alias("h")).collect()}
        got = {r.id: [(h.start, h.end) for h in r.hits] for r in d.table_hits(frame, "k", "t", table, strict).collect()}
        assert got == own


def test_names_that_share_their_beginning_meet_few_places(spark):
    """Two places a text hold a name; short grams of digits would meet hundreds of names at each."""
    names = spark.range(20_000).select(F.format_string("Customer#%09d", "id").alias("name"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("kind"))
    name = F.format_string("Customer#%09d", F.col("id") * 7)
    texts = spark.range(2_000).select("id", F.concat(F.lit("of "), name, F.lit("7, not Customer#0 ("), name, F.lit(")")).alias("text"))
    assert 4_000 <= d._candidates(texts, names).count() <= 6_000


def test_batches_are_cut_by_what_they_hold():
    texts = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (10, 0, 5, 90, 3, 200, 1)] + [None]})
    cut = [c.column("t").to_pylist() for c in d._few(iter([texts]), "t", 100)]
    assert [[len(t or "") for t in c] for c in cut] == [[10, 0, 5], [90, 3], [200], [1, 0]]
    lists = pa.RecordBatch.from_pydict({"c": pa.array([[1] * n for n in (3, 4, 9, 1)] + [None])})
    assert [c.num_rows for c in d._few(iter([lists]), "c", 7)] == [2, 1, 2]


def test_a_million_names_by_join(spark):
    """The plan has one size whatever the table's, and the hits are right."""
    names = spark.range(1_000_000).select(F.concat(F.lit("user-"), F.hex(F.col("id") * 7_919 + 1), F.lit("@x")).alias("name"), F.col("id").cast("string").alias("value"), F.lit(None).cast("string").alias("kind"))
    texts = spark.range(200).select("id", F.concat(F.lit("to user-"), F.hex(F.col("id") * 7_919 * 3 + 1), F.lit("@x and user-0@x, user-"), F.hex(F.col("id") * 7_919 + 1), F.lit("@x.")).alias("t"))
    found = d.table_hits(texts, "id", "t", names)
    assert {r.id: [h.value for h in r.hits] for r in found.collect()} == {k: [str(3 * k), str(k)] for k in range(200)}
    few = d.table_hits(texts, "id", "t", names.limit(10), most_bytes=0)
    size = lambda f: len(f._jdf.queryExecution().analyzed().toString())
    assert abs(size(found) - size(few)) < 2_000


def test_a_chunk_meets_a_name_once_and_few_places_go_to_their_texts(spark, monkeypatch):
    """What is shuffled for dense texts is a chunk's names, not their places."""
    met, by_chunk = [], d._by_chunk
    monkeypatch.setattr(d, "_by_chunk", lambda chunked, own, strict: met.append(own.count()) or by_chunk(chunked, own, strict))
    table = spark.createDataFrame([("alpha", "1", "org"), ("beta", "2", None), ("gamma", "3", "org")], "name string, value string, kind string")
    dense = spark.createDataFrame([(k, f"alpha betas {k} alphas " * 50) for k in range(100)], "id long, text string")
    found = d.table_hits(dense, "id", "text", table, most_bytes=0).collect()
    assert len(found) == 100 and all([h.name for h in r.hits] == ["alpha", "beta"] * 50 for r in found)
    assert len(met) == 1 and met[0] <= 2 * 2 * spark.sparkContext.defaultParallelism
    sparse = spark.createDataFrame([(k, "x " * 3_000 + f"gamma {k}") for k in range(20)], "id long, text string")
    assert {r.id: [tuple(h) for h in r.hits] for r in d.table_hits(sparse, "id", "text", table, most_bytes=0).collect()} == {k: [(6_000, 6_005, "gamma", "3")] for k in range(20)}
    assert len(met) == 1


def test_names_that_a_task_takes_whole_are_bounded(spark, monkeypatch):
    """Two million bytes of names go to chunks of texts, not to every task."""
    monkeypatch.setattr(d, "_by_automaton", None)
    names = spark.range(200_000).select(F.format_string("n%09d", "id").alias("name"), F.lit("v").alias("value"), F.lit("org").alias("kind"))
    texts = spark.range(50).select("id", F.format_string("of n%09d.", F.col("id") * 3).alias("text"))
    assert all(len(r.hits) == 1 for r in d.table_hits(texts, "id", "text", names).collect())


def test_places_of_texts_that_no_name_shares_are_left_out(spark):
    """However many names there are: 200,000 grams would fill a fortieth of a megabyte's bits, and each be met by as many places."""
    names = spark.range(200_000).select(F.format_string("n%09d", "id").alias("name"), F.lit("v").alias("value"), F.lit("org").alias("kind"))
    texts = spark.range(200).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.sha2(F.concat("id", F.lit("-"), k), 256)), "").alias("text"))
    assert d._keyed(d._chunked(texts)[0], names)[1].count() < 50


def test_texts_are_dealt_once(spark):
    table = spark.createDataFrame([("alpha", "1", "org")], "name string, value string, kind string")
    dense = spark.createDataFrame([(k, "alpha " * 50) for k in range(20)], "id long, text string")
    plan = d.table_hits(dense, "id", "text", table, most_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_whole_names_are_met_only_where_they_stand_free(spark):
    listed = [("alpha", "1", "org"), ("beta", "2", None), ("gamma", "3", "person"), ("alphabetagamma12", "4", "org")]
    table = spark.createDataFrame(listed, "name string, value string, kind string")
    texts = ["alphas xalpha alpha1", "betas", "gammas", "alpha", "(alpha)", "éalpha東", "alphabetagamma12", "alphabetagamma123", "alpha" * 9]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert d._keyed(d._chunked(frame.filter("id in (0, 8)"))[0], table.filter("name = 'alpha'"))[1].count() == 0
    assert {r.id: [tuple(h) for h in r.hits] for r in d.table_hits(frame, "id", "text", table, most_bytes=0).collect()} == {k: brute(t, listed, False) for k, t in enumerate(texts)}
