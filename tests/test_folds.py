"""Folds on small tables: boundaries, missing keys, empty tables."""

import hashlib
import random

from pyspark.sql import functions as F

from tracelake.functions.lookup import dictionary_hits, execution_key, names_pattern
from tracelake.operators import folds, metrics


def test_sliding_admit_at_the_boundary_and_without_a_key(spark):
    rows = [(1, 7, 0), (2, 7, 10), (3, 7, 59), (4, 7, 60), (5, None, 0), (6, None, 0), (7, None, 0), (8, 9, None)]
    found = folds.sliding_admit(spark.createDataFrame(rows, "id long, k long, t long"), "k", "t", "id", 2, 60).collect()
    assert {r.id: (r.admitted, r.retry_secs) for r in found} == {1: (True, 0), 2: (True, 0), 3: (False, 1), 4: (True, 0), 5: (True, 0), 6: (True, 0), 7: (False, 60)}


def test_sliding_admit_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), rng.randrange(2_000)) for i in range(600)]
    want, kept = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        live = [x for x in kept.get(k, []) if t - x < 100]
        want[i] = len(live) < 4
        kept[k] = live + [t] * want[i]
    found = folds.sliding_admit(spark.createDataFrame(rows, "id long, k long, t long"), "k", "t", "id", 4, 100).collect()
    assert {r.id: r.admitted for r in found} == want


def test_registry_state(spark):
    log = [
        (1, 1, "revoke", None, 5), (1, 2, "register", "a", 10), (1, 3, "register", "b", 11), (1, 4, "approve_always", None, 12), (1, 5, "hash_change", "c", 13), (1, 6, "note", None, 14),
        (2, 1, "register", "x", 1), (2, 2, "reject", None, 2), (2, 3, "register", "y", 3),
    ]
    events = spark.createDataFrame(log, "caller long, seq long, op string, hash string, ts long")
    found = {r.caller: r for r in folds.registry_state(events).collect()}
    assert tuple(found[1])[1:] == ("c", "a", 13 + folds.GRACE, True, False, "allow", 12, 1, 1)
    assert tuple(found[2])[1:] == ("y", None, None, False, False, None, None, 0, 0)
    assert folds.registry_state(events.limit(0)).count() == 0


def test_first_decisions(spark):
    tickets = spark.createDataFrame([(1, 0, 1), (1, 50, 2), (2, 0, 3), (3, 0, 4)], "key long, ts long, id long")
    reactions = spark.createDataFrame([(1, 60, 5, False), (1, 70, 6, True), (2, 301, 7, True), (3, 300, 8, True)], "key long, ts long, id long, approved boolean")
    found = {r.id: (r.state, r.waited_secs) for r in folds.first_decisions(tickets, reactions).collect()}
    assert found == {1: ("denied", 60), 2: ("denied", 10), 3: ("timeout", None), 4: ("approved", 300)}


def test_dictionary_takes_the_longest_name_and_escapes_signs(spark):
    texts = spark.createDataFrame([(1, "a.b abc ab a.bc"), (2, None), (3, "")], "id long, text string")
    found = texts.select("id", dictionary_hits(F.col("text"), ["ab", "a.b", "abc", ""]).alias("h")).collect()
    assert {r.id: r.h for r in found} == {1: ["a.b", "abc", "ab", "a.b"], 2: [], 3: []}
    assert texts.select(dictionary_hits(F.col("text"), []).alias("h")).first().h == [] and names_pattern([]) == r"(?!)"


def test_execution_key(spark):
    row = spark.range(1).select(execution_key(F.lit("a"), F.lit(None), F.lit("é")).alias("k")).first()
    assert row.k == hashlib.sha256(b"a\0\0" + "é".encode() + b"\0").hexdigest()


def test_min_gap_holds_no_list_of_a_busy_key(spark):
    rng = random.Random(8)
    times = [(1, t) for t in range(0, 6_000, 2)] + [(k, rng.randrange(900)) for k in (2, None) for _ in range(300)] + [(3, None), (3, 4), (3, 4), (4, None)]
    want = {}
    for k, t in sorted(times, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        last, hits, admitted = want.get(k, (None, 0, 0))
        ok = t is not None and (last is None or t - last >= 7)
        want[k] = (t if ok else last, hits + 1, admitted + ok)
    found = metrics.min_gap_admit(spark.createDataFrame(times, "k long, t long"), "k", "t", 7)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert {r.k: (r.hits, r.admitted) for r in found.collect()} == {k: v[1:] for k, v in want.items()}
