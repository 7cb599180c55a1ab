"""Decision tables, approvals, registrations, continued responses and wide numbers against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import wide
from tracelake.operators import ledger

M = (1 << 64) - 1


def rows(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


@pytest.mark.parametrize("most", [3, 4_096])
def test_decision_table_against_a_loop(spark, most):
    rng = random.Random(most)
    events, want = [], []
    tables, refused = {}, {}
    ts = 0
    for seq in range(3_000 if most == 3 else 9_000):
        ts += rng.random() < (0.3 if most == 3 else 0.01)
        node, key = rng.choice("ab" if most == 3 else "aaaaab"), f"k{rng.randint(0, 9 if most == 3 else 30_000)}"
        op = rng.choice(["begin"] * (4 if most == 3 else 30) + ["approve", "deny", "time_out", "consume", "other"])
        events.append((node, seq, ts, op, key))
        t = tables.setdefault(node, {})
        if op in ("approve", "deny", "time_out"):
            t[key] = ({"approve": "approved", "deny": "denied", "time_out": "timed_out"}[op], ts)
            while len(t) > most and any(v[1] is not None for v in t.values()):
                del t[min((v[1], k) for k, v in t.items() if v[1] is not None)[1]]
        elif op == "consume":
            t.pop(key, None)
        elif op == "begin":
            for k in [k for k, v in t.items() if v[1] is not None and ts - v[1] >= 60]:
                del t[k]
            if key in t:
                met = t[key][0]
            else:
                if len(t) >= most and any(v[1] is not None for v in t.values()):
                    del t[min((v[1], k) for k, v in t.items() if v[1] is not None)[1]]
                met = "reserved" if len(t) < most else "saturated"
                if met == "reserved":
                    t[key] = ("busy", None)
                else:
                    refused[node] = refused.get(node, 0) + 1
            want.append((node, seq, key, met, refused.get(node, 0), len(t)))
    frame = spark.createDataFrame(events, "node string, seq long, ts long, op string, key string")
    got = rows(ledger.decision_outcomes(frame, most), "node", "seq", "key", "outcome", "saturated", "entries")
    assert got == sorted(want, key=repr) and {w[3] for w in want} >= {"reserved", "busy", "approved", "saturated"}


def test_registry_against_a_loop(spark):
    rng = random.Random(4)
    events, state, counts = [], {}, {}
    for seq in range(1_500):
        path, name = f"/p{rng.randint(0, 60)}", rng.choice([None, " ", *(f" n{k} " for k in range(25))])
        op = rng.choice(["register", "register", "revoke", "enable", "disable", "mode", "window", "hash_change", "else"])
        e = {"seq": seq, "op": op, "path": path, "name": name, "hash": f"h{rng.randint(0, 3)}", "mode": rng.choice([None, "allow"]), "ttl": rng.randint(0, 9), "ts": seq * 2}
        events.append(tuple(e.values()))
        c, own = counts.setdefault(path, [0, 0, 0]), state.get(path)
        bare = (name or "").strip()
        if op == "register":
            if own and not own["revoked"]:
                c[0] += 1
            elif bare and any(not s["revoked"] and s["name"] == bare for s in state.values()):
                c[1] += 1
            else:
                state[path] = {"name": bare, "hash": e["hash"], "old": None, "until": None, "enabled": False, "revoked": False, "mode": e["mode"], "at": None, "ttl": e["ttl"]}
        elif own is None:
            c[2] += 1
        elif op == "revoke":
            own |= {"revoked": True, "enabled": False}
        elif op == "enable":
            own |= {"enabled": True, "revoked": False}
        elif op == "disable":
            own["enabled"] = False
        elif op == "mode":
            own["mode"] = e["mode"]
        elif op == "window":
            own |= {"at": e["ts"], "ttl": e["ttl"]}
        elif op == "hash_change" and e["hash"] != own["hash"]:
            own |= {"old": own["hash"], "until": e["ts"] + 3_600, "hash": e["hash"]}
    frame = spark.createDataFrame(events, "seq long, op string, path string, name string, hash string, mode string, ttl long, ts long")
    want = sorted(((p, *state[p].values(), *c) if p in state else (p, *[None] * 9, *c) for p, c in counts.items()), key=repr)
    assert rows(ledger.registry_by_two_keys(frame), "*") == want
    assert all(sum(w[k] for w in want) > 0 for k in (-1, -2, -3))
    assert ledger.registry_by_two_keys(frame.limit(0)).count() == 0


def test_groups_close_over_long_chains(spark):
    links = [(f"p{k:03}", f"n{k}") for k in range(120)] + [(f"p{k + 1:03}", f"n{k}") for k in range(119)] + [("q", None), ("r", "x"), ("s", "x")]
    found = {r.path: r["group"] for r in ledger.connected_names(spark.createDataFrame(links, "path string, name string")).collect()}
    assert {found[f"p{k:03}"] for k in range(120)} == {"p000"} and (found["q"], found["r"], found["s"]) == ("q", "r", "r")


def test_approvals_under_bulk_events(spark):
    events = [("a", 1, "ask", "x"), ("a", 2, "ask", "y"), ("a", 3, "approve", "x"), ("a", 4, "lock", None), ("a", 5, "forget", None), ("a", 6, "ask", "z"), ("a", 7, "clear", None), ("a", 8, "deny", "z"), ("b", 9, "ask", "x"), (None, 10, "ask", "x")]
    frame = spark.createDataFrame(events, "node string, seq long, op string, id string")
    got = rows(ledger.settled_approvals(frame), "node", "id", "seq", "outcome", "settled_at", "gone_at")
    assert got == sorted([("a", "x", 1, "approved", 3, 5), ("a", "y", 2, "locked", 4, 5), ("a", "z", 6, "locked", 7, 7), ("b", "x", 9, "pending", None, None), (None, "x", 10, "pending", None, None)], key=repr)


def test_continued_responses_latest_before_wins(spark):
    said = spark.createDataFrame([("t", "r", "c1", 10), ("t", "r", "c2", 20), ("t", "r", "c3", 20), ("u", "r", "c9", 5), ("t", None, "c0", 1)], "tenant string, response_id string, conversation string, ts long")
    asked = spark.createDataFrame([("t", 1, "r", 10), ("t", 2, "r", 11), ("t", 3, "r", 21), ("t", 4, "r", 2_000), ("u", 5, "r", 6), ("t", 6, "q", 50), ("t", 7, None, 50)], "tenant string, id long, previous_id string, ts long")
    assert {r.id: r.conversation for r in ledger.continued_responses(said, asked).collect()} == {1: None, 2: "c1", 3: "c3", 4: None, 5: "c9", 6: None, 7: None}


def test_wide_numbers_on_edges(spark):
    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & M
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
        return x ^ x >> 31

    rng = random.Random(3)
    edges = [0, 1, 0xFFFF, 0x10000, 0xFEFFFFFF, 0xFF000000, (1 << 63) - 1, 1 << 63, M - 1, M] + [rng.getrandbits(64) for _ in range(300)]
    frame = spark.createDataFrame([(str(x), str(y)) for x, y in zip(edges, reversed(edges))], "x string, y string").select(F.col("x").cast("decimal(20,0)").alias("x"), F.col("y").cast("decimal(20,0)").alias("y"))
    bits = wide.as_bits(F.col("x"))
    found = frame.select("x", "y", wide.splitmix(bits).alias("h"), wide.add(bits, M).alias("a"), wide.multiply(bits, M - 12).alias("m"), ledger.tool_bucket(F.col("x")).alias("b"), ledger.chat_bucket(F.col("x"), F.col("y")).alias("c")).collect()
    for r in found:
        x, y = int(r.x), int(r.y)
        assert (r.h & M, r.a & M, r.m & M) == (mix(x), (x + M) & M, x * (M - 12) & M)
        assert r.b == (x if x < 0xFF000000 else 0xFF000000 + mix(x) % 256)
        turned = (x << 17 | x >> 47) & M
        assert r.c == ((x << 16) + y if x < 0xFF00 and y < 1 << 16 else 0xFF000000 + mix(mix(turned ^ y * 0x9E3779B97F4A7C15 & M)) % 256)


def test_a_group_reads_narrow_rows_of_few_events(spark, monkeypatch):
    seen, fold = {}, ledger.fold_sorted
    monkeypatch.setattr(ledger, "fold_sorted", lambda rows, key, *more: seen.setdefault(key, rows) and fold(rows, key, *more))
    events = [(k, op, f"/p{k % 3}", "n", "h", None, 1, k) for k, op in enumerate(["register", "mode", "window", "hash_change", "disable", "enable", "revoke", "register", "else"])]
    made = ledger.registry_by_two_keys(spark.createDataFrame(events, "seq long, op string, path string, name string, hash string, mode string, ttl long, ts long"))
    assert seen["group"].columns == ["group", "seq", "path", "op", "name"] and seen["group"].count() == 4
    assert made.count() == 3
