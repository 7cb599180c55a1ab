"""Rule, policy and registry files."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.sources import rules


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_names_and_rules(spark, tmp_path):
    names = write(tmp_path, "names.txt", "Ann # first\n\n# none\nBob\n")
    assert [r.name for r in rules.name_list(spark, names).collect()] == ["Ann", "Bob"]
    assert rules.load_rules(spark, names, "dict") == [("Ann", "name"), ("Bob", "name")]
    with pytest.raises(ValueError):
        rules.load_rules(spark, names)
    pairs = rules.load_rules(spark, write(tmp_path, "r.json", "\ufeff" + json.dumps({"patterns": [{"name": "a", "pattern": "x+"}, {"name": "b", "pattern": "("}]})))
    assert pairs == [("a", "x+"), ("b", "(")]
    assert rules.load_rules(spark, write(tmp_path, "d.yaml", "names:\n  - Eve\n  - {name: Zoe, type: person}\n"), "dict") == [("Eve", "name"), ("Zoe", "person")]
    with pytest.raises(ValueError):
        rules.load_rules(spark, write(tmp_path, "bad.json", '[{"name": 1}]'))
    with pytest.raises(ValueError):
        rules.load_rules(spark, write(tmp_path, "big.json", " " * (rules.LIMIT + 1)))


def test_checked_patterns_of_the_engine_that_runs_them(spark):
    given = [("a", "x++y"), ("b", r"(?a:q)"), ("c", r"\Aok\Z")]
    assert [n for n, _ in rules.checked_patterns(given)] == ["a", "b", "c"] and [n for n, _ in rules.checked_patterns(given, spark=spark)] == ["a", "c"]


def test_checked_patterns():
    given = [("a", "x+"), ("a", "y"), ("email", "z"), ("b", r"\bq"), ("c", "(?P<n>q)"), ("d", "("), ("e", "(?:q)")]
    assert rules.checked_patterns(given) == [("a", "x+"), ("e", "(?:q)")]


def test_literal_prefix():
    cases = {"abc+": "abc", "abc?d": "ab", r"a\.b[0-9]": "a.b", "a|b": "", "^a": "", "x{2}": "", "order-[0-9]+": "order-", r"\d": ""}
    assert {p: rules.literal_prefix(p) for p in cases} == cases


def test_policy(spark, tmp_path):
    text = json.dumps({"deny": ["rm"], "dangerous": ["drop => no drops [network]", {"pattern": "x", "reason": "y"}], "mode": "block", "internal_suffixes": [".corp"]})
    policy, mode = rules.load_policy(spark, write(tmp_path, "p.json", text))
    assert (policy.deny, policy.internal, mode) == (("rm",), (".corp",), "block") and policy.dangerous == (("drop", "no drops", True), ("x", "y", False))
    policy, mode = rules.load_policy(spark, write(tmp_path, "p.yaml", "extra_block_substrings:\n  - evil\nallow: []\n"))
    assert (policy.block, mode) == (("evil",), "off") and rules.load_policy(spark, str(tmp_path / "p.yaml"), "approve")[1] == "approve"
    for bad in ('{"nope": []}', '{"mode": "x"}', '{"deny": "rm"}', '{"dangerous": ["no arrow"]}', "[]"):
        with pytest.raises(ValueError):
            rules.load_policy(spark, write(tmp_path, "bad.json", bad))


def test_registry(spark, tmp_path):
    schema = "caller_path string, expected_hash string, revoked boolean"
    callers = spark.createDataFrame([("/b", "h2", True), ("/a", None, False)], schema)
    text = rules.registry_text(callers)
    back = rules.load_registry(spark, write(tmp_path, "reg.json", text), schema)
    assert [tuple(r) for r in back.collect()] == [("/a", None, False), ("/b", "h2", True)]
    with pytest.raises(ValueError):
        rules.load_registry(spark, write(tmp_path, "forged.json", text.replace("h2", "h3")), schema)
    old = rules.load_registry(spark, write(tmp_path, "old.json", '{"/c": {"expected_hash": "h"}}'), schema)
    assert [tuple(r) for r in old.select("caller_path", F.col("expected_hash")).collect()] == [("/c", "h")]
    assert rules.registry_text(callers.limit(0)).startswith("{")


def test_registry_of_any_size(spark, tmp_path):
    schema = "caller_path string, expected_hash string, revoked boolean"
    n = 100_000
    callers = spark.range(n).select(F.concat(F.lit("/srv/"), "id").alias("caller_path"), F.sha2(F.col("id").cast("string"), 256).alias("expected_hash"), (F.col("id") % 2 == 0).alias("revoked"))
    with pytest.raises(ValueError):
        rules.registry_text(callers)
    path = str(tmp_path / "registry")
    rules.write_registry(callers, path)
    back = rules.read_registry(spark, path, schema)
    assert back.count() == n and back.exceptAll(callers).isEmpty()
    lines = spark.read.text(f"{path}/entries")
    for k, changed in enumerate((lines.filter("value not like '%/srv/77777\"%'"), lines.union(lines.limit(1)), lines.select(F.replace("value", F.lit("/srv/5\""), F.lit("/srv/x\""))))):
        other = str(tmp_path / f"forged{k}")
        changed.write.text(f"{other}/entries")
        spark.read.text(f"{path}/digest").write.text(f"{other}/digest")
        with pytest.raises(ValueError):
            rules.read_registry(spark, other, schema)
