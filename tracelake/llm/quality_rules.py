"""Weakly supervised quality rules: rules vote or abstain, EM weighs them, a posterior decides.

Everything runs as DataFrame expressions.  The only thing that reaches the driver is the table of
vote patterns, which has at most ``3 ** len(RULES)`` rows whatever the corpus size; expectation-
maximisation over it estimates the accuracy of each rule and the share of good documents, and the
posterior is a weighted sum of votes evaluated inside the JVM.

Defined results: a null or blank text has no words, fails the base rule and is not kept; a null
``doc_id`` is passed through; repeated rows each get their own result; an empty table gives an
empty result with the same schema.  Other input columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

SPACE = r"[\x20\x09-\x0D]+"
# Very common function words of the corpus languages (en, fr, de, es).
FUNCTION_WORDS = (
    "the of and to in is was that it for on with as are be this by from at or an "
    "le la les de du des et un une en que qui dans pour par sur au aux est pas "
    "der die das und ein eine zu den dem mit von nicht sich auf ist im "
    "el los las y se con para no una su al lo como por"
).split()
RULES = ("word_length", "symbols", "duplicate_lines", "repeats", "function_words", "capitals", "variety")


@dataclass(frozen=True)
class VoteModel:
    """Prior log-odds of a good document, and per rule what an up or a down vote adds to them."""

    prior: float
    up: tuple[float, ...]
    down: tuple[float, ...]


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def rule_features(documents: DataFrame) -> DataFrame:
    """Base counts and the vote of every rule, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = documents.select(documents["doc_id"], text.alias("t")).select(
        "doc_id",
        "t",
        F.filter(F.split("t", SPACE, -1), lambda w: w != "").alias("words"),
        lines.alias("lines"),
    )
    hashes = F.when(
        F.size("words") >= 3,
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    counted = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[A-Z]", ""))).cast("long").alias("n_capitals"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_distinct("words").alias("vocabulary"),
        hashes.alias("grams"),
    )
    # Starts of windows seen twice or more, by sorting (hash, position); most texts need no sort.
    repeated = F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))
    sorted_grams = counted.withColumn("s", repeated).drop("grams")
    starts = F.sort_array(
        F.transform(
            F.filter(
                F.transform(
                    "s",
                    lambda x, i: F.when(
                        F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
            lambda p: F.coalesce(p, F.lit(0)),
        )
    )
    covered = sorted_grams.withColumn("starts", starts).withColumn(
        "n_repeat_words",
        F.coalesce(
            F.aggregate(
                F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
            F.lit(0).cast("long"),
        ),
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    known = F.size(F.array_intersect("vocabulary", F.array(*[F.lit(w) for w in FUNCTION_WORDS])))
    votes = [
        _vote(chars.between(3 * n, 11 * n), (chars < 2 * n) | (chars > 15 * n)),
        _vote(F.col("n_symbols") * 20 < n, F.col("n_symbols") * 4 > n),
        _vote(F.col("n_dup_lines") * 10 <= F.col("n_lines"), F.col("n_dup_lines") * 2 > F.col("n_lines")),
        _vote(F.col("n_repeat_words") * 5 <= n, F.col("n_repeat_words") * 5 > 2 * n),
        _vote(known >= 4, known <= 1),
        _vote(F.col("n_capitals") * 7 < chars, F.col("n_capitals") * 2 > chars),
        _vote(F.size("vocabulary") * 5 >= n, F.size("vocabulary") * 20 < n),
    ]
    return covered.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[F.when(n > 0, v).otherwise(F.lit(0).cast("tinyint")).alias(f"vote_{r}") for r, v in zip(RULES, votes)],
    )


def fit_votes(features: DataFrame, rounds: int = 50) -> VoteModel:
    """Estimate rule accuracies by EM over the counts of vote patterns (at most 3**rules rows).

    A rule has two accuracies: how often it is right about good documents, and about bad ones.
    """
    names = [f"vote_{r}" for r in RULES]
    patterns = features.filter("n_words > 0").groupBy(*names).count().orderBy(*names).collect()
    on_good, on_bad, prior = [0.95] * len(names), [0.4] * len(names), 0.85
    for _ in range(rounds if patterns else 0):
        model = _model(prior, on_good, on_bad)
        good = total = 0.0
        # Pseudo-counts keep a rule that rarely votes near its starting accuracy.
        up_good, cast_good = [9.5] * len(names), [10.0] * len(names)
        down_bad, cast_bad = [4.0] * len(names), [10.0] * len(names)
        for *votes, count in patterns:
            p = _posterior(model, votes)
            good, total = good + p * count, total + count
            for j, v in enumerate(votes):
                if v:
                    cast_good[j] += p * count
                    cast_bad[j] += (1 - p) * count
                    up_good[j] += p * count * (v > 0)
                    down_bad[j] += (1 - p) * count * (v < 0)
        prior = min(0.98, max(0.02, good / total))
        on_good = [min(0.999, max(0.55, r / c)) for r, c in zip(up_good, cast_good)]
        on_bad = [min(0.999, max(1.5 * (1 - g), r / c)) for r, c, g in zip(down_bad, cast_bad, on_good)]
    return _model(prior, on_good, on_bad)


def _model(prior: float, on_good: list[float], on_bad: list[float]) -> VoteModel:
    return VoteModel(
        math.log(prior / (1 - prior)),
        tuple(math.log(g / (1 - b)) for g, b in zip(on_good, on_bad)),
        tuple(math.log((1 - g) / b) for g, b in zip(on_good, on_bad)),
    )


def _posterior(model: VoteModel, votes: list[int]) -> float:
    z = model.prior + sum((u if v > 0 else d) for u, d, v in zip(model.up, model.down, votes) if v)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def quality_rules(documents: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """Base counts, votes, posterior quality probability and verdict for every document."""
    features = cut(rule_features(documents))
    model = fit_votes(features)
    z = F.lit(model.prior)
    for rule, up, down in zip(RULES, model.up, model.down):
        vote = F.col(f"vote_{rule}")
        z = z + F.when(vote > 0, F.lit(up)).when(vote < 0, F.lit(down)).otherwise(F.lit(0.0))
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return (
        features.withColumn("base_failed", failed)
        .withColumn("quality_probability", 1 / (1 + F.exp(-z)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= min_posterior))
    )
