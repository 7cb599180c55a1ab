"""Driver queries of the corpus operators: ``name -> (spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicate_components

    return near_duplicate_components(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoding_digests

    return encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import neighbour_likeness

    return neighbour_likeness(documents(spark, sf_dir))


def spotsigs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import classes_and_pairs

    return classes_and_pairs(documents(spark, sf_dir))


def op5_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfp_dedup import repeat_digests

    return repeat_digests(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_crf import find_personal_data

    return find_personal_data(documents(spark, sf_dir))


def op8_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superkmer import window_digests

    return window_digests(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bradley_terry import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import phrase_collocations

    return phrase_collocations(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import run_digests

    return run_digests(documents(spark, sf_dir))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_spotsigs": op4_spotsigs,
    "op5_pfp_dedup": op5_pfp_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii_crf": op7_pii_crf,
    "op8_superkmer_dedup": op8_superkmer_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash": op13_simhash,
    "spotsigs_pairs": spotsigs_pairs,
}
#: Whole counts by size and language; every cut of a candidate joins the counts of its parts.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
grams AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i : i + k - 1])) AS ph FROM split, sizes),
f AS (SELECT lang, ph, CAST(count(*) AS HUGEINT) AS c FROM grams GROUP BY lang, ph),
totals AS (SELECT lang, sum(c) AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
candidates AS (SELECT lang, ph, c FROM f WHERE len(ph) > 1 AND c >= 100),
inner_parts AS (
  SELECT lang, ph[i.k : i.k + m.k - 1] AS ph, max(c) AS longer FROM candidates, sizes AS i, sizes AS m
  WHERE m.k > 1 AND m.k < len(ph) AND i.k + m.k - 1 <= len(ph) GROUP BY ALL),
kept AS (
  SELECT c.lang, c.ph, c.c AS a FROM candidates AS c LEFT JOIN inner_parts AS p ON p.lang = c.lang AND p.ph = c.ph
  WHERE p.longer IS NULL OR 100 * p.longer < 100 * c.c),
cuts AS (
  SELECT kept.lang, kept.ph, a, k, x.c AS l, y.c AS r, n, 1000 * a * n // (x.c * y.c) AS score
  FROM kept JOIN sizes ON k < len(kept.ph) JOIN totals ON totals.lang = kept.lang
  JOIN f AS x ON x.lang = kept.lang AND x.ph = kept.ph[:k] JOIN f AS y ON y.lang = kept.lang AND y.ph = kept.ph[k + 1 :]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) <= 2000
"""
ORACLE_SQL: dict[str, str] = {"op11_collocations": COLLOCATIONS_SQL}
