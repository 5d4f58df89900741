"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, exact_dedup, hmm, license, minhash, mixing, pii, quality, substring, token_store
from .store import new_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"), f"digests_{uuid.uuid4().hex}")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, topic, n_words, probability, kept of every document."""
    p = mixing.P
    df = mixing.probabilities(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.col(p + "topic").alias("topic"), F.col(p + "words").alias("n_words"), F.round(p + "p", 6).alias("probability"), (F.col(p + "u") < F.col(p + "p")).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = new_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), where)
    return token_store.digest_tokens(spark, where)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pii.find(table(spark, sf_dir, "documents"))
    sure = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"size(filter(spans, x -> x.base AND x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return df.select("doc_id", *counts, F.sha2(joined(sure).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", *quality.METRICS, "base_failed", "kept")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_minhash": op3_minhash,
    "op4_token_store": op4_token_store,
    "op5_hmm": op5_hmm,
    "op6_pii": op6_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring": op8_substring,
    "op9_bpe": op9_bpe,
    "op10_license_scan": op10_license_scan,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op2_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, lang, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
        t AS (
          SELECT *, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN n < 100 THEN 'piece' WHEN n < 1000 THEN 'article' ELSE 'long' END AS topic FROM d),
        c AS (SELECT source, lang, topic, sum(n)::DOUBLE AS mass FROM t GROUP BY ALL),
        s AS (
          SELECT *, sqrt(sum(mass) OVER (PARTITION BY source)) AS ps, sqrt(sum(mass) OVER (PARTITION BY lang)) AS pl, sqrt(sum(mass) OVER (PARTITION BY topic)) AS pt FROM c),
        a AS (
          SELECT *, ps / (SELECT sum(p) FROM (SELECT DISTINCT source, ps AS p FROM s)) AS ws, pl / (SELECT sum(p) FROM (SELECT DISTINCT lang, pl AS p FROM s)) AS wl,
                 pt / (SELECT sum(p) FROM (SELECT DISTINCT topic, pt AS p FROM s)) AS wt FROM s),
        r AS (
          SELECT 0 AS it, source, lang, topic, mass, ws, wl, wt, mass / sum(mass) OVER () AS w FROM a
          UNION ALL
          SELECT it + 1, source, lang, topic, mass, ws, wl, wt, w * wt / sum(w) OVER (PARTITION BY topic) FROM (
            SELECT * REPLACE (w * wl / sum(w) OVER (PARTITION BY lang) AS w) FROM (
              SELECT * REPLACE (w * ws / sum(w) OVER (PARTITION BY source) AS w) FROM r WHERE it < 40))),
        q AS (SELECT source, lang, topic, mass, w / mass AS ratio FROM r WHERE it = 40),
        o AS (  -- with the i largest ratios cut to 1, the scale that meets the share
          SELECT (0.7 * (SELECT sum(mass) FROM q) - coalesce(sum(mass) OVER before, 0)) / sum(mass * ratio) OVER rest AS scale, ratio,
                 lag(ratio) OVER (ORDER BY ratio DESC, source, lang, topic) AS above
          FROM q WINDOW before AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        rest AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        k AS (SELECT min(scale) AS scale FROM o WHERE scale * ratio <= 1 AND (above IS NULL OR scale * above >= 1))
        SELECT doc_id, topic, n AS n_words, round(least(1.0, ratio * scale), 6) AS probability,
               CAST('0x' || substr(md5('mix:' || doc_id), 1, 12) AS BIGINT) / pow(16, 12) < least(1.0, ratio * scale) AS kept
        FROM t JOIN q USING (source, lang, topic) CROSS JOIN k""",
    "op7_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p),
        v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
        m AS (
          SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                  - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
                 coalesce(v.n, 0)::BIGINT AS n_repeat_words
          FROM d LEFT JOIN v ON d.doc_id = v.doc_id)
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
                    OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR (n_dup_lines >= 5 AND 20 * n_dup_lines > n_words)) AS kept
        FROM m""",
    "op8_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(win, ' ')) AS first FROM p),
        g AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM f, (SELECT unnest(range(0, 13)) AS k) WHERE first < doc_id GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
}
