"""Queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, langid, lines, mixing, packing, quality, rules, tokens, warc


#: Sizes and targets of the mix: the level below which no source is capped, read off sums in the order of cap / weight.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS ss FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, row_number() OVER o AS i, sum(ss) OVER () AS total, sum(ss) OVER o - ss AS before, sum(w) OVER () - sum(w) OVER o + w AS open_w FROM w WINDOW o AS (ORDER BY ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((1.5 * total - 2 * before) / open_w, i) AS level FROM r WHERE w * (1.5 * total - 2 * before) / open_w <= 2 * ss)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, round(CAST(least(2 * ss, coalesce(w * level, 2 * ss)) AS DOUBLE), 4) AS target FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, l"""

#: The statistics and the base rules of the quality rules.
RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS rep FROM m, (VALUES (0), (1), (2)) v(j) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express."""
    return mixing.op2_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express."""
    return rules.op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann_search": ann.op1_ann_search,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_warc_round_trip": warc.op5_warc_round_trip,
        "op6_quality_rules": rules.op6_quality_rules,
        "op7_pack_retrieval": packing.op7_pack_retrieval,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_token_counts": tokens.op9_token_counts,
        "op10_language_id": langid.op10_language_id,
        "mix_targets": mix_targets,
        "rules_base": rules_base,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard.OP3_SQL, "op5_warc_round_trip": warc.OP5_SQL, "mix_targets": MIX_SQL, "rules_base": RULES_SQL}
