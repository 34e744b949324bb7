"""Queries of this package and their SQL."""

from __future__ import annotations

from linkloom.llm import langid, licences, lm, mixing, nearest, partcodes, repair, repeats, rules, sharding, simhash, tiling, topk

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_lm_scores": lm.op2,
    "op3_nearest_vectors": nearest.op3,
    "op4_source_mix": mixing.op4,
    "op5_long_repeats": repeats.op5,
    "op6_benchmark_leaks": tiling.op6,
    "op7_quality_rules": rules.op7,
    "op8_histogram_shards": sharding.op8,
    "op9_licence_scan": licences.op9,
    "op10_simhash_groups": simhash.op10,
    "op11_part_codes": partcodes.op11,
    "op12_greatest_products": topk.op12,
    "op13_conversation_repair": repair.op13,
}

ORACLES = {
    "op9_licence_scan": licences.ORACLE,
    "op11_part_codes": partcodes.ORACLE,
    "op12_greatest_products": topk.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
    "op4_source_mix": r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), f AS (
  SELECT *, 2 * source_size AS cap,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
            - CAST(coalesce(sum(2 * source_size) OVER before, 0) AS BIGINT))
         / (CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT)) AS level
  FROM s
  WINDOW before AS (ORDER BY (2 * source_size)::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, cap <= weight * level AS capped FROM f
), g AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE weight * (
           (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS BIGINT))
           / (CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS BIGINT))) END AS target
  FROM c
), b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole FROM g
), k AS (
  SELECT source, key, CAST(sum(size) AS BIGINT) AS at_key FROM d GROUP BY source, key
), r AS (
  SELECT *, CAST(coalesce(sum(at_key) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM k
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(b.whole * d.size + CASE
         WHEN r.before + r.at_key <= b.budget - b.whole * b.source_size THEN d.size
         WHEN r.before < b.budget - b.whole * b.source_size
           THEN CAST(floor((d.size * (b.budget - b.whole * b.source_size - r.before))::DOUBLE / r.at_key) AS BIGINT)
         ELSE 0 END AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.key = r.key
""",
}
