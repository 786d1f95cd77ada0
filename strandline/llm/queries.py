"""Queries on model-training text, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import conversations, mixing, pairs, pii, reading, tokenizer
from strandline.sources.tables import table


def _free_text(spark: SparkSession, d: str) -> DataFrame:
    return pii.text_fields(table(spark, d, "interactions"), table(spark, d, "cases"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(_free_text(spark, d))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(_free_text(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "interactions"))


def p4_refusals(spark: SparkSession, d: str) -> DataFrame:
    return pairs.refusal_templates(pairs.read_pairs(table(spark, d, "interactions")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "messages")).select("session_id", "pos", "message_id")


def p6_contigs(spark: SparkSession, d: str) -> DataFrame:
    return conversations.contigs(conversations.clean_messages(table(spark, d, "messages")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p4_refusals, p6_found, p6_contigs, p7_ids, p8_mix, p8_shares, p9_found)}

_ROLE = "lower(regexp_replace(role, '^[\\s:<|\\[\\]>]+|[\\s:<|\\[\\]>]+$', '', 'g'))"
_ROLES = "CASE " + " ".join(f"WHEN {_ROLE} IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in conversations.ROLES.items()) + " END"
SQL: dict[str, str] = {
    "p6_found": f"""
WITH m AS (
  SELECT session_id, message_id, CASE WHEN trim(turn_id) <> '' THEN trim(turn_id) END AS turn_id, message, {_ROLES} AS role,
    CASE WHEN regexp_matches(trim(msg_ts), '^\\d{{4}}-\\d\\d-\\d\\d[Tt ]\\d\\d:\\d\\d:\\d\\d(\\.\\d{{1,9}})?([Zz]|[+-]\\d\\d:\\d\\d)$')
      THEN CAST(epoch(TRY_CAST(regexp_replace(upper(trim(msg_ts)), '\\.\\d+', '') AS TIMESTAMPTZ)) AS BIGINT) * 1000000000 + CAST(rpad(regexp_extract(msg_ts, '\\.(\\d{{1,9}})', 1), 9, '0') AS BIGINT) END AS ns
  FROM messages WHERE session_id IS NOT NULL AND regexp_matches(message, '[^\\s\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]')
), one AS (
  SELECT session_id, role, ns, message, min(message_id) AS message_id, min(turn_id) AS turn_id FROM m GROUP BY ALL
), spoken AS (
  SELECT *, lead(role) OVER w AS next, row_number() OVER w AS k FROM one WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY ns, message_id)
), bad AS (
  SELECT session_id FROM one WHERE ns IS NULL OR role IS NULL
  UNION SELECT session_id FROM spoken WHERE k = 1 AND role <> 'user' OR role = 'user' AND coalesce(next, '') <> 'assistant'
  UNION SELECT session_id FROM one a WHERE role = 'assistant' AND turn_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM one u WHERE u.session_id = a.session_id AND u.turn_id = a.turn_id AND u.role = 'user')
)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ns, message_id) AS INTEGER) AS pos, message_id
FROM one WHERE session_id IN (SELECT session_id FROM spoken) AND session_id NOT IN (SELECT session_id FROM bad)""",
}
