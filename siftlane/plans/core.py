"""The core queries of general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlane.operators import nested, sessions
from siftlane.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "detections"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(table(spark, d, "detections"))


def _child(tag: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: nested.child_table(nested.flatten(table(spark, d, "detections"), payload=True), tag)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    **{f"p2_{tag}": _child(tag) for tag in nested.TAGS},
    "p3_found": p3_found,
}

ORACLE_SQL: dict[str, str] = {
    "p3_found": """
WITH m AS (
  SELECT DISTINCT chat_id, CAST(round(ts * 1000) AS BIGINT) AS ms, coalesce(session_tier, 0) AS tier,
         sender_name, message_text, action_tier, session_tier, detections_json
  FROM detections WHERE chat_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY chat_id ORDER BY ms) <= 900000 THEN 0 ELSE 1 END AS opens FROM m),
s AS (SELECT *, sum(opens) OVER (PARTITION BY chat_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT chat_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_events, CAST(max(tier) AS BIGINT) AS max_tier
FROM s GROUP BY chat_id, session""",
}
