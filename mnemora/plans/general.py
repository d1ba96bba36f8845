"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.intervals import periods_and_gaps
from mnemora.operators.sessions import micros, sessions
from mnemora.sources import read_table


def agent_key(column: str = "agent"):
    """Agent trimmed of blanks and lower-cased; null where nothing is left."""
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "usage_log")
    return sessions(
        log, agent_key(), micros("ts"), F.col("id"), counts={"n_calls": F.col("op") == "tool_call"},
    ).select(F.col("entity").alias("agent"), "start_us", "end_us", "n_events", "n_calls")


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their duration, and per agent as one row per session."""
    log = read_table(spark, sf_dir, "usage_log")
    return sessions(
        log, agent_key(), micros("ts"), F.col("id"), counts={"n_calls": F.col("op") == "tool_call", "n_writes": F.col("op").isin("store", "update", "supersede")},
    ).withColumnRenamed("entity", "agent")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read_table(spark, sf_dir, "memories").where(F.col("status").isin("active", "superseded", "archived"))
    return periods_and_gaps(
        facts, {"subject_id": F.col("subject_id"), "relation": F.col("relation")}, micros("valid_from"), micros("valid_to"))


QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions, "p3_found": p3_found}

_P2 = """
WITH e AS (SELECT DISTINCT id, lower(trim(agent)) AS agent, epoch_us(ts) AS t, op FROM usage_log
           WHERE agent IS NOT NULL AND trim(agent) <> ''),
m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY agent ORDER BY t, id) <= 1800000000 THEN 0 ELSE 1 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY agent ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT agent, min(t) AS start_us, max(t) AS end_us, {more} count(*) AS n_events,
       count(*) FILTER (WHERE op = 'tool_call') AS n_calls{last} FROM s GROUP BY agent, k"""

SQL = {
    "p2_found": _P2.format(more="", last=""),
    "p2_sessions": _P2.format(more="max(t) - min(t) AS duration_us,", last=",\n       count(*) FILTER (WHERE op IN ('store', 'update', 'supersede')) AS n_writes"),
    "p3_found": """
WITH r AS (SELECT subject_id, relation, epoch_us(valid_from) AS s, coalesce(epoch_us(valid_to), 9223372036854775807) AS e
           FROM memories WHERE subject_id IS NOT NULL AND relation IS NOT NULL AND valid_from IS NOT NULL
             AND status IN ('active', 'superseded', 'archived') AND (valid_to IS NULL OR valid_to > valid_from)),
b AS (SELECT *, max(e) OVER (PARTITION BY subject_id, relation ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END)
        OVER (PARTITION BY subject_id, relation ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM b),
p AS (SELECT subject_id, relation, k, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
g AS (SELECT subject_id, relation, lag(e) OVER (PARTITION BY subject_id, relation ORDER BY k) AS s, s AS e FROM p)
SELECT subject_id, relation, 'period' AS kind, s AS start_us, CASE WHEN e = 9223372036854775807 THEN -1 ELSE e END AS end_us FROM p
UNION ALL SELECT subject_id, relation, 'gap', s, e FROM g WHERE s IS NOT NULL""",
}
