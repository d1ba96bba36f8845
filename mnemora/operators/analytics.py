"""Usage analytics, counts and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tools whose calls are reads, by the beginning of their name (fixed values).
READ_PREFIXES = ("search", "find", "list", "profile", "entity", "timeline")
#: Settings and their defaults (fixed values).
SETTINGS: dict[str, object] = {
    "judge_backend": "none", "judge_idle_exit_s": 600, "supersede_auto": 0.8, "supersede_review": 0.5, "conflict_threshold": 0.8, "entity_link": 0.8, "rrf_k": 60,
    "adaptive_fusion": True, "w_graph": 0.7, "prior_importance": 0.1, "prior_recency": 0.05, "prior_access": 0.05, "recency_half_life_d": 90, "rerank": True,
    "rerank_blend": True, "rerank_fused_weight": 0.5, "rerank_pool": 8, "rerank_chars": 320, "link_k": 3, "link_min_sim": 0.6, "recall_min_score": -2.0, "recall_max": 3,
    "profile_min_importance": 0.7, "profile_max_chars": 3200, "consolidate": True, "consolidate_hour_utc": 22, "dup_threshold": 0.92, "archive_after_days": 180,
    "archive_max_importance": 0.3, "web_ui": False,
}


def as_text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def type_name(value: object) -> str:
    return type(value).__name__


def is_read() -> Column:
    """Whether an event reads: a recall, or the call of a reading tool."""
    tool = F.lit(False)
    for p in READ_PREFIXES:
        tool = tool | F.col("tool").startswith(p)
    return F.coalesce((F.col("op") == "recall") | ((F.col("op") == "tool_call") & tool), F.lit(False))


def is_write() -> Column:
    return F.coalesce(F.col("op") == "store", F.lit(False))


def _since_day(now: str, days: int) -> Column:
    """Whole days count: the day of the cutoff is inside."""
    return F.col("ts") >= F.expr(f"cast(date_trunc('DAY', TIMESTAMP_NTZ '{now}' - INTERVAL {days} DAYS) as timestamp_ntz)")


def counts(memories: DataFrame, entities: DataFrame, links: DataFrame, reviews: DataFrame, skills: DataFrame) -> DataFrame:
    """One row of table counts; each table is aggregated in one pass, and the parts are summed. ``skills`` has a row for each skill."""
    n = {"skills": skills, "memories": memories, "active_facts": memories.where("status = 'active' AND relation IS NOT NULL"), "entities": entities, "links": links, "open_reviews": reviews.where("status = 'open'")}
    parts = None
    for k, df in n.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy().agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in n])


def calls_window(log: DataFrame, now: str, days: int) -> DataFrame:
    """Calls by tool and agent since some days before: n, mean_ms; a null agent is shown as '?' but stays its own group."""
    g = log.where((F.col("op") == "tool_call") & _since_day(now, days)).groupBy("tool", "agent").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms")).alias("mean_ms"))
    return g.select("tool", F.coalesce("agent", F.lit("?")).alias("agent"), "n", "mean_ms")


def writes_window(log: DataFrame, now: str, days: int) -> DataFrame:
    return log.where(_since_day(now, days)).agg(F.count_if(F.col("op") == "store").alias("stores"), F.count_if(F.col("op") == "supersede").alias("supersedes"))


def daily(log: DataFrame, now: str, days: int) -> DataFrame:
    """Reads and writes of the last ``days`` calendar days, days without events as zero."""
    spine = log.sparkSession.range(days).select(F.date_sub(F.lit(now).cast("date"), F.col("id").cast("int")).alias("day"))
    at = log.where(F.col("ts") >= F.date_sub(F.lit(now).cast("date"), days - 1).cast("timestamp_ntz")).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(is_read()).alias("reads"), F.count_if(is_write()).alias("writes"))
    return spine.join(at, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("writes", F.lit(0)).alias("writes"))


def agents(log: DataFrame, now: str, days: int) -> DataFrame:
    """Reads and writes by agent in the last ``days`` times 24 hours; null and empty agents are 'unknown', agents with neither are left out."""
    who = F.coalesce(F.nullif(F.col("agent"), F.lit("")), F.lit("unknown"))
    return log.where(F.expr(f"ts >= TIMESTAMP_NTZ '{now}' - INTERVAL {days} DAYS") & (is_read() | is_write())).groupBy(who.alias("agent")).agg(F.count_if(is_read()).alias("reads"), F.count_if(is_write()).alias("writes"))


def latencies(log: DataFrame) -> DataFrame:
    """Per tool: n, interpolated median, and the value at place max(1, floor(0.95 n)) of the sorted latencies.

    Latencies are first counted by value, so a tool's window holds its distinct values, not its rows.
    """
    by_value = log.where("op = 'tool_call' AND latency_ms IS NOT NULL").groupBy("tool", "latency_ms").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tool").orderBy("latency_ms")
    s = by_value.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy("tool")))
    at = lambda k: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("c") < k), F.col("latency_ms")))
    p95 = F.greatest(F.lit(1), F.expr("cast(floor(n * 0.95) as bigint)"))
    out = s.groupBy("tool", "n").agg(at(F.expr("(n + 1) div 2")).alias("low"), at(F.expr("n div 2 + 1")).alias("high"), at(p95).alias("p95_ms"))
    return out.select("tool", "n", ((F.col("low") + F.col("high")) / 2).alias("median_ms"), "p95_ms")


def version(log: DataFrame) -> DataFrame:
    """The id of the last event that changed the ledger."""
    return log.where(F.col("op").isin("store", "update", "supersede", "delete", "review", "archive", "merge")).agg(F.max("id").alias("version"))


def accesses(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Events about each memory: n_accesses (redelivered events once), last_access."""
    e = log.where("memory_id IS NOT NULL").select("id", "ts", "memory_id").distinct().groupBy("memory_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_access"))
    return memories.select("id").join(e.withColumnRenamed("memory_id", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_accesses"), "last_access")


def public_shape(memories: DataFrame) -> DataFrame:
    """Rows as shown outside: the uid as id, no internal columns, raw_text only where it differs from content."""
    return memories.select(
        F.col("uid").alias("id"), "domain", "type", "content", F.when(F.col("raw_text").eqNullSafe(F.col("content")), None).otherwise(F.col("raw_text")).alias("raw_text"),
        "relation", "object_text", "importance", "status", F.col("recorded_at").alias("created_at"), F.col("recorded_at").alias("updated_at"))


def log_rows(rows: DataFrame, op: str, ts: Column, memory_id: Column, detail: Column) -> DataFrame:
    """Rows of the event log for an operation, ready to append."""
    return rows.select(ts.alias("ts"), F.lit(op).alias("op"), "agent", memory_id.alias("memory_id"), F.to_json(detail).alias("detail"))


def resolve_settings(spark: SparkSession, stored: dict[str, str], environment: dict[str, str] | None = None) -> DataFrame:
    """Every setting with its kind and value: the stored one, else that of the environment, else the default, coerced to the kind.

    A variable of the environment is the key in capitals. Unknown keys are left out; a text that is no number of a
    numeric setting is passed over for the next level.
    """
    d = spark.createDataFrame([(k, as_text(v), type_name(v)) for k, v in SETTINGS.items()], "key string, fallback string, kind string")
    o = spark.createDataFrame([(k, v) for k, v in stored.items()], "key string, stored string")
    e = spark.createDataFrame([(k.lower(), v) for k, v in (environment or {}).items()], "key string, env string")

    def coerced(c: str) -> Column:
        flag = F.when(F.col(c).isNotNull(), F.when(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), "true").otherwise("false"))
        whole, number = F.expr(f"try_cast(trim({c}) AS bigint)").cast("string"), F.expr(f"CASE WHEN try_cast(trim({c}) AS double) IS NOT NULL THEN trim({c}) END")
        return F.when(F.col("kind") == "bool", flag).when(F.col("kind") == "int", whole).when(F.col("kind") == "float", number).otherwise(F.col(c))

    return d.join(o, "key", "left").join(e, "key", "left").select("key", "kind", F.coalesce(*map(coerced, ("stored", "env", "fallback"))).alias("value"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables, those of the new one where both have the key."""
    rest = [c for c in old.columns if c not in keys]
    return old.join(new.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest]), keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])
