"""Queries over the memory store: functions, filters, joins and aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.functions import text, vectors
from mnemora.operators import analytics, entities, views
from mnemora.plans.registry import AS_OF, NOW, Plan, Tables

plan = Plan()
QUERIES, SQL = plan.queries, plan.sql

SQL_NORM = r"""regexp_replace(lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g')), '\s+', ' ', 'g')"""
SQL_CLIP = r"""CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {1}), ' [^ ]*$', '') || ' …' END"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
SQL_TOKENS = r"list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_.\-]*'), lambda t: regexp_replace(lower(t), '^[.\-]+|[.\-]+$', '', 'g')), lambda t: t <> '' AND t NOT IN (" + _STOP + "))"
KNOWN = "('active', 'superseded', 'archived')"

# scalar functions


@plan.add(f"SELECT id, {SQL_NORM.format('name')} AS norm_name FROM entities")
def norm_name(t: Tables) -> DataFrame:
    return t.entities.select("id", text.norm_name(F.col("name")).alias("norm_name"))


@plan.add("SELECT id, regexp_replace(regexp_replace(lower(relation), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS relation_key FROM memories")
def norm_relation(t: Tables) -> DataFrame:
    return t.memories.select("id", text.norm_relation(F.col("relation")).alias("relation_key"))


@plan.add(f"SELECT doc_id, len({SQL_TOKENS.format('text')}) AS n_tokens, array_to_string({SQL_TOKENS.format('text')}, ' ') AS tokens FROM documents")
def tokenize(t: Tables) -> DataFrame:
    tokens = text.query_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@plan.add("""SELECT id, array_to_string(list_filter(list_transform(string_split(array_to_string(tags, ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags
FROM memories WHERE tags IS NOT NULL""")
def csv_split(t: Tables) -> DataFrame:
    joined = F.array_join("tags", ",")
    return t.memories.where("tags IS NOT NULL").select("id", F.array_join(text.split_csv(joined), "|").alias("tags"))


@plan.add(rf"""WITH s AS (SELECT id, content, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c FROM memories)
SELECT id, {SQL_CLIP.format('c', 220)} AS clipped, {SQL_CLIP.format('content', 500)} AS recalled FROM s""")
def clip_text(t: Tables) -> DataFrame:
    c = F.col("content")
    return t.memories.select("id", text.clip(c, 220).alias("clipped"), text.clip(c, 500, collapse=False).alias("recalled"))


@plan.add("SELECT id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, importance * 2 - 0.5)) AS importance FROM memories WHERE importance IS NOT NULL")
def clamp(t: Tables) -> DataFrame:
    return t.memories.where("importance IS NOT NULL").select("id", text.clamp(F.col("importance") * 2 - 0.5).alias("importance"))


_UNIT = "SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM memories WHERE len(embedding) = 384"


@plan.add(f"""WITH u AS ({_UNIT}), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM u)
SELECT id, round(n, 6) AS length, round(list_sum(list_transform(v, lambda x: abs(x) / CASE WHEN n = 0 THEN 1 ELSE n END)), 6) AS total FROM n""")
def l2_normalize(t: Tables) -> DataFrame:
    v = t.memories.where(F.size("embedding") == 384)
    total = F.aggregate(vectors.unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + F.abs(x))
    return v.select("id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(total, 6).alias("total"))


@plan.add("SELECT id, json_extract_string(detail, '$.domain') AS domain, TRY_CAST(json_extract_string(detail, '$.n_results') AS INTEGER) AS n_results, json_extract_string(detail, '$.error') AS error FROM usage_log")
def json_decode(t: Tables) -> DataFrame:
    at = lambda k: F.get_json_object("detail", f"$.{k}")
    return t.usage_log.select("id", at("domain").alias("domain"), at("n_results").cast("int").alias("n_results"), at("error").alias("error"))


@plan.add("""SELECT uid AS id, domain, type, content, CASE WHEN raw_text = content THEN NULL ELSE raw_text END AS raw_text,
 relation, object_text, importance, status, recorded_at AS created_at, recorded_at AS updated_at FROM memories""")
def public_shape(t: Tables) -> DataFrame:
    return analytics.public_shape(t.memories)


@plan.add("""SELECT recorded_at AS ts, 'store' AS op, agent, id AS memory_id,
 '{"domain":"' || domain || '","keyed":' || CASE WHEN relation IS NULL THEN 'false' ELSE 'true' END || '}' AS detail FROM memories WHERE domain IS NOT NULL""")
def event_log_append(t: Tables) -> DataFrame:
    stored = t.memories.where("domain IS NOT NULL")
    return analytics.log_rows(stored, "store", F.col("recorded_at"), F.col("id"), F.struct("domain", F.col("relation").isNotNull().alias("keyed")))


# filters


@plan.add(f"SELECT id, domain, content FROM memories WHERE status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')")
def current_view(t: Tables) -> DataFrame:
    return views.current_view(t.memories, NOW).select("id", "domain", "content")


_AS_OF = f"status IN {KNOWN} AND valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')"


@plan.add(f"SELECT id, subject_id, relation, object_text, status, valid_from, valid_to FROM memories WHERE {_AS_OF}")
def as_of_filter(t: Tables) -> DataFrame:
    return views.as_of(t.memories, AS_OF).select("id", "subject_id", "relation", "object_text", "status", "valid_from", "valid_to")


@plan.add(f"SELECT id, status, valid_from, valid_to FROM memories WHERE status IN {KNOWN}")
def history_view(t: Tables) -> DataFrame:
    return views.history(t.memories).select("id", "status", "valid_from", "valid_to")


@plan.add("SELECT id, content FROM memories WHERE domain = 'projects' AND type = 'fact'")
def filter_domain_type(t: Tables) -> DataFrame:
    return views.matching(t.memories, domain="projects", kind="fact").select("id", "content")


@plan.add("SELECT id, content FROM memories WHERE len(list_filter(tags, lambda x: lower(x) = 'ops')) > 0")
def filter_tag(t: Tables) -> DataFrame:
    return views.matching(t.memories, tag="Ops").select("id", "content")


@plan.add("SELECT id, importance FROM memories WHERE importance >= 0.7")
def filter_importance(t: Tables) -> DataFrame:
    return views.matching(t.memories, min_importance=0.7).select("id", "importance")


@plan.add("""SELECT id, CASE WHEN domain IS NULL OR domain NOT IN ('identity', 'projects', 'code', 'general', 'diary') THEN 'domain'
 WHEN (subject_id IS NULL) <> (relation IS NULL) THEN 'subject and relation' END AS error FROM memories""")
def validate_statements(t: Tables) -> DataFrame:
    return t.memories.select("id", views.errors(t.memories).alias("error"))


@plan.add("""WITH s AS (SELECT id, content, row_number() OVER (ORDER BY id DESC) AS rank, count(*) OVER () AS n FROM memories WHERE id < 1500)
SELECT id, content, CAST(rank AS INTEGER) AS rank, CASE WHEN n > 50 THEN max(CASE WHEN rank = 50 THEN id END) OVER () END AS next_offset FROM s QUALIFY rank <= 50""")
def list_page(t: Tables) -> DataFrame:
    return views.page(t.memories.select("id", "content"), 50, before=1500)


# joins


@plan.add("SELECT m.id, m.relation, m.object_text, e.name AS subject_name FROM memories m LEFT JOIN entities e ON e.id = m.subject_id")
def memory_subject_join(t: Tables) -> DataFrame:
    e = t.entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"))
    return t.memories.select("id", "relation", "object_text", "subject_id").join(e, "subject_id", "left").drop("subject_id")


_ACTIVE_LINKS = "SELECT l.src, l.dst, l.weight FROM links l JOIN memories a ON a.id = l.src JOIN memories b ON b.id = l.dst WHERE a.status = 'active' AND b.status = 'active'"


@plan.add(_ACTIVE_LINKS)
def active_links(t: Tables) -> DataFrame:
    return entities.active_links(t.links, t.memories)


@plan.add("""WITH s AS (SELECT src AS id, dst AS other, weight FROM links UNION ALL SELECT dst, src, weight FROM links),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY weight DESC, other) AS rank FROM s JOIN memories m ON m.id = other WHERE m.status = 'active')
SELECT id, other, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def related_links(t: Tables) -> DataFrame:
    return entities.related(t.links, t.memories, 6)


@plan.add("SELECT e.id, e.ts, e.op, e.agent, m.content FROM (SELECT * FROM usage_log WHERE op = 'store') e LEFT JOIN memories m ON m.id = e.memory_id")
def events_list(t: Tables) -> DataFrame:
    m = t.memories.select(F.col("id").alias("memory_id"), "content")
    return t.usage_log.where("op = 'store'").select("id", "ts", "op", "agent", "memory_id").join(m, "memory_id", "left").drop("memory_id")


@plan.add("""SELECT id, ts, op, agent, memory_id FROM (SELECT DISTINCT id, ts, op, agent, memory_id FROM usage_log WHERE op = 'tool_call') ORDER BY id DESC LIMIT 1000""")
def events_page(t: Tables) -> DataFrame:
    """The newest events of an operation, at most a thousand; redelivered rows once."""
    rows = t.usage_log.where("op = 'tool_call'").select("id", "ts", "op", "agent", "memory_id").distinct()
    return rows.orderBy(F.desc("id")).limit(views.clamped("events", 5000))


@plan.add("""SELECT src, dst FROM links l WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.memory_id IS NOT NULL AND r.other_id IS NOT NULL AND r.kind = 'merge'
 AND least(r.memory_id, r.other_id) = l.src AND greatest(r.memory_id, r.other_id) = l.dst)""")
def unreviewed_pairs(t: Tables) -> DataFrame:
    return entities.unreviewed(t.links.select("src", "dst"), t.reviews)


@plan.add("""SELECT r.id, r.kind, r.confidence, r.created_at, m.content AS memory, o.content AS other, e.name AS entity FROM reviews r
LEFT JOIN memories m ON m.id = r.memory_id AND r.kind <> 'alias' LEFT JOIN memories o ON o.id = r.other_id AND r.kind <> 'alias'
LEFT JOIN entities e ON e.id = r.other_id AND r.kind = 'alias' WHERE r.status = 'open'""")
def open_reviews(t: Tables) -> DataFrame:
    return entities.open_reviews(t.reviews, t.memories, t.entities)


@plan.add(f"""WITH k AS (SELECT id, {SQL_NORM.format('name')} AS k, 0 AS via FROM entities
UNION ALL SELECT id, {SQL_NORM.format('a')}, 1 FROM (SELECT id, unnest(aliases) AS a FROM entities) WHERE a IS NOT NULL),
b AS (SELECT k, arg_min(id, via * 1000000000000 + id) AS entity_id FROM k WHERE k <> '' GROUP BY k),
m AS (SELECT DISTINCT object_text AS mention FROM memories WHERE object_text IS NOT NULL)
SELECT mention, entity_id FROM m LEFT JOIN b ON b.k = {SQL_NORM.format('mention')}""")
def entity_resolve_exact(t: Tables) -> DataFrame:
    mentions = t.memories.where("object_text IS NOT NULL").select(F.col("object_text").alias("mention")).distinct()
    return entities.resolve_exact(mentions, t.entities)


@plan.add("""SELECT m.id, coalesce(m.object_entity_id, e.id) AS object_entity_id FROM memories m LEFT JOIN entities e ON e.norm = lower(trim(m.object_text)) WHERE m.object_text IS NOT NULL""")
def object_backfill(t: Tables) -> DataFrame:
    return entities.backfill(t.memories.where("object_text IS NOT NULL"), t.entities)


@plan.add(f"""WITH q AS (SELECT id, ' ' || {SQL_NORM.format('content')} || ' ' AS q FROM memories WHERE id % 100 = 0),
n AS (SELECT id AS entity_id, {SQL_NORM.format('name')} AS n FROM entities UNION SELECT id, {SQL_NORM.format('a')} FROM (SELECT id, unnest(aliases) AS a FROM entities) WHERE a IS NOT NULL)
SELECT DISTINCT q.id, entity_id, 1.0::DOUBLE AS weight FROM q JOIN n ON n.n <> '' AND contains(q.q, ' ' || n.n || ' ')""")
def entity_seeds_named(t: Tables) -> DataFrame:
    """The first step of the seeds: entities that a query names."""
    queries = t.memories.where("id % 100 = 0").select("id", "content")
    return entities.named_in(queries, t.entities)


@plan.add(f"""WITH p AS (SELECT DISTINCT u.id AS probe, u.ts AS moment, m.domain, m.subject_id, m.relation FROM usage_log u JOIN memories m ON m.id = u.memory_id WHERE m.relation IS NOT NULL)
SELECT probe, moment, m.id AS fact, m.object_text FROM p JOIN memories m USING (domain, subject_id, relation)
WHERE m.status IN {KNOWN} AND m.valid_from <= moment AND (m.valid_to IS NULL OR m.valid_to > moment)""")
def as_of_join(t: Tables) -> DataFrame:
    keys = ["domain", "subject_id", "relation"]
    keyed = t.memories.where("relation IS NOT NULL").select(F.col("id").alias("memory_id"), *keys)
    probes = t.usage_log.select(F.col("id").alias("probe"), F.col("ts").alias("moment"), "memory_id").join(keyed, "memory_id").drop("memory_id").distinct()
    facts = t.memories.select(F.col("id").alias("fact"), *keys, "object_text", "status", "valid_from", "valid_to")
    return views.as_of_join(probes, facts, keys).select("probe", "moment", "fact", "object_text")


@plan.add("""WITH i AS (SELECT least(memory_id, other_id) AS src, greatest(memory_id, other_id) AS dst, round(confidence, 4) AS weight, created_at, id FROM reviews
 WHERE kind <> 'alias' AND memory_id IS NOT NULL AND other_id IS NOT NULL AND memory_id <> other_id),
f AS (SELECT * EXCLUDE id FROM i QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY created_at, id) = 1)
SELECT src, dst, weight, created_at FROM links UNION ALL SELECT src, dst, weight, created_at FROM f ANTI JOIN links USING (src, dst)""")
def link_insert_ignore(t: Tables) -> DataFrame:
    r = t.reviews.where("kind <> 'alias' AND memory_id IS NOT NULL AND other_id IS NOT NULL AND memory_id <> other_id")
    new = r.select(F.least("memory_id", "other_id").alias("src"), F.greatest("memory_id", "other_id").alias("dst"), F.round("confidence", 4).alias("weight"), "created_at", F.col("id").alias("seq"))
    return entities.insert_or_ignore(t.links, new, ["src", "dst"], ["created_at", "seq"])


# aggregates


@plan.add("SELECT domain, status, count(*) AS n FROM memories GROUP BY ALL")
def stats_domain_status(t: Tables) -> DataFrame:
    return t.memories.groupBy("domain", "status").agg(F.count("*").alias("n"))


@plan.add("""SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM memories WHERE status = 'active' AND relation IS NOT NULL) AS active_facts,
 (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM reviews WHERE status = 'open') AS open_reviews, (SELECT count(DISTINCT p_name) FROM part) AS skills""")
def stats_counts(t: Tables) -> DataFrame:
    return analytics.counts(t.memories, t.entities, t.links, t.reviews, t.part.select("p_name").distinct())


@plan.add(f"""SELECT tool, coalesce(agent, '?') AS agent, n, mean_ms FROM (SELECT tool, agent, count(*) AS n, round(avg(latency_ms)) AS mean_ms FROM usage_log
 WHERE op = 'tool_call' AND ts >= date_trunc('day', TIMESTAMP '{NOW}' - INTERVAL 7 DAY) GROUP BY tool, agent)""")
def usage_calls_window(t: Tables) -> DataFrame:
    return analytics.calls_window(t.usage_log, NOW, 7)


@plan.add(f"""SELECT count(*) FILTER (WHERE op = 'store') AS stores, count(*) FILTER (WHERE op = 'supersede') AS supersedes FROM usage_log
 WHERE ts >= date_trunc('day', TIMESTAMP '{NOW}' - INTERVAL 30 DAY)""")
def usage_writes_window(t: Tables) -> DataFrame:
    return analytics.writes_window(t.usage_log, NOW, 30)


_READ = "(op = 'recall' OR (op = 'tool_call' AND (" + " OR ".join(f"starts_with(tool, '{p}')" for p in analytics.READ_PREFIXES) + ")))"
_WRITE = "op = 'store'"


@plan.add(f"""WITH d AS (SELECT unnest(generate_series(DATE '{NOW[:10]}' - INTERVAL 13 DAY, DATE '{NOW[:10]}', INTERVAL 1 DAY))::DATE AS day),
e AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE {_READ}) AS reads, count(*) FILTER (WHERE {_WRITE}) AS writes FROM usage_log GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes FROM d LEFT JOIN e USING (day)""")
def event_daily(t: Tables) -> DataFrame:
    return analytics.daily(t.usage_log, NOW, 14)


@plan.add(f"""SELECT CASE WHEN agent IS NULL OR agent = '' THEN 'unknown' ELSE agent END AS agent, count(*) FILTER (WHERE {_READ}) AS reads, count(*) FILTER (WHERE {_WRITE}) AS writes
FROM usage_log WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND op IN ('tool_call', 'recall', 'store') GROUP BY 1 HAVING reads + writes > 0""")
def usage_agents(t: Tables) -> DataFrame:
    return analytics.agents(t.usage_log, NOW, 14)


@plan.add("""WITH r AS (SELECT tool, latency_ms, row_number() OVER (PARTITION BY tool ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY tool) AS n
 FROM usage_log WHERE op = 'tool_call' AND latency_ms IS NOT NULL)
SELECT tool, n, median(latency_ms) AS median_ms, max(CASE WHEN k = greatest(1, CAST(floor(n * 0.95) AS BIGINT)) THEN latency_ms END) AS p95_ms FROM r GROUP BY tool, n""")
def latency_percentiles(t: Tables) -> DataFrame:
    return analytics.latencies(t.usage_log)


@plan.add("SELECT max(id) AS version FROM usage_log WHERE op IN ('store', 'update', 'supersede', 'delete', 'review', 'archive', 'merge')")
def ledger_version(t: Tables) -> DataFrame:
    return analytics.version(t.usage_log)


@plan.add("""SELECT m.id, count(e.id) AS n_accesses, max(e.ts) AS last_access FROM memories m LEFT JOIN (SELECT DISTINCT id, ts, memory_id FROM usage_log WHERE memory_id IS NOT NULL) e ON e.memory_id = m.id GROUP BY m.id""")
def access_counts(t: Tables) -> DataFrame:
    return analytics.accesses(t.memories, t.usage_log)


@plan.add("""SELECT DISTINCT memory_id, id AS event_id, ts, op, agent FROM usage_log WHERE memory_id IS NOT NULL""")
def memory_history(t: Tables) -> DataFrame:
    return t.usage_log.where("memory_id IS NOT NULL").select("memory_id", F.col("id").alias("event_id"), "ts", "op", "agent").distinct()


# the alias reviews of these tables don't name the dropped entity: the one with the next id stands for it
_MERGES = "mg AS (SELECT DISTINCT other_id AS keep, other_id + 1 AS dropped FROM reviews WHERE kind = 'alias' AND status = 'approved' AND other_id + 1 IN (SELECT id FROM entities))"


def _merges(t: Tables) -> DataFrame:
    known = t.entities.select(F.col("id").alias("drop"))
    return t.reviews.where("kind = 'alias' AND status = 'approved'").select(F.col("other_id").alias("keep"), (F.col("other_id") + 1).alias("drop")).distinct().join(known, "drop", "left_semi")


@plan.add(f"""WITH {_MERGES}, x AS (SELECT e.id, unnest(coalesce(aliases, [])) AS a FROM entities e WHERE id IN (SELECT keep FROM mg) UNION SELECT keep, name FROM mg JOIN entities d ON d.id = dropped
 UNION SELECT keep, unnest(coalesce(aliases, [])) FROM mg JOIN entities d ON d.id = dropped)
SELECT id, string_agg(a, '|' ORDER BY a) AS aliases FROM x WHERE a IS NOT NULL AND trim(a) <> '' GROUP BY id""")
def alias_merge(t: Tables) -> DataFrame:
    return entities.absorb(t.entities, _merges(t)).select("id", F.array_join("aliases", "|").alias("aliases"))


@plan.add(f"""WITH {_MERGES}, o AS (SELECT dropped, min(keep) AS keep FROM mg GROUP BY dropped)
SELECT m.id, coalesce(s.keep, m.subject_id) AS subject_id, coalesce(o.keep, m.object_entity_id) AS object_entity_id FROM memories m LEFT JOIN o s ON s.dropped = m.subject_id LEFT JOIN o ON o.dropped = m.object_entity_id
WHERE s.keep IS NOT NULL OR o.keep IS NOT NULL""")
def alias_repoint(t: Tables) -> DataFrame:
    """Facts moved from the dropped entity to the kept one."""
    return entities.repoint(t.memories, _merges(t))


@plan.add(f"""WITH n AS (SELECT object_entity_id AS id, object_text AS alias, id AS seq FROM memories WHERE object_entity_id IS NOT NULL AND object_text IS NOT NULL),
f AS (SELECT id, {SQL_NORM.format('alias')} AS form, trim(arg_min(alias, seq)) AS alias, min(seq) AS seq FROM n GROUP BY ALL),
k AS (SELECT id, list(alias ORDER BY seq) AS added FROM f WHERE form <> '' AND NOT EXISTS (SELECT 1 FROM (SELECT id, unnest(aliases) AS a FROM entities) e WHERE e.id = f.id AND {SQL_NORM.format('e.a')} = f.form) GROUP BY id)
SELECT id, coalesce(array_to_string(list_concat(coalesce(aliases, []), coalesce(added, [])), '|'), '') AS aliases FROM entities LEFT JOIN k USING (id)""")
def alias_add(t: Tables) -> DataFrame:
    """The ways facts write an entity, as its aliases, less those it has in normalised form."""
    new = t.memories.where("object_entity_id IS NOT NULL AND object_text IS NOT NULL").select(F.col("object_entity_id").alias("id"), F.col("object_text").alias("alias"), F.col("id").alias("seq"))
    return entities.add_aliases(t.entities, new).select("id", F.array_join("aliases", "|").alias("aliases"))


@plan.add("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY id) AS k FROM memories WHERE external_id IS NOT NULL)
SELECT external_id, arg_min(uid, id) AS uid, arg_min(valid_from, id) AS valid_from, arg_max(content, id) AS content, arg_max(importance, id) AS importance,
 arg_max(source, id) FILTER (WHERE source IS NOT NULL) AS source, count(*) AS n_imports FROM w GROUP BY external_id""")
def upsert_external_id(t: Tables) -> DataFrame:
    return entities.upsert_external(t.memories)


# settings, of which the table is given inline

_OVERRIDES = [("rrf_k", "30"), ("rerank", "off"), ("w_graph", "0.9"), ("judge_backend", "none"), ("link_k", "many")]
_ENVIRONMENT = {"RRF_K": "99", "WEB_UI": "Yes", "LINK_K": " 4 ", "RERANK_POOL": "x", "NO_SETTING": "1"}
_PUT = [("rrf_k", "45"), ("link_k", "5")]
_OVERRIDES_SQL = ", ".join(f"('{k}', '{v}')" for k, v in _OVERRIDES)
_PUT_SQL = ", ".join(f"('{k}', '{v}')" for k, v in _PUT)


@plan.add("""SELECT * FROM (VALUES ('judge_backend', 'str', 'none'), ('judge_idle_exit_s', 'int', '600'), ('supersede_auto', 'float', '0.8'), ('supersede_review', 'float', '0.5'), ('conflict_threshold', 'float', '0.8'),
('entity_link', 'float', '0.8'), ('rrf_k', 'int', '30'), ('adaptive_fusion', 'bool', 'true'), ('w_graph', 'float', '0.9'), ('prior_importance', 'float', '0.1'), ('prior_recency', 'float', '0.05'),
('prior_access', 'float', '0.05'), ('recency_half_life_d', 'int', '90'), ('rerank', 'bool', 'false'), ('rerank_blend', 'bool', 'true'), ('rerank_fused_weight', 'float', '0.5'), ('rerank_pool', 'int', '8'),
('rerank_chars', 'int', '320'), ('link_k', 'int', '4'), ('link_min_sim', 'float', '0.6'), ('recall_min_score', 'float', '-2.0'), ('recall_max', 'int', '3'), ('profile_min_importance', 'float', '0.7'),
('profile_max_chars', 'int', '3200'), ('consolidate', 'bool', 'true'), ('consolidate_hour_utc', 'int', '22'), ('dup_threshold', 'float', '0.92'), ('archive_after_days', 'int', '180'),
('archive_max_importance', 'float', '0.3'), ('web_ui', 'bool', 'true')) s(key, kind, value)""")
def settings_resolve(t: Tables) -> DataFrame:
    return analytics.resolve_settings(t.spark, dict(_OVERRIDES), _ENVIRONMENT)


@plan.add(f"WITH o(key, value) AS (VALUES {_OVERRIDES_SQL}), p(key, value) AS (VALUES {_PUT_SQL}) SELECT key, coalesce(p.value, o.value) AS value FROM o FULL JOIN p USING (key)")
def settings_upsert(t: Tables) -> DataFrame:
    old, new = (t.spark.createDataFrame(rows, "key string, value string") for rows in (_OVERRIDES, _PUT))
    return analytics.upsert(old, new, ["key"])
