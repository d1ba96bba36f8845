"""Queries of the ledger, reviews, skills and consolidation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import query_tokens
from mnemora.operators import ledger, search
from mnemora.operators.entities import alias_reviewed, judged, unreviewed
from mnemora.operators.near import near_later
from mnemora.operators.profile import core_profile as profile_lines
from mnemora.plans.memory import KNOWN, SQL_CLIP, SQL_NORM, SQL_TOKENS
from mnemora.plans.registry import NOW, Plan, Tables

plan = Plan()
QUERIES, SQL = plan.queries, plan.sql
DIM = 384

_SAID = f"""said AS (SELECT domain, subject_id, relation, id AS seq, {SQL_NORM.format('coalesce(object_text, content)')} AS value, coalesce(object_text, content) AS text,
 epoch_us(observed_at) AS obs FROM memories WHERE subject_id IS NOT NULL AND relation IS NOT NULL AND observed_at IS NOT NULL)"""
_FOLD = f"""WITH RECURSIVE {_SAID}, s AS (SELECT *, row_number() OVER (PARTITION BY domain, subject_id, relation ORDER BY seq) AS rn FROM said),
f AS (SELECT domain, subject_id, relation, seq, text, obs, rn, 'first' AS outcome, value AS av, obs AS af FROM s WHERE rn = 1
 UNION ALL SELECT s.domain, s.subject_id, s.relation, s.seq, s.text, s.obs, s.rn, CASE WHEN s.value = f.av THEN 'restate' WHEN s.obs < f.af THEN 'late' ELSE 'supersede' END,
 CASE WHEN s.value = f.av OR s.obs < f.af THEN f.av ELSE s.value END, CASE WHEN s.value = f.av OR s.obs < f.af THEN f.af ELSE s.obs END
 FROM f JOIN s ON s.domain = f.domain AND s.subject_id = f.subject_id AND s.relation = f.relation AND s.rn = f.rn + 1),
k AS (SELECT *, outcome <> 'late' AS leads, min(obs) OVER (PARTITION BY domain, subject_id, relation ORDER BY obs RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM f WHERE outcome <> 'restate'),
h AS (SELECT *, CASE WHEN leads THEN lead(seq) OVER w END AS heir, CASE WHEN leads THEN lead(obs) OVER w END AS heir_obs FROM k WINDOW w AS (PARTITION BY domain, subject_id, relation, leads ORDER BY seq)),
a AS (SELECT domain, subject_id, relation, obs AS after, min(seq) AS after_seq FROM k GROUP BY ALL),
done AS (SELECT domain, subject_id, relation, seq, text, obs, outcome, CASE WHEN leads AND heir IS NULL THEN 'active' ELSE 'superseded' END AS status,
 CASE WHEN leads AND heir IS NULL THEN NULL WHEN heir_obs = obs THEN obs ELSE after END AS valid_to, CASE WHEN leads AND heir IS NULL THEN NULL WHEN heir_obs = obs THEN heir ELSE after_seq END AS superseded_by
 FROM h LEFT JOIN a USING (domain, subject_id, relation, after))"""


@plan.add(_FOLD + " SELECT * FROM done UNION ALL SELECT domain, subject_id, relation, seq, text, obs, outcome, NULL, NULL, NULL FROM f WHERE outcome = 'restate'")
def ledger_fold(t: Tables) -> DataFrame:
    return ledger.fold(ledger.statements(t.memories))


@plan.add(_FOLD + " SELECT domain, subject_id, relation, seq FROM f WHERE outcome = 'restate'")
def ledger_restates(t: Tables) -> DataFrame:
    return ledger_fold(t).where("outcome = 'restate'").select(*ledger.KEY, "seq")


@plan.add(_FOLD + " SELECT domain, subject_id, relation, seq, obs, valid_to, superseded_by FROM done WHERE outcome = 'late'")
def ledger_late(t: Tables) -> DataFrame:
    return ledger_fold(t).where("outcome = 'late'").select(*ledger.KEY, "seq", "obs", "valid_to", "superseded_by")


@plan.add(f"""WITH {_SAID}, l AS (SELECT *, lag(value) OVER (PARTITION BY domain, subject_id, relation ORDER BY obs, seq) AS last FROM said), k AS (SELECT * FROM l WHERE last IS NULL OR last <> value)
SELECT domain, subject_id, relation, seq, obs, lead(obs) OVER w AS valid_to, lead(seq) OVER w AS superseded_by FROM k WINDOW w AS (PARTITION BY domain, subject_id, relation ORDER BY obs, seq)""")
def ledger_inorder(t: Tables) -> DataFrame:
    return ledger.in_order(ledger.statements(t.memories))


@plan.add("SELECT domain, subject_id, relation, count(*) AS n FROM memories WHERE status = 'active' AND relation IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def invariant_check(t: Tables) -> DataFrame:
    return ledger.violations(t.memories)


@plan.add("SELECT id, CASE WHEN confidence >= 0.8 THEN 'supersede' WHEN confidence >= 0.5 THEN 'pending' ELSE 'new' END AS band FROM reviews WHERE kind = 'supersede'")
def judge_bands(t: Tables) -> DataFrame:
    return t.reviews.where("kind = 'supersede'").select("id", ledger.judge_band(F.col("confidence")).alias("band"))


@plan.add("SELECT id, coalesce(nullif(temporal_form, ''), 'unknown') AS temporal_form FROM memories")
def temporal_form(t: Tables) -> DataFrame:
    return t.memories.select("id", F.coalesce(F.nullif("temporal_form", F.lit("")), F.lit("unknown")).alias("temporal_form"))


@plan.add(f"""WITH g AS (SELECT DISTINCT memory_id AS id FROM usage_log WHERE op = 'delete' AND memory_id IS NOT NULL)
SELECT m.id, CASE WHEN g.id IS NOT NULL THEN 'deleted' ELSE status END AS status, CASE WHEN g.id IS NOT NULL THEN coalesce(valid_to, TIMESTAMP '{NOW}') ELSE valid_to END AS valid_to FROM memories m LEFT JOIN g USING (id)""")
def soft_delete(t: Tables) -> DataFrame:
    gone = t.usage_log.where("op = 'delete' AND memory_id IS NOT NULL").select(F.col("memory_id").alias("id"))
    return ledger.soft_delete(t.memories, gone, NOW)


@plan.add(f"""SELECT r.id AS review, r.memory_id, CASE WHEN kind = 'supersede' THEN 'active' ELSE n.status END AS new_status, CASE WHEN kind = 'supersede' AND r.confidence >= 0.5 THEN o.relation ELSE n.relation END AS new_relation, r.other_id,
 CASE WHEN r.confidence >= 0.5 THEN 'superseded' WHEN kind = 'conflict' AND o.status = 'pending' THEN 'active' ELSE o.status END AS old_status,
 CASE WHEN r.confidence >= 0.5 THEN CASE WHEN kind = 'merge' THEN TIMESTAMP '{NOW}' ELSE n.valid_from END ELSE o.valid_to END AS old_valid_to, CASE WHEN r.confidence >= 0.5 THEN n.id ELSE o.superseded_by END AS old_superseded_by
FROM reviews r JOIN memories n ON n.id = r.memory_id JOIN memories o ON o.id = r.other_id WHERE r.status = 'open' AND kind IN ('supersede', 'conflict', 'merge')""")
def resolve_reviews(t: Tables) -> DataFrame:
    return ledger.resolve_reviews(t.reviews, t.memories, F.col("confidence") >= 0.5, NOW)


@plan.add("SELECT subject_id, domain, relation, object_text, valid_from FROM memories WHERE status = 'active' AND relation IS NOT NULL")
def list_keys(t: Tables) -> DataFrame:
    return t.memories.where("status = 'active' AND relation IS NOT NULL").select("subject_id", "domain", "relation", "object_text", "valid_from")


@plan.add("""SELECT subject_id, relation, id, object_text, status, valid_from, valid_to, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY relation, valid_from NULLS FIRST, id) AS INTEGER) AS pos
FROM memories WHERE relation IS NOT NULL AND subject_id IS NOT NULL AND status <> 'deleted'""")
def timeline(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("subject_id").orderBy("relation", F.asc_nulls_first("valid_from"), "id"))
    return t.memories.where("relation IS NOT NULL AND subject_id IS NOT NULL AND status <> 'deleted'").select("subject_id", "relation", "id", "object_text", "status", "valid_from", "valid_to", pos.alias("pos"))


# skills, kept as the parts of the star schema: name, seq, payload

_VERSIONS = """c AS (SELECT p_name AS name, p_partkey AS seq, p_type AS payload, lag(p_type) OVER (PARTITION BY p_name ORDER BY p_partkey) AS last FROM part),
v AS (SELECT name, seq, payload, CAST(row_number() OVER (PARTITION BY name ORDER BY seq) AS INTEGER) AS version FROM c WHERE last IS NULL OR last <> payload)"""


def _saves(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("payload"))


@plan.add(f"WITH {_VERSIONS} SELECT * FROM v")
def skill_versions(t: Tables) -> DataFrame:
    return ledger.skill_versions(_saves(t))


@plan.add(f"WITH {_VERSIONS} SELECT name, arg_max(payload, version) AS payload, max(version) AS version FROM v GROUP BY name")
def list_skills(t: Tables) -> DataFrame:
    return ledger.current_skills(_saves(t)).orderBy("name")


@plan.add(f"WITH {_VERSIONS} SELECT name, arg_max(payload, version) AS payload, max(version) AS version FROM v WHERE name NOT IN (SELECT p_name FROM part WHERE p_size = 50) GROUP BY name")
def skill_delete(t: Tables) -> DataFrame:
    gone = t.part.where("p_size = 50").select(F.col("p_name").alias("name")).distinct()
    return ledger.current_skills(_saves(t)).join(gone, "name", "left_anti")


_EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@plan.add(f"""WITH {_EMB}, s AS (SELECT a.id AS query, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT query, id, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def find_skill(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.vector_topk(e.where("id % 100 = 0"), e, 64, 5)


@plan.add(f"""WITH {_EMB}, s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.id < b.id) SELECT * FROM s WHERE similarity >= 0.3""")
def cosine_pairs(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    # every pair is asked for, so as many answers are kept as there are rows; the threshold leaves few
    return search.vector_topk(e, e, 64, e.count(), side="later", least=0.3).select(F.col("query").alias("a"), F.col("id").alias("b"), "similarity")


# consolidation


def _usable(where: str, table: str = "memories") -> str:
    return f"(SELECT id, embedding::DOUBLE[] AS v FROM {table} WHERE {where} AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


def _pairs_sql(rows: str, k: int, least: float, side: str = "b.id > a.id") -> str:
    return f"""n AS {rows}, s AS (SELECT a.id AS query, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON {side}),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s WHERE similarity >= {least} QUALIFY rank <= {k})"""


_NOTES = "relation IS NULL AND status = 'active'"


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("embedding").alias("v"))


@plan.add(f"WITH {_pairs_sql(_usable(_NOTES), 3, 0.92)} SELECT query AS a, id AS b, similarity FROM p")
def near_duplicate_pairs(t: Tables) -> DataFrame:
    n = _vectors(t.memories.where(_NOTES))
    return near_later(n, DIM, 3, 0.92).select(F.col("query").alias("a"), F.col("id").alias("b"), "similarity")


@plan.add(f"""WITH {_pairs_sql(_usable(_NOTES), 3, 0.92)}, q AS (SELECT least(memory_id, other_id) AS a, greatest(memory_id, other_id) AS b FROM reviews WHERE kind = 'merge')
SELECT CASE WHEN y.recorded_at > x.recorded_at THEN y.id ELSE x.id END AS newer, CASE WHEN y.recorded_at > x.recorded_at THEN x.id ELSE y.id END AS older, round(coalesce(j, similarity), 4) AS confidence
FROM (SELECT p.*, CASE WHEN p.query % 2 = 0 THEN round(len(list_intersect(list_distinct({SQL_TOKENS.format('x.content')}), {SQL_TOKENS.format('y.content')})) / greatest(1, len(list_distinct({SQL_TOKENS.format('x.content')}))), 6) END AS j
 FROM p JOIN memories x ON x.id = p.query JOIN memories y ON y.id = p.id) p JOIN memories x ON x.id = p.query JOIN memories y ON y.id = p.id WHERE coalesce(j, 1) >= 0.5 AND NOT EXISTS (SELECT 1 FROM q WHERE q.a = p.query AND q.b = p.id)""")
def merge_proposals(t: Tables) -> DataFrame:
    """Pairs to merge that no merge review has seen and a judge doesn't refuse; a stand-in answers for every second note."""
    pairs = near_duplicate_pairs(t).select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity")
    at = t.memories.select("id", "recorded_at")
    words = t.memories.select("id", query_tokens(F.col("content")).alias("w"))
    asked = pairs.where("src % 2 = 0").join(words.toDF("src", "q"), "src").join(words.toDF("dst", "w"), "dst").select("src", "dst", search.token_overlap(F.col("q"), F.col("w")).alias("p"))
    p = judged(unreviewed(pairs, t.reviews), asked).join(at.toDF("src", "src_at"), "src").join(at.toDF("dst", "dst_at"), "dst")
    later = F.col("dst_at") > F.col("src_at")
    return p.select(F.when(later, F.col("dst")).otherwise(F.col("src")).alias("newer"), F.when(later, F.col("src")).otherwise(F.col("dst")).alias("older"), F.round("confidence", 4).alias("confidence"))


@plan.add(f"""WITH {_pairs_sql(_usable('true', 'entities'), 3, 0.88)} SELECT query AS keep, id AS "drop", similarity FROM p WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.kind = 'alias'
 AND least(CAST(r.detail ->> 'keep' AS BIGINT), CAST(r.detail ->> 'drop' AS BIGINT)) = query AND greatest(CAST(r.detail ->> 'keep' AS BIGINT), CAST(r.detail ->> 'drop' AS BIGINT)) = id)""")
def alias_proposals(t: Tables) -> DataFrame:
    e = _vectors(t.entities)
    near = near_later(e, DIM, 3, 0.88).select(F.col("query").alias("src"), F.col("id").alias("dst"), "similarity")
    return near.join(alias_reviewed(t.reviews), ["src", "dst"], "left_anti").select(F.col("src").alias("keep"), F.col("dst").alias("drop"), "similarity")


_LIVE = "status IN ('active', 'pending')"


@plan.add(f"WITH {_pairs_sql(_usable(_LIVE), 3, 0.6, 'b.id < a.id')} SELECT DISTINCT id AS src, query AS dst, round(similarity, 4) AS weight FROM p")
def link_knn(t: Tables) -> DataFrame:
    n = _vectors(t.memories.where(_LIVE))
    return search.vector_topk(n, n, DIM, 3, side="earlier", least=0.6).select(F.col("id").alias("src"), F.col("query").alias("dst"), F.round("similarity", 4).alias("weight")).distinct()


@plan.add(f"""WITH q AS {_usable('id % 100 = 0', 'entities')}, e AS {_usable('true', 'entities')}, s AS (SELECT q.id AS query, e.id, round(list_cosine_similarity(q.v, e.v), 6) AS similarity FROM q JOIN e ON q.id <> e.id)
SELECT query, id, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s WHERE similarity >= 0.55 QUALIFY rank <= 5""")
def entity_resolve_fuzzy(t: Tables) -> DataFrame:
    e = _vectors(t.entities)
    return search.vector_topk(e.where("id % 100 = 0"), e, DIM, 5, least=0.55)


@plan.add(f"""SELECT id, 'archived' AS status FROM memories WHERE {_NOTES} AND importance < 0.3 AND domain <> 'diary' AND coalesce(last_accessed, recorded_at) < TIMESTAMP '{NOW}' - INTERVAL 180 DAY""")
def archive_stale(t: Tables) -> DataFrame:
    old = F.expr(f"coalesce(last_accessed, recorded_at) < TIMESTAMP_NTZ '{NOW}' - INTERVAL 180 DAYS")
    return t.memories.where(_NOTES).where((F.col("importance") < 0.3) & (F.col("domain") != "diary") & old).select("id", F.lit("archived").alias("status"))


@plan.add(rf"""WITH f AS (SELECT lower(e.name) AS o, e.name, m.relation, m.id, coalesce(nullif(m.object_text, ''), m.content) AS value, strftime(m.valid_from, '%Y-%m-%d') AS since
 FROM memories m JOIN entities e ON e.id = m.subject_id WHERE m.status = 'active' AND m.relation IS NOT NULL AND m.importance >= 0.7),
g AS (SELECT *, row_number() OVER w AS n, lag(name) OVER w AS before FROM f WINDOW w AS (ORDER BY o, name, relation, id)),
c AS (SELECT id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c, strftime(observed_at, '%Y-%m-%d') AS d, row_number() OVER (ORDER BY importance DESC, observed_at DESC NULLS LAST, id) AS n FROM memories WHERE {_NOTES} AND importance >= 0.7 AND domain = 'identity'),
l AS (SELECT 0 AS part, 0 AS n, 0 AS i, '# Core memory (as of {NOW[:10]})' AS line UNION ALL SELECT 1, n, 0, chr(10) || '## ' || name FROM g WHERE before IS DISTINCT FROM name
 UNION ALL SELECT 1, n, 1, '- ' || replace(relation, '_', ' ') || ': ' || value || ' (since ' || coalesce(since, '?') || ')' FROM g UNION ALL SELECT 2, n, 0, chr(10) || '## About the user' FROM c WHERE n = 1
 UNION ALL SELECT 2, n, 1, '- ' || {SQL_CLIP.format('c', 220)} || ' (' || d || ')' FROM c),
z AS (SELECT CAST(row_number() OVER (ORDER BY part, n, i) AS INTEGER) AS pos, line, sum(length(line) + 1) OVER (ORDER BY part, n, i) AS size FROM l WHERE line IS NOT NULL)
SELECT pos, line FROM z WHERE size <= 3200 UNION ALL SELECT min(pos), '- … (truncated; search memory for more)' FROM z WHERE size > 3200 HAVING count(*) > 0""")
def core_profile(t: Tables) -> DataFrame:
    return profile_lines(t.memories, t.entities, NOW[:10])


@plan.add(f"""WITH k AS (SELECT domain, subject_id, relation, arg_max(object_text, (observed_at, id)) AS latest, arg_max(object_text, id) FILTER (WHERE status = 'active') AS answer, list(object_text) AS every
 FROM memories WHERE relation IS NOT NULL AND object_text IS NOT NULL AND status IN {KNOWN} GROUP BY ALL)
SELECT count(*) AS n, round(avg(CASE WHEN answer = latest THEN 1.0 ELSE 0 END), 6) AS current_at_1, round(avg(CASE WHEN answer <> latest AND list_contains(every, answer) THEN 1.0 ELSE 0 END), 6) AS stale_at_1,
 round(avg(CASE WHEN answer IS NULL THEN 1.0 ELSE 0 END), 6) AS miss_at_1 FROM k""")
def eval_metrics(t: Tables) -> DataFrame:
    from mnemora.operators.evaluate import answer_metrics

    return answer_metrics(t.memories.where(f"status IN {KNOWN}"))
