"""Queries of the write path, with their SQL. Judges' answers are stand-ins computed from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import norm_name, query_tokens
from mnemora.operators import models, search, writing
from mnemora.operators.ledger import KEY
from mnemora.plans.memory import SQL_NORM, SQL_TOKENS
from mnemora.plans.registry import NOW, Plan, Tables

plan = Plan()
QUERIES, SQL = plan.queries, plan.sql
DIM = 384
_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

# mentions: what the facts of every hundredth row speak of; a row's vector stands for its mention's

_NEAR = f"""men AS (SELECT object_text AS mention, min(id) AS id FROM memories WHERE id % 100 = 1 AND object_text IS NOT NULL GROUP BY ALL),
mv AS (SELECT mention, embedding::DOUBLE[] AS v FROM men JOIN memories USING (id) WHERE {_USABLE}), ev AS (SELECT id AS entity_id, embedding::DOUBLE[] AS v FROM entities WHERE {_USABLE}),
nr AS (SELECT mention, entity_id, round(list_cosine_similarity(mv.v, ev.v), 6) AS similarity FROM mv, ev QUALIFY row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, entity_id) <= 5),
pk AS (SELECT mention, entity_id, round(0.7 + similarity, 6) AS p FROM nr QUALIFY row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, entity_id) = 1)"""


def _mentions(t: Tables) -> DataFrame:
    return t.memories.where("id % 100 = 1 AND object_text IS NOT NULL").groupBy(F.col("object_text").alias("mention")).agg(F.min("id").alias("id"))


def _near_entities(t: Tables) -> DataFrame:
    asked = _mentions(t).join(t.memories.select("id", F.col("embedding").alias("v")), "id")
    best = search.vector_topk(asked.select("id", "v"), t.entities.select("id", F.col("embedding").alias("v")), DIM, 5, same_ids=True)
    return best.withColumnRenamed("id", "entity_id").join(asked.select(F.col("id").alias("query"), "mention"), "query")


@plan.add(f"""WITH {_NEAR}, k AS (SELECT id, {SQL_NORM.format('name')} AS k, 0 AS via FROM entities UNION ALL SELECT id, {SQL_NORM.format('a')}, 1 FROM (SELECT id, unnest(aliases) AS a FROM entities) WHERE a IS NOT NULL),
b AS (SELECT k, arg_min(id, via * 1000000000000 + id) AS entity_id FROM k WHERE k <> '' GROUP BY k)
SELECT m.mention, coalesce(b.entity_id, CASE WHEN p.p >= 0.8 AND n.similarity >= 0.3 THEN p.entity_id END) AS entity_id,
CASE WHEN b.entity_id IS NOT NULL THEN 'exact' WHEN p.p >= 0.8 AND n.similarity >= 0.3 THEN 'judge' ELSE 'new' END AS how
FROM men m LEFT JOIN b ON b.k = {SQL_NORM.format('m.mention')} LEFT JOIN pk p USING (mention) LEFT JOIN nr n ON n.mention = p.mention AND n.entity_id = p.entity_id""")
def entity_plan(t: Tables) -> DataFrame:
    """The entity of each mention: by its name, by a stand-in judge's pick of the nearest by vector (from 0.3 on, as these tables' are far), or a new one."""
    near = _near_entities(t)
    picks = near.where("rank = 1").select("mention", "entity_id", F.round(F.lit(0.7) + F.col("similarity"), 6).alias("p"))
    return writing.plan_entities(_mentions(t), t.entities, near, picks, least=0.3)


@plan.add(f"""WITH n AS (SELECT trim(object_text) AS name, id AS seq, {SQL_NORM.format('object_text')} AS norm FROM memories WHERE object_text IS NOT NULL AND object_entity_id IS NULL),
f AS (SELECT norm, min(seq) AS seq, arg_min(name, seq) AS name FROM n WHERE norm <> '' AND norm NOT IN (SELECT norm FROM entities WHERE norm IS NOT NULL) GROUP BY norm)
SELECT (SELECT max(id) FROM entities) + row_number() OVER (ORDER BY seq, norm) AS id, name, norm FROM f""")
def entity_create(t: Tables) -> DataFrame:
    """The entities that plain values of facts would make, in order of their first mention."""
    new = t.memories.where("object_text IS NOT NULL AND object_entity_id IS NULL").select(F.col("object_text").alias("mention"), F.col("id").alias("seq"))
    return writing.create_entities(new, t.entities)


# statements: active facts said again, every seventh under another relation; a judge's answer follows from the id

_SAID = """said AS (SELECT id + 1000000000 AS seq, domain, subject_id, CASE WHEN id % 7 = 0 THEN relation || '_again' ELSE relation END AS relation, id AS fact_id, (id % 50) / 49.0 AS p, object_text, valid_from, id
 FROM memories WHERE status = 'active' AND relation IS NOT NULL AND subject_id IS NOT NULL)"""
_MAPPED = f"""{_SAID}, fx AS (SELECT id, domain, subject_id, relation, row_number() OVER (PARTITION BY domain, subject_id ORDER BY valid_from DESC, id DESC) AS k FROM memories WHERE status = 'active' AND relation IS NOT NULL AND subject_id IS NOT NULL),
sm AS (SELECT s.*, x.id AS same, y.relation AS adopted FROM said s LEFT JOIN fx x ON x.domain = s.domain AND x.subject_id = s.subject_id AND x.relation = s.relation LEFT JOIN fx y ON y.id = s.fact_id AND y.k <= 12),
mp AS (SELECT *, CASE WHEN same IS NOT NULL THEN 'exact' WHEN adopted IS NULL OR p < 0.5 THEN 'new' WHEN p >= 0.8 THEN 'auto' ELSE 'review' END AS band FROM sm)"""


def _said(t: Tables) -> DataFrame:
    m = t.memories.where("status = 'active' AND relation IS NOT NULL AND subject_id IS NOT NULL")
    again = F.when(F.col("id") % 7 == 0, F.concat("relation", F.lit("_again"))).otherwise(F.col("relation"))
    return m.select((F.col("id") + 1_000_000_000).alias("seq"), "domain", "subject_id", again.alias("relation"), F.col("id").alias("fact_id"), (F.col("id") % 50 / 49.0).alias("p"), "object_text", "valid_from", "id")


def _mapped(t: Tables) -> DataFrame:
    said = _said(t)
    return writing.map_keys(said, t.memories.where("status = 'active'"), said.select("seq", "fact_id", "p"))


@plan.add(f"""WITH {_MAPPED} SELECT seq, CASE band WHEN 'exact' THEN same WHEN 'new' THEN NULL ELSE fact_id END AS target, round(CASE band WHEN 'exact' THEN 1.0 WHEN 'new' THEN NULL ELSE p END, 6) AS confidence, band,
CASE band WHEN 'auto' THEN adopted ELSE relation END AS relation FROM mp""")
def key_mapping(t: Tables) -> DataFrame:
    """The fact that each statement replaces: of its key, or as judged among the subject's latest twelve, whose relation it takes."""
    return _mapped(t).withColumn("confidence", F.round("confidence", 6))


_VALUE = "CASE id % 3 WHEN 0 THEN coalesce(object_text, '') ELSE coalesce(object_text, '') || ' anew' END"
_BATCH = f"""bt AS (SELECT m.seq, m.domain, m.subject_id, CASE band WHEN 'auto' THEN adopted ELSE relation END AS relation, {SQL_NORM.format(_VALUE)} AS value,
 epoch_us(valid_from) + (id % 5 - 2) * 86400000000 AS obs FROM mp m WHERE band <> 'review'),
hs AS (SELECT id, domain, subject_id, relation, status, {SQL_NORM.format("coalesce(object_text, '')")} AS value, epoch_us(valid_from) AS f, epoch_us(valid_to) AS u, superseded_by AS b FROM memories
 WHERE status IN ('active', 'superseded') AND relation IS NOT NULL AND subject_id IS NOT NULL)"""


@plan.add(f"""WITH {_MAPPED}, {_BATCH},
o AS (SELECT bt.*, a.id AS aid, a.f AS af, CASE WHEN a.id IS NULL THEN 'first' WHEN a.value = bt.value THEN 'restate' WHEN obs < a.f THEN 'late' ELSE 'supersede' END AS outcome FROM bt
 LEFT JOIN hs a ON a.domain = bt.domain AND a.subject_id = bt.subject_id AND a.relation = bt.relation AND a.status = 'active'),
l AS (SELECT o.seq, arg_min(h.id, (h.f, h.id)) AS b, min(h.f) AS u FROM o JOIN hs h ON h.domain = o.domain AND h.subject_id = o.subject_id AND h.relation = o.relation AND h.f > o.obs WHERE outcome = 'late' GROUP BY o.seq)
SELECT domain, subject_id, relation, seq, outcome, CASE outcome WHEN 'restate' THEN NULL WHEN 'late' THEN 'superseded' ELSE 'active' END AS status, l.u AS valid_to, l.b AS superseded_by FROM o LEFT JOIN l USING (seq)
UNION ALL SELECT domain, subject_id, relation, aid, 'given', 'superseded', obs, seq FROM o WHERE outcome = 'supersede'
UNION ALL SELECT h.domain, h.subject_id, h.relation, h.id, 'given', 'superseded', o.obs, o.seq FROM o JOIN hs h ON h.domain = o.domain AND h.subject_id = o.subject_id AND h.relation = o.relation
 WHERE outcome = 'late' AND h.status = 'superseded' AND h.f < o.obs AND h.u > o.obs""")
def store_batch(t: Tables) -> DataFrame:
    """What the statements store and change, those in the review band aside: a third restate, others come late or replace."""
    value = F.when(F.col("id") % 3 == 0, F.coalesce("object_text", F.lit(""))).otherwise(F.concat(F.coalesce("object_text", F.lit("")), F.lit(" anew")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    said = _said(t).select("seq", "domain", "subject_id", norm_name(value).alias("value"), (micros("valid_from") + (F.col("id") % 5 - 2) * 86_400_000_000).alias("obs"))
    said = said.join(_mapped(t).where("band <> 'review'").select("seq", "relation"), "seq")
    old = t.memories.where("relation IS NOT NULL AND subject_id IS NOT NULL").select(
        "id", *KEY, "status", norm_name(F.coalesce("object_text", F.lit(""))).alias("value"), micros("valid_from").alias("valid_from"), micros("valid_to").alias("valid_to"), "superseded_by")
    return writing.store(said, old)


# conflicts: new notes, the rows of every hundredth id, against active memories

_CONFLICT = f"""cq AS (SELECT id AS note, embedding::DOUBLE[] AS v, list_distinct({SQL_TOKENS.format('content')}) AS t FROM memories WHERE id % 100 = 0 AND relation IS NULL AND {_USABLE}),
cr AS (SELECT id, embedding::DOUBLE[] AS v, {SQL_TOKENS.format('content')} AS t FROM memories WHERE status = 'active' AND {_USABLE}),
cs AS (SELECT note, id, round(list_cosine_similarity(cq.v, cr.v), 6) AS similarity, round(len(list_intersect(cq.t, cr.t)) / greatest(1, len(cq.t)), 6) AS p FROM cq JOIN cr ON note <> id),
cn AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY similarity DESC, id) AS k FROM cs WHERE similarity >= 0.5 QUALIFY k <= 5),
cb AS (SELECT note, arg_max(id, (p, -k)) AS id, max(p) AS p FROM cn GROUP BY note HAVING max(p) >= 0.4)"""


def _conflicts(t: Tables) -> DataFrame:
    """From 0.4 on, as the stand-in's answers are low."""
    v = lambda rows: rows.select("id", F.col("embedding").alias("v"))
    near = search.vector_topk(v(t.memories.where("id % 100 = 0 AND relation IS NULL")), v(t.memories.where("status = 'active'")), DIM, 5, least=0.5).select(F.col("query").alias("note"), "id", "similarity")
    words = t.memories.select("id", query_tokens(F.col("content")).alias("w"))
    both = near.join(words.toDF("note", "q"), "note").join(words, "id").select("note", "id", search.token_overlap(F.col("q"), F.col("w")).alias("p"))
    return writing.conflicts(near, both, threshold=0.4)


@plan.add(f"WITH {_CONFLICT} SELECT * FROM cb")
def note_conflicts(t: Tables) -> DataFrame:
    """The active memory that each new note most likely makes out of date."""
    return _conflicts(t)


@plan.add(f"WITH {_CONFLICT} SELECT id, CASE WHEN status = 'active' AND id IN (SELECT id FROM cb) THEN 'pending' ELSE status END AS status FROM memories")
def conflict_hidden(t: Tables) -> DataFrame:
    """Memories after the old sides of conflicts are set pending."""
    return writing.hidden(t.memories, _conflicts(t))


@plan.add(f"WITH {_CONFLICT}, {_MAPPED} SELECT 'conflict' AS kind, note AS memory_id, id AS other_id, p AS confidence FROM cb UNION ALL SELECT 'supersede', seq, fact_id, round(p, 6) FROM mp WHERE band = 'review'")
def review_queue(t: Tables) -> DataFrame:
    """Reviews that unsure statements and conflicting notes open."""
    return writing.review_rows(_mapped(t), _conflicts(t)).withColumn("confidence", F.round("confidence", 6))


@plan.add("""SELECT id, CASE WHEN temporal_form IN ('ongoing', 'completed', 'habitual', 'unknown') THEN temporal_form WHEN (id % 10) / 10 >= 0.5 THEN ['ongoing', 'completed', 'habitual', 'sometimes'][id % 4 + 1] ELSE 'unknown' END AS temporal_form FROM memories""".replace("['ongoing', 'completed', 'habitual', 'sometimes'][id % 4 + 1]", "CASE WHEN id % 4 = 3 THEN 'unknown' ELSE ['ongoing', 'completed', 'habitual', 'sometimes'][id % 4 + 1] END"))
def temporal_form_judged(t: Tables) -> DataFrame:
    """The given form, else a judge's, here from the id."""
    pick = F.element_at(F.array(*map(F.lit, ("ongoing", "completed", "habitual", "sometimes"))), (F.col("id") % 4 + 1).cast("int"))
    return t.memories.select("id", writing.temporal_form(F.col("temporal_form"), pick, F.col("id") % 10 / 10).alias("temporal_form"))


@plan.add(f"""WITH r AS (SELECT uid AS ref FROM memories WHERE id % 50 = 0 UNION SELECT external_id FROM memories WHERE id % 50 = 1), g AS (SELECT id FROM memories WHERE uid IN (SELECT ref FROM r WHERE ref IS NOT NULL) OR external_id IN (SELECT ref FROM r WHERE ref IS NOT NULL))
SELECT id, CASE WHEN id IN (FROM g) THEN 'deleted' ELSE status END AS status, CASE WHEN id IN (FROM g) THEN coalesce(valid_to, TIMESTAMP '{NOW}') ELSE valid_to END AS valid_to FROM memories""")
def delete_by_reference(t: Tables) -> DataFrame:
    """Memories after those of some uids and external ids are deleted."""
    from mnemora.operators.ledger import soft_delete

    refs = t.memories.where("id % 50 = 0").select(F.col("uid").alias("ref")).unionAll(t.memories.where("id % 50 = 1").select("external_id"))
    return soft_delete(t.memories, writing.referred(t.memories, refs), NOW)


_EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@plan.add(f"""WITH {_EMB}, s AS (SELECT a.id AS query, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) AS k FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT query, id, similarity, CASE WHEN k = 3 THEN 0.9 END AS p, CAST(row_number() OVER (PARTITION BY query ORDER BY k <> 3, k) AS INTEGER) AS rank FROM s WHERE k <= 5""")
def find_skill_picked(t: Tables) -> DataFrame:
    """Skills by vector, a judge's pick first; here the third of each list."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    hits = search.vector_topk(e.where("id % 100 = 0"), e, 64, 5)
    return writing.picked_first(hits, hits.where("rank = 3").select("query", "id", F.lit(0.9).alias("p")))


@plan.add("""WITH s AS (SELECT p_name AS name, 'skill-' || min(p_partkey) AS uid, CASE WHEN min(p_partkey) % 2 = 0 THEN 'ext-' || min(p_partkey) END AS external_id, count(*) AS saves FROM part GROUP BY p_name),
r AS (SELECT uid AS ref FROM s WHERE uid LIKE '%1' UNION SELECT external_id FROM s WHERE uid LIKE '%2' UNION SELECT name FROM s WHERE uid LIKE '%3')
SELECT name, uid, external_id, saves FROM s WHERE name NOT IN (SELECT ref FROM r WHERE ref IS NOT NULL) AND uid NOT IN (SELECT ref FROM r WHERE ref IS NOT NULL)
AND (external_id IS NULL OR external_id NOT IN (SELECT ref FROM r WHERE ref IS NOT NULL))""")
def skill_delete_by_reference(t: Tables) -> DataFrame:
    """Skills left after some are deleted by uid, external id or name; the parts of the star schema stand for their saves."""
    first = F.min("p_partkey").cast("string")
    s = t.part.groupBy(F.col("p_name").alias("name")).agg(
        F.concat(F.lit("skill-"), first).alias("uid"), F.when(F.min("p_partkey") % 2 == 0, F.concat(F.lit("ext-"), first)).alias("external_id"), F.count("*").alias("saves"))
    by = lambda c, end: s.where(F.col("uid").endswith(end)).select(F.col(c).alias("ref"))
    refs = by("uid", "1").unionAll(by("external_id", "2")).unionAll(by("name", "3"))
    return writing.without(s, refs, ["uid", "external_id", "name"]).select("name", "uid", "external_id", "saves")


# models as plain Python functions over batches, here with stand-ins


@plan.add(f"""SELECT id, CASE WHEN object_text IS NOT NULL THEN round(len(list_intersect(list_distinct({SQL_TOKENS.format('object_text')}), {SQL_TOKENS.format('content')})) / greatest(1, len(list_distinct({SQL_TOKENS.format('object_text')}))), 6) END AS p FROM memories WHERE content IS NOT NULL""")
def judge_noul(t: Tables) -> DataFrame:
    """A yes-or-no judge over pairs of texts; a text that is missing, or a batch that fails, has no answer."""
    return t.memories.where("content IS NOT NULL").select("id", models.noul(models.overlap)(F.col("object_text"), F.col("content")).alias("p"))


@plan.add("""WITH o AS (SELECT m.id, m.content AS state, e.id AS option, e.name FROM memories m JOIN entities e ON e.id IN (m.subject_id, m.subject_id + 1) WHERE m.id % 20 = 0 AND m.content IS NOT NULL),
s AS (SELECT id, option, CASE WHEN length(name) > 0 THEN 1.0 / (1 + abs(length(name) - length(state) % 20)) END AS p FROM o)
SELECT id, CAST(arg_max(option, (p, -option)) AS VARCHAR) AS pick, round(max(p), 6) AS p FROM s GROUP BY id""")
def judge_choice(t: Tables) -> DataFrame:
    """A judge's pick among the options of each question."""
    m = t.memories.where("id % 20 = 0 AND content IS NOT NULL").select("id", F.col("content").alias("state"), F.explode(F.array("subject_id", F.col("subject_id") + 1)).alias("option"))
    options = m.join(t.entities.select(F.col("id").alias("option"), "name"), "option").select("id", "state", F.col("option").cast("string").alias("key"), F.col("name").alias("text"))
    return models.choice(options, models.nearest_length).withColumn("p", F.round("p", 6))


@plan.add("SELECT id, length(content)::DOUBLE AS x, length(regexp_replace(content, '[^a-z]', '', 'g'))::DOUBLE AS y FROM memories WHERE content IS NOT NULL")
def embed_texts(t: Tables) -> DataFrame:
    """Vectors from a model given as a function; the stand-in counts characters and small letters."""
    v = t.memories.where("content IS NOT NULL").select("id", models.embedded(models.letter_counts)(F.col("content")).alias("v"))
    return v.select("id", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))
