"""Queries of hybrid retrieval and of the graph, with their SQL.

Queries are the memories whose id is divisible by 100, each searched against all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.stemming import stemmed_tokens
from mnemora.functions.text import query_tokens
from mnemora.operators import analytics, entities, evaluate, graph, models, search, views
from mnemora.plans.memory import SQL_NORM, SQL_TOKENS
from mnemora.plans.registry import AS_OF, NOW, Plan, Tables
from mnemora.sources import cut

plan = Plan()
QUERIES, SQL = plan.queries, plan.sql
DIM = 384
W_GRAPH = analytics.SETTINGS["w_graph"]

_CUR = f"cur AS MATERIALIZED (SELECT * FROM memories WHERE status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'))"
_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VEC = f"""vq AS MATERIALIZED (SELECT id AS query, embedding::DOUBLE[] AS v FROM memories WHERE id % 100 = 0 AND {_USABLE}), vr AS MATERIALIZED (SELECT id, embedding::DOUBLE[] AS v FROM cur WHERE {_USABLE}),
vs AS (SELECT query, id, round(list_cosine_similarity(vq.v, vr.v), 6) AS similarity FROM vq JOIN vr ON query <> id),
vec AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 30)"""
_POST = f"""tok AS MATERIALIZED (SELECT id, {SQL_TOKENS.format("content || ' ' || coalesce(array_to_string(tags, ' '), '')")} AS w FROM memories WHERE content IS NOT NULL),
post AS MATERIALIZED (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL),
qt AS MATERIALIZED (SELECT query, term, CAST(row_number() OVER (PARTITION BY query ORDER BY p) - 1 AS INTEGER) AS pos FROM (SELECT id AS query, unnest({SQL_TOKENS.format('content')}) AS term,
 unnest(range(len({SQL_TOKENS.format('content')}))) AS p FROM memories WHERE id % 100 = 0)),
ql AS MATERIALIZED (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT id, max(len) AS len FROM post GROUP BY id))"""
_BM = """df AS MATERIALIZED (SELECT term, count(DISTINCT id) AS df FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, ql),
bs AS (SELECT query, p.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM (SELECT DISTINCT query, term FROM qt) t JOIN post p USING (term) JOIN idf USING (term), ql
 WHERE p.id IN (SELECT id FROM cur) GROUP BY query, p.id),
bm AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM bs QUALIFY rank <= 30)"""
_AW = """aw AS MATERIALIZED (SELECT query, round(0.4 + 0.8 * least(1.0, greatest(0.0, avg(CASE WHEN df IS NULL THEN 1.0 ELSE ln((n + 1) / (df + 0.5)) / ln(n + 1) END))), 9) AS w_text
 FROM (SELECT * FROM qt WHERE pos < 12) LEFT JOIN df USING (term), (SELECT count(*) AS n FROM memories) GROUP BY query)"""
#: What cuts a query to its first terms in ``_AW``; where it is left out, all terms of a query give the weight.
_FIRST = " WHERE pos < 12"
_ADJ = """live AS MATERIALIZED (SELECT id, subject_id, object_entity_id FROM memories WHERE status = 'active'),
one AS (SELECT 'm' || id AS a, 'e' || subject_id AS b, 1.0::DOUBLE AS w FROM live WHERE subject_id IS NOT NULL UNION ALL SELECT 'm' || id, 'e' || object_entity_id, 1.0 FROM live WHERE object_entity_id IS NOT NULL
 UNION ALL SELECT 'm' || src, 'm' || dst, weight FROM links WHERE src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live)),
adj AS MATERIALIZED (SELECT a AS src, b AS dst, sum(w) AS w FROM (SELECT a, b, w FROM one UNION ALL SELECT b, a, w FROM one) GROUP BY ALL)"""


def _ppr(seeds: str) -> str:
    """Twenty rounds as twenty common table expressions, from seeds (query, node, weight)."""
    parts = [
        "deg AS MATERIALIZED (SELECT src, sum(w) AS d FROM adj GROUP BY src)", "stp AS MATERIALIZED (SELECT src, dst, w / d AS p FROM adj JOIN deg USING (src))",
        f"sd AS (SELECT query, node, sum(weight) AS weight FROM ({seeds}) WHERE weight > 0 AND node IN (SELECT src FROM deg) GROUP BY ALL)",
        "r0 AS MATERIALIZED (SELECT query, node, weight / sum(weight) OVER (PARTITION BY query) AS mass FROM sd)"]
    for i in range(1, 21):
        parts.append(f"""r{i} AS MATERIALIZED (SELECT query, node, sum(x) AS mass FROM (SELECT query, dst AS node, 0.5 * mass * p AS x FROM r{i - 1} JOIN stp ON src = node
 UNION ALL SELECT query, node, 0.5 * mass FROM r0) GROUP BY ALL)""")
    return ", ".join(parts)


_SEEDS = f"""nm AS (SELECT id AS entity_id, {SQL_NORM.format('name')} AS n FROM entities UNION SELECT id, {SQL_NORM.format('a')} FROM (SELECT id, unnest(aliases) AS a FROM entities) WHERE a IS NOT NULL),
seeds AS MATERIALIZED (SELECT DISTINCT query, entity_id FROM (SELECT id AS query, ' ' || {SQL_NORM.format('content')} || ' ' AS q FROM memories WHERE id % 100 = 0) JOIN nm ON n <> '' AND contains(q, ' ' || n || ' '))"""
#: With the second step, for queries that name no entity: the three best by BM25 over names and aliases.
_SEEDS = f"""{_SEEDS.replace('seeds AS', 'named AS')}, et AS (SELECT id, {SQL_TOKENS.format("concat_ws(' ', name, array_to_string(aliases, ' '))")} AS w FROM entities),
ep AS MATERIALIZED (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM et) GROUP BY ALL),
el AS MATERIALIZED (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT id, max(len) AS len FROM ep GROUP BY id)),
ed AS (SELECT term, count(DISTINCT id) AS df FROM ep GROUP BY term), ei AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM ed, el),
eq AS (SELECT DISTINCT query, term FROM (SELECT id AS query, unnest({SQL_TOKENS.format('content')}) AS term FROM memories WHERE id % 100 = 0) WHERE query NOT IN (SELECT query FROM named)),
es AS (SELECT query, id AS entity_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM eq JOIN ep USING (term) JOIN ei USING (term), el GROUP BY query, id),
seeds AS MATERIALIZED (SELECT query, entity_id, 1.0::DOUBLE AS weight FROM named UNION ALL SELECT query, entity_id, 0.5::DOUBLE
 FROM (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, entity_id) <= 3))"""
_GR = f"""{_ADJ}, {_SEEDS}, {_ppr("SELECT query, 'e' || entity_id AS node, weight FROM seeds")},
gm AS (SELECT query, CAST(substr(node, 2) AS BIGINT) AS id, round(mass, 9) AS mass FROM r20 WHERE node[1] = 'm'),
g90 AS (SELECT * FROM gm QUALIFY row_number() OVER (PARTITION BY query ORDER BY mass DESC, id) <= 90),
gr AS MATERIALIZED (SELECT query, id, mass, CAST(row_number() OVER (PARTITION BY query ORDER BY mass DESC, id) AS INTEGER) AS rank FROM g90 WHERE id IN (SELECT id FROM cur) QUALIFY rank <= 30)"""
_FUSE = """al AS (SELECT query, id, 'v' AS c, rank FROM vec UNION ALL SELECT query, id, 'b', rank FROM bm UNION ALL SELECT query, id, 'g', rank FROM gr),
fu AS MATERIALIZED (SELECT query, id, round(sum(CASE c WHEN 'v' THEN 1.0::DOUBLE WHEN 'b' THEN coalesce(w_text, 1.0) ELSE 0.7::DOUBLE END / (60 + rank)), 9) AS fused, max(CASE WHEN c = 'v' THEN rank END) AS r_vector,
 max(CASE WHEN c = 'b' THEN rank END) AS r_text, max(CASE WHEN c = 'g' THEN rank END) AS r_graph FROM al LEFT JOIN aw USING (query) GROUP BY query, id)"""
_PRIOR = f"""pr AS MATERIALIZED (SELECT query, id, fused, r_vector, r_text, r_graph, round((0.1 * coalesce(importance, 0) + 0.05 * pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(observed_at)) / 86400000000.0) / 90.0)
 + 0.05 * CASE WHEN most > 0 THEN ln(1 + access_count) / ln(1 + most) ELSE 0 END) / 61, 9) AS prior
 FROM (SELECT fu.*, m.importance, m.observed_at, m.access_count, max(access_count) OVER (PARTITION BY query) AS most FROM fu JOIN memories m USING (id)))"""
_ORDER = "od AS MATERIALIZED (SELECT *, round(fused + prior, 9) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(fused + prior, 9) DESC, id) AS INTEGER) AS fused_rank FROM pr)"
_RR = f"""rt AS (SELECT id, list_distinct({SQL_TOKENS.format('substr(content, 1, 320)')}) AS w FROM memories), qd AS (SELECT id AS query, list_distinct({SQL_TOKENS.format('content')}) AS q FROM memories WHERE id % 100 = 0),
po AS (SELECT query, id, fused_rank, round(len(list_intersect(q, w)) / greatest(1, len(q)), 6) AS rerank FROM od JOIN qd USING (query) JOIN rt USING (id) WHERE fused_rank <= 8),
r1k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY rerank DESC, fused_rank) AS INTEGER) AS rerank_rank FROM po),
bl AS MATERIALIZED (SELECT *, round(0.5 / (10 + fused_rank) + 1.0 / (10 + rerank_rank), 9) AS blended FROM r1k),
rb AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY blended DESC, fused_rank) AS INTEGER) AS rank FROM bl)"""
_TEXT = f"{_CUR}, {_POST}, {_BM}"
_ALL = f"WITH {_CUR}, {_VEC}, {_POST}, {_BM}, {_AW}, {_GR}, {_FUSE}, {_PRIOR}, {_ORDER}"


def _queries(t: Tables) -> DataFrame:
    """The queries, with their whole texts."""
    if t.asked is not None:
        return t.asked
    return t.memories.where("id % 100 = 0").select("id", "content", F.col("embedding").alias("v"))


def _current(t: Tables) -> DataFrame:
    return views.current_view(t.memories, NOW)


def _vector(t: Tables, allowed: DataFrame) -> DataFrame:
    return search.vector_topk(_queries(t), allowed.select("id", F.col("embedding").alias("v")), DIM, search.POOL)


@plan.add(f"WITH {_CUR}, {_VEC} SELECT query, id, similarity, rank FROM vec")
def vector_topk(t: Tables) -> DataFrame:
    return _vector(t, _current(t))


def _words(t: Tables) -> DataFrame:
    words = query_tokens(F.concat_ws(" ", "content", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    return t.memories.where("content IS NOT NULL").select("id", words.alias("w"))


def _has(rows: DataFrame) -> DataFrame:
    """Each term of each row (id, w), once."""
    return rows.select("id", F.explode(F.array_distinct("w")).alias("term"))


def _terms(t: Tables) -> DataFrame:
    return _queries(t).select(F.col("id").alias("query"), F.posexplode(query_tokens(F.col("content"))).alias("pos", "term"))


@plan.add(f"WITH {_POST} SELECT term, count(DISTINCT id) AS df, sum(tf)::BIGINT AS n FROM post GROUP BY term")
def term_idf(t: Tables) -> DataFrame:
    return search.postings(_words(t), F.col("w")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@plan.add(f"WITH {_TEXT} SELECT query, id, score, rank FROM bm")
def bm25_topk(t: Tables) -> DataFrame:
    return search.text_topk(_terms(t).select("query", "term"), cut(_words(t)), search.POOL, allowed=_current(t))


@plan.add()
def bm25_stemmed(t: Tables) -> DataFrame:
    """BM25 as a stemming full-text index ranks: English stems, no accents, content and tags; a token of several words is a phrase."""
    whole = F.concat_ws(" ", "content", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    rows = cut(t.memories.where("content IS NOT NULL").select("id", stemmed_tokens(whole).alias("w")))
    asked = _queries(t).select(F.col("id").alias("query"), F.explode(F.array_distinct(query_tokens(F.col("content")))).alias("t"))
    terms = cut(asked.select("query", F.array_join(stemmed_tokens(F.col("t")), " ").alias("term")).where("term <> ''"))
    return search.text_topk(terms, rows, search.POOL, allowed=_current(t))


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@plan.add(f"""WITH {_CUR}, pw AS MATERIALIZED (SELECT id, {_WORDS.format("content")} AS w FROM memories WHERE content IS NOT NULL), ql AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM pw WHERE len(w) > 0),
qt AS (SELECT DISTINCT id AS query, array_to_string({_WORDS.format('x')}, ' ') AS term FROM (SELECT id, unnest({SQL_TOKENS.format('content')}) AS x FROM memories WHERE id % 100 = 0)),
ph AS (SELECT DISTINCT term, string_split(term, ' ') AS p FROM qt WHERE term <> ''),
hit AS MATERIALIZED (SELECT id, term, len(w) AS len, len(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) AS tf FROM pw JOIN ph ON list_has_all(w, p)),
df AS (SELECT term, count(*) AS df FROM hit WHERE tf > 0 GROUP BY term), idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, ql),
bs AS (SELECT query, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM qt JOIN hit USING (term) JOIN idf USING (term), ql WHERE tf > 0 AND id IN (SELECT id FROM cur) GROUP BY query, id)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM bs QUALIFY rank <= 30""")
def bm25_phrases(t: Tables) -> DataFrame:
    """BM25 in which a token of several words, as ``svc-9.1``, stands for its words side by side."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    rows = cut(t.memories.where("content IS NOT NULL").select("id", words(F.col("content")).alias("w")))
    asked = _queries(t).select(F.col("id").alias("query"), F.explode(F.array_distinct(query_tokens(F.col("content")))).alias("t"))
    terms = cut(asked.select("query", F.array_join(words(F.col("t")), " ").alias("term")).where("term <> ''"))
    return search.text_topk(terms, rows, search.POOL, allowed=_current(t))


@plan.add(f"WITH {_TEXT}, {_AW} SELECT query, w_text FROM aw")
def adaptive_weight(t: Tables) -> DataFrame:
    return search.adaptive_weight(_terms(t), _has(_words(t)), t.memories.count())


@plan.add(f"WITH {_ADJ} SELECT src, dst, round(w, 9) AS w FROM adj")
def graph_adjacency(t: Tables) -> DataFrame:
    return graph.adjacency(t.memories, t.links).withColumn("w", F.round("w", 9))


@plan.add(f"WITH {_ADJ}, {_ppr('''SELECT id AS query, 'e' || id AS node, 1.0::DOUBLE AS weight FROM entities WHERE id % 100 = 0''')} SELECT query, node, round(mass, 9) AS mass FROM r20")
def ppr(t: Tables) -> DataFrame:
    seeds = t.entities.where("id % 100 = 0").select(F.col("id").alias("query"), F.concat(F.lit("e"), "id").alias("node"), F.lit(1.0).alias("weight"))
    return graph.pagerank(graph.adjacency(t.memories, t.links), seeds).withColumn("mass", F.round("mass", 9))


def _graph(t: Tables, allowed: DataFrame) -> DataFrame:
    nodes = entities.seeds(_queries(t), t.entities).select(F.col("id").alias("query"), F.concat(F.lit("e"), "entity_id").alias("node"), "weight")
    mass = graph.pagerank(graph.adjacency(t.memories, t.links), nodes).where("node LIKE 'm%'")
    mass = mass.select("query", F.expr("cast(substr(node, 2) as bigint)").alias("id"), F.round("mass", 9).alias("mass"))
    # more than asked for are ranked first and filtered then, as rank is held against the unfiltered mass
    wide = search.ranked(mass, "query", [F.desc("mass"), F.col("id")], 3 * search.POOL).drop("rank")
    return search.ranked(wide.join(allowed.select("id"), "id", "left_semi"), "query", [F.desc("mass"), F.col("id")], search.POOL)


@plan.add(f"WITH {_CUR}, {_GR} SELECT query, id, mass, rank FROM gr")
def graph_channel(t: Tables) -> DataFrame:
    return _graph(t, _current(t)).select("query", "id", "mass", "rank")


@plan.add(f"WITH {_SEEDS} SELECT query AS id, entity_id, weight FROM seeds")
def entity_seeds(t: Tables) -> DataFrame:
    """Seeds with the second step: queries that name no entity start from the best by BM25 over names."""
    return entities.seeds(_queries(t), t.entities)


def _fused(t: Tables, allowed: DataFrame, w_graph: float = W_GRAPH, adaptive: bool = True, most: int | None = 12) -> DataFrame:
    rows, asked = cut(_words(t)), _terms(t)
    best = search.text_topk(asked.select("query", "term"), rows, search.POOL, allowed=allowed)
    if adaptive:
        best = best.join(search.adaptive_weight(asked, _has(rows), t.memories.count(), most), "query", "left").withColumn("weight", F.coalesce("w_text", F.lit(1.0)))
    text = best if adaptive else best.withColumn("weight", F.lit(1.0))
    return search.fuse({
        "vector": _vector(t, allowed).withColumn("weight", F.lit(1.0)), "text": text, "graph": _graph(t, allowed).withColumn("weight", F.lit(w_graph))})


@plan.add(f"WITH {_CUR}, {_VEC}, {_POST}, {_BM}, {_AW.replace(_FIRST, '')}, {_GR}, {_FUSE} SELECT query, id, fused, r_vector, r_text, r_graph FROM fu")
def rrf_fusion(t: Tables) -> DataFrame:
    """The channels fused; all terms of a query give the weight of the text channel."""
    return _fused(t, _current(t), most=None).select("query", "id", "fused", "r_vector", "r_text", "r_graph")


@plan.add(_ALL + " SELECT query, id, fused, prior FROM pr")
def recency_prior(t: Tables) -> DataFrame:
    return search.prior(_fused(t, _current(t)), t.memories, NOW).select("query", "id", "fused", "prior")


def _ordered(t: Tables, allowed: DataFrame, w_graph: float = W_GRAPH, adaptive: bool = True, most: int | None = 12) -> DataFrame:
    """All candidates in fused order; every row that one of three channels of POOL rows gives."""
    p = search.prior(_fused(t, allowed, w_graph, adaptive, most), t.memories, NOW).withColumn("score", F.round(F.col("fused") + F.col("prior"), 9))
    # read twice by the reranking queries
    return cut(search.ranked(p, "query", [F.desc("score"), F.col("id")], 3 * search.POOL).withColumnRenamed("rank", "fused_rank"))


def _scores(t: Tables, ordered: DataFrame) -> DataFrame:
    """Reranker's scores of the pool: query, id, rerank."""
    asked = _queries(t).select(F.col("id").alias("query"), query_tokens(F.col("content")).alias("q"))
    # words are cut after the join, of the pool's texts alone
    read = t.memories.select("id", F.substring("content", 1, 320).alias("text"))
    pool = ordered.where(F.col("fused_rank") <= search.RERANKED).join(read, "id").join(asked, "query")
    return pool.select("query", "id", search.token_overlap(F.col("q"), query_tokens(F.col("text"))).alias("rerank"))


def _found(t: Tables, allowed: DataFrame, limit: int = 5, rerank: str = "blend", w_graph: float = W_GRAPH, adaptive: bool = True, most: int | None = 12) -> DataFrame:
    ordered = _ordered(t, allowed, w_graph, adaptive, most)
    return search.reordered(ordered, None if rerank == "off" else _scores(t, ordered), rerank).where(F.col("rank") <= max(1, limit))


@plan.add(_ALL + f", {_RR} SELECT query, id, fused_rank, rerank, rerank_rank, blended, rank FROM rb")
def rerank_blend(t: Tables) -> DataFrame:
    ordered = _ordered(t, _current(t))
    return search.blend(_scores(t, ordered).join(ordered.select("query", "id", "fused_rank"), ["query", "id"]))


#: The whole order: the reranked pool, then the rest as fused; the pool scores by the reranker, the rest by fusion and prior.
_WHOLE = "wh AS MATERIALIZED (SELECT query, id, rank, rerank, rerank AS score FROM rb UNION ALL SELECT query, id, fused_rank, NULL, score FROM od WHERE fused_rank > 8)"
_FOUND = "SELECT query, id, rank, score FROM wh WHERE rank <= "


def _search_sql(rows: str, limit: int, rerank: str = "blend") -> str:
    """The SQL of a search over the rows that meet ``rows``."""
    sql = _ALL.replace(_CUR, f"cur AS MATERIALIZED (SELECT * FROM memories WHERE {rows})")
    if rerank == "off":
        return sql + f" SELECT query, id, fused_rank AS rank, score FROM od WHERE fused_rank <= {limit}"
    rr = _RR if rerank == "blend" else _RR.replace("ORDER BY blended DESC, fused_rank)", "ORDER BY rerank DESC, fused_rank)")
    return sql + f", {rr}, {_WHOLE} {_FOUND}{limit}"


_NOW_ROWS = f"status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"


@plan.add(_search_sql(_NOW_ROWS, 5))
def hybrid_search(t: Tables) -> DataFrame:
    return _found(t, _current(t)).select("query", "id", "rank", "score")


@plan.add(_search_sql(_NOW_ROWS + " AND domain = 'projects' AND importance >= 0.3", 12))
def hybrid_search_filtered(t: Tables) -> DataFrame:
    """Search within a domain and from an importance on, with more hits than are reranked."""
    return _found(t, views.matching(_current(t), domain="projects", min_importance=0.3), 12).select("query", "id", "rank", "score")


@plan.add(_search_sql(_NOW_ROWS + " AND type = 'fact' AND len(list_filter(tags, lambda x: lower(x) = 'ops')) > 0", 10, "sort"))
def hybrid_search_tagged(t: Tables) -> DataFrame:
    """Search within a type and a tag; the reranker alone orders its pool."""
    return _found(t, views.matching(_current(t), kind="fact", tag="Ops"), 10, "sort").select("query", "id", "rank", "score")


@plan.add(_search_sql(f"status IN ('active', 'superseded', 'archived') AND valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')", 5))
def hybrid_search_as_of(t: Tables) -> DataFrame:
    """Search of what was true at a moment."""
    return _found(t, views.as_of(t.memories, AS_OF)).select("query", "id", "rank", "score")


@plan.add(_search_sql("status IN ('active', 'superseded', 'archived')", 20, "off").replace(_FIRST, ""))
def hybrid_search_history(t: Tables) -> DataFrame:
    """Search of all that was ever true, in fused order without a reranker; all terms of a query give the weight of the text channel."""
    return _found(t, views.history(t.memories), 20, "off", most=None).select("query", "id", "rank", "score")


@plan.add(_ALL + f""", {_RR}, {_WHOLE} SELECT wh.query, wh.id, wh.rank, r_vector, r_text, r_graph, fused, prior, rerank, CASE WHEN r_vector IS NOT NULL THEN 1.0 END AS w_vector,
CASE WHEN r_text IS NOT NULL THEN w_text END AS w_text, CASE WHEN r_graph IS NOT NULL THEN 0.7 END AS w_graph FROM wh JOIN od USING (query, id) LEFT JOIN aw USING (query) WHERE wh.rank <= 10""")
def search_explain(t: Tables) -> DataFrame:
    """Hits with their rank and weight in each channel that gave them, the fused score, the prior and the reranker's score."""
    w = search.adaptive_weight(_terms(t), _has(_words(t)), t.memories.count())
    hits = _found(t, _current(t), 10).join(w, "query", "left")
    weight = lambda c, v: F.when(F.col(f"r_{c}").isNotNull(), v).alias(f"w_{c}")
    return hits.select("query", "id", "rank", "r_vector", "r_text", "r_graph", "fused", "prior", "rerank", weight("vector", F.lit(1.0)), weight("text", F.col("w_text")), weight("graph", F.lit(W_GRAPH)))


@plan.add(_ALL + f""", {_RR}, {_WHOLE}, tc AS (SELECT id, count(*) AS hits FROM wh WHERE rank <= 5 GROUP BY id)
SELECT id, access_count + coalesce(hits, 0) AS access_count, CASE WHEN hits > 0 THEN TIMESTAMP '{NOW}' ELSE last_accessed END AS last_accessed FROM memories LEFT JOIN tc USING (id)""")
def search_touch(t: Tables) -> DataFrame:
    """Memories after a batch of searches has counted its hits."""
    return search.touched(t.memories, _found(t, _current(t)), NOW)


@plan.add(_ALL + f""", {_RR}, {_WHOLE}, rg AS (SELECT wh.query, wh.id, wh.rank, m.content AS c, m.domain, m.observed_at FROM wh JOIN memories m ON m.id = wh.id JOIN memories q ON q.id = wh.query
 WHERE wh.rank <= 6 AND score >= 0.2 AND NOT (m.importance >= 0.7 AND (m.relation IS NOT NULL OR m.domain = 'identity')) AND len(regexp_extract_all(q.content, '\\S+')) >= 3)
SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS pos,
 '- ' || CASE WHEN length(c) <= 500 THEN c ELSE regexp_replace(substr(c, 1, 500), ' [^ ]*$', '') || ' …' END || ' (' || domain || ', ' || strftime(observed_at, '%Y-%m-%d') || ')' AS line FROM rg QUALIFY pos <= 3""")
def recall_gate(t: Tables) -> DataFrame:
    """At most three lines for each prompt of three words or more: hits of sufficient score that the profile doesn't show anyway.

    0.2 is the least score of the stand-in reranker; prompts are read whole.
    """
    long_enough = _queries(t).where(F.size(F.regexp_extract_all("content", F.lit(r"\S+"), F.lit(0))) >= 3).select(F.col("id").alias("query"))
    return search.recalled(_found(t, _current(t), 6).join(long_enough, "query", "left_semi"), t.memories, 0.2)


@plan.add(f"""WITH {_CUR}, q AS MATERIALIZED (SELECT id AS query, embedding::DOUBLE[] AS v, list_distinct({SQL_TOKENS.format('content')}) AS t FROM memories WHERE id % 100 = 0 AND relation IS NULL AND {_USABLE}),
r AS MATERIALIZED (SELECT id, embedding::DOUBLE[] AS v, {SQL_TOKENS.format('content')} AS t FROM memories WHERE status = 'active' AND {_USABLE}),
s AS (SELECT query, id, round(list_cosine_similarity(q.v, r.v), 6) AS similarity, round(len(list_intersect(q.t, r.t)) / greatest(1, len(q.t)), 6) AS p FROM q JOIN r ON query <> id),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS k FROM s WHERE similarity >= 0.5 QUALIFY k <= 5)
SELECT query, arg_max(id, (p, -k)) AS id, max(p) AS p, max(p) >= 0.8 AS pending FROM n GROUP BY query""")
def conflict_gate(t: Tables) -> DataFrame:
    """For each new note the nearest active memory that most likely contradicts it, by a stand-in score; the first wins ties."""
    notes = t.memories.where("id % 100 = 0 AND relation IS NULL").select("id", F.col("embedding").alias("v"))
    live = t.memories.where("status = 'active'").select("id", F.col("embedding").alias("v"))
    near = search.vector_topk(notes, live, DIM, 5, least=0.5)
    words = t.memories.select("id", query_tokens(F.col("content")).alias("w"))
    both = near.join(words.toDF("query", "q"), "query").join(words, "id").withColumn("p", search.token_overlap(F.col("q"), F.col("w")))
    return both.groupBy("query").agg(F.max_by("id", F.struct("p", -F.col("rank"))).alias("id"), F.max("p").alias("p")).withColumn("pending", F.col("p") >= 0.8)


# quality of answers: a seeded set of statements and questions through the write path and the search


class _Set:
    """The tables that a search needs, of a set of statements, and its questions."""

    def __init__(self, spark: SparkSession, said: list[tuple], asked: list[tuple], keyed: bool) -> None:
        self.memories, self.entities = evaluate.loaded(spark, said, keyed)
        self.links = spark.createDataFrame([], "src long, dst long, weight double")
        self.questions = cut(spark.createDataFrame(asked, evaluate.QUESTIONS))
        self.asked = cut(self.questions.select("id", "content", models.embedded(evaluate.bag_of_words)(F.col("content")).alias("v")))


@plan.add()
def eval_quality(t: Tables) -> DataFrame:
    """Shares of right, stale and missing answers by system: vectors alone, hybrid search over notes and over the ledger, and ablations.

    The embedding and the reranker are stand-ins, so the figures tell about the ledger and the fusion, not about models.
    """
    said, asked = evaluate.dataset()
    notes, facts = (_Set(t.spark, said, asked, keyed) for keyed in (False, True))
    systems = [
        ("vectors alone, notes", notes, _vector(notes, _current(notes))), ("hybrid, notes", notes, _found(notes, _current(notes))), ("hybrid, ledger", facts, _found(facts, _current(facts))),
        ("ledger, reranker alone orders", facts, _found(facts, _current(facts), rerank="sort")), ("ledger, no reranker", facts, _found(facts, _current(facts), rerank="off")),
        ("ledger, graph without weight", facts, _found(facts, _current(facts), w_graph=0.0)), ("ledger, fixed weights", facts, _found(facts, _current(facts), adaptive=False))]
    rows = [evaluate.scored(hits.select("query", "id", "rank"), s.questions, s.memories).select(F.lit(name).alias("system"), "*") for name, s, hits in systems]
    return reduce(DataFrame.unionAll, rows)


# graph views


@plan.add("SELECT subject_id, relation, id, object_text FROM memories WHERE status = 'active' AND subject_id IS NOT NULL AND relation IS NOT NULL")
def entity_facts(t: Tables) -> DataFrame:
    return t.memories.where("status = 'active' AND subject_id IS NOT NULL AND relation IS NOT NULL").select("subject_id", "relation", "id", "object_text")


@plan.add("SELECT m.object_entity_id AS entity_id, m.id, e.name AS subject, m.relation FROM memories m JOIN entities e ON e.id = m.subject_id WHERE m.status = 'active' AND m.object_entity_id IS NOT NULL")
def entity_mentions(t: Tables) -> DataFrame:
    names = t.entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    return t.memories.where("status = 'active' AND object_entity_id IS NOT NULL").join(names, "subject_id").select(F.col("object_entity_id").alias("entity_id"), "id", "subject", "relation")


@plan.add("""WITH f AS (SELECT subject_id AS a, object_entity_id AS b FROM memories WHERE status = 'active' AND subject_id IS NOT NULL AND object_entity_id IS NOT NULL),
e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM f UNION ALL SELECT b, a FROM f) WHERE a <> b), h1 AS (SELECT a AS start, b AS id, 1 AS hops FROM e),
h2 AS (SELECT DISTINCT start, b AS id, 2 AS hops FROM h1 JOIN e ON e.a = h1.id), h3 AS (SELECT DISTINCT start, b AS id, 3 AS hops FROM h2 JOIN e ON e.a = h2.id)
SELECT start, id, min(hops) AS hops FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE start <> id GROUP BY ALL""")
def entity_neighbors(t: Tables) -> DataFrame:
    return graph.neighbors(t.memories, t.entities.select("id"), depth=3)


@plan.add("""WITH f AS (SELECT * FROM memories WHERE status = 'active' AND domain = 'projects' AND subject_id IS NOT NULL)
SELECT 'fact' AS kind, id, subject_id AS other FROM f UNION ALL SELECT 'entity', x, NULL FROM (SELECT subject_id AS x FROM f UNION SELECT object_entity_id FROM f) WHERE x IS NOT NULL
UNION ALL SELECT 'note', id, NULL FROM memories WHERE status = 'active' AND domain = 'projects' AND subject_id IS NULL
UNION ALL SELECT 'link', src, dst FROM links WHERE src IN (SELECT id FROM memories WHERE status = 'active') AND dst IN (SELECT id FROM memories WHERE status = 'active')""")
def graph_snapshot(t: Tables) -> DataFrame:
    return graph.snapshot(t.memories, t.links, domain="projects")
