"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.llm.contamination import leaked_passages
from mnemora.llm.mixture import mix_to_targets, plain_source, token_count
from mnemora.llm.near_duplicates import near_duplicate_classes, similar_texts
from mnemora.llm.names import link_names
from mnemora.llm.neighbours import nearest
from mnemora.llm.percentiles import digit_histogram, histogram_percentiles, merge_histograms, percentiles
from mnemora.llm.pii import find_pii, redact
from mnemora.operators.search import vector_topk
from mnemora.plans.general import agent_key
from mnemora.sources import cut, read_table

#: Lowest percentile that is a case of p4, in milliseconds.
SLOW_MS = {50: 800, 95: 5000, 99: 20000}


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with an agent and a latency of 0 or more, each id once."""
    log = read_table(spark, sf_dir, "usage_log").where((F.col("op") == "tool_call") & (F.col("latency_ms") >= 0))
    kept = log.select("id", agent_key().alias("agent"), "tool", "latency_ms", F.to_date("ts").alias("day")).where("agent IS NOT NULL AND tool IS NOT NULL")
    return kept.groupBy("id").agg(F.min(F.struct("agent", "tool", "latency_ms", "day")).alias("r")).select("r.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = percentiles(_calls(spark, sf_dir), {"agent": F.col("agent"), "tool": F.col("tool")}, F.col("latency_ms"), list(SLOW_MS), at_least=20)
    least = F.create_map(*[F.lit(x) for p, ms in SLOW_MS.items() for x in (float(p), float(ms))])
    return out.where(F.col("value") >= least[F.col("pct")]).select("agent", "tool", F.col("pct").cast("int").alias("pct"))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentiles of every agent and tool."""
    out = percentiles(_calls(spark, sf_dir), {"agent": F.col("agent"), "tool": F.col("tool")}, F.col("latency_ms"), [50, 90, 95, 99])
    return out.withColumn("pct", F.col("pct").cast("int")).withColumn("value", F.col("value").cast("double"))


def p4_daily_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the percentiles per agent and tool from histograms made day by day and then combined."""
    days = digit_histogram(_calls(spark, sf_dir), {"day": F.col("day"), "agent": F.col("agent"), "tool": F.col("tool")}, F.col("latency_ms"))
    out = histogram_percentiles(merge_histograms(days, ["agent", "tool"]), ["agent", "tool"], [50, 95, 99])
    # a whole number lies in the interval of 24 leading bits whose ends are a share of 2**-12 apart
    return out.select("agent", "tool", F.col("pct").cast("int").alias("pct"), F.ceil("low").alias("low"), F.floor("high").alias("high"), "n")


QUERIES = {"p4_found": p4_found, "p4_percentiles": p4_percentiles, "p4_daily_merged": p4_daily_merged}

_CALLS = """
WITH c AS (SELECT DISTINCT id, lower(trim(agent)) AS agent, tool, latency_ms FROM usage_log
           WHERE op = 'tool_call' AND agent IS NOT NULL AND trim(agent) <> '' AND tool IS NOT NULL AND latency_ms >= 0),
r AS (SELECT agent, tool, latency_ms, row_number() OVER (PARTITION BY agent, tool ORDER BY latency_ms) AS k,
             count(*) OVER (PARTITION BY agent, tool) AS n FROM c),
q AS (SELECT agent, tool, pct, n, min(latency_ms) AS v FROM r, (SELECT unnest([50, 90, 95, 99]) AS pct)
      WHERE k * 100 >= pct * n GROUP BY ALL)"""
SQL = {
    "p4_found": _CALLS + """
SELECT agent, tool, pct FROM q WHERE n >= 20 AND (pct = 50 AND v >= 800 OR pct = 95 AND v >= 5000 OR pct = 99 AND v >= 20000)""",
    "p4_percentiles": _CALLS + " SELECT agent, tool, pct, CAST(v AS DOUBLE) AS value, n FROM q",
    # 24 leading bits of a double are 12 of exponent and sign and 12 of its mantissa
    "p4_daily_merged": _CALLS + """, s AS (SELECT *, CASE WHEN v = 0 THEN 1.0 ELSE pow(2, floor(log2(v) + 1e-12) - 12) END AS step FROM q WHERE pct <> 90)
SELECT agent, tool, pct, CAST(ceil(floor(v / step) * step) AS BIGINT) AS low, CAST(ceil((floor(v / step) + 1) * step) - 1 AS BIGINT) AS high, n FROM s""",
}


# 1: most similar vectors

DIM = 384


def _nearest(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, table), F.col("id"), F.col("embedding"), DIM, k=5, least=0.70)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [
        _nearest(spark, sf_dir, name).select(F.lit(name).alias("collection"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
        for name in ("memories", "entities")
    ]
    return out[0].unionAll(out[1]).distinct()


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every hundredth row, the number of its exact nearest rows, and whether the index finds nine in ten of them at least."""
    out = []
    for name in ("memories", "entities"):
        rows = read_table(spark, sf_dir, name).select("id", F.col("embedding").alias("v"))
        exact = vector_topk(rows.where("id % 100 = 0"), rows, DIM, 5, least=0.70).select(F.col("query").alias("id"), F.col("id").alias("neighbour"))
        found = _nearest(spark, sf_dir, name).select("id", "neighbour", F.lit(1).alias("hit"))
        both = exact.join(found, ["id", "neighbour"], "left")
        out.append(both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).select(F.lit(name).alias("collection"), "n", (F.col("hits") >= 0.9 * F.col("n")).alias("enough")))
    return out[0].unionAll(out[1])


QUERIES |= {"p1_found": p1_found, "p1_recall": p1_recall}

_EXACT = """(WITH v AS (SELECT id, embedding::DOUBLE[] AS v FROM {t} WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS c, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) AS k FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT '{t}' AS collection, count(*) AS n, true AS enough FROM s WHERE k <= 5 AND c >= 0.70)"""
SQL["p1_recall"] = _EXACT.format(t="memories") + " UNION ALL " + _EXACT.format(t="entities")


# 5: near-duplicate notes


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that are not deleted."""
    notes = read_table(spark, sf_dir, "memories").where("relation IS NULL AND status <> 'deleted'")
    return notes.select("id", "content", "raw_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    sides = notes.select(F.explode(F.array(
        F.struct(F.struct("id", F.lit("content").alias("field")).alias("row"), F.col("content").alias("text")),
        F.struct(F.struct("id", F.lit("raw_text").alias("field")).alias("row"), F.col("raw_text").alias("text")))).alias("e")).select("e.row", "e.text")
    links, members = similar_texts(sides, F.col("row"), F.col("text"), length=2, threshold=0.5)
    m = cut(members.where("shingles > 0").select(F.col("id.id").alias("memory"), F.col("id.field").alias("field"), "text_id"))
    left, right = m.select(F.col("memory").alias("x"), "field", F.col("text_id").alias("a")), m.select(F.col("memory").alias("y"), "field", F.col("text_id").alias("b"))
    linked = links.select("a", "b").join(left, "a").join(right, ["b", "field"])
    same = left.join(right.withColumnRenamed("b", "a"), ["a", "field"]).where("x < y")
    pairs = linked.where("x <> y").select("x", "y").unionAll(same.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("memory_a"), F.greatest("x", "y").alias("memory_b")).distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every note by its content, with five-word shingles at 0.8."""
    return near_duplicate_classes(_notes(spark, sf_dir), F.col("id"), F.col("content")).select(F.col("id").alias("memory_id"), "class_id")


QUERIES |= {"p5_found": p5_found, "p5_classes": p5_classes}

SQL["p5_found"] = """
WITH t AS (SELECT id, 'c' AS f, content AS t FROM memories WHERE relation IS NULL AND status <> 'deleted'
           UNION ALL SELECT id, 'r', raw_text FROM memories WHERE relation IS NULL AND status <> 'deleted'),
w AS (SELECT id, f, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM t WHERE t IS NOT NULL),
s AS (SELECT DISTINCT id, f, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w),
n AS (SELECT id, f, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.id AS a, b.id AS b, a.f, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.f = b.f AND a.id < b.id GROUP BY ALL)
SELECT DISTINCT a AS memory_a, b AS memory_b FROM p JOIN n x ON x.id = a AND x.f = p.f JOIN n y ON y.id = b AND y.f = p.f
WHERE c >= 0.5 * (x.n + y.n - c)"""


SQL["p5_classes"] = """
WITH RECURSIVE m AS (SELECT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM memories WHERE relation IS NULL AND status <> 'deleted' AND content IS NOT NULL),
t AS (SELECT min(id) AS x, w FROM m GROUP BY w),
s AS MATERIALIZED (SELECT DISTINCT x, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM t),
n AS (SELECT x, count(*) AS n FROM s GROUP BY x),
p AS (SELECT a.x AS a, b.x AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.x <> b.x GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n i ON i.x = a JOIN n j ON j.x = b WHERE c >= 0.8 * (i.n + j.n - c)),
r AS (SELECT x, x AS y FROM t UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
k AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT m.id AS memory_id, class_id FROM m JOIN t USING (w) JOIN k USING (x)"""


# 7: evaluation passages in the corpus


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")
    return leaked_passages(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"), window=12, max_edits=1)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("edits = 0").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document and item with a passage word for word: the number of places, and the first one's word."""
    return _leaks(spark, sf_dir).where("edits = 0").groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.countDistinct("doc_pos").alias("n_places"), F.min("doc_pos").alias("first_word"))


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items whose passages all have a word inserted, lost or changed, and where the first begins."""
    found = _leaks(spark, sf_dir).groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.min("edits").alias("edits"), F.min("doc_pos").alias("first_word"))
    return found.where("edits > 0").drop("edits")


QUERIES |= {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_edited": p7_edited}

_PASSAGES = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS p FROM i)"""
SQL["p7_found"] = _PASSAGES + " SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (p)"
SQL["p7_leaks"] = _PASSAGES + " SELECT doc_id, item_id, count(DISTINCT k) AS n_places, CAST(min(k) - 1 AS INTEGER) AS first_word FROM dw JOIN iw USING (p) GROUP BY ALL"


# 8: mixing sources to target weights


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers

    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in read_table(spark, sf_dir, "mix_targets").collect()]
    tokens = token_count(spark, F.col("text"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return mix_to_targets(read_table(spark, sf_dir, "documents"), F.col("doc_id"), plain_source(F.col("source")), tokens, targets)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and the copies each is used in."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares by source."""
    return _mix(spark, sf_dir)[1]


def p8_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with sizes in words: what each source has, and whether its size is short of its share of the largest possible total by less than a document."""
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in read_table(spark, sf_dir, "mix_targets").collect()]
    docs = read_table(spark, sf_dir, "documents").select("doc_id", plain_source(F.col("source")).alias("source"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    report = mix_to_targets(docs, F.col("doc_id"), F.col("source"), F.col("n"), targets)[1]
    total = F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_copies") / F.col("target_share"))).over(Window.partitionBy(F.lit(0)))
    budget = F.when(F.col("available") > 0, F.col("target_share") * total).otherwise(0.0)
    largest = docs.groupBy("source").agg(F.max("n").alias("largest"))
    out = report.withColumn("budget", budget).join(largest, "source", "left")
    return out.select("source", "target_share", "max_copies", "available", ((F.col("size") <= F.col("budget") + 1) & (F.col("size") >= F.col("budget") - 1 - F.coalesce("largest", F.lit(0)))).alias("reached"))


QUERIES |= {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_words": p8_words}

SQL["p8_words"] = """
WITH d AS (SELECT nullif(regexp_replace(regexp_replace(lower(source), '[\\s_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS source, len(regexp_extract_all(text, '\\S+')) AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS n FROM d WHERE n > 0 GROUP BY source)
SELECT t.source, target_share, CAST(max_repeats AS INTEGER) AS max_copies, coalesce(n, 0) AS available, true AS reached FROM mix_targets t LEFT JOIN s USING (source)"""


# 6: variant spellings of names


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of persons and organisations: all but those whose kind says that they are something else."""
    kind = F.lower(F.trim(F.col("kind")))
    return read_table(spark, sf_dir, "entities").where(~F.coalesce(kind.isin("host", "service", "tool", "project"), F.lit(False)))


def _same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names(_entities(spark, sf_dir), F.col("id"), F.col("name"), F.col("aliases"), F.col("kind"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(_same_names(spark, sf_dir))
    a, b = c.withColumnRenamed("id", "entity_a"), c.withColumnRenamed("id", "entity_b")
    return a.join(b, "class_id").where("entity_a < entity_b").select("entity_a", "entity_b")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every row that may name a person or an organisation."""
    return _same_names(spark, sf_dir).withColumnRenamed("id", "entity_id")


QUERIES |= {"p6_found": p6_found, "p6_classes": p6_classes}


# 9: personal information


def _members(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The members of the house, a table of fixed size: their mention is no personal information."""
    return [(r["given_name"], r["surname"]) for r in read_table(spark, sf_dir, "members").select("given_name", "surname").collect()]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), _members(spark, sf_dir))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return redact(read_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), _members(spark, sf_dir))


QUERIES |= {"p9_found": p9_found, "p9_redacted": p9_redacted}
