"""Quality of answers about facts that change."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import norm_name
from mnemora.operators import models, writing
from mnemora.operators.entities import backfill, resolve_exact
from mnemora.operators.ledger import KEY
from mnemora.sources import cut

STATEMENTS = "seq long, domain string, subject string, relation string, object string, content string, at timestamp_ntz"
QUESTIONS = "id long, kind string, content string, latest string, olds array<string>, expected string"
#: What changes about a person: relation, sentence, question, values (invented).
_CHANGES = (
    ("home_town", "{s} now lives in {v}.", "Where does {s} live?", "Arvik Belmora Corvane Dunleith Estrova Fenmarch Galdria Hoskirk"),
    ("tea", "{s} drinks {v} tea these days.", "Which tea does {s} drink?", "sencha oolong rooibos assam jasmine lapsang matcha darjeeling"),
    ("instrument", "The instrument {s} plays is the {v}.", "What instrument does {s} play?", "cello oboe lute tuba viola zither bassoon marimba"),
    ("port", "The test server of {s} listens on port {v}.", "Which port does the test server of {s} use?", "7101 7202 7303 7404 7505 7606 7707 7808"),
    ("shift", "{s} works the {v} shift.", "Which shift does {s} work?", "dawn morning noon evening night weekend holiday standby"))
_PEOPLE = "Aldren Brisa Corin Dalia Edric Fenna Goran Hilde Ivo Juna Kelm Lotte Marn Nessa Orla Pavo Quill Runa".split()
_STEADY = (("The archive of {p} is kept on shelf {n}.", "On which shelf is the archive of {p}?"), ("{p} is written in dialect {n} of Forth.", "Which dialect is {p} written in?"), ("The logo of {p} shows {n} herons.", "How many herons are on the logo of {p}?"), ("Releases of {p} happen every {n} weeks.", "How often is {p} released?"))
_PROJECTS = "alder birch cedar damson elder fir gorse hazel ilex juniper".split()


def dataset(seed: int = 11, keys: int = 60) -> tuple[list[tuple], list[tuple]]:
    """Statements in order of time and questions about them: facts that change, facts that don't, and facts two steps away."""
    r = random.Random(seed)
    said, asked = [], []
    start = datetime(2025, 1, 1)
    pool = [(p, c) for p in _PEOPLE for c in _CHANGES]
    for person, (relation, text, question, values) in r.sample(pool, min(keys, len(pool))):
        chosen = r.sample(values.split(), r.randint(2, 4))
        at = start + timedelta(days=r.randint(0, 60))
        for v in chosen:
            said.append(("identity", person, relation, v, text.format(s=person, v=v), at))
            at += timedelta(days=r.randint(20, 120))
        asked.append(("changing", question.format(s=person), chosen[-1], chosen[:-1], None))
    late = start + timedelta(days=600)
    for n, p in enumerate(_PROJECTS):
        for text, question in _STEADY:
            said.append(("projects", None, None, None, text.format(p=p, n=n + 2), late))
            asked.append(("steady", question.format(p=p), None, [], text.format(p=p, n=n + 2)))
    for n in range(10):
        a, b, c = f"job-{chr(97 + n)}ra", f"queue-{chr(97 + n)}mo", f"rack-{chr(97 + n)}tu"
        end = f"{b} is held on {c}."
        said += [("projects", a, "reads_from", b, f"{a} reads from {b}.", late), ("projects", b, "held_on", c, end, late)]
        asked.append(("two steps", f"What is the queue of {a} held on?", None, [], end))
    said.sort(key=lambda x: x[-1])
    return [(i + 1, *s) for i, s in enumerate(said)], [(1_000_000 + i, *q) for i, q in enumerate(asked)]


def bag_of_words(texts: list[str]) -> list[list[float]]:
    """A stand-in for a text embedding: every word sets four of 384 places, by its hash."""
    out = []
    for t in texts:
        v = [0.0] * 384
        for w in "".join(c.lower() if c.isalnum() else " " for c in t).split():
            for k in range(4):
                h = crc32(f"{k}{w}".encode())
                v[h % 384] += 1.0 if h & 1024 else -1.0
        out.append(v if any(v) else [1.0] * 384)
    return out


def loaded(spark: SparkSession, said: list[tuple], keyed: bool) -> tuple[DataFrame, DataFrame]:
    """The memories and entities that the write path makes of the statements, as keyed facts or as plain notes."""
    s = spark.createDataFrame(said, STATEMENTS)
    subjects = s.where("subject IS NOT NULL").select(F.col("subject").alias("mention"), "seq")
    none = spark.createDataFrame([], "id long, name string, norm string, aliases array<string>")
    entities = writing.create_entities(subjects if keyed else subjects.limit(0), none).withColumn("aliases", F.array().cast("array<string>"))
    who = resolve_exact(subjects.select("mention").distinct(), entities).toDF("subject", "subject_id")
    m = s.join(who, "subject", "left").select(
        F.col("seq").alias("id"), "domain", F.lit("fact").alias("type"), "subject_id", F.when(F.col("subject_id").isNotNull(), F.col("relation")).alias("relation"), F.col("object").alias("object_text"),
        "content", F.array().cast("array<string>").alias("tags"), F.lit(0.5).alias("importance"), F.col("at").alias("observed_at"), F.col("at").alias("valid_from"), F.lit(0).alias("access_count"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"), models.embedded(bag_of_words)(F.col("content")).alias("embedding"), F.lit(None).cast("long").alias("object_entity_id"))
    m = m.join(backfill(m, entities).withColumnRenamed("object_entity_id", "to"), "id").withColumn("object_entity_id", F.col("to")).drop("to")
    batch = m.where("subject_id IS NOT NULL").select(*KEY, F.col("id").alias("seq"), norm_name(F.col("object_text")).alias("value"), F.unix_micros(F.col("valid_from").cast("timestamp")).alias("obs"))
    empty = spark.createDataFrame([], "id long, domain string, subject_id long, relation string, status string, value string, valid_from long, valid_to long, superseded_by long")
    told = writing.store(batch, empty).select(F.col("seq").alias("id"), "outcome", "status", F.timestamp_micros("valid_to").cast("timestamp_ntz").alias("valid_to"))
    return cut(m.join(told, "id", "left").where("outcome IS NULL OR outcome <> 'restate'").withColumn("status", F.coalesce("status", F.lit("active"))).drop("outcome")), cut(entities)


def scored(hits: DataFrame, questions: DataFrame, memories: DataFrame) -> DataFrame:
    """One row of shares over the questions, from hits (query, id, rank): of the changing ones whether the first hit tells the latest value,
    an older one or neither, of the others whether the expected text is among the first five."""
    text = hits.where("rank <= 5").join(memories.select("id", "content"), "id").select(F.col("query").alias("id"), "rank", F.col("content").alias("hit"))
    q = questions.select("id", "kind", "latest", "olds", "expected")
    by = q.join(text, "id", "left").groupBy(*q.columns).agg(F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("top"), F.coalesce(F.max(F.col("hit") == F.col("expected")), F.lit(False)).alias("found"))
    now = F.coalesce(F.contains("top", "latest"), F.lit(False))
    old = ~now & F.coalesce(F.exists("olds", lambda o: F.contains(F.col("top"), o)), F.lit(False))
    share = lambda kind, c: F.round(F.avg(F.when(F.col("kind") == kind, c.cast("double"))), 4)
    return by.agg(
        share("changing", now).alias("current_at_1"), share("changing", old).alias("stale_at_1"), share("changing", ~now & ~old).alias("miss_at_1"),
        share("steady", F.col("found")).alias("steady_recall_at_5"), share("two steps", F.col("found")).alias("two_step_recall_at_5"))


def answer_metrics(facts: DataFrame) -> DataFrame:
    """Shares of keys whose active value is the latest observed one (current), an older one (stale), or missing.

    Keys are those with at least one value; ties in time go to the later row. Aggregates only, without lists.
    """
    known = facts.where("relation IS NOT NULL AND object_text IS NOT NULL")
    by_key = known.groupBy(*KEY).agg(
        F.max_by("object_text", F.struct("observed_at", "id")).alias("latest"), F.max_by("object_text", F.when(F.col("status") == "active", F.col("id"))).alias("answer"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return by_key.agg(
        F.count("*").alias("n"), share(F.col("answer") == F.col("latest")).alias("current_at_1"), share(F.col("answer") != F.col("latest")).alias("stale_at_1"), share(F.col("answer").isNull()).alias("miss_at_1"))
