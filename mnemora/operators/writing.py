"""The write path for batches: whom a statement speaks of, which fact it replaces, what it contradicts, and what is stored.

A judge's answers come as tables, so that any model, or none, may give them; without an answer the path is deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.functions.text import norm_name
from mnemora.operators.entities import resolve_exact
from mnemora.operators.ledger import KEY
from mnemora.operators.search import ranked
from mnemora.sources import cut

FORMS = ("ongoing", "completed", "habitual", "unknown")


def plan_entities(mentions: DataFrame, entities: DataFrame, near: DataFrame, picks: DataFrame, link: float = 0.8, least: float = 0.55, most: int = 5) -> DataFrame:
    """The entity of each mention, and how it was found: mention, entity_id, how (exact, judge, new; null id for new).

    ``near`` (mention, entity_id, similarity) are entities near by vector, of which the ``most`` best from ``least`` on
    are candidates; ``picks`` (mention, entity_id, p) what a judge picked among them, accepted from ``link`` on. A
    mention without exact entity and accepted pick is new. Repeated mentions count once; null and blank ones are new.
    """
    exact = resolve_exact(mentions.select("mention").distinct(), entities)
    shown = ranked(near.where(F.col("similarity") >= least), "mention", [F.desc("similarity"), F.col("entity_id")], most).select("mention", "entity_id")
    p = picks.where(F.col("p") >= link).join(shown, ["mention", "entity_id"], "left_semi").groupBy("mention").agg(F.max_by("entity_id", F.struct("p", F.negative("entity_id"))).alias("picked"))
    out = exact.join(p, "mention", "left")
    how = F.when(F.col("entity_id").isNotNull(), "exact").when(F.col("picked").isNotNull(), "judge").otherwise("new")
    return out.select("mention", F.coalesce("entity_id", "picked").alias("entity_id"), how.alias("how"))


def numbered(rows: DataFrame, order: list[str], name: str, start: int) -> DataFrame:
    """Rows with running numbers from ``start`` in the given order.

    Rows are range-sorted; the driver sees one count a partition, no rows.
    """
    parts = cut(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, at = {}, start
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(start))
    line = Window.partitionBy("__part").orderBy(*order)
    return parts.withColumn(name, (offsets[F.col("__part")] + F.row_number().over(line) - 1).cast("long")).drop("__part")


def create_entities(new: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (id, name, norm) of the entities that new mentions (mention, seq) make, numbered on from the largest id.

    One for each normalised name that no entity has, named as first mentioned; blank mentions make none.
    """
    n = new.select(F.trim("mention").alias("name"), "seq", norm_name(F.col("mention")).alias("norm")).where("norm <> ''")
    first = n.groupBy("norm").agg(F.min(F.struct("seq", "name")).alias("f")).select("norm", F.col("f.seq").alias("seq"), F.col("f.name").alias("name"))
    open_ = first.join(entities.select("norm"), "norm", "left_anti")
    top = entities.agg(F.max("id")).first()[0] or 0
    return numbered(open_, ["seq", "norm"], "id", top + 1).select("id", "name", "norm")


def map_keys(said: DataFrame, facts: DataFrame, picks: DataFrame, auto: float = 0.8, review: float = 0.5, latest: int = 12) -> DataFrame:
    """Which active fact each keyed statement replaces: seq, target, confidence, band, relation.

    ``said`` has seq, domain, subject_id, relation; ``facts`` the active keyed rows. A fact of the same key is the target
    (band exact). Else the subject's ``latest`` facts of the domain were shown to a judge, whose pick (seq, fact_id, p)
    counts among those only: from ``auto`` on it is the target and the statement takes its relation (auto), from
    ``review`` on it is the target of a review (review), otherwise there is none (new).
    """
    f = facts.where("relation IS NOT NULL AND subject_id IS NOT NULL").select("id", *KEY, "valid_from")
    same = f.groupBy(*KEY).agg(F.max("id").alias("same"))
    s = said.select("seq", *KEY).join(same, KEY, "left")
    line = Window.partitionBy("domain", "subject_id").orderBy(F.desc("valid_from"), F.desc("id"))
    shown = f.withColumn("k", F.row_number().over(line)).where(F.col("k") <= latest).select(F.col("id").alias("fact_id"), "domain", "subject_id", F.col("relation").alias("adopted"))
    best = picks.where(F.col("p") >= review).groupBy("seq").agg(F.max_by("fact_id", F.struct("p", F.negative("fact_id"))).alias("fact_id"), F.max("p").alias("p"))
    out = s.join(best, "seq", "left").join(shown, ["fact_id", "domain", "subject_id"], "left")
    band = F.when(F.col("same").isNotNull(), "exact").when(F.col("adopted").isNull(), "new").when(F.col("p") >= auto, "auto").otherwise("review")
    b = out.withColumn("band", band)
    return b.select(
        "seq", F.when(F.col("band") == "exact", F.col("same")).when(F.col("band") != "new", F.col("fact_id")).alias("target"),
        F.when(F.col("band") == "exact", 1.0).when(F.col("band") != "new", F.col("p")).alias("confidence"), "band", F.when(F.col("band") == "auto", F.col("adopted")).otherwise(F.col("relation")).alias("relation"))


def conflicts(near: DataFrame, probabilities: DataFrame, least: float = 0.5, most: int = 5, threshold: float = 0.8) -> DataFrame:
    """The memory that each new note most likely makes out of date: note, id, p.

    ``near`` (note, id, similarity) are active memories near by vector, of which the ``most`` best from ``least`` on are
    held against the note; ``probabilities`` (note, id, p) are a judge's. The best p counts from ``threshold`` on, the
    nearer memory where several have it. Pairs without an answer count for nothing.
    """
    shown = ranked(near.where(F.col("similarity") >= least), "note", [F.desc("similarity"), F.col("id")], most)
    best = shown.join(probabilities, ["note", "id"]).where("p IS NOT NULL").groupBy("note").agg(F.max_by("id", F.struct("p", F.negative("rank"))).alias("id"), F.max("p").alias("p"))
    return best.where(F.col("p") >= threshold)


def temporal_form(given: Column, pick: Column, p: Column, least: float = 0.5) -> Column:
    """The given form if it is one, else what a judge picked from ``least`` on, else unknown."""
    asked = F.coalesce((p >= least) & pick.isin(*FORMS), F.lit(False))
    return F.when(given.isin(*FORMS), given).when(asked, pick).otherwise("unknown")


def _decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, value, since = None, None, None
    for f in frames:
        out = []
        for k, v, o, was in zip(f["key"], f["value"], f["obs"], f["was"]):
            if k != key:
                key, value, since = k, None, None
            if was is not None:
                if was == "active":
                    value, since = v, o
                out.append("given")
            elif since is None:
                value, since = v, o
                out.append("first")
            elif v == value:
                out.append("restate")
            elif o < since:
                out.append("late")
            else:
                value, since = v, o
                out.append("supersede")
        yield f[["key", "seq", "obs", "was", "was_to", "was_by"]].assign(outcome=out)


def store(said: DataFrame, memories: DataFrame) -> DataFrame:
    """What a batch of keyed statements stores and changes: the key, seq, outcome, status, valid_to, superseded_by.

    ``said`` has the key, seq (arrival; beyond all ids of ``memories``), value (compared form) and obs (microseconds) of
    statements that take part; ``memories`` the table (id, key, value, status, valid_from and valid_to in microseconds,
    superseded_by). One row comes out for each statement (first, restate, late, supersede) and for each row of the table
    that it changes (given). Times are microseconds; an open end is null.

    A statement equal to the active value changes nothing. One observed before the active value began is history: it
    ends where the next later value of its key begins, and ends an earlier value within whose time it falls. Any other
    ends the active value. Only that decision is sequential (a value of state over rows sorted by key and arrival, only
    of the keys in the batch); all times follow by windows.
    """
    keys = said.select(*KEY).distinct()
    old = memories.where("status IN ('active', 'superseded')").join(keys, KEY, "left_semi")
    columns = ["key", "seq", "value", "obs", "was", "was_to", "was_by"]
    rows = said.select(*KEY, "seq", "value", "obs", *[F.lit(None).cast(t).alias(c) for c, t in (("was", "string"), ("was_to", "long"), ("was_by", "long"))]).unionByName(
        old.select(*KEY, F.col("id").alias("seq"), "value", F.col("valid_from").alias("obs"), F.col("status").alias("was"), F.col("valid_to").alias("was_to"), F.col("superseded_by").alias("was_by")))
    ordered = rows.withColumn("key", F.to_json(F.struct(*KEY))).select(*columns).repartition("key").sortWithinPartitions("key", "seq")
    told = cut(ordered.mapInPandas(_decided, "key string, seq long, obs long, was string, was_to double, was_by double, outcome string"))
    told = told.withColumn("was_to", F.when(~F.isnan("was_to"), F.col("was_to")).cast("long")).withColumn("was_by", F.when(~F.isnan("was_by"), F.col("was_by")).cast("long"))
    w = told.where("outcome <> 'restate'")
    by_time = Window.partitionBy("key").orderBy("obs").rangeBetween(1, Window.unboundedFollowing)
    late = F.col("outcome") == "late"
    leads = ~late & (F.col("was").isNull() | (F.col("was") == "active"))
    line = Window.partitionBy("key", "leads").orderBy("seq")
    w = w.withColumn("leads", leads).withColumn("any", F.min(F.struct("obs", "seq")).over(by_time)).withColumn("cut", F.min(F.when(late, F.struct("obs", "seq"))).over(by_time))
    w = w.withColumn("heir", F.when(F.col("leads"), F.lead(F.struct("obs", "seq")).over(line)))
    # the end a row has without late ones, and by whom
    end = F.when(F.col("leads"), F.col("heir")).otherwise(F.struct(F.col("was_to").alias("obs"), F.col("was_by").alias("seq")))
    end = F.when(late, F.col("any")).otherwise(end)
    cuts = F.coalesce(~late & F.col("cut.obs").isNotNull() & (F.col("end.obs") > F.col("cut.obs")), F.lit(False))
    w = w.withColumn("end", end).withColumn("end", F.when(cuts, F.col("cut")).otherwise(F.col("end")))
    active = F.col("leads") & F.col("heir").isNull()
    done = w.select(
        "key", "seq", "outcome", F.when(active, "active").otherwise("superseded").alias("status"), F.when(~active, F.col("end.obs")).alias("valid_to"), F.when(~active, F.col("end.seq")).alias("superseded_by"),
        (F.col("was").isNotNull() & (F.when(active, "active").otherwise("superseded") == F.col("was")) & F.when(~active, F.col("end.obs")).eqNullSafe(F.col("was_to"))).alias("same"))
    changed = done.where("outcome <> 'given' OR NOT same").drop("same")
    both = changed.unionByName(told.where("outcome = 'restate'").select("key", "seq", "outcome"), allowMissingColumns=True)
    return both.withColumn("k", F.from_json("key", "domain string, subject_id long, relation string")).select("k.*", "seq", "outcome", "status", "valid_to", "superseded_by")


def review_rows(mapped: DataFrame, conflicting: DataFrame) -> DataFrame:
    """Rows for the review queue (kind, memory_id, other_id, confidence): of statements in the review band and of conflicting notes."""
    unsure = mapped.where("band = 'review'").select(F.lit("supersede").alias("kind"), F.col("seq").alias("memory_id"), F.col("target").alias("other_id"), "confidence")
    return unsure.unionAll(conflicting.select(F.lit("conflict"), "note", "id", "p"))


def hidden(memories: DataFrame, conflicting: DataFrame) -> DataFrame:
    """Memories (id, status) after the old sides of conflicts, if active, have been set pending."""
    gone = conflicting.select("id").distinct().withColumn("gone", F.lit(True))
    return memories.select("id", "status").join(gone, "id", "left").select("id", F.when(F.col("gone") & (F.col("status") == "active"), "pending").otherwise(F.col("status")).alias("status"))


def referred(memories: DataFrame, refs: DataFrame) -> DataFrame:
    """The ids of the memories that references (ref) name, by uid or by external id."""
    found = [memories.join(refs.select(F.col("ref").alias(c)).where(f"{c} IS NOT NULL"), c, "left_semi").select("id") for c in ("uid", "external_id")]
    return reduce(DataFrame.unionAll, found).distinct()


def without(rows: DataFrame, refs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that no reference (ref) names by one of the columns; null references and values name nothing."""
    r = refs.select("ref").where("ref IS NOT NULL").distinct()
    for c in columns:
        rows = rows.join(r.withColumnRenamed("ref", c), c, "left_anti")
    return rows


def picked_first(hits: DataFrame, picks: DataFrame) -> DataFrame:
    """Hits (query, id, rank, ...) with a judge's pick (query, id, p) moved to the front and its p beside it; a pick that isn't among the hits changes nothing."""
    out = hits.join(picks.select("query", "id", "p"), ["query", "id"], "left")
    line = Window.partitionBy("query").orderBy(F.col("p").isNull(), "rank")
    return out.withColumn("rank", F.row_number().over(line))
