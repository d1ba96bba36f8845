"""The bi-temporal ledger: folding statements, transitions of facts, reviews and skills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.functions.text import norm_name
from mnemora.sources import cut

KEY = ["domain", "subject_id", "relation"]


def statements(memories: DataFrame) -> DataFrame:
    """Keyed rows as statements: the key, seq (arrival), value (compared form), text, obs (microseconds)."""
    text = F.coalesce("object_text", "content")
    return memories.where("subject_id IS NOT NULL AND relation IS NOT NULL AND observed_at IS NOT NULL").select(
        *KEY, F.col("id").alias("seq"), norm_name(text).alias("value"), text.alias("text"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("obs"))


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, value, since = None, None, None
    for f in frames:
        out = []
        for k, v, o in zip(f["key"], f["value"], f["obs"]):
            if k != key:
                key, value, since = k, v, o
                out.append("first")
            elif v == value:
                out.append("restate")
            elif o < since:
                out.append("late")
            else:
                value, since = v, o
                out.append("supersede")
        yield f[["key", "seq", "text", "obs"]].assign(outcome=out)


def fold(said: DataFrame) -> DataFrame:
    """Statements with their outcome, in arrival order of each key, and the intervals of those kept.

    The first value of a key is active. A value equal to the active one is a restatement and is dropped. One observed
    before the active one began goes into the history; any other supersedes it. Columns: the key, seq, text, obs,
    outcome (first, restate, late, supersede), status, valid_to and superseded_by (both null for restatements).

    Only the decision is sequential, and only for keys with a statement older than the one before it; the others are decided
    by windows. It streams over rows sorted by key and arrival with one value of state, so a key of any size needs no memory. Intervals follow from the kept rows alone: a row ends where the next later one of its
    key begins; one superseded at its own beginning is empty. Equal values are compared in normalised form.
    """
    keyed = said.withColumn("key", F.to_json(F.struct(*KEY)))
    arrival = Window.partitionBy("key").orderBy("seq")
    seen = keyed.select("key", "seq", "value", "text", "obs", F.lag("value").over(arrival).alias("before"), F.lag("obs").over(arrival).alias("since"), F.row_number().over(arrival).alias("n"))
    seen = cut(seen.withColumn("late", F.max(F.coalesce(F.col("obs") < F.col("since"), F.lit(False))).over(Window.partitionBy("key"))))
    # a key whose statements come in order of time has no late ones, and the active value is the one before
    outcome = F.when(F.col("n") == 1, "first").when(F.col("value").eqNullSafe(F.col("before")), "restate").otherwise("supersede")
    calm = seen.where("NOT late").select("key", "seq", "text", "obs", outcome.alias("outcome"))
    ordered = seen.where("late").select("key", "seq", "value", "text", "obs").repartition("key").sortWithinPartitions("key", "seq")
    told = cut(calm.unionByName(ordered.mapInPandas(_decide, "key string, seq long, text string, obs long, outcome string")))
    kept, dropped = told.where("outcome <> 'restate'"), told.where("outcome = 'restate'")
    by_time = Window.partitionBy("key").orderBy("obs")
    after = F.min(F.struct("obs", "seq")).over(by_time.rangeBetween(1, Window.unboundedFollowing))
    leads = F.col("outcome") != "late"  # rows that were active once, in arrival order
    line = Window.partitionBy("key", "leads").orderBy("seq")
    w = kept.withColumn("leads", leads).withColumn("after", after)
    w = w.withColumn("heir", F.when(F.col("leads"), F.lead("seq").over(line))).withColumn("heir_obs", F.when(F.col("leads"), F.lead("obs").over(line)))
    empty = F.col("heir_obs") == F.col("obs")
    active = F.col("leads") & F.col("heir").isNull()
    done = w.select(
        "key", "seq", "text", "obs", "outcome", F.when(active, "active").otherwise("superseded").alias("status"),
        F.when(~active, F.when(F.coalesce(empty, F.lit(False)), F.col("obs")).otherwise(F.col("after.obs"))).alias("valid_to"),
        F.when(~active, F.when(F.coalesce(empty, F.lit(False)), F.col("heir")).otherwise(F.col("after.seq"))).alias("superseded_by"))
    both = done.unionByName(dropped, allowMissingColumns=True)
    return both.withColumn("k", F.from_json("key", "domain string, subject_id long, relation string")).select("k.*", "seq", "text", "obs", "outcome", "status", "valid_to", "superseded_by")


def in_order(said: DataFrame) -> DataFrame:
    """The fold of statements that arrive in order of time, by windows alone: key, seq, obs, valid_to, superseded_by."""
    line = Window.partitionBy(*KEY).orderBy("obs", "seq")
    kept = said.withColumn("last", F.lag("value").over(line)).where("last IS NULL OR last <> value")
    return kept.select(*KEY, "seq", "obs", F.lead("obs").over(line).alias("valid_to"), F.lead("seq").over(line).alias("superseded_by"))


def violations(memories: DataFrame) -> DataFrame:
    """Keys with more than one active fact; a sound ledger has none."""
    return memories.where("status = 'active' AND relation IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def judge_band(p: Column, auto: float = 0.8, review: float = 0.5) -> Column:
    """What a decision of probability ``p`` leads to: supersede, pending or new."""
    return F.when(p >= auto, "supersede").when(p >= review, "pending").otherwise("new")


def soft_delete(memories: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Memories after those of ``ids`` are deleted: status deleted, an open interval closed at ``now``."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    m = memories.select("id", "status", "valid_to").join(gone, "id", "left")
    return m.select("id", F.when(F.col("gone"), "deleted").otherwise(F.col("status")).alias("status"), F.when(F.col("gone"), F.coalesce("valid_to", F.lit(now).cast("timestamp_ntz"))).otherwise(F.col("valid_to")).alias("valid_to"))


def resolve_reviews(reviews: DataFrame, memories: DataFrame, approved: Column, now: str) -> DataFrame:
    """What the open reviews of memories do: review, memory_id (new side), new_status, new_relation, other_id (old side), old_status, old_valid_to, old_superseded_by.

    supersede: approval ends the old fact where the new begins and makes the new active under the old one's relation,
    rejection makes the new active as it is. conflict: approval ends the old one, rejection makes it active again if it
    is pending. merge: approval ends the old one now, rejection changes nothing. What isn't changed is shown as it is.
    Reviews of aliases are resolved by ``entities.absorb`` and ``entities.repoint``.
    """
    m = memories.select("id", "status", "valid_from", "valid_to", "relation", "superseded_by")
    new = m.toDF("memory_id", "new_was", "new_from", "new_to", "new_rel", "new_by")
    old = m.toDF("other_id", "old_was", "old_from", "old_to", "old_rel", "old_by")
    r = reviews.where("status = 'open' AND kind IN ('supersede', 'conflict', 'merge')").withColumn("yes", approved).join(new, "memory_id").join(old, "other_id")
    ends = F.col("yes")
    end = F.when(F.col("kind") == "merge", F.lit(now).cast("timestamp_ntz")).otherwise(F.col("new_from"))
    return r.select(
        F.col("id").alias("review"), "memory_id", F.when(F.col("kind") == "supersede", "active").otherwise(F.col("new_was")).alias("new_status"), "other_id",
        F.when((F.col("kind") == "supersede") & F.col("yes"), F.col("old_rel")).otherwise(F.col("new_rel")).alias("new_relation"),
        F.when(ends, "superseded").when((F.col("kind") == "conflict") & (F.col("old_was") == "pending"), "active").otherwise(F.col("old_was")).alias("old_status"),
        F.when(ends, end).otherwise(F.col("old_to")).alias("old_valid_to"), F.when(ends, F.col("memory_id")).otherwise(F.col("old_by")).alias("old_superseded_by"))


def skill_versions(saved: DataFrame) -> DataFrame:
    """Saves of skills (name, seq, payload) as versions: a save with the payload of the one before changes nothing."""
    line = Window.partitionBy("name").orderBy("seq")
    changed = saved.withColumn("last", F.lag("payload").over(line)).where(~F.col("last").eqNullSafe(F.col("payload")) | F.col("last").isNull())
    return changed.select("name", "seq", "payload", F.row_number().over(line).alias("version"))


def current_skills(saved: DataFrame) -> DataFrame:
    """The last version of every skill: name, payload, version."""
    v = skill_versions(saved)
    return v.groupBy("name").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))
