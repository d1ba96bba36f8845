"""Views of the ledger: current, as of a moment, history, and the usual predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import has_tag

DOMAINS = ("identity", "projects", "code", "general", "diary")
#: Levels of the tree of days of an as-of join.
LEVELS = 16
#: Statuses that were true at some time.
KNOWN = ("active", "superseded", "archived")


#: Default and largest number of rows of each listing (fixed values).
LIMITS = {"search": (5, 50), "list": (100, 500), "events": (100, 1000), "reviews": (20, 100), "related": (6, 6), "skills": (3, 50)}


def clamped(listing: str, limit: int | None = None) -> int:
    """The limit that a listing is given, or its default, between 1 and its largest."""
    default, most = LIMITS[listing]
    return max(1, min(default if limit is None else limit, most))


def current_view(memories: DataFrame, now: str) -> DataFrame:
    """Active rows that haven't expired at ``now``."""
    return memories.where((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))))


def as_of(memories: DataFrame, moment: str) -> DataFrame:
    """Rows valid at ``moment``: begun, not ended (intervals are half-open), neither deleted nor pending."""
    t = F.lit(moment).cast("timestamp_ntz")
    return memories.where(F.col("status").isin(*KNOWN) & (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def history(memories: DataFrame) -> DataFrame:
    """All rows that were true at some time."""
    return memories.where(F.col("status").isin(*KNOWN))


def matching(memories: DataFrame, domain: str | None = None, kind: str | None = None, tag: str | None = None, min_importance: float | None = None) -> DataFrame:
    """Rows that meet all the given predicates; those not given don't filter."""
    out = memories
    for given, condition in (
        (domain, F.col("domain") == domain), (kind, F.col("type") == kind), (tag, has_tag(F.col("tags"), tag or "")), (min_importance, F.col("importance") >= min_importance)):
        out = out if given is None else out.where(condition)
    return out


def as_of_join(probes: DataFrame, facts: DataFrame, keys: list[str], moment: str = "moment", many: int = 64) -> DataFrame:
    """Each probe (keys and a moment) with the facts valid at its moment.

    Probes of a key meet its facts, up to ``many`` of them. Beyond that the key's time is divided into days, and days
    into a binary tree: a fact stands at the few nodes that make up its days, a probe looks at the nodes above its own,
    and so meets the facts of its time only; the key is divided over the nodes. Times beyond the tree's 2**16 days count
    to its ends, where, as everywhere, the times are compared. Rows with a null key or no time meet nothing.
    """
    last = (1 << LEVELS) - 1
    day = lambda c: F.greatest(F.lit(0), F.least(F.lit(last), F.unix_date(F.to_date(c))))
    node = lambda level, at: F.struct(level.cast("int").alias("level"), at.cast("int").alias("node"))
    whole, levels = F.array(node(F.lit(-1), F.lit(0))), F.sequence(F.lit(0), F.lit(LEVELS))

    def sides(n: Column) -> Column:
        """At a level, the days a..b leave at most one node on each side that no node above holds."""
        size = F.pow(F.lit(2.0), n).cast("int")
        low, high = F.ceil(F.col("__a") / size), F.floor((F.col("__b") + 1) / size) - 1
        return F.array(F.when((low <= high) & ((low % 2 == 1) | (n == LEVELS)), node(n, low)), F.when((low <= high) & (high % 2 == 0), node(n, high)))

    f = history(facts).where("valid_from IS NOT NULL").withColumn("__a", day(F.col("valid_from"))).withColumn("__b", F.greatest("__a", F.coalesce(day(F.col("valid_to")), F.lit(last))))
    hot = f.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > many).select(*keys, F.lit(True).alias("__hot"))
    stands = F.when(F.col("__hot"), F.array_compact(F.array_distinct(F.flatten(F.transform(levels, sides))))).otherwise(whole)
    looks = F.when(F.col("__hot"), F.transform(levels, lambda n: node(n, F.floor(day(F.col(moment)) / F.pow(F.lit(2.0), n))))).otherwise(whole)

    def spread(rows: DataFrame, at: Column) -> DataFrame:
        out = rows.join(hot, keys, "left").withColumn("__e", F.explode(at))
        return out.withColumn("__level", F.col("__e.level")).withColumn("__node", F.col("__e.node")).drop("__a", "__b", "__hot", "__e")

    met = spread(probes, looks).join(spread(f, stands), [*keys, "__level", "__node"])
    return met.where(f"valid_from <= {moment} AND (valid_to IS NULL OR valid_to > {moment})").drop("__level", "__node")


def errors(statements: DataFrame) -> Column:
    """Why a statement isn't valid, or null: an unknown domain, or only one of subject and relation."""
    return (
        F.when(~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False)), "domain")
        .when(F.col("subject_id").isNull() != F.col("relation").isNull(), "subject and relation"))


def page(rows: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """A page of the newest rows with id below ``before``, and next_offset, the last id if more follow."""
    kept = rows if before is None else rows.where(F.col("id") < before)
    some = kept.orderBy(F.desc("id")).limit(limit + 1)
    from pyspark.sql.window import Window

    w = Window.orderBy(F.desc("id"))  # over at most limit + 1 rows
    numbered = some.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    last = F.max(F.when(F.col("rank") == limit, F.col("id"))).over(Window.partitionBy(F.lit(0)))
    return numbered.withColumn("next_offset", F.when(F.col("n") > limit, last)).where(F.col("rank") <= limit).drop("n")
