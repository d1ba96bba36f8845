"""Sessions separated by gaps of inactivity, by pairing session starts with session ends."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.sources import cut

DAY_US = 86_400_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (taken as UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def sessions(
    events: DataFrame,
    entity: Column,
    ts_us: Column,
    event_id: Column | None = None,
    gap_us: int = 1_800_000_000,
    counts: Mapping[str, Column] | None = None,
    slice_us: int = DAY_US,
) -> DataFrame:
    """One row per session: entity, start_us, end_us, duration_us, n_events and one column per entry of ``counts``.

    A session is a maximal run of an entity's events in which no step to the next exceeds ``gap_us`` (a step of
    exactly ``gap_us`` stays inside). ``counts`` maps a name to a condition; the events that meet it are counted.
    With ``event_id`` each id counts once (of rows that share an id but differ, the smallest is taken). Rows with a
    null entity, time or id are left out; no rows give no sessions; equal times belong to one session. Input columns
    are reached only through the given expressions, so extra columns and their names don't matter.

    An entity's time line is cut into slices of ``slice_us``, so a hot entity spreads over as many tasks as it has
    slices; events within one gap of a cut are also shown to the neighbouring slice, which is all a RANGE frame of
    one gap can see. Start and end numbers inside a slice are completed by the totals of the earlier slices.
    """
    if slice_us <= gap_us:
        raise ValueError("a slice must be longer than the gap")
    counts = dict(counts or {})
    names = list(counts)
    rows = events.select(
        entity.alias("entity"), ts_us.cast("long").alias("t"), *([event_id.alias("i")] if event_id is not None else []),
        *[F.when(c, 1).otherwise(0).cast("long").alias(f"c_{n}") for n, c in counts.items()],
    ).where("entity IS NOT NULL AND t IS NOT NULL")
    if event_id is not None:
        rest = [c for c in rows.columns if c != "i"]
        rows = rows.where("i IS NOT NULL").groupBy("i").agg(F.min(F.struct(*rest)).alias("r")).select("r.*")

    own = F.expr(f"t div {slice_us} - CASE WHEN t % {slice_us} < 0 THEN 1 ELSE 0 END")
    into = F.pmod(F.col("t"), F.lit(slice_us))
    seen_by = F.array_compact(F.array(
        F.col("own"), F.when(into <= gap_us, F.col("own") - 1), F.when(into >= slice_us - gap_us, F.col("own") + 1)))
    points = (
        rows.withColumn("own", own).withColumn("slice", F.explode(seen_by))
        .repartition("entity", "slice")
        .groupBy("entity", "slice", "own", "t").agg(F.count("*").alias("n"), *[F.sum(f"c_{n}").alias(f"c_{n}") for n in names])
    )
    line = Window.partitionBy("entity", "slice").orderBy("t")
    marked = (
        points.withColumn("is_start", (F.count("*").over(line.rangeBetween(-gap_us, -1)) == 0).cast("long"))
        .withColumn("is_end", (F.count("*").over(line.rangeBetween(1, gap_us)) == 0).cast("long"))
        .where("own = slice")
    )
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ["n", *[f"c_{n}" for n in names]]
    ranked = marked.select(
        "entity", "slice", "t", "is_start", "is_end", *sums, F.sum("is_start").over(so_far).alias("starts"), F.sum("is_end").over(so_far).alias("ends"),
        *[F.sum(s).over(so_far).alias(f"sum_{s}") for s in sums], F.lead("t").over(line).isNull().alias("is_last"),
    )
    # written once and read three times: as many rows as sessions begin and end, and one for each slice
    ranked = cut(ranked.where("is_start = 1 OR is_end = 1 OR is_last"))
    totals = ranked.where("is_last").select("entity", "slice", "starts", "ends", *[f"sum_{s}" for s in sums])
    earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("entity", "slice", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b_{c}") for c in ("starts", "ends", *[f"sum_{s}" for s in sums])])
    edges = ranked.where("is_start = 1 OR is_end = 1").join(before, ["entity", "slice"])
    starts = edges.where("is_start = 1").select(
        "entity", (F.col("starts") + F.col("b_starts")).alias("rank"), F.col("t").alias("start_us"),
        *[(F.col(f"b_sum_{s}") + F.col(f"sum_{s}") - F.col(s)).alias(f"from_{s}") for s in sums])
    ends = edges.where("is_end = 1").select(
        "entity", (F.col("ends") + F.col("b_ends")).alias("rank"), F.col("t").alias("end_us"),
        *[(F.col(f"b_sum_{s}") + F.col(f"sum_{s}")).alias(f"to_{s}") for s in sums])
    return starts.join(ends, ["entity", "rank"]).select(
        "entity", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        (F.col("to_n") - F.col("from_n")).alias("n_events"), *[(F.col(f"to_c_{n}") - F.col(f"from_c_{n}")).alias(n) for n in names])
