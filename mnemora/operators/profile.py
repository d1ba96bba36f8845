"""The core profile: a text of bounded size of what is true and important."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.functions.text import clip


class Profiles:
    """Profile texts by the version of the ledger they were made from: made anew only when it has changed."""

    def __init__(self) -> None:
        self._version: object = None
        self._text = ""
        self.made = 0

    def text(self, version: object, memories: DataFrame, entities: DataFrame, today: str) -> str:
        """The profile as one text; its date, too, is that of the last change."""
        if not self.made or version != self._version:
            self._text = "\n".join(r["line"] for r in core_profile(memories, entities, today).orderBy("pos").collect())  # at most 3200 characters
            self._version, self.made = version, self.made + 1
        return self._text


def core_profile(memories: DataFrame, entities: DataFrame, today: str, least: float = 0.7, most: int = 3200) -> DataFrame:
    """Lines of the profile in order: pos, line. It ends with a mark where the next line would exceed ``most`` characters.

    Active keyed facts of at least that importance by subject and relation, then identity notes by importance and
    recency. A line has at least one character, so no more than ``most`` rows of either kind are ever needed: the two
    sorts keep that many, and the windows run over them only.
    """
    names = entities.select(F.col("id").alias("subject_id"), "name")
    active = memories.where((F.col("status") == "active") & (F.col("importance") >= least))
    facts = active.where("relation IS NOT NULL").join(names, "subject_id").select(F.lower("name").alias("o"), "name", "relation", "id", F.coalesce(F.nullif("object_text", F.lit("")), "content").alias("value"), F.date_format("valid_from", "yyyy-MM-dd").alias("since"))
    facts = facts.orderBy("o", "name", "relation", "id").limit(most)
    order = Window.orderBy("o", "name", "relation", "id")
    said = F.concat(F.lit("- "), F.translate("relation", "_", " "), F.lit(": "), "value", F.lit(" (since "), F.coalesce("since", F.lit("?")), F.lit(")"))
    heading = F.when(~F.lag("name").over(order).eqNullSafe(F.col("name")), F.concat(F.lit("\n## "), "name"))
    f = facts.withColumn("n", F.row_number().over(order)).withColumn("lines", F.array(heading, said)).select(F.lit(1).alias("part"), "n", F.posexplode("lines").alias("i", "line"))
    notes = active.where("relation IS NULL AND domain = 'identity'").orderBy(F.desc("importance"), F.desc("observed_at"), "id").limit(most)
    at = F.row_number().over(Window.orderBy(F.desc("importance"), F.desc("observed_at"), "id"))
    note = F.concat(F.lit("- "), clip(F.col("content"), 220), F.lit(" ("), F.date_format("observed_at", "yyyy-MM-dd"), F.lit(")"))
    title = F.when(F.col("n") == 1, F.lit("\n## About the user"))
    g = notes.withColumn("n", at).withColumn("lines", F.array(title, note)).select(F.lit(2).alias("part"), "n", F.posexplode("lines").alias("i", "line"))
    head = memories.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(f"# Core memory (as of {today})").alias("line"))
    lines = head.unionAll(f).unionAll(g).where("line IS NOT NULL")
    w = Window.orderBy("part", "n", "i")
    sized = lines.withColumn("pos", F.row_number().over(w)).withColumn("size", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = sized.where(F.col("size") <= most).select("pos", "line")
    mark = sized.where(F.col("size") > most).groupBy().agg(F.min("pos").alias("pos")).where("pos IS NOT NULL").select("pos", F.lit("- … (truncated; search memory for more)").alias("line"))
    return kept.unionAll(mark)
