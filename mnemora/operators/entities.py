"""Entities, links and reviews: resolution, merging and the joins around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.functions.text import norm_name, query_tokens
from mnemora.operators import search
from mnemora.sources import cut


def active_links(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links with both ends active."""
    live = memories.where("status = 'active'").select("id")
    out = links.select("src", "dst", "weight")
    for end in ("src", "dst"):
        out = out.join(live.withColumnRenamed("id", end), end, "left_semi")
    return out


def both_ways(links: DataFrame) -> DataFrame:
    """Links from either end: id, other, weight."""
    return links.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight").unionAll(links.select("dst", "src", "weight"))


def related(links: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """For each memory its k heaviest links with active memories; ties go to the smaller id."""
    live = memories.where("status = 'active'").select(F.col("id").alias("other"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "other"))
    return both_ways(links).join(live, "other", "left_semi").select("id", "other", "weight", rank.alias("rank")).where(F.col("rank") <= k)


def unreviewed(pairs: DataFrame, reviews: DataFrame, kind: str = "merge") -> DataFrame:
    """Pairs (src < dst) for which no review of that kind exists, in either order and whatever its outcome."""
    seen = reviews.where((F.col("kind") == kind) & F.col("memory_id").isNotNull() & F.col("other_id").isNotNull())
    seen = seen.select(F.least("memory_id", "other_id").alias("src"), F.greatest("memory_id", "other_id").alias("dst"))
    return pairs.join(seen.distinct(), ["src", "dst"], "left_anti")


def alias_reviewed(reviews: DataFrame) -> DataFrame:
    """Pairs of entities (src < dst) that an alias review has named in its detail (keep, drop), whatever its outcome."""
    d = reviews.where("kind = 'alias'").select(F.from_json("detail", "keep long, drop long").alias("d")).where("d.keep IS NOT NULL AND d.drop IS NOT NULL")
    return d.select(F.least("d.keep", "d.drop").alias("src"), F.greatest("d.keep", "d.drop").alias("dst")).distinct()


def judged(proposals: DataFrame, decisions: DataFrame, least: float = 0.5) -> DataFrame:
    """Proposals (src, dst, similarity) that a judge doesn't refuse: src, dst, confidence.

    ``decisions`` (src, dst, p) may lack pairs, as where no judge is at hand; those keep their similarity as confidence.
    """
    d = decisions.groupBy("src", "dst").agg(F.max("p").alias("p"))
    return proposals.join(d, ["src", "dst"], "left").where(f"p IS NULL OR p >= {least}").select("src", "dst", F.coalesce("p", "similarity").alias("confidence"))


def open_reviews(reviews: DataFrame, memories: DataFrame, entities: DataFrame) -> DataFrame:
    """Open reviews with the texts of their memories, or for aliases the name of their entity."""
    text = memories.select("id", "content")
    r = reviews.where("status = 'open'").select("id", "kind", "confidence", "created_at", *[F.when(F.col("kind") != "alias", F.col(c)).alias(c) for c in ("memory_id", "other_id")], F.when(F.col("kind") == "alias", F.col("other_id")).alias("entity_id"))
    out = r.join(text.toDF("memory_id", "memory"), "memory_id", "left").join(text.toDF("other_id", "other"), "other_id", "left")
    return out.join(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id", "left").select("id", "kind", "confidence", "created_at", "memory", "other", "entity")


def name_keys(entities: DataFrame) -> DataFrame:
    """Keys of names (via 0) and aliases (via 1): key, id, via."""
    own = entities.select(norm_name(F.col("name")).alias("key"), "id", F.lit(0).alias("via"))
    also = entities.select("id", F.explode("aliases").alias("a")).where("a IS NOT NULL").select(norm_name(F.col("a")).alias("key"), "id", F.lit(1).alias("via"))
    return own.unionAll(also).where("key <> ''")


def resolve_exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Each mention with its entity: by name before alias, then the smallest id; null where none has the key."""
    best = name_keys(entities).groupBy("key").agg(F.min(F.struct("via", "id")).alias("b")).select("key", F.col("b.id").alias("entity_id"))
    return mentions.withColumn("key", norm_name(F.col("mention"))).join(best, "key", "left").select("mention", "entity_id")


def backfill(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with their object resolved to the entity of that norm where it was open."""
    e = entities.select(F.col("norm").alias("key"), F.col("id").alias("found"))
    return facts.select("id", "object_entity_id", F.lower(F.trim("object_text")).alias("key")).join(e, "key", "left").select("id", F.coalesce("object_entity_id", "found").alias("object_entity_id"))


def named_in(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose name or alias stands in a query text as whole words: id, entity_id, weight 1.

    Each place of a query is joined with the names by one word, for names of one word, and by two, for longer ones, whose
    rest is compared then. So no query is held against every entity, and the longest name costs only itself. Places carry
    their words alone, not the query's text, which would cost the square of its length.
    """
    key = F.split("key", " ")
    names = name_keys(entities).select(key.alias("k"), F.array_join(F.slice(key, 1, 2), " ").alias("head"), F.col("id").alias("entity_id")).distinct()
    w = queries.where("content IS NOT NULL").select("id", F.split(norm_name(F.col("content")), " ").alias("w"))
    at = lambda i, n, head: F.struct((i + 1).alias("i"), F.lit(n).alias("n"), head.alias("head"))
    one = F.transform("w", lambda x, i: at(i, 1, x))
    two = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: at(i, 2, F.concat(x, F.lit(" "), F.col("w")[i + 1])))
    heads = w.select("id", F.explode(F.concat(one, two)).alias("x")).select("id", "x.*")
    met = heads.join(names, "head").where(F.least(F.size("k"), F.lit(2)) == F.col("n")).join(w, "id").where(F.slice("w", F.col("i"), F.size("k")) == F.col("k"))
    return met.select("id", "entity_id", F.lit(1.0).alias("weight")).distinct()


def seeds(queries: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """Entities to start from: those named in a query (weight 1), or where it names none the ``k`` best by BM25 over names and aliases (0.5): id, entity_id, weight."""
    named = cut(named_in(queries, entities))
    words = query_tokens(F.concat_ws(" ", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")))
    rows = cut(entities.select("id", words.alias("w")))
    rest = queries.join(named.select("id").distinct(), "id", "left_anti")
    best = search.text_topk(rest.select(F.col("id").alias("query"), F.explode(query_tokens(F.col("content"))).alias("term")), rows, k)
    return named.unionAll(best.select(F.col("query").alias("id"), F.col("id").alias("entity_id"), F.lit(0.5).alias("weight")))


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table and the first new row, in ``order``, of each key that it doesn't have."""
    first = new.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").select(*table.columns)
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def merged_aliases(*lists: Column) -> Column:
    """Distinct non-blank entries of several lists, sorted; null lists count as empty."""
    filled = [F.coalesce(x, F.array().cast("array<string>")) for x in lists]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*filled), lambda x: x.isNotNull() & (F.trim(x) != ""))))


def add_aliases(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (id, aliases) after aliases (id, alias, seq) are added in order; one that an entity has in normalised form, or a blank one, is passed over.

    Of several new ones of one form the first is taken. Entities without new aliases keep theirs; a null list counts as empty.
    """
    first = new.select("id", F.trim("alias").alias("alias"), "seq", norm_name(F.col("alias")).alias("form")).where("form <> ''")
    first = first.groupBy("id", "form").agg(F.min(F.struct("seq", "alias")).alias("a"))
    lists = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a.seq", "a.alias", "form"))).alias("added"))
    old = F.coalesce("aliases", F.array().cast("array<string>"))
    forms = F.transform(old, lambda x: norm_name(x))
    kept = F.filter(F.coalesce("added", F.array().cast("array<struct<seq:bigint,alias:string,form:string>>")), lambda x: ~F.coalesce(F.array_contains(forms, x["form"]), F.lit(False)))
    return entities.select("id", "aliases").join(lists.withColumn("added", F.col("added").cast("array<struct<seq:bigint,alias:string,form:string>>")), "id", "left").select("id", F.concat(old, F.transform(kept, lambda x: x["alias"])).alias("aliases"))


def absorb(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Aliases of the entities that absorb others (merges: keep, drop): id, aliases, those of both and the dropped names, sorted and distinct.

    Pairs of one kept entity are taken together; pairs with an unknown or the same entity are left out.
    """
    e = entities.select("id", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    m = merges.select("keep", "drop").where("keep <> drop").distinct()
    dropped = m.join(e.toDF("drop", "name", "aliases"), "drop").select(F.col("keep").alias("id"), F.concat(F.array("name"), "aliases").alias("more"))
    more = dropped.groupBy("id").agg(F.flatten(F.collect_list("more")).alias("more"))
    return e.join(more, "id").select("id", merged_aliases(F.col("aliases"), F.col("more")).alias("aliases"))


def repoint(memories: DataFrame, merges: DataFrame) -> DataFrame:
    """Memories that name a dropped entity as subject or object, with the kept one in its place: id, subject_id, object_entity_id."""
    to = merges.groupBy("drop").agg(F.min("keep").alias("keep"))
    m = memories.select("id", "subject_id", "object_entity_id")
    m = m.join(to.toDF("subject_id", "s"), "subject_id", "left").join(to.toDF("object_entity_id", "o"), "object_entity_id", "left")
    return m.where("s IS NOT NULL OR o IS NOT NULL").select("id", F.coalesce("s", "subject_id").alias("subject_id"), F.coalesce("o", "object_entity_id").alias("object_entity_id"))


def upsert_external(memories: DataFrame) -> DataFrame:
    """Repeated imports folded to one row per external id: identity and validity of the first, content of the last, last known source."""
    m = memories.where("external_id IS NOT NULL")
    return m.groupBy("external_id").agg(
        F.min_by("uid", "id").alias("uid"), F.min_by("valid_from", "id").alias("valid_from"), F.max_by("content", "id").alias("content"), F.max_by("importance", "id").alias("importance"),
        F.max_by("source", F.when(F.col("source").isNotNull(), F.col("id"))).alias("source"), F.count("*").alias("n_imports"))
