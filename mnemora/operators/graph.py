"""Graph queries over facts and links: adjacency, personalised PageRank, neighbourhoods, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.sources import cut


def adjacency(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Directed edges (src, dst, w), each way, between active memories ('m' + id) and entities ('e' + id).

    A memory is tied to its subject and its object with weight 1, linked memories with the link's weight; parallel
    edges add up.
    """
    live = memories.where("status = 'active'").select("id", "subject_id", "object_entity_id")
    m, e = (lambda c: F.concat(F.lit("m"), c)), (lambda c: F.concat(F.lit("e"), c))
    ties = [live.where(f"{c} IS NOT NULL").select(m("id").alias("a"), e(c).alias("b"), F.lit(1.0).alias("w")) for c in ("subject_id", "object_entity_id")]
    ids = live.select("id")
    near = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    one_way = ties[0].unionAll(ties[1]).unionAll(near.select(m("src").alias("a"), m("dst").alias("b"), F.col("weight").alias("w")))
    both = one_way.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(one_way.select("b", "a", "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, stay: float = 0.5, every: int = 5) -> DataFrame:
    """Personalised PageRank for many queries: query, node, mass, from seeds (query, node, weight) over edges (src, dst, w).

    Seeds outside the graph or without weight are left out and the rest normalised; in each round half the mass returns
    to the seeds and half moves along the edges in proportion to their weight. Mass sums to 1 for each query. Masses
    live where their nodes are: the edges are partitioned once, lineage is cut every few rounds.
    """
    degree = edges.groupBy("src").agg(F.sum("w").alias("degree"))
    step = cut(edges.join(degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("p")))
    known = seeds.where("weight > 0").join(degree.select(F.col("src").alias("node")), "node", "left_semi").groupBy("query", "node").agg(F.sum("weight").alias("weight"))
    total = known.groupBy("query").agg(F.sum("weight").alias("total"))
    reset = cut(known.join(total, "query").select("query", "node", (F.col("weight") / F.col("total")).alias("r")))
    mass = reset.withColumnRenamed("r", "mass")
    for i in range(rounds):
        moved = mass.join(step, F.col("node") == F.col("src")).select("query", F.col("dst").alias("node"), (F.col("mass") * F.col("p") * (1 - stay)).alias("x"))
        mass = moved.unionAll(reset.select("query", "node", (F.col("r") * stay).alias("x"))).groupBy("query", "node").agg(F.sum("x").alias("mass"))
        if i % every == every - 1:
            mass = cut(mass)
    return mass


def neighbors(memories: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """Entities within ``depth`` (at most 3) facts of each starting entity: start, id, hops; the start itself is left out.

    Active facts with both ends are walked both ways.
    """
    f = memories.where("status = 'active' AND subject_id IS NOT NULL AND object_entity_id IS NOT NULL").select(F.col("subject_id").alias("a"), F.col("object_entity_id").alias("b"))
    edges = f.unionAll(f.select("b", "a")).where("a <> b").distinct()
    reached = start.select(F.col("id").alias("start"), "id").withColumn("hops", F.lit(0))
    front = reached
    for hop in range(1, min(depth, 3) + 1):
        nxt = front.join(edges, front["id"] == edges["a"]).select("start", F.col("b").alias("id")).distinct()
        front = nxt.join(reached.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(front)
    return reached.where("hops > 0")


def snapshot(memories: DataFrame, links: DataFrame, domain: str | None = None, history: bool = False) -> DataFrame:
    """The graph to be shown, as rows (kind, id, other): facts with their subject, entities touched, notes, links of active memories."""
    statuses = ["active", "superseded"] if history else ["active"]
    in_domain = F.lit(True) if domain is None else F.col("domain") == domain
    facts = memories.where(F.col("status").isin(statuses) & in_domain & F.col("subject_id").isNotNull())
    touched = facts.select(F.explode(F.array("subject_id", "object_entity_id")).alias("id")).where("id IS NOT NULL").distinct()
    notes = memories.where((F.col("status") == "active") & in_domain & F.col("subject_id").isNull())
    live = memories.where("status = 'active'").select("id")
    near = links.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("id"), b.cast("long").alias("other"))
    return row(facts, "fact", "id", F.col("subject_id")).unionAll(row(touched, "entity", "id", F.lit(None))).unionAll(row(notes, "note", "id", F.lit(None))).unionAll(row(near, "link", "src", F.col("dst")))
