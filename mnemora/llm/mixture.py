"""Corpora with target shares of sources, by nested hash thresholds."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemora.sources import cut

#: Bits of a hash digit: a pass sums tokens in 2**DIGIT buckets for each source.
DIGIT = 12
_LEVELS = 5


_ENCODINGS: dict[tuple[str, str, int], object] = {}


def _encoding(path: str, pattern: str, content: bytes):  # noqa: ANN202
    """The encoding of a vocabulary, made once in a process."""
    import base64

    import tiktoken

    key = (path, pattern, len(content))
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def token_count(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """Tokens of a text under the byte-level vocabulary file at ``path`` (token and rank on each line); null has 0.

    The driver reads the file (a vocabulary of some megabytes) and sends its content, so executors need no such path.
    """
    content = spark.sparkContext.broadcast(Path(path).read_bytes())

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        e = _encoding(path, pattern, content.value)
        return texts.map(lambda t: 0 if t is None else len(e.encode_ordinary(t))).astype("int64")

    return count(text)


def plain_source(source: Column) -> Column:
    """Plain form of a source: lower case, blanks and hyphens as underscores, none at the ends; null if empty."""
    s = F.regexp_replace(F.lower(source), r"[\s_-]+", "_")
    return F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit(""))


def mix_to_targets(docs: DataFrame, doc_id: Column, source: Column, size: Column, targets: Iterable[tuple[str, float, int]], total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A mixture (doc_id, source, size, copies) and its report by source.

    ``targets`` holds source, share and the most copies of a document (a bounded list, one row for each source).
    ``total`` is the size wanted; without it, the largest at which every source that has documents can reach its
    share. A source gives as many full copies of itself as fit its budget, and the documents whose hash is below a
    threshold once more. The thresholds are nested: a larger total keeps all documents of a smaller one. A source
    that can't reach its share within its copies gives all it may. Sources without a target, null ids, null sources
    and sizes of 0 or less take no part. The sum of a source is short of its budget by less than one document.

    Tokens are summed by source and hash digit; only the bucket in which the budget ends is divided further.
    The report: source, target_share, actual_share, size, available, docs, max_copies.
    """
    wanted = {s: (float(share), int(most)) for s, share, most in targets}
    rows = docs.select(doc_id.alias("doc_id"), source.alias("source"), size.cast("long").alias("size")).where(
        F.col("doc_id").isNotNull() & F.col("source").isin(list(wanted)) & (F.col("size") > 0))
    rows = cut(rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    have = {r["source"]: r["s"] for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    if total is None:
        total = min((have[s] * most / share for s, (share, most) in wanted.items() if s in have and share > 0), default=0.0)
    full, rest = {}, {}
    for s, n in have.items():
        share, most = wanted[s]
        budget = min(share * total, most * n)
        full[s] = min(most, int(budget // n))
        rest[s] = int(budget - full[s] * n) if full[s] < most else 0
    # descend: the hash prefixes below which all documents are taken, and the bucket still to be divided
    prefix = dict.fromkeys(have, 0)
    for level in range(_LEVELS):
        shift = 64 - DIGIT * (level + 1)
        at = F.create_map(*[F.lit(x) for s, p in prefix.items() for x in (s, p)])[F.col("source")] if prefix else F.lit(0)
        inside = rows if level == 0 else rows.where(F.shiftrightunsigned("h", shift + DIGIT) == at)
        sums: dict[str, list[tuple[int, int]]] = {}
        for r in inside.groupBy("source", F.shiftrightunsigned("h", shift).alias("d")).agg(F.sum("size").alias("n")).collect():
            sums.setdefault(r["source"], []).append((r["d"], r["n"]))
        for s in have:
            cut_at = (prefix[s] + 1) << DIGIT
            for d, n in sorted(sums.get(s, [])):
                if n > rest[s]:
                    cut_at = d
                    break
                rest[s] -= n
            prefix[s] = cut_at
    if not have:
        mixed = rows.select("doc_id", "source", "size", F.lit(0).alias("copies"))
    else:
        below = F.create_map(*[F.lit(x) for s, p in prefix.items() for x in (s, p)])[F.col("source")]
        base = F.create_map(*[F.lit(x) for s, n in full.items() for x in (s, n)])[F.col("source")]
        extra = F.shiftrightunsigned("h", 64 - DIGIT * _LEVELS) < below
        mixed = rows.select("doc_id", "source", "size", (base + extra.cast("int")).alias("copies")).where("copies > 0")
    spark = docs.sparkSession
    asked = spark.createDataFrame([(s, share, most) for s, (share, most) in wanted.items()], "source string, target_share double, max_copies int")
    sums = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").cast("long").alias("docs"))
    stock = rows.groupBy("source").agg(F.sum("size").alias("available"))
    whole = F.sum("size").over(Window.partitionBy(F.lit(0)))  # over the sources only
    report = asked.join(sums, "source", "left").join(stock, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("size") / whole, F.lit(0.0)).alias("actual_share"), F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("docs", F.lit(0)).alias("docs"), "max_copies")
    return mixed, report
