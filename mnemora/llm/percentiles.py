"""Percentiles of large numeric columns by radix selection over mergeable digit histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemora.sources import cut

#: Bits of a radix digit: a group has at most 2**DIGIT histogram rows for each prefix followed.
DIGIT = 16
#: Of whole numbers, whose leading bits are finer than those of a double; the first digit has what is left over.
DIGIT_WHOLE = 12
_NAN = int(np.array([np.nan]).view(np.int64)[0]) - 2**63


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SIGN = -(2**63)


@F.pandas_udf(T.LongType())
def ordered_bits(value: pd.Series) -> pd.Series:
    """The bits of a double as a long whose unsigned order is the numeric order; both zeros are one, NaN is last."""
    v = value.to_numpy(np.float64, na_value=np.nan, copy=True)
    v[v == 0] = 0.0
    v[np.isnan(v)] = np.nan
    raw = v.view(np.int64)
    return pd.Series(np.where(raw < 0, ~raw, raw ^ np.int64(-(2**63))))


def bits_value(bits: str | Column) -> Column:
    """Inverse of ``ordered_bits``."""
    b = F.col(bits) if isinstance(bits, str) else bits
    return F.when(b == F.lit(_NAN), F.lit(float("nan"))).otherwise(_finite(b))  # Arrow would make a null of NaN


@F.pandas_udf(T.DoubleType())
def _finite(bits: pd.Series) -> pd.Series:
    u = bits.to_numpy(np.int64)
    return pd.Series(np.where(u < 0, u ^ np.int64(-(2**63)), ~u).astype(np.int64).view(np.float64))


def _milli(percents: Sequence[float]) -> list[int]:
    return [round(p * 1000) for p in percents]


def _targets(totals: DataFrame, percents: Sequence[float]) -> DataFrame:
    """One row per group and percentile with the rank that is looked for: ceil(share * n), at least 1."""
    p = F.explode(F.array(*[F.lit(m).cast("long") for m in _milli(percents)]))
    return totals.withColumn("__p", p).withColumn("__rank", F.greatest(F.lit(1), F.expr("(__p * __n + 99999) div 100000")))


def percentiles(rows: DataFrame, groups: dict[str, Column], value: Column, percents: Sequence[float], at_least: int = 1) -> DataFrame:
    """Exact percentiles per group: the group columns, pct, value (a double, or a long of whole numbers), n.

    The percentile is the smallest value with at least that share of the group's rows at or below it. Null values are
    left out, a null group column is a group of its own, NaN counts as larger than all numbers; groups of fewer than
    ``at_least`` values and empty inputs give no rows. Ties and repeated rows count as often as they occur.

    Values become order-preserving integers. Each pass counts the next 16 bits (12 of whole numbers) of those values that share the
    followed prefix, and follows the digit that holds the target rank; a digit that holds one distinct value ends the
    search early. Counts are summed on the map side first, so a hot group costs no more than its histogram.
    """
    names = list(groups)
    v = rows.select(*[c.alias(f"g{i}") for i, c in enumerate(groups.values())], value.alias("v")).where("v IS NOT NULL")
    whole = isinstance(v.schema["v"].dataType, _WHOLE)
    # of a whole number the sign bit is turned, so none is rounded, and it never leaves the JVM
    base = cut(v.withColumn("u", F.col("v").cast("long").bitwiseXOR(F.lit(_SIGN)) if whole else ordered_bits(F.col("v").cast("double"))).drop("v"))
    g = [f"g{i}" for i in range(len(names))]
    # leading bits that all values share tell nothing
    ends = base.agg(*[f(F.col("u").bitwiseXOR(F.lit(_SIGN))) for f in (F.min, F.max)]).first()
    ends = (0, 0) if ends[0] is None else tuple(ends)
    top = max(1, ((ends[0] ^ ends[1]) & (2**64 - 1)).bit_length())
    above = lambda bits: F.shiftrightunsigned("u", bits) if bits < 64 else F.lit(0).cast("long")
    open_targets, done = None, []
    while True:
        width = (top - 1) % DIGIT_WHOLE + 1 if whole else min(DIGIT, top)
        shift = top - width
        now = base.withColumn("prefix", above(top))
        if open_targets is not None:
            wanted = open_targets.select(*g, "prefix").distinct()
            now = now.alias("a").join(wanted.alias("b"), _all([F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*g, "prefix"]]), "left_semi")
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        hist = now.groupBy(*g, "prefix", digit.alias("digit")).agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"))
        line = Window.partitionBy(*g, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("n").over(line))
        if open_targets is None:
            hist = cut(hist)
            open_targets = _targets(hist.groupBy(*g).agg(F.sum("n").alias("__n")).where(F.col("__n") >= at_least), percents)
            open_targets = open_targets.withColumn("prefix", F.lit(0).cast("long") if top >= 64 else F.lit(_prefix(ends[0], top)).cast("long"))
        t, h = open_targets.alias("t"), hist.alias("h")
        hit = t.join(h, _all([F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*g, "prefix"]]) & (F.col("t.__rank") <= F.col("h.upto")) & (F.col("t.__rank") > F.col("h.upto") - F.col("h.n")))
        hit = cut(hit.select(
            *[F.col(f"t.{c}") for c in g], "t.__p", "t.__n", (F.col("t.__rank") - F.col("h.upto") + F.col("h.n")).alias("__rank"),
            F.shiftleft("h.prefix", width).bitwiseOR(F.col("h.digit")).alias("prefix"), "h.lo", "h.hi"))
        done.append(hit.where("lo = hi").select(*g, "__p", "__n", "lo"))
        open_targets = hit.where("lo <> hi").drop("lo", "hi")
        top = shift
        if not top or open_targets.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(c).alias(n) for c, n in zip(g, names)], (F.col("__p") / 1000).alias("pct"), (F.col("lo").bitwiseXOR(F.lit(_SIGN)) if whole else bits_value("lo")).alias("value"), F.col("__n").alias("n"))


def _prefix(signed: int, bits: int) -> int:
    """What stands above the lowest ``bits`` bits of the unsigned form of a value."""
    return ((signed ^ _SIGN) & (2**64 - 1)) >> bits


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def digit_histogram(rows: DataFrame, groups: dict[str, Column], value: Column, bits: int = 24) -> DataFrame:
    """A mergeable summary: the group columns, prefix (the first ``bits`` bits of the value's ordered form), n.

    Summaries of separate days, files or partitions are combined by ``merge_histograms``. Null values are left out.
    A value read back from a prefix is off by at most a share of 2**(12 - bits) of itself.
    """
    u = rows.select(*[c.alias(n) for n, c in groups.items()], value.cast("double").alias("__v")).where("__v IS NOT NULL").withColumn("__u", ordered_bits("__v"))
    return u.groupBy(*groups, F.shiftrightunsigned("__u", 64 - bits).alias("prefix")).agg(F.count("*").alias("n"))


def merge_histograms(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One histogram from the union of several with the same ``bits``."""
    return parts.groupBy(*groups, "prefix").agg(F.sum("n").alias("n"))


def histogram_percentiles(hist: DataFrame, groups: Sequence[str], percents: Sequence[float], bits: int = 24, at_least: int = 1) -> DataFrame:
    """Percentiles of a merged histogram: the group columns, pct, low, high, n; the exact one lies in [low, high]."""
    line = Window.partitionBy(*groups).orderBy("prefix")
    upto = hist.withColumn("__upto", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto = upto.withColumn("__n", F.sum("n").over(Window.partitionBy(*groups))).where(F.col("__n") >= at_least)
    t = _targets(upto, percents).where("__rank <= __upto AND __rank > __upto - n")
    low = F.shiftleft("prefix", 64 - bits)
    high = low.bitwiseOR(F.lit((1 << (64 - bits)) - 1).cast("long"))
    return t.select(*groups, (F.col("__p") / 1000).alias("pct"), bits_value(low).alias("low"), bits_value(high).alias("high"), F.col("__n").alias("n"))
