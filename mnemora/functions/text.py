"""Text functions of the memory store, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in a query (fixed values).
STOP_WORDS = (
    "the a an and or of to in on for is are was what which who how do does did i my me it with about that this be at by as").split()


def norm_name(name: Column) -> Column:
    """Name key: outer blanks off, outer punctuation off, lower case, inner blanks to one. Null stays null."""
    s = F.regexp_replace(name, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"""^[.,;:!?"']+|[.,;:!?"']+$""", "")
    return F.regexp_replace(F.lower(s), r"\s+", " ")


def norm_relation(relation: Column) -> Column:
    """Relation key: lower case, everything but letters a to z and digits to single underscores, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(relation), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def query_tokens(text: Column) -> Column:
    """ASCII word tokens (dots, hyphens, underscores inside) in lower case, without stop words; repeats are kept."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9_.\-]*"), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), r"^[.\-]+|[.\-]+$", ""))
    return F.filter(raw, lambda t: (t != "") & ~t.isin(STOP_WORDS))


def split_csv(text: Column) -> Column:
    """Entries of a comma-separated text, trimmed, without blanks."""
    return clean_tags(F.split(text, ","))


def clean_tags(tags: Column) -> Column:
    """Tags trimmed, without blanks and nulls."""
    return F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))


def clip(text: Column, length: int, collapse: bool = True) -> Column:
    """Text cut to ``length`` characters at a blank, marked with an ellipsis; blanks are collapsed first if asked."""
    s = F.trim(F.regexp_replace(text, r"\s+", " ")) if collapse else text
    return F.when(F.length(s) <= length, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, length), r" [^ ]*$", ""), F.lit(" …")))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` between two bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def has_tag(tags: Column, tag: str) -> Column:
    """Whether a tag is among the tags, whatever its case; null tags match nothing."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == tag.lower()), F.lit(False))
