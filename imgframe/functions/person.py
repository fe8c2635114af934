"""Person names: family^given^middle^prefix^suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("family", "given", "middle", "prefix", "suffix")


def name_parts(text: Column) -> Column:
    """struct of five parts; an empty part is NULL and more than five are dropped."""
    split = F.split(F.trim(text), r"\^")
    return F.struct(*[F.nullif(F.get(split, F.lit(i)), F.lit("")).alias(p) for i, p in enumerate(PARTS)])


def format_name(parts: Column) -> Column:
    """Joined by ^, without empty parts at the end."""
    return F.regexp_replace(F.concat_ws("^", *[F.coalesce(parts[p], F.lit("")) for p in PARTS]), r"\^+$", "")


def display_name(parts: Column) -> Column:
    """Prefix, given, middle, family and suffix, joined by spaces."""
    return F.concat_ws(" ", *[parts[p] for p in ("prefix", "given", "middle", "family", "suffix")])


def make_name(**parts: Column) -> Column:
    """A name of the parts that are given."""
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"a name has no {sorted(unknown)}")
    return F.struct(*[F.nullif(parts[p], F.lit("")).alias(p) if p in parts else F.lit(None).cast("string").alias(p) for p in PARTS])
