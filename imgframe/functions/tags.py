"""Attribute tags as LONG (group * 65536 + element), and paths of them. An invalid text gives NULL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

TAG_TEXT = r"^(\([0-9A-Fa-f]{4},[0-9A-Fa-f]{4}\)|[0-9A-Fa-f]{4},[0-9A-Fa-f]{4}|[0-9A-Fa-f]{8})$"
INDEX = r"^\[[0-9]{1,9}\]$"


def parse_tag(text: Column) -> Column:
    """LONG of ``(GGGG,EEEE)``, ``GGGG,EEEE`` or ``GGGGEEEE``, hex digits in any case."""
    return F.when(text.rlike(TAG_TEXT), F.conv(F.translate(text, "(),", ""), 16, 10).cast("long"))


def tag_key(tag: Column) -> Column:
    """``GGGGEEEE``, upper case."""
    return F.lpad(F.hex(tag), 8, "0")


def format_tag(tag: Column) -> Column:
    """``(GGGG,EEEE)``, upper case."""
    half = lambda n: F.lpad(F.hex(n), 4, "0")
    return F.concat(F.lit("("), half(group_of(tag)), F.lit(","), half(element_of(tag)), F.lit(")"))


def group_of(tag: Column) -> Column:
    return F.shiftright(tag, 16)


def element_of(tag: Column) -> Column:
    return tag.bitwiseAND(0xFFFF)


def is_private(tag: Column) -> Column:
    return group_of(tag) % 2 == 1


def is_meta(tag: Column) -> Column:
    """Whether the tag belongs to a file's meta table."""
    return group_of(tag) == 2


def is_group_length(tag: Column) -> Column:
    return element_of(tag) == 0


def is_private_creator(tag: Column) -> Column:
    return is_private(tag) & element_of(tag).between(0x10, 0xFF)


def tag_of(text: Column, aliases: Mapping[str, int]) -> Column:
    """A tag text, or else an alias (case counts) of a small dictionary."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,bigint>")
    return F.coalesce(parse_tag(text), F.try_element_at(names, text).cast("long"))


def parse_selector(text: Column, aliases: Mapping[str, int]) -> Column:
    """array<struct<tag long, item int>> of ``key[i].key``; a step without an index is item 0, the last step must be bare.

    NULL if any step is not valid.
    """
    def parts(s: Column) -> Column:
        name = F.substring_index(s, "[", 1)
        return F.struct(name.alias("key"), F.substring(s, F.length(name) + 1, F.length(s)).alias("rest"))

    def step(p: Column) -> Column:
        item = F.when(p.rest == "", 0).when(p.rest.rlike(INDEX), F.substring(p.rest, F.lit(2), F.length(p.rest) - 2).cast("int"))
        return F.struct(tag_of(p["key"], aliases).alias("tag"), item.alias("item"))

    parsed = F.transform(F.transform(F.split(text, r"\."), parts), step)
    return let(parsed, lambda p: F.when(F.forall(p, lambda x: x.tag.isNotNull() & x.item.isNotNull()) & ~text.endswith("]"), p))


def format_selector(steps: Column) -> Column:
    """``(GGGG,EEEE)[i].(GGGG,EEEE)``: the canonical text of a path."""
    n = F.size(steps)
    texts = F.transform(steps, lambda s, i: F.when(i < n - 1, F.concat(format_tag(s.tag), F.lit("["), s.item.cast("string"), F.lit("]"))).otherwise(format_tag(s.tag)))
    return F.array_join(texts, ".")
