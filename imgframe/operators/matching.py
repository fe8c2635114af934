"""Key=value queries as predicates: single value, list, wildcard, range and universal matching."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal, values
from .dictionary import SEED
from .elements import scope, steps_of, tag_at

TEXT_VRS = frozenset("AE AS CS DS IS LO LT PN SH ST UC UI UR UT".split())
INTEGER_VRS = {"SS": (-(2**15), 2**15 - 1), "US": (0, 2**16 - 1), "SL": (-(2**31), 2**31 - 1), "UL": (0, 2**32 - 1), "SV": (-(2**63), 2**63 - 1), "UV": (0, 2**64 - 1)}
REFUSED_VRS = frozenset("AT OB OD OF OL OV OW UN SQ".split())


RANGES = {"DA": (temporal.date_range, temporal.day_within), "TM": (temporal.time_range, temporal.within), "DT": (temporal.datetime_range, temporal.within)}


class QueryError(ValueError):
    """A term can't be turned into a predicate."""


@dataclass(frozen=True)
class Term:
    """``key=value``; an empty value matches everything and only asks for the key."""

    key: str
    value: str

    @classmethod
    def parse(cls, text: str) -> Term:
        key, mark, value = text.partition("=")
        if not key.strip():
            raise QueryError(f"no key in {text!r}")
        return cls(key.strip(), value)


def parse_query_lines(lines: DataFrame) -> DataFrame:
    """Lines (column value) that are not blank and no # comments."""
    text = F.trim("value")
    return lines.where((text != "") & ~text.startswith("#"))


def literal(value: str, vr: str) -> str | int | float:
    """The value as its representation has it; an error where it can't be."""
    if vr in REFUSED_VRS:
        raise QueryError(f"{vr} can't be queried by text")
    if vr in INTEGER_VRS:
        low, high = INTEGER_VRS[vr]
        if not re.fullmatch(r"\s*[+-]?\d+\s*", value) or not low <= int(value) <= high:
            raise QueryError(f"{value!r} is no {vr}")
        return int(value)
    if vr in ("FL", "FD"):
        try:
            return float(value)
        except ValueError as e:
            raise QueryError(f"{value!r} is no {vr}") from e
    return value


def predicate(column: Column, vr: str, value: str) -> Column:
    """Whether a column matches a query value.

    Dates, times and date-times (DA, TM, DT) match ranges with a dash, or the whole of a partial value. Dates are
    DATE or timestamps, times microseconds of the day; what is no range is an error. Text matches ``*`` and ``?`` and lists with a backslash.
    """
    if value == "":
        return F.lit(True)
    if vr in RANGES:
        parse, test = RANGES[vr]
        bounds = temporal.fixed_bounds(parse(F.lit(value if "-" in value else f"{value}-{value}")))
        if bounds is None:
            raise QueryError(f"{value!r} is no range of {vr}")
        return test(column, bounds)
    if vr in TEXT_VRS or vr == "LO":
        options = value.split("\\")
        plain = [v for v in options if not re.search(r"[*?]", v) or vr == "UI"]
        found = values.trim_padding(column).isin(*plain) if plain else F.lit(False)
        for v in options:
            if v not in plain:
                pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in v)
                found = found | column.rlike(f"^(?s:{pattern})$")
        return found
    return column == F.lit(literal(value, vr))


def select_where(rows: DataFrame, terms: list[str], schema: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows that match all ``terms``; the keys asked for come first. ``schema``: key to (column, representation).

    Of terms with the same key the last counts.
    """
    last = {t.key: t for t in map(Term.parse, terms)}
    unknown = [k for k in last if k not in schema]
    if unknown:
        raise QueryError(f"unknown keys: {unknown}")
    out = rows
    for key, term in last.items():
        column, vr = schema[key]
        if term.value != "":
            out = out.where(predicate(F.col(column), vr, term.value))
    return out


def canonical_path(text: str, aliases: dict[str, int]) -> str:
    """``key[i].key`` of tags or aliases as a path; a sequence without an index is its first item."""
    steps = []
    for step in text.split("."):
        found = re.fullmatch(r"([^\[\]]+?)(?:\[(\d{1,9})\])?", step.strip())
        digits = found and re.fullmatch(r"\(?([0-9A-Fa-f]{4}),?([0-9A-Fa-f]{4})\)?", found[1])
        tag = int(digits[1] + digits[2], 16) if digits else aliases.get(found[1]) if found else None
        if tag is None:
            raise QueryError(f"no path: {text!r}")
        steps.append((f"({tag >> 16:04X},{tag & 0xFFFF:04X})", found[2]))
    if steps[-1][1] is not None:
        raise QueryError(f"{text!r} ends in an item")
    return ".".join([*(f"{t}[{i or 0}]" for t, i in steps[:-1]), steps[-1][0]])


def build_identifier(terms: list[str], entries=SEED) -> list[tuple[str, int, str, list[str]]]:
    """The elements (path, tag, vr, values) of a query: its terms, with the sequences and items that lead to nested ones.

    Representations are those of the dictionary ``entries``, or LO. An item may be the next one of its sequence at most;
    of terms with the same path the last counts. Values that their representation can't have are a ``QueryError``.
    """
    aliases, kinds = {alias: tag for tag, _, alias, _ in entries}, {tag: vr for tag, _, _, vr in entries}
    found: dict[str, tuple] = {}
    items: dict[str, int] = {}
    for term in map(Term.parse, terms):
        path = canonical_path(term.key, aliases)
        for sequence, item in steps_of(path):
            if item > items.get(sequence, 0):
                raise QueryError(f"{path}: {sequence} has no item {item} yet")
            items[sequence] = max(items.get(sequence, 0), item + 1)
            found[sequence] = (sequence, tag_at(sequence), "SQ", [])
        tag = tag_at(path)
        vr = kinds.get(tag, "LO")
        vr = vr if vr in TEXT_VRS | REFUSED_VRS or vr in INTEGER_VRS or vr in ("FL", "FD") or vr in RANGES else "LO"
        if term.value != "":
            literal(term.value, vr)
        found[path] = (path, tag, vr, [term.value] if term.value != "" else [])
    return sorted(found.values())


def value_matches(held: Column, vr: str, value: str) -> Column:
    """Whether one of an element's values, as texts, matches a query value."""
    typed = {"DA": temporal.exact_date, "TM": lambda v: temporal.let(temporal.partial_time(v), temporal.time_earliest), "DT": lambda v: temporal.let(temporal.partial_datetime(v), temporal.datetime_earliest)}
    number = (lambda v: v.try_cast("double")) if vr in ("FL", "FD") else (lambda v: v.try_cast("decimal(38,0)")) if vr in INTEGER_VRS else None
    convert = typed.get(vr) or number or (lambda v: v)
    return F.coalesce(F.exists(held, lambda v: predicate(convert(v), vr, value)), F.lit(False))


def match_in_items(elements: DataFrame, identifier: list[tuple[str, int, str, list[str]]]) -> DataFrame:
    """(instance): the instances whose elements match an identifier, nested keys within items.

    All keys of one item of the identifier, those in its own sequences among them, must be met by the elements of one
    item of the instance, whichever it is; an element without a value matches everything. Only elements of the keys'
    tags are looked at. They are dealt by instance once, and from the innermost items up each level tells the next one
    which items hold all that is asked for, as bits: a window for each level within that one deal, and no joins.
    """
    keys = [(path, tag, vr, values[0]) for path, tag, vr, values in identifier if vr != "SQ" and values]
    if not keys:
        return elements.select("instance").distinct()
    nodes = sorted({f"{s}[{i}]." for path, *_ in keys for s, i in steps_of(path)}, key=lambda n: -n.count("."))
    bits = {name: 1 << i for i, name in enumerate([*(path for path, *_ in keys), *nodes])}
    if len(bits) > 63:
        raise QueryError(f"{len(bits)} keys and items are too many")
    parent = lambda name: re.sub(r"[^.]*$", "", name.rstrip("."))
    needs = {node: sum(b for name, b in bits.items() if parent(name) == node) for node in ["", *nodes]}
    general = F.regexp_replace("path", r"\[\d+\]", "[]")
    mask = lambda tests: sum((F.when(test, F.lit(bit)).otherwise(F.lit(0)) for test, bit in tests), F.lit(0)).cast("long")
    met = mask([((general == re.sub(r"\[\d+\]", "[]", path)) & value_matches(F.col("values"), vr, value), bits[path]) for path, _, vr, value in keys])
    rows = elements.where(F.col("tag").isin(*sorted({tag for _, tag, *_ in keys}))).select("instance", scope(F.col("path")).alias("item"), met.alias("bits")).where("bits <> 0").repartition("instance")
    depth = max(node.count(".") for node in ["", *nodes])
    item = F.col("item")
    for d in range(depth, 0, -1):
        all_bits = F.bit_or("bits").over(Window.partitionBy("instance", "item"))
        own = F.regexp_replace(item, r"\[\d+\]", "[]")
        held = mask([((own == re.sub(r"\[\d+\]", "[]", node)) & (all_bits.bitwiseAND(F.lit(needs[node])) == needs[node]), bits[node]) for node in nodes if node.count(".") == d])
        here = F.size(F.split(item, r"\.")) - 1 == d
        rows = rows.select("instance", F.when(here, F.regexp_replace(item, r"[^.]*\.$", "")).otherwise(item).alias("item"), F.when(here, held).otherwise(F.col("bits")).alias("bits")).where("bits <> 0")
    return rows.groupBy("instance").agg(F.bit_or("bits").alias("bits")).where(F.col("bits").bitwiseAND(F.lit(needs[""])) == needs[""]).select("instance")


#: 2^BITS blocks of days make a block of the next level; the first of the days that a date can hold, and the levels that hold them all.
BITS, EARLIEST = 3, -(1 << 31)
LEVELS = 11


def days_of(lo: Column, hi: Column) -> tuple[Column, Column]:
    """The first and the last day from lo to hi, counted from the earliest one; a NULL bound is open."""
    place = lambda day, bound: F.coalesce(F.unix_date(day).cast("long"), F.lit(bound).cast("long")) - F.lit(EARLIEST).cast("long")
    return place(lo, EARLIEST), place(hi, -EARLIEST - 1)


def block_of(day: Column, level: Column) -> Column:
    """The block of a level that holds a day."""
    return F.call_function("shiftright", F.unix_date(day.cast("date")).cast("long") - F.lit(EARLIEST).cast("long"), level * BITS)


def blocks_of(lo: Column, hi: Column) -> Column:
    """array<struct<level, block>>: disjoint blocks of days that make up lo to hi; a NULL bound is open. Few for any range."""
    first, last = days_of(lo, hi)
    one = F.lit(1).cast("long")

    def inside(level: Column) -> tuple[Column, Column]:
        """The first and the last block of a level that is inside of the range; there is none where they are the wrong way round."""
        return F.call_function("shiftright", first + F.call_function("shiftleft", one, level * BITS) - 1, level * BITS), F.call_function("shiftright", last + 1, level * BITS) - 1

    def found(level: Column) -> Column:
        (a, b), (up, down) = inside(level), inside(level + 1)
        whole, run = up <= down, lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        blocks = F.when(whole, F.concat(run(a, F.shiftleft(up, BITS) - 1), run(F.shiftleft(down + 1, BITS), b))).otherwise(run(a, b))
        return F.transform(blocks, lambda n: F.struct(level.alias("level"), n.alias("block")))

    top = F.floor((F.length(F.bin(last - first + 1)) - 1) / BITS).cast("int")  # of a block as long as the range at most
    return F.when(first <= last, F.flatten(F.transform(F.sequence(F.lit(0), top), found))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def match_many(queries: DataFrame, instances: DataFrame, day: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of the rows of ``queries`` (with lo and hi, dates) and ``instances`` whose ``day`` is in the range, all in one join.

    A range is cut into blocks of days, of which each day is in one for each level; so both meet by equal blocks, and a
    pair comes out once. A NULL bound is open; a range with lo after hi, or a NULL day, matches nothing. ``keys`` are
    columns of both that must be equal where the query's is not NULL. Other columns stay; those of ``queries`` with the
    names of ``instances`` are to be renamed before. Where only totals of the pairs are asked for, see ``match_totals``.
    """
    q = queries.withColumn("_block", F.explode(blocks_of(F.col("lo"), F.col("hi"))))
    levels = sorted(r[0] for r in q.select("_block.level").distinct().collect())  # a handful at most
    each = F.array(*[F.struct(F.lit(k).cast("int").alias("level"), block_of(F.col(day), F.lit(k)).alias("block")) for k in levels]) if levels else F.array().cast("array<struct<level:int,block:bigint>>")
    renamed = {k: f"_q_{k}" for k in keys}
    q = q.withColumnsRenamed(renamed)
    pairs = instances.where(F.col(day).isNotNull()).withColumn("_block", F.explode(each)).join(q, "_block")
    for k, name in renamed.items():
        pairs = pairs.where(F.col(name).isNull() | (F.col(name) == F.col(k)))
    return pairs.drop("_block", *renamed.values())


def match_totals(queries: DataFrame, instances: DataFrame, day: str, keys: tuple[str, ...], by: tuple[str, ...], totals: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """(by, totals) of the pairs of ``match_many``, grouped by columns of ``queries``, without making the pairs.

    ``totals`` are an aggregate of instances each, and what merges such aggregates of parts (a count and a sum, a minimum
    and a minimum). Instances are summed up by day and keys, and then by block, once with each choice of keys that some
    query asks for; each distinct range meets one row for each of its few blocks, however many instances these hold, and
    queries take the totals of their range. Joins are by sorting: ranges are many more in blocks than Spark would guess.
    """
    merged = [merge(name).alias(name) for name, (_, merge) in totals.items()]
    asked = lambda of: sum((F.when(F.col(f"{of}{k}").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0))
    at = lambda choice, level, block, held: F.struct(choice.alias("asked"), level.alias("level"), block.alias("block"), *[v.alias(k) for k, v in zip(keys, held, strict=True)]).alias("_at")
    first, last = days_of(F.col("lo"), F.col("hi"))
    lengths = queries.select(asked("").alias("asked"), (last - first + 1).alias("days")).where("days > 0")
    longest = lengths.groupBy("asked").agg(F.max("days")).collect()  # a row for each choice of keys
    days = instances.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias("_day"), *keys).agg(*[total.alias(name) for name, (total, _) in totals.items()])
    levels = [(choice, level) for choice, most in longest or [(0, 1)] for level in range(LEVELS) if most >> level * BITS]
    places = [at(F.lit(choice), F.lit(level), block_of(F.col("_day"), F.lit(level)), [F.when(F.lit(bool(choice >> i & 1)), F.col(k)) for i, k in enumerate(keys)]) for choice, level in levels]
    blocks = days.select(F.explode(F.array(*places)).alias("_at"), *totals).groupBy("_at").agg(*merged)
    ranges = queries.select(F.struct("lo", "hi", *keys).alias("_range")).distinct()
    cut = ranges.select("_range", F.explode(blocks_of(F.col("_range.lo"), F.col("_range.hi"))).alias("_cut"))
    cut = cut.select("_range", at(asked("_range."), F.col("_cut.level"), F.col("_cut.block"), [F.col(f"_range.{k}") for k in keys]))
    found = cut.join(blocks.hint("merge"), "_at").groupBy("_range").agg(*merged)
    asking = queries.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.struct("lo", "hi", *keys).alias("_range"))
    return asking.join(found.hint("merge"), "_range").groupBy(*[F.col(f"_by_{c}").alias(c) for c in by]).agg(*merged)
