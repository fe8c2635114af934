"""Data sets as a table of elements, and an ordered list of operations on them.

``elements``: (instance, path, tag, vr, values array<string>); one row for each attribute of each instance. path is
the canonical text of the place of the attribute, as ``functions.tags.format_selector`` writes it; nested attributes
have longer paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags

ENTRIES = "array<struct<path:string,tag:bigint,vr:string,values:array<string>>>"
ELEMENTS = "instance long, path string, tag long, vr string, values array<string>"

CHANGES = frozenset("remove empty set_vr set set_if_missing replace push truncate".split())
#: Operations that make what is not there, with the sequences and the one next item that lead there.
MAKES = frozenset("set_vr set set_if_missing push".split())
INTEGER_VRS, FLOAT_VRS = ("SS", "US", "SL", "UL", "SV", "UV"), ("FL", "FD")
PUSHED = frozenset("str i16 u16 i32 u32 f32 f64".split())


class OperationError(ValueError):
    """An operation that no data set allows."""


@dataclass(frozen=True)
class Operation:
    """One change to the attribute at ``path``; ``argument`` is a value or Column, a representation, or a number of values.

    vr: of an attribute that is made. kind: of a value that is pushed, one of ``PUSHED``.
    """

    change: str
    path: str
    argument: object = None
    vr: str = "UN"
    kind: str = "str"

    def __post_init__(self):
        if self.change not in CHANGES:
            raise OperationError(f"there is no change {self.change!r}")
        if self.kind not in PUSHED:
            raise OperationError(f"there is no kind {self.kind!r}")


def elements_of(rows: DataFrame, instance: str, attributes: dict[str, tuple[int, str]]) -> DataFrame:
    """Elements of a wide table: ``attributes`` gives the tag and representation of each column; NULLs give none."""
    each = [F.struct(F.lit(tag).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.col(c).cast("string").alias("value")) for c, (tag, vr) in attributes.items()]
    out = rows.select(F.col(instance).cast("long").alias("instance"), F.explode(F.array(*each)).alias("e")).where("e.value IS NOT NULL")
    return out.select("instance", tags.format_tag(F.col("e.tag")).alias("path"), "e.tag", "e.vr", F.array("e.value").alias("values"))


def wide(elements: DataFrame, paths: dict[str, str]) -> DataFrame:
    """One row an instance, a column for the first value at each path: one aggregation."""
    first = lambda p: F.max(F.when(F.col("path") == p, F.get("values", F.lit(0))))
    return elements.groupBy("instance").agg(*[first(p).alias(c) for c, p in paths.items()])


def none() -> Column:
    return F.array().cast("array<string>")


def steps_of(path: str) -> list[tuple[str, int]]:
    """(path of the sequence, item) of all that lead to a path, outermost first."""
    found, at = [], 0
    while (at := path.find("].", at + 1)) >= 0:
        sequence, _, item = path[:at].rpartition("[")
        found.append((sequence, int(item)))
    return found


def tag_at(path: str) -> int:
    last = path.rsplit(".", 1)[-1]
    return int(last[1:5] + last[6:10], 16)


def below(path: Column, sequence: str) -> Column:
    """Whether a path lies within a sequence: one interval of paths, which a Parquet scan can prune by."""
    return (path >= f"{sequence}[") & (path < f"{sequence}\\")  # the character after the bracket


def scope(path: Column) -> Column:
    """What a path has before its last step: the item that an element stands in, or nothing at the root."""
    return F.regexp_extract(path, r"^(.*\.)?[^.]*$", 1)


class _State:
    """What is known of one path while operations are folded: columns that are worked out once for each instance."""

    def __init__(self, path: str, row: str, items: str):
        found = F.col(row)
        self.path, self.there, self.vr, self.values, self.items = path, found.isNotNull(), found["vr"], F.coalesce(found["values"], none()), F.coalesce(F.col(items), F.lit(0))

    def gone(self) -> None:
        self.there, self.items = F.lit(False), F.lit(0)


def apply(elements: DataFrame, operations: Sequence[Operation], strict: bool = False) -> DataFrame:
    """Elements after all operations, one after the other.

    All operations fold into one pass: what stands at the paths that they name is worked out for each instance, in a
    window over its elements, and carried through the list as expressions. An operation that an instance does not
    allow (a nested path in no sequence, an item after the next one, a value pushed to another kind) changes nothing,
    or with ``strict`` is an error; replacing, emptying, truncating or removing what is not there changes nothing.
    """
    paths = list(dict.fromkeys(p for op in operations for p in (*(s for s, _ in steps_of(op.path)), op.path)))
    if not paths:
        return elements
    path, ordered = F.col("path"), Window.partitionBy("instance").orderBy("path", "tag")
    own = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one order for both, so one sort
    rows = elements.select("instance", "path", "tag", "vr", "values")
    found = {f"_s{i}": F.max(F.when(path == p, F.struct("vr", "values"))).over(own) for i, p in enumerate(paths)}
    item = lambda p: F.regexp_extract(F.substring(path, len(p) + 2, 10), r"^(\d+)\]", 1).try_cast("int")
    counted = {f"_n{i}": F.max(F.when(below(path, p), item(p) + 1)).over(own) for i, p in enumerate(paths)}
    first = F.row_number().over(ordered) == 1
    rows = rows.withColumns({**found, **counted, "_first": first})

    states = {p: _State(p, f"_s{i}", f"_n{i}") for i, p in enumerate(paths)}
    cleared: list[str] = []
    problems: list[Column] = []
    for op in operations:
        _fold(op, states, cleared, problems)

    kept = ~path.isin(paths)
    for p in dict.fromkeys(cleared):
        kept = kept & ~below(path, p)
    kept = F.coalesce(kept, F.lit(True))  # a row without a path says that the data set can't be read
    entry = lambda path, tag, vr, values: F.struct(path.alias("path"), tag.cast("long").alias("tag"), vr.alias("vr"), values.alias("values"))
    made = F.filter(F.array(*[F.when(s.there, entry(F.lit(p), F.lit(tag_at(p)), s.vr, s.values)) for p, s in states.items()]), lambda e: e.isNotNull())
    empty = F.array().cast(ENTRIES)
    if strict and problems:
        wrong = F.coalesce(*problems)
        made = F.when(wrong.isNotNull(), F.raise_error(wrong).cast(ENTRIES)).otherwise(made)
    each = F.concat(F.when(kept, F.array(entry(path, F.col("tag"), F.col("vr"), F.col("values")))).otherwise(empty), F.when(F.col("_first"), made).otherwise(empty))
    return rows.select("instance", F.explode(each).alias("e")).select("instance", "e.*")


def _fold(op: Operation, states: dict[str, _State], cleared: list[str], problems: list[Column]) -> None:
    """The states after one operation."""
    state = states[op.path]
    there = state.there
    argument = op.argument if isinstance(op.argument, Column) else F.lit(op.argument)
    text = argument.cast("string")
    if op.change in ("remove", "empty", "set", "replace"):  # a sequence loses its items
        cleared.append(op.path)
        for p, other in states.items():
            if p.startswith(op.path + "["):
                other.gone()
        state.items = F.lit(0)
    if op.change == "remove":
        state.there = F.lit(False)
        return
    can = F.lit(True)
    if op.change in MAKES:
        levels = [(states[s], i) for s, i in steps_of(op.path)]
        for level, i in levels:
            can = can & (~level.there | (level.vr == "SQ")) & (F.lit(i) <= level.items)
        if levels:
            problems.append(F.when(~can, F.lit(f"{op.change} {op.path}: no sequence or item to put it in")))
        makes = can if op.change != "set_if_missing" else can & ~there
        for level, i in levels:
            level.vr = F.when(level.there, level.vr).otherwise("SQ")
            level.there = level.there | makes
            level.items = F.when(makes, F.greatest(level.items, F.lit(i + 1))).otherwise(level.items)
        state.there = there | can
    if op.change == "empty":
        state.values = none()
    elif op.change == "set_vr":
        state.vr, state.values = F.when(there | can, F.lit(op.argument)), F.when(there, state.values).otherwise(none())
    elif op.change == "set":
        state.vr, state.values = F.when(there, state.vr).otherwise(op.vr), F.array(text)
    elif op.change == "replace":
        state.values = F.array(text)
    elif op.change == "set_if_missing":
        state.vr, state.values = F.when(there, state.vr).otherwise(op.vr), F.when(there, state.values).otherwise(F.array(text))
    elif op.change == "truncate":
        state.values = F.slice(state.values, 1, op.argument)
    elif op.change == "push":
        vr = F.when(there, state.vr).otherwise(op.vr)
        number = argument.try_cast("double")
        whole = F.when(number.isNotNull(), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("string"))
        fits = ~vr.isin("SQ", "AT", *(() if op.kind != "str" else (*INTEGER_VRS, *FLOAT_VRS)))
        value = text if op.kind == "str" else F.when(vr.isin(*INTEGER_VRS), whole).when(vr.isin(*FLOAT_VRS), number.cast("string")).otherwise(text)
        problems.append(F.when(there & ~fits, F.concat(F.lit(f"push {op.kind} {op.path}: not a value of "), vr)))
        state.vr = vr
        state.values = F.when(there & ~fits, state.values).otherwise(F.concat(F.when(there, state.values).otherwise(none()), F.array(value)))


def value_at(elements: DataFrame, path: str) -> DataFrame:
    """(instance, values, failure) for each instance: the values at a path, or why there are none.

    failure names the first step that fails: ``missing sequence P``, ``not a sequence P`` or ``missing leaf P``.
    """
    names = [*(s for s, _ in steps_of(path)), path]
    at = lambda p, c: F.max(F.when(F.col("path") == p, F.col(c)))
    inside = [F.max(F.startswith(F.col("path"), F.lit(f"{s}[{i}]."))) for s, i in steps_of(path)]
    grouped = elements.groupBy("instance").agg(*[at(p, "vr").alias(f"_v{i}") for i, p in enumerate(names)], *[c.alias(f"_i{i}") for i, c in enumerate(inside)], at(path, "values").alias("values"))
    failure = F.lit(None).cast("string")
    for i, p in reversed(list(enumerate(names))):
        vr = F.col(f"_v{i}")
        if p == path:
            failure = F.when(vr.isNull(), f"missing leaf {p}")
        else:
            failure = F.when(vr.isNull(), f"missing sequence {p}").when(vr != "SQ", f"not a sequence {p}").when(~F.col(f"_i{i}"), f"missing sequence {p}").otherwise(failure)
    return grouped.select("instance", "values", failure.alias("failure"))


def put_private(elements: DataFrame, group: int, creator: str, element: int, vr: str, value: Column | str, first_block: int = 0x10) -> DataFrame:
    """Elements with a private one of a creator in every instance, in place of the same.

    The creator's block is used, or else the first free one from ``first_block`` is reserved for it.
    """
    if group % 2 == 0:
        raise OperationError("a private group is odd")
    tag = F.col("tag")
    mine = tags.is_private_creator(tag) & (tags.group_of(tag) == group) & ~F.col("path").contains(".")
    named = F.get("values", F.lit(0)) == creator
    block = tags.element_of(tag)
    blocks = elements.groupBy("instance").agg(F.min(F.when(mine & named, block)).alias("held"), F.collect_set(F.when(mine, block)).alias("taken"))
    free = F.get(F.filter(F.sequence(F.lit(first_block), F.lit(0xFF)), lambda b: ~F.array_contains("taken", b.cast("long"))), F.lit(0)).cast("long")
    blocks = blocks.withColumn("block", F.coalesce("held", free)).where("block IS NOT NULL")
    value = value if isinstance(value, Column) else F.lit(value)
    base = F.lit(group << 16)
    row = lambda tag, vr, v: F.struct(tag.cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(v).alias("values"))
    new = blocks.select("instance", F.explode(F.array(row(base + F.col("block"), "LO", F.lit(creator)), row(base + F.col("block") * 256 + element, vr, value))).alias("e"))
    return upsert(elements, new.select("instance", tags.format_tag(F.col("e.tag")).alias("path"), "e.*"))


def upsert(old: DataFrame, new: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """All elements of both, those of ``new`` in place of the same of ``old``.

    A sequence of ``new`` takes the place of one of ``old`` with all that it holds; items that the new one lacks go. Of
    several of one instance and path on the same side, the last by the columns ``order`` of both stands; of equal ones,
    the largest by tag, representation and values.
    """
    sequences = new.where("vr = 'SQ'").groupBy("instance").agg(F.collect_set("path").alias("_sequences"))
    within = F.exists("_sequences", lambda s: F.startswith(F.col("path"), F.concat(s, F.lit("["))))
    old = old.join(sequences, "instance", "left").where(~F.coalesce(within, F.lit(False))).drop("_sequences")
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(rows, ["instance", "path"], ["_new", *order, "tag", "vr", "values"]).drop("_new", *order)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; the largest is kept map side first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def private_elements(elements: DataFrame) -> DataFrame:
    """Private elements with the creator that reserved their block in the same data set or item: (…, creator)."""
    tag, at = F.col("tag"), scope(F.col("path"))
    creators = elements.where(tags.is_private_creator(tag)).groupBy("instance", at.alias("_scope"), tags.group_of(tag).alias("_group"), tags.element_of(tag).alias("_block")).agg(F.max(F.get("values", F.lit(0))).alias("creator"))
    private = elements.where(tags.is_private(tag) & (tags.element_of(tag) >= 0x1000)).withColumns({"_scope": at, "_group": tags.group_of(tag), "_block": F.shiftright(tags.element_of(tag), 8)})
    return private.join(creators, ["instance", "_scope", "_group", "_block"], "left").drop("_scope", "_group", "_block")


def read_until(elements: DataFrame, tag: int, inclusive: bool = False) -> DataFrame:
    """Root elements before ``tag`` (or up to it), with all that they hold.

    Paths are in the order of their root tags, so this is one comparison of ``path`` that reaches a Parquet scan.
    """
    end = tag + 1 if inclusive else tag
    return elements.where(F.col("path") < f"({end >> 16:04X},{end & 0xFFFF:04X})")


#: What an anonymised data set must not hold, and what takes its place.
ANONYMOUS = (
    Operation("replace", "(0010,0010)", "ANONYMOUS"),
    Operation("remove", "(0008,0090)"),
    Operation("empty", "(0010,1010)"),
    Operation("set", "(0012,0062)", "YES", "CS"),
)


def anonymize(elements: DataFrame) -> DataFrame:
    return apply(elements, ANONYMOUS)


#: Declares UTF-8; text is held as such anyway, and so written from then on.
TO_UTF8 = (Operation("set", "(0008,0005)", "ISO_IR 192", "CS"),)


def convert_to_utf8(elements: DataFrame) -> DataFrame:
    return apply(elements, TO_UTF8)
