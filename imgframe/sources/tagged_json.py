"""Tagged JSON: an object of ``GGGGEEEE`` keys with a representation and values; and text dumps."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..operators.elements import ELEMENTS
from .codec import BYTES, PIXEL_DATA, VRS, element_batch, sort_key

INTEGERS = ("SL", "SS", "UL", "US", "SV", "UV")
FLOATS = ("FL", "FD")
#: Whole numbers beyond this are written as text.
LARGEST = 2**31 - 1


class JsonError(ValueError):
    """The text is no tagged JSON."""


def _quoted(text: Column) -> Column:
    """A JSON string; what JSON must escape is escaped, control characters among it. NULL for NULL."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""))


def _name(value: Column) -> Column:
    """A name object of the groups that are there."""
    groups = F.split(value, "=")
    each = F.array(*[F.concat(F.lit(f'"{g}":'), _quoted(F.get(groups, F.lit(i)))) for i, g in enumerate(GROUPS)])
    some = F.filter(each, lambda x, i: x.isNotNull() & ((F.get(groups, i) != "") | (i == 0) & (F.size(groups) == 1)))
    return F.concat(F.lit("{"), F.array_join(some, ","), F.lit("}"))


def encode_value(value: Column, vr: Column) -> Column:
    """One value: a number where its representation is numeric, a name object, or a string.

    Whole numbers beyond 32 bits, and what is not finite, are strings; a tag is its eight digits.
    """
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    lost = F.when(F.isnan(number), '"NaN"').when(number > 0, '"inf"').otherwise('"-inf"')
    whole = F.when(finite & (F.abs(number) <= LARGEST), value).otherwise(_quoted(value))
    real = F.when(finite, value).when(number.isNotNull(), lost).otherwise(_quoted(value))
    return F.when(vr.isin(*INTEGERS), whole).when(vr.isin(*FLOATS), real).when(vr == "PN", _name(value)).when(vr == "AT", _quoted(F.regexp_replace(value, "[(),]", ""))).otherwise(_quoted(value))


def encode_element(vr: Column, values: Column) -> Column:
    """``{"vr":…,"Value":[…]}``, ``{"vr":…,"InlineBinary":…}`` of bytes; only vr for an empty value."""
    head = F.concat(F.lit('{"vr":"'), vr, F.lit('"'))
    inline = F.concat(head, F.lit(',"InlineBinary":"'), F.base64(F.unhex(F.array_join(values, ""))), F.lit('"}'))
    listed = F.concat(head, F.lit(',"Value":['), F.array_join(F.transform(values, lambda v: encode_value(v, vr)), ","), F.lit("]}"))
    return F.when(F.size(values) == 0, F.concat(head, F.lit("}"))).when(vr.isin(*sorted(BYTES)), inline).otherwise(listed)


def _open(path: Column, is_sequence: Column) -> Column:
    """The sequences and items that stand open after an element: those of its path, and itself if it is a sequence."""
    inside = F.regexp_extract_all(path, F.lit(r"(\([0-9A-F,]+\)(?=\[)|\[[0-9]+\])"))
    return F.when(path.contains("["), inside).otherwise(F.array().cast("array<string>")) if is_sequence is None else F.concat(_open(path, None), F.when(is_sequence, F.array(F.element_at(F.split(path, r"\."), -1))).otherwise(F.array().cast("array<string>")))


def _closed(held: Column, kept: Column) -> Column:
    """The text that closes all that is open but the first ``kept``: items, and sequences with their list if they have one."""
    ends = F.transform(held, lambda x, i: F.when(x.startswith("["), "}").when(i == F.size(held) - 1, "}").otherwise("]}"))
    return F.array_join(F.reverse(F.slice(ends, kept + 1, F.greatest(F.size(held) - kept, F.lit(0)))), "")


def _opened(wanted: Column, held: Column, kept: Column) -> Column:
    """The text that opens sequences and items after the first ``kept``; items that have no element are empty objects."""
    number = lambda x: F.regexp_extract(x, r"([0-9]+)", 1).cast("int")

    def step(x: Column, i: Column) -> Column:
        before = F.when((i == kept) & (F.size(held) > kept), number(F.get(held, kept)))  # of the item that has just been closed
        listed = F.when((i == kept) & (F.size(held) == kept), ',"Value":[').otherwise("")  # the first item of an open sequence
        item = F.when(before.isNotNull(), F.concat(F.repeat(F.lit(",{}"), number(x) - before - 1), F.lit(",{"))).otherwise(F.concat(listed, F.repeat(F.lit("{},"), number(x)), F.lit("{")))
        sequence = F.concat(F.when(i == kept, ",").otherwise(""), F.lit('"'), F.translate(x, "(),", ""), F.lit('":{"vr":"SQ","Value":['))
        return F.when(x.startswith("["), item).otherwise(sequence)

    return F.array_join(F.slice(F.transform(wanted, step), kept + 1, F.greatest(F.size(wanted) - kept, F.lit(0))), "")


def to_json(elements: DataFrame, depth: int | None = None) -> DataFrame:
    """(instance, json): the elements of each instance in the order of their tags, those of items within their sequences.

    Elements are put in the order of their paths, once. Each gives its own text, after what closes and opens between the
    element before it and itself; these texts joined are the object. ``depth`` 0 says that no sequence has items.
    Encapsulated pixel data is left out, and rows without a path; an item without elements is an empty object.
    """
    rows = elements.where(~((F.col("tag") == PIXEL_DATA) & (F.size("values") > 1)) & F.col("path").isNotNull()).select("instance", "path", "vr", "values")
    flat, path = depth == 0, F.col("path")
    ordered = Window.partitionBy("instance").orderBy(path if flat else sort_key(path))
    key = F.translate(F.element_at(F.split(path, r"\."), -1), "(),", "")
    whole = F.concat(F.lit('"'), key, F.lit('":'), encode_element(F.col("vr"), F.col("values")))
    first = F.row_number().over(ordered)
    if flat:
        rows = rows.select("instance", first.alias("n"), whole.alias("text"))
        return rows.groupBy("instance").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), ","), F.lit("}")).alias("json"))
    before = F.lag("path").over(ordered)
    rows = rows.withColumns({"n": first, "before": before, "before_vr": F.lag("vr").over(ordered), "after": F.lead("path").over(ordered)})
    is_sequence = (F.col("vr") == "SQ") | F.coalesce(F.startswith("after", F.concat(path, F.lit("["))), F.lit(False))
    was_sequence = (F.col("before_vr") == "SQ") | F.startswith(path, F.concat(F.col("before"), F.lit("[")))
    nested = path.contains("[") | F.coalesce(F.col("before").contains("[") | was_sequence, F.lit(False))
    rows = rows.withColumns({"held": F.when(nested & F.col("before").isNotNull(), _open(F.col("before"), was_sequence)).when(nested, F.array().cast("array<string>")), "wanted": F.when(nested, _open(path, None)), "is_sequence": is_sequence})
    same = F.array_position(F.zip_with("held", "wanted", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    rows = rows.withColumn("kept", F.when(same > 0, same - 1).otherwise(F.least(F.size("held"), F.size("wanted"))).cast("int"))
    between = F.when(~nested, F.when(F.col("n") == 1, "").otherwise(",")).otherwise(
        F.concat(_closed(F.col("held"), F.col("kept")), F.when(F.col("n") == 1, F.regexp_replace(_opened(F.col("wanted"), F.col("held"), F.col("kept")), "^,", "")).otherwise(_opened(F.col("wanted"), F.col("held"), F.col("kept"))), F.when((F.size("wanted") == F.col("kept")) & (F.col("n") > 1), ",").otherwise(""))
    )
    head = F.concat(F.lit('"'), key, F.lit('":{"vr":"'), F.col("vr"), F.lit('"'))
    last = F.when(F.col("after").isNull(), F.when(is_sequence | path.contains("["), _closed(_open(path, is_sequence), F.lit(0))).otherwise(""))
    rows = rows.select("instance", "n", F.concat(between, F.when(F.col("is_sequence"), head).otherwise(whole), F.coalesce(last, F.lit(""))).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return rows.groupBy("instance").agg(F.concat(F.lit("{"), F.array_join(texts, ""), F.lit("}")).alias("json"))


#: The groups of a name, and the fields of an element.
GROUPS = ("Alphabetic", "Ideographic", "Phonetic")
FIELDS = frozenset(("vr", "Value", "InlineBinary", "BulkDataURI"))


def _text(value: object, vr: str) -> str:
    """One JSON value as an element's text."""
    if value is None:
        return ""
    if isinstance(value, dict):
        return "=".join(value.get(g) or "" for g in GROUPS).rstrip("=")
    if isinstance(value, float) and vr not in FLOATS and value.is_integer():
        return str(int(value))
    if vr == "AT" and isinstance(value, str) and len(value) == 8:
        return f"({value[:4]},{value[4:]})".upper()
    return value if isinstance(value, str) else repr(value)


def read_object(held: dict, prefix: str = "", strict: bool = False) -> Iterator[tuple[str, int, str, list[str], str | None]]:
    """(path, tag, vr, values, link) of an object's elements and of those in its items.

    A representation that is missing or unknown is UN. With ``strict`` what no element has is an error: another field,
    no representation, or values of UN.
    """
    for key, element in held.items():
        if len(key) != 8 or not isinstance(element, dict):
            raise JsonError(f"{key!r} is no element")
        tag = int(key, 16)
        path = f"{prefix}({key[:4]},{key[4:]})".upper() if not prefix else f"{prefix}({key[:4].upper()},{key[4:].upper()})"
        vr = element.get("vr")
        if strict and (set(element) - FIELDS or vr is None or vr == "UN" and "Value" in element):
            raise JsonError(f"{path} has a field too many, no vr, or values of UN")
        vr = vr if vr in VRS else "UN"
        values = element.get("Value") or []
        if vr == "SQ":
            yield path, tag, vr, [], None
            for n, item in enumerate(values):
                yield from read_object(item or {}, f"{path}[{n}].", strict)
        elif "InlineBinary" in element:
            yield path, tag, vr, [base64.b64decode(element["InlineBinary"]).hex()], None
        else:
            yield path, tag, vr, [_text(v, vr) for v in values], element.get("BulkDataURI")


def from_json(rows: DataFrame, instance: str = "instance", column: str = "json", strict: bool = False, links: bool = False) -> DataFrame:
    """Elements of tagged JSON, nested ones too: numbers as text, names with their groups joined by =, bytes as hex.

    An element that only links to bulk data has no values; ``links`` gives these as (instance, path, link) instead.
    Text that is no tagged JSON gives one row with a NULL path, or with ``strict`` is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(key, *e) for e in read_object(json.loads(text) if text else {}, strict=strict)]
                except (ValueError, AttributeError, TypeError) as e:
                    if strict:
                        raise
                    out.append((key, None, None, None, None, None))
            if links:
                linked = [r for r in out if r[5] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in linked], k) for i, k in ((0, pa.int64()), (1, pa.string()), (5, pa.string()))], ["instance", "path", "link"])
            else:
                yield element_batch([r[:5] for r in out])

    return rows.select(F.col(instance).cast("long"), F.col(column)).mapInArrow(run, "instance long, path string, link string" if links else ELEMENTS)


def dump_line(tag: Column, alias: Column, vr: Column, values: Column, width: int = 80) -> Column:
    """``TAG ALIAS VR (VM, LEN bytes): VALUE``; control characters show as points, long values are cut."""
    joined = F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r"[\x00-\x1F\x7F]", "."), F.lit('"'))), ", ")
    shown = F.when(F.size(values) > 1, F.concat(F.lit("["), joined, F.lit("]"))).otherwise(joined)
    n = F.octet_length(F.array_join(values, "\\"))
    cut = F.when(F.char_length(shown) > width, F.concat(F.substring(shown, 1, width - 1), F.lit("…"))).otherwise(shown)
    return F.concat(tags.format_tag(tag), F.lit(" "), F.rpad(F.coalesce(alias, F.lit("«unknown»")), 24, " "), F.lit(" "), vr, F.lit(" ("), F.size(values), F.lit(", "), n + n % 2, F.lit(" bytes): "), cut)
