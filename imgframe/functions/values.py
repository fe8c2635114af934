"""Multi-valued text and numbers: trimming, splitting, conversion, equality, sizes, and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

PADDING = r"[ \x00]+$"
ENDS = r"^[\s\x00]+|[\s\x00]+$"
#: Bytes of one value of each binary kind.
VALUE_BYTES = {"U8": 1, "I16": 2, "U16": 2, "I32": 4, "U32": 4, "F32": 4, "Tags": 4, "I64": 8, "U64": 8, "F64": 8}


def trim_padding(text: Column) -> Column:
    """Without trailing spaces and NULs."""
    return F.regexp_replace(text, PADDING, "")


def to_str(values: Column) -> Column:
    """Values of an array<string>, each without padding, joined by a backslash."""
    return F.array_join(F.transform(values, trim_padding), "\\")


def to_raw_str(values: Column) -> Column:
    return F.array_join(values, "\\")


def to_multi_str(values: Column) -> Column:
    """array<string>: the joined values split at backslashes again."""
    return F.split(to_raw_str(values), r"\\")


def first_text(text: Column) -> Column:
    """The first of backslash-separated values, without white space and NULs at its ends."""
    return F.regexp_replace(F.substring_index(text, "\\", 1), ENDS, "")


def to_int(text: Column) -> Column:
    """BIGINT of the first value; NULL if it is no whole number."""
    first = first_text(text)
    return F.when(first.rlike(r"^[+-]?[0-9]{1,19}$"), first.try_cast("bigint"))


def to_float(text: Column) -> Column:
    """DOUBLE of the first value; NULL if it is no number."""
    first = first_text(text)
    return F.when(first.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), first.try_cast("double"))


#: The range of each kind of whole number.
RANGES = {"u8": (0, 2**8 - 1), "i16": (-(2**15), 2**15 - 1), "u16": (0, 2**16 - 1), "i32": (-(2**31), 2**31 - 1), "u32": (0, 2**32 - 1), "i64": (-(2**63), 2**63 - 1)}


def to_narrow_int(text: Column, kind: str) -> Column:
    """BIGINT of the first value; NULL if it is no whole number of the ``kind``'s range."""
    low, high = RANGES[kind]
    return let(to_int(text), lambda n: F.when(n.between(low, high), n))


def to_float32(text: Column) -> Column:
    """FLOAT of the first value; NULL if it is no number."""
    return to_float(text).cast("float")


def _all(values: Column, one) -> Column:
    """The array with ``one`` applied to each value; NULL if any gives NULL."""
    return let(F.transform(values, one), lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), v))


def to_multi_int(text: Column, kind: str = "i64") -> Column:
    """array<bigint> of all values of a text; NULL if any is none of the ``kind``. An empty text has no values."""
    split = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\\"))
    return _all(split, lambda v: to_narrow_int(v, kind))


def to_multi_float(text: Column) -> Column:
    """array<double> of all values of a text; NULL if any is no number."""
    split = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\\"))
    return _all(split, to_float)


def text_bytes(values: Column) -> Column:
    """Bytes of the joined text, without padding."""
    return F.encode(to_raw_str(values), "UTF-8")


def number_bytes(values: Column, width: int) -> Column:
    """Bytes of whole numbers of ``width`` bytes each, the lowest first."""
    digits = lambda v: F.substring(F.lpad(F.hex(v.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)
    turned = lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.unhex(F.array_join(F.transform(values, lambda v: turned(digits(v))), ""))


def _float_bits(x: Column, width: int) -> Column:
    """The bits of a number as a whole number: sign, exponent and fraction, worked out without rounding."""
    bias, digits = (127, 23) if width == 4 else (1023, 52)
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")
    power = lambda n: F.pow(F.lit(2.0), n)
    exponent = F.when(size < power(guess), guess - 1).when(size / 2 >= power(guess), guess + 1).otherwise(guess)
    small = (size * 2.0 ** ((bias + digits - 1) // 2) * 2.0 ** (bias + digits - 1 - (bias + digits - 1) // 2)).cast("long")
    normal = let(exponent, lambda e: F.when(e >= 1 - bias, (e + bias).cast("long") * (1 << digits) + ((size / power(e) - 1) * 2.0**digits).cast("long")))
    most = ((1 << (8 * width - 1 - digits)) - 1) << digits
    bits = F.when(size == 0, 0).when(size == float("inf"), most).when(size < 2.0 ** (1 - bias), small).otherwise(normal)
    return F.when(F.isnan(x), most + (1 << (digits - 1))).otherwise(bits + F.when(x.cast("string").startswith("-"), F.lit(1 << (8 * width - 1) if width == 4 else -(1 << 63))).otherwise(0))


def float_bytes(values: Column, width: int) -> Column:
    """Bytes of floating-point numbers of 4 or 8 bytes each, the lowest first; doubles are rounded to 4 bytes first."""
    if width not in (4, 8):
        raise ValueError(f"there are no numbers of {width} bytes")
    exact = (lambda v: v.cast("float").cast("double")) if width == 4 else (lambda v: v.cast("double"))
    return number_bytes(F.transform(values, lambda v: let(exact(v), lambda x: _float_bits(x, width))), width)


def strict(values: Column, held: Column, wanted: str) -> Column:
    """The values if they are held as the kind that is wanted, without any conversion; else NULL."""
    return F.when(held == wanted, values)


def extend_as(values: Column, held: Column, kind: str, *more: Column) -> Column:
    """array<string> of values held as text, int or float, with ``more`` of a ``kind`` (text, int or float) at the end.

    Text takes numbers as text; whole numbers take the whole part of others; text onto numbers, and anything onto
    other kinds, gives NULL.
    """
    added = F.array(*more)
    text = F.transform(added, lambda v: v.cast("string"))
    whole = F.transform(added, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("string")) if kind == "float" else text
    real = F.transform(added, lambda v: v.cast("double").cast("string")) if kind != "text" else text
    if kind == "text":
        return F.when(held == "text", F.concat(values, text))
    return F.when(held == "text", F.concat(values, text)).when(held == "int", F.concat(values, whole)).when(held == "float", F.concat(values, real))


def values_equal(a: Column, b: Column) -> Column:
    """Equality of two array<string> values: without padding."""
    return to_str(a) == to_str(b)


def multiplicity(values: Column) -> Column:
    """Number of values; 0 for NULL."""
    return F.coalesce(F.size(values), F.lit(0)).cast("long")


def text_byte_length(values: Column) -> Column:
    """Bytes of joined text, padded to an even number."""
    n = F.octet_length(to_raw_str(values))
    return (n + n % 2).cast("long")


def binary_byte_length(values: Column, kind: str) -> Column:
    n = F.size(values) * VALUE_BYTES[kind]
    return (n + n % 2).cast("long")


def truncate(values: Column, limit: int) -> Column:
    """The first ``limit`` values."""
    return F.slice(values, 1, limit)


def extend(values: Column, *more: Column) -> Column:
    """Values with more at the end, as the kind that they have."""
    return F.concat(F.coalesce(values, F.array()), F.array(*more))


#: The characters that each text type allows.
VALID = {"DA": r"^[0-9\\]*$", "TM": r"^[0-9\\. ]*$", "DT": r"^[0-9\\. +-]*$", "CS": r"^[A-Z0-9\\_ ]*$", "UI": r"^[0-9\\.]*$", "IS": r"^[0-9\\ +-]*$", "DS": r"^[0-9\\ +\-.eE]*$"}


def is_valid(text: Column, vr: str) -> Column:
    """Whether the text has only characters that its type allows; types without a rule allow all."""
    return text.rlike(VALID[vr]) if vr in VALID else text.isNotNull()
