"""Transforms of pixel samples as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale(x: Column, slope: float | Column = 1.0, intercept: float | Column = 0.0) -> Column:
    return x * slope + intercept


def window_linear(x: Column, width: Column, center: Column, ymax: float) -> Column:
    """LINEAR: ramp of ``width`` (1 at least) about ``center - 0.5``, from 0 to ``ymax``."""
    w = F.greatest(width, F.lit(1.0))
    half = (w - 1) / 2
    c = center - 0.5
    ramp = ((x - c) / F.nullif(w - 1, F.lit(0.0)) + 0.5) * ymax
    return F.when(x <= c - half, 0.0).when(x > c + half, ymax).otherwise(ramp)


def window_linear_exact(x: Column, width: Column, center: Column, ymax: float) -> Column:
    w = F.greatest(width, F.lit(0.0))
    ramp = ((x - center) / F.nullif(w, F.lit(0.0)) + 0.5) * ymax
    return F.when(x <= center - w / 2, 0.0).when(x > center + w / 2, ymax).otherwise(ramp)


def window_sigmoid(x: Column, width: Column, center: Column, ymax: float) -> Column:
    return ymax / (1 + F.exp(-4 * (x - center) / F.greatest(width, F.lit(1.0))))


def normalize(x: Column, low: Column, high: Column, ymax: float) -> Column:
    """LINEAR window over the whole of low to high."""
    return window_linear(x, high - low, (low + high) / 2, ymax)


def lut_index(sample: Column, bits: int) -> Column:
    """The entry of a table of 2^bits: only the low bits count."""
    return sample.bitwiseAND((1 << bits) - 1)


def stored_value(index: Column, bits: int, signed: bool) -> Column:
    """The sample that an entry stands for; the upper half is negative if signed."""
    return F.when(index >= (1 << (bits - 1)), index - (1 << bits)).otherwise(index) if signed else index


def explicit_lut(x: Column, first: int, table: Column, shift: int = 0) -> Column:
    """A table's entry for a rounded sample, held at both ends; shifted left by ``shift`` bits."""
    at = F.least(F.greatest(F.round(x).cast("int") - first, F.lit(0)), F.size(table) - 1)
    return F.shiftleft(F.get(table, at), shift)


def ybr_to_rgb(y: Column, cb: Column, cr: Column, half: int = 128, top: int = 255) -> list[Column]:
    """Red, green and blue of full-range luminance and colour differences: the inverse of the published transform."""
    b, r = cb - half, cr - half
    whole = lambda c: F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(top)).cast("int")
    return [whole(y + 1.402 * r), whole(y - (0.114 * 1.772 / 0.587) * b - (0.299 * 1.402 / 0.587) * r), whole(y + 1.772 * b)]


def interleave(planes: Column, samples: int) -> Column:
    """Values by pixel of an array that has them plane by plane."""
    size = (F.size(planes) / samples).cast("int")
    return F.transform(planes, lambda _, i: F.get(planes, (i % samples) * size + F.floor(i / samples).cast("int")))


def frame(values: Column, length: int, number: Column) -> Column:
    """Frame ``number`` (from 0) of an array of frames; an error past the end."""
    return F.when((number + 1) * length <= F.size(values), F.slice(values, number * length + 1, length)).otherwise(F.raise_error(F.lit("frame out of range")).cast("array<double>"))


def invert(x: Column, ymax: int) -> Column:
    """For images whose lowest sample is white."""
    return ymax - x


def signed_to_unsigned(x: Column) -> Column:
    return x + 0x8000


def narrow(x: Column) -> Column:
    """16 bits to 8."""
    return F.shiftright(x, 8)


def widen(x: Column) -> Column:
    """8 bits to 16."""
    return F.shiftleft(x, 8) + x


def expand_bits(byte: Column) -> Column:
    """array<int> of eight samples 0 or 255, the lowest bit first."""
    return F.array(*[F.shiftright(byte, i).bitwiseAND(1) * 255 for i in range(8)])


def lut_descriptor(values: Column, entries: Column) -> Column:
    """struct<n, first, bits> of a table's descriptor; NULL unless it has three values, entries, 16 bits at most, and as many ``entries`` of data as it says."""
    n, first, bits = (F.get(values, F.lit(i)).cast("int") for i in range(3))
    good = (F.size(values) == 3) & (n > 0) & bits.between(0, 16) & (entries == n)
    return F.when(good, F.struct(n.alias("n"), first.alias("first"), bits.alias("bits")))


#: Kinds of images.
INTERPRETATIONS = ("MONOCHROME1", "MONOCHROME2", "PALETTE COLOR", "RGB", "YBR_FULL", "YBR_FULL_422", "YBR_PARTIAL_420", "YBR_ICT", "YBR_RCT", "XYB")


def interpretation(text: Column) -> Column:
    """The kind of an image, padding ignored; NULL for one that is not known."""
    kind = F.regexp_replace(text, r"[ \x00]+$", "")
    return F.when(kind.isin(*INTERPRETATIONS), kind)


def is_monochrome(text: Column) -> Column:
    return F.coalesce(interpretation(text).isin("MONOCHROME1", "MONOCHROME2"), F.lit(False))
