"""Queries from encoded data sets to arrays and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements as E
from ..operators import images as I
from ..sources import codec
from .registry import query, table


def _row(path, vr, *values):
    return F.struct(F.lit(path).alias("path"), F.lit(E.tag_at(path)).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(*values).cast("array<string>").alias("values"))


def _hex16(values):
    low = lambda v: F.lpad(F.hex(v.cast("long") % 65536), 4, "0")
    return F.array_join(F.transform(values, lambda v: F.lower(F.concat(F.substring(low(v), 3, 2), F.substring(low(v), 1, 2)))), "")


def _image(spark, sf_dir, *more, frames=4, bits=12, tables=None):
    """Each vector is an image of four frames of 4 x 4 samples of 12 bits, encoded and decoded again as a whole file."""
    samples = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 1000).cast("long"))
    each = F.array(
        _row("(0028,0002)", "US", F.lit(1)),
        _row("(0028,0004)", "CS", F.when(F.col("vec_id") % 2 == 0, "MONOCHROME2").otherwise("MONOCHROME1")),
        _row("(0028,0008)", "IS", F.lit(frames)),
        _row("(0028,0010)", "US", F.lit(4)),
        _row("(0028,0011)", "US", F.lit(4)),
        _row("(0028,0100)", "US", F.lit(16)),
        _row("(0028,0101)", "US", F.lit(bits)),
        _row("(0028,0103)", "US", F.lit(0)),
        _row("(7FE0,0010)", "OW", _hex16(samples)),
        *more,
    )
    each = each if tables is None else F.concat(each, tables)
    elements = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("instance"), F.explode(each).alias("e")).select("instance", "e.*")
    files = codec.encode_datasets(elements, syntax=codec.EXPLICIT)
    return codec.decode_datasets(files, "instance", "data", None)


SAMPLES = "list_transform(embedding[f * 16 + 1 : f * 16 + 16], lambda x: floor((x::DOUBLE + 1) * 1000))"


@query(f"""SELECT vec_id AS instance, CAST(f AS BIGINT) AS frame, list_transform({SAMPLES}, lambda v: v * (f + 2) - 1024) AS v FROM embeddings, range(4) r(f)""")
def array_convert(spark, sf_dir):
    """Rescaled samples of each frame, by the frame's own slope and the root's intercept."""
    more = [_row("(0028,1052)", "DS", F.lit("-1024")), _row("(5200,9230)", "SQ")]
    for f in range(4):
        at = f"(5200,9230)[{f}].(0028,9145)"
        more += [_row(at, "SQ"), _row(f"{at}[0].(0028,1053)", "DS", F.lit(f + 2))]
    return I.decode_frames(_image(spark, sf_dir, *more), codec.EXPLICIT).select("instance", "frame", F.col("values").alias("v"))


@query(f"""WITH s AS (SELECT vec_id, f, {SAMPLES} AS s FROM embeddings, range(4) r(f))
SELECT vec_id AS instance, CAST(f AS BIGINT) AS frame, list_transform(s, lambda v: CASE WHEN vec_id % 2 = 0 THEN trunc(CASE WHEN v <= 899.5::DOUBLE - 99.5::DOUBLE THEN 0 WHEN v > 899.5::DOUBLE + 99.5::DOUBLE THEN 65535 ELSE ((v - 899.5::DOUBLE) / 199::DOUBLE + 0.5::DOUBLE) * 65535::DOUBLE END)
ELSE 65535 - trunc(CASE WHEN v <= 899.5::DOUBLE - 99.5::DOUBLE THEN 0 WHEN v > 899.5::DOUBLE + 99.5::DOUBLE THEN 65535 ELSE ((v - 899.5::DOUBLE) / 199::DOUBLE + 0.5::DOUBLE) * 65535::DOUBLE END) END) AS v FROM s""")
def image_mono(spark, sf_dir):
    """Grey images through their window; where the lowest sample is white they are turned round."""
    more = [_row("(0028,1050)", "DS", F.lit("900"), F.lit("1")), _row("(0028,1051)", "DS", F.lit("200"), F.lit("2"))]
    return I.decode_frames(_image(spark, sf_dir, *more), codec.EXPLICIT, "image").select("instance", "frame", F.col("values").alias("v"))


VOI_SQL = f"""WITH s AS (SELECT vec_id, f, list_transform({SAMPLES}, lambda v: 2 * v - 100) AS s FROM embeddings, range(4) r(f)),
t AS (SELECT vec_id, f, list_transform(s, lambda w: CASE WHEN vec_id % 4 < 2 THEN ((CAST(least(greatest(w - 800, 0), 255) AS INTEGER) * 16 + CASE WHEN vec_id % 4 = 1 THEN f ELSE 0 END) % 4096) * 16
  WHEN w <= 899.5::DOUBLE - 99.5::DOUBLE THEN 0 WHEN w > 899.5::DOUBLE + 99.5::DOUBLE THEN 65535 ELSE trunc(((w - 899.5::DOUBLE) / 199::DOUBLE + 0.5::DOUBLE) * 65535::DOUBLE) END) AS s FROM s)
SELECT vec_id AS instance, CAST(f AS BIGINT) AS frame, list_transform(s, lambda x: CAST(CASE WHEN vec_id % 2 = 0 THEN x ELSE 65535 - x END AS DOUBLE)) AS v FROM t"""


@query(VOI_SQL)
def image_voi_tables(spark, sf_dir):
    """Images through a table of the data set, one for all frames or one for each, and through the window where there is none."""
    k = F.col("vec_id") % 4
    entries = lambda f: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lower(F.concat(F.substring(F.lpad(F.hex((i * 16 + f) % 4096), 4, "0"), 3, 2), F.substring(F.lpad(F.hex((i * 16 + f) % 4096), 4, "0"), 1, 2)))), "")
    none = F.array().cast(E.ENTRIES)

    def item(at, f):
        return F.array(_row(f"{at}[0].(0028,3002)", "US", F.lit(256), F.lit(800), F.lit(12)), _row(f"{at}[0].(0028,3006)", "OW", entries(f)))

    shared = F.concat(F.array(_row("(0028,3010)", "SQ")), item("(0028,3010)", 0))
    own = F.concat(F.array(_row("(5200,9230)", "SQ")), *[F.concat(F.array(_row(f"(5200,9230)[{f}].(0028,9132)", "SQ"), _row(f"(5200,9230)[{f}].(0028,9132)[0].(0028,3010)", "SQ")), item(f"(5200,9230)[{f}].(0028,9132)[0].(0028,3010)", f)) for f in range(4)])
    more = [_row("(0028,1050)", "DS", F.lit("900")), _row("(0028,1051)", "DS", F.lit("200")), _row("(0028,1052)", "DS", F.lit("-100")), _row("(0028,1053)", "DS", F.lit("2"))]
    elements = _image(spark, sf_dir, *more, tables=F.when(k == 0, shared).when(k == 1, own).otherwise(none))
    return I.decode_frames(elements, codec.EXPLICIT, "image", I.Options(interpretation="invert")).select("instance", "frame", F.col("values").alias("v"))


@query("""WITH s AS (SELECT vec_id, f, list_transform(list_concat(embedding, embedding[1:8])[f * 12 + 1 : f * 12 + 12], lambda x: floor((x::DOUBLE + 1) * 100)) AS s FROM embeddings, range(6) r(f))
SELECT vec_id AS instance, CAST(f AS BIGINT) AS frame, 'P6' || chr(10) || '2 2' || chr(10) || '255' || chr(10) AS head, list_transform(range(12), lambda i: s[CASE WHEN vec_id % 2 = 0 THEN i ELSE i % 3 * 4 + i // 3 END + 1]) AS v FROM s""")
def image_colour(spark, sf_dir):
    """Colour images of six frames (a vector, and its first components again), by pixel and by plane, and as files."""
    k = F.col("vec_id")
    byte = lambda v: F.lower(F.lpad(F.hex(F.floor((v.cast("double") + 1) * 100).cast("long")), 2, "0"))
    each = F.array(_row("(0028,0002)", "US", F.lit(3)), _row("(0028,0004)", "CS", F.lit("RGB")), _row("(0028,0006)", "US", k % 2), _row("(0028,0008)", "IS", F.lit(6)), _row("(0028,0010)", "US", F.lit(2)), _row("(0028,0011)", "US", F.lit(2)), _row("(0028,0100)", "US", F.lit(8)), _row("(0028,0101)", "US", F.lit(8)), _row("(0028,0103)", "US", F.lit(0)), _row("(7FE0,0010)", "OB", F.array_join(F.transform(F.concat("embedding", F.slice("embedding", 1, 8)), byte), "")))
    elements = table(spark, sf_dir, "embeddings").select(k.alias("instance"), F.explode(each).alias("e")).select("instance", "e.*")
    out = I.decode_frames(elements, codec.EXPLICIT, "image")
    file = I.portable_image(F.col("values"), F.col("rows"), F.col("columns"), F.col("samples"))
    return out.select("instance", "frame", F.decode(F.substring(file, 1, 11), "UTF-8").alias("head"), F.col("values").alias("v"))


@query("""SELECT o_orderkey AS instance, f AS frame, CASE WHEN o_orderkey % 4 = 0 THEN 3.0 WHEN o_orderkey % 4 = 1 AND f = 1 THEN 5.0 WHEN o_orderkey % 4 IN (1, 2) THEN 7.0 ELSE 1.0 END::DOUBLE AS slope, CASE WHEN o_orderkey % 4 = 3 THEN 'LINEAR' ELSE 'SIGMOID' END AS function, CASE WHEN o_orderkey % 4 = 0 THEN [10.0, 20.0][CAST(f + 1 AS INTEGER)] END::DOUBLE AS center FROM orders, range(2) r(f)""")
def functional_groups(spark, sf_dir):
    """Attributes of frames from the root, their own group, the shared group or the default."""
    k = F.col("o_orderkey") % 4
    base, own, shared = [], [], []
    base = [_row("(0028,1053)", "DS", F.lit("3")), _row("(0028,1056)", "CS", F.lit("SIGMOID")), _row("(0028,1050)", "DS", F.lit("10"), F.lit("20"))]
    own = [_row("(5200,9230)[1].(0028,9145)[0].(0028,1053)", "DS", F.lit("5")), _row("(5200,9230)[1].(0028,9132)[0].(0028,1056)", "CS", F.lit("LINEAR_EXACT"))]
    shared = [_row("(5200,9229)[0].(0028,9145)[0].(0028,1053)", "DS", F.lit("7")), _row("(5200,9229)[0].(0028,9132)[0].(0028,1056)", "CS", F.lit("SIGMOID"))]
    each = F.concat(F.array(_row("(0028,0008)", "IS", F.lit(2))), F.when(k == 0, F.array(*base)).when(k == 1, F.array(*own, *shared)).when(k == 2, F.array(*shared)).otherwise(F.array().cast(E.ENTRIES)))
    elements = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), F.explode(each).alias("e")).select("instance", "e.*")
    images = elements.groupBy("instance").agg(F.lit(2).alias("n_frames"))
    return I.frame_attributes(elements, images).select("instance", "frame", "slope", "function", "center")


@query(f"""SELECT vec_id AS instance, CAST(f AS BIGINT) AS frame, {SAMPLES} AS v FROM embeddings, range(4) r(f)""")
def transcode_round_trip(spark, sf_dir):
    """Native frames to run lengths, to deflated ones, and decoded again."""
    packed = I.transcode(_image(spark, sf_dir), codec.EXPLICIT, "1.2.840.10008.1.2.5")
    small = I.transcode(packed, "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.8.1")
    return I.decode_frames(small, "1.2.840.10008.1.2.8.1").select("instance", "frame", F.col("values").alias("v"))


@query("""SELECT vec_id AS instance, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 100)) AS v, CAST(NULL AS VARCHAR) AS slope, '8' AS bits FROM embeddings""")
def image_import(spark, sf_dir):
    """A portable image in place of the data set's own; what described the old one alone is gone."""
    old = _image(spark, sf_dir, _row("(0028,1053)", "DS", F.lit("2")))
    byte = lambda v: F.lpad(F.hex(F.floor((v.cast("double") + 1) * 100).cast("long")), 2, "0")
    files = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("instance"), F.concat(F.encode(F.lit("P5\n8 8\n255\n"), "UTF-8"), F.unhex(F.array_join(F.transform("embedding", byte), ""))).alias("file"))
    new = I.insert_images(old, files, "file")
    found = E.wide(new, {"slope": "(0028,1053)", "bits": "(0028,0101)"})
    return I.decode_frames(new, codec.EXPLICIT).join(found, "instance").select("instance", F.col("values").alias("v"), "slope", "bits")


@query(f"""WITH s AS (SELECT vec_id, f, {SAMPLES} AS s FROM embeddings, range(4) r(f))
SELECT vec_id AS instance, CAST(f AS BIGINT) AS frame, hex(encode('P5' || chr(10) || '4 4' || chr(10) || '65535' || chr(10))) || list_aggregate(list_transform(s, lambda v: right('0000' || upper(printf('%x', CAST(CASE WHEN vec_id % 2 = 0 THEN v ELSE 65535 - v END AS BIGINT))), 4)), 'string_agg', '') AS file FROM s""")
def image_export_deep(spark, sf_dir):
    """Grey images of 16 bits as files, which have the highest byte first."""
    out = I.decode_frames(_image(spark, sf_dir), codec.EXPLICIT, "image", I.Options(voi="identity"))
    return out.select("instance", "frame", F.hex(I.portable_image(F.col("values"), F.col("rows"), F.col("columns"), F.col("samples"), 16)).alias("file"))
