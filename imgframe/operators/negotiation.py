"""Which transfer syntax and presentation context an instance goes by; statuses of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMPLICIT_LE, EXPLICIT_LE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
MAX_PDU, MIN_PDU, DEFAULT_PDU, PDV_HEADER = 131_072, 1_018, 32_762, 6

#: Named failures of a move.
FAILURES = {0xA701: "out of resources: matches", 0xA702: "out of resources: sub-operations", 0xA801: "move destination unknown", 0xA900: "identifier does not match", 0x0122: "class not supported", 0x0211: "unrecognized operation", 0x0212: "mistyped argument", 0x0124: "not authorized"}


#: Rows up to which contexts and supported classes are broadcast; an association has 128 contexts at most.
BROADCAST_ROWS = 100_000

#: Information models that are asked to find.
FIND_MODELS = {"patient": "1.2.840.10008.5.1.4.1.2.1.1", "study": "1.2.840.10008.5.1.4.1.2.2.1", "worklist": "1.2.840.10008.5.1.4.31"}


def small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def find_model(root: Column) -> Column:
    """The identifier of an information model: of the patient's root, the worklist, or else the study's root."""
    return F.when(root == "patient", FIND_MODELS["patient"]).when(root == "worklist", FIND_MODELS["worklist"]).otherwise(FIND_MODELS["study"])


def retrieve_level(root: Column, given: Column) -> Column:
    """The level that a query asks for: its own, or the root's; none for a worklist."""
    return F.coalesce(given, F.when(root == "patient", "PATIENT").when(root != "worklist", "STUDY"))


def association_counts(answered: DataFrame, keys: list[str], needs: list[str]) -> DataFrame:
    """(keys, offered, accepted, pairs) of negotiated contexts: how many, how many accepted, and distinct combinations of ``needs``."""
    return answered.groupBy(*keys).agg(F.count("*").alias("offered"), F.count_if(F.col("reason") == "accepted").alias("accepted"), F.countDistinct(*needs).alias("pairs"))


def answer_roles(roles: Column, accepted: Column) -> Column:
    """array<struct<uid, scu, scp>> of the proposed roles that are answered: those of the classes in ``accepted``; NULL, no answer, for none."""
    own = F.filter(roles, lambda r: F.array_contains(accepted, r.uid))
    return F.when(F.size(own) > 0, own)


def first_supported(offered: Column, supported: Column) -> Column:
    """The first of an offered array that is also in ``supported``; NULL for none."""
    return F.get(F.filter(offered, lambda x: F.array_contains(supported, x)), F.lit(0))


def pick_context(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """``files`` (file, sop_class, ts, codec_free) with context_id of ``contexts`` (context_id, sop_class, ts).

    First of the same class by: the same transfer syntax; where the file's needs no codec, explicit, then implicit
    little endian; ties go to the lesser id. NULL where none fits.
    """
    same = F.col("c.ts") == F.col("f.ts")
    order = F.when(same, 0).when(F.col("f.codec_free") & (F.col("c.ts") == EXPLICIT_LE), 1).when(F.col("f.codec_free") & (F.col("c.ts") == IMPLICIT_LE), 2)
    found = files.alias("f").join(small(contexts).alias("c"), "sop_class").withColumn("_order", order).where("_order IS NOT NULL")
    best = found.groupBy("file").agg(F.min(F.struct("_order", "context_id")).alias("_best")).select("file", F.col("_best.context_id").alias("context_id"))
    return files.join(best, "file", "left")


def negotiate(proposed: DataFrame, supported: DataFrame) -> DataFrame:
    """``proposed`` (…, sop_class, transfer_syntaxes) with the one accepted and a reason.

    ``supported``: (sop_class, syntaxes array).
    """
    joined = proposed.join(small(supported), "sop_class", "left")
    accepted = first_supported(F.col("transfer_syntaxes"), F.col("syntaxes"))
    reason = F.when(F.col("syntaxes").isNull(), "abstract syntax not supported").when(accepted.isNull(), "transfer syntaxes not supported").otherwise("accepted")
    return joined.withColumns({"accepted": accepted, "reason": reason}).drop("syntaxes")


def admit(calling: Column, called: Column, own: str, version: Column, context: Column, application_context: str = "1.2.840.10008.3.1.1.1") -> Column:
    """The reason for which an association is refused; NULL if it isn't."""
    return F.when(version.bitwiseAND(1) == 0, "no reason given").when(context != application_context, "application context name not supported").when(F.trim(called) != own, "called AE title not recognized")


def peer_max_pdu(length: Column) -> Column:
    """What a peer takes: 0 says no limit."""
    return F.when(length == 0, MAX_PDU).otherwise(F.least(length, F.lit(MAX_PDU)))


def status_kind(status: Column) -> Column:
    """success, pending, cancel, warning, or failure."""
    return F.when(status == 0, "success").when(status.isin(0xFF00, 0xFF01), "pending").when(status == 0xFE00, "cancel").when(F.shiftright(status, 12) == 0xB, "warning").otherwise("failure")


def status_text(status: Column) -> Column:
    """The name of a known failure."""
    known = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    return F.try_element_at(known, status)


def transcode_step(source: Column, target: Column) -> Column:
    """What changing from one transfer syntax to another takes; both are registry rows (uid, codec)."""
    direct = F.struct(source.uid, target.uid)
    native = lambda c: c.codec.isin("none", "dataset")
    return (
        F.when(source.uid == target.uid, "nothing")
        .when(native(source) & native(target), "header")
        .when(direct.isNull() | ~source.codec.isin("full", "read", "none", "dataset"), "cannot decode")
        .when(native(target), "decode")
        .when(~target.codec.isin("full", "write"), "cannot encode")
        .when(native(source), "encode")
        .otherwise("decode and encode")
    )
