"""Dictionary lookups of attributes, with fallbacks, and of transfer syntaxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.values import trim_padding

#: Rows up to which a dictionary is broadcast (under 200 bytes each); a larger one is shuffled.
BROADCAST_ROWS = 100_000

#: Fixed values: (tag, mask of the bits that count, alias, value representation).
SEED = (
    (0x00000000, 0xFFFFFFFF, "CommandGroupLength", "UL"),
    (0x00000900, 0xFFFFFFFF, "Status", "US"),
    (0x00020000, 0xFFFFFFFF, "FileMetaInformationGroupLength", "UL"),
    (0x00020010, 0xFFFFFFFF, "TransferSyntaxUID", "UI"),
    (0x00080005, 0xFFFFFFFF, "SpecificCharacterSet", "CS"),
    (0x00080008, 0xFFFFFFFF, "ImageType", "CS"),
    (0x00080020, 0xFFFFFFFF, "StudyDate", "DA"),
    (0x00080021, 0xFFFFFFFF, "SeriesDate", "DA"),
    (0x00080052, 0xFFFFFFFF, "QueryRetrieveLevel", "CS"),
    (0x00080060, 0xFFFFFFFF, "Modality", "CS"),
    (0x00080061, 0xFFFFFFFF, "ModalitiesInStudy", "CS"),
    (0x00080090, 0xFFFFFFFF, "ReferringPhysicianName", "PN"),
    (0x00100010, 0xFFFFFFFF, "PatientName", "PN"),
    (0x00101010, 0xFFFFFFFF, "PatientAge", "AS"),
    (0x00189074, 0xFFFFFFFF, "FrameAcquisitionDateTime", "DT"),
    (0x00200013, 0xFFFFFFFF, "InstanceNumber", "IS"),
    (0x00203100, 0xFFFFFF00, "SourceImageIDs", "CS"),
    (0x00283010, 0xFFFFFFFF, "VOILUTSequence", "SQ"),
    (0x0040A168, 0xFFFFFFFF, "ConceptCodeSequence", "SQ"),
    (0x0040A730, 0xFFFFFFFF, "ContentSequence", "SQ"),
    (0x52009230, 0xFFFFFFFF, "PerFrameFunctionalGroupsSequence", "SQ"),
    (0x60003000, 0xFF00FFFF, "OverlayData", "Ox"),
    (0x7FE00003, 0xFFFFFFFF, "EncapsulatedPixelDataValueTotalLength", "UV"),
    (0x7FE00010, 0xFFFFFFFF, "PixelData", "Px"),
)

ALIASES = {alias: tag for tag, _, alias, _ in SEED}


def dictionary(spark: SparkSession, entries=SEED) -> DataFrame:
    """(tag, mask, alias, vr); give more entries for a larger dictionary."""
    return spark.createDataFrame(list(entries), "tag long, mask long, alias string, vr string")


def _small(entries: DataFrame) -> DataFrame:
    return F.broadcast(entries) if entries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else entries


def lookup(rows: DataFrame, entries: DataFrame, tag: str = "tag") -> DataFrame:
    """``rows`` with alias and vr of column ``tag``: exact, then repeating groups, then repeating elements, private creators, group lengths; else NULL."""
    out = rows
    for mask, name in ((0xFFFFFFFF, "exact"), (0xFF00FFFF, "group"), (0xFFFFFF00, "element")):
        part = entries.where(F.col("mask") == mask).select(F.col("tag").alias(f"_{name}"), F.struct("alias", "vr").alias(f"_{name}_entry"))
        out = out.join(_small(part), F.col(tag).bitwiseAND(F.lit(mask)) == F.col(f"_{name}"), "left").drop(f"_{name}")
    t = F.col(tag)
    entry = lambda alias, vr: F.struct(F.lit(alias).alias("alias"), F.lit(vr).alias("vr"))
    found = F.coalesce("_exact_entry", "_group_entry", "_element_entry", F.when(tags.is_private_creator(t), entry("PrivateCreator", "LO")), F.when(tags.is_group_length(t), entry("GenericGroupLength", "UL")))
    return out.withColumn("_found", found).drop("_exact_entry", "_group_entry", "_element_entry").select("*", "_found.alias", "_found.vr").drop("_found")


def lookup_name(rows: DataFrame, entries: DataFrame, name: str = "name") -> DataFrame:
    """``rows`` with the tag of column ``name``: a tag text first, else an alias (case counts)."""
    part = entries.select(F.col("alias").alias(name), F.col("tag").alias("_tag"))
    return rows.join(_small(part), name, "left").withColumn("tag", F.coalesce(tags.parse_tag(F.col(name)), "_tag")).drop("_tag")


def relaxed_vr(vr: Column) -> Column:
    """The one representation taken for a virtual one."""
    return F.when(vr == "Xs", "US").when(vr.isin("Ox", "Px", "Lt"), "OW").otherwise(vr)


def exact_vr(vr: Column) -> Column:
    """NULL for a virtual representation."""
    return F.when(~vr.isin("Xs", "Ox", "Px", "Lt"), vr)


#: Fixed values: (uid, name, codec); codec: none, dataset, dataset_stub, full, read, write or stub.
TRANSFER_SYNTAXES = (
    ("1.2.840.10008.1.2", "Implicit VR Little Endian", "none"),
    ("1.2.840.10008.1.2.1", "Explicit VR Little Endian", "none"),
    ("1.2.840.10008.1.2.2", "Explicit VR Big Endian", "none"),
    ("1.2.840.10008.1.2.1.98", "Encapsulated Uncompressed Explicit VR Little Endian", "full"),
    ("1.2.840.10008.1.2.1.99", "Deflated Explicit VR Little Endian", "dataset"),
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline (Process 1)", "stub"),
    ("1.2.840.10008.1.2.4.51", "JPEG Extended (Process 2 & 4)", "stub"),
    ("1.2.840.10008.1.2.4.57", "JPEG Lossless, Non-Hierarchical (Process 14)", "stub"),
    ("1.2.840.10008.1.2.4.70", "JPEG Lossless, Non-Hierarchical, First-Order Prediction", "stub"),
    ("1.2.840.10008.1.2.4.80", "JPEG-LS Lossless Image Compression", "stub"),
    ("1.2.840.10008.1.2.4.81", "JPEG-LS Lossy (Near-Lossless) Image Compression", "stub"),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000 Image Compression (Lossless Only)", "stub"),
    ("1.2.840.10008.1.2.4.91", "JPEG 2000 Image Compression", "stub"),
    ("1.2.840.10008.1.2.4.92", "JPEG 2000 Part 2 Multi-component Image Compression (Lossless Only)", "stub"),
    ("1.2.840.10008.1.2.4.93", "JPEG 2000 Part 2 Multi-component Image Compression", "stub"),
    ("1.2.840.10008.1.2.4.94", "JPIP Referenced", "stub"),
    ("1.2.840.10008.1.2.4.95", "JPIP Referenced Deflate", "dataset"),
    ("1.2.840.10008.1.2.4.100", "MPEG2 Main Profile / Main Level", "stub"),
    ("1.2.840.10008.1.2.4.100.1", "Fragmentable MPEG2 Main Profile / Main Level", "stub"),
    ("1.2.840.10008.1.2.4.101", "MPEG2 Main Profile / High Level", "stub"),
    ("1.2.840.10008.1.2.4.101.1", "Fragmentable MPEG2 Main Profile / High Level", "stub"),
    ("1.2.840.10008.1.2.4.102", "MPEG-4 AVC/H.264 High Profile / Level 4.1", "stub"),
    ("1.2.840.10008.1.2.4.102.1", "Fragmentable MPEG-4 AVC/H.264 High Profile / Level 4.1", "stub"),
    ("1.2.840.10008.1.2.4.103", "MPEG-4 AVC/H.264 BD-Compatible High Profile / Level 4.1", "stub"),
    ("1.2.840.10008.1.2.4.103.1", "Fragmentable MPEG-4 AVC/H.264 BD-Compatible High Profile / Level 4.1", "stub"),
    ("1.2.840.10008.1.2.4.104", "MPEG-4 AVC/H.264 High Profile / Level 4.2 For 2D Video", "stub"),
    ("1.2.840.10008.1.2.4.104.1", "Fragmentable MPEG-4 AVC/H.264 High Profile / Level 4.2 For 2D Video", "stub"),
    ("1.2.840.10008.1.2.4.105", "MPEG-4 AVC/H.264 High Profile / Level 4.2 For 3D Video", "stub"),
    ("1.2.840.10008.1.2.4.105.1", "Fragmentable MPEG-4 AVC/H.264 High Profile / Level 4.2 For 3D Video", "stub"),
    ("1.2.840.10008.1.2.4.106", "MPEG-4 AVC/H.264 Stereo High Profile / Level 4.2", "stub"),
    ("1.2.840.10008.1.2.4.106.1", "Fragmentable MPEG-4 AVC/H.264 Stereo High Profile / Level 4.2", "stub"),
    ("1.2.840.10008.1.2.4.107", "HEVC/H.265 Main Profile / Level 5.1", "stub"),
    ("1.2.840.10008.1.2.4.108", "HEVC/H.265 Main 10 Profile / Level 5.1", "stub"),
    ("1.2.840.10008.1.2.4.110", "JPEG XL Lossless", "stub"),
    ("1.2.840.10008.1.2.4.111", "JPEG XL Recompression", "stub"),
    ("1.2.840.10008.1.2.4.112", "JPEG XL", "stub"),
    ("1.2.840.10008.1.2.4.201", "High-Throughput JPEG 2000 Image Compression (Lossless Only)", "stub"),
    ("1.2.840.10008.1.2.4.202", "High-Throughput JPEG 2000 with RPCL Options Image Compression (Lossless Only)", "stub"),
    ("1.2.840.10008.1.2.4.203", "High-Throughput JPEG 2000 Image Compression", "stub"),
    ("1.2.840.10008.1.2.4.204", "JPIP HTJ2K Referenced", "stub"),
    ("1.2.840.10008.1.2.4.205", "JPIP HTJ2K Referenced Deflate", "dataset"),
    ("1.2.840.10008.1.2.5", "RLE Lossless", "full"),
    ("1.2.840.10008.1.2.7.1", "SMPTE ST 2110-20 Uncompressed Progressive Active Video", "stub"),
    ("1.2.840.10008.1.2.7.2", "SMPTE ST 2110-20 Uncompressed Interlaced Active Video", "stub"),
    ("1.2.840.10008.1.2.7.3", "SMPTE ST 2110-30 PCM Digital Audio", "stub"),
    ("1.2.840.10008.1.2.8.1", "Deflated Image Frame Compression", "full"),
)

#: Which codecs a more capable one replaces in a registry.
REPLACES = {"dataset": ("dataset_stub",), "read": ("stub",), "write": ("stub",), "full": ("stub", "read", "write")}

#: Fixed values: (uid, keyword, name, kind) of identifiers; give more to ``uid_dictionary``.
UIDS = (
    ("1.2.840.10008.1.1", "Verification", "Verification SOP Class", "sop_class"),
    ("1.2.840.10008.1.20.1", "StorageCommitmentPushModel", "Storage Commitment Push Model SOP Class", "sop_class"),
    ("1.2.840.10008.1.3.10", "MediaStorageDirectoryStorage", "Media Storage Directory Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.1", "ComputedRadiographyImageStorage", "Computed Radiography Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.1.1", "DigitalXRayImageStorageForPresentation", "Digital X-Ray Image Storage - For Presentation", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.1.2", "DigitalMammographyXRayImageStorageForPresentation", "Digital Mammography X-Ray Image Storage - For Presentation", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.2", "CTImageStorage", "CT Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.2.1", "EnhancedCTImageStorage", "Enhanced CT Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.3.1", "UltrasoundMultiFrameImageStorage", "Ultrasound Multi-frame Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.4", "MRImageStorage", "MR Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.4.1", "EnhancedMRImageStorage", "Enhanced MR Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.6.1", "UltrasoundImageStorage", "Ultrasound Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.7", "SecondaryCaptureImageStorage", "Secondary Capture Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.12.1", "XRayAngiographicImageStorage", "X-Ray Angiographic Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.20", "NuclearMedicineImageStorage", "Nuclear Medicine Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.66.4", "SegmentationStorage", "Segmentation Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.77.1.6", "VLWholeSlideMicroscopyImageStorage", "VL Whole Slide Microscopy Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.88.11", "BasicTextSRStorage", "Basic Text SR Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.104.1", "EncapsulatedPDFStorage", "Encapsulated PDF Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.128", "PositronEmissionTomographyImageStorage", "Positron Emission Tomography Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.481.1", "RTImageStorage", "RT Image Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.481.2", "RTDoseStorage", "RT Dose Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.481.3", "RTStructureSetStorage", "RT Structure Set Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.1.481.5", "RTPlanStorage", "RT Plan Storage", "sop_class"),
    ("1.2.840.10008.5.1.4.1.2.1.1", "PatientRootQueryRetrieveInformationModelFind", "Patient Root Query/Retrieve Information Model - FIND", "sop_class"),
    ("1.2.840.10008.5.1.4.1.2.1.2", "PatientRootQueryRetrieveInformationModelMove", "Patient Root Query/Retrieve Information Model - MOVE", "sop_class"),
    ("1.2.840.10008.5.1.4.1.2.2.1", "StudyRootQueryRetrieveInformationModelFind", "Study Root Query/Retrieve Information Model - FIND", "sop_class"),
    ("1.2.840.10008.5.1.4.1.2.2.2", "StudyRootQueryRetrieveInformationModelMove", "Study Root Query/Retrieve Information Model - MOVE", "sop_class"),
    ("1.2.840.10008.5.1.4.31", "ModalityWorklistInformationModelFind", "Modality Worklist Information Model - FIND", "sop_class"),
)


def uid_dictionary(spark: SparkSession, more: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(uid, keyword, name, kind): identifiers known here, those of transfer syntaxes (without keyword), and ``more``."""
    syntaxes = [(uid, None, name, "transfer_syntax") for uid, name, _ in TRANSFER_SYNTAXES]
    return spark.createDataFrame([*UIDS, *syntaxes, *more], "uid string, keyword string, name string, kind string")


def lookup_uid(rows: DataFrame, column: str, entries: DataFrame | None = None) -> DataFrame:
    """``rows`` with uid, keyword, name and kind of the entry whose identifier (padding ignored) or keyword is in ``column``; NULL for unknown ones."""
    entries = uid_dictionary(rows.sparkSession) if entries is None else entries
    entry = F.struct("uid", "keyword", "name", "kind").alias("_entry")
    keys = entries.select(F.col("uid").alias("_key"), entry).unionByName(entries.where("keyword IS NOT NULL").select(F.col("keyword").alias("_key"), entry))
    return rows.join(_small(keys), trim_padding(F.col(column)) == F.col("_key"), "left").select(*rows.columns, "_entry.*")


def register(registry: DataFrame, more: DataFrame) -> DataFrame:
    """(uid, name, codec): a registry with ``more`` in it; what is there is replaced only by what can do strictly more."""
    better = F.lit(False)
    for codec, lesser in REPLACES.items():
        better = better | (F.col("m.codec") == codec) & F.col("r.codec").isin(*lesser)
    both = registry.select("uid", "name", "codec").alias("r").join(more.select("uid", "name", "codec").dropDuplicates(["uid"]).alias("m"), F.col("r.uid") == F.col("m.uid"), "full")
    take = F.col("r.uid").isNull() | F.coalesce(better, F.lit(False))
    return both.select(*[F.when(take, F.col(f"m.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in ("uid", "name", "codec")])


def transfer_syntaxes(spark: SparkSession) -> DataFrame:
    """(uid, name, codec) with what each can do."""
    return capabilities(spark.createDataFrame(list(TRANSFER_SYNTAXES), "uid string, name string, codec string"))


def capabilities(registry: DataFrame) -> DataFrame:
    """A registry (uid, name, codec) with what each syntax can do."""
    codec = F.col("codec")
    return registry.select(
        "uid",
        "name",
        "codec",
        codec.isin("none", "dataset", "full").alias("fully_supported"),
        (codec == "none").alias("codec_free"),
        (codec == "dataset_stub").alias("unsupported"),
        codec.isin("dataset_stub", "stub").alias("unsupported_pixels"),
        codec.isin("full", "read", "write", "stub").alias("encapsulated"),
        codec.isin("none", "dataset", "full", "read").alias("can_decode_all"),
        (codec != "dataset_stub").alias("can_decode_dataset"),
    )


def lookup_transfer_syntax(rows: DataFrame, uid: str = "uid", registry: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of the registry for column ``uid``, padding ignored; NULL for unknown ones."""
    registry = (transfer_syntaxes(rows.sparkSession) if registry is None else registry).withColumnRenamed("uid", "_uid")
    return rows.join(_small(registry), trim_padding(F.col(uid)) == F.col("_uid"), "left").drop("_uid")
