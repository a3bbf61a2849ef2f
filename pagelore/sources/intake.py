"""Uploads: bounded binary scans, declared types, signatures, adapter manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 20 * 1024 * 1024

#: Extension, media type, kind and the hex of the first bytes.
MEDIA_TYPES = (
    ("pdf", "application/pdf", "pdf", "25504446"),
    ("png", "image/png", "image", "89504E470D0A1A0A"),
    ("jpg", "image/jpeg", "image", "FFD8FF"),
    ("jpeg", "image/jpeg", "image", "FFD8FF"),
    ("tif", "image/tiff", "image", "49492A00|4D4D002A"),
    ("tiff", "image/tiff", "image", "49492A00|4D4D002A"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", "504B0304"),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx", "504B0304"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx", "504B0304"),
)


def media_types(spark: SparkSession) -> DataFrame:
    """The fixed table of kinds: extension, media_type, kind, signature. A few rows, so joins broadcast it."""
    return spark.createDataFrame(MEDIA_TYPES, "extension string, media_type string, kind string, signature string")


def read_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, length and content of the files below `path`; larger files keep a null content and a reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= max_bytes
    return files.select("path", "length", F.when(fits, F.col("content")).alias("content"), F.when(~fits, "too_large").when(F.col("length") == 0, "empty").alias("reason"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([0-9A-Za-z]+)$", 1))


def declared_kind(df: DataFrame, name: str, media_type: str | None = None) -> DataFrame:
    """Adds kind and declared (accepted, unknown_extension, type_mismatch) from name and media type.

    A null or generic media type (application/octet-stream) is no contradiction.
    """
    kinds = F.broadcast(media_types(df.sparkSession).select(F.col("extension").alias("__ext"), F.col("media_type").alias("__type"), "kind"))
    joined = df.withColumn("__ext", extension(F.col(name))).join(kinds, "__ext", "left")
    told = F.lower(F.trim(F.substring_index(F.col(media_type), ";", 1))) if media_type else F.lit(None).cast("string")
    generic = told.isNull() | told.isin("", "application/octet-stream")
    verdict = F.when(F.col("kind").isNull(), "unknown_extension").when(generic | (told == F.col("__type")), "accepted").otherwise("type_mismatch")
    return joined.withColumn("declared", verdict).drop("__ext", "__type")


def signature_matches(content: Column, name: Column, spark: SparkSession) -> Column:
    """Whether the first bytes fit the extension; null content gives null."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(False)
    for ext, _, _, signature in MEDIA_TYPES:
        fits = F.lit(False)
        for one in signature.split("|"):
            fits = fits | F.startswith(head, F.lit(one))
        out = F.when(extension(name) == ext, fits).otherwise(out)
    return F.when(content.isNotNull(), out)


def adapter_issues(manifests: DataFrame) -> DataFrame:
    """Conformance of adapter manifests: name, version, extensions, media_types, max_bytes -> sorted issues.

    An extension or media type that two adapters claim is an issue of both.
    """
    claims = manifests.select("name", F.explode(F.array_union("extensions", "media_types")).alias("claim")).distinct()
    shared = claims.groupBy("claim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("claim")
    disputed = claims.join(shared, "claim", "left_semi").select("name").distinct().withColumn("__disputed", F.lit(True))
    issues = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name_missing"),
                F.when(~F.coalesce(F.col("version").rlike(r"^\d+\.\d+(?:\.\d+)?$"), F.lit(False)), "version_malformed"),
                F.when(F.coalesce(F.size("extensions"), F.lit(0)) == 0, "extensions_missing"),
                F.when(F.exists("extensions", lambda e: (e != F.lower(e)) | F.startswith(e, F.lit("."))), "extension_form"),
                F.when(~F.coalesce(F.col("max_bytes").between(1, MAX_BYTES), F.lit(False)), "size_limit"),
                F.when(F.coalesce("__disputed", F.lit(False)), "ownership_conflict"),
            )
        )
    )
    return manifests.join(disputed, "name", "left").select("name", issues.alias("issues"))
