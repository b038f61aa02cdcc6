"""Files of any kind to features and IDs: PDF files by their pages, images by their pixels, all others by their bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import FEATURES, file_identity, verify_file_identity, with_features
from . import files, images, pdf


def file_features(spark: SparkSession, path: str, engine: Callable[[bytes], pdf.Document] = pdf.read_bytes, prefix: str = "UNIV") -> DataFrame:
    """source_file, FEATURES, document_id and error of the files below a path. A file that its reader can't read has an error and no ID.

    Each kind is scanned by itself, by a filter on names that reaches the scan. Spark lists no files of 0 bytes.
    """
    every = files.scan(spark, path)
    kind = F.col("suffix")
    pdfs = pdf.features(every.where(kind == ".pdf"), engine)
    sizes = every.where(kind.isin(*files.IMAGES)).select("source_file", "file_size", "modification_time")
    plain = F.regexp_replace("source_file", "^file:/+", "file:/")  # the two sources don't write paths alike
    sizes = sizes.withColumn("source_file", plain)
    pictures = images.image_features(images.read_images(spark, path, files.IMAGES).withColumn("source_file", plain), sizes)
    unread = sizes.join(pictures.select("source_file"), "source_file", "left_anti").withColumn("error", F.lit("no image")).withColumn("file_type", F.lit("IMAGE"))
    rest = files.generic_features(every.where(~kind.isin(".pdf", *files.IMAGES)))
    out = None
    for part in (pdfs, pictures, unread, rest):
        part = with_features(part if "error" in part.columns else part.withColumn("error", F.lit(None).cast("string")))
        part = part.select("source_file", *[F.col(f).cast(dict(file_size="long", page_count="int", creation_time="double", modification_time="double").get(f, "string")).alias(f) for f in FEATURES], "error")
        part = part.withColumn("source_file", plain)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("document_id", F.when(F.col("error").isNull(), file_identity(prefix)))


def verify_files(features: DataFrame, claimed: DataFrame, prefix: str = "UNIV") -> DataFrame:
    """source_file, claimed_id, verified: claims (source_file, claimed_id) against files; a file that isn't there, or can't be read, verifies none."""
    both = claimed.select("source_file", "claimed_id").join(features, "source_file", "left")
    return both.select("source_file", "claimed_id", (verify_file_identity(F.col("claimed_id"), prefix) & F.col("document_id").isNotNull()).alias("verified"))
