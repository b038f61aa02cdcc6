"""Files as tables, and tables as JSON. Directories are listed by Spark; order is that of paths, which stand for a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import file_identity, with_features

TEXT = (".txt", ".xml", ".html", ".htm")
SCANS = (".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".tiff")
#: What a scan of a directory for scans takes.
BATCH = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")


#: Rows that one task is given at most, and bytes of a table below which its rows aren't counted.
TASK_ROWS, COUNTED_BYTES = 100_000, 1 << 22


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, and over more tasks the more rows there are; where the scan does that itself, and for streams, as it is.

    A table is often one file of one or a few row groups, each of which one task reads, however many partitions its bytes are cut into; what
    follows, bound by regular expressions, would stay in those tasks. So the rows of each partition are counted, unless the table is
    small, which reads the files' footers alone while the plan is made. Spark moves the columns that are used alone, before they are
    worked on. Takes a scan with filters and projections at most.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) < COUNTED_BYTES
    if small:
        return df if plan.toRdd().getNumPartitions() >= cores else df.repartition(cores * 2)
    rows, most = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    wanted = max(cores * 2, -(-(rows or 0) // TASK_ROWS))
    return df if (most or 0) <= 2 * (rows or 0) // wanted and plan.toRdd().getNumPartitions() >= cores else df.repartition(wanted)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its point; '' where a name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = None, recursive: bool = True) -> DataFrame:
    """source_file, suffix, file_size, modification_time (seconds), content (bytes) of the files below a path. Only files of ``suffixes`` are opened."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = r.load(path)
    kind = suffix(F.col("path"))
    files = files.select(F.col("path").alias("source_file"), kind.alias("suffix"), F.col("length").alias("file_size"), F.unix_micros("modificationTime").cast("double").alias("_t"), "content")
    files = files.withColumn("modification_time", F.col("_t") / 1e6).drop("_t")
    return files.where(F.col("suffix").isin(*suffixes)) if suffixes else files


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; what isn't UTF-8 is left out."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "�", "")


def texts(files: DataFrame) -> DataFrame:
    """Adds full_text and average_confidence (1) for text files, and error for others: scans need an OCR engine, the rest isn't known."""
    kind = F.col("suffix")
    error = F.when(kind.isin(*TEXT), None).when(kind.isin(*SCANS), "needs OCR").otherwise(F.concat(F.lit("unsupported file type: "), kind))
    return files.withColumn("full_text", F.when(kind.isin(*TEXT), decoded(F.col("content")))).withColumn("average_confidence", F.lit(1.0)).withColumn("error", error)


def read_texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return texts(scan(spark, path, TEXT, recursive)).drop("content")


def generic_features(files: DataFrame) -> DataFrame:
    """FEATURES of files by their bytes: type by suffix, 16 digits of SHA-256 (of the size where bytes are NULL). Creation times aren't known to Spark: ''."""
    hash16 = F.left(F.sha2(F.coalesce(F.col("content"), F.col("file_size").cast("string").cast("binary")), 256), F.lit(16))
    return with_features(files.withColumn("file_type", F.upper(F.translate("suffix", ".", ""))).withColumn("content_hash", hash16))


def file_ids(files: DataFrame, prefix: str = "UNIV") -> DataFrame:
    return generic_features(files).withColumn("document_id", file_identity(prefix))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, in as many files as partitions; letters beyond ASCII as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def as_json_array(df: DataFrame, order: str) -> DataFrame:
    """One row: all rows as one indented array in order. The result is one value, so it is for reports of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct("*").alias("_r"))))
    return df.agg(F.to_json(F.transform(rows, lambda x: x["_r"]), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
