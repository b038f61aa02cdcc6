"""Reports over processed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, name: str = "source_file") -> DataFrame:
    """document_id, n_files, files (in order of seq) of IDs that several rows have."""
    g = df.groupBy("document_id").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list(F.struct("seq", F.col(name).alias("f")))).alias("fs"))
    return g.where("n_files > 1").select("document_id", "n_files", F.transform("fs", lambda x: x["f"]).alias("files"))


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("document_type").agg(F.count("*").alias("n")).orderBy("document_type")


def totals(df: DataFrame) -> DataFrame:
    """One row: n_documents, n_duplicates (of the rows that are left), mean_confidence (0 without rows), n_ids, all_same."""
    ids = F.countDistinct("document_id")
    return df.agg(F.count("*").alias("n_documents"), F.count_if("is_duplicate").alias("n_duplicates"), F.coalesce(F.avg("ocr_confidence"), F.lit(0.0)).alias("mean_confidence"), ids.alias("n_ids"), (ids == 1).alias("all_same"))


def engines(runs: DataFrame) -> DataFrame:
    """For each engine of runs (engine, document_id, confidence, processing_time_ms): n_runs, n_ids, deterministic, means, least and most time."""
    ids = F.countDistinct("document_id")
    t = "processing_time_ms"
    return runs.groupBy("engine").agg(F.count("*").alias("n_runs"), ids.alias("n_ids"), (ids == 1).alias("deterministic"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.avg(t).alias("mean_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"))


def best_engine(runs: DataFrame) -> DataFrame:
    """One row: the engine of greatest mean confidence, the first by name of equals."""
    return engines(runs).agg(F.min_by("engine", F.struct(-F.col("mean_confidence"), F.col("engine"))).alias("engine"), F.max("mean_confidence").alias("mean_confidence"))


def ends(df: DataFrame, n: int = 5) -> DataFrame:
    """The first and last n rows by seq."""
    first = df.orderBy("seq").limit(n)
    return first.unionByName(df.join(first.select("seq"), "seq", "left_anti").orderBy(F.col("seq").desc()).limit(n))


def listed(ids, most: int = 5, word: str = "unique IDs"):  # noqa: ANN001, ANN201
    """The entries of an array, in order, where they are at most so many; else how many there are."""
    return F.when(F.size(ids) <= most, F.array_join(F.array_sort(ids), ", ")).otherwise(F.concat(F.size(ids).cast("string"), F.lit(f" {word}")))


def shortened(c, most: int = 500, tail: str = "..."):  # noqa: ANN001, ANN201
    """At most so many characters of a text, and the tail where some are cut."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(tail))).otherwise(c)
