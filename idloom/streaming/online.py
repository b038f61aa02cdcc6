"""Identity on streams: documents as they come, prior duplicates by keyed state, decisions against a growing archive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.matching import blocked_pairs, evaluate
from ..plans.pipeline import process

FLAGGED = "canonical_string string, document_id string, seq long, is_duplicate boolean, duplicate_of string"


def process_stream(texts: DataFrame) -> DataFrame:
    """The stateless part: a projection, in append mode."""
    return process(texts)


def flag_duplicates(processed: DataFrame, hours: int | None = None) -> DataFrame:
    """FLAGGED for each row of a stream with canonical_string, document_id, seq: the first ID seen for a canonical string is kept as state.

    Rows of one batch count in order of seq. ``hours``: state that nothing has touched for so long is dropped; by default it stays.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        first = state.get[0] if state.exists else rows["document_id"].iloc[0]
        state.update((first,))
        if hours:
            state.setTimeoutDuration(hours * 3_600_000)
        dup = rows["document_id"] != first
        yield pd.DataFrame({"canonical_string": key[0], "document_id": rows["document_id"], "seq": rows["seq"], "is_duplicate": dup, "duplicate_of": [first if d else None for d in dup]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if hours else GroupStateTimeout.NoTimeout
    return processed.select("canonical_string", "document_id", F.col("seq").cast("long").alias("seq")).groupBy("canonical_string").applyInPandasWithState(step, FLAGGED, "first string", "append", timeout)


def decide_batch(batch: DataFrame, archive_path: str, decisions_path: str, batch_id: int) -> None:
    """For ``foreachBatch``: decides on a batch of records (with seq) against the archive, and adds the new ones to it.

    Within the batch a record that matches an earlier one of the batch is no new one either; it is told as a duplicate of the
    last such. Files are written below batch=N, so that a batch that is repeated after a failure replaces what it wrote and doesn't see it.
    """
    spark = batch.sparkSession
    at = f"batch={batch_id}"
    path = spark._jvm.org.apache.hadoop.fs.Path(archive_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    old = spark.read.option("basePath", archive_path).schema(StructType([*batch.schema.fields, StructField("batch", IntegerType())])).parquet(archive_path).where(F.col("batch") < batch_id).drop("batch") if there else batch.limit(0)
    told = evaluate(batch, old)
    inner = blocked_pairs(batch).groupBy(F.col("seq_old").alias("s")).agg(F.max_by(F.struct("seq_new", "reason", "completeness_new", "completeness_old"), "seq_new").alias("m"))
    told = told.join(inner, F.col("seq") == F.col("s"), "left")
    take = (F.col("action") == "new") & F.col("m").isNotNull()
    better = F.when(F.col("m.completeness_old") > F.col("m.completeness_new"), "supersede").otherwise("duplicate")
    pick = lambda inner_value, c: F.when(take, inner_value).otherwise(F.col(c)).alias(c)
    told = told.select("seq", pick(better, "action"), pick(F.col("m.reason"), "reason"), pick(F.col("m.seq_new"), "match_seq"))
    told.write.mode("overwrite").parquet(f"{decisions_path}/{at}")
    kept = spark.read.parquet(f"{decisions_path}/{at}").where("action <> 'duplicate'").select("seq")
    batch.join(kept, "seq", "left_semi").write.mode("overwrite").parquet(f"{archive_path}/{at}")


def first_of_batch(batch: DataFrame) -> DataFrame:
    """The earliest row of each canonical string in a batch."""
    w = Window.partitionBy("canonical_string").orderBy("seq")
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
