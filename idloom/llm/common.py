"""What the operators share: row selection, prefix sums, table access; scratch tables and components are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components as connected_components
from ..scratch import clear, mark, new_path, written

__all__ = ["clear", "collapse_repeats", "connected_components", "drop_documents", "fresh", "mark", "new_path", "prefix_base", "table", "text_key", "written"]

#: Buckets of a two-level ranking: rows of one hot key are ranked in this many independent windows.
RANK_BUCKETS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; rows of one doc_id and one key are one document."""
    return F.xxhash64(F.coalesce(F.octet_length(text), F.lit(-1)), text)


def drop_documents(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text_key) isn't in ``dropped`` (columns doc_id, tkey); all its columns.

    ``dropped`` has no text, but grows with docs, so both sides are shuffled, at any size; a hash table of the ids
    spares sorting the texts.
    """
    d, k = fresh(docs, "_drop_id"), fresh(docs, "_drop_key")
    out = docs.withColumn(k, text_key(F.col("text")))
    gone = dropped.select(F.col("doc_id").alias(d), F.col("tkey").alias(k + "_r"))
    return out.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(k) == F.col(k + "_r")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def collapse_repeats(docs: DataFrame, has_repeats: bool, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row for each (doc_id, text) and value of ``by``. Where no such row repeats, which the caller knows, there is nothing to do."""
    if not has_repeats:
        return docs
    k = fresh(docs, "_repeat_key")
    return docs.withColumn(k, text_key(F.col("text"))).dropDuplicates(["doc_id", *by, k]).drop(k)


def prefix_base(counts: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one in its group; ``counts`` is small (groups x RANK_BUCKETS rows at most)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
