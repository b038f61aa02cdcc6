"""Operator 1, exact deduplication by block naming.

Texts are cut into blocks of fixed size in bytes. Equal blocks get one integer name, by sorting; then adjacent names
of a document are paired, pairs are sorted into names again, and so on until each document has one name. Two
documents have the same (level, name) if and only if their texts are equal byte for byte: no hash decides.

Plan: one shuffle carries text (blocks, hash-partitioned by bucket so that each bucket is sorted by itself); all later
levels carry 8-byte names and halve each time. The HOT most frequent blocks, by a count of hashes, are left out of it: they are
aggregated, sorted by themselves and joined back by broadcast, HOT * BLOCK_BYTES at most, so that a block that stands in a third of all
documents doesn't travel at all. Each level is written, while the plan is made.

Defined cases: a NULL text equals nothing and is kept; empty texts are equal to each other; rows equal in doc_id and text
are one document and give one row; a NULL doc_id is kept only in a group without other ids; of equal texts the
smallest doc_id stays. A text of any length is named whole, in as many levels as it takes. An empty table gives an empty result. Only doc_id,
of any type, and text are read; columns of any other name are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clear, collapse_repeats, drop_documents, mark, table, text_key, written

BLOCK_BYTES = 1024
#: Buckets that are sorted by themselves; a name is bucket * 2**40 + rank in the bucket.
BUCKETS = 1 << 16
#: So many blocks, the most frequent ones, are named apart; every other one has less than this part of all rows.
HOT = 4096


def _named(rows: DataFrame, content: list[str]) -> DataFrame:
    """Adds ``name`` in place of ``content``: equal for rows equal in it, different otherwise."""
    h = F.xxhash64(*content)
    often = rows.select(h.alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(HOT).select("h")
    often = [r[0] for r in often.collect()]
    spark = rows.sparkSession
    hashes = spark.createDataFrame([(x,) for x in often], "h long")
    hot = rows.join(F.broadcast(hashes), h == F.col("h"), "left_semi").select(*content).distinct()
    hot = hot.select(*content, (F.lit(1 << 60) + F.row_number().over(Window.orderBy(*content))).alias("name"))  # HOT rows, but for collisions
    rows = rows.join(F.broadcast(hot), content, "left")
    cold = rows.where("name IS NULL").withColumn("bucket", F.pmod(h, F.lit(BUCKETS)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*content))
    cold = cold.withColumn("name", F.col("bucket") * F.lit(1 << 40) + rank).drop("bucket", *content)
    return rows.where("name IS NOT NULL").drop(*content).unionByName(cold)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each (doc_id, tkey) with a text: doc_id, tkey, n_rows (repeated rows), level, name."""
    b = F.col("text").cast("binary")
    last = F.greatest(F.ceil(F.octet_length("text") / F.lit(block_bytes)).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("idx"), F.substring(b, i * block_bytes + 1, F.lit(block_bytes)).alias("block")))
    blocks = docs.where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text")).alias("tkey"), F.explode(cut).alias("s"))
    blocks = blocks.select("doc_id", "tkey", "s.idx", "s.block")
    gather = F.transform(F.array_sort(F.collect_set(F.struct("idx", "name"))), lambda s: s["name"]).alias("names")
    cur = _named(blocks, ["block"]).groupBy("doc_id", "tkey").agg(F.count_if(F.col("idx") == 0).alias("n_rows"), gather)
    cur = written(cur, "op1-level0")
    longest = cur.agg(F.max(F.size("names"))).first()[0] or 1
    done, level = [cur.where(F.size("names") == 1).withColumn("level", F.lit(0))], 0
    while longest > 1:
        level += 1
        longest = (longest + 1) // 2
        at = lambda i: F.coalesce(F.get("names", i), F.lit(-1).cast("long"))
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(i.alias("idx"), at(2 * i).alias("a"), at(2 * i + 1).alias("b")))
        open_ = cur.where(F.size("names") > 1).select("doc_id", "tkey", "n_rows", F.explode(pairs).alias("s")).select("doc_id", "tkey", "n_rows", "s.idx", "s.a", "s.b")
        nxt = _named(open_, ["a", "b"]).groupBy("doc_id", "tkey").agg(F.first("n_rows").alias("n_rows"), gather)
        cur = written(nxt, f"op1-level{level}")
        done.append(cur.where(F.size("names") == 1).withColumn("level", F.lit(level)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "tkey", "n_rows", "level", F.element_at("names", 1).alias("name"))


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each (doc_id, tkey) with a text: doc_id, tkey, n_rows, keep_id, n_copies, keep."""
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"))
    out = identities(docs, block_bytes)
    # a group may be a third of all rows: it is aggregated before it is joined back
    best = out.groupBy(F.col("level").alias("l"), F.col("name").alias("m")).agg(F.min(order).alias("best"), F.count("*").alias("n_copies"))
    out = out.join(best, (F.col("level") == F.col("l")) & (F.col("name") == F.col("m")))
    return out.select("doc_id", "tkey", "n_rows", F.col("best.y").alias("keep_id"), "n_copies", F.col("best.y").eqNullSafe(F.col("doc_id")).alias("keep"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id (smallest doc_id with this text), n_copies (documents with this text), keep."""
    null = docs.where(F.col("text").isNull()).select("doc_id").distinct()
    null = null.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("keep"))
    return groups(docs, block_bytes).select("doc_id", "keep_id", "n_copies", "keep").unionByName(null)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose text an earlier doc_id has; repeated rows become one."""
    start = mark()
    g = written(groups(docs), "op1-groups")
    clear(spark, start, g)
    repeats = bool(g.agg(F.max("n_rows") > 1).first()[0])
    return collapse_repeats(drop_documents(docs, g.where(~F.col("keep"))), repeats)


SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_copies,
       text IS NULL OR doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text) AS keep
FROM (SELECT DISTINCT doc_id, text FROM documents)
"""
