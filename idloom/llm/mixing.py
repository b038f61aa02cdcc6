"""Operator 8, mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token budget: the corpus's tokens, shared out by the sources' target weights. A source smaller than
its budget is repeated in complete epochs; what is left of the budget is drawn without replacement, with probability
by quality weight: documents are sorted by key -ln(u) / weight, and taken while the running sum of tokens fits. A token is an ID of the
tokenizer that operator 10 writes with. The weight is a document's quality score where one is given (the pipeline gives operator 4's), else
what its label says. u comes from md5 of doc_id and seed, so that the draw is the same on every run and in any other engine.

Plan: texts are read once for their token counts; what is shuffled has no text. The running sum is taken in two levels, in
buckets of a source's keys and over the buckets' sums, so that one hot source is spread over many tasks.

Defined cases: a NULL text has 0 tokens; rows equal in doc_id, text and source are one document, and a text of several sources is drawn in
each; NULL sources are one source of their own; a document without a label, or with a NULL one, has weight UNLABELLED; several labels of one
doc_id count by their largest; scores under LEAST count as that. A document of 0 tokens fits whenever any budget is left. Equal keys go by
doc_id and text. Texts of any length are counted whole; doc_id may be of any type; other columns are kept, whatever their names. An empty table
gives an empty result. Jobs run while the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clear, collapse_repeats, fresh, mark, table, text_key, written
from .quality import score_column, train
from .token_output import n_tokens, ranks_path

GOOD, BAD, UNLABELLED = 1.0, 0.25, 0.5
LEAST = 0.01
SEED = "mix-1"
BUCKETS = 4096


def plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget_ratio: float = 1.0, seed: str = SEED, score: Column | None = None) -> DataFrame:
    """doc_id, tkey, source, n_tokens, copies for each document.

    ``targets``: weight by source, all equal where None; a source it lacks gets 0. ``score``: weight of a row of docs, in place of labels.
    """
    count = n_tokens(ranks_path(docs.sparkSession))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "source", count(F.col("text")).alias("n_tokens"), (F.lit(None).cast("double") if score is None else score).alias("score"))
    rows = rows.groupBy("doc_id", "tkey", "source").agg(F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"), F.count("*").alias("n_rows"))
    if score is None:
        quality = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("q"))
        rows = rows.join(quality, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")
        weight = F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, BAD).otherwise(UNLABELLED)
    else:
        weight = F.greatest(F.coalesce("score", F.lit(LEAST)), F.lit(LEAST))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))
    rows = rows.withColumn("key", -F.log(u) / weight).drop("q", "score")
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))
    rows = written(rows, "op8-rows")

    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    base = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("tokens").over(base), F.lit(0).cast("long")))
    sums = sums.withColumn("total", F.sum("tokens").over(Window.partitionBy("source")))
    if targets is None:
        share = F.lit(1.0)
    elif targets:
        weights = F.create_map(*[F.lit(x) for name, w in targets.items() for x in (name, float(w))])
        share = F.coalesce(F.try_element_at(weights, F.coalesce("source", F.lit(""))), F.lit(0.0))
    else:
        share = F.lit(0.0)
    per = sums.groupBy("source").agg(F.max("total").alias("total")).withColumn("share", share)
    whole = per.agg(F.sum("total").alias("corpus"), F.sum("share").alias("shares"))
    per = per.crossJoin(whole).withColumn("budget", F.floor(F.col("corpus") * F.lit(float(budget_ratio)) * F.col("share") / F.greatest(F.col("shares"), F.lit(1e-12))))
    per = per.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("budget") / F.greatest(F.col("total"), F.lit(1)))).otherwise(0).cast("long"))
    per = per.withColumn("left", (F.col("budget") - F.col("epochs") * F.col("total")).cast("long"))
    per = per.select(F.col("source").alias("s1"), "epochs", "left")
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base").join(per, F.col("s2").eqNullSafe(F.col("s1"))).drop("s1")

    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("n_tokens").over(inside))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    drawn = (F.col("left") > 0) & (F.col("base") + F.col("run") <= F.col("left"))
    return rows.select("doc_id", "tkey", "source", "n_tokens", "n_rows", (F.col("epochs") + drawn.cast("long")).alias("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, copies (0: not drawn) for every document; the sources have equal weights."""
    return plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "source", "n_tokens", "copies")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget_ratio: float = 1.0, score: Column | None = None) -> DataFrame:
    """The rows of docs, each as often as the plan says; the columns of docs."""
    start = mark()
    p = written(plan(docs, labels, targets, budget_ratio, score=score), "op8-plan")
    clear(docs.sparkSession, start, p)
    docs = collapse_repeats(docs, bool(p.agg(F.max("n_rows") > 1).first()[0]), ["source"])
    k, d, r, o, n, i = (fresh(docs, x) for x in ("_mix_key", "_mix_id", "_mix_rkey", "_mix_source", "_mix_n", "_mix_i"))
    right = p.where("copies > 0").select(F.col("doc_id").alias(d), F.col("tkey").alias(r), F.col("source").alias(o), F.col("copies").cast("int").alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(k) == F.col(r)) & F.col("source").eqNullSafe(F.col(o))
    out = docs.withColumn(k, text_key(F.col("text"))).join(right.hint("shuffle_hash"), same)
    return out.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to equal token budgets of their sources, drawn by the quality classifier's scores.

    The stages before leave no column for the score, so that the model is trained again, on documents that they kept, and applied.
    """
    labels = table(spark, sf_dir, "labels")
    return mix(docs, labels, score=score_column(train(docs, labels))(F.col("text")))
