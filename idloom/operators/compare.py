"""Two documents side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.hashing import short_sha

LABELS = ("NIP", "Numer", "Data", "Kwota", "Dodatkowe")
MISSING = "BRAK"
IMAGE_TYPES = ("IMAGE", "JPG", "JPEG", "PNG", "GIF", "BMP", "TIFF", "WEBP")
#: Parts of a file's identity, in order; those a source lacks are ''.
FEATURES = ("file_type", "file_size", "content_hash", "visual_hash", "text_hash", "metadata_hash", "structure_hash", "color_profile_hash", "dimensions", "page_count", "creation_time", "modification_time")


def file_identity(prefix: str = "UNIV") -> Column:
    """PREFIX-TYPE-HASH of a file's FEATURES, times in whole seconds; a copy with other times has another."""
    shown = {f: N.text(F.col(f)) for f in FEATURES}
    for f in ("creation_time", "modification_time"):
        shown[f] = N.text(F.when(F.col(f) != 0, F.col(f).cast("long")))
    shown["page_count"] = N.text(F.when(F.col("page_count") != 0, F.col("page_count")))
    kind = F.when(F.col("file_type").isin(*IMAGE_TYPES), "IMG").otherwise(F.upper(F.left(F.col("file_type"), F.lit(3))))
    return F.concat(F.lit(prefix + "-"), kind, F.lit("-"), short_sha(F.concat_ws("|", *[shown[f] for f in FEATURES])))


def with_features(df: DataFrame) -> DataFrame:
    """Adds those of FEATURES that are missing, as NULL."""
    kinds = dict(file_size="long", page_count="int", creation_time="double", modification_time="double")
    return df.withColumns({f: F.lit(None).cast(kinds.get(f, "string")) for f in FEATURES if f not in df.columns})


def verify_file_identity(claimed: Column, prefix: str = "UNIV") -> Column:
    """Whether an ID is the one of a file's FEATURES; false where either can't be had."""
    return F.coalesce(claimed == file_identity(prefix), F.lit(False))


def parse_file_identity(c: Column) -> Column:
    """prefix, type_code, hash; a NULL struct where there aren't three parts."""
    p = F.split(c, "-")
    return F.when(F.size(p) == 3, F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("prefix", "type_code", "hash"))]))


def compare_files(pairs: DataFrame, files: DataFrame, prefix: str = "UNIV") -> DataFrame:
    """For pairs (a, b) of file keys: IDs and whether they, types, sizes and hashes are equal. Visual and text hashes: NULL unless both are there."""
    f = with_features(files).withColumn("_id", file_identity(prefix))
    side = lambda n: f.select(F.col("key").alias(n), F.struct(F.col("_id").alias("id"), *FEATURES).alias(f"_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    eq = lambda x: F.col(f"_a.{x}").eqNullSafe(F.col(f"_b.{x}"))
    maybe = lambda x: N.present(F.col(f"_a.{x}")) == N.present(F.col(f"_b.{x}"))
    return both.select(
        "a", "b", F.col("_a.id").alias("id1"), F.col("_b.id").alias("id2"), eq("id").alias("identical_ids"), eq("file_type").alias("same_type"), eq("file_size").alias("same_size"),
        eq("content_hash").alias("same_content_hash"), maybe("visual_hash").alias("same_visual_hash"), maybe("text_hash").alias("same_text_hash"),
    )


def canonical_diff(df: DataFrame, first: str, second: str, key: list[str]) -> DataFrame:
    """A row for each part of either canonical string: key, position, label, value1, value2, same. What one lacks is MISSING."""
    z = F.arrays_zip(F.split(N.text(F.col(first)), r"\|").alias("x"), F.split(N.text(F.col(second)), r"\|").alias("y"))
    out = df.select(*key, F.posexplode(z).alias("position", "z"))
    label = F.coalesce(F.get(F.array(*[F.lit(x) for x in LABELS]), F.col("position")), F.concat(F.lit("Pole "), (F.col("position") + 1).cast("string")))
    v = lambda n: F.coalesce(F.col(f"z.{n}"), F.lit(MISSING))
    return out.select(*key, "position", label.alias("label"), v("x").alias("value1"), v("y").alias("value2"), (v("x") == v("y")).alias("same"))
