"""Operator 10, token IDs as flat binary files with 64-bit document offsets.

Each task writes one shard: ``NAME.bin`` holds the token IDs of its documents one after the other (unsigned 16-bit where the
vocabulary fits, else 32-bit), each document followed by an end-of-text ID; ``NAME.idx`` holds the documents' starts
in the shard, and its end, as signed 64-bit integers. A shard's base is the sum of the shards before it, so
base + start is a document's place in the whole corpus. ``manifest.json`` lists the shards that count.

Shards are named by partition and attempt. What a lost or doubled attempt leaves behind is not in the manifest, which is made
from the committed table of documents (``docs/`` in the same folder). Nothing is shuffled but that table.

Defined cases: a NULL text has no token, like an empty one, and keeps its place; each row is written, also one that
repeats another; strings of special tokens in a text are ordinary text; a text of any length is encoded whole. Only doc_id, of any type, and
text are read; columns of any other name are left alone. An empty table gives an empty result and a manifest without shards. The files are
written while the plan is made.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table

#: Where the ranks of the vocabulary are, on every executor, unless the session's ``spark.idloom.tokenizer`` names another file.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: str = RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a ranks file, once for each Python process."""
    if ranks not in _encodings:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks]


def ranks_path(spark: SparkSession) -> str:
    return spark.conf.get("spark.idloom.tokenizer", RANKS)


def encode(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The IDs of a text; none of NULL. Strings of special tokens are ordinary text."""
    return enc.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


def n_tokens(ranks: str = RANKS) -> Callable[[Column], Column]:
    """A function of a text column: how many IDs the tokenizer makes of each text, 0 for NULL."""

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        enc = encoding(ranks)
        return pa.array([len(encode(enc, t.as_py())) for t in text], pa.int64())

    return count


def id_type(end: int) -> np.dtype:
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


def write(docs: DataFrame, out: str, ranks: str | None = None, end: int = END) -> DataFrame:
    """Writes the shards below ``out``, a folder all executors share: doc_id, shard, token_offset (in the corpus), n_tokens."""
    spark, dtype = docs.sparkSession, id_type(end)
    ranks = ranks or ranks_path(spark)

    def shard(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = _filesystem(out)
        fs.create_dir(root, recursive=True)
        enc, at, starts, stream = encoding(ranks), 0, [0], None
        for b in parts:
            sizes, first = [], at
            offsets = []
            stream = stream or fs.open_output_stream(f"{root}/{name}.bin")
            for text in b.column("text"):
                ids = encode(enc, text.as_py())
                stream.write(ids.astype(dtype).tobytes())
                stream.write(np.array([end], dtype).tobytes())
                offsets.append(at)
                sizes.append(len(ids))
                at += len(ids) + 1
                starts.append(at)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([name] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "shard", "local_offset", "n_tokens"])
        if stream is not None:
            stream.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(starts, "<i8").tobytes())

    kind = dict(docs.dtypes)["doc_id"]
    got = docs.select("doc_id", "text").mapInArrow(shard, f"doc_id {kind}, shard string, local_offset long, n_tokens long")
    got.write.option("compression", "zstd").parquet(f"{out}/docs")
    rows = spark.read.schema(got.schema).parquet(f"{out}/docs")
    shards = rows.groupBy("shard").agg(F.sum(F.col("n_tokens") + 1).alias("n_ids"), F.count("*").alias("n_docs"))
    shards = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    listed = [r.asDict() for r in shards.orderBy("shard").collect()]  # one row for each task of the scan
    fs, root = _filesystem(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype.str, "end": end, "shards": listed}).encode())
    bases = shards.select(F.col("shard").alias("s"), "base")
    placed = rows.join(bases, F.col("shard") == F.col("s"))
    return placed.select("doc_id", "shard", (F.col("base") + F.col("local_offset")).alias("token_offset"), "n_tokens")


class TokenCorpus:
    """The written corpus, memory-mapped. Documents are numbered through the shards in order."""

    def __init__(self, folder: str) -> None:
        with open(f"{folder}/manifest.json") as f:
            meta = json.load(f)
        self.dtype, self.shards = np.dtype(meta["dtype"]), meta["shards"]
        self._ids = [np.memmap(f"{folder}/{s['shard']}.bin", self.dtype, "r") for s in self.shards]
        self._starts = [np.memmap(f"{folder}/{s['shard']}.idx", "<i8", "r") for s in self.shards]
        self._bases = np.array([s["base"] for s in self.shards], np.int64)
        self._firsts = np.cumsum([0, *[s["n_docs"] for s in self.shards]])

    def __len__(self) -> int:
        return int(self._firsts[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        s = int(np.searchsorted(self._firsts, i, "right")) - 1
        k = i - self._firsts[s]
        return self._ids[s][self._starts[s][k] : self._starts[s][k + 1] - 1]

    def at(self, token_offset: int, n: int) -> np.ndarray:
        """n IDs from a place in the whole corpus, as ``write`` reports it."""
        s = int(np.searchsorted(self._bases, token_offset, "right")) - 1
        k = int(token_offset - self._bases[s])
        return self._ids[s][k : k + n]


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the tokens of all documents into the shared folder; a row for each document tells where."""
    return write(table(spark, sf_dir, "documents"), new_path(spark, "op10-tokens"))
