from __future__ import annotations

import random
from collections import Counter

import plain_versions as plain
import pytest
from pyspark.sql import functions as F
from test_dedup import _brute_groups, _edited, words

import corpus_pipeline
from idloom.llm import mixing, packing


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    """Documents with junk, exact and near copies, NULL and blank texts, a hot source, repeated rows and clashing columns; and labels."""
    rng = random.Random(21)
    rows = []
    for i in range(120):
        rows.append((i, words(rng, rng.randint(30, 120)).capitalize() + ".", rng.choice(["hot", "hot", "hot", "a", None])))
    for i in range(120, 150):
        rows.append((i, " | ".join(words(rng, 40).upper().split()) + " !! ***", "a"))
    for i in range(150, 170):
        rows.append((i, rows[rng.randrange(60)][1], "b"))
    for i in range(170, 190):
        rows.append((i, _edited(rng, rows[rng.randrange(60)][1], 0.02), "b"))
    rows += [(190, None, "a"), (191, "", "a"), (192, "  ", None), (5, rows[5][1], rows[5][2]), (300, words(rng, 9000), "long")]
    labels = [(i, int(not 120 <= i < 150), 0) for i in range(0, 160, 1) if i % 5]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = make(rows)
    for c in ("tkey", "node", "name", "score", "ids", "window_id"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def test_stages_and_run_against_plain_python(spark, folder):
    path, rows, labels = folder
    y = [(d, q) for d, q, _ in labels]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "simhash", "mixing", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    triples = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]

    scores = plain.quality_scores([r[:2] for r in rows], y)
    want = [r for r, s in zip(rows, scores) if s >= 0.5]
    docs = stages["quality"](spark, docs, path)
    assert docs.columns == columns and Counter(triples(docs)) == Counter(want) and 130 < len(want) < 170

    first = plain.groups_by_text([r[:2] for r in want])
    want = sorted({r for r in want if first[r[1]] == r[0]}, key=repr)
    docs = stages["exact_dedup"](spark, docs, path)
    assert docs.columns == columns and sorted(triples(docs), key=repr) == want

    groups = _brute_groups(sorted(r[:2] for r in want))
    want = [r for r in want if groups[r[0]][0] == r[0]]
    docs = stages["simhash"](spark, docs, path)
    assert docs.columns == columns and sorted(triples(docs), key=repr) == want and len(want) < len(groups)

    weights = [max(s, mixing.LEAST) for s in plain.quality_scores([r[:2] for r in want], y)]
    copies = plain.mix(want, weights, mixing.SEED)
    docs = stages["mixing"](spark, docs, path)
    mixed = Counter(triples(docs))
    assert docs.columns == columns and mixed == Counter(copies) + Counter() and set(copies.values()) > {0, 1} and {r["tkey"] for r in docs.collect()} == {"mine"}

    pieces = plain.pieces([r[:2] for r in mixed.elements()], packing.CAPACITY)
    have, shape = plain.unpacked(stages["packing"](spark, docs, path).collect())
    assert have == pieces and shape == plain.filled([len(ids) for _, _, ids in pieces.elements()], packing.CAPACITY)

    assert plain.unpacked(corpus_pipeline.run(spark, path).collect()) == (have, shape)


def test_run_on_empty_tables(spark, empty, no_labels, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
