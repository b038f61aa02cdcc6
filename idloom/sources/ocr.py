"""Recognised text. Engines are plugged in: Spark distributes them, groups words into lines, and joins pages.

An engine is a class with ``words(image: bytes) -> list[Word]`` or ``lines(image: bytes) -> list[Line]``, and ``pages(pdf: bytes) ->
list[bytes]`` for documents of pages. None is bundled. ``register`` makes it known by name; each Python worker makes one instance.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities as E

ENGINES: dict[str, Callable[[], object]] = {}
ORDER = ("tesseract", "paddle", "easyocr")
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
PAGES = f"source_file string, page int, full_text string, lines array<struct<text:string,confidence:double,bbox:{BOX}>>, average_confidence double, engine_used string, processing_time_ms double, error string"


class Word(NamedTuple):
    text: str
    confidence: float
    """In percent; negative where the engine doesn't say."""
    line: int
    box: tuple[int, int, int, int]


class Line(NamedTuple):
    text: str
    confidence: float
    """In 0..1."""
    polygon: list[tuple[float, float]]


def register(name: str, make: Callable[[], object]) -> None:
    ENGINES[name] = make


def choose(preferred: str | None, fallback: str | None, engines: dict[str, Callable[[], object]]) -> tuple[str, object]:
    """The first engine of preferred, fallback and the rest that can be made."""
    for name in dict.fromkeys([preferred, fallback, *ORDER, *engines]):
        if name in engines:
            try:
                return name, engines[name]()
            except ImportError:
                continue
    raise ImportError("no OCR engine can be used")


def grouped(words: list[Word]) -> list[tuple[str, float, tuple[int, int, int, int]]]:
    """Lines of words: blank words don't count, a line ends where the number of the line changes. Confidence is the mean, in 0..1; the box is the first word's."""
    out: list[list[Word]] = []
    for w in words:
        if not w.text.strip():
            continue
        if not out or out[-1][-1].line != w.line:
            out.append([])
        out[-1].append(w)
    return [(" ".join(w.text for w in ws), sum(max(w.confidence, 0.0) for w in ws) / len(ws) / 100, ws[0].box) for ws in out]


def rectangle(polygon: list[tuple[float, float]]) -> tuple[int, int, int, int]:
    x, y = [int(p[0]) for p in polygon], [int(p[1]) for p in polygon]
    return min(x), min(y), max(x), max(y)


def recognise(files: DataFrame, preferred: str | None = None, fallback: str | None = None, engines: dict[str, Callable[[], object]] | None = None) -> DataFrame:
    """A row for each page of files (source_file, suffix, content): PAGES. A file that fails gives one row with its error."""
    known = dict(ENGINES if engines is None else engines)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine: tuple[str, object] | None = None
        for pdf in parts:
            rows = []
            for name, kind, content in zip(pdf["source_file"], pdf["suffix"], pdf["content"], strict=True):
                try:
                    engine = engine or choose(preferred, fallback, known)
                    pages = engine[1].pages(content) if kind == ".pdf" else [content]
                    if not pages:
                        raise ValueError("no pages")
                    for i, image in enumerate(pages, 1):
                        t = time.perf_counter()
                        found = [(x.text, x.confidence, rectangle(x.polygon)) for x in engine[1].lines(image)] if hasattr(engine[1], "lines") else grouped(engine[1].words(image))
                        lines = [{"text": a, "confidence": float(c), "bbox": dict(zip(("x1", "y1", "x2", "y2"), box, strict=True))} for a, c, box in found]
                        mean = sum(x["confidence"] for x in lines) / len(lines) if lines else 0.0
                        rows.append((name, i, "\n".join(x["text"] for x in lines), lines, mean, engine[0], (time.perf_counter() - t) * 1000, None))
                except Exception as e:  # noqa: BLE001 - one bad file mustn't end the job: it is told in its row
                    rows.append((name, 1, None, None, None, engine[0] if engine else None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "page", "full_text", "lines", "average_confidence", "engine_used", "processing_time_ms", "error"])

    return files.select("source_file", "suffix", "content").mapInPandas(run, PAGES)


def group_words(words: DataFrame, key: list[str]) -> DataFrame:
    """Lines of words in a table: key, seq, line_num, text, conf (percent). Result: key, line (from 1), text, confidence (0..1).

    Blank and NULL words don't count; NULL confidences are 0. A line number that comes back later starts another line.
    """
    w = Window.partitionBy(*key).orderBy("seq")
    kept = words.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "") != "")
    new = F.when(F.col("line_num").eqNullSafe(F.lag("line_num").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    kept = kept.withColumn("_new", new).withColumn("line", F.sum("_new").over(w))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("text").alias("t")))), lambda x: x["t"])
    mean = F.avg(F.greatest(F.coalesce(F.col("conf").cast("double"), F.lit(0.0)), F.lit(0.0))) / 100
    return kept.groupBy(*key, "line").agg(F.array_join(in_order, " ").alias("text"), mean.alias("confidence"))


def combine_pages(pages: DataFrame, key: str = "source_file") -> DataFrame:
    """One row for each document of pages (page, full_text, average_confidence): key, n_pages, full_text, average_confidence.

    Texts in order of pages with an empty line between them, confidence their mean. Entities of the whole are found afterwards, in order of the text.
    """
    p = F.array_sort(F.collect_list(F.struct("page", F.coalesce("full_text", F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.array_join(F.transform(p, lambda x: x["t"]), "\n\n").alias("full_text"), F.coalesce(F.avg("average_confidence"), F.lit(0.0)).alias("average_confidence"))


def combine_entities(pages: DataFrame, key: str = "source_file", names: tuple[str, ...] = ("nips", "amounts", "dates", "invoice_numbers")) -> DataFrame:
    """Entities found page by page, united in order of pages."""
    whole = lambda n: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", F.col(n).alias("x")))), lambda s: s["x"])))
    return pages.select(key, "page", E.entities(F.col("full_text")).alias("e")).select(key, "page", "e.*").groupBy(key).agg(*[whole(n).alias(n) for n in names])
