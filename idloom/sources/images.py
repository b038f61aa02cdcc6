"""Perceptual hashes and quality of images, in numpy behind Arrow batches.

Images come decoded by Spark's image source (``spark.read.format("image")``), or as grids of gray values. Resampling is a
windowed sinc of three lobes, rounded to whole values after each axis.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINGERPRINT = "ahash string, dhash string, phash string, width int, height int, quality_score double, sharpness double, contrast double"


def hex_of(bits: np.ndarray) -> str:
    bits = np.asarray(bits).astype(np.uint8).ravel()
    return np.packbits(np.r_[np.zeros(-len(bits) % 8, np.uint8), bits]).tobytes().hex()[-(-(-len(bits) // 4)) :]


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of rows x columns x (blue, green, red[, alpha]), or the values of one channel."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2])
    b, g, r = (pixels[..., i].astype(np.int64) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def stretch(img: np.ndarray, cut: int = 2) -> np.ndarray:
    """Values stretched to 0..255 after leaving out ``cut`` percent of the pixels at either end."""
    h = np.bincount(img.ravel(), minlength=256)
    drop = img.size * cut // 100
    low = np.maximum(h - np.maximum(drop - (np.cumsum(h) - h), 0), 0)
    h = np.maximum(low - np.maximum(drop - (np.cumsum(low[::-1]) - low[::-1]), 0)[::-1], 0)
    left = np.flatnonzero(h)
    if not len(left) or left[0] == left[-1]:
        return img
    scale = 255.0 / (left[-1] - left[0])
    table = np.clip((np.arange(256) * scale - left[0] * scale).astype(int), 0, 255).astype(np.uint8)
    return table[img]


def _weights(size: int, to: int) -> np.ndarray:
    scale = max(size / to, 1.0)
    centre = (np.arange(to) + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resample(img: np.ndarray, width: int, height: int) -> np.ndarray:
    out = img.astype(float)
    if out.shape[1] != width:
        out = np.clip(np.floor(out @ _weights(out.shape[1], width).T + 0.5), 0, 255)
    if out.shape[0] != height:
        out = np.clip(np.floor(_weights(out.shape[0], height) @ out + 0.5), 0, 255)
    return out


def ahash(img: np.ndarray) -> str:
    g = resample(img, 8, 8)
    return hex_of(g >= g.mean())


def dhash(img: np.ndarray) -> str:
    g = resample(img, 9, 8)
    return hex_of(g[:, :-1] > g[:, 1:])


def phash(img: np.ndarray, size: int = 32) -> str:
    """Signs, around their median, of the lowest 8 x 8 products with a cosine basis; the first value isn't in the median."""
    k = np.arange(size)
    basis = np.cos(np.pi * np.outer(2 * k + 1, k) / (2 * size))
    low = (basis @ resample(img, size, size) @ basis.T)[:8, :8].ravel()
    return hex_of(low > np.median(low[1:]))


def quality(img: np.ndarray, longest: int = 256) -> tuple[float, float, float]:
    """Score in 0..1, sharpness (variance of differences), contrast (deviation)."""
    h, w = img.shape
    work = img.astype(float)
    if max(w, h) > longest:
        r = longest / max(w, h)
        work = resample(img, max(1, int(w * r)), max(1, int(h * r)))
    var = lambda d: float(d.var()) if d.size else 0.0
    sharp, contrast = var(np.diff(work, axis=1)) + var(np.diff(work, axis=0)), float(work.std())
    score = 0.5 * min(1.0, sharp / 500) + 0.3 * min(1.0, contrast / 80) + 0.2 * min(1.0, w * h / (1200 * 1600))
    return score, sharp, contrast


def fingerprint(pixels: np.ndarray) -> tuple | None:
    """The values of FINGERPRINT; None where there are no pixels."""
    if not pixels.size:
        return None
    g = stretch(gray(pixels))
    return (ahash(g), dhash(g), phash(g), g.shape[1], g.shape[0], *quality(g))


def exact_hash(pixels: np.ndarray) -> str:
    """16 digits of SHA-256 of a 32 x 32 bit pattern of the image, padded with white to a square."""
    g = gray(pixels)
    side = max(g.shape)
    top, left = round((side - g.shape[0]) * 0.5), round((side - g.shape[1]) * 0.5)
    square = np.full((side, side), 255, np.uint8)
    square[top : top + g.shape[0], left : left + g.shape[1]] = g
    small = resample(square, 32, 32)
    return hashlib.sha256(hex_of(small >= small.mean()).encode()).hexdigest()[:16]


def color_hash(pixels: np.ndarray) -> str:
    """16 digits of SHA-256 of the histograms of red, green and blue."""
    p = pixels if pixels.ndim == 3 and pixels.shape[2] >= 3 else np.repeat(gray(pixels)[..., None], 3, 2)
    counts = [int(n) for c in (2, 1, 0) for n in np.bincount(p[..., c].ravel(), minlength=256)]
    return hashlib.sha256(str(counts).encode()).hexdigest()[:16]


def rounded(df: DataFrame) -> DataFrame:
    """FINGERPRINT as it is stored: the score to four decimals, sharpness and contrast to two."""
    return df.withColumns({"quality_score": F.round("quality_score", 4), "sharpness": F.round("sharpness", 2), "contrast": F.round("contrast", 2)})


def from_json(json: Column) -> Column:
    """A struct of FINGERPRINT from JSON of those names; what is missing or NULL is '' or 0."""
    parsed = F.from_json(json, FINGERPRINT)
    fields = [f.split() for f in FINGERPRINT.split(", ")]
    return F.struct(*[F.coalesce(parsed[n], F.lit("" if t == "string" else 0).cast(t)).alias(n) for n, t in fields])


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """source_file, width, height, channels, data of the images below a path; what can't be decoded is left out. Only files of ``suffixes`` are opened."""
    r = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true")
    if suffixes:
        either = lambda s: "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in s)
        r = r.option("pathGlobFilter", "{" + ",".join("*" + either(s) for s in suffixes) + "}")
    i = r.load(path)
    return i.select(F.col("image.origin").alias("source_file"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _pixels(pdf: pd.DataFrame) -> Iterator[np.ndarray | None]:
    for w, h, c, data in zip(pdf["width"], pdf["height"], pdf["channels"], pdf["data"], strict=True):
        ok = data is not None and len(data) == w * h * c and len(data) > 0
        yield np.frombuffer(data, np.uint8).reshape(h, w, c) if ok else None


def fingerprints(images: DataFrame) -> DataFrame:
    """source_file and FINGERPRINT; NULLs for an image without sound data."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FINGERPRINT.split(", ")]
        for pdf in parts:
            rows = [fingerprint(p) if p is not None else None for p in _pixels(pdf)]
            out = pd.DataFrame([r or (None,) * len(names) for r in rows], columns=names)
            out.insert(0, "source_file", pdf["source_file"].to_numpy())
            yield out.astype({"width": "Int32", "height": "Int32"})

    return images.select("source_file", "width", "height", "channels", "data").mapInPandas(run, "source_file string, " + FINGERPRINT)


def image_features(images: DataFrame, sizes: DataFrame) -> DataFrame:
    """FEATURES of images joined with their file sizes (source_file, file_size, modification_time)."""
    hashes = "source_file string, visual_hash string, color_profile_hash string, dimensions string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(None, None, None) if p is None else (exact_hash(p), color_hash(p), f"({p.shape[1]}, {p.shape[0]})") for p in _pixels(pdf)]
            out = pd.DataFrame(rows, columns=["visual_hash", "color_profile_hash", "dimensions"])
            out.insert(0, "source_file", pdf["source_file"].to_numpy())
            yield out

    h = images.select("source_file", "width", "height", "channels", "data").mapInPandas(run, hashes).join(sizes, "source_file")
    shape = F.translate(F.translate("dimensions", "() ", ""), ",", "x")
    told = F.concat_ws("\n", F.concat(F.lit("size:"), shape), F.lit("mode:RGB"), F.concat(F.lit("visual_hash:"), F.col("visual_hash")), F.concat(F.lit("color_hash:"), F.col("color_profile_hash")), F.concat(F.lit("file_size:"), F.col("file_size").cast("string")))
    return h.withColumn("file_type", F.lit("IMAGE")).withColumn("content_hash", F.left(F.sha2(told, 256), F.lit(16)))


def preprocess(pixels: np.ndarray) -> np.ndarray:
    """Gray, contrast by half more around the mean, sharpened: what an OCR engine is given."""
    g = gray(pixels).astype(float)
    g = np.clip(np.floor(g.mean() + 0.5) * -0.5 + g * 1.5, 0, 255)
    p = np.pad(g, 1, mode="edge")
    around = sum(p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)) - g
    out = np.clip(np.floor((32 * g - 2 * around) / 16 + 0.5), 0, 255)
    out[[0, -1]], out[:, [0, -1]] = g[[0, -1]], g[:, [0, -1]]
    return out.astype(np.uint8)


def grid_hashes(df: DataFrame, key: str, grid: str, side: int = 8) -> DataFrame:
    """key, ahash, dhash, phash: of square grids of doubles that are as they are, without stretching; a NULL or odd-sized grid gives NULLs.

    The column right of the last, which differences of rows need, is the first one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for x in pdf[grid]:
                ok = x is not None and len(x) == side * side
                g = np.asarray(x, float).reshape(side, side) if ok else None
                rows.append((ahash(g), dhash(np.c_[g, g[:, :1]]), phash(g, side)) if ok else (None,) * 3)
            out = pd.DataFrame(rows, columns=["ahash", "dhash", "phash"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return df.select(key, grid).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, ahash string, dhash string, phash string")
