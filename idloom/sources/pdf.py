"""Features of PDF files from their bytes, page by page: lengths of texts, images, sizes, drawings, fonts, and metadata.

An engine reads a file; the one here knows the syntax and no more: objects, compressed streams and object streams, text that is shown by literal or
hex strings without fonts' own encodings. It renders nothing, so that there is no visual hash. Where a PDF library is at hand, give an engine
that uses it; the hashes follow from what the engine tells.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>(?!>)|(?<!\w)(T\*|Td|TD|Tm|BT)(?!\w)", re.S)
_PAINT = re.compile(rb"(?<![\w'*\"])(?:S|s|f|F|f\*|B|B\*|b|b\*)(?=\s|$)")


@dataclass
class Page:
    text: str = ""
    images: int = 0
    width: float = 0.0
    height: float = 0.0
    drawings: int = 0
    fonts: int = 0


@dataclass
class Document:
    pages: list[Page] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    visual_hash: str | None = None


def _stream(body: bytes) -> bytes:
    """The bytes of an object's stream, inflated where they are compressed so; empty where they are something else."""
    at = body.find(b"stream")
    if at < 0:
        return b""
    raw = body[at + 6 :].lstrip(b"\r").removeprefix(b"\n")
    raw = raw[: raw.rfind(b"endstream")]
    head = body[:at]
    if b"FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""
    return b"" if b"/Filter" in head else raw


def _objects(content: bytes) -> dict[int, bytes]:
    out = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            data = _stream(body)
            first, count = (re.search(rb"/%s\s+(\d+)" % k, body) for k in (b"First", b"N"))
            if not (first and count):
                continue
            numbers = [int(x) for x in data[: int(first[1])].split()[: 2 * int(count[1])]]
            starts = [int(first[1]) + x for x in numbers[1::2]] + [len(data)]
            for n, a, z in zip(numbers[::2], starts, starts[1:], strict=False):
                out.setdefault(n, data[a:z])
    return out


def _literal(raw: bytes) -> str:
    raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw)
    raw = re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1]), raw, flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def _text(content: bytes) -> str:
    out = []
    for literal, digits, move in _SHOWN.findall(content):
        if move:
            out.append("\n" if out and not out[-1].endswith("\n") else "")
        elif digits:
            out.append(_literal(bytes.fromhex(re.sub(rb"\s", b"", digits).decode() + "0" * (len(re.sub(rb"\s", b"", digits)) % 2))))
        else:
            out.append(_literal(literal))
    return "".join(out)


def read_bytes(content: bytes) -> Document:
    """The engine of this module. Raises ValueError where the bytes are no PDF."""
    if b"%PDF-" not in content[:1024]:
        raise ValueError("no PDF")
    objects = _objects(content)
    parents = {n: int(m[1]) for n, b in objects.items() if (m := re.search(rb"/Parent\s+(\d+)", b))}

    def inherited(n: int, pattern: bytes) -> re.Match | None:
        for _ in range(50):
            if m := re.search(pattern, objects.get(n, b""), re.S):
                return m
            if n not in parents:
                return None
            n = parents[n]
        return None

    def entries(body: bytes, name: bytes) -> list[bytes]:
        """The values of a dictionary of resources, written in place or by reference."""
        m = re.search(rb"/%s\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)" % name, body, re.S)
        return _REF.findall(m[1] if m[1] is not None else objects.get(int(m[2]), b"")) if m else []

    order: list[int] = []

    def walk(n: int, seen: frozenset[int]) -> None:
        body = objects.get(n, b"")
        if n in seen:
            return
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            for k in _REF.findall(kids[1]):
                walk(int(k), seen | {n})
        elif re.search(rb"/Type\s*/Page\b", body):
            order.append(n)

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and n not in parents]
    for n in roots:
        walk(n, frozenset())
    pages = []
    for n in order:
        page, body = Page(), objects[n]
        if box := inherited(n, rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)"):
            a, b, c, d = (float(box[i]) for i in range(1, 5))
            page.width, page.height = abs(c - a), abs(d - b)
        by_ref = inherited(n, rb"/Resources\s+(\d+)\s+\d+\s+R")
        resources = objects.get(int(by_ref[1]), b"") if by_ref else next((objects[k] for k in (n, parents.get(n)) if b"/Resources" in objects.get(k, b"")), b"")
        page.fonts = len(set(entries(resources, b"Font")))
        page.images = sum(b"/Image" in objects.get(int(k), b"") for k in set(entries(resources, b"XObject")))
        if parts := re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", body, re.S):
            shown = b"\n".join(_stream(objects.get(int(k), b"")) for k in _REF.findall(parts[1] or parts[2]))
            page.text, page.drawings = _text(shown), len(_PAINT.findall(re.sub(rb"\((?:[^()\\]|\\.)*\)", b"", shown, flags=re.S)))
        pages.append(page)
    info = re.search(rb"/Info\s+(\d+)", content)
    told = re.findall(rb"/(\w+)\s*\(((?:[^()\\]|\\.)*)\)", objects.get(int(info[1]), b"") if info else b"", re.S)
    return Document(pages, {k.decode(): _literal(v) for k, v in told})


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]


def hashes(doc: Document) -> tuple:
    """content_hash, text_hash, metadata_hash, visual_hash, dimensions, page_count of what an engine told."""
    lines = []
    for i, p in enumerate(doc.pages):
        lines += [f"page_{i}_text_length:{len(p.text)}", f"page_{i}_images:{p.images}", f"page_{i}_size:{p.width:.2f}x{p.height:.2f}", f"page_{i}_drawings:{p.drawings}", f"page_{i}_fonts:{p.fonts}"]
    text = "".join(p.text for p in doc.pages)
    size = str((doc.pages[0].width, doc.pages[0].height)) if doc.pages else None
    return _sha("\n".join(lines)), _sha(text) if text else None, _sha(json.dumps(doc.metadata, sort_keys=True)), doc.visual_hash, size, len(doc.pages)


def features(files: DataFrame, engine: Callable[[bytes], Document] = read_bytes) -> DataFrame:
    """source_file, file_size, modification_time and what ``hashes`` gives of files with content; error (NULL where all is well) says what an engine couldn't read."""
    names = ["content_hash", "text_hash", "metadata_hash", "visual_hash", "dimensions", "page_count"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for content in pdf["content"]:
                try:
                    rows.append((*hashes(engine(bytes(content or b""))), None))
                except Exception as e:  # noqa: BLE001 - an engine's errors are its own; each is told in its row
                    rows.append((None,) * len(names) + (f"{type(e).__name__}: {e}",))
            out = pd.DataFrame(rows, columns=[*names, "error"]).astype({"page_count": "Int32"})
            for i, c in enumerate(("source_file", "file_size", "modification_time")):
                out.insert(i, c, pdf[c].to_numpy())
            yield out

    got = files.select("source_file", "file_size", "modification_time", "content")
    kinds = "source_file string, file_size long, modification_time double, " + ", ".join(f"{n} string" for n in names[:-1]) + ", page_count int, error string"
    return got.mapInPandas(run, kinds).withColumn("file_type", F.lit("PDF"))
