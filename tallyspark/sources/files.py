"""Whole files as rows, settings, fetched pages and PDF bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import variant
from tallyspark.plans.session import ship_code

RESPONSE = "url string, final_url string, status int, body string, error string"


def whole_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content of text files, one row each."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def json_objects(spark: SparkSession, *paths: str) -> DataFrame:
    """path, v, error: files that should be one JSON object each."""
    read = whole_texts(spark, *paths)
    v = variant.parsed(F.col("content"))
    error = F.when(v.isNull(), "cannot be read").when(variant.kind(v) != "OBJECT", "not an object")
    return read.select("path", F.when(error.isNull(), v).alias("v"), error.alias("error"))


def settings(*paths: str) -> dict:
    """Settings of JSON files on the driver, later ones over earlier ones; files that can't be read count as empty."""
    out: dict = {}
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            continue
        if isinstance(found, dict):
            out |= found
    return out


def fetched(urls: DataFrame, get: Callable[[str], tuple[str, int, bytes]]) -> DataFrame:
    """url, final_url, status, body, error of distinct addresses; ``get`` gives (final address, status, bytes) or raises.

    Bytes are read as UTF-8 with replacement. Failures are rows with an error, their body is null.
    """
    ship_code(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    final, status, raw = get(url)
                    rows.append((url, final, status, raw.decode("utf-8", "replace"), None))
                except Exception as why:  # any failure of the network is a row
                    rows.append((url, url, None, None, str(why)[:80]))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "body", "error"]).astype({"status": "Int32"})

    return urls.select("url").distinct().mapInPandas(run, RESPONSE)


def probed(urls: DataFrame, head: Callable[[str], int], get: Callable[[str], int]) -> DataFrame:
    """url, head_status, get_status, error of distinct addresses: GET is tried where HEAD raises."""
    ship_code(urls.sparkSession)

    def one(url: str) -> tuple:
        try:
            return url, head(url), None, None
        except Exception:  # servers that refuse HEAD are asked again
            try:
                return url, None, get(url), None
            except Exception as why:
                return url, None, None, str(why)[:80]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(u) for u in frame["url"]], columns=["url", "head_status", "get_status", "error"]).astype({"head_status": "Int32", "get_status": "Int32"})

    return urls.select("url").distinct().mapInPandas(run, "url string, head_status int, get_status int, error string")


def pdf_markers(content: bytes | None) -> tuple[int, bool, bool]:
    """(pages by the greatest page count that an object names, Unicode maps, text operators) of a PDF's bytes."""
    raw = content or b""
    counts = [int(n) for n in re.findall(rb"/Count\s+(\d+)", raw)]
    return max(counts, default=0), b"/ToUnicode" in raw, re.search(rb"\b(?:BT|Tj|TJ)\b", raw) is not None


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, parser, page_count, pages_with_text, text_characters, searchable of PDFs (path, content).

    A PDF library is asked where the executors have one; else the bytes' markers tell pages and
    whether there is text, and the numbers of characters stay null.
    """
    ship_code(files.sparkSession)

    def by_library(raw: bytes):
        import io

        for name in ("pymupdf", "pypdf", "PyPDF2"):
            try:
                module = __import__(name)
            except ImportError:
                continue
            try:
                if name == "pymupdf":
                    with module.open(stream=raw, filetype="pdf") as doc:
                        return name, [len(p.get_text()) for p in doc]
                return name, [len(p.extract_text() or "") for p in module.PdfReader(io.BytesIO(raw)).pages]
            except Exception:  # the next reader may know the file
                continue
        return None

    def one(path: str, raw: bytes) -> tuple:
        if (read := by_library(raw)) is not None:
            name, sizes = read
            return path, name, len(sizes), sum(n > 0 for n in sizes), sum(sizes), any(sizes)
        n, maps, operators = pdf_markers(raw)
        return path, "markers", n, None, None, bool(n and (maps or operators))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [one(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            out = pd.DataFrame(rows, columns=["path", "parser", "page_count", "pages_with_text", "text_characters", "searchable"])
            yield out.astype({"pages_with_text": "Int64", "text_characters": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, parser string, page_count bigint, pages_with_text bigint, text_characters bigint, searchable boolean")
