"""Bulletin files to pages: PDF by ``sources.pdf``, else text split at form feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.pdf import Unreadable, pdf_pages

#: Files that a task reads at a time.
FILES = 16


def pages_of(content: bytes | None) -> tuple[list[str], str | None]:
    """The pages of a file and, if it has none, why; bytes that are no UTF-8 are left out of text files."""
    if content and content[:1024].lstrip()[:5] == b"%PDF-":
        try:
            return pdf_pages(content), None
        except Unreadable as why:
            return [], f"PDF: {why}"
    text = (content or b"").decode("utf-8", "ignore")
    return (text.split("\f"), None) if text else ([], "empty")


def file_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """The files with pages and reason (why there are no pages, else null) in place of their content."""
    kept = [c for c in files.columns if c != content]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in kept], "pages array<string>, reason string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES):
                part = b.slice(at, FILES)
                read = [pages_of(x) for x in part.column(content).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array([p for p, _ in read], pa.list_(pa.string())), pa.array([why for _, why in read], pa.string())], [*kept, "pages", "reason"])

    return files.select(*kept, content).mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, pages and reason of every file under ``path``; Spark lists no empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return file_pages(files.selectExpr("path", "sha2(content, 256) AS sha256", "content"))
