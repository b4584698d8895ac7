"""From files to stored text: a pluggable extractor in Arrow batches, then pages and windows as columns."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import CHUNK_PARTS, EXTRACTED, NORM_VERSION


@dataclass(frozen=True)
class Output:
    """What an extractor made of one file; ``code`` is None if a signal ended it."""

    code: int | None
    text: bytes
    errors: str = ""


Extractor = Callable[[bytes], Output]
TOOL = "pdftotext"


def tool_available() -> bool:
    return shutil.which(TOOL) is not None


def tool_version() -> str:
    """First line the tool prints about itself; ``missing`` or ``unknown``."""
    if not tool_available():
        return "missing"
    lines = subprocess.run([TOOL, "-v"], capture_output=True, text=True, check=False).stderr.splitlines()
    return lines[0].strip() if lines and lines[0].strip() else "unknown"


def run_tool(content: bytes) -> Output:
    """The file goes to the tool's input, its text comes from the output."""
    done = subprocess.run([TOOL, "-", "-"], input=content, capture_output=True, check=False)
    return Output(done.returncode if done.returncode >= 0 else None, done.stdout, done.stderr.decode("utf-8", "replace").strip())


def plain_text(content: bytes) -> Output:
    """For files that hold text, pages parted by form feeds."""
    return Output(0, content)


def error_text(code: int | None, errors: str, tool: str = TOOL) -> str:
    """What is stored for a failed extraction: how it ended, and what was said."""
    ended = f"{tool} terminated by signal" if code is None else f"{tool} exited with status {code}"
    return f"{ended}: {errors}" if errors else ended


def extract(files: DataFrame, extractor: Extractor = run_tool, name: str = TOOL, version: str = "unknown") -> DataFrame:
    """Extracted documents of (path, size_bytes, mtime_ns, dev, ino, content), as :data:`~paperlode.schema.EXTRACTED`.

    A file that fails has status error and what was said; one without visible text is empty, with no pages. Where a column
    ``failure`` says why a file couldn't be read, that is its error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, failures = [], []
            for content, failure in zip(batch.column("content"), batch.column("failure").to_pylist()):
                if failure is not None:
                    failures.append(failure)
                    texts.append(None)
                    continue
                try:
                    out = extractor(content.as_py() or b"")
                except OSError as e:
                    out = Output(-1, b"", str(e))
                failed = out.code != 0
                failures.append(error_text(out.code, out.errors, name) if failed else None)
                texts.append(None if failed else out.text.decode("utf-8", "replace"))
            kept = [c for c in batch.schema.names if c not in ("content", "failure")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(failures, pa.string())], [*kept, "text", "error_text"])

    failure = F.col("failure") if "failure" in files.columns else F.lit(None).cast("string").alias("failure")
    rows = files.select("path", "size_bytes", "mtime_ns", "dev", "ino", "content", failure)
    read = rows.mapInArrow(run, "path string, size_bytes long, mtime_ns long, dev long, ino long, text string, error_text string")
    return documents_of(read, name, version)


def documents_of(read: DataFrame, name: str, version: str) -> DataFrame:
    """Documents with their chunks from (path, size_bytes, mtime_ns, dev, ino, text, error_text)."""
    pages = tx.pages_column(F.col("text"))
    status = F.when(F.col("error_text").isNotNull(), "error").when(F.coalesce(tx.is_blank(F.col("text")), F.lit(True)), "empty").otherwise("ok")
    docs = read.withColumns({
        "extractor": F.lit(name), "extractor_version": F.lit(version), "norm_version": F.lit(NORM_VERSION).cast("long"), "status": status,
        "page_count": F.when(status == "ok", F.size(pages)).otherwise(0),
    })
    windows = tx.window_rows(tx.page_rows(docs.where("status = 'ok'"), ["path"]), ["path"])
    grouped = windows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*CHUNK_PARTS.names))).alias("chunks"))
    none = F.array().cast(EXTRACTED["chunks"].dataType)
    joined = docs.drop("text").join(grouped, "path", "left").withColumn("chunks", F.coalesce("chunks", none))
    return joined.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EXTRACTED))
