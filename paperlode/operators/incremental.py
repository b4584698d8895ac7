"""Processing only what is new since the last success, exactly once, whatever fails.

A log folder holds one small file per commit, named by a sequence number that only grows. A commit names
the upper limit it reached and the folder with its output; both become visible by one atomic rename, which
fails if another run took the number. A run reads the last commit's limit, fixes its own upper limit once
at its start, writes its output aside and commits. Output of a run that died before that is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run committed first; nothing of this run is visible."""


@dataclass(frozen=True)
class Commit:
    sequence: int
    lower: int
    upper: int
    output: str | None
    note: dict | None = None  # what the writer wants to find again without reading the output


class CommitLog:
    """Commits under ``root``, a folder every node can reach; all access is by Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.root}/log"))

    def _read(self, name: str) -> Commit:
        stream = self._fs.open(self._path(f"{self.root}/log/{name}"))
        try:
            return Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _names(self) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(f"{self.root}/log")) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))

    def commits(self) -> list[Commit]:
        """All commits, oldest first."""
        return [self._read(n) for n in self._names()]

    def since(self, enough: Callable[[Commit], bool]) -> list[Commit]:
        """The latest commit for which ``enough`` holds and those after it, oldest first; older ones aren't read."""
        out: list[Commit] = []
        for name in reversed(self._names()):
            out.append(self._read(name))
            if enough(out[-1]):
                break
        return out[::-1]

    def last(self) -> Commit | None:
        names = self._names()
        return self._read(names[-1]) if names else None

    def commit(self, after: Commit | None, upper: int, output: str | None, lower: int = 0, note: dict | None = None) -> Commit:
        """Publish limit and output together, as the commit next to ``after`` (``lower``: the limit where there is none)."""
        new = Commit(after.sequence + 1 if after else 1, after.upper if after else lower, upper, output, note)
        aside = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(json.dumps(asdict(new)).encode())
        stream.close()
        try:
            self._context.rename(aside, self._path(f"{self.root}/log/{new.sequence:020d}.json"), self._none)
        except Exception as e:
            self._fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"commit {new.sequence} exists") from e
            raise
        return new


def run(log: CommitLog, ceiling: Callable[[], int], work: Callable[[int, int], DataFrame], first: int = 0, before_commit: Callable[[Commit | None], None] | None = None) -> Commit | None:
    """Process all positions in (last upper limit, ``ceiling()``], once.

    ``work(lower, upper)`` returns the output of that range; ``first`` is the limit before any commit.
    With nothing new no commit is made and the last one is returned. ``before_commit`` is called between writing and
    committing; if it raises, the run has left nothing that is ever read.
    """
    last = log.last()
    lower = last.upper if last else first
    upper = ceiling()  # fixed here: what arrives later waits for the next run
    if upper <= lower:
        return last
    output = f"{log.root}/data/{uuid.uuid4().hex}"
    work(lower, upper).write.parquet(output)
    if before_commit:
        before_commit(last)
    return log.commit(last, upper, output, lower)


def committed(log: CommitLog, schema: str) -> DataFrame:
    """Output of all commits; with none an empty table."""
    outputs = [c.output for c in log.commits() if c.output]
    reader = log.spark.read.schema(schema)
    return reader.parquet(*outputs) if outputs else log.spark.createDataFrame([], schema)
