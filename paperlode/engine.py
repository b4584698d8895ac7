"""One folder as a searchable index: settings, start and search."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.extract import TOOL, Extractor, run_tool, tool_available, tool_version
from .plans.search import MODES
from .schema import DEFAULT_LIMIT
from .sources.files import store_path
from .streaming.live import LiveIndex, Options


@dataclass(frozen=True)
class Config:
    """What a user may set. ``store`` is made from ``data_dir`` and the folder's name where it isn't given."""

    root: str
    data_dir: str = os.path.expanduser("~/.local/share")
    store: str | None = None
    respect_ignore: bool = False
    follow_symlinks: bool = False
    jobs: int | None = None
    debounce_ms: int = 200
    mode: str = "fuzzy"
    limit: int = DEFAULT_LIMIT
    extractor: Extractor = run_tool
    extractor_name: str = TOOL
    extractor_version: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")


class Engine:
    """Opens the store, brings it up to date, answers queries."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        if config.extractor is run_tool and not tool_available():
            raise RuntimeError(f"{TOOL} is not installed; give another extractor")
        self.config = config
        store = config.store or store_path(config.data_dir, config.root)
        version = config.extractor_version or (tool_version() if config.extractor is run_tool else "1")
        self.live = LiveIndex(spark, Options(config.root, f"{store}/tables", f"{store}/listings", config.respect_ignore, config.follow_symlinks, f"{config.debounce_ms} milliseconds", 0, config.extractor, config.extractor_name, version))
        self._checkpoint = f"{store}/checkpoint"
        self._stream = None

    def scan(self) -> None:
        """Process what is new or changed, once."""
        self.live.scan()

    def start(self) -> None:
        """Scan, then follow changes."""
        self._stream = self.live.watch(self._checkpoint)

    def stop(self) -> None:
        if self._stream is not None:
            self._stream.stop()
            self._stream = None

    def search(self, query: str, mode: str | None = None, limit: int | None = None) -> DataFrame:
        return self.live.search(query, mode or self.config.mode, self.config.limit if limit is None else limit)
