"""Settings of ingestion, kept as a JSON file over defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from leafmill.operators.chunking import Chunking
from leafmill.sources.tools import Tools


@dataclass(frozen=True)
class Settings:
    """What a user may set. ``page_sleep_ms`` is accepted and has no effect: the cluster's scheduler shares out processors."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    chunk_strategy: str = "semantic"
    page_sleep_ms: int = 100
    max_pdf_pages: int = 500
    max_file_size_mb: int = 200

    def chunking(self) -> Chunking:
        return Chunking(self.chunk_size, self.chunk_overlap, self.chunk_strategy)

    def tools(self, tools: Tools = Tools()) -> Tools:
        """``tools`` with the limits that are set."""
        return replace(tools, max_pdf_pages=self.max_pdf_pages)

    @property
    def max_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024


def load(path: str) -> Settings:
    """Settings of a file; defaults for what it lacks, and altogether if it is missing or broken."""
    try:
        stored = json.loads(Path(path).read_text(encoding="utf-8"))
        known = {f.name for f in fields(Settings)}
        return replace(Settings(), **{k: v for k, v in stored.items() if k in known})
    except (OSError, ValueError, AttributeError):
        return Settings()


def save(settings: Settings, path: str) -> None:
    """Write settings as readable JSON; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(settings), ensure_ascii=False, indent=2), encoding="utf-8")
