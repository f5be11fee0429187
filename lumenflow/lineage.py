"""Lineage records and a file-based schema registry."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lumenflow.schemas import EVENT, TABLES


@dataclass(frozen=True)
class LineageEvent:
    job: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


@dataclass
class Lineage:
    """Keeps what jobs read and wrote; sending it anywhere is left to the caller, through sink."""

    sink: object | None = None
    events: list[LineageEvent] = field(default_factory=list)

    def record(self, job: str, inputs: list[str] | DataFrame, outputs: list[str]) -> LineageEvent:
        read = inputs.inputFiles() if isinstance(inputs, DataFrame) else inputs
        event = LineageEvent(job, tuple(sorted(read)), tuple(outputs))
        self.events.append(event)
        if self.sink is not None:
            self.sink(event)
        return event

    def summary(self) -> dict:
        return {"events": len(self.events), "jobs": sorted({e.job for e in self.events}), "last": asdict(self.events[-1]) if self.events else None}


class SchemaRegistry:
    """A JSON file per subject below a folder."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def _path(self, subject: str) -> Path:
        return self.root / f"{subject}.json"

    def register(self, subject: str, schema: StructType) -> Path:
        self.root.mkdir(parents=True, exist_ok=True)
        path = self._path(subject)
        path.write_text(json.dumps(json.loads(schema.json()), indent=2, sort_keys=True) + "\n")
        return path

    def get(self, subject: str) -> StructType | None:
        path = self._path(subject)
        return StructType.fromJson(json.loads(path.read_text())) if path.exists() else None

    def register_all(self) -> list[Path]:
        """streaming_event and offline_{table} for every declared table."""
        subjects = {"streaming_event": EVENT} | {f"offline_{name}": schema for name, schema in TABLES.items()}
        return [self.register(name, schema) for name, schema in subjects.items()]
