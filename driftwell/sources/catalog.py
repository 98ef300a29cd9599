"""Table definitions and their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T


class CatalogError(ValueError):
    """A definition is invalid or clashes with another."""


@dataclass
class IndexDef:
    """``path`` holds the posting lists of the table as of batch ``built``, each value's in ``chunks`` parts; None before they are written."""

    name: str
    columns: list[str]
    unique: bool = False
    path: str | None = None
    built: int = 0
    chunks: int = 1


@dataclass
class TableDef:
    """Columns in order, one primary key, and indexes by name; ``batches`` are (kind, seq, path) of its change log."""

    name: str
    schema: T.StructType
    primary_key: str
    indexes: dict[str, IndexDef] = field(default_factory=dict)
    batches: list[list] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = self.schema.names
        if len(set(names)) != len(names):
            raise CatalogError(f"a column of {self.name} is defined twice")
        if not self.primary_key:
            raise CatalogError(f"{self.name} needs a primary key")
        if self.primary_key not in names:
            raise CatalogError(f"{self.name} has no column {self.primary_key}")
        self.schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name != self.primary_key) for f in self.schema])

    def add_index(self, index: IndexDef) -> None:
        if index.name in self.indexes:
            raise CatalogError(f"there is an index {index.name}")
        for c in index.columns:
            if c not in self.schema.names:
                raise CatalogError(f"{self.name} has no column {c}")
        self.indexes[index.name] = index

    def covering(self, column: str) -> list[IndexDef]:
        return [i for i in self.indexes.values() if column in i.columns]

    def last(self) -> int:
        """The number of the newest batch."""
        return max((s for _, s, _ in self.batches), default=0)

    def to_json(self) -> dict:
        return {"name": self.name, "schema": json.loads(self.schema.json()), "primary_key": self.primary_key, "indexes": [vars(i) for i in self.indexes.values()], "batches": self.batches}

    @staticmethod
    def from_json(d: dict) -> TableDef:
        return TableDef(d["name"], T.StructType.fromJson(d["schema"]), d["primary_key"], {i["name"]: IndexDef(**i) for i in d["indexes"]}, [list(b) for b in d["batches"]])
