"""Source and schema definitions: plain data with JSON forms, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from kinfold.functions import transforms


@dataclass(frozen=True)
class SourceDef:
    """Delimited files: which column is which attribute. Columns count from 1."""

    columns: dict[str, int]
    id_column: int = 1
    delimiter: str = ","
    glob: str = ""
    concurrent: int = 0

    def __post_init__(self) -> None:
        if len(self.delimiter.encode()) != 1:
            raise ValueError("the delimiter must be one byte")
        if self.id_column < 1 or any(n < 1 for n in self.columns.values()):
            raise ValueError("columns count from 1")

    @classmethod
    def from_json(cls, text: str) -> SourceDef:
        d = json.loads(text)
        names = [f["name"] for f in d["fields"]]
        if len(set(names)) < len(names):
            raise ValueError("a field name occurs twice")
        columns = {f["name"]: int(f["column"]) for f in d["fields"]}
        return cls(columns, int(d.get("id_column", 1)), d.get("delimiter", ","), d.get("glob", ""), int(d.get("concurrent", 0)))

    def to_json(self) -> str:
        fields = [{"name": n, "column": c} for n, c in self.columns.items()]
        return json.dumps({"fields": fields, "id_column": self.id_column, "delimiter": self.delimiter, "glob": self.glob, "concurrent": self.concurrent})


@dataclass(frozen=True)
class Transform:
    """One step of a field's pipeline, by name and arguments."""

    function: str
    arguments: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        transforms.build(self.function, self.arguments)  # raises for unknown names and bad arguments

    def to_dict(self) -> dict:
        return {"function": self.function} | ({"arguments": self.arguments} if self.arguments else {})


@dataclass(frozen=True)
class FieldDef:
    """Attributes that are joined, without a separator, and then turned into terms."""

    attrs: tuple[str, ...]
    transforms: tuple[Transform, ...] = ()
    comment: str = ""

    @classmethod
    def from_dict(cls, d: dict) -> FieldDef:
        steps = tuple(Transform(t["function"], t.get("arguments") or {}) for t in d.get("transforms") or ())
        return cls(tuple(d["attrs"]), steps, d.get("comment", ""))

    @classmethod
    def from_json(cls, text: str) -> FieldDef:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return {"comment": self.comment, "attrs": list(self.attrs), "transforms": [t.to_dict() for t in self.transforms]}


@dataclass(frozen=True)
class SchemaDef:
    """``hash_count`` hyperplanes cut into chunks of ``width`` bits; what is left over is unused."""

    hash_count: int
    width: int
    fields: tuple[FieldDef, ...]

    def __post_init__(self) -> None:
        if not 1 <= self.width <= 32 or self.hash_count < self.width:
            raise ValueError("1 <= width <= 32 and width <= hash_count must hold")
        if not self.fields:
            raise ValueError("a schema needs a field")

    @property
    def chunks(self) -> int:
        return self.hash_count // self.width

    @property
    def attrs(self) -> list[str]:
        return list(dict.fromkeys(a for f in self.fields for a in f.attrs))

    @classmethod
    def from_json(cls, text: str) -> SchemaDef:
        d = json.loads(text)
        return cls(int(d["hash_count"]), int(d["chunk_size"]), tuple(FieldDef.from_dict(f) for f in d["fields"]))

    def to_json(self) -> str:
        return json.dumps({"hash_count": self.hash_count, "chunk_size": self.width, "fields": [f.to_dict() for f in self.fields]})
