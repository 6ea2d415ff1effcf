"""Table metadata: the fixed, external schema that every operator is driven by."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import types as T

CATEGORICAL, ORDINAL, INTEGER, FLOAT = "Categorical", "Ordinal", "Integer", "Float"
NUMERICAL = (INTEGER, FLOAT)
DISCRETE = (CATEGORICAL, ORDINAL)
NULL_LABEL = "NaN"
OUT_OF_BINS = "nan"


def bin_labels(edges: Sequence) -> tuple[str, ...]:
    return tuple(f"({lo},{hi}]" for lo, hi in zip(edges, edges[1:]))


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    labels: tuple[str, ...] | None = None
    bins: tuple | None = None

    def __post_init__(self):
        if self.kind not in NUMERICAL + DISCRETE:
            raise ValueError(f"unknown type {self.kind!r} for column {self.name!r}")
        if self.kind in DISCRETE and not self.labels:
            raise ValueError(f"discrete column {self.name!r} needs labels")
        if self.kind in NUMERICAL and (self.low is None or self.high is None):
            raise ValueError(f"numeric column {self.name!r} needs a range")

    @property
    def numeric(self) -> bool:
        return self.kind in NUMERICAL

    @property
    def binned(self) -> bool:
        """A numeric column that was re-typed to labels of its bins."""
        return not self.numeric and self.bins is not None

    def edges(self, n: int) -> list:
        """Edges of ``n`` equal bins; whole numbers for Integer columns, so edges may repeat."""
        step = (self.high - self.low) / n
        raw = [self.low + i * step for i in range(n)] + [self.high]
        return [int(e) for e in raw] if self.kind == INTEGER else [float(e) for e in raw]

    def domain_size(self, n: int) -> int:
        return n if self.numeric else len(self.labels)


@dataclass(frozen=True)
class TableMeta:
    columns: tuple[ColumnMeta, ...]

    def __getitem__(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def __len__(self) -> int:
        return len(self.columns)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def numeric(self) -> list[ColumnMeta]:
        return [c for c in self.columns if c.numeric]

    @property
    def discrete(self) -> list[ColumnMeta]:
        return [c for c in self.columns if not c.numeric]

    @staticmethod
    def from_dict(doc: dict) -> TableMeta:
        return TableMeta(
            tuple(
                ColumnMeta(
                    name=c["name"],
                    kind=c["type"],
                    low=c.get("min"),
                    high=c.get("max"),
                    labels=tuple(c["i2s"]) if "i2s" in c else None,
                    bins=tuple(c["bins"]) if "bins" in c else None,
                )
                for c in doc["columns"]
            )
        )

    @staticmethod
    def read(path: str) -> TableMeta:
        with open(path) as fh:
            return TableMeta.from_dict(json.load(fh))

    def to_dict(self) -> dict:
        cols = []
        for c in self.columns:
            entry: dict = {"name": c.name, "type": c.kind}
            if c.numeric:
                entry |= {"min": c.low, "max": c.high}
            else:
                entry |= {"i2s": list(c.labels), "size": len(c.labels)}
            if c.bins is not None:
                entry["bins"] = list(c.bins)
            cols.append(entry)
        return {"columns": cols}

    def derive(self, quids: Iterable[str] = (), drop: Iterable[str] = ()) -> TableMeta:
        """Metadata after dropping columns and turning numeric quasi-identifiers into labels of their bins."""
        quids, drop = set(quids or ()), set(drop or ())
        unknown = (quids | drop) - set(self.names)
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        out = []
        for c in self.columns:
            if c.name in drop:
                continue
            if c.name in quids and c.numeric:
                if not c.bins:
                    raise ValueError(f"numeric quasi-identifier {c.name!r} has no bins")
                c = replace(c, kind=CATEGORICAL, labels=bin_labels(c.bins))
            out.append(c)
        return TableMeta(tuple(out))

    def select(self, names: Iterable[str]) -> TableMeta:
        return TableMeta(tuple(self[n] for n in names))

    def struct(self) -> T.StructType:
        """Spark schema of the typed table."""
        kinds = {INTEGER: T.LongType(), FLOAT: T.DoubleType()}
        return T.StructType([T.StructField(c.name, kinds.get(c.kind, T.StringType())) for c in self.columns])

    def check(self, have: Iterable[str]) -> None:
        missing = [n for n in self.names if n not in set(have)]
        if missing:
            raise ValueError(f"columns missing from the table: {missing}")
