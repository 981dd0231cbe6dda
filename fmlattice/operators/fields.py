"""Field definitions: which column is what kind of feature."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

IDENTITY = "identity"   # one-hot over a learned dictionary
LIST = "list"           # multi-hot over a learned dictionary, weight 1/m
NUMBER = "number"       # one feature holding the numeric value
TIME = "time"           # number: epoch seconds -> whole days
TARGET = "target"       # the label (or, in a side table, the join key)

KINDS = (IDENTITY, LIST, NUMBER, TIME, TARGET)


@dataclass(frozen=True)
class FieldSpec:
    """One column of the input and how it becomes features.

    ``transform``: optional ``Column -> Column`` giving the double value of a
    token (identity / list) or of the field (number / time / target).  For a
    list it is applied to each token (``F.transform``)."""

    column: str
    kind: str
    sep: str = ","
    transform: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown field kind {self.kind!r}; one of {KINDS}")

    @property
    def categorical(self) -> bool:
        return self.kind in (IDENTITY, LIST)


def Identity(column: str, transform=None) -> FieldSpec:
    return FieldSpec(column, IDENTITY, transform=transform)


def List(column: str, sep: str = ",", transform=None) -> FieldSpec:
    return FieldSpec(column, LIST, sep=sep, transform=transform)


def Number(column: str, transform=None) -> FieldSpec:
    return FieldSpec(column, NUMBER, transform=transform)


def Time(column: str, transform=None) -> FieldSpec:
    """``transform`` takes the place of epoch seconds -> whole days."""
    return FieldSpec(column, TIME, transform=transform)


def Target(column: str, transform=None) -> FieldSpec:
    return FieldSpec(column, TARGET, transform=transform)


def split_target_inputs(specs: list[FieldSpec]) -> tuple[FieldSpec, list[FieldSpec]]:
    """The target and the ordered remaining fields (Q21: exactly one target)."""
    targets = [s for s in specs if s.kind == TARGET]
    if len(targets) != 1:
        raise ValueError(f"a definition needs exactly one target field, got {len(targets)}")
    return targets[0], [s for s in specs if s.kind != TARGET]
