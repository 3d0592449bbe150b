"""Small frozen specs that name columns, operators and aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

COMPARISONS = ("<", "<=", ">", ">=")
OPERATORS = ("==", "!=", *COMPARISONS, "contains", "in", "between")
AGGREGATES = ("count", "mean", "median", "sum", "min", "max", "std")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str = "=="
    value: Any = None

    @property
    def label(self) -> str:
        return f"{self.column} {self.operator} {self.value}"

    def check(self, df: DataFrame) -> None:
        if self.column not in df.columns:
            raise ValueError(f"Filter column not found: {self.column}")
        if self.operator not in OPERATORS:
            raise ValueError(f"Unsupported filter operator: {self.operator}")
        if self.operator == "between" and len(self.value) != 2:
            raise ValueError("between needs a low and a high value")


@dataclass(frozen=True)
class Group:
    filters: Sequence[Filter] = field(default_factory=tuple)
    label: str | None = None


def check_filters(df: DataFrame, filters: Sequence[Filter]) -> None:
    for item in filters:
        item.check(df)


def check_aggregate(df: DataFrame, column: str, function: str) -> None:
    if column not in df.columns:
        raise ValueError(f"Aggregation column not found: {column}")
    if function not in AGGREGATES:
        raise ValueError(f"Unsupported aggregation {function}")
