"""The table of the table API: a DataFrame with the dialect's result conventions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class DataTable:
    """Wraps a DataFrame, which stays lazy; only to_map_list(), rows() and row_count() run it."""

    df: DataFrame

    @property
    def schema(self) -> StructType:
        return self.df.schema

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def to_map_list(self) -> list[dict[str, Any]]:
        """Rows as maps by lower-cased column name; of columns with the same name the last one counts. For results that fit
        into the driver; rows() streams larger ones."""
        return list(self.rows())

    def rows(self) -> Iterator[dict[str, Any]]:
        """Rows as maps, a partition at a time."""
        names = [c.lower() for c in self.df.columns]
        for row in self.df.toLocalIterator():
            yield dict(zip(names, row, strict=True))

    def row_count(self) -> int:
        return self.df.count()

    def cache(self) -> DataTable:
        return DataTable(self.df.cache())

    def __repr__(self) -> str:
        return f"DataTable({', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.df.schema)})"
