"""A small chainable table query: verbs collect, ``frame`` gives the DataFrame; Catalyst plans it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableQuery:
    source: DataFrame
    columns: tuple[str, ...] = ()
    filters: tuple[Column, ...] = ()
    orders: tuple[Column, ...] = ()
    most: int | None = None
    extra: dict = field(default_factory=dict)

    def select(self, columns: str = "*") -> TableQuery:
        return replace(self, columns=tuple(c.strip() for c in columns.split(",") if c.strip() != "*"))

    def where(self, condition: Column) -> TableQuery:
        return replace(self, filters=(*self.filters, condition))

    def eq(self, column: str, value: object) -> TableQuery:
        """Equal; as in SQL, never true for None."""
        return self.where(F.col(column) == F.lit(value))

    def is_(self, column: str, value: object) -> TableQuery:
        """Null-safe equal."""
        return self.where(F.col(column).eqNullSafe(F.lit(value)))

    def in_(self, column: str, values: list) -> TableQuery:
        return self.where(F.col(column).isin(*values))

    def gte(self, column: str, value: object) -> TableQuery:
        return self.where(F.col(column) >= F.lit(value))

    def like(self, column: str, pattern: str) -> TableQuery:
        return self.where(F.col(column).like(pattern))

    def order(self, column: str, desc: bool = False) -> TableQuery:
        """Nulls last ascending and first descending, as the origin's store has it."""
        return replace(self, orders=(*self.orders, F.col(column).desc_nulls_first() if desc else F.col(column).asc_nulls_last()))

    def limit(self, n: int) -> TableQuery:
        return replace(self, most=n)

    def frame(self) -> DataFrame:
        d = self.source
        for f in self.filters:
            d = d.where(f)
        if self.orders:
            d = d.orderBy(*self.orders)
        if self.most is not None:
            d = d.limit(self.most)
        return d.select(*self.columns) if self.columns else d

    def maybe_single(self):
        """The only row, None without one; an error for more."""
        rows = self.limit(2).frame().collect()
        if len(rows) > 1:
            raise ValueError("more than one row")
        return rows[0] if rows else None
