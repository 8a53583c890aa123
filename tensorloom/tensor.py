"""The data model: a sparse tensor is a DataFrame of integer coordinates and one value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.storage import dealt


def coords(order: int) -> list[str]:
    return [f"i{m}" for m in range(order)]


@dataclass(frozen=True)
class SparseTensor:
    """Coordinates ``i0 ..`` (long, from 0) and ``v`` (double). Coordinates may repeat: their values add up.

    ``known_dims`` saves the pass over the data that finds dimensions as largest index plus one;
    ``unique`` says that no coordinate repeats, which saves adding up. ``source`` has about as many
    rows or more and is cheap to count, as a table is: tasks are sized by it.
    """

    df: DataFrame
    order: int
    known_dims: tuple[int, ...] | None = None
    unique: bool = False
    source: DataFrame | None = None

    @classmethod
    def from_table(cls, df: DataFrame, modes: Sequence[str | Column], value: str | Column, dims: Sequence[int] | None = None) -> SparseTensor:
        """A tensor over columns or expressions of a table; other columns are never read."""
        pick = lambda c: F.col(c) if isinstance(c, str) else c
        cols = [pick(c).cast("long").alias(f"i{m}") for m, c in enumerate(modes)]
        return cls(df.select(*cols, pick(value).cast("double").alias("v")), len(modes), tuple(dims) if dims else None, source=df)

    @property
    def coords(self) -> list[str]:
        return coords(self.order)

    @cached_property
    def dims(self) -> tuple[int, ...]:
        if self.known_dims:
            return self.known_dims
        row = self.df.agg(*(F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in self.coords)).first()
        return tuple(row)

    @cached_property
    def most_rows(self) -> int:
        """About how many rows there are at most, by counting the source; 0 without one."""
        return 0 if self.source is None else self.source.count()

    def like(self, df: DataFrame, unique: bool = False) -> SparseTensor:
        """The same shape over other rows, about as many."""
        return SparseTensor(df.select(*self.coords, "v"), self.order, self.known_dims, unique, self.source)

    def dealt(self, modes: Sequence[int]) -> SparseTensor:
        """The same entries dealt by the given modes to tasks of bounded rows (see ``functions.storage.dealt``)."""
        return self.like(dealt(self.df, [f"i{m}" for m in modes], self.most_rows), self.unique)

    def where(self, condition) -> SparseTensor:
        """The entries that meet a condition on coordinates and v."""
        return self.like(self.df.where(condition), self.unique)

    def nnz(self) -> int:
        return self.df.count()

    def coalesce(self) -> SparseTensor:
        """One row for each coordinate."""
        return self if self.unique else self.like(self.dealt(range(self.order)).df.groupBy(*self.coords).agg(F.sum("v").alias("v")), True)

    def drop_zeros(self) -> SparseTensor:
        return self.where("v <> 0")

    def check_modes(self, *modes: int) -> None:
        if len(set(modes)) != len(modes) or any(not 0 <= m < self.order for m in modes):
            raise ValueError(f"modes {modes} of a tensor of order {self.order}")


def same_shape(x: SparseTensor, y: SparseTensor) -> None:
    if x.order != y.order:
        raise ValueError(f"orders differ: {x.order} and {y.order}")
    if x.known_dims and y.known_dims and x.known_dims != y.known_dims:
        raise ValueError(f"shapes differ: {x.known_dims} and {y.known_dims}")
