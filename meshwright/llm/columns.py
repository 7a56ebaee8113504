"""A table's columns under names that helper columns can't clash with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Columns:
    """The columns of ``df`` as c0, c1, ... in ``rows``; results get the given names back at the end.

    Names compare as the session does (without case, unless it says otherwise). Columns by the names in ``new`` are
    replaced by an operator's own results, so they don't come back.
    """

    def __init__(self, df: DataFrame, new: Iterable[str] = ()):
        case = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
        self.fold = str if case else str.lower
        self.names = df.columns
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        gone = {self.fold(n) for n in new}
        self.own = [i for i, n in enumerate(self.names) if self.fold(n) not in gone]

    def __contains__(self, name: str) -> bool:
        return self.fold(name) in map(self.fold, self.names)

    def at(self, name: str) -> str:
        """The name that a column has in ``rows``."""
        return f"c{[self.fold(n) for n in self.names].index(self.fold(name))}"

    def __getitem__(self, name: str) -> Column:
        return F.col(self.at(name))

    def kept(self) -> list[Column]:
        """The columns that come back, still under their positions."""
        return [F.col(f"c{i}") for i in self.own]

    def named(self, df: DataFrame, *extra: str) -> DataFrame:
        """The columns that come back, under their names, then ``extra``."""
        return df.select(*[F.col(f"c{i}").alias(self.names[i]) for i in self.own], *[F.col(c) for c in extra])
