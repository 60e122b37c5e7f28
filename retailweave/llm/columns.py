"""Names of result and helper columns beside whatever columns a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def clear_of(table: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names, which an operator's results replace."""
    taken = {n.lower() for n in names}
    return table.drop(*[c for c in table.columns if c.lower() in taken])


def free_prefix(table: DataFrame) -> str:
    """A prefix that no column of the table begins with, for helper columns."""
    prefix = "__"
    while any(c.startswith(prefix) for c in table.columns):
        prefix += "_"
    return prefix
