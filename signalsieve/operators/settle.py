"""Expensive columns computed once, at a chosen place of the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, keep: Sequence[str | Column], computed: dict[str, Column]) -> DataFrame:
    """``keep`` next to the ``computed`` columns, which later filters cannot take apart.

    A filter on a computed column is normally moved below it, which evaluates the whole
    expression there a second time (and, through several steps, many times). Rows made by
    a generator stop that; filters on the kept columns still reach the scan.
    """
    row = F.struct(*[col.alias(name) for name, col in computed.items()])
    return df.select(*keep, F.inline(F.array(row)))
