"""Rows of a stored table by their number as scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number isn't among ``gone``'s rid, with their columns, whatever their names.

    ``docs`` has to be a stored table: its rows are numbered as scanned, once by the operator and once here.
    """
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    return numbered.join(gone.select(F.col("rid").alias(name)), name, "left_anti").drop(name)
