"""Rows on their way through Python: batches small enough for long texts, and ids that stay exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's own defaults, and what takes their place where the session keeps them: rows and bytes of a batch.
_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b"),
}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what a Python worker holds at once while the jobs inside run; the session is as before afterwards. A longer text is a batch of its own."""
    before = {key: spark.conf.get(key, None) for key in _LIMITS}
    changed = [key for key, (default, _) in _LIMITS.items() if before[key] in (None, default)]
    for key in changed:
        spark.conf.set(key, _LIMITS[key][1])
    try:
        yield
    finally:
        for key in changed:
            if before[key] is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before[key])


def slices(batches: Iterator[pd.DataFrame], rows: int = 250) -> Iterator[pd.DataFrame]:
    """The batches in parts of so many rows, so that what is made of them is as bounded."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo : lo + rows]


def map_rows(rows: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, *ids: str) -> DataFrame:
    """``mapInPandas`` with exact 64-bit ids.

    pandas turns integers to floats where a batch has a null among them, so the
    columns ``ids`` go through as text, on the way in and out.
    """
    made = T.StructType.fromDDL(schema)
    given = rows.withColumns({c: F.col(c).cast("string") for c in ids if c in rows.columns})
    through = T.StructType([T.StructField(f.name, T.StringType() if f.name in ids else f.dataType) for f in made])
    out = given.mapInPandas(function, through)
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in made))
