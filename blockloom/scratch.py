"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from .files import Files


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job go when the job is done, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


class Scratch:
    """Tables written once and read back: they cut lineage and outlive lost executors. ``lean`` ones take less disk: their shuffle files go once they are written, and zstd packs them."""

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark, self.lean = spark, lean
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """``df`` as a written table, in folders by the columns named."""
        with tidy(self.spark) if self.lean else nullcontext():
            # Spark reads the setting where a frame is made.
            writer = (df.select("*").write.option("compression", "zstd") if self.lean else df.write).mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name)).select(df.columns)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            Files(self.spark).delete(self.path(name))

    def close(self) -> None:
        """Deletes all tables of this name."""
        Files(self.spark).delete(self.root)
