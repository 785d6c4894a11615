"""Helpers shared by the operators: slices of Arrow batches, checkpoints, bounded samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from triagelake.session import cut_lineage, shared_dir

#: White space of the contracts: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of one Arrow batch that are Python objects at a time.
SLICE = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; later plans restart from its files."""
    return cut_lineage(df)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[list[list]]:
    """The columns of each slice of rows as Python lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [c.to_pylist() for c in part.columns]


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no model may learn labels from: crc32 of the id's text divides evenly."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def share_of(key: Column, wanted: int, available: int) -> Column:
    """True for about ``wanted`` of ``available`` rows, chosen by a hash of their key."""
    scale = 1 << 20
    take = scale if available <= wanted else max(1, wanted * scale // available)
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(scale)) < take


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that an earlier step has written, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


__all__ = ["SPACE", "SLICE", "documents", "saved", "slices", "partition_id", "held_out", "share_of", "removed", "shared_dir"]
