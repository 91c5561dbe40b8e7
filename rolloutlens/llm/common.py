"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table_path

#: Documents handled at once inside a task, whatever the size of an Arrow batch.
SLICE = 512
#: Null ids are one document that comes after all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)).cast("int")


def unit_hash(*cols: Column, salt: str) -> Column:
    """A number in [0, 1) from a 53-bit hash of the columns: the same for the
    same row in every run and on every cluster."""
    h = F.xxhash64(F.lit(salt), *cols).bitwiseAND(F.lit((1 << 53) - 1))
    return h.cast("double") / F.lit(float(1 << 53))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Text column as Python strings; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once under the session's shared checkpoint folder and reread."""
    return materialize(df, name)
