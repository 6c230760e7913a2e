"""What several text operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.split() splits at exactly [\x20\x09-\x0D] and bytes.lower() lowers
#: exactly A-Z, so words of whole texts come from these two on UTF-8 bytes.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: bytes of text that a Python task gets at once where ``small_batches`` was called; a longer text comes alone
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session end at ``BATCH_BYTES``, unless the session has a setting of its own.

    A batch is held several times at once, by the executor while it grows and
    by the Python worker with its list of texts and its results, and neither
    gives all of that memory back. Spark's own limit is 64 MB.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


#: bits of a filter of bounded size, 128 KB as a literal of a plan; a false hit costs work only
CELLS = 1 << 20


def cells_of(keys: DataFrame, key: str) -> bytes:
    """A bit per cell, one where some key falls; at most ``CELLS`` numbers reach the driver."""
    out = bytearray(CELLS // 8)
    for r in keys.select(_cell(F.col(key)).alias("cell")).distinct().toLocalIterator():
        out[r["cell"] // 8] |= 1 << r["cell"] % 8
    return bytes(out)


def _cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def in_cells(key: Column, cells: bytes) -> Column:
    """False only for values that are no key."""
    # one literal of numbers, which Spark folds into an array before it runs
    bytes_ = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<int>")
    return F.get(bytes_, F.shiftright(_cell(key), 3)).bitwiseAND(F.call_function("shiftleft", F.lit(1), _cell(key) % 8)) != 0
