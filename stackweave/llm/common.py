"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests, a laptop) gets a temporary folder,
    which is removed when the process ends; on a cluster its absence is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="stackweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    A lost executor then costs a reread of files instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from here on in this session.

    Rows are whole texts: Spark's 10,000 of them would fill tens of MB in the executor and
    again in the Python worker, for each task.  A setting that is lower stays.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "0")) <= rows:
        spark.conf.set(setting, str(rows))


def utf8(column: str) -> Column:
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def lowest_hashes(df: DataFrame, hash_: Column, n: int, total: int, where: Column | None = None) -> DataFrame:
    """Up to ``n`` rows of the lowest 64-bit hashes, of the ``total`` rows that ``where`` picks.

    Rows far above are left out first, so that what meets in one place follows ``n`` and
    not the number of partitions, and ``where`` is asked of few rows.
    """
    share = min(1.0, (2 * n + 50) / max(total, 1))
    near = df if share == 1.0 else df.where(hash_ <= int(-(2**63) + share * 2**64) - 1)
    return (near if where is None else near.where(where)).orderBy(hash_).limit(n)


def words(blob: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes: ``bytes.split`` splits at just those."""
    return blob.split() if blob else []


def batches_of(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a record batch with about ``limit`` bytes of ``column`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
