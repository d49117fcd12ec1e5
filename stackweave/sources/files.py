"""Small files through Hadoop's file system, so that any store Spark reads will do."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if it is not there."""
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside its place and moves it there, replacing what was."""
    fs, p = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot replace {path}")


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, default=str))


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if fs.exists(_fs(spark, new)[1]):
        raise FileExistsError(new)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"cannot move {old} to {new}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def glob(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a pattern names."""
    fs, p = _fs(spark, pattern)
    return sorted((s.getPath().toString(), s.getLen()) for s in (fs.globStatus(p) or []))
