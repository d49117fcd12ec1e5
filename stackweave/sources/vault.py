"""Vaults: a folder with a manifest and tables in Parquet or Arrow files."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators import ranking
from . import files

FORMAT_VERSION = "1"
# The tables a vault may hold.
TABLES = ("sources", "source_year_metrics", "source_topics", "source_issns")


def safe_relative(path: str) -> str:
    """A path inside the vault; absolute ones and ones that lead out are refused."""
    if not path or path.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:|^\w+://", path) or ".." in re.split(r"[/\\]", path):
        raise ValueError(f"not a path inside the vault: {path}")
    return path


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (file or stream format), a task for each file, in batches."""
    blobs = spark.read.format("binaryFile").load(path).select("content")
    first = blobs.limit(1).collect()
    if not first:
        raise FileNotFoundError(path)

    def open_ipc(blob: bytes):
        return pa.ipc.open_file(blob) if blob[:6] == b"ARROW1" else pa.ipc.open_stream(blob)

    schema = open_ipc(bytes(first[0][0])).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def read(batches):
        for b in batches:
            for blob in b.column(0):
                yield from open_ipc(blob.as_py()).read_all().to_batches()

    return blobs.mapInArrow(read, from_arrow_schema(schema))


@dataclass
class Vault:
    """An opened vault.  ``layout`` is auto (Arrow if it is there, else Parquet), parquet or arrow."""

    spark: SparkSession
    root: str
    manifest: dict
    layout: str = "auto"
    single: dict[str, str] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, root: str, layout: str = "auto") -> Vault:
        manifest = files.read_json(spark, f"{root}/manifest.json")
        if manifest is None:
            raise FileNotFoundError(f"{root}/manifest.json")
        for t in manifest["tables"].values():
            for kind in ("parquet", "arrow"):
                if t.get(kind):
                    safe_relative(t[kind]["path"])
        return cls(spark, root, manifest, layout)

    @classmethod
    def open_file(cls, spark: SparkSession, path: str) -> Vault:
        """A vault of one table: ``.arrow`` and ``.ipc`` are Arrow, all else Parquet."""
        kind = "arrow" if path.endswith((".arrow", ".ipc")) else "parquet"
        manifest = {"format_version": FORMAT_VERSION, "tables": {"sources": {"rows": 0, "primary_key": ["openalex_id"], kind: {"path": path}}}}
        return cls(spark, "", manifest, "auto", {"sources": path})

    @classmethod
    def open_any(cls, spark: SparkSession, path: str) -> Vault:
        return cls.open(spark, path) if files.exists(spark, f"{path}/manifest.json") else cls.open_file(spark, path)

    def table_path(self, name: str) -> str:
        """The file of a table by the layout, or the other one if that is missing."""
        if name in self.single:
            return self.single[name]
        entry = self.manifest["tables"].get(name)
        if not entry:
            raise KeyError(f"the vault has no table {name}")
        order = ("parquet", "arrow") if self.layout == "parquet" else ("arrow", "parquet")
        for kind in order:
            if entry.get(kind) and files.exists(self.spark, path := f"{self.root}/{entry[kind]['path']}"):
                return path
        raise FileNotFoundError(name)

    def scan(self, name: str = "sources") -> DataFrame:
        path = self.table_path(name)
        return read_arrow(self.spark, path) if path.endswith((".arrow", ".ipc")) else self.spark.read.parquet(path)

    def overview(self) -> DataFrame:
        return ranking.overview(self.scan())

    def top_sources(self, by: str, limit: int, source_type: str | None = "journal") -> DataFrame:
        return ranking.top_sources(self.scan(), by, limit, source_type)

    def search_sources(self, **query) -> DataFrame:
        return ranking.search_sources(self.scan(), **query)


def inspect_partitions(spark: SparkSession, raw: str, part: str = "part_0000.parquet") -> dict:
    """Number and bytes of the raw partitions, and the snapshot's date; none is an error."""
    found = files.glob(spark, f"{raw}/updated_date=*/{part}")
    if not found:
        raise FileNotFoundError(f"no partitions in {raw}")
    return {"partitions": len(found), "bytes": sum(n for _, n in found), "has_manifest": files.exists(spark, f"{raw}/manifest.json"), "snapshot_date": snapshot_date(spark, raw)}


def snapshot_date(spark: SparkSession, raw: str) -> str | None:
    """``date`` of the raw manifest; null if it cannot be read."""
    try:
        got = files.read_json(spark, f"{raw}/manifest.json")
    except ValueError:
        return None
    return got.get("date") if isinstance(got, dict) and isinstance(got.get("date"), str) else None


def raw_sources(spark: SparkSession, raw: str, part: str = "part_0000.parquet") -> DataFrame:
    """The raw partitions with their hive key."""
    return spark.read.option("basePath", raw).parquet(f"{raw}/updated_date=*/{part}")


def import_sources(spark: SparkSession, raw: str, destination: str, with_arrow: bool = False) -> Vault:
    """Builds a vault beside its place, the manifest last, and moves it there; the place must be free."""
    found = inspect_partitions(spark, raw)
    if files.exists(spark, destination):
        raise FileExistsError(destination)
    staging = f"{destination.rstrip('/')}.building-{uuid.uuid4().hex}"
    try:
        ranking.import_projection(raw_sources(spark, raw)).write.parquet(f"{staging}/tables/sources.parquet")
        rows = spark.read.parquet(f"{staging}/tables/sources.parquet")
        entry = {"rows": rows.count(), "primary_key": ["openalex_id"], "parquet": {"path": "tables/sources.parquet"}}
        if with_arrow:
            write_arrow(rows, f"{staging}/tables/sources.arrow")
            entry["arrow"] = {"path": "tables/sources.arrow"}
        files.write_json(spark, f"{staging}/manifest.json", {"format_version": FORMAT_VERSION, "vault_id": uuid.uuid4().hex, "logical_schema_version": 1, "created_at": datetime.now(UTC).isoformat(), "source": {"name": "OpenAlex", "entity": "sources", "snapshot_date": found["snapshot_date"], "input_path": raw}, "tables": {"sources": entry}})
        files.rename(spark, staging, destination)
    except BaseException:
        files.delete(spark, staging)
        raise
    return Vault.open(spark, destination)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow stream for each partition, as rows of bytes under ``path``: no partition leaves its executor."""
    import os

    def encode(batches):
        sink, writer = pa.BufferOutputStream(), None
        for b in batches:
            writer = writer or pa.ipc.new_stream(sink, b.schema)
            writer.write_batch(b)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"content": [sink.getvalue().to_pybytes()]})

    local = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with pa.OSFile(local, "wb") as f:
        writer = None
        for row in df.mapInArrow(encode, "content binary").toLocalIterator():
            for b in pa.ipc.open_stream(row[0]):
                writer = writer or pa.ipc.new_file(f, b.schema)
                writer.write_batch(b)
        if writer is None:
            writer = pa.ipc.new_file(f, df.limit(0).toArrow().schema)
        writer.close()
