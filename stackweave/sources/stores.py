"""User stores in JSON: items, assets, sessions, import batches; block objects; texts of documents."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..schemas import ASSET_DDL, LITERATURE_ITEM, SESSION_DDL, SOURCE_RECORD
from . import files

# Limits of a document's text layer.
PDF_BYTES, PDF_PAGES, PDF_CHARS, PAGES_AT_ONCE = 32 << 20, 500, 2_000_000, 8


def schema_of(kind: str) -> StructType:
    """The declared schema of a store; DDL is parsed by the running session."""
    return {"items": lambda: LITERATURE_ITEM, "assets": lambda: StructType.fromDDL(ASSET_DDL), "sessions": lambda: StructType.fromDDL(SESSION_DDL)}[kind]()


def read_store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A store's rows with their declared schema; a store that is not there is empty, missing lists too."""
    schema = schema_of(kind)
    df = spark.read.schema(schema).json(path, multiLine=True) if files.exists(spark, path) else spark.createDataFrame([], schema)
    lists = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in schema.fields if f.dataType.typeName() == "array"}
    return df.withColumns(lists) if lists else df


def legacy_assets(items: DataFrame) -> DataFrame:
    """Assets from the files that items used to list; an item's default file is its default asset."""
    rows = items.select("item_id", "default_file_id", F.explode("files").alias("f"))
    values = {"asset_id": F.col("f.file_id"), "item_id": F.col("item_id"), "asset_kind": F.lit("document"), "storage_kind": F.lit("managed"), "path": F.col("f.path"), "display_name": F.col("f.display_name"), "is_default": F.coalesce(F.col("f.file_id") == F.col("default_file_id"), F.lit(False))}
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of("assets").fields])


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Import batches of a folder's JSON files, the oldest first."""
    schema = StructType.fromDDL("batch_id string, imported_at string").add("records", ArrayType(SOURCE_RECORD))
    return spark.read.schema(schema).json(f"{folder}/*.json", multiLine=True).orderBy("imported_at")


def payload_lines(text: str) -> list[str]:
    """JSON texts of the works in a payload: an object, an array of objects, or one a line; blank is none."""
    if not text.strip():
        return []
    try:
        got = json.loads(text)
    except ValueError:
        got = [json.loads(line) for line in text.splitlines() if line.strip()]
    got = got if isinstance(got, list) else [got]
    if not all(isinstance(x, dict) for x in got):
        raise ValueError("a payload holds objects")
    return [json.dumps(x) for x in got]


def block_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(address, payload) of the block files under a folder, the address from the file's name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("address"), F.col("content").alias("payload"))


Extractor = Callable[[bytes], list[str]]


class Encrypted(ValueError):
    """What an extractor raises for a document that it may not read."""


def text_layers(documents: DataFrame, extract: Extractor, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, outcome, text, pages): a document's text by a pluggable extractor, or why there is none.

    Outcomes: indexed, no_text, encrypted, too_large, too_many_pages, too_much_text, failed.
    Documents over the size limit are never opened.
    """

    def outcome(blob: bytes | None) -> tuple[str, str | None, int]:
        if blob is None:
            return "failed", None, 0
        if len(blob) > PDF_BYTES:
            return "too_large", None, 0
        try:
            pages = extract(blob)
        except Encrypted:
            return "encrypted", None, 0
        except Exception:  # noqa: BLE001 - whatever a broken document does to an extractor is an outcome
            return "failed", None, 0
        if len(pages) > PDF_PAGES:
            return "too_many_pages", None, len(pages)
        text = "\n".join(p.strip() for p in pages).strip()
        if len(text) > PDF_CHARS:
            return "too_much_text", None, len(pages)
        return ("indexed", text, len(pages)) if text else ("no_text", None, len(pages))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, PAGES_AT_ONCE):
                part = b.slice(i, PAGES_AT_ONCE)
                got = [outcome(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True))], ["path", "outcome", "text", "pages"])

    return documents.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, outcome string, text string, pages int")


class Epochs:
    """Commits in a folder: data first, then a row that names it; readers take the newest row whose check holds.

    A commit that broke off leaves data without a valid row, which no reader sees.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self) -> list[dict]:
        import hashlib

        out = []
        for path, _ in files.glob(self.spark, f"{self.root}/commits/*.json"):
            try:
                row = files.read_json(self.spark, path)
            except ValueError:
                continue
            body = {k: v for k, v in row.items() if k != "check"} if isinstance(row, dict) else {}
            if isinstance(row, dict) and row.get("check") == hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
                out.append(row)
        return sorted(out, key=lambda r: r["sequence"])

    def commit(self, df: DataFrame) -> int:
        import hashlib
        import uuid

        rows = self._rows()
        sequence = rows[-1]["sequence"] + 1 if rows else 0
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{name}")
        body = {"sequence": sequence, "parent": rows[-1]["sequence"] if rows else None, "data": name}
        files.write_json(self.spark, f"{self.root}/commits/{sequence:020d}.json", body | {"check": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()})
        return sequence

    def head(self) -> DataFrame | None:
        rows = self._rows()
        return self.spark.read.parquet(f"{self.root}/data/{rows[-1]['data']}") if rows else None

    def sweep(self, keep: int = 1) -> list[str]:
        """Deletes data that none of the newest ``keep`` commits names."""
        live = {r["data"] for r in self._rows()[-keep:]}
        gone = [p for p, _ in files.glob(self.spark, f"{self.root}/data/*") if p.rsplit("/", 1)[-1] not in live]
        for p in gone:
            files.delete(self.spark, p)
        return gone
