"""Declared schemas, metric names and the type mapping of stored values."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructField, StructType

SOURCES_DDL = """
openalex_id string, display_name string, source_type string, issn_l string, works_count bigint, oa_works_count bigint,
cited_by_count bigint, mean_citedness_2yr double, h_index bigint, i10_index bigint, is_oa boolean, is_in_doaj boolean,
is_high_oa_rate boolean, is_in_scielo boolean, is_ojs boolean, is_core boolean, first_publication_year int,
last_publication_year int, homepage_url string, apc_usd bigint, country_code string, openalex_updated_at string,
openalex_created_at string"""

IDENTIFIER = StructType([StructField("namespace", StringType()), StructField("value", StringType())])
SOURCE_REF = StructType([StructField("source_name", StringType()), StructField("external_id", StringType()), StructField("original_locator", StringType())])
FILE_REF = StructType([StructField("file_id", StringType()), StructField("path", StringType()), StructField("display_name", StringType())])

SOURCE_RECORD = StructType(
    [
        StructField("record_id", StringType()),
        StructField("source_name", StringType()),
        StructField("external_id", StringType()),
        StructField("external_identifiers", ArrayType(IDENTIFIER)),
        StructField("title", StringType()),
        StructField("authors", ArrayType(StringType())),
        StructField("published_year", IntegerType()),
        StructField("item_type", StringType()),
        StructField("abstract_text", StringType()),
        StructField("keywords", ArrayType(StringType())),
        StructField("pages", StringType()),
        StructField("volume", StringType()),
        StructField("raw_fields", MapType(StringType(), StringType())),
    ]
)

LITERATURE_ITEM = StructType(
    [
        StructField("item_id", StringType()),
        StructField("title", StringType()),
        StructField("authors", ArrayType(StringType())),
        StructField("published_year", IntegerType()),
        StructField("item_type", StringType()),
        StructField("favorite", BooleanType()),
        StructField("reading_status", StringType()),
        StructField("tags", ArrayType(StringType())),
        StructField("sources", ArrayType(SOURCE_REF)),
        StructField("files", ArrayType(FILE_REF)),
        StructField("default_file_id", StringType()),
        StructField("external_identifiers", ArrayType(IDENTIFIER)),
    ]
)

ASSET_DDL = "asset_id string, item_id string, asset_kind string, storage_kind string, path string, display_name string, media_type string, file_size bigint, content_hash string, imported_at string, is_default boolean"
SESSION_DDL = "session_id string, item_id string, asset_id string, started_at timestamp, last_opened_at timestamp, ended_at timestamp, state string"
NOTE_DDL = "note_id string, item_id string, created_at string, updated_at string, archived_at string, title string, markdown_body string, revision string"
REF_TABLE_DDL = "xpath string, ref_id string, address string"

# Metric names.
METRICS = ("works_count", "cited_by_count", "h_index", "i10_index", "mean_citedness_2yr", "citations_per_work", "oa_rate")

# Stored scalar kinds and the types they are read as.  Wider unsigned numbers
# widen; what Spark has no type for is text.
SCALARS = {
    "null": NullType(),
    "bool": BooleanType(),
    "i8": ByteType(),
    "i16": ShortType(),
    "i32": IntegerType(),
    "i64": LongType(),
    "u8": ShortType(),
    "u16": IntegerType(),
    "u32": LongType(),
    "u64": DecimalType(20, 0),
    "f32": FloatType(),
    "f64": DoubleType(),
    "utf8": StringType(),
    "binary": BinaryType(),
    "date32": DateType(),
    "decimal256": StringType(),
}


def assert_schema(df, expected: StructType) -> None:
    """Names and types must be those expected, in order; nullability is not compared."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in expected.fields]
    if got != want:
        raise ValueError(f"schema mismatch: {got} instead of {want}")
