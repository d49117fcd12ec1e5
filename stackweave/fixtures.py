"""Views that give the test tables the shapes of a literature library.

Each view is one SQL text that Spark and DuckDB both run, so that a query and its check
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "sources": """
SELECT concat('S', CAST(s.s_suppkey AS STRING)) AS openalex_id, s.s_name AS display_name,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'journal' WHEN 1 THEN 'conference' ELSE 'repository' END AS source_type,
  concat('0000-', CAST(1000 + s.s_suppkey AS STRING)) AS issn_l,
  concat('N', substring(n.n_name, 8, 1)) AS country_code,
  CAST(coalesce(l.works, 0) AS BIGINT) AS works_count, CAST(coalesce(l.oa, 0) AS BIGINT) AS oa_works_count,
  CAST(coalesce(l.cited, 0) AS BIGINT) AS cited_by_count,
  CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE CAST((s.s_suppkey * 37) % 101 AS BIGINT) END AS h_index,
  CASE WHEN s.s_suppkey % 11 = 0 THEN NULL ELSE CAST((s.s_suppkey * 53) % 211 AS BIGINT) END AS i10_index,
  CASE WHEN s.s_suppkey % 13 = 0 THEN NULL ELSE CAST((s.s_suppkey * 29) % 97 AS DOUBLE) / 8 END AS mean_citedness_2yr,
  s.s_acctbal > 0 AS is_oa, s.s_suppkey % 5 = 0 AS is_in_doaj,
  concat('https://source', CAST(s.s_suppkey AS STRING), '.example.org') AS homepage_url,
  CAST(s.s_suppkey % 9 * 100 AS BIGINT) AS apc_usd
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_suppkey, count(*) AS works, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS oa, sum(l_linenumber) AS cited
           FROM lineitem GROUP BY l_suppkey) l ON l.l_suppkey = s.s_suppkey""",
    "items": """
SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, source AS author, lang AS tag, text AS content,
  CASE doc_id % 4 WHEN 0 THEN 'inbox' WHEN 1 THEN 'reading' WHEN 2 THEN 'read' ELSE 'archived' END AS reading_status,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1980 + doc_id % 45 AS INT) END AS published_year
FROM documents""",
    # every customer is in both: what does not match differs in its identifiers
    "records": """
SELECT c_custkey AS record_id, c_name AS title,
  CASE WHEN c_custkey % 3 = 0 THEN concat('10.1000/OTHER', CAST(c_custkey AS STRING)) ELSE concat('10.1000/CUST', CAST(c_custkey - c_custkey % 2 AS STRING)) END AS doi,
  concat(CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'pm' END, CAST(c_custkey AS STRING)) AS pmid, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS volume
FROM customer""",
    "library": """
SELECT c_custkey AS item_id, CASE WHEN c_custkey % 5 < 2 THEN '' ELSE c_name END AS title, concat('10.1000/cust', CAST(c_custkey AS STRING)) AS doi,
  concat('pm', CAST(c_custkey * 2 AS STRING)) AS pmid
FROM customer""",
    "assets": """
SELECT d.doc_id AS asset_id, d.doc_id AS item_id, concat('papers/', CAST(d.doc_id AS STRING), CASE WHEN d.doc_id % 10 = 9 THEN '.txt' ELSE '.pdf' END) AS path,
  d.n_chars AS file_size, d.text AS content, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'unreadable' ELSE 'available' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "sessions": """
SELECT event_id AS session_id, user_id AS item_id, user_id % 10 AS asset_id, ts AS started_at, ts AS last_opened_at,
  CASE event_type WHEN 'error' THEN 'closed' WHEN 'purchase' THEN 'closed' WHEN 'view' THEN 'paused' ELSE 'active' END AS state
FROM events""",
    "notes": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS note_id, conv_id AS item_id, turn AS updated_at, text AS markdown_body,
  CASE WHEN role = 'system' THEN turn END AS archived_at
FROM conversations""",
}


def _uses(sql: str) -> list[str]:
    return [t for t in TABLES if t in sql]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of ``sf_dir``."""
    for t in _uses(VIEWS[name]):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """SQL with the fixture views it names as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
