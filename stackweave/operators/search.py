"""The full-text index: postings of metadata fields and contents, queries, incremental updates.

An index generation is two tables: ``postings`` (term, item_id, field, asset_id) and
``records`` (what each item and asset was indexed as).  A query reads the postings of its
terms alone; terms are a pushed-down filter, and grouping is a partial count by field.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import files

ANALYZER_VERSION, EXTRACTOR_VERSION = "1", "1"
# Fields in the order hits list them, and what a scope takes in.
FIELDS = ("title", "authors", "tags", "content")
SCOPES = {"all": FIELDS, "metadata": ("title", "authors", "tags"), "title": ("title",), "authors": ("authors",), "tags": ("tags",), "content": ("content",)}
PAGE_LIMIT, PAGE_MOST = 50, 100
PDF_BYTES = 32 << 20


def scope_fields(scopes: list[str]) -> list[str]:
    """The fields of scopes; none at all means all."""
    wanted = {f for s in scopes or ["all"] for f in SCOPES[s]}
    return [f for f in FIELDS if f in wanted]


def asset_state(assets: DataFrame, items: DataFrame) -> DataFrame:
    """Assets of known items with the state they are indexed in.

    In order: external, unsupported media, missing, unreadable, too large, no text, indexed.
    """
    path = F.lower("path")
    state = (
        F.when(path.rlike(r"^\w+://"), "external")
        .when(~path.endswith(".pdf"), "unsupported")
        .when(F.col("status") == "missing", "missing")
        .when(F.col("status") == "unreadable", "unreadable")
        .when(F.col("file_size") > PDF_BYTES, "too_large")
        .when(F.coalesce(F.trim("content"), F.lit("")) == "", "no_text")
        .otherwise("indexed")
    )
    return assets.join(items.select("item_id").distinct(), "item_id", "left_semi").withColumn("state", state)


def metadata_fields(items: DataFrame, analyzer=tx.terms) -> DataFrame:
    """(item_id, field, asset_id, terms) of titles, authors and tags."""

    lists = {"authors": F.concat_ws("\n", "authors"), "tags": F.concat_ws("\n", "tags"), "title": F.coalesce("title", F.lit(""))}
    parts = F.array(*[F.struct(F.lit(f).alias("field"), lists[f].alias("text")) for f in ("title", "authors", "tags")])
    rows = items.select("item_id", F.explode(parts).alias("p")).select("item_id", "p.field", F.lit(None).cast(items.schema["item_id"].dataType).alias("asset_id"), "p.text")
    return rows.withColumn("terms", analyzer(F.col("text"))).drop("text")


def content_fields(indexed: DataFrame, analyzer=tx.terms) -> DataFrame:
    """(item_id, field, asset_id, terms) of indexed contents."""
    return indexed.where("state = 'indexed'").select("item_id", F.lit("content").alias("field"), "asset_id", analyzer(F.col("content")).alias("terms"))


def postings(fields: DataFrame) -> DataFrame:
    """One row for each distinct term of a field.

    The outer explode keeps the optimizer from filtering by the size of ``terms`` first,
    which would run the analyzer twice.
    """
    return fields.select(F.explode_outer("terms").alias("term"), "item_id", "field", "asset_id").where(F.col("term").isNotNull())


def build(items: DataFrame, assets: DataFrame, analyzer=tx.terms) -> tuple[DataFrame, DataFrame]:
    """(postings, records) of a full build; records hold the content for excerpts."""
    states = asset_state(assets, items)
    own = metadata_fields(items, analyzer).unionByName(content_fields(states, analyzer))
    fingerprints = items.select("item_id", tx.fingerprint(F.coalesce("title", F.lit("")), F.col("authors"), F.col("tags")).alias("metadata_fingerprint"))
    records = states.join(fingerprints, "item_id").select("item_id", "asset_id", F.when(F.col("state") == "indexed", F.col("content")).alias("content"), F.sha2(F.col("content"), 256).alias("content_hash"), "metadata_fingerprint", F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.lit(ANALYZER_VERSION).alias("analyzer_version"), "state")
    return postings(own), records


def issues(records: DataFrame) -> DataFrame:
    """Assets that are not indexed, by kind."""
    return records.where("state not in ('indexed', 'external')").select("item_id", "asset_id", F.col("state").alias("kind"))


def field_matches(index: DataFrame, query: list[str], scopes: list[str] | None = None) -> DataFrame:
    """(item_id, field, asset_id) of the fields in scope that hold every term of the query."""
    hits = index.where(F.col("term").isin(query) & F.col("field").isin(scope_fields(scopes or [])))
    # postings hold a term of a field once, so a plain count will do: one shuffle less than a distinct one
    return hits.groupBy("item_id", "field", "asset_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(query))).drop("n")


def hits(matches: DataFrame) -> DataFrame:
    """(item_id, has_metadata, field_matches): an item's matches in the order of fields and assets."""
    rank = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))
    return matches.groupBy("item_id").agg(F.max((F.col("field") != "content").cast("int")).alias("has_metadata"), F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "asset_id", "field"))).alias("field_matches"))


def search(index: DataFrame, records: DataFrame, text: str, scopes: list[str] | None = None, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page of hits with excerpts, one row with total_hits): items with metadata hits first, then by id."""
    query = tx.analyze(text)
    limit = PAGE_LIMIT if limit is None else min(max(limit, 1), PAGE_MOST)
    matches = field_matches(index, query, scopes) if query else index.limit(0).select("item_id", "field", "asset_id")
    found = hits(matches)
    page = found.orderBy(F.desc("has_metadata"), "item_id").offset(offset).limit(limit)
    shown = page.select("item_id", "has_metadata", F.explode("field_matches").alias("m")).select("item_id", "has_metadata", "m.rank", "m.field", "m.asset_id")
    with_text = shown.join(records.select("item_id", "asset_id", "state", tx.excerpt(F.col("content"), query or [""]).alias("excerpt")), ["item_id", "asset_id"], "left")
    return with_text.drop("rank"), found.agg(F.count(F.lit(1)).alias("total_hits"))


def reusable(records: DataFrame, assets: DataFrame) -> DataFrame:
    """(item_id, asset_id) of assets that would be indexed as they were: same content hash, same versions, and indexed then."""
    was = records.where((F.col("state") == "indexed") & (F.col("extractor_version") == EXTRACTOR_VERSION) & (F.col("analyzer_version") == ANALYZER_VERSION)).select("item_id", "asset_id", F.col("content_hash").alias("__was"))
    return assets.select("item_id", "asset_id", F.sha2(F.col("content"), 256).alias("__is")).join(was, ["item_id", "asset_id"]).where("__is = __was").select("item_id", "asset_id").distinct()


def update(index: DataFrame, records: DataFrame, items: DataFrame, assets: DataFrame, changes: DataFrame, analyzer=tx.terms) -> tuple[DataFrame, DataFrame]:
    """The index after changes (kind, item_id, asset_id): what is affected is built anew, the rest is kept.

    Kinds: item_removed, metadata_changed, asset_removed, asset_changed.  A removed item
    beats all; a removed asset beats a changed one.  A changed asset whose content is as it
    was indexed, under the present versions, keeps its postings.
    """
    c = changes.dropDuplicates(["kind", "item_id", "asset_id"])
    same = reusable(records, asset_state(assets, items).where("state = 'indexed'")).withColumn("kind", F.lit("asset_changed"))
    c = c.join(same, ["kind", "item_id", "asset_id"], "left_anti")
    gone_items = c.where("kind = 'item_removed'").select("item_id").distinct()
    meta = c.where("kind = 'metadata_changed'").select("item_id").distinct().join(gone_items, "item_id", "left_anti")
    touched = c.where("kind in ('asset_removed', 'asset_changed')").select("item_id", "asset_id").distinct()
    changed = c.where("kind = 'asset_changed'").select("item_id", "asset_id").distinct().join(c.where("kind = 'asset_removed'").select("item_id", "asset_id").distinct(), ["item_id", "asset_id"], "left_anti").join(gone_items, "item_id", "left_anti")
    kept = index.join(gone_items, "item_id", "left_anti")
    is_content = F.col("field") == "content"
    kept_meta = kept.where(~is_content).join(meta, "item_id", "left_anti")
    kept_content = kept.where(is_content).join(touched, ["item_id", "asset_id"], "left_anti")
    new_index, new_records = build(items.join(meta, "item_id", "left_semi"), assets.limit(0), analyzer)[0], None
    content_index, new_records = build(items, assets.join(changed, ["item_id", "asset_id"], "left_semi"), analyzer)
    out = kept_meta.unionByName(kept_content).unionByName(new_index).unionByName(content_index.where(is_content))
    fresh = items.join(meta, "item_id", "left_semi").select("item_id", tx.fingerprint(F.coalesce("title", F.lit("")), F.col("authors"), F.col("tags")).alias("fresh"))
    old = records.join(gone_items, "item_id", "left_anti").join(touched, ["item_id", "asset_id"], "left_anti").join(fresh, "item_id", "left")
    old = old.withColumn("metadata_fingerprint", F.coalesce("fresh", "metadata_fingerprint")).select(*records.columns)
    return out, old.unionByName(new_records.select(*records.columns))


def state_of(pointer: dict | None, issues_: Column) -> Column:
    """missing, stale (another analyzer or extractor), degraded (assets that are not indexed), or ready."""
    if pointer is None:
        return F.lit("missing")
    if (pointer.get("analyzer"), pointer.get("extractor")) != (ANALYZER_VERSION, EXTRACTOR_VERSION):
        return F.lit("stale")
    return F.when(issues_ > 0, "degraded").otherwise("ready")


def index_state(spark: SparkSession, root: str) -> str:
    """missing, building, failed, stale, degraded or ready."""
    pointer = files.read_json(spark, f"{root}/manifest.json")
    if pointer is None:
        return next((s for s in ("failed", "building") if files.exists(spark, f"{root}/{s}.json")), "missing")
    if (pointer.get("analyzer"), pointer.get("extractor")) != (ANALYZER_VERSION, EXTRACTOR_VERSION):
        return "stale"
    return "degraded" if pointer.get("issues") else "ready"


def stale_reason(spark: SparkSession, root: str) -> str | None:
    """What made an index stale: its analyzer, its extractor, or both."""
    pointer = files.read_json(spark, f"{root}/manifest.json") or {}
    own = {"analyzer": ANALYZER_VERSION, "extractor": EXTRACTOR_VERSION}
    return ", ".join(k for k, v in own.items() if pointer and pointer.get(k) != v) or None


def search_published(spark: SparkSession, root: str, text: str, scopes: list[str] | None = None, limit: int | None = None, offset: int = 0) -> tuple[str, DataFrame | None, DataFrame | None]:
    """(state, page, total): a search of the current generation; no page where its state allows none."""
    state = index_state(spark, root)
    if state not in ("ready", "degraded"):
        return state, None, None
    return state, *search(*load(spark, root, tx.analyze(text)), text, scopes, limit, offset)


def publish(spark: SparkSession, root: str, index: DataFrame, records: DataFrame, buckets: int = 16, files_a_shard: int = 4) -> str:
    """Writes a generation and then switches the pointer to it; readers see the old one until then.

    A query reads the shards of its terms.  A shard is written by ``files_a_shard`` tasks,
    dealt by item, so that a term in most items is in no single task; both grow with the
    postings.
    """
    generation = uuid.uuid4().hex
    if files.read_json(spark, f"{root}/manifest.json") is None:
        files.write_json(spark, f"{root}/building.json", {"generation": generation})
    try:
        shard = F.pmod(F.xxhash64("term"), F.lit(buckets))
        part = F.pmod(F.xxhash64("item_id"), F.lit(files_a_shard))
        index.withColumn("shard", shard).repartition(buckets * files_a_shard, "shard", part).sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{root}/generations/{generation}/postings")
        records.write.parquet(f"{root}/generations/{generation}/records")
        written = spark.read.parquet(f"{root}/generations/{generation}/records")
        files.write_json(spark, f"{root}/manifest.json", {"generation": generation, "analyzer": ANALYZER_VERSION, "extractor": EXTRACTOR_VERSION, "buckets": buckets, "issues": issues(written).count()})
    except BaseException:
        if index_state(spark, root) in ("missing", "building"):
            files.write_json(spark, f"{root}/failed.json", {"generation": generation})
        raise
    return generation


def load(spark: SparkSession, root: str, query: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, records) of the current generation; a query's terms name the shards that are read."""
    if (state := index_state(spark, root)) not in ("ready", "degraded"):
        raise RuntimeError(f"the search index is {state}")
    pointer = files.read_json(spark, f"{root}/manifest.json")
    base = f"{root}/generations/{pointer['generation']}"
    index = spark.read.parquet(f"{base}/postings")
    if query is not None:
        shards = [r[0] for r in spark.createDataFrame([(t,) for t in query] or [("",)], "t string").select(F.pmod(F.xxhash64("t"), F.lit(pointer["buckets"]))).collect()]
        index = index.where(F.col("shard").isin(shards))
    return index.drop("shard"), spark.read.parquet(f"{base}/records")
