"""The library: list filters, identity matching, imports and merges, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import MATCHING


def list_items(items: DataFrame, keyword: str = "", status: str | None = None, limit: int | None = None) -> DataFrame:
    """Items with a keyword in their title, an author or a tag, and of a status."""
    rows = items
    if keyword.strip():
        k = keyword.strip().lower()

        def has(x: Column) -> Column:
            return F.lower(x).contains(k)

        rows = rows.where(F.coalesce(has(F.col("title")), F.lit(False)) | F.exists(F.coalesce("authors", F.array().cast("array<string>")), has) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), has))
    if status is not None:
        rows = rows.where(F.col("reading_status") == status)
    return rows if limit is None else rows.orderBy("item_id").limit(limit)


def identifier_rows(rows: DataFrame, id_col: str, identifiers_col: str = "external_identifiers") -> DataFrame:
    """(id, place, namespace, value) of the identifiers that matching looks at, values in lower case."""
    return rows.select(F.col(id_col), F.posexplode(identifiers_col).alias("place", "i")).where(F.col("i.namespace").isin(*MATCHING)).select(id_col, "place", F.col("i.namespace").alias("namespace"), F.lower("i.value").alias("value"))


def identity_match(records: DataFrame, items: DataFrame) -> DataFrame:
    """(record_id, item_id): for each record the item of its first identifier that any item has, the first item of several.

    ``items`` are in the order of item_id.  Of items with one identifier the first is kept
    before the join, so a value that many items share never multiplies.
    """
    owners = identifier_rows(items, "item_id").groupBy("namespace", "value").agg(F.min("item_id").alias("item_id"))
    hits = identifier_rows(records, "record_id").join(owners, ["namespace", "value"])
    return hits.groupBy("record_id").agg(F.min_by("item_id", "place").alias("item_id"))


def import_preview(records: DataFrame, items: DataFrame) -> DataFrame:
    """Records with the item they match (null if none) and the default policy."""
    match = identity_match(records, items).withColumnRenamed("item_id", "matched_item_id")
    return records.join(match, "record_id", "left").withColumn("policy", F.lit("merge"))


def import_outcome(policy: Column, matched: Column) -> Column:
    """skipped, created, or merged; a merge without a match creates."""
    return F.when(policy == "skip", "skipped").when((policy == "merge") & matched.isNotNull(), "merged").otherwise("created")


def import_counts(preview: DataFrame) -> DataFrame:
    out = import_outcome(F.col("policy"), F.col("matched_item_id"))
    return preview.agg(*[F.count_if(out == k).alias(k) for k in ("created", "merged", "skipped")], F.lit(0).cast("bigint").alias("errors"))


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def add_identifiers(own: Column, more: Column) -> Column:
    """Identifiers of ``more`` that are not in ``own`` (namespace, and value in any case) put behind it."""

    def known(i: Column, among: Column) -> Column:
        return F.exists(among, lambda o: (o["namespace"] == i["namespace"]) & (F.lower(o["value"]) == F.lower(i["value"])))

    return F.concat(own, F.filter(more, lambda i: ~known(i, own)))


def merge_into_items(items: DataFrame, records: DataFrame, matches: DataFrame) -> DataFrame:
    """Items with the blanks filled from the records that match them, in the order of record_id."""
    own = records.join(matches, "record_id").groupBy("item_id")
    first = own.agg(
        F.min_by("title", F.when(~_blank(F.col("title")), F.col("record_id"))).alias("m_title"),
        F.min_by("authors", F.when(F.size("authors") > 0, F.col("record_id"))).alias("m_authors"),
        F.min_by("published_year", F.when(F.col("published_year").isNotNull(), F.col("record_id"))).alias("m_year"),
        F.min_by("item_type", F.when(F.col("item_type") != "other", F.col("record_id"))).alias("m_type"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "external_identifiers"))), lambda x: x["external_identifiers"])).alias("m_ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("record_id", "source_name", "external_id"))), lambda x: F.struct(x["source_name"].alias("source_name"), x["external_id"].alias("external_id"), F.lit(None).cast("string").alias("original_locator"))).alias("m_refs"),
    )
    j = items.join(first, "item_id", "left")
    fresh = F.filter(F.col("m_refs"), lambda r: ~F.exists(F.col("sources"), lambda s: s["source_name"].eqNullSafe(r["source_name"]) & s["external_id"].eqNullSafe(r["external_id"])))
    has = F.col("m_ids").isNotNull()
    new = {
        "title": F.when(has & _blank(F.col("title")), F.coalesce("m_title", "title")).otherwise(F.col("title")),
        "authors": F.when(has & (F.size("authors") <= 0), F.coalesce("m_authors", "authors")).otherwise(F.col("authors")),
        "published_year": F.coalesce("published_year", "m_year"),
        "item_type": F.when(has & (F.col("item_type") == "other"), F.coalesce("m_type", "item_type")).otherwise(F.col("item_type")),
        "external_identifiers": F.when(has, add_identifiers(F.col("external_identifiers"), F.array_distinct(F.col("m_ids")))).otherwise(F.col("external_identifiers")),
        "sources": F.when(has, F.concat("sources", F.array_distinct(fresh))).otherwise(F.col("sources")),
    }
    return j.withColumns(new).select(*items.columns)


def draft_items(records: DataFrame) -> DataFrame:
    """New items for records: inbox, no tags, one source reference."""
    from ..schemas import LITERATURE_ITEM

    kinds = {f.name: f.dataType for f in LITERATURE_ITEM.fields}
    ref = F.array(F.struct("source_name", "external_id", F.lit(None).cast("string").alias("original_locator")))
    values = {"item_id": F.col("record_id"), "favorite": F.lit(False), "reading_status": F.lit("inbox"), "tags": F.array(), "sources": ref, "files": F.array(), "default_file_id": F.lit(None)}
    return records.select(*[values.get(n, F.col(n) if n not in values else None).cast(t).alias(n) for n, t in kinds.items()])


def commit_import(preview: DataFrame, items: DataFrame) -> DataFrame:
    """The library after an import: matched items merged, others created, skipped records left out."""
    out = import_outcome(F.col("policy"), F.col("matched_item_id"))
    merging = preview.where(out == "merged")
    matches = merging.select("record_id", F.col("matched_item_id").alias("item_id"))
    records = [c for c in preview.columns if c not in ("matched_item_id", "policy")]
    return merge_into_items(items, merging.select(*records), matches).unionByName(draft_items(preview.where(out == "created").select(*records)).select(*items.columns))


def merge_records(records: DataFrame, group: str, order: str) -> DataFrame:
    """One record for each group from what several resolvers say, in order: the first that is not blank stands."""
    keyed = records.withColumn("__o", F.col(order))

    def first(c: str, good: Column) -> Column:
        return F.coalesce(F.min_by(c, F.when(good, F.col("__o"))), F.min_by(c, "__o")).alias(c)

    def listed(c: str) -> Column:
        # by a comparison of the order alone: maps have none
        by_order = F.array_sort(F.collect_list(F.struct("__o", c)), lambda a, b: F.when(a["__o"] < b["__o"], -1).when(a["__o"] > b["__o"], 1).otherwise(0))
        return F.transform(by_order, lambda x: x[c])

    text = [first(c, ~_blank(F.col(c))) for c in ("title", "abstract_text", "pages", "volume", "external_id")]
    identifiers = F.aggregate(listed("external_identifiers"), F.array().cast("array<struct<namespace:string,value:string>>"), add_identifiers)
    raw = F.aggregate(listed("raw_fields"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~_blank(v) | ~F.map_contains_key(m, k)), F.map_filter(m, lambda k, v: ~F.map_contains_key(a, k) | _blank(a[k]))))
    return keyed.groupBy(group).agg(
        F.concat_ws(" + ", F.array_distinct(listed("source_name"))).alias("source_name"),
        *text,
        first("authors", F.size("authors") > 0),
        first("keywords", F.size("keywords") > 0),
        first("published_year", F.col("published_year").isNotNull()),
        first("item_type", F.col("item_type") != "other"),
        identifiers.alias("external_identifiers"),
        raw.alias("raw_fields"),
    )


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replaced by changes of the same key, new ones added."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*rows.columns))


def delete_items(items: DataFrame, assets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, assets) without the given item ids; files stay where they are."""
    return items.join(gone, "item_id", "left_anti"), assets.join(gone, "item_id", "left_anti")


def import_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """Assets with new ones, of which an item keeps one a content; an item's first asset is its default."""
    fresh = new.join(assets.select("item_id", "content_hash"), ["item_id", "content_hash"], "left_anti")
    least = fresh.groupBy("item_id", "content_hash").agg(F.min("asset_id").alias("asset_id"))
    fresh = fresh.join(least, ["item_id", "content_hash", "asset_id"], "left_semi")
    had = assets.groupBy("item_id").agg(F.lit(True).alias("had"))
    first = fresh.groupBy("item_id").agg(F.min("asset_id").alias("first"))
    marked = fresh.join(had, "item_id", "left").join(first, "item_id").withColumn("is_default", F.col("had").isNull() & (F.col("asset_id") == F.col("first")))
    return assets.unionByName(marked.select(*assets.columns))


def set_default(assets: DataFrame, item_id, asset_id) -> DataFrame:
    """One default for an item."""
    own = F.col("item_id") == item_id
    return assets.withColumn("is_default", F.when(own, F.col("asset_id") == asset_id).otherwise(F.col("is_default")))


def check_association(items: DataFrame, assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (item_id, asset_id) that do not belong together, with the reason."""
    no_item = wanted.join(items.select("item_id"), "item_id", "left_anti").withColumn("reason", F.lit("unknown item"))
    known = wanted.join(items.select("item_id"), "item_id", "left_semi")
    return no_item.unionByName(known.join(assets.select("item_id", "asset_id"), ["item_id", "asset_id"], "left_anti").withColumn("reason", F.lit("unknown asset")))


def recent(rows: DataFrame, key: str, at: str, keep: int) -> DataFrame:
    """The latest keys, each once."""
    return rows.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(keep)


def row_numbers(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
