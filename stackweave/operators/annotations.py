"""Quote annotations: made from a page's text, kept as files, changed and removed.

An annotation points at text of one page of a stored asset.  It is only made where that text
is found exactly once; its file is JSON with no more and no fewer keys than named here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .notes import CONTEXT_CHARS, QUOTE_CHARS

# The file's version and kind, and its keys.
VERSION, KIND = "1", "quote"
ANCHOR = ("asset_id", "asset_content_hash_at_capture", "extractor_version", "page_number", "selected_text", "normalized_text_hash", "prefix_context", "suffix_context")
FIELDS = ("annotation_id", "item_id", "asset_id", "created_at", "updated_at", *ANCHOR[1:])
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
FILE = (
    "format_version string, annotation_id string, item_id string, asset_id string, created_at string, updated_at string, kind string, "
    "anchor struct<asset_id: string, asset_content_hash_at_capture: string, extractor_version: string, page_number: int, selected_text: string, normalized_text_hash: string, prefix_context: string, suffix_context: string>"
)
TOP = ("format_version", "annotation_id", "item_id", "asset_id", "created_at", "updated_at", "kind", "anchor")


def anchor_problem(page: Column, selected: Column, prefix: Column, suffix: Column) -> Column:
    """Why an anchor is refused, null if it is not; nulls count as empty."""

    def chars(c: Column) -> Column:
        return F.length(F.coalesce(c, F.lit("")))

    return (
        F.when(F.coalesce(page, F.lit(0)) < 1, "page_out_of_range")
        .when((chars(selected) < 1) | (chars(selected) > QUOTE_CHARS), "selected_text")
        .when(chars(prefix) > CONTEXT_CHARS, "prefix_context")
        .when(chars(suffix) > CONTEXT_CHARS, "suffix_context")
    )


def quote(drafts: DataFrame, items: DataFrame, assets: DataFrame, pages: DataFrame, now: Column, extractor: str) -> DataFrame:
    """Annotations of drafts, each with ``refused``: why it is not made, null if it is.

    ``drafts`` is (annotation_id, item_id, asset_id, page_number, selected_text,
    prefix_context, suffix_context), ``assets`` (item_id, asset_id, storage_kind, media_type,
    status, content_hash), ``pages`` (asset_id, page_number, text).  Checks go in order:
    anchor, item, asset, whether the asset can be quoted, and whether its page has the text
    exactly once.  Of a refused draft all that would be computed is null.
    """
    names = [F.col(c) for c in drafts.columns]
    a = drafts.join(items.select("item_id", F.lit(True).alias("__item")).distinct(), "item_id", "left")
    a = a.join(assets.select("item_id", "asset_id", "storage_kind", "media_type", "status", "content_hash"), ["item_id", "asset_id"], "left")
    a = a.join(pages.select("asset_id", "page_number", F.col("text").alias("__page")), ["asset_id", "page_number"], "left")
    place = tx.location(F.coalesce("__page", F.lit("")), F.col("selected_text"), F.coalesce("prefix_context", F.lit("")), F.coalesce("suffix_context", F.lit("")))
    refused = F.coalesce(
        anchor_problem(F.col("page_number"), F.col("selected_text"), F.col("prefix_context"), F.col("suffix_context")),
        F.when(F.col("__item").isNull(), "unknown item")
        .when(F.col("status").isNull(), "unknown asset")
        .when(F.col("storage_kind") == "external", "external asset")
        .when((F.lower("media_type") != "application/pdf") | (F.col("status") != "available"), "unavailable asset")
        .when(place["state"] == "NotFound", "not found")
        .when(place["state"] == "Ambiguous", "ambiguous"),
    )
    made = a.withColumn("refused", refused)
    kept = F.col("refused").isNull()
    return made.select(
        *names,
        "refused",
        F.when(kept, now).alias("created_at"),
        F.when(kept, now).alias("updated_at"),
        F.when(kept, F.col("content_hash")).alias("asset_content_hash_at_capture"),
        F.when(kept, F.lit(extractor)).alias("extractor_version"),
        F.when(kept, F.sha2(tx.nfkc(F.col("selected_text")), 256)).alias("normalized_text_hash"),
    )


def file_text(annotations: DataFrame) -> Column:
    """The JSON of an annotation's file, for a table with the columns of ``FIELDS``."""
    stamps = {c: F.date_format(c, STAMP) for c in ("created_at", "updated_at")}
    top = [F.lit(VERSION).alias("format_version"), *[stamps.get(c, F.col(c).cast("string")).alias(c) for c in TOP[1:6]], F.lit(KIND).alias("kind")]
    anchor = F.struct(*[F.col(c).cast("int" if c == "page_number" else "string").alias(c) for c in ANCHOR])
    return F.to_json(F.struct(*top, anchor.alias("anchor")), {"ignoreNullFields": "false"})


def parse_files(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Annotations of files (name, value); ``error`` tells what is wrong with one.

    In order: malformed JSON, missing or further keys, another version, another kind, a
    change before the creation, an anchor that does not fit, a file under another id.
    """
    f = F.from_json("value", FILE)
    rows = files.withColumns({"__f": f, "__top": F.json_object_keys("value"), "__anchor": F.json_object_keys(F.get_json_object("value", "$.anchor"))})

    def exactly(column: str, keys: tuple[str, ...]) -> Column:
        return F.coalesce(F.array_sort(F.col(column)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))

    a, anchor = F.col("__f"), F.col("__f.anchor")
    times = [F.try_to_timestamp(a[c], F.lit(STAMP)) for c in ("created_at", "updated_at")]
    whole = exactly("__top", TOP) & exactly("__anchor", ANCHOR) & times[0].isNotNull() & times[1].isNotNull()
    sha = r"^[0-9a-f]{64}$"
    error = (
        F.when(~F.coalesce(whole, F.lit(False)), "malformed")
        .when(a["format_version"] != VERSION, "unknown version")
        .when((a["kind"] != KIND) | (times[1] < times[0]), "malformed")
        .when(a["asset_id"] != anchor["asset_id"], "asset_id")
        .when(anchor_problem(anchor["page_number"], anchor["selected_text"], anchor["prefix_context"], anchor["suffix_context"]).isNotNull(), "anchor")
        .when(~anchor["asset_content_hash_at_capture"].rlike(sha) | ~anchor["normalized_text_hash"].rlike(sha), "hash")
        .when(a["annotation_id"] != F.col("name"), "other id")
    )
    plain = [a[c].alias(c) for c in ("annotation_id", "item_id", "asset_id")] + [t.alias(c) for t, c in zip(times, ("created_at", "updated_at"), strict=True)] + [anchor[c].alias(c) for c in ANCHOR[1:]]
    return rows.select(*(keep or []), *plain, error.alias("error"))


def listed(annotations: DataFrame, item_id=None) -> DataFrame:
    """Annotations, of one item if asked, the last changed first."""
    rows = annotations if item_id is None else annotations.where(F.col("item_id") == item_id)
    return rows.orderBy(F.desc("updated_at"), "annotation_id")


def updated(annotations: DataFrame, drafts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(annotations, refused): drafts (the columns of ``FIELDS`` but the times) replace the annotation of their id.

    The time of creation stays.  Drafts of an unknown id, and those whose anchor does not
    fit, change nothing.  Ids are distinct on either side.
    """
    checked = drafts.withColumn("refused", anchor_problem(F.col("page_number"), F.col("selected_text"), F.col("prefix_context"), F.col("suffix_context")))
    known = checked.join(annotations.select("annotation_id", F.lit(True).alias("__known")), "annotation_id", "left").withColumn("refused", F.coalesce("refused", F.when(F.col("__known").isNull(), "unknown annotation")))
    good = known.where(F.col("refused").isNull())
    created = annotations.select("annotation_id", "created_at")
    new = good.join(created, "annotation_id").withColumn("updated_at", now).select(*annotations.columns)
    return annotations.join(good.select("annotation_id"), "annotation_id", "left_anti").select(*annotations.columns).unionByName(new), known.where(F.col("refused").isNotNull()).drop("__known")


def deleted(annotations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations, unknown): annotations without those of ``ids``, and the ids that none had."""
    gone = ids.select("annotation_id").distinct()
    return annotations.join(gone, "annotation_id", "left_anti"), gone.join(annotations.select("annotation_id"), "annotation_id", "left_anti")
