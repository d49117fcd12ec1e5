"""Assets: their status from a listing of what is there, names that are safe, defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Media types by ending, and names that some systems reserve.
MEDIA = {"pdf": "application/pdf", "epub": "application/epub+zip", "html": "text/html", "txt": "text/plain"}
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}


def media_type(path: Column) -> Column:
    """The media type of a path's ending, null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in MEDIA.items():
        out = F.when(ending == k, v).otherwise(out)
    return out


def status(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """Assets with their status: external, invalid, missing, unreadable or available.

    ``listing`` is (path, readable, is_file) of what a store has.  A managed path must stay
    inside the vault, and the media type must be that of its ending.
    """
    bad_path = F.col("path").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)") | (F.col("path") == "")
    wrong_media = ~media_type(F.col("path")).eqNullSafe(F.col("media_type"))
    j = assets.join(listing.select("path", "readable", "is_file"), "path", "left")
    state = F.when(F.col("storage_kind") == "external", "external").when(bad_path | wrong_media, "invalid").when(F.col("is_file").isNull(), "missing").when(~F.col("is_file"), "invalid").when(~F.col("readable"), "unreadable").otherwise("available")
    return j.withColumn("status", state).select(*assets.columns, "status")


def safe_name(name: str, ending: str = ".pdf") -> str:
    """A file name of letters, digits, dashes and underscores, never reserved, with the ending."""
    stem = name[: -len(ending)] if name.lower().endswith(ending) else name
    stem = re.sub(r"[^\w-]+", "-", stem).strip("-")[:120] or "document"
    return (f"{stem}-file" if stem.lower() in RESERVED else stem) + ending


def remove(assets: DataFrame, item_id, asset_id) -> DataFrame:
    """Assets without one; no other becomes the default in its place."""
    return assets.where(~((F.col("item_id") == item_id) & (F.col("asset_id") == asset_id)))


def one_default(assets: DataFrame) -> DataFrame:
    """Items that have several defaults, with their number."""
    return assets.where("is_default").groupBy("item_id").count().where("count > 1")
