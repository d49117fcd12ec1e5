"""Notes and quote annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Limits of notes and anchors, and the header of a note's file.
TITLE_CHARS, BODY_BYTES, QUOTE_CHARS, CONTEXT_CHARS = 240, 512 * 1024, 8192, 256
BLOCK = 100
HEADER = ("format_version", "note_id", "item_id", "created_at", "updated_at", "archived_at", "title")


def list_notes(notes: DataFrame, item_id=None, archived: bool = False) -> DataFrame:
    """Notes, the last changed first; archived ones only if asked for."""
    rows = notes if item_id is None else notes.where(F.col("item_id") == item_id)
    rows = rows if archived else rows.where(F.col("archived_at").isNull())
    return rows.orderBy(F.desc("updated_at"), "note_id")


def problems(title: Column, body: Column) -> Column:
    """Why a note is refused, null if it is not."""
    return F.when(F.length(title) > TITLE_CHARS, "title too long").when(title.rlike(r"[\r\n]"), "title has several lines").when(F.octet_length(body) > BODY_BYTES, "body too long")


def revision(content: Column) -> Column:
    return F.sha2(content, 256)


def note_text(note: dict) -> str:
    """A note's file: the header of seven lines between rules, then the body."""
    return "\n".join(["---", *(f"{k}: {note.get(k) or ''}" for k in HEADER), "---", note.get("markdown_body", "")])


def parse_notes(files: DataFrame, text_col: str = "value") -> DataFrame:
    """Notes from their files' texts; ``error`` tells what is wrong with one."""
    lines = F.split(F.col(text_col), "\n", len(HEADER) + 3)

    def value(i: int, k: str) -> Column:
        line = F.get(lines, F.lit(i + 1))
        return F.when(line.startswith(f"{k}: "), F.substring(line, F.lit(len(k) + 3), F.length(line)))

    cells = {k: value(i, k) for i, k in enumerate(HEADER)}
    broken = (F.get(lines, F.lit(0)) != "---") | (F.get(lines, F.lit(len(HEADER) + 1)) != "---") | (F.size(lines) < len(HEADER) + 2)
    for c in cells.values():
        broken = broken | c.isNull()
    error = F.when(F.coalesce(broken, F.lit(True)), "malformed header").when(cells["format_version"] != "1", "unknown version")
    return files.select(*[F.when(c != "", c).alias(k) if k != "title" else F.coalesce(c, F.lit("")).alias(k) for k, c in cells.items()], F.coalesce(F.get(lines, F.lit(len(HEADER) + 2)), F.lit("")).alias("markdown_body"), revision(F.col(text_col)).alias("revision"), error.alias("error"))


def compare_and_swap(notes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, refused): edits (note_id, expected, title, markdown_body, updated_at) whose expected revision is the note's."""
    j = notes.alias("n").join(edits.alias("e"), "note_id", "left")
    ok = F.col("e.expected") == F.col("n.revision")
    new = [F.when(ok, F.col(f"e.{c}")).otherwise(F.col(f"n.{c}")).alias(c) if c in ("title", "markdown_body", "updated_at") else F.when(ok, revision(F.col("e.markdown_body"))).otherwise(F.col("n.revision")).alias(c) if c == "revision" else F.col("note_id") if c == "note_id" else F.col(f"n.{c}").alias(c) for c in notes.columns]
    refused = edits.join(notes.select("note_id", "revision"), "note_id", "left").where(F.col("revision").isNull() | (F.col("expected") != F.col("revision"))).drop("revision")
    return j.select(*new), refused


def resolve_annotations(annotations: DataFrame, items: DataFrame, assets: DataFrame, pages: DataFrame, extractor: str) -> DataFrame:
    """Each annotation's state, decided in order: orphan item, missing asset, external, unavailable, changed content, other extractor, no such page, text found, gone or ambiguous.

    ``pages`` is (asset_id, page_number, text); ``assets`` has storage_kind, status,
    content_hash and page_count.
    """
    a = annotations.join(items.select("item_id", F.lit(True).alias("has_item")), "item_id", "left")
    a = a.join(assets.select("item_id", "asset_id", "storage_kind", "status", "content_hash", "page_count"), ["item_id", "asset_id"], "left")
    a = a.join(pages.select("asset_id", "page_number", F.col("text").alias("page_text")), ["asset_id", "page_number"], "left")
    where = tx.location(F.coalesce("page_text", F.lit("")), F.col("selected_text"), F.col("prefix_context"), F.col("suffix_context"))
    state = (
        F.when(F.col("has_item").isNull(), "orphan_item")
        .when(F.col("status").isNull(), "missing_asset")
        .when(F.col("storage_kind") == "external", "external_asset")
        .when(F.col("status") != "available", "unavailable")
        .when(F.col("content_hash") != F.col("hash_at_capture"), "content_changed")
        .when(F.col("extractor_version") != extractor, "extractor_changed")
        .when((F.col("page_number") < 1) | (F.col("page_number") > F.col("page_count")), "page_out_of_range")
        .otherwise(F.lower(where["state"]))
    )
    return a.select(*annotations.columns, state.alias("state"), F.when(state == "found", where["place"]).alias("place"))


def locate_passages(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, occurrences, state) of passages over all texts.

    Passages are matched through a shared word window, by a hash join: each passage asks with
    its first ``k`` words, each text offers all windows of ``k`` words, and exact counts follow
    on the pairs that meet.  Passages of fewer words are sought in every text, in blocks.
    """
    k = 4
    space = r"[^\x20\x09-\x0D]+"
    p = passages.select("item_id", F.col("text").alias("passage")).withColumn("w", F.regexp_extract_all("passage", F.lit(space), 0))
    long, short = p.where(F.size("w") > k + 1), p.where(F.size("w") <= k + 1)
    # the first word of a passage may be the end of a longer word in a text, so windows begin at the second
    asked = long.select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, k), " ")).alias("h"))
    words = texts.select("doc_id", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(space), 0).alias("w")).where(F.size("w") >= k)
    offered = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " "))))).alias("h"))
    met = offered.join(asked.select("h").distinct(), "h", "left_semi").join(asked, "h").select("item_id", "passage", "doc_id").distinct()
    counted = met.join(texts.select("doc_id", "text"), "doc_id").groupBy("item_id").agg(F.sum(tx.occurrences(F.col("text"), F.col("passage"))).cast("bigint").alias("n"))
    asked_short = [(r["item_id"], r["passage"]) for r in short.select("item_id", "passage").toLocalIterator()]
    for at in range(0, len(asked_short), BLOCK):
        # passages too short for a window: a block of them at a time against each text
        block = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(t).alias("passage")) for i, t in asked_short[at : at + BLOCK]])
        found = texts.select("text", F.explode(F.filter(block, lambda p: F.col("text").contains(p["passage"]))).alias("p")).groupBy("p.item_id")
        counted = counted.unionByName(found.agg(F.sum(tx.occurrences(F.col("text"), F.col("p.passage"))).cast("bigint").alias("n")))
    out = passages.select("item_id").join(counted, "item_id", "left").withColumn("occurrences", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.select("item_id", "occurrences", F.when(F.col("occurrences") == 0, "NotFound").when(F.col("occurrences") == 1, "Found").otherwise("Ambiguous").alias("state"))
