"""Stored values, user stores, commits, assets, workspaces."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stackweave import workspace
from stackweave.functions import display, values
from stackweave.operators import assets
from stackweave.sources import files, stores


def test_values_are_ordered_by_their_bytes(spark):
    df = spark.createDataFrame([(1,), (256,), (-1,), (0,), (None,)], "v bigint").where("v is not null")
    assert [r.v for r in df.orderBy(values.order_key(F.col("v"), "i64")).collect()] == [0, 256, 1, -1]
    text = spark.createDataFrame([("b",), ("a",), ("ab",)], "v string")
    assert [r.v for r in text.orderBy(values.order_key(F.col("v"), "utf8")).collect()] == ["a", "ab", "b"]
    assert values.tag("null") == 0 and values.tag("decimal256") == 21


def test_frozen_digest(spark):
    # Fixed value: the digest of a domain without parts.
    assert values.canonical_digest(b"domain", []).hex() == "855652511297084ea790a61be3641b2e"
    got = spark.range(1).select(values.digest_of("x", F.unhex(F.lit("0102"))).alias("d")).first().d
    assert bytes(got) == values.canonical_digest(b"x", [b"\x01\x02"])


def test_sequences_maps_and_blobs(spark):
    row = spark.range(1).select(
        values.concat_sequences(F.array(F.lit(1)), F.array(F.lit(2))).alias("s"),
        values.concat_blobs(F.encode(F.lit("ab"), "UTF-8"), F.encode(F.lit("cd"), "UTF-8")).alias("b"),
        values.fold_sequences([F.array(F.lit(i)) for i in (1, 2, 3)]).alias("f"),
        values.hex16(F.unhex(F.lit("00" * 16))).alias("h"),
    ).first()
    assert (row.s, bytes(row.b), row.f, row.h) == ([1, 2], b"abcd", [6], "0" * 32)
    two = F.create_map(F.lit("a"), F.lit(1))
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        spark.range(1).select(values.union_maps(two, two)).collect()


def test_displays(spark):
    row = spark.range(1).select(display.size(F.lit(1536)).alias("k"), display.size(F.lit(10)).alias("b"), display.size(F.lit(None).cast("bigint")).alias("n"), display.number(F.lit(1234.6)).alias("i"), display.rfc3339(F.lit("2024-01-02T03:04:05Z")).alias("t"), display.rfc3339(F.lit("2024-01-02T03:04:05+02:00")).alias("o")).first()
    assert (row.k, row.b, row.n, row.i, row.t.hour, row.o) == ("1.5 KB", "10 B", "—", "1,235", 3, None)


def test_stores(spark, tmp_path):
    assert stores.read_store(spark, f"file://{tmp_path}/none.json", "items").count() == 0
    items = [{"item_id": "i", "title": "T", "files": [{"file_id": "f1", "path": "a.pdf", "display_name": "a"}, {"file_id": "f2", "path": "b.pdf", "display_name": "b"}], "default_file_id": "f2"}, {"item_id": "j"}]
    (tmp_path / "items.json").write_text(json.dumps(items))
    got = stores.read_store(spark, f"file://{tmp_path}/items.json", "items")
    assert {r.item_id: r.tags for r in got.collect()} == {"i": [], "j": []}
    assert {r.asset_id: r.is_default for r in stores.legacy_assets(got).collect()} == {"f1": False, "f2": True}
    os.makedirs(tmp_path / "b")
    for n, at in (("x", "2024-02"), ("y", "2024-01")):
        (tmp_path / "b" / f"{n}.json").write_text(json.dumps({"batch_id": n, "imported_at": at, "records": []}))
    assert [r.batch_id for r in stores.read_batches(spark, f"file://{tmp_path}/b").collect()] == ["y", "x"]
    assert len(stores.payload_lines('[{"id": 1}, {"id": 2}]')) == 2 and len(stores.payload_lines('{"id": 1}\n\n{"id": 2}')) == 2 and stores.payload_lines(" ") == []
    with pytest.raises(ValueError):
        stores.payload_lines("[1]")


def test_text_layers(spark):
    def extract(blob):
        if blob == b"locked":
            raise stores.Encrypted
        if blob == b"broken":
            raise RuntimeError
        return blob.decode().split("|")

    rows = [("a", b"one| two "), ("b", b"locked"), ("c", b"broken"), ("d", b" | "), ("e", b"x|" * 600), ("f", None)]
    got = {r.path: (r.outcome, r.text) for r in stores.text_layers(spark.createDataFrame(rows, "path string, content binary"), extract).collect()}
    assert got == {"a": ("indexed", "one\ntwo"), "b": ("encrypted", None), "c": ("failed", None), "d": ("no_text", None), "e": ("too_many_pages", None), "f": ("failed", None)}


def test_epochs(spark, tmp_path):
    e = stores.Epochs(spark, f"file://{tmp_path}/e")
    assert e.head() is None
    assert [e.commit(spark.range(n)) for n in (1, 2, 3)] == [0, 1, 2]
    path = f"file://{tmp_path}/e/commits/{2:020d}.json"
    files.write_text(spark, path, files.read_text(spark, path).replace('"sequence": 2', '"sequence": 9'))  # broken row
    assert e.head().count() == 2 and len(e.sweep()) == 2 and e.head().count() == 2


def test_assets(spark):
    assert assets.safe_name("a/b: c?.PDF") == "a-b-c.pdf" and assets.safe_name("con") == "con-file.pdf" and assets.safe_name("..") == "document.pdf"
    df = spark.createDataFrame([("i", "a", True), ("i", "b", True), ("j", "a", True)], "item_id string, asset_id string, is_default boolean")
    assert [r.item_id for r in assets.one_default(df).collect()] == ["i"] and assets.remove(df, "i", "a").count() == 2


def test_workspace(tmp_path):
    root = str(tmp_path / "w")
    made = workspace.create(root, "T")
    os.rmdir(os.path.join(root, "notes"))
    states = {s["kind"]: s["state"] for s in workspace.open_(root)["subtrees"]}
    assert len(made["subtrees"]) == 8 and states["notes"] == "degraded" and states["search"] == "ready"
    with pytest.raises(FileExistsError):
        workspace.create(root, "T")
    os.makedirs(tmp_path / "old" / "notes")
    (tmp_path / "old" / "notes" / "n.md").write_text("x")
    workspace.migrate(str(tmp_path / "old"), str(tmp_path / "new"), "T", str(tmp_path / "b.zip"))
    assert (tmp_path / "new" / "notes" / "n.md").exists() and (tmp_path / "b.zip").exists()
