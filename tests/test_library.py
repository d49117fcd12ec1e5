"""Sources, functions, plans and operators on small literal inputs."""

import json
import os
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from stackweave import cli, queries
from stackweave.functions import identifiers as ids
from stackweave.functions import text as tx
from stackweave.operators import library, notes, search, sessions, store, tree
from stackweave.plans import catalog, transform, views
from stackweave.sources import files, records, resolvers, sinks, vault
from stackweave.streaming import live

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# text -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, want", [("ＦＯＯ Rust 与机器学习", ["foo", "rust", "与机", "机器", "器学", "学习"]), ("ÁLICE Müller", ["álice", "müller"]), ("张伟", ["张伟"]), ("Data-Science 学", ["data", "science", "学"]), ("", []), ("a A a1 b_c", ["a", "a1", "b", "c"]), (None, [])])
def test_analyzer(spark, text, want):
    assert tx.analyze(text) == want
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.terms(F.col("t")).alias("x")).first().x == want


def test_latin_texts_agree_with_the_analyzer(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", tx.terms(F.col("text")).alias("a"), tx.latin_terms(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b == tx.analyze(r.text) for r in rows)


def test_excerpt_is_clamped(spark):
    text = "x" * 300 + " Needle " + "y" * 300
    got = one(spark, tx.excerpt(F.lit(text), ["needle"]))
    assert got == "…" + text[221:461] + "…" and one(spark, tx.excerpt(F.lit("ab"), ["q"])) == "ab" and one(spark, tx.excerpt(F.lit(None).cast("string"), ["q"])) == ""


@pytest.mark.parametrize("text, prefix, suffix, want", [("one two one", "", "", ("Ambiguous", None)), ("one two", "", "", ("Found", 0)), ("xone two", "", " t", ("Found", 1)), ("two", "", "", ("NotFound", None)), ("oneone", "one", "", ("Found", 0))])
def test_location(spark, text, prefix, suffix, want):
    got = one(spark, tx.location(F.lit(text), F.lit("one"), F.lit(prefix), F.lit(suffix)))
    assert tuple(got) == want


def test_contains_is_literal(spark):
    df = spark.createDataFrame([("A.B (c) \\E d",), ("axb",)], "t string")
    assert [r.t for r in df.where(tx.contains_text(F.col("t"), "a.b (C) \\E")).collect()] == ["A.B (c) \\E d"]
    assert tx.contains_text(F.col("t"), "  ") is None


def test_fingerprint(spark):
    import hashlib

    want = hashlib.sha256(b"T\0A\0B\0\xff" + b"x\0").hexdigest()
    assert one(spark, tx.fingerprint(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x")))) == want


@pytest.mark.parametrize(
    "text, want",
    [("doi:10.1038/S41586-021-03819-2", ("doi", "10.1038/s41586-021-03819-2")), ("pmid:12345", ("pmid", "12345")), ("PMC:PMC12345", ("pmcid", "12345")), ("978-0-13-468599-1", ("isbn", "9780134685991")), ("W12345", ("openalex", "W12345")), ("12345", ("openalex", "W12345")), ("https://openalex.org/W9", ("openalex", "W9")), ("not-an-id", None), ("  ", None), (None, None)],
)
def test_identifiers(spark, text, want):
    got = one(spark, ids.classify(F.lit(text).cast("string")))
    assert (got and tuple(got)) == want


def test_guessed_identifiers(spark):
    want = {" DOI:10.1/x": "doi", "a/b": "doi", "https://doi.org/10.1/x": "doi", "pmid:x": "pmid", "\t123\n": "pmid", "PMC:1": "pmcid", "pmcid:7": "pmcid", "PMC12345": None, "W12": None, "1 2": None, "": None, None: None}
    df = spark.createDataFrame(list(enumerate(want)), "i int, x string")
    assert [r.k for r in df.orderBy("i").select(ids.guess(F.col("x")).alias("k")).collect()] == list(want.values())


# records --------------------------------------------------------------------------------------------

BIB = "@comment{x}@article{test2020, title={A {Test} Paper}, author={Alice Smith and Bob Jones}, year={2020}, doi={10.1000/xyz}, volume = 7, note = \"q\"}\n@book{b, title={B}}"
RIS = "TY  - JOUR\nTI  - A title\n  goes on\nAU  - One, A\nAU  - Two, B\nPY  - 2019/03/\nSN  - 1234-5678\nIS  - 3\nSP  - 1\nEP  - 10\nKW  - k1\nKW  - k2\nER  - \nTY  - BOOK\nT1  - Book\nSN  - 978-3-030-00000-0\n"


def test_bibtex(spark):
    got = records.parse_files(spark.createDataFrame([(BIB,), ("",)], "value string"), "BibTeX").orderBy("title").collect()
    a, b = got
    assert (a.title, a.authors, a.published_year, a.item_type, a.external_id, a.volume) == ("A {Test} Paper", ["Alice Smith", "Bob Jones"], 2020, "article", "test2020", "7")
    assert [tuple(i) for i in a.external_identifiers] == [("doi", "10.1000/xyz")] and b.item_type == "book"
    for bad in ("@article{x, title={a}", "no entry", "@article{x, title=?}"):
        with pytest.raises(ValueError):
            records.parse_bibtex(bad)


def test_ris(spark):
    a, b = records.parse_files(spark.createDataFrame([(RIS,)], "value string"), "ris").collect()
    assert (a.title, a.authors, a.published_year, a.item_type, a.pages, a.keywords) == ("A title goes on", ["One, A", "Two, B"], 2019, "article", "1-10", ["k1", "k2"])
    assert [tuple(i) for i in a.external_identifiers] == [("issn", "1234-5678")] and a.raw_fields["is"] == "3"
    assert b.item_type == "book" and [tuple(i) for i in b.external_identifiers] == [("isbn", "978-3-030-00000-0")]
    with pytest.raises(ValueError):
        records.parse_ris("text without tags")


WORK = {"id": "https://openalex.org/W123456789", "doi": "https://doi.org/10.1000/ABC", "title": "T", "authorships": [{"author": {"display_name": "A"}}], "publication_year": 2020, "type": "article", "biblio": {"first_page": "1", "last_page": "10", "volume": "3"}, "abstract_inverted_index": {"world": [1], "Hello": [0]}, "keywords": ["k", {"keyword": "m"}], "cited_by_count": 5}


def test_works(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    (tmp_path / "deep" / "a.jsonl").write_text(json.dumps(WORK) + "\n\n" + json.dumps({"id": "https://openalex.org/W2", "title": "Other"}) + "\n")
    got = records.read_works(spark, str(tmp_path))
    w = got.where("external_id = 'W123456789'").first()
    assert [tuple(i) for i in w.external_identifiers] == [("openalex", "W123456789"), ("doi", "10.1000/abc")]
    assert (w.pages, w.abstract_text, w.keywords, w.raw_fields) == ("1-10", "Hello world", ["k", "m"], {"cited_by_count": "5"})
    assert records.search_works(got, "oTHer", 10).count() == 1 and records.search_works(got, " ", 10).count() == 0
    assert records.doi_index(got).first().doi == "10.1000/abc"
    assert records.import_format("open-alex_works") == "OpenAlexWorks"


# the library ----------------------------------------------------------------------------------------


def _items(spark):
    rows = [("i1", "", [], None, "other", [("doi", "10.1/A")]), ("i2", "Kept", ["X"], 1999, "book", [("pmid", "7"), ("url", "u")]), ("i3", "Third", ["Y"], None, "article", [("doi", "10.1/a")])]
    df = spark.createDataFrame(rows, "item_id string, title string, authors array<string>, published_year int, item_type string, external_identifiers array<struct<namespace:string,value:string>>")
    empty = F.array().cast("array<struct<source_name:string,external_id:string,original_locator:string>>")
    return df.withColumns({"favorite": F.lit(False), "reading_status": F.lit("inbox"), "tags": F.array(F.lit("t")), "sources": empty, "files": F.array().cast("array<struct<file_id:string,path:string,display_name:string>>"), "default_file_id": F.lit(None).cast("string")})


def _records(spark):
    rows = [("r1", "New", ["N"], 2001, "article", [("url", "u"), ("doi", "10.1/a"), ("pmid", "9")]), ("r2", "Other", ["O"], 2002, "article", [("pmid", "7")]), ("r3", "Fresh", [], None, "other", [("doi", "10.9/z")])]
    return spark.createDataFrame([("RIS", r[0], *r) for r in rows], "source_name string, external_id string, record_id string, title string, authors array<string>, published_year int, item_type string, external_identifiers array<struct<namespace:string,value:string>>")


def test_imports(spark):
    preview = library.import_preview(_records(spark), _items(spark))
    assert {r.record_id: r.matched_item_id for r in preview.collect()} == {"r1": "i1", "r2": "i2", "r3": None}
    assert library.import_counts(preview).first()[:3] == (1, 2, 0)
    got = {r.item_id: r for r in library.commit_import(preview, _items(spark)).collect()}
    assert (got["i1"].title, got["i1"].authors, got["i1"].published_year, got["i1"].item_type) == ("New", ["N"], 2001, "article")
    assert [tuple(i) for i in got["i1"].external_identifiers] == [("doi", "10.1/A"), ("url", "u"), ("pmid", "9")]
    assert (got["i2"].title, got["i2"].published_year, got["i2"].sources[0].external_id) == ("Kept", 1999, "r2")
    assert got["r3"].reading_status == "inbox" and len(got) == 4 and got["i3"].sources == []


def test_record_merge(spark):
    rows = [("a", 0, "Crossref", " ", None, "other", [("doi", "10.1234/example"), ("pmid", "1")], {"x": "", "y": "1"}), ("a", 1, "PubMed", "Title", 2021, "article", [("doi", "10.1234/EXAMPLE"), ("pmcid", "2")], {"x": "2", "y": "3"})]
    df = spark.createDataFrame(rows, "g string, n int, source_name string, title string, published_year int, item_type string, external_identifiers array<struct<namespace:string,value:string>>, raw_fields map<string,string>").withColumns({c: F.lit("") for c in ("abstract_text", "pages", "volume", "external_id")} | {c: F.array().cast("array<string>") for c in ("authors", "keywords")})
    r = library.merge_records(df, "g", "n").first()
    assert (r.title, r.published_year, r.item_type, r.source_name) == ("Title", 2021, "article", "Crossref + PubMed")
    assert len(r.external_identifiers) == 3 and r.raw_fields == {"x": "2", "y": "1"}


def test_assets(spark):
    ddl = "asset_id string, item_id string, content_hash string, is_default boolean"
    own = spark.createDataFrame([("a1", "i1", "h1", True)], ddl)
    new = spark.createDataFrame([("a2", "i1", "h1", False), ("a3", "i1", "h2", False), ("a4", "i2", "h1", False), ("a5", "i2", "h1", False)], ddl)
    got = {r.asset_id: r.is_default for r in library.import_assets(own, new).collect()}
    assert got == {"a1": True, "a3": False, "a4": True}
    items = spark.createDataFrame([("i1",)], "item_id string")
    bad = {r.asset_id: r.reason for r in library.check_association(items, own, new.select("item_id", "asset_id")).collect()}
    assert bad == {"a2": "unknown asset", "a3": "unknown asset", "a4": "unknown item", "a5": "unknown item"}


# search ---------------------------------------------------------------------------------------------


def _corpus(spark):
    items = spark.createDataFrame([(1, "Whales needle list", ["Mary Ann"], ["whaling"]), (2, "Nothing but pages", ["X"], ["t"]), (3, "Third", ["Y"], [])], "item_id bigint, title string, authors array<string>, tags array<string>")
    rows = [(10, 1, "a.pdf", 10, "the needle text", "available"), (20, 2, "b.pdf", 10, "needle and another", "available"), (30, 3, "c.txt", 10, "needle", "available"), (40, 3, "d.pdf", 10, "needle", "missing"), (50, 3, "https://x/e.pdf", 1, "needle", "available"), (60, 99, "f.pdf", 1, "needle", "available"), (70, 3, "g.pdf", 1, " ", "available")]
    return items, spark.createDataFrame(rows, "asset_id bigint, item_id bigint, path string, file_size bigint, content string, status string")


def test_search(spark, tmp_path):
    items, assets = _corpus(spark)
    index, recs = search.build(items, assets)
    assert {(r.asset_id, r.kind) for r in search.issues(recs).collect()} == {(30, "unsupported"), (40, "missing"), (70, "no_text")}
    root = f"file://{tmp_path}/index"
    assert search.index_state(spark, root) == "missing"
    assert search.search_published(spark, root, "needle") == ("missing", None, None)
    search.publish(spark, root, index, recs, 4)
    # three assets are not indexed
    assert search.index_state(spark, root) == "degraded" and search.stale_reason(spark, root) is None
    state, _, total = search.search_published(spark, root, "NEEDLE")
    assert state == "degraded" and total.first().total_hits == 2
    index, recs = search.load(spark, root, ["needle"])
    page, total = search.search(index, recs, "NEEDLE")
    assert total.first().total_hits == 2
    got = [(r.item_id, r.has_metadata, r.field, r.excerpt) for r in page.orderBy(F.desc("has_metadata"), "item_id", "field").collect()]
    assert got == [(1, 1, "content", "the needle text"), (1, 1, "title", None), (2, 0, "content", "needle and another")]
    index, recs = search.load(spark, root)
    for scope, text, want in (("authors", "mary", 1), ("tags", "whaling", 1), ("content", "another", 1), ("title", "mary", 0), ("all", "needle mary", 0), ("all", "...", 0)):
        assert search.search(index, recs, text, [scope])[1].first().total_hits == want
    page, total = search.search(index, recs, "needle", limit=1, offset=1)
    assert total.first().total_hits == 2 and [r.item_id for r in page.collect()] == [2]


def test_incremental_index_equals_a_rebuild(spark):
    items, assets = _corpus(spark)
    rng = random.Random(3)
    for _ in range(2):
        new_items = items.where(F.col("item_id") != rng.choice([1, 2, 3])).withColumn("title", F.when(F.col("item_id") == 2, f"Fresh {rng.random()}").otherwise(F.col("title")))
        new_assets = assets.join(new_items.select("item_id"), "item_id", "left_semi").where("asset_id <> 10").select(*assets.columns).withColumn("content", F.when(F.col("asset_id") == 20, "changed words").otherwise(F.col("content")))
        gone = items.join(new_items, "item_id", "left_anti").select(F.lit("item_removed").alias("kind"), "item_id", F.lit(None).cast("bigint").alias("asset_id"))
        more = spark.createDataFrame([("metadata_changed", 2, None), ("asset_changed", 2, 20), ("asset_removed", 1, 10), ("asset_changed", 1, 10)], "kind string, item_id bigint, asset_id bigint")
        got = search.update(*search.build(items, assets), new_items, new_assets, gone.unionByName(more))
        for a, b in zip(got, search.build(new_items, new_assets), strict=True):
            assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


# sessions and notes ----------------------------------------------------------------------------------


def test_session_moves(spark):
    assert sessions.apply_action("active", "pause") == "paused" and sessions.apply_action("paused", "end") == "closed"
    for state, action in (("closed", "resume"), ("active", "fly")):
        with pytest.raises(ValueError):
            sessions.apply_action(state, action)
    rows = [(1, 1, "closed", 9), (2, 1, "paused", 3), (3, 1, "active", 5), (4, 2, "closed", 1), (5, 2, "closed", 2)]
    df = spark.createDataFrame([(a, b, c, d, d) for a, b, c, d in rows], "session_id int, item_id int, state string, last_opened_at int, started_at int")
    assert {r.item_id: r.session_id for r in sessions.continue_target(df, ["item_id"]).collect()} == {1: 3, 2: 5}


def test_notes(spark):
    note = {"format_version": "1", "note_id": "n", "item_id": "i", "created_at": "c", "updated_at": "u", "archived_at": None, "title": "T: x", "markdown_body": "body\n---\nmore"}
    got = notes.parse_notes(spark.createDataFrame([(notes.note_text(note),), ("rubbish",)], "value string")).collect()
    assert {k: getattr(got[0], k) for k in note} == note and got[0].error is None and got[1].error == "malformed header"
    df = spark.createDataFrame([("n", "t", "b", "u1", "rev")], "note_id string, title string, markdown_body string, updated_at string, revision string")
    edits = spark.createDataFrame([("n", "rev", "t2", "b2", "u2"), ("m", "x", "", "", "")], "note_id string, expected string, title string, markdown_body string, updated_at string")
    new, refused = notes.compare_and_swap(df, edits)
    assert new.first().title == "t2" and [r.note_id for r in refused.collect()] == ["m"]
    assert one(spark, notes.problems(F.lit("a\nb"), F.lit(""))) == "title has several lines"


def test_annotation_states(spark):
    items = spark.createDataFrame([(1,)], "item_id int")
    ddl = "item_id int, asset_id int, storage_kind string, status string, content_hash string, page_count int"
    assets = spark.createDataFrame([(1, 1, "managed", "available", "h", 2), (1, 2, "external", "available", "h", 2), (1, 3, "managed", "missing", "h", 2)], ddl)
    pages = spark.createDataFrame([(1, 1, "one two one"), (1, 2, "two")], "asset_id int, page_number int, text string")
    rows = [("a", 9, 1, 1, "h", "1", "one"), ("b", 1, 8, 1, "h", "1", "one"), ("c", 1, 2, 1, "h", "1", "one"), ("d", 1, 3, 1, "h", "1", "one"), ("e", 1, 1, 1, "other", "1", "one"), ("f", 1, 1, 1, "h", "0", "one"), ("g", 1, 1, 3, "h", "1", "one"), ("h", 1, 1, 1, "h", "1", "one"), ("i", 1, 1, 1, "h", "1", "two"), ("j", 1, 1, 2, "h", "1", "one")]
    ann = spark.createDataFrame([(*r, "", "") for r in rows], "id string, item_id int, asset_id int, page_number int, hash_at_capture string, extractor_version string, selected_text string, prefix_context string, suffix_context string")
    got = {r.id: (r.state, r.place) for r in notes.resolve_annotations(ann, items, assets, pages, "1").collect()}
    assert got == {"a": ("orphan_item", None), "b": ("missing_asset", None), "c": ("external_asset", None), "d": ("unavailable", None), "e": ("content_changed", None), "f": ("extractor_changed", None), "g": ("page_out_of_range", None), "h": ("ambiguous", None), "i": ("found", 4), "j": ("notfound", None)}


def test_passages_of_any_length(spark):
    texts = spark.createDataFrame([(1, "pre alpha beta gamma delta epsilon zeta post"), (2, "xalpha beta gamma delta epsilon zeta alpha beta gamma delta epsilon zeta"), (3, None)], "doc_id int, text string")
    passages = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "gamma"), (3, "no such passage in the texts at all"), (4, "lpha beta gamma delta epsilon zet")], "item_id int, text string")
    assert {r.item_id: (r.occurrences, r.state) for r in notes.locate_passages(passages, texts).collect()} == {1: (3, "Ambiguous"), 2: (3, "Ambiguous"), 3: (0, "NotFound"), 4: (3, "Ambiguous")}


# views and conversions ------------------------------------------------------------------------------


def _tables(spark):
    ddl = "id int, label string"
    return {n: views.with_order(spark.createDataFrame(r, ddl), "id") for n, r in {"l": [(1, "a"), (2, "b"), (None, "n")], "r": [(2, "B"), (3, "C"), (None, "N")], "c": [(3, "c")]}.items()}


def test_views(spark):
    t = _tables(spark)
    a, b = views.table("l"), views.table("r")
    v = views.select(views.concat(views.table("c"), a), ["label", "id"], (1, 2))
    assert [tuple(r) for r in views.rows(views.resolve(views.View.from_json(v.to_json()), t)).collect()] == [("n", None), ("a", 1)]
    assert [tuple(r) for r in views.rows(views.resolve(views.join(a, b, ["id"]), t)).collect()] == [(2, "b", "B")]
    left = views.rows(views.resolve(views.join(a, b, ["id"], "left"), t)).collect()
    assert [tuple(r) for r in left] == [(None, "n", None), (1, "a", None), (2, "b", "B")]
    numbered = views.numbered(t["l"]).orderBy(views.POS)
    assert [r[views.POS] for r in numbered.collect()] == [1, 2, 3]
    for bad in (views.select(a, ["x"]), views.select(a, ["id"], (0, 4)), views.select(a, ["id"], (3, 1)), views.join(a, b, ["zz"]), views.View("join", [a]), views.View("select", [a], {"odd": 1}), views.table("none"), views.apply("nothing", a), views.concat(a, views.select(a, ["id"]))):
        with pytest.raises(views.ViewError):
            views.resolve(bad, t)
    with pytest.raises(views.ViewError):
        views.register("join", lambda x: x[0])


def test_transforms(spark):
    df = spark.createDataFrame([(1, "x", 4), (2, "y", 5), (3, "z", 6)], "a int, b string, c int")
    assert [tuple(r) for r in transform.apply([transform.Rename("a", "x"), transform.Drop("b")], df).collect()] == [(1, 4), (2, 5), (3, 6)]
    assert transform.apply([transform.Convert("a", LongType())], df).schema["a"].dataType == LongType()
    transform.register("double", lambda c: c * 2)
    assert [r.a for r in transform.apply([transform.Map("double", "a", IntegerType())], df).collect()] == [2, 4, 6]
    assert transform.moved([transform.Move("root/old", "root/new")], "root/old/points") == "root/new/points"
    assert transform.moved([transform.Move("root/old", "root/new")], "root/older") == "root/older"
    for bad in ([transform.Drop("nope")], [transform.Rename("a", "x"), transform.Rename("a", "y")], [transform.Rename("a", "x"), transform.Convert("x", LongType())], [transform.Map("double", "a", StringType())], [transform.Map("none", "a", IntegerType())]):
        with pytest.raises(transform.TransformError):
            transform.apply(bad, df)


# trees, store, catalog ------------------------------------------------------------------------------


def test_tree_paths_and_merges(spark):
    assert tree.parse_path("/a/b[3]") == ["a", "b", 3] and tree.show_path(["a", "b", 3]) == "/a/b[3]"
    with pytest.raises(ValueError):
        tree.parse_path("/a{k}")
    assert tree.canonical(["a", 1]) == b"F" + (1).to_bytes(8, "little") + b"a" + b"I" + (1).to_bytes(8, "little")
    dest = spark.createDataFrame([("/a", "1"), ("/b", "1"), ("/s/x", "1")], "path string, value string")
    src = spark.createDataFrame([("/a", "2"), ("/c", "s")], "path string, value string")
    want = {"overwrite": {"/a": "2", "/c": "s"}, "add": {"/a": "1", "/b": "1", "/c": "s", "/s/x": "1"}, "modify": {"/a": "2", "/b": "1", "/s/x": "1"}, "delete": {"/a": "1"}}
    for name, w in want.items():
        assert {r.path: r.value for r in tree.merge(dest, src, tree.FLAGS[name]).collect()} == w
    assert {r.path: r.value for r in tree.merge(dest, src, {"add", "modify"}).collect()} == {"/a": "2", "/b": "1", "/c": "s", "/s/x": "1"}
    assert {r.path: r.value for r in tree.merge(dest, src, None, ["/a"]).collect()} == {"/a": "2", "/b": "1", "/s/x": "1"}
    assert {r.path for r in tree.rename_subtree(dest, "/s", "/t").collect()} == {"/a", "/b", "/t/x"}
    with pytest.raises(ValueError):
        tree.rename_subtree(dest, "/b", "/a")
    nodes = spark.createDataFrame([("1", None, "a", None), ("2", "1", "b", "v"), ("3", "9", "c", "v"), ("2", "1", "b", "v")], "node string, parent string, segment string, value string")
    assert sorted((r.node, r.problem) for r in tree.tree_problems(nodes).collect()) == [("2", "repeated node"), ("2", "repeated segment"), ("3", "unknown parent")]
    got = tree.longest_reachable(tree.paths(nodes.limit(2)), "/a/b/z[1]").first()
    assert (got.path, got.rest) == ("/a/b", "/z[1]")


def test_store(spark):
    payloads = spark.createDataFrame([(b"x",), (b"x",), (b"ARROW1..",)], "payload binary")
    empty = payloads.select(F.lit("").alias("address"), "payload").limit(0)
    blocks = store.put(empty, payloads)
    assert blocks.count() == 2 and store.put(blocks, payloads).count() == 2
    assert {r.m for r in payloads.select(store.magic(F.col("payload")).alias("m")).collect()} == {"raw", "arrow"}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)] + [(77, 3)], "sequence bigint, parent bigint")
    assert sorted(r.sequence for r in store.reachable_commits(chain, 40, 7).collect()) == list(range(7, 41))
    with pytest.raises(ValueError):
        store.next_commit(chain, {"sequence": 5, "parent": 4})
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    a, b = store.table_digest(df, ["id"]).first(), store.table_digest(df.repartition(13, "v"), ["id"]).first()
    assert a == b and a != store.table_digest(df.withColumn("v", F.col("v") + 1), ["id"]).first()
    assert a != store.table_digest(df, ["v", "id"]).first()  # the order counts
    same = spark.range(9000).select(F.lit(1).alias("v"))
    assert store.table_digest(same, ["v"]).first() != store.table_digest(same.limit(8999), ["v"]).first() and store.table_digest(same.limit(0), ["v"]).count() == 1


def test_numbers_of_many_partitions(spark):
    """Wide rows in many partitions, with and without runtime plans: numbers are the order's."""
    df = spark.range(0, 200_000, 1, 16).select(F.xxhash64("id").alias("k"), F.repeat(F.col("id").cast("string"), 40).alias("wide"))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = views.numbered(views.with_order(df, "k")).select("k", views.POS).toPandas().sort_values("k")
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert (got[views.POS].to_numpy() == range(1, 200_001)).all()


def test_annotations_change_and_go(spark):
    from stackweave.operators import annotations as an

    page = "one two three two"
    drafts = spark.createDataFrame([("n1", "i1", "a1", 1, "three", "two ", ""), ("n2", "i1", "a1", 1, "two", "", ""), ("n3", "i1", "a1", 1, "two", "one ", "")], "annotation_id string, item_id string, asset_id string, page_number int, selected_text string, prefix_context string, suffix_context string")
    items = spark.createDataFrame([("i1",)], "item_id string")
    assets = spark.createDataFrame([("i1", "a1", "managed", "application/PDF", "available", "0" * 64)], "item_id string, asset_id string, storage_kind string, media_type string, status string, content_hash string")
    pages = spark.createDataFrame([("a1", 1, page)], "asset_id string, page_number int, text string")
    made = an.quote(drafts, items, assets, pages, F.lit("2024-01-01").cast("timestamp"), "1")
    assert {r.annotation_id: r.refused for r in made.collect()} == {"n1": None, "n2": "ambiguous", "n3": None}
    kept = made.where("refused is null").drop("refused").select(*an.FIELDS)
    back = an.parse_files(kept.select(F.col("annotation_id").alias("name"), an.file_text(kept).alias("value")))
    assert back.where("error is not null").count() == 0 and sorted(map(str, back.select(*an.FIELDS).collect())) == sorted(map(str, kept.collect()))
    edit = kept.where("annotation_id = 'n1'").drop("created_at", "updated_at").withColumn("page_number", F.lit(2))
    more = edit.withColumn("annotation_id", F.lit("n9")).unionByName(kept.where("annotation_id = 'n3'").drop("created_at", "updated_at").withColumn("selected_text", F.lit("")))
    now, refused = an.updated(kept, edit.unionByName(more), F.lit("2024-02-01").cast("timestamp"))
    got = {r.annotation_id: r for r in now.collect()}
    assert got["n1"].page_number == 2 and got["n1"].updated_at > got["n1"].created_at and got["n3"].page_number == 1
    assert {r.annotation_id: r.refused for r in refused.collect()} == {"n9": "unknown annotation", "n3": "selected_text"}
    left, unknown = an.deleted(now, spark.createDataFrame([("n1",), ("n7",)], "annotation_id string"))
    assert [r.annotation_id for r in an.listed(left, "i1").collect()] == ["n3"] and unknown.first().annotation_id == "n7"


def test_catalog():
    r = catalog.Registry()
    r.register(catalog.NodeType("base", [catalog.Child("id", "text")]))
    r.register(catalog.NodeType("sample", [catalog.Child("rows", "table", "ZeroOrMore")], ["base"]))
    assert [c.name for c in r.children("sample")] == ["id", "rows"] and ("sample", "table", 0, None) in r.definitions()
    with pytest.raises(catalog.Conflict):
        r.register(catalog.NodeType("base", []))
    r.register(catalog.NodeType("loop", [], ["loop"]))
    with pytest.raises(catalog.Conflict):
        r.children("loop")
    with pytest.raises(catalog.Conflict):
        catalog.compose([catalog.NodeType("a")], [catalog.NodeType("a", [catalog.Child("x", "y")])])
    assert catalog.compose([catalog.NodeType("a")], [catalog.NodeType("a", [catalog.Child("x", "y")])], "merge")[0].children
    assert sorted(["1.0.0", "1.0.0-rc.2", "1.0.0-rc.10", "0.9.9+b"], key=catalog.version_key) == ["0.9.9+b", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0"]


# vaults, sinks, resolvers, streams, the command line -------------------------------------------------


def _raw(spark, root):
    s = queries.view(spark, SF, "sources")
    raw = s.select(F.col("openalex_id").alias("id"), F.col("source_type").alias("type"), "display_name", "works_count", "cited_by_count", "oa_works_count", "country_code", "is_oa", "issn_l", "homepage_url", "apc_usd", "is_in_doaj", F.struct(F.col("mean_citedness_2yr").alias("2yr_mean_citedness"), "h_index", "i10_index").alias("summary_stats"))
    part = root / "updated_date=2026-08-25"
    os.makedirs(part)
    raw.coalesce(1).write.parquet(f"file://{root}/tmp")
    name = next(n for n in os.listdir(root / "tmp") if n.endswith(".parquet"))
    os.rename(root / "tmp" / name, part / "part_0000.parquet")
    (root / "manifest.json").write_text('{"date": "2026-08-25"}')
    return f"file://{root}"


@pytest.mark.parametrize("with_arrow", [False, True])
def test_vault_round_trip(spark, tmp_path, with_arrow, capsys):
    raw = _raw(spark, tmp_path / "raw")
    assert vault.inspect_partitions(spark, raw) | {"bytes": 0} == {"partitions": 1, "bytes": 0, "has_manifest": True, "snapshot_date": "2026-08-25"}
    place = f"file://{tmp_path}/vault"
    v = vault.import_sources(spark, raw, place, with_arrow)
    want = queries.QUERIES["source_rank_h"](spark, SF).collect()
    assert v.top_sources("h_index", 30).collect() == want and v.manifest["source"]["snapshot_date"] == "2026-08-25"
    assert v.table_path("sources").endswith(".arrow") == with_arrow
    with pytest.raises(FileExistsError):
        vault.import_sources(spark, raw, place)
    with pytest.raises(FileNotFoundError):
        vault.inspect_partitions(spark, f"file://{tmp_path}/none")
    assert vault.Vault.open_any(spark, f"{place}/tables/sources.parquet").overview().first().sources == v.overview().first().sources
    assert cli.main(["rank", place, "h_index", "--limit", "3"], spark) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]) == min(3, len(want))
    for bad in ("/x", "../x", "c:\\x", "s3://x"):
        with pytest.raises(ValueError):
            vault.safe_relative(bad)


def test_exports(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([(1, "a,<b>", None), (2, None, True)], "i int, s string, b boolean")
    assert sinks.export(df, str(tmp_path / "x" / "o.csv")) == 2
    assert (tmp_path / "x" / "o.csv").read_text().split() == ["i,s,b", '1,"a,<b>",', "2,,true"]
    assert sinks.export(df, str(tmp_path / "o.xlsx")) == 2
    sheet = zipfile.ZipFile(tmp_path / "o.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "a,&lt;b&gt;" in sheet and sheet.count("<row>") == 3
    assert [json.loads(r[0]) for r in sinks.json_rows(df).collect()][0] == {"i": 1, "s": "a,<b>", "b": None}
    assert sinks.backup(str(tmp_path / "x"), str(tmp_path / "b.zip")) == 1
    sinks.restore(str(tmp_path / "b.zip"), str(tmp_path / "y"))
    assert (tmp_path / "y" / "o.csv").exists()
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "")
    with pytest.raises(ValueError):
        sinks.restore(str(tmp_path / "bad.zip"), str(tmp_path / "z"))
    files.write_json(spark, f"file://{tmp_path}/a/b.json", {"x": 1})
    files.write_json(spark, f"file://{tmp_path}/a/b.json", {"x": 2})
    assert files.read_json(spark, f"file://{tmp_path}/a/b.json") == {"x": 2}


def test_resolvers():
    crossref = {"message": {"DOI": "10.1/X", "title": [""], "author": [{"family": "F", "given": "G"}], "issued": {"date-parts": [[2020]]}, "type": "journal-article", "container-title": ["J"]}}
    scholar = {"paperId": "p", "title": "S title", "year": 2021, "externalIds": {"DOI": "10.1/x", "PubMed": "5"}, "authors": []}
    calls = []

    def fetch(url):
        calls.append(url)
        if "crossref" in url:
            return 200, json.dumps(crossref)
        if "semanticscholar" in url:
            return 200, json.dumps(scholar)
        return 404, ""

    got = resolvers.Registry(fetch).resolve_best("doi", "10.1/x")
    assert (got["title"], got["published_year"], got["source_name"], got["authors"]) == ("S title", 2020, "Crossref + Semantic Scholar", ["F, G"])
    assert [i["namespace"] for i in got["external_identifiers"]] == ["doi", "pmid"] and got["raw_fields"]["journal"] == "J"
    with pytest.raises(resolvers.NotFound):
        resolvers.Registry(fetch).resolve_best("isbn", "1")
    tries = []

    def broken(url):
        tries.append(url)
        return (503, "") if len(tries) == 1 else (200, "{")

    with pytest.raises(resolvers.Malformed):
        resolvers.fetch_json(broken, "u", 0)
    assert len(tries) == 2


def test_session_stream_equals_the_batch_fold(spark, tmp_path):
    rows = [(1, 1, "start"), (2, 1, "pause"), (3, 1, "start"), (4, 1, "resume"), (5, 2, "start"), (6, 2, "end"), (7, 2, "resume"), (8, 2, "start")]
    df = spark.createDataFrame(rows, "event_id bigint, item_id bigint, action string").select("event_id", F.timestamp_seconds("event_id").alias("ts"), "item_id", (F.col("item_id") * 10).alias("asset_id"), "action")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.session_states(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.item_id: (r.state, r.refused) for r in spark.table("states").collect()}
    assert got == {1: ("active", 1), 2: ("active", 1)}
    seen = []
    q = live.apply_changes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), lambda b, _: seen.append(b.count()), f"{tmp_path}/cp2")
    q.awaitTermination(90)
    assert sum(seen) == len(rows)
    # the same batch once more, as after a restart that lost the commit: it is marked
    shutil.rmtree(f"{tmp_path}/cp2/commits")
    live.apply_changes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), lambda b, _: seen.append(b.count()), f"{tmp_path}/cp2").awaitTermination(90)
    assert sum(seen) == len(rows)


def test_schema_assertion(spark):
    from stackweave.schemas import assert_schema

    want = StructType([StructField("a", IntegerType())])
    assert_schema(spark.createDataFrame([(1,)], "a int"), want)
    with pytest.raises(ValueError):
        assert_schema(spark.createDataFrame([(1,)], "a bigint"), want)


def test_nothing_imports_the_training_operators():
    import pathlib

    root = pathlib.Path(queries.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())


def test_identity_queries_reach_every_customer(spark):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    counts = queries.QUERIES["import_preview_counts"](spark, sf).first()
    assert counts.created + counts.merged == n and counts.created > n // 20
    assert queries.QUERIES["identity_match"](spark, sf).agg({"item_id": "max"}).first()[0] > 500
    assert queries.QUERIES["record_merge_fill"](spark, sf).count() == n


def test_join_and_size_queries_reach_every_row(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert queries.QUERIES["display_size"](spark, sf).count() == docs
    assert queries.QUERIES["view_join_inner"](spark, sf).count() == orders.where("o_orderkey % 7 <> 0").count()
    left = queries.QUERIES["view_join_left"](spark, sf)
    assert left.count() == orders.count() and left.where("c_name IS NULL").count() == orders.where("o_orderkey % 7 = 0").count()
    assert queries.QUERIES["view_nested"](spark, sf).count() == 100
