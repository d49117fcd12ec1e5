"""Registered queries of the library's operators, and the same in SQL.

Every query runs over whole tables; a limit stands only where it is the feature (a top-k, a
page).  The SQL names fixture views, which are put in front of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .fixtures import table, view, with_views
from .functions import identifiers as ids
from .functions import text as tx
from .operators import annotations, library, notes, ranking, search, sessions, store, tree
from .plans import transform, views
from .sources import records, resolvers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, using: tuple[str, ...] = ()):
    """Registers a query and its SQL over the fixture views that it uses."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = with_views(sql, *using) if using else sql
        return f

    return add


# Sources: summary, rankings, searches ---------------------------------------------------------------


@query(
    """SELECT count(*) AS sources, count(*) FILTER (source_type = 'journal') AS journals, count(*) FILTER (source_type = 'conference') AS conferences,
  count(*) FILTER (is_oa) AS open_access, CAST(coalesce(sum(works_count), 0) AS BIGINT) AS works, CAST(coalesce(sum(cited_by_count), 0) AS BIGINT) AS citations FROM sources""",
    using=("sources",),
)
def source_overview(spark, d):
    return ranking.overview(view(spark, d, "sources"))


RANKED = ", ".join(ranking.RANKED)
METRIC_SQL = {"works": "works_count", "cited": "cited_by_count", "h": "h_index", "i10": "i10_index", "mean": "mean_citedness_2yr", "citations_per_work": "CAST(cited_by_count AS DOUBLE) / nullif(works_count, 0)", "oa_rate": "CAST(oa_works_count AS DOUBLE) / nullif(works_count, 0)"}
METRIC_OF = {"works": "works_count", "cited": "cited_by_count", "h": "h_index", "i10": "i10_index", "mean": "mean_citedness_2yr"}


def _rank(short: str) -> None:
    sql = f"SELECT {RANKED}, {METRIC_SQL[short]} AS metric_value FROM sources WHERE source_type = 'journal' ORDER BY metric_value DESC NULLS FIRST, openalex_id LIMIT 30"
    query(sql, f"source_rank_{short}", ("sources",))(lambda spark, d: ranking.top_sources(view(spark, d, "sources"), METRIC_OF.get(short, short), 30))


for _short in METRIC_SQL:
    _rank(_short)

SEARCHED = ", ".join(ranking.SEARCHED)
SEARCHES = {
    "all": ({}, "TRUE", 100, 0),
    "country": ({"country": "n1"}, "country_code = 'N1'", 100, 0),
    "oa": ({"is_oa": True, "source_type": "conference"}, "is_oa AND source_type = 'conference'", 100, 0),
    "text": ({"text": "PLIER#00000001"}, "contains(lower(display_name), lower('PLIER#00000001'))", 100, 0),
    "page2": ({"limit": 20, "offset": 20}, "TRUE", 20, 20),
}


def _search(short: str) -> None:
    args, where, limit, offset = SEARCHES[short]
    query(f"SELECT {SEARCHED} FROM sources WHERE {where} ORDER BY openalex_id LIMIT {limit} OFFSET {offset}", f"source_search_{short}", ("sources",))(lambda spark, d: ranking.search_sources(view(spark, d, "sources"), **args))


for _short in SEARCHES:
    _search(_short)


@query(f"SELECT display_name AS name, metric_value AS value FROM (SELECT {RANKED}, h_index AS metric_value FROM sources WHERE source_type = 'journal') ORDER BY metric_value DESC NULLS FIRST, openalex_id LIMIT 10", using=("sources",))
def source_chart(spark, d):
    return ranking.chart(ranking.top_sources(view(spark, d, "sources"), "h_index", 30))


@query(
    """SELECT openalex_id, display_name, source_type, issn_l, works_count, oa_works_count, cited_by_count, mean_citedness_2yr, h_index, i10_index, is_oa, is_in_doaj,
  homepage_url, apc_usd, country_code FROM sources""",
    using=("sources",),
)
def import_projection(spark, d):
    s = view(spark, d, "sources")
    stats = F.struct(F.col("mean_citedness_2yr").alias("2yr_mean_citedness"), "h_index", "i10_index").alias("summary_stats")
    raw = s.select(F.col("openalex_id").alias("id"), F.col("source_type").alias("type"), *[c for c in s.columns if c not in ("openalex_id", "source_type", "mean_citedness_2yr", "h_index", "i10_index")], stats)
    return ranking.import_projection(raw).select(*s.select("openalex_id", "display_name", "source_type", "issn_l", "works_count", "oa_works_count", "cited_by_count", "mean_citedness_2yr", "h_index", "i10_index", "is_oa", "is_in_doaj", "homepage_url", "apc_usd", "country_code").columns)


# Records, identifiers --------------------------------------------------------------------------------


@query(
    """SELECT 'W' || CAST(doc_id AS VARCHAR) AS external_id, split_part(text, chr(10), 1) AS title, lang AS author, CAST(2000 + doc_id % 20 AS INTEGER) AS published_year,
  CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'other' END AS item_type, '10.5/d' || CAST(doc_id AS VARCHAR) AS doi, CAST(doc_id AS VARCHAR) || '-' || CAST(doc_id + 9 AS VARCHAR) AS pages FROM documents"""
)
def works_json_extract(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    work = F.to_json(
        F.struct(
            F.concat(F.lit("https://openalex.org/W"), i).alias("id"),
            F.concat(F.lit("https://doi.org/10.5/D"), i).alias("doi"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.array(F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))).alias("authorships"),
            (2000 + F.col("doc_id") % 20).cast("int").alias("publication_year"),
            F.when(F.col("doc_id") % 3 == 0, "article").when(F.col("doc_id") % 3 == 1, "book").otherwise("dataset").alias("type"),
            F.struct(i.alias("first_page"), (F.col("doc_id") + 9).cast("string").alias("last_page")).alias("biblio"),
        )
    )
    r = records.works_from_json(docs.select(work.alias("value")))
    doi = F.get(F.filter("external_identifiers", lambda x: x["namespace"] == "doi"), F.lit(0))["value"]
    return r.select("external_id", "title", F.get("authors", F.lit(0)).alias("author"), "published_year", "item_type", doi.alias("doi"), "pages")


@query("SELECT p_partkey AS id, p_name AS abstract_text FROM part")
def abstract_from_inverted_index(spark, d):
    words = F.split("p_name", " ", -1)
    places = F.map_from_arrays(F.array_distinct(words), F.transform(F.array_distinct(words), lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.when(F.get(words, i) == w, i)), lambda p: p.isNotNull())))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.abstract_text(places).alias("abstract_text"))


RAW_IDENTIFIERS = """
WITH raw AS (
  SELECT page_id AS id, url AS x FROM pages
  UNION ALL SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'doi:10.1000/AB' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'pmid:' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'PMC:PMC' || CAST(c_custkey AS VARCHAR)
    WHEN 3 THEN '978-0-13-' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || '-1' WHEN 4 THEN CAST(c_custkey AS VARCHAR) ELSE 'name ' || c_name || ' x' END FROM customer)"""

IDENTIFIER_SQL = RAW_IDENTIFIERS + """,
t AS (SELECT id, trim(x) AS x, lower(trim(x)) AS l, upper(trim(x)) AS u FROM raw),
k AS (SELECT id,
  trim(regexp_replace(u, '^(?:W)?(?:HTTPS://OPENALEX\\.ORG/)?(?:HTTP://OPENALEX\\.ORG/)?', '')) AS o,
  trim(regexp_replace(l, '^(?:doi:)?(?:https://doi\\.org/)?(?:http://doi\\.org/)?', '')) AS d,
  trim(replace(l, 'pmid:', '')) AS p,
  trim(regexp_replace(trim(regexp_replace(l, '^(?:pmcid:)?(?:pmc:)?', '')), '^pmc', '')) AS c,
  regexp_replace(u, '[^0-9X]', '', 'g') AS i FROM t)
SELECT id, CASE WHEN regexp_full_match(o, 'W?[0-9]+') THEN 'openalex' WHEN contains(d, '/') THEN 'doi' WHEN regexp_full_match(p, '[0-9]+') THEN 'pmid' WHEN regexp_full_match(c, '[0-9]+') THEN 'pmcid'
    WHEN length(i) IN (10, 13) THEN 'isbn' END AS namespace,
  CASE WHEN regexp_full_match(o, 'W?[0-9]+') THEN 'W' || ltrim(o, 'W') WHEN contains(d, '/') THEN d WHEN regexp_full_match(p, '[0-9]+') THEN p WHEN regexp_full_match(c, '[0-9]+') THEN c
    WHEN length(i) IN (10, 13) THEN i END AS value FROM k"""


def _identifiers(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    made = (
        F.when(k % 6 == 0, F.concat(F.lit("doi:10.1000/AB"), s))
        .when(k % 6 == 1, F.concat(F.lit("pmid:"), s))
        .when(k % 6 == 2, F.concat(F.lit("PMC:PMC"), s))
        .when(k % 6 == 3, F.concat(F.lit("978-0-13-"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("-1")))
        .when(k % 6 == 4, s)
        .otherwise(F.concat(F.lit("name "), "c_name", F.lit(" x")))
    )
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("x")).unionByName(table(spark, d, "customer").select(k.alias("id"), made.alias("x")))


@query(IDENTIFIER_SQL)
def identifier_classify(spark, d):
    return _identifiers(spark, d).select("id", ids.classify(F.col("x")).alias("i")).select("id", "i.namespace", "i.value")


@query(
    RAW_IDENTIFIERS
    + """
SELECT id, CASE WHEN contains(x, '/') OR starts_with(lower(trim(x)), 'doi:') THEN 'doi' WHEN starts_with(lower(trim(x)), 'pmid:') OR regexp_full_match(trim(x), '[0-9]+') THEN 'pmid'
    WHEN starts_with(lower(trim(x)), 'pmc:') OR starts_with(lower(trim(x)), 'pmcid:') THEN 'pmcid' END AS kind FROM raw"""
)
def identifier_guess(spark, d):
    return _identifiers(spark, d).select("id", ids.guess(F.col("x")).alias("kind"))


@query("SELECT page_id AS id, regexp_replace(lower(url), '^(?:https://|http://)', '') AS doi FROM pages")
def doi_normalize(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), ids.doi(F.regexp_replace("url", "^https?://", "https://doi.org/")).alias("doi"))


# The library -----------------------------------------------------------------------------------------


@query("SELECT item_id, title, reading_status FROM items WHERE (contains(lower(title), 'that') OR contains(lower(author), 'that') OR contains(lower(tag), 'that')) AND reading_status = 'inbox'", using=("items",))
def item_keyword_filter(spark, d):
    items = view(spark, d, "items").withColumns({"authors": F.array("author"), "tags": F.array("tag")})
    return library.list_items(items, "That", "inbox").select("item_id", "title", "reading_status")


def _pair(namespace: str, c: str) -> Column:
    return F.struct(F.lit(namespace).alias("namespace"), F.col(c).alias("value"))


def _records(spark, d) -> DataFrame:
    return view(spark, d, "records").withColumn("external_identifiers", F.array(_pair("doi", "doi"), _pair("pmid", "pmid")))


def _library(spark, d) -> DataFrame:
    return view(spark, d, "library").withColumn("external_identifiers", F.array(_pair("doi", "doi"), _pair("pmid", "pmid")))


MATCH_SQL = """, m AS (SELECT r.record_id, coalesce(d.item_id, p.item_id) AS item_id FROM records r
  LEFT JOIN (SELECT lower(doi) AS v, min(item_id) AS item_id FROM library GROUP BY 1) d ON lower(r.doi) = d.v
  LEFT JOIN (SELECT lower(pmid) AS v, min(item_id) AS item_id FROM library GROUP BY 1) p ON lower(r.pmid) = p.v)"""


def _match_sql(sql: str) -> str:
    return with_views("", "records", "library").rstrip() + MATCH_SQL + "\n" + sql


@query(_match_sql("SELECT record_id, item_id FROM m WHERE item_id IS NOT NULL"))
def identity_match(spark, d):
    return library.identity_match(_records(spark, d), _library(spark, d))


@query(_match_sql("SELECT count(*) FILTER (item_id IS NULL) AS created, count(*) FILTER (item_id IS NOT NULL) AS merged, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors FROM m"))
def import_preview_counts(spark, d):
    return library.import_counts(library.import_preview(_records(spark, d), _library(spark, d)))


@query(
    _match_sql(
        """SELECT l.item_id, CASE WHEN trim(l.title) = '' THEN coalesce(b.title, l.title) ELSE l.title END AS title, coalesce(b.n, 0) AS n_records
FROM library l LEFT JOIN (SELECT m.item_id, arg_min(r.title, r.record_id) AS title, count(*) AS n FROM m JOIN records r USING (record_id) WHERE m.item_id IS NOT NULL GROUP BY 1) b USING (item_id)"""
    )
)
def record_merge_fill(spark, d):
    items = _library(spark, d).select("item_id", "title", F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("published_year"), F.lit("other").alias("item_type"), F.array().cast("array<struct<source_name:string,external_id:string,original_locator:string>>").alias("sources"), "external_identifiers")
    recs = _records(spark, d).select("record_id", F.lit("RIS").alias("source_name"), F.col("record_id").cast("string").alias("external_id"), "title", F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("published_year"), F.lit("other").alias("item_type"), "external_identifiers")
    merged = library.merge_into_items(items, recs, library.identity_match(recs, items))
    return merged.select("item_id", "title", F.size("sources").cast("bigint").alias("n_records"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS asset_id, count(*) AS copies FROM documents GROUP BY 1")
def asset_dedup_by_hash(spark, d):
    return store.dedup_assets(table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.col("text").alias("content")))


# Views and conversions -------------------------------------------------------------------------------


def _orders(spark, d) -> DataFrame:
    return views.with_order(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


def _customers(spark, d) -> DataFrame:
    return views.with_order(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")


def _resolved(view_: views.View, **tables: DataFrame) -> DataFrame:
    return views.resolve(view_, tables).drop(views.POS)


# Every customer takes part; orders without one get a key that none has.
JOIN_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_custkey ELSE o_custkey END AS o_custkey, o_totalprice FROM orders) {} JOIN customer ON c_custkey = o_custkey"


def _joined(spark, d, how: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 7 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return _resolved(views.join(views.table("o"), views.table("c"), ["o_custkey"], how), o=_orders(spark, d).withColumn("o_custkey", key), c=_customers(spark, d))


@query(JOIN_SQL.format(""))
def view_join_inner(spark, d):
    return _joined(spark, d, "inner")


@query(JOIN_SQL.format("LEFT"))
def view_join_left(spark, d):
    return _joined(spark, d, "left")


def _lines(spark, d, flag: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return views.with_order(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'")
def view_concat(spark, d):
    return _resolved(views.concat(views.table("r"), views.table("a")), r=_lines(spark, d, "R"), a=_lines(spark, d, "A"))


@query("SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 10")
def view_select_interval(spark, d):
    return _resolved(views.select(views.table("o"), ["o_totalprice", "o_orderkey"], (10, 40)), o=_orders(spark, d))


@query(
    """SELECT o_orderkey, c_name FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 5)
JOIN customer ON c_custkey = o_custkey"""
)
def view_nested(spark, d):
    v = views.select(views.join(views.select(views.table("o"), ["o_orderkey", "o_custkey"], (5, 100)), views.table("c"), ["o_custkey"]), ["o_orderkey", "c_name"])
    return _resolved(views.View.from_json(v.to_json()), o=_orders(spark, d), c=_customers(spark, d))


def _sum_keys(inputs: list[DataFrame]) -> DataFrame:
    parts = [i.select(F.sum("o_custkey").alias("s"), F.count("*").alias("n")) for i in inputs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("s").cast("bigint").alias("total"), F.sum("n").cast("bigint").alias("n"))


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total, count(*) AS n FROM orders")
def view_registered_sum(spark, d):
    views.unregister("sum_keys")
    views.register("sum_keys", _sum_keys)
    o = _orders(spark, d)
    return _resolved(views.apply("sum_keys", views.table("a"), views.table("b")), a=o.where("o_orderkey % 2 = 0"), b=o.where("o_orderkey % 2 <> 0"))


@query("SELECT CAST(p_partkey AS DOUBLE) AS part, p_name, p_size * 2 AS p_size, 'fixed' AS p_brand FROM part")
def transform_plan(spark, d):
    from pyspark.sql.types import IntegerType

    transform.register("double", lambda c: c * 2)
    rules = [transform.Rename("p_partkey", "part"), transform.Drop("p_type"), transform.Drop("p_retailprice"), transform.Fill("p_brand", "fixed"), transform.Map("double", "p_size", IntegerType())]
    out = transform.apply(rules, table(spark, d, "part"))
    return transform.apply([transform.Convert("part", DoubleType())], out)


# Text and search -------------------------------------------------------------------------------------

TERMS_SQL = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"SELECT doc_id, len({TERMS_SQL.format('text')}) AS n_terms, array_to_string(list_sort({TERMS_SQL.format('text')}), ' ') AS terms FROM documents")
def analyze_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_terms"), F.array_join(F.array_sort("t"), " ").alias("terms"))


def _index(spark, d):
    items = view(spark, d, "items").withColumns({"authors": F.array("author"), "tags": F.array("tag")})
    return items, view(spark, d, "assets")


FIELDS_SQL = (
    with_views("", "items", "assets").rstrip()
    + f""",
fields AS (
  SELECT item_id, 'title' AS field, CAST(NULL AS BIGINT) AS asset_id, {TERMS_SQL.format("coalesce(title, '')")} AS terms FROM items
  UNION ALL SELECT item_id, 'authors', NULL, {TERMS_SQL.format("author")} FROM items
  UNION ALL SELECT item_id, 'tags', NULL, {TERMS_SQL.format("tag")} FROM items
  UNION ALL SELECT item_id, 'content', asset_id, {TERMS_SQL.format("content")} FROM assets WHERE path LIKE '%.pdf' AND status = 'available' AND file_size <= 33554432 AND trim(content) <> ''),
matches AS (SELECT item_id, field, asset_id FROM fields WHERE len(list_intersect(terms, [{{terms}}])) = {{n}} AND field IN ({{fields}})),
hits AS (SELECT item_id, max(CASE WHEN field <> 'content' THEN 1 ELSE 0 END) AS has_metadata, count(*) AS n_matches FROM matches GROUP BY item_id)
"""
)


def _fields_sql(text: str, fields: tuple[str, ...], sql: str) -> str:
    t = tx.analyze(text)
    return FIELDS_SQL.replace("{terms}", ", ".join(f"'{x}'" for x in t)).replace("{n}", str(len(t))).replace("{fields}", ", ".join(f"'{f}'" for f in fields)) + sql


TEXT = "The that"


def _matches(spark, d, scopes: list[str] | None) -> DataFrame:
    items, assets = _index(spark, d)
    return search.field_matches(search.build(items, assets)[0], tx.analyze(TEXT), scopes)


def _found(name: str, scopes: list[str]) -> None:
    query(_fields_sql(TEXT, tuple(search.scope_fields(scopes)), "SELECT item_id, field, asset_id FROM matches"), name)(lambda spark, d: _matches(spark, d, scopes))


for _name, _scopes in {"search_metadata": ["metadata"], "search_content": ["content"], "search_scoped": ["title", "tags"]}.items():
    _found(_name, _scopes)


@query(_fields_sql(TEXT, search.FIELDS, "SELECT count(*) AS total_hits FROM hits"))
def search_total(spark, d):
    return search.hits(_matches(spark, d, None)).agg(F.count(F.lit(1)).alias("total_hits"))


@query(_fields_sql(TEXT, search.FIELDS, "SELECT item_id, CAST(has_metadata AS INTEGER) AS has_metadata, n_matches FROM hits ORDER BY has_metadata DESC, item_id LIMIT 50 OFFSET 10"))
def search_all_page(spark, d):
    found = search.hits(_matches(spark, d, None)).orderBy(F.desc("has_metadata"), "item_id").offset(10).limit(50)
    return found.select("item_id", "has_metadata", F.size("field_matches").cast("bigint").alias("n_matches"))


@query(
    """WITH t AS (SELECT doc_id, text, greatest(instr(lower(text), 'that') - 1, 0) AS place FROM documents), s AS (SELECT *, greatest(place - 80, 0) AS a FROM t), e AS (SELECT *, least(a + 240, length(text)) AS b FROM s)
SELECT doc_id, (CASE WHEN a > 0 THEN '…' ELSE '' END) || substring(text, a + 1, b - a) || (CASE WHEN b < length(text) THEN '…' ELSE '' END) AS excerpt FROM e"""
)
def search_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.excerpt(F.col("text"), ["that"]).alias("excerpt"))


CHANGED = "item_id % 7 = 0"


@query(
    _fields_sql(TEXT, search.FIELDS, "SELECT field, count(*) AS n_postings, count(DISTINCT item_id) AS n_items FROM (SELECT item_id, field, unnest(terms) AS term FROM fields WHERE item_id % 11 <> 0) GROUP BY field")
)
def index_incremental_equals_rebuild(spark, d):
    """The index of an older library brought up to date: removed, changed and new items and assets."""
    items, assets = _index(spark, d)
    old_items = items.withColumn("title", F.when(F.col("item_id") % 7 == 0, "old title").otherwise(F.col("title")))
    old_assets = assets.withColumn("content", F.when(F.col("item_id") % 5 == 0, "old content").otherwise(F.col("content")))
    old = search.build(old_items, old_assets)
    now_items, now_assets = items.where("item_id % 11 <> 0"), assets.where("item_id % 11 <> 0")

    def change(kind: str, where: str, asset: bool) -> DataFrame:
        return items.where(where).select(F.lit(kind).alias("kind"), "item_id", (F.col("item_id") if asset else F.lit(None).cast("bigint")).alias("asset_id"))

    changes = change("item_removed", "item_id % 11 = 0", False).unionByName(change("metadata_changed", "item_id % 7 = 0", False)).unionByName(change("asset_changed", "item_id % 5 = 0", True))
    index, _ = search.update(*old, now_items, now_assets, changes)
    return index.groupBy("field").agg(F.count(F.lit(1)).alias("n_postings"), F.count_distinct("item_id").alias("n_items"))


@query(
    "SELECT item_id, asset_id, CASE WHEN path NOT LIKE '%.pdf' THEN 'unsupported' WHEN status <> 'available' THEN status ELSE 'no_text' END AS kind FROM assets WHERE path NOT LIKE '%.pdf' OR status <> 'available' OR trim(content) = ''",
    using=("assets",),
)
def index_issues(spark, d):
    items, assets = _index(spark, d)
    return search.issues(search.asset_state(assets, items))


# Sessions, notes, annotations ------------------------------------------------------------------------


@query("SELECT session_id, item_id, asset_id, state FROM sessions ORDER BY last_opened_at DESC, started_at DESC, session_id DESC LIMIT 20", using=("sessions",))
def sessions_recent(spark, d):
    return sessions.recent(view(spark, d, "sessions"), 20).select("session_id", "item_id", "asset_id", "state")


@query("SELECT item_id, session_id, state FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (state <> 'closed') DESC, last_opened_at DESC, started_at DESC, session_id DESC) AS n FROM sessions) WHERE n = 1", using=("sessions",))
def session_continue(spark, d):
    return sessions.continue_target(view(spark, d, "sessions"), ["item_id"]).select("item_id", "session_id", "state")


@query("SELECT item_id, asset_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id, asset_id ORDER BY last_opened_at DESC, started_at DESC, session_id DESC) AS n FROM sessions) WHERE n = 1", using=("sessions",))
def session_latest(spark, d):
    return sessions.latest(view(spark, d, "sessions"), ["item_id", "asset_id"]).select("item_id", "asset_id", "session_id")


@query("SELECT s.session_id, s.asset_id, coalesce(a.status, 'invalid') AS status FROM sessions s LEFT JOIN (SELECT * FROM assets WHERE asset_id % 2 = 0) a USING (asset_id)", using=("sessions", "assets"))
def session_asset_status(spark, d):
    return sessions.with_asset_status(view(spark, d, "sessions"), view(spark, d, "assets").where("asset_id % 2 = 0")).select("session_id", "asset_id", "status")


@query(
    """WITH n AS (SELECT b.item_id, CAST(sum((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text)) AS BIGINT) AS occurrences FROM benchmark b, documents d WHERE contains(d.text, b.text) GROUP BY 1)
SELECT b.item_id, coalesce(n.occurrences, 0) AS occurrences, CASE WHEN n.occurrences IS NULL THEN 'NotFound' WHEN n.occurrences = 1 THEN 'Found' ELSE 'Ambiguous' END AS state FROM benchmark b LEFT JOIN n USING (item_id)"""
)
def annotation_location(spark, d):
    return notes.locate_passages(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query("SELECT note_id, item_id, updated_at, markdown_body FROM notes WHERE archived_at IS NULL", using=("notes",))
def notes_listing(spark, d):
    return notes.list_notes(view(spark, d, "notes")).select("note_id", "item_id", "updated_at", "markdown_body")


@query("SELECT note_id, sha256(markdown_body) AS revision FROM notes", using=("notes",))
def note_revisions(spark, d):
    return view(spark, d, "notes").select("note_id", notes.revision(F.col("markdown_body")).alias("revision"))


PAGES_SQL = """WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN substring(text, 1, 9000) WHEN doc_id % 6 = 2 THEN 'no such words here' ELSE substring(text, 1, 40) END AS quote,
  doc_id % 17 = 0 AS orphan, CASE WHEN doc_id % 13 = 0 THEN 'external' ELSE 'managed' END AS storage_kind, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'available' END AS status, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS page FROM documents)
SELECT doc_id AS annotation_id, CASE WHEN page < 1 THEN 'page_out_of_range' WHEN length(quote) < 1 OR length(quote) > 8192 THEN 'selected_text' WHEN orphan THEN 'unknown item' WHEN storage_kind = 'external' THEN 'external asset'
  WHEN status <> 'available' THEN 'unavailable asset' WHEN NOT contains(text, quote) THEN 'not found' WHEN contains(substring(text, instr(text, quote) + length(quote)), quote) THEN 'ambiguous' END AS refused,
  CASE WHEN refused IS NULL THEN sha256(quote) END AS normalized_text_hash, CASE WHEN refused IS NULL THEN sha256(text) END AS asset_content_hash_at_capture FROM a"""


@query(PAGES_SQL)
def annotation_quotes(spark, d):
    """A quote of every document, kept or refused: bad anchors, unknown items, assets that cannot be quoted, text that is gone or there twice."""
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    quote = F.when(i % 6 == 0, "").when(i % 6 == 1, F.substring("text", 1, 9000)).when(i % 6 == 2, "no such words here").otherwise(F.substring("text", 1, 40))
    drafts = docs.select(i.alias("annotation_id"), i.alias("item_id"), i.alias("asset_id"), F.when(i % 7 == 0, 0).otherwise(1).alias("page_number"), quote.alias("selected_text"), F.lit("").alias("prefix_context"), F.lit("").alias("suffix_context"))
    items = docs.where(i % 17 != 0).select(i.alias("item_id"))
    assets = docs.select(i.alias("item_id"), i.alias("asset_id"), F.when(i % 13 == 0, "external").otherwise("managed").alias("storage_kind"), F.lit("application/pdf").alias("media_type"), F.when(i % 11 == 0, "missing").otherwise("available").alias("status"), F.sha2("text", 256).alias("content_hash"))
    pages = docs.select(i.alias("asset_id"), F.lit(1).alias("page_number"), "text")
    made = annotations.quote(drafts, items, assets, pages, F.lit("2024-01-01").cast("timestamp"), "1")
    return made.select("annotation_id", "refused", "normalized_text_hash", "asset_content_hash_at_capture")


@query("SELECT c_custkey AS annotation_id, CASE c_custkey % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unknown version' WHEN 2 THEN 'other id' END AS error FROM customer")
def annotation_files(spark, d):
    """Annotations through their files and back; some files cut short, of another version, or under another name."""
    k = F.col("c_custkey")
    a = table(spark, d, "customer").select(k.cast("string").alias("annotation_id"), F.lit("i1").alias("item_id"), F.lit("a1").alias("asset_id"), F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("created_at"), F.lit("2024-01-02T00:00:00Z").cast("timestamp").alias("updated_at"), F.sha2("c_name", 256).alias("asset_content_hash_at_capture"), F.lit("1").alias("extractor_version"), F.lit(1).alias("page_number"), F.col("c_name").alias("selected_text"), F.sha2("c_name", 256).alias("normalized_text_hash"), F.lit("").alias("prefix_context"), F.lit("").alias("suffix_context"), k)
    text = annotations.file_text(a)
    broken = F.when(k % 4 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).when(k % 4 == 1, F.replace(text, F.lit('"format_version":"1"'), F.lit('"format_version":"9"'))).otherwise(text)
    files = a.select(F.when(k % 4 == 2, F.lit("other")).otherwise(F.col("annotation_id")).alias("name"), broken.alias("value"), k)
    return annotations.parse_files(files, ["c_custkey"]).select(F.col("c_custkey").alias("annotation_id"), "error")


@query("SELECT doc_id AS asset_id FROM documents d JOIN labels l USING (doc_id) WHERE doc_id % 10 <> 9 AND quality <> 0 AND n_chars <= 33554432 AND trim(text) <> '' AND doc_id % 4 <> 0")
def index_reuse(spark, d):
    """Assets that a change event names though their contents are as they were indexed: their postings stay."""
    items, assets = _index(spark, d)
    _, records = search.build(items, assets)
    now = assets.withColumn("content", F.when(F.col("asset_id") % 4 == 0, F.concat("content", F.lit(" new"))).otherwise(F.col("content")))
    return search.reusable(records, now).select("asset_id")


@query("SELECT 'ready' AS empty_library, 'degraded' AS with_issues, 'stale' AS other_analyzer, 'missing' AS none, count(*) FILTER (path NOT LIKE '%.pdf' OR status <> 'available' OR trim(content) = '') AS issues FROM assets", using=("assets",))
def index_states(spark, d):
    """What a search would be told in four situations, and how many assets are not indexed."""
    items, assets = _index(spark, d)
    _, records = search.build(items, assets)
    own = {"analyzer": search.ANALYZER_VERSION, "extractor": search.EXTRACTOR_VERSION}
    n = F.lit(None).cast("bigint")
    counted = search.issues(records).agg(F.count(F.lit(1)).alias("issues"))
    return counted.select(
        search.state_of(own, F.lit(0)).alias("empty_library"), search.state_of(own, F.col("issues")).alias("with_issues"), search.state_of({**own, "analyzer": "0"}, n).alias("other_analyzer"), search.state_of(None, n).alias("none"), "issues"
    )


# Trees and the store ---------------------------------------------------------------------------------


def _geo(spark, d) -> DataFrame:
    def part(t: str, node: Column, parent: Column, segment: Column, value: Column) -> DataFrame:
        return table(spark, d, t).select(node.alias("node"), parent.cast("string").alias("parent"), segment.alias("segment"), value.cast("string").alias("value"))

    none = F.lit(None)
    return (
        part("region", F.concat(F.lit("r"), "r_regionkey"), none, F.col("r_name"), none)
        .unionByName(part("nation", F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_name"), none))
        .unionByName(part("customer", F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("["), "c_custkey", F.lit("]")), F.sha2("c_name", 256)))
    )


GEO_SQL = """WITH p AS (SELECT '/' || r_name AS path, 0 AS level, CAST(NULL AS VARCHAR) AS value FROM region
UNION ALL SELECT '/' || r_name || '/' || n_name, 1, NULL FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT '/' || r_name || '/' || n_name || '[' || CAST(c_custkey AS VARCHAR) || ']', 2, sha256(c_name) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


@query(GEO_SQL + "SELECT path, CAST(level AS INTEGER) AS level FROM p")
def tree_paths(spark, d):
    return tree.paths(_geo(spark, d)).select("path", "level")


@query(GEO_SQL + "SELECT path, value FROM p WHERE value IS NOT NULL")
def tree_leaf_refs(spark, d):
    return tree.leaf_refs(tree.paths(_geo(spark, d)))


@query(GEO_SQL + "SELECT path, value FROM p WHERE value IS NOT NULL AND NOT starts_with(path, '/ASIA/') AND NOT starts_with(path, '/EUROPE/FRANCE[')")
def tree_prune(spark, d):
    return tree.prune(tree.leaf_refs(tree.paths(_geo(spark, d))), ["/ASIA", "/ASIA/CHINA", "/EUROPE/FRANCE"])[0]


def _leaves(spark, d, where: str, value: str) -> DataFrame:
    return table(spark, d, "orders").where(where).select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("path"), F.expr(value).alias("value"))


MERGE_SQL = """WITH de AS (SELECT '/o/' || CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus AS d FROM orders WHERE o_orderkey % 3 <> 0),
so AS (SELECT '/o/' || CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority AS s FROM orders WHERE o_orderkey % 2 = 0),
j AS (SELECT path, d, s FROM de FULL OUTER JOIN so USING (path))
"""
MERGES = {
    "overwrite": "SELECT path, s AS value FROM j WHERE s IS NOT NULL",
    "add": "SELECT path, coalesce(d, s) AS value FROM j",
    "modify": "SELECT path, coalesce(s, d) AS value FROM j WHERE d IS NOT NULL",
    "delete": "SELECT path, d AS value FROM j WHERE d IS NOT NULL AND s IS NOT NULL",
}


def _merge(short: str) -> None:
    query(MERGE_SQL + MERGES[short], f"tree_merge_{short}")(lambda spark, d: tree.merge(_leaves(spark, d, "o_orderkey % 3 <> 0", "o_orderstatus"), _leaves(spark, d, "o_orderkey % 2 = 0", "o_orderpriority"), tree.FLAGS[short]))


for _short in MERGES:
    _merge(_short)


@query("SELECT sha256('tb-blob' || chr(0) || html) AS address, count(*) AS n FROM (SELECT DISTINCT html FROM pages) GROUP BY 1")
def store_dedup(spark, d):
    payloads = table(spark, d, "pages").select(F.encode("html", "UTF-8").alias("payload"))
    empty = payloads.select(F.lit("").alias("address"), "payload").where("false")
    return store.put(empty, payloads).groupBy("address").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id FROM pages WHERE page_id % 10 <> 3 EXCEPT SELECT page_id FROM pages WHERE page_id % 10 IN (5, 6, 7, 8, 9)")
def store_gc(spark, d):
    """Blocks that no commit from the head down to sequence 5 refers to; commit n refers to the pages n mod 10, and 3 is off the chain."""
    pages = table(spark, d, "pages")
    commits = spark.range(10).select(F.col("id").alias("sequence"), F.when(F.col("id") > 0, F.col("id") - F.when(F.col("id") == 4, 2).otherwise(1)).alias("parent"))
    blocks = pages.where("page_id % 10 <> 3").select(F.col("page_id").cast("string").alias("address"), "html")
    refs = pages.select((F.col("page_id") % 10).alias("sequence"), F.col("page_id").cast("string").alias("address"))
    return store.garbage(blocks, refs, store.reachable_commits(commits, 9, 5)).select(F.col("address").cast("bigint").alias("page_id"))


@query(
    """SELECT '/p/' || CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 20 = 0 THEN 'dangling reference' WHEN page_id % 20 = 1 THEN 'changed bytes' ELSE 'reference without leaf' END AS problem FROM pages WHERE page_id % 20 IN (0, 1, 2)
UNION ALL SELECT '/q/' || CAST(page_id AS VARCHAR), 'leaf without reference' FROM pages WHERE page_id % 20 = 3"""
)
def store_verify(spark, d):
    p = table(spark, d, "pages").select("page_id", F.encode(F.concat_ws(":", "page_id", "html"), "UTF-8").alias("payload"))
    m = F.col("page_id") % 20
    path = F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("path")
    refs = p.select(path, F.col("page_id").cast("string").alias("ref_id"), store.address(F.col("payload")).alias("address"))
    blocks = p.where(m != 0).select(store.address(F.col("payload")).alias("address"), F.when(m == 1, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("payload")).alias("payload"))
    leaves = p.where(m != 2).select(path).unionByName(p.where(m == 3).select(F.concat(F.lit("/q/"), F.col("page_id").cast("string")).alias("path")))
    return store.verify(blocks, refs, leaves)


@query("SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS parent, 'nation' AS kind, count(*) AS n, CAST(1 AS BIGINT) AS least, CAST(4 AS BIGINT) AS most FROM nation GROUP BY n_regionkey HAVING count(*) > 4")
def cardinality_check(spark, d):
    nodes = _geo(spark, d).withColumn("kind", F.when(F.col("node").startswith("r"), "region").when(F.col("node").startswith("n"), "nation").otherwise("customer"))
    rules = spark.createDataFrame([("region", "nation", 1, 4), ("nation", "customer", 0, None)], "parent_kind string, kind string, least bigint, most bigint")
    return tree.cardinality(nodes, rules)


@query(
    """WITH s AS (SELECT date_trunc('month', l_shipdate) AS chunk, min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1)
SELECT CAST(year(chunk) * 100 + month(chunk) AS INTEGER) AS chunk FROM s WHERE last >= TIMESTAMP '1997-06-01' AND hi >= 50"""
)
def chunk_prune(spark, d):
    li = table(spark, d, "lineitem")
    stats = li.groupBy(F.date_trunc("month", "l_shipdate").alias("chunk")).agg(F.max("l_quantity").alias("hi"), F.max("l_shipdate").alias("last"))
    kept = tree.chunks_for(stats, (F.col("last") >= F.lit("1997-06-01").cast("timestamp")) & (F.col("hi") >= 50))
    return kept.select((F.year("chunk") * 100 + F.month("chunk")).cast("int").alias("chunk"))


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 DAY AND TIMESTAMP '2024-01-20 00:00:00'")
def cache_freshness(spark, d):
    return resolvers.fresh(table(spark, d, "events").withColumn("cached_at", F.col("ts").cast("timestamp")), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query(
    """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 50 = 0 THEN 'unknown parent' WHEN c_custkey % 50 = 1 THEN 'repeated node' ELSE 'repeated segment' END AS problem FROM customer WHERE c_custkey % 50 IN (0, 1, 2)"""
)
def tree_check(spark, d):
    """Planted among all customers: parents that are not there, nodes that are there twice, second nodes of a segment."""
    n = F.col("c_custkey")
    base = table(spark, d, "customer").select(n, F.concat(F.lit("c"), n).alias("node"), F.when(n % 50 == 0, F.concat(F.lit("gone"), n)).otherwise(F.lit("root")).alias("parent"), F.concat(F.lit("["), n, F.lit("]")).alias("segment"))
    again = base.where(n % 50 == 1).withColumn("segment", F.concat(F.lit("again"), n))
    second = base.where(n % 50 == 2).withColumn("node", F.concat(F.lit("d"), n))
    root = spark.createDataFrame([("root", None, "/")], "node string, parent string, segment string")
    parts = [x.select("node", "parent", "segment") for x in (base, again, second)]
    return tree.tree_problems(root.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])).select(F.col("node").alias("path"), "problem")


@query(
    """SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS link, CASE WHEN o_orderkey % 3 = 0 THEN 'source' ELSE 'target' END AS endpoint, 'n' || CAST(-o_orderkey AS VARCHAR) AS node FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'kind', 'c' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0"""
)
def endpoint_check(spark, d):
    """Links from customers to orders, some to nodes that are not there and some of a kind that may not begin there."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    customers = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit("customer").alias("kind"))
    nodes = customers.unionByName(o.select(F.concat(F.lit("o"), k).alias("node"), F.lit("order").alias("kind")))
    gone = F.concat(F.lit("n"), (-k).cast("string"))
    links = o.select(F.concat(F.lit("o"), k).alias("link"), F.when(k % 5 == 0, "audits").otherwise("places").alias("kind"), F.when(k % 3 == 0, gone).otherwise(F.concat(F.lit("c"), "o_custkey")).alias("source"), F.when(k % 3 == 2, gone).otherwise(F.concat(F.lit("o"), k)).alias("target"))
    rules = spark.createDataFrame([("places", "customer", "order"), ("audits", "clerk", "order")], "kind string, source_kind string, target_kind string")
    return tree.endpoint_problems(nodes, links, rules)


DIGEST_SQL = """WITH r AS (SELECT o_custkey, o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
n AS (SELECT h, row_number() OVER (ORDER BY o_custkey, o_orderkey, h) - 1 AS n FROM r),
b AS (SELECT n // 4096 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM n GROUP BY 1),
c AS (SELECT n // 4096 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM b GROUP BY 1)
SELECT CASE WHEN (SELECT count(*) FROM b) = 1 THEN (SELECT h FROM b) ELSE (SELECT h FROM c) END AS digest"""


@query(DIGEST_SQL)
def table_digest(spark, d):
    """One digest of a table in the order of two columns, however it is dealt out (the SQL: up to 16 million rows)."""
    return store.table_digest(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderkey"])


# Values, assets, displays ----------------------------------------------------------------------------


@query("SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey % 256, (c_custkey // 256) % 256, (c_custkey // 65536) % 256, c_custkey // 16777216) AS place FROM customer")
def value_order(spark, d):
    """Integers in the order of their stored bytes, least byte first; places by ranges of that order."""
    from .functions.values import order_key

    keyed = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), order_key(F.col("c_custkey"), "i64").alias(views.POS))
    return views.numbered(keyed).select("k", F.col(views.POS).cast("bigint").alias("place"))


@query(
    """SELECT asset_id, CASE WHEN asset_id % 13 = 0 THEN 'external' WHEN asset_id % 11 = 0 OR path LIKE '%.txt' THEN 'invalid' WHEN asset_id % 7 = 0 THEN 'missing' WHEN asset_id % 5 = 0 THEN 'unreadable' ELSE 'available' END AS status FROM assets""",
    using=("assets",),
)
def asset_status(spark, d):
    from .operators import assets as files_of

    a = view(spark, d, "assets").select("asset_id", F.when(F.col("asset_id") % 11 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), F.lit("application/pdf").alias("media_type"), F.when(F.col("asset_id") % 13 == 0, "external").otherwise("managed").alias("storage_kind"))
    listing = a.where("asset_id % 7 <> 0").select("path", (F.col("asset_id") % 5 != 0).alias("readable"), F.lit(True).alias("is_file"))
    return files_of.status(a, listing).select("asset_id", "status")


@query("SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.1f MB', n_chars / 1048576.0) WHEN n_chars >= 1024 THEN printf('%.1f KB', CAST(n_chars AS DOUBLE) / 1024) ELSE CAST(n_chars AS VARCHAR) || ' B' END AS shown FROM documents")
def display_size(spark, d):
    from .functions.display import size

    return table(spark, d, "documents").select("doc_id", size(F.col("n_chars")).alias("shown"))
