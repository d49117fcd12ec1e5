"""Bibliographic records from BibTeX, RIS and works JSON.

A file is one row of text; parsing a file is a Python table function over Arrow batches,
and whatever can be said with columns (works JSON) is.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.text import abstract_text
from ..schemas import SOURCE_RECORD

FORMATS = {"bibtex": "BibTeX", "ris": "Ris", "openalexworks": "OpenAlexWorks"}


def import_format(name: str) -> str:
    """A format by its name, in any case."""
    key = name.replace("_", "").replace("-", "").lower()
    if key not in FORMATS:
        raise ValueError(f"unknown import format: {name}")
    return FORMATS[key]


def _record(source: str, **values) -> dict:
    blank = {"external_id": None, "external_identifiers": [], "title": "", "authors": [], "published_year": None, "item_type": "other", "abstract_text": "", "keywords": [], "pages": "", "volume": "", "raw_fields": {}}
    raw = values.get("raw_fields", {})
    return {"record_id": str(uuid.uuid5(uuid.NAMESPACE_OID, f"{source}|{sorted(raw.items())}|{values.get('external_id')}")), "source_name": source, **blank, **values}


# BibTeX: entries @type{key, name = value, ...} with values in braces, quotes or digits
_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*\{")
_NAME = re.compile(r"[\s,]*([A-Za-z][\w-]*)\s*=\s*")


def _braced(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i + 1
    raise ValueError("BibTeX: a brace is not closed")


def _value(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] == "{":
        end = _braced(text, at)
        return text[at + 1 : end - 1].strip(), end
    if text[at : at + 1] == '"':
        end = text.find('"', at + 1)
        if end < 0:
            raise ValueError("BibTeX: a quote is not closed")
        return text[at + 1 : end].strip(), end + 1
    m = re.compile(r"[0-9]+").match(text, at)
    if not m:
        raise ValueError("BibTeX: a value is neither braced, quoted nor a number")
    return m.group(), m.end()


def parse_bibtex(text: str) -> list[dict]:
    out, at = [], 0
    while m := _ENTRY.search(text, at):
        end = _braced(text, m.end() - 1)
        at = end
        if m[1].lower() == "comment":
            continue
        key, _, body = text[m.end() : end - 1].partition(",")
        fields, i = {}, 0
        while n := _NAME.match(body, i):
            fields[n[1].lower()], i = _value(body, n.end())
        if body[i:].strip(" \t\r\n,"):
            raise ValueError(f"BibTeX: cannot read {body[i : i + 20]!r}")
        kind = ids.ITEM_TYPES["bibtex"].get(m[1].lower(), "other")
        year = fields.get("year", "")
        out.append(
            _record(
                "BibTeX",
                external_id=key.strip() or None,
                external_identifiers=[{"namespace": n, "value": fields[n]} for n in ("doi", "isbn", "pmid", "url") if fields.get(n)],
                title=fields.get("title", ""),
                authors=[a.strip() for a in fields.get("author", "").split(" and ") if a.strip()],
                published_year=int(year) if re.fullmatch(r"[+-]?[0-9]{1,9}", year) else None,
                item_type=kind,
                abstract_text=fields.get("abstract", ""),
                keywords=[k.strip() for k in re.split("[,;]", fields.get("keywords", "")) if k.strip()],
                pages=fields.get("pages", ""),
                volume=fields.get("volume", ""),
                raw_fields=fields,
            )
        )
    if not out and text.strip():
        raise ValueError("BibTeX: no entry found")
    return out


_TAG = re.compile(r"([A-Za-z0-9]{2})  -[ \t]*(.*)")
_LISTS = {"au": "authors", "a1": "authors", "a2": "authors", "a3": "authors", "kw": "keywords"}


def parse_ris(text: str) -> list[dict]:
    """TY opens a record and ER closes it; other lines go on with the tag before; the last value of a tag stands."""
    out: list[dict] = []
    kind = None
    fields: dict[str, str] = {}
    lists: dict[str, list[str]] = {"authors": [], "keywords": []}
    last = ""

    def first(*names: str) -> str | None:
        return next((fields[n] for n in names if fields.get(n)), None)

    def close() -> None:
        nonlocal kind
        if kind is not None:
            if not kind:
                raise ValueError("RIS: a record has no type")
            item_type = ids.ITEM_TYPES["ris"].get(kind.upper(), "other")
            found = [{"namespace": n, "value": v} for n, v in (("doi", first("do", "doi")), ("issn" if item_type == "article" else "isbn", first("sn"))) if v]
            title, year = first("ti", "t1", "ct") or "", "".join(c for c in first("py", "y1") or "" if c.isdigit())[:4]
            out.append(
                _record(
                    "RIS",
                    external_id=found[0]["value"] if found else title or None,
                    external_identifiers=found,
                    title=title,
                    authors=lists["authors"],
                    published_year=int(year) if len(year) == 4 else None,
                    item_type=item_type,
                    abstract_text=first("ab") or "",
                    keywords=lists["keywords"],
                    pages="-".join(p for p in (first("sp"), first("ep")) if p),
                    volume=first("vl") or "",
                    raw_fields=dict(fields),
                )
            )
        kind = None

    for line in text.splitlines():
        m = _TAG.fullmatch(line)
        if m and m[1].upper() == "TY":
            close()
            kind, fields, lists, last = m[2].strip(), {}, {"authors": [], "keywords": []}, ""
        elif m and m[1].upper() == "ER":
            close()
        elif kind is not None and m:
            last, value = m[1].lower(), m[2].strip()
            fields[last] = value
            if value and last in _LISTS:
                lists[_LISTS[last]].append(value)
        elif kind is not None and last and line.strip():
            more = line.strip()
            fields[last] = f"{fields[last]} {more}".strip()
            own = lists[_LISTS[last]] if last in _LISTS else []
            if own:
                own[-1] = f"{own[-1]} {more}"
    close()
    if not out and text.strip():
        raise ValueError("RIS: no record found")
    return out


def _arrow_schema():
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(SOURCE_RECORD)


def parse_files(files: DataFrame, format_: str, text_col: str = "value") -> DataFrame:
    """Records of files (one text a row) in BibTeX or RIS."""
    parse = {"BibTeX": parse_bibtex, "Ris": parse_ris}[import_format(format_)]
    schema = _arrow_schema()

    def run(batches):
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() for r in parse(t or "")]
            yield pa.RecordBatch.from_pylist([{**r, "raw_fields": list(r["raw_fields"].items())} for r in rows], schema)

    return files.select(F.col(text_col).cast("string")).mapInArrow(run, SOURCE_RECORD)


# The parts of a work that have a column of their own.
WORK_DDL = "id string, doi string, title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, type string, host_venue struct<issn_l:string,issn:string>, primary_location struct<source:struct<issn_l:string,issn:array<string>>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, abstract_inverted_index map<string,array<int>>, keywords array<string>"
WORK_PARTS = ("id", "doi", "title", "authorships", "publication_year", "type", "host_venue", "primary_location", "biblio", "abstract_inverted_index", "keywords")


def works_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of works, one JSON object a row; blank rows are skipped, bad ones fail the scan."""
    rows = lines.where(F.trim(column) != "").select(F.trim(column).alias("j"))
    w = rows.select("j", F.from_json("j", WORK_DDL, {"mode": "FAILFAST"}).alias("w"), F.from_json("j", "map<string,string>").alias("raw"))
    openalex = ids.last_segment(F.col("w.id"))
    doi = ids.doi(F.col("w.doi"))
    issn = F.coalesce(F.col("w.host_venue.issn_l"), F.col("w.primary_location.source.issn_l"), F.get(F.col("w.primary_location.source.issn"), F.lit(0)))

    def identifier(namespace: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(namespace).alias("namespace"), value.alias("value")))

    keyword = F.transform("w.keywords", lambda k: F.coalesce(F.get_json_object(k, "$.keyword"), F.get_json_object(k, "$.name"), F.when(~k.startswith("{"), k)))
    return w.select(
        F.md5("j").alias("record_id"),
        F.lit("OpenAlex").alias("source_name"),
        openalex.alias("external_id"),
        F.array_compact(F.array(identifier("openalex", openalex), identifier("doi", doi), identifier("issn", issn))).alias("external_identifiers"),
        F.coalesce("w.title", F.lit("")).alias("title"),
        F.coalesce(F.array_compact(F.transform("w.authorships", lambda a: a["author"]["display_name"])), F.array().cast("array<string>")).alias("authors"),
        F.col("w.publication_year").alias("published_year"),
        ids.item_type(F.coalesce("w.type", F.lit("")), "works").alias("item_type"),
        abstract_text(F.col("w.abstract_inverted_index")).alias("abstract_text"),
        F.coalesce(F.array_compact(keyword), F.array().cast("array<string>")).alias("keywords"),
        ids.page_range(F.col("w.biblio.first_page"), F.col("w.biblio.last_page")).alias("pages"),
        F.coalesce("w.biblio.volume", F.lit("")).alias("volume"),
        F.map_filter("raw", lambda k, _: ~k.isin(*WORK_PARTS)).alias("raw_fields"),
    )


def read_works(spark: SparkSession, folder: str) -> DataFrame:
    """All works of a folder's ``.jsonl`` and ``.gz`` files, however deep."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    return works_from_json(lines.where(F.input_file_name().rlike(r"\.(jsonl|gz)$")))


def search_works(records: DataFrame, query: str, limit: int) -> DataFrame:
    """Records with the query in their title or an identifier, case-insensitive; nothing for a blank query."""
    if not query.strip() or limit <= 0:
        return records.limit(0)
    q = query.lower()
    hit = F.lower("title").contains(q) | F.lower("external_id").contains(q) | F.exists("external_identifiers", lambda i: F.lower(i["value"]).contains(q))
    return records.where(F.coalesce(hit, F.lit(False))).limit(limit)


def doi_index(records: DataFrame, order: str = "record_id") -> DataFrame:
    """doi -> record, the last in order if several have it."""
    pairs = records.select(F.explode("external_identifiers").alias("i"), F.struct(F.col(order).alias("o"), F.struct("*").alias("r")).alias("best")).where("i.namespace = 'doi'")
    return pairs.groupBy(F.lower("i.value").alias("doi")).agg(F.max_by("best.r", "best.o").alias("record"))
