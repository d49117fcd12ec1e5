"""Identifiers, item types, years and names of bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier kinds that match records to items, and item types by their source names.
MATCHING = ("doi", "isbn", "issn", "pmid", "openalex")
ITEM_TYPES = {
    "bibtex": {"article": "article", "inproceedings": "article", "conference": "article", "book": "book", "inbook": "chapter", "incollection": "chapter", "chapter": "chapter"},
    "ris": {"JOUR": "article", "JFULL": "article", "MGZN": "article", "CONF": "article", "CPAPER": "article", "BOOK": "book", "CHAP": "chapter"},
    "works": {"article": "article", "book": "book", "chapter": "chapter"},
}


def _upper_ascii(x: Column) -> Column:
    return F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def openalex_id(x: Column) -> Column:
    """``W`` and digits, also from an address, and from bare digits; null for anything else."""
    rest = F.trim(F.regexp_replace(_upper_ascii(F.trim(x)), r"^(?:W)?(?:HTTPS://OPENALEX\.ORG/)?(?:HTTP://OPENALEX\.ORG/)?", ""))
    return F.when(rest.rlike(r"^W?[0-9]+$"), F.concat(F.lit("W"), F.regexp_replace(rest, "^W", "")))


def doi(x: Column) -> Column:
    """Anything with a slash, in lower case and without the usual prefixes."""
    rest = F.trim(F.regexp_replace(_lower_ascii(F.trim(x)), r"^(?:doi:)?(?:https://doi\.org/)?(?:http://doi\.org/)?", ""))
    return F.when(rest.contains("/"), rest)


def pmid(x: Column) -> Column:
    rest = F.trim(F.replace(_lower_ascii(F.trim(x)), F.lit("pmid:"), F.lit("")))
    return F.when(rest.rlike("^[0-9]+$"), rest)


def pmcid(x: Column) -> Column:
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(_lower_ascii(F.trim(x)), "^(?:pmcid:)?(?:pmc:)?", "")), "^pmc", ""))
    return F.when(rest.rlike("^[0-9]+$"), rest)


def isbn(x: Column) -> Column:
    """The digits and X of ten or thirteen places."""
    rest = F.regexp_replace(_upper_ascii(x), "[^0-9X]", "")
    return F.when(F.length(rest).isin(10, 13), rest)


def guess(x: Column) -> Column:
    """The kind a person most likely entered: doi, pmid, pmcid, or null.

    Unlike ``classify``, bare digits are a PubMed id, and only the prefix tells a PMC id.
    """
    entered = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(entered.rlike("^doi:|/"), "doi").when(entered.rlike(r"^pmid:|^[0-9]+\z"), "pmid").when(entered.rlike("^pmc(id)?:"), "pmcid")


def classify(x: Column) -> Column:
    """(namespace, value) of the first kind that fits, in the order openalex, doi, pmid, pmcid, isbn; null if none."""
    kinds = {"openalex": openalex_id(x), "doi": doi(x), "pmid": pmid(x), "pmcid": pmcid(x), "isbn": isbn(x)}
    out = F.lit(None).cast("struct<namespace:string,value:string>")
    for name, value in reversed(kinds.items()):
        out = F.when(value.isNotNull(), F.struct(F.lit(name).alias("namespace"), value.alias("value"))).otherwise(out)
    return out


def last_segment(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def item_type(x: Column, source: str) -> Column:
    """The item type that a source's name for it stands for; ``other`` if it has none."""
    out = F.lit("other")
    for name, kind in ITEM_TYPES[source].items():
        out = F.when(x == name, kind).otherwise(out)
    return out


def year_in(x: Column) -> Column:
    """The first four digits anywhere, as a year."""
    return F.substring(F.regexp_replace(x, r"[^0-9]", ""), 1, 4).try_cast("int")


def page_range(first: Column, last: Column) -> Column:
    return F.coalesce(F.concat_ws("-", first, last), F.lit(""))


def authors_and(x: Column) -> Column:
    """Names between ``and``."""
    return F.filter(F.transform(F.split(x, " and "), F.trim), lambda n: n != "")


def family_given(family: Column, given: Column) -> Column:
    return F.concat_ws(", ", family, given)
