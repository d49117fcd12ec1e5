"""Ranking, searching and summarising sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text
from ..schemas import METRICS

RANKED = ("openalex_id", "display_name", "source_type", "country_code", "works_count", "cited_by_count", "h_index", "is_oa")
SEARCHED = ("openalex_id", "display_name", "source_type", "issn_l", "country_code", "works_count", "oa_works_count", "cited_by_count", "h_index", "is_oa", "is_in_doaj", "homepage_url", "apc_usd")


def metric(name: str) -> Column:
    """The column of a metric; the two ratios are null where there are no works.  Unknown names are refused."""
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    works = F.when(F.col("works_count") != 0, F.col("works_count"))
    if name == "citations_per_work":
        return F.col("cited_by_count") / works
    if name == "oa_rate":
        return F.col("oa_works_count") / works
    return F.col(name)


def overview(sources: DataFrame) -> DataFrame:
    """One row of totals; an empty table gives zeros."""

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0).cast("bigint"))

    return sources.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("source_type") == "journal").alias("journals"),
        F.count_if(F.col("source_type") == "conference").alias("conferences"),
        F.count_if("is_oa").alias("open_access"),
        total("works_count").alias("works"),
        total("cited_by_count").alias("citations"),
    )


def top_sources(sources: DataFrame, by: str, limit: int, source_type: str | None = "journal") -> DataFrame:
    """The ``limit`` first sources by a metric, largest first, nulls before them, ties by id.

    One TakeOrderedAndProject: every partition keeps ``limit`` rows, nothing is shuffled.
    """
    rows = sources if source_type is None else sources.where(F.col("source_type") == source_type)
    return rows.select(*RANKED, metric(by).alias("metric_value")).orderBy(F.desc_nulls_first("metric_value"), "openalex_id").limit(limit)


def search_sources(sources: DataFrame, text: str = "", source_type: str | None = None, country: str | None = None, is_oa: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Sources by name and properties, in the order of their ids, one page."""
    rows = sources
    if source_type is not None:
        rows = rows.where(F.col("source_type") == source_type)
    if country is not None:
        rows = rows.where(F.col("country_code") == country.upper())
    if is_oa is not None:
        rows = rows.where(F.col("is_oa") == is_oa)
    if (named := contains_text(F.col("display_name"), text)) is not None:
        rows = rows.where(named)
    return rows.select(*SEARCHED).orderBy("openalex_id").offset(offset).limit(limit)


def import_projection(raw: DataFrame) -> DataFrame:
    """The columns of the source table from raw rows with a ``summary_stats`` struct."""
    s = F.col("summary_stats")
    stats = {"mean_citedness_2yr": s["2yr_mean_citedness"], "h_index": s["h_index"], "i10_index": s["i10_index"]}
    renamed = {"openalex_id": "id", "source_type": "type", "openalex_updated_at": "updated_date", "openalex_created_at": "created_date"}
    plain = ["display_name", "issn_l", "works_count", "oa_works_count", "cited_by_count", "is_oa", "is_in_doaj", "is_high_oa_rate", "is_in_scielo", "is_ojs", "is_core", "first_publication_year", "last_publication_year", "homepage_url", "apc_usd", "country_code"]
    from pyspark.sql.types import StructType

    from ..schemas import SOURCES_DDL

    columns = {**{new: F.col(old) for new, old in renamed.items() if old in raw.columns}, **stats, **{c: F.col(c) for c in plain if c in raw.columns}}
    fields = StructType.fromDDL(SOURCES_DDL).fields
    return raw.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def page(rows: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """Page ``number`` from 1 of rows in an order; pages before the first are the first."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def chart(ranking: DataFrame, n: int = 10) -> DataFrame:
    """(name, value) of the first rows of a ranking."""
    return ranking.orderBy(F.desc_nulls_first("metric_value"), "openalex_id").limit(n).select(F.col("display_name").alias("name"), F.col("metric_value").alias("value"))
