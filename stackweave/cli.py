"""Command line: ``python -m stackweave.cli vault PATH | rank PATH METRIC | search PATH TEXT | items FILE``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import library, sessions
from .schemas import LITERATURE_ITEM, METRICS, SESSION_DDL
from .sources.sinks import export, json_rows
from .sources.vault import Vault


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="stackweave")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("vault").add_argument("path")
    rank = sub.add_parser("rank")
    rank.add_argument("path")
    rank.add_argument("metric", choices=METRICS)
    rank.add_argument("--type", default="journal")
    rank.add_argument("--limit", type=int, default=30)
    rank.add_argument("--export")
    search = sub.add_parser("search")
    search.add_argument("path")
    search.add_argument("text")
    search.add_argument("--country")
    search.add_argument("--limit", type=int, default=100)
    search.add_argument("--offset", type=int, default=0)
    items = sub.add_parser("items")
    items.add_argument("path")
    items.add_argument("--keyword", default="")
    items.add_argument("--status")
    items.add_argument("--limit", type=int, default=50)
    reading = sub.add_parser("sessions")
    reading.add_argument("path")
    reading.add_argument("--limit", type=int, default=20)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "vault":
        print(json.dumps(Vault.open_any(spark, a.path).manifest, default=str))
        return 0
    if a.command == "rank":
        rows = Vault.open_any(spark, a.path).top_sources(a.metric, a.limit, a.type or None)
        if a.export:
            print(json.dumps({"rows": export(rows, a.export), "path": a.export}))
            return 0
    elif a.command == "search":
        rows = Vault.open_any(spark, a.path).search_sources(text=a.text, country=a.country, limit=a.limit, offset=a.offset)
    elif a.command == "items":
        rows = library.list_items(spark.read.schema(LITERATURE_ITEM).json(a.path, multiLine=True), a.keyword, a.status, a.limit)
    else:
        rows = sessions.recent(spark.read.schema(SESSION_DDL).json(a.path, multiLine=True), a.limit)
    for r in json_rows(rows).collect():
        print(r[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
