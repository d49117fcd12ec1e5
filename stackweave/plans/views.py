"""The view algebra: concat, select, join and registered functions over ordered tables.

A view is a small tree that becomes one plan.  Tables keep their order in ``__pos``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

POS = "__pos"
RESERVED = ("concat", "join", "select", "table")
_registered: dict[str, Callable[[list[DataFrame]], DataFrame]] = {}


class ViewError(ValueError):
    """A view that cannot be resolved."""


def register(name: str, function: Callable[[list[DataFrame]], DataFrame]) -> None:
    """Registers a function of any number of tables; names of the algebra and taken names are refused."""
    if name in RESERVED or name in _registered:
        raise ViewError(f"the name {name} is taken")
    _registered[name] = function


def unregister(name: str) -> None:
    _registered.pop(name, None)


@dataclass
class View:
    """kind: table, concat, select, join, or a registered name."""

    kind: str
    inputs: list[View] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def to_json(self) -> str:
        def plain(v: View) -> dict:
            return {"kind": v.kind, "inputs": [plain(i) for i in v.inputs], "params": v.params}

        return json.dumps(plain(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> View:
        def made(d: dict) -> View:
            v = cls(d["kind"], [made(i) for i in d["inputs"]], d["params"])
            v.check()
            return v

        return made(json.loads(text))

    def check(self) -> None:
        """Arity and parameters; unknown parameters are refused."""
        n = len(self.inputs)
        wanted = {"table": n == 0, "concat": n >= 1, "select": n == 1, "join": n == 2}.get(self.kind, n >= 1)
        known = {"table": {"name"}, "select": {"columns", "rows"}, "join": {"keys", "mode"}}.get(self.kind, set())
        if not wanted:
            raise ViewError(f"{self.kind} over {n} inputs")
        if set(self.params) - known:
            raise ViewError(f"unknown parameters: {sorted(set(self.params) - known)}")
        if self.kind == "join" and self.params.get("mode", "inner") not in ("inner", "left"):
            raise ViewError("joins are inner or left")

    def tables(self) -> list[str]:
        return [self.params["name"]] if self.kind == "table" else [t for i in self.inputs for t in i.tables()]


def table(name: str) -> View:
    return View("table", [], {"name": name})


def concat(*inputs: View) -> View:
    return View("concat", list(inputs))


def select(of: View, columns: list[str], rows: tuple[int, int] | None = None) -> View:
    return View("select", [of], {"columns": columns} | ({"rows": list(rows)} if rows else {}))


def join(left: View, right: View, keys: list[str], mode: str = "inner") -> View:
    return View("join", [left, right], {"keys": keys, "mode": mode})


def apply(name: str, *inputs: View) -> View:
    return View(name, list(inputs))


def with_order(df: DataFrame, *order: str) -> DataFrame:
    """Adds the position that views keep: a struct of the order's columns, compared as a whole."""
    return df.withColumn(POS, F.struct(*[F.col(c) for c in order]))


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POS]


def resolve(view: View, tables: dict[str, DataFrame]) -> DataFrame:
    """The plan of a view over ordered tables; its rows carry their order in ``__pos``."""
    view.check()
    if view.kind == "table":
        if view.params["name"] not in tables:
            raise ViewError(f"no table {view.params['name']}")
        return tables[view.params["name"]]
    inputs = [resolve(i, tables) for i in view.inputs]
    if view.kind == "concat":
        first = inputs[0]
        for other in inputs[1:]:
            if [(c, first.schema[c].dataType) for c in _columns(first)] != [(c, other.schema[c].dataType) for c in _columns(other)]:
                raise ViewError("concat needs equal schemas")
        if len({d.schema[POS].dataType.simpleString() for d in inputs}) > 1:  # orders of different shapes
            inputs = [numbered(d) for d in inputs]
        parts = [d.select(*_columns(d), F.struct(F.lit(i).alias("part"), F.col(POS).alias("at")).alias(POS)) for i, d in enumerate(inputs)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
    if view.kind == "select":
        df, names = inputs[0], view.params["columns"]
        if missing := [c for c in names if c not in _columns(df)]:
            raise ViewError(f"no columns {missing}")
        if "rows" in view.params:
            start, count = view.params["rows"]
            if start < 0 or count < 0:
                raise ViewError("rows out of range")
            picked = df.orderBy(POS).offset(start).limit(count)
            if count and df.orderBy(POS).offset(start + count - 1).limit(1).count() == 0 or not count and df.orderBy(POS).limit(start).count() < start:
                raise ViewError("rows out of range")
            df = picked
        return df.select(*names, POS)
    if view.kind == "join":
        left, right = inputs
        keys = view.params["keys"]
        for k in keys:
            if k not in _columns(left) or k not in _columns(right):
                raise ViewError(f"no key {k}")
            if left.schema[k].dataType != right.schema[k].dataType:
                raise ViewError(f"key {k} has two types")
        others = [c for c in _columns(right) if c not in keys]
        named = [F.col(c).alias(f"{c}_right" if c in _columns(left) else c) for c in others]
        r = right.select(*[F.col(k) for k in keys], *named, F.col(POS).alias("__right"))
        j = left.join(r, keys, view.params.get("mode", "inner"))
        new = [f"{c}_right" if c in _columns(left) else c for c in others]
        return j.select(*_columns(left), *new, F.struct(F.col(POS).alias("left"), F.col("__right").alias("right")).alias(POS))
    if view.kind not in _registered:
        raise ViewError(f"no function {view.kind}")
    return _registered[view.kind](inputs)


def numbered(df: DataFrame) -> DataFrame:
    """The order as row numbers from 1: counts of ordered ranges first, so that no task numbers all rows.

    The ranges are written once: their bounds are sampled, and a second sample would give
    others than those that were counted.
    """
    ranged = written(df.repartitionByRange(POS).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(POS)))
    return inside.join(F.broadcast(sizes.select("__part", "__before")), "__part").withColumn(POS, F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")


def rows(df: DataFrame) -> DataFrame:
    """A view's rows in their order, without the position."""
    return df.orderBy(POS).drop(POS)
