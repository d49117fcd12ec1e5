"""Schema conversions: a list of rules, checked before they are applied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

_functions: dict[str, Callable[[Column], Column]] = {}


class TransformError(ValueError):
    """A plan that cannot be executed."""


@dataclass(frozen=True)
class Rename:
    old: str
    new: str


@dataclass(frozen=True)
class Drop:
    column: str


@dataclass(frozen=True)
class Convert:
    column: str
    to: DataType


@dataclass(frozen=True)
class Fill:
    """Replaces every value of a column; the value takes the column's type."""

    column: str
    value: object


@dataclass(frozen=True)
class Map:
    """Applies a registered function to a column of a declared type."""

    function: str
    column: str
    kind: DataType
    out: str | None = None


@dataclass(frozen=True)
class Move:
    old: str
    new: str


Rule = Rename | Drop | Convert | Fill | Map | Move


def register(name: str, function: Callable[[Column], Column]) -> None:
    """Registers a column function; a name that is taken gets the new one."""
    _functions[name] = function


def _named(rule: Rule) -> str | None:
    return rule.old if isinstance(rule, Rename) else None if isinstance(rule, Move) else rule.column


def uncovered(rules: list[Rule], schema: StructType) -> list[Rule]:
    """Rules that name no column of the input schema."""
    return [r for r in rules if (n := _named(r)) is not None and n not in schema.names]


def dry_run(rules: list[Rule], schema: StructType) -> None:
    """Raises if a rule has no column, or a column is renamed twice."""
    if missing := uncovered(rules, schema):
        raise TransformError(f"not executable: {missing}")
    renamed = [r.old for r in rules if isinstance(r, Rename)]
    if len(set(renamed)) < len(renamed):
        raise TransformError("a column is renamed twice")


def apply(rules: list[Rule], df: DataFrame) -> DataFrame:
    """The rules in order; all become one projection."""
    dry_run(rules, df.schema)
    for r in rules:
        if isinstance(r, Move):
            continue
        if _named(r) not in df.columns:
            raise TransformError(f"no column {_named(r)} any more")
        if isinstance(r, Rename):
            df = df.withColumnRenamed(r.old, r.new)
        elif isinstance(r, Drop):
            df = df.drop(r.column)
        elif isinstance(r, Convert):
            df = df.withColumn(r.column, F.col(r.column).cast(r.to))
        elif isinstance(r, Fill):
            df = df.withColumn(r.column, F.lit(r.value).cast(df.schema[r.column].dataType))
        else:
            if r.function not in _functions:
                raise TransformError(f"no function {r.function}")
            if df.schema[r.column].dataType != r.kind:
                raise TransformError(f"{r.column} is not of type {r.kind}")
            df = df.withColumn(r.column, _functions[r.function](F.col(r.column)))
            df = df.withColumnRenamed(r.column, r.out) if r.out else df
    return df


def moved(rules: list[Rule], path: str) -> str:
    """A path after the first move, whole segments only."""
    for r in rules:
        if isinstance(r, Move):
            return r.new + path[len(r.old) :] if path == r.old or path.startswith(r.old + "/") else path
    return path


def moved_column(rules: list[Rule], path: Column) -> Column:
    for r in rules:
        if isinstance(r, Move):
            return F.when((path == r.old) | path.startswith(r.old + "/"), F.concat(F.lit(r.new), F.substring(path, F.lit(len(r.old) + 1), F.length(path)))).otherwise(path)
    return path
