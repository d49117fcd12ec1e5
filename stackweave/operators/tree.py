"""Trees as adjacency rows: paths, leaf references, scoped merges, pruning.

A tree is rows (node, parent, segment, value): roots have a null parent; segments are
names or positions.  Paths are ``/a/b[3]``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

FLAGS = {"overwrite": None, "add": {"add"}, "modify": {"modify"}, "delete": {"delete"}}
SEGMENT = re.compile(r"/([A-Za-z0-9_.-]+)|\[([0-9]+)\]")


def parse_path(path: str) -> list[str | int]:
    """``/a/b[3]`` as names and positions; anything else is refused."""
    out, at = [], 0
    while at < len(path):
        m = SEGMENT.match(path, at)
        if not m:
            raise ValueError(f"not a path: {path}")
        out.append(m[1] if m[1] is not None else int(m[2]))
        at = m.end()
    if not out:
        raise ValueError("an empty path")
    return out


def show_path(parts: list[str | int]) -> str:
    return "".join(f"[{p}]" if isinstance(p, int) else f"/{p}" for p in parts)


def canonical(parts: list[str | int]) -> bytes:
    """The bytes that order and prefix-test paths: a tag, a length or number of 8 bytes, the name."""
    return b"".join(b"I" + p.to_bytes(8, "little") if isinstance(p, int) else b"F" + len(p.encode()).to_bytes(8, "little") + p.encode() for p in parts)


def paths(nodes: DataFrame, depth: int = 100) -> DataFrame:
    """Rows with their ``path`` and ``level``: a join for each level until one has no rows.

    Levels are written, so that each is made once, from the one above it.
    """
    level = nodes.where(F.col("parent").isNull()).withColumn("path", F.concat(F.lit("/"), F.col("segment"))).withColumn("level", F.lit(0))
    out = level = written(level)
    for n in range(1, depth + 1):
        above = level.select(F.col("node").alias("__p"), F.col("path").alias("__path"))
        level = nodes.join(above, F.col("parent") == F.col("__p")).withColumn("path", F.concat("__path", F.when(F.col("segment").rlike(r"^\["), F.col("segment")).otherwise(F.concat(F.lit("/"), F.col("segment"))))).withColumn("level", F.lit(n)).select(*out.columns)
        level = written(level)
        if level.limit(1).count() == 0:
            return out
        out = out.unionByName(level)
    raise ValueError("the tree is deeper than allowed, or has a cycle")


def leaf_refs(pathed: DataFrame) -> DataFrame:
    """(path, value) of the leaves, each once."""
    return pathed.join(pathed.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti").where("value is not null").select("path", "value").distinct()


def tree_problems(nodes: DataFrame) -> DataFrame:
    """Rows that break a tree: unknown parents, repeated nodes, repeated segments of one parent."""
    unknown = nodes.where("parent is not null").join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", F.lit("unknown parent").alias("problem"))
    twice = nodes.groupBy("node").count().where("count > 1").select("node", F.lit("repeated node").alias("problem"))
    same = nodes.groupBy("parent", "segment").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", F.lit("repeated segment").alias("problem"))
    return unknown.unionByName(twice).unionByName(same)


def in_scope(path: Column, fragments: list[str] | None) -> Column:
    """True within the given fragments, whole segments; no fragments at all means everywhere."""
    if fragments is None:
        return F.lit(True)
    out = F.lit(False)
    for f in fragments:
        out = out | (path == f) | path.startswith(f + "/") | path.startswith(f + "[")
    return out


def merge(destination: DataFrame, source: DataFrame, flags: set[str] | None, fragments: list[str] | None = None) -> DataFrame:
    """Leaves (path, value) after a merge: one full join on the path.

    Without flags the source replaces what is in scope; else it adds, modifies and deletes
    as they say.  Out of scope the destination stays.
    """
    flags = {"add", "modify", "delete"} if flags is None else flags
    j = destination.select("path", F.col("value").alias("d"), F.lit(True).alias("in_d")).join(source.select("path", F.col("value").alias("s"), F.lit(True).alias("in_s")), "path", "full_outer")
    scope = in_scope(F.col("path"), fragments)
    has_d, has_s = F.col("in_d").isNotNull(), F.col("in_s").isNotNull()
    keep = F.when(~scope, has_d).when(has_d & has_s, F.lit(True)).when(has_s, F.lit("add" in flags)).otherwise(F.lit("delete" not in flags))
    value = F.when(scope & has_s & (~has_d | F.lit("modify" in flags)), F.col("s")).otherwise(F.col("d"))
    return j.where(keep).select("path", value.alias("value"))


def prune(leaves: DataFrame, prefixes: list[str]) -> tuple[DataFrame, list[str]]:
    """(leaves outside the prefixes, the longest subtrees that went)."""
    top = [p for p in sorted(set(prefixes)) if not any(p != q and (p.startswith(q + "/") or p.startswith(q + "[")) for q in prefixes)]
    return (leaves.where(~in_scope(F.col("path"), top)), top)


def rename_subtree(leaves: DataFrame, old: str, new: str) -> DataFrame:
    """Leaves with a subtree under another path; a path that is then there twice is an error at run time."""
    moved = F.when(in_scope(F.col("path"), [old]), F.concat(F.lit(new), F.substring("path", F.lit(len(old) + 1), F.length("path")))).otherwise(F.col("path"))
    out = leaves.withColumn("path", moved)
    twice = out.groupBy("path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} is there already")
    return out


def get(pathed: DataFrame, path: str) -> DataFrame:
    return pathed.where(F.col("path") == path)


def longest_reachable(pathed: DataFrame, path: str) -> DataFrame:
    """The deepest row on the way to a path, and the rest of the way."""
    on_way = F.lit(path).startswith(F.concat(F.col("path"), F.lit("/"))) | F.lit(path).startswith(F.concat(F.col("path"), F.lit("["))) | (F.col("path") == path)
    return pathed.where(on_way).orderBy(F.desc(F.length("path"))).limit(1).withColumn("rest", F.substring(F.lit(path), F.length("path") + 1, F.lit(len(path))))


def cardinality(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Children counts outside their definition (parent_kind, kind, least, most); ``most`` null is no bound.

    ``nodes`` is (node, parent, kind).
    """
    parents = nodes.select(F.col("node").alias("parent"), F.col("kind").alias("parent_kind")).join(F.broadcast(definitions), "parent_kind")
    counts = nodes.where("parent is not null").groupBy("parent", "kind").count()
    j = parents.join(counts, ["parent", "kind"], "left").withColumn("n", F.coalesce("count", F.lit(0).cast("bigint")))
    return j.where((F.col("n") < F.col("least")) | (F.col("n") > F.col("most"))).select("parent", "kind", "n", "least", "most")


def endpoint_problems(nodes: DataFrame, links: DataFrame, rules: DataFrame) -> DataFrame:
    """(link, endpoint, node): ends of links (link, kind, source, target) that are no node, or ``kind`` where the ends' kinds break the rule.

    ``nodes`` is (node, kind) with distinct nodes, ``rules`` (kind, source_kind, target_kind);
    a kind without a rule may link anything.  Kinds are compared where both ends are there,
    and the source is named.
    """
    ends = links
    for end in ("source", "target"):
        ends = ends.join(nodes.select(F.col("node").alias(end), F.col("kind").alias(f"{end}_is")), end, "left")
    ends = ends.join(F.broadcast(rules), "kind", "left")
    broken = (F.col("source_is") != F.col("source_kind")) | (F.col("target_is") != F.col("target_kind"))
    checks = [(F.col(f"{e}_is").isNull(), e, F.col(e)) for e in ("source", "target")] + [(broken, "kind", F.col("source"))]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(e).alias("endpoint"), n.alias("node"))) for c, e, n in checks]))
    return ends.select("link", F.explode(found).alias("p")).select("link", "p.endpoint", "p.node")


def chunks_for(stats: DataFrame, predicate: Column) -> DataFrame:
    """Chunks whose statistics do not rule a predicate out; their payloads are not opened."""
    return stats.where(predicate)
