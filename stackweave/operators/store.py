"""The content-addressed store: blobs, reference tables, commits, verification, cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.views import POS, numbered
from ..sources.shared import written

#: Hashes that make one of the next level of a table's digest.
FOLD = 4096


def address(payload: Column) -> Column:
    """A payload's address: SHA-256 under the store's domain."""
    return F.sha2(F.concat(F.encode(F.lit("tb-blob"), "UTF-8"), F.unhex(F.lit("00")), payload), 256)


def magic(payload: Column) -> Column:
    """arrow, parquet or raw, by a payload's first bytes."""
    return F.when(F.substring(payload, 1, 6) == F.encode(F.lit("ARROW1"), "UTF-8"), "arrow").when(F.substring(payload, 1, 4) == F.encode(F.lit("PAR1"), "UTF-8"), "parquet").otherwise("raw")


def put(blocks: DataFrame, payloads: DataFrame) -> DataFrame:
    """Blocks (address, payload) with new payloads; what is there already is not written again."""
    fresh = payloads.select(address(F.col("payload")).alias("address"), "payload").dropDuplicates(["address"])
    return blocks.unionByName(fresh.join(blocks.select("address"), "address", "left_anti"))


def reachable_commits(commits: DataFrame, head: int, keep_from: int) -> DataFrame:
    """Sequences from the head along the parents down to ``keep_from``.

    Each round doubles the length of the jumps, so a chain of n commits takes log n rounds;
    a round's tables are written, so plans stay short.
    """
    links = commits.where(F.col("sequence") >= keep_from).select(F.col("sequence").alias("at"), F.col("parent").alias("jump"))
    jumps = written(links.where(F.col("jump") >= keep_from))
    reach = written(links.where(F.col("at") == head).select("at"))
    n = reach.count()
    while True:
        reach = written(reach.unionByName(reach.join(jumps, "at").select(F.col("jump").alias("at"))).distinct())
        if (now := reach.count()) == n:
            return reach.select(F.col("at").alias("sequence"))
        n = now
        # all jumps of up to this length are taken, so the next are twice as long
        jumps = written(jumps.alias("x").join(jumps.alias("y"), F.col("x.jump") == F.col("y.at")).select(F.col("x.at").alias("at"), F.col("y.jump").alias("jump")))


def garbage(blocks: DataFrame, refs: DataFrame, live: DataFrame) -> DataFrame:
    """Blocks that no live commit refers to; ``refs`` is (sequence, address)."""
    return blocks.join(refs.join(live, "sequence", "left_semi").select("address").distinct(), "address", "left_anti")


def verify(blocks: DataFrame, refs: DataFrame, leaves: DataFrame) -> DataFrame:
    """What is wrong with a reference table (path, ref_id, address): missing blocks, changed bytes, leaves without a reference and references without a leaf."""
    j = refs.join(blocks, "address", "left")
    missing = j.where("payload is null").select("path", F.lit("dangling reference").alias("problem"))
    changed = j.where(F.col("payload").isNotNull() & (address(F.col("payload")) != F.col("address"))).select("path", F.lit("changed bytes").alias("problem"))
    no_ref = leaves.select("path").join(refs.select("path"), "path", "left_anti").select("path", F.lit("leaf without reference").alias("problem"))
    no_leaf = refs.select("path").join(leaves.select("path"), "path", "left_anti").select("path", F.lit("reference without leaf").alias("problem"))
    return missing.unionByName(changed).unionByName(no_ref).unionByName(no_leaf)


def formats(refs: DataFrame, versions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each reference's disk format: as its version row says, else by its first bytes."""
    j = refs.join(versions.select("path", "disk_version"), "path", "left").join(blocks, "address", "left")
    return j.select("path", F.coalesce("disk_version", magic(F.col("payload"))).alias("format"))


def table_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """One digest of a table's rows in the order of ``order`` (then of their own hashes), however they are dealt out.

    Rows are hashed where they are and numbered; ``FOLD`` consecutive hashes make one of the
    next level, until one is left.  No task holds more than that, equal rows or not.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    level = numbered(df.select(F.struct(*order, row.alias("h")).alias(POS), row.alias("h"))).select((F.col(POS) - 1).alias("n"), "h")
    while True:
        folded = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ""), 256)
        level = written(level.groupBy(F.floor(F.col("n") / FOLD).alias("n")).agg(folded.alias("h")))
        if level.count() <= 1:
            # of no rows: the digest of nothing
            return level.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def union_first(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, our own where both have one."""
    return own.unionByName(other.join(own.select(key), key, "left_anti").dropDuplicates([key]))


def next_commit(commits: DataFrame, row: dict) -> DataFrame:
    """Commits with one more; its sequence must be larger than all."""
    top = commits.agg(F.max("sequence")).first()[0]
    if top is not None and row["sequence"] <= top:
        raise ValueError("the sequence must grow")
    return commits.unionByName(commits.sparkSession.createDataFrame([row], commits.schema))


def dedup_assets(assets: DataFrame) -> DataFrame:
    """(content_hash, asset_id, copies): the first asset of each content."""
    return assets.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min("asset_id").alias("asset_id"), F.count(F.lit(1)).alias("copies"))
