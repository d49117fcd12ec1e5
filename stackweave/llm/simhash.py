"""SimHash near-duplicate groups through a Gray-order hierarchical index.

A document's fingerprint is the majority of the bits of its three-word shingles' XXH64
(seed 42).  Two fingerprints link when at most two bits differ; groups are the connected
components of those links.

The index works on distinct fingerprints.  Its upper nodes are masked patterns: of eight
bytes, linked fingerprints share at least six, so each fingerprint goes to the 28 nodes
that fix six bytes.  A node holds 2^16 fingerprints at most, whatever the corpus: that
bounds a group without any cap.  Below such a node the fingerprints are sorted by their
Gray rank and packed into a tree whose nodes keep the bits that all their members share;
a search adds up the differences to those bits and drops whole groups beyond two.  A node
emits a spanning forest of its links, never all pairs.

Nulls: a null text counts as empty (no word: fingerprint zero, linked like any other); a
null id is never a component's name, and its row still gets its group's name.  Rows that
repeat are kept.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, utf8, words
from .components import components

DISTANCE = 2
FAN = 16
SEED = 42


def fingerprint(blob: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes."""
    ws = words(blob.lower()) if blob else []
    if not ws:
        return 0
    text = b" ".join(ws)
    if len(ws) <= width:
        h = np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
        starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
        ends = (starts + sizes)[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)), dtype=np.uint64, count=len(ends))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed 64-bit number; and its text's digest if asked."""

    def compute(batches):
        for b in batches:
            fps = np.array([fingerprint(v.as_py()) for v in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    small_batches(df.sparkSession)
    more = [_digest(text_col).alias("digest")] if digests else []
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"), *more).mapInArrow(compute, "doc_id bigint, fp bigint" + (", digest bigint" if digests else ""))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bottom-up nodes over sorted codes: per level the shared mask, the pattern, the first child."""
    mask, pattern = np.full(len(codes), ~np.uint64(0)), codes
    out = []
    while len(mask) > 1:
        first = np.arange(0, len(mask), FAN)
        same = np.bitwise_and.reduceat(mask, first) & ~(np.bitwise_or.reduceat(pattern, first) ^ np.bitwise_and.reduceat(pattern, first))
        mask, pattern = same, np.bitwise_and.reduceat(pattern, first) & same
        out.append((mask, pattern, first))
    return out[::-1]


def linked_pairs(codes: np.ndarray, distance: int = DISTANCE, block: int = 4096):
    """Index pairs (i < j) of Gray-sorted distinct codes at most ``distance`` bits apart, in blocks.

    A query walks the tree from the root and leaves a node when the differences to the
    bits that all its members share exceed ``distance``.
    """
    levels = _levels(codes)
    for start in range(0, len(codes), block):
        query = np.arange(start, min(start + block, len(codes)))
        node = np.zeros(len(query), dtype=np.int64)
        for depth, (mask, pattern, _) in enumerate(levels):
            near = np.bitwise_count((codes[query] ^ pattern[node]) & mask[node]) <= distance
            query, node = query[near], node[near]
            below = len(levels[depth + 1][0]) if depth + 1 < len(levels) else len(codes)
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            query = np.repeat(query, FAN)
            keep = (child < below) & (child >= query // FAN ** (len(levels) - depth - 1))
            query, node = query[keep], child[keep]
        near = (query < node) & (np.bitwise_count(codes[query] ^ codes[node]) <= distance)
        yield query[near], node[near]


def _forest(n: int, pairs) -> np.ndarray:
    """Root of each of n members after joining all linked pairs."""
    root = np.arange(n)

    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(root, root[root]):
                root = root[root]
    return root


def group_links(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct codes, as (member, root) codes."""
    codes = codes[np.argsort(gray_rank(codes))]
    root = _forest(len(codes), linked_pairs(codes))
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return codes[moved], codes[root[moved]]


def _keyed(fps: DataFrame) -> DataFrame:
    """28 rows for each fingerprint: which six of eight bytes are fixed, and the rest masked out."""
    masks = [sum(0xFF << 8 * i for i in keep) for keep in combinations(range(8), 6)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    nodes = F.array(*[F.struct(F.lit(i).cast("byte").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(signed)])
    return fps.select("fp", F.explode(nodes).alias("node")).select("fp", "node.mask", "node.pattern")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all groups; ``fps`` has distinct fp."""
    # dealt out anew: the 28 rows of each fingerprint are made by as many tasks as read them
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = _keyed(spread).groupBy("mask", "pattern").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")

    def search(batches):
        for b in batches:
            lists = b.column(0)
            left, right = [], []
            for x in lists:
                codes = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if len(codes) == 2:
                    if np.bitwise_count(codes[0] ^ codes[1]) <= DISTANCE:
                        left.append(codes[:1])
                        right.append(codes[1:])
                    continue
                a, r = group_links(codes)
                left.append(a)
                right.append(r)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (left, right)], ["a", "b"])

    return nodes.mapInArrow(search, "a bigint, b bigint")


def _groups(df: DataFrame, id_col: str, text_col: str, digests: bool = False) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row; with its text's digest if asked."""
    per_row = materialize(fingerprints(df, id_col, text_col, digests), "fingerprints")
    reps = materialize(per_row.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    links = materialize(fingerprint_links(reps.select("fp")), "fp-links").distinct()
    # name nodes by fingerprint: every one is distinct and not null
    roots = components(links)
    grouped = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "root").select("fp", "root", "component_id")
    return per_row.join(named, "fp")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    return _groups(df, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group: the one with its smallest id, by the texts' digests if that id repeats.

    Rows are told apart by id and digest (64 bits), so an id may repeat with other texts or
    be null; a group without any id keeps one row too.
    """
    groups = materialize(_groups(df, id_col, text_col, digests=True).select("doc_id", "digest", "root", "component_id"), "groups")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    n = groups.where(named).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root").alias("d")).first()
    repeats = n["n"] != n["d"]
    gone = groups.where(~named).select("doc_id", "digest")
    if repeats:
        first = groups.where(named).groupBy("root").agg(F.min("digest").alias("first"))
        gone = gone.unionByName(groups.where(named).join(first, "root").where("digest <> first").select("doc_id", "digest"))
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest")).distinct()
    kept = df.join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col("__gone")) & (_digest(text_col) == F.col("__digest")), "left_anti")
    if repeats:
        kept = kept.withColumn("__copy", _digest(text_col)).dropDuplicates([id_col, "__copy"]).drop("__copy")
    return kept
