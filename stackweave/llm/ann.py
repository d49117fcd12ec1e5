"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted to at most ``sample_rows`` distinct vectors (smallest hash first; the
only bounded step besides the calibration queries), and every distinct vector is put into a
leaf.  A query walks the tree best bin first: a priority queue holds the nodes seen, the
nearest centre comes out next, and leaves are visited in that order.  How many are visited
is calibrated: exact neighbours of at most ``calibration`` queries are found by comparing
those with all rows in blocks, and visits are widened until ``recall`` of them is reached.

Visits and rows meet by a shuffle on (leaf, part); a leaf is cut into parts of about
``part_rows`` rows and, beyond ``query_rows`` queries, its queries into slices that each
meet all parts, so no task holds more.  The tree has at most a sixteenth of ``sample_rows``
leaves: beyond ``leaf_rows`` times that many vectors a larger sample keeps leaves small.  Vectors that are equal become one row with
their smallest ids, as many as a result can show, which loses nothing: they tie.

Nearness is the cosine in double precision (exactly rounded sums of the original vectors),
larger first, ties to the smaller id; a query's own id is no candidate.  Vectors that are
null, zero, hold null or non-finite components, lack an id, or are of another length than
most take no part.  Rows that repeat (id and vector) count once.  Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lowest_hashes, materialize

RESULT = "query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    parts = vector.cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(parts, lambda x: x != 0), F.lit(False))


def scaled(m: np.ndarray) -> np.ndarray:
    """Vectors (rows, or one) times a power of two each, largest component near one: squares stay in range, cosines as they are."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=-1, keepdims=True))[1]) if m.size else m


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


class Tree:
    """Nodes in arrays: a centre, the children's range, or a leaf's number."""

    def __init__(self, sample: np.ndarray, leaves: int, branching: int = 8, rounds: int = 10, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.centres = [sample.mean(axis=0) if len(sample) else np.zeros(1)]
        self.children: list[tuple[int, int] | None] = [None]
        work = [(-len(sample), 0, np.arange(len(sample)))]
        n_leaves = 1
        while work and n_leaves < leaves:  # the fullest leaf is split next
            _, node, rows = heapq.heappop(work)
            k = min(branching, leaves - n_leaves + 1)
            if len(rows) < 2 * k or k < 2:
                continue
            points = sample[rows]
            centres = points[rng.choice(len(rows), k, replace=False)]
            for _ in range(rounds):
                near = (points @ centres.T).argmax(axis=1)
                for c in range(k):
                    if (near == c).any():
                        centres[c] = points[near == c].mean(axis=0)
                centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1)), 1e-12)[:, None]
            near = (points @ centres.T).argmax(axis=1)
            filled = [c for c in range(k) if (near == c).any()]
            if len(filled) < 2:
                continue
            first = len(self.centres)
            self.children[node] = (first, first + len(filled))
            for c in filled:
                self.centres.append(centres[c])
                self.children.append(None)
                heapq.heappush(work, (-int((near == c).sum()), len(self.centres) - 1, rows[near == c]))
            n_leaves += len(filled) - 1
        self.centres = np.array(self.centres)
        self.leaf = np.full(len(self.children), -1)
        ends = [i for i, c in enumerate(self.children) if c is None]
        self.leaf[ends] = np.arange(len(ends))
        self.n_leaves = len(ends)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest centre at every level."""
        out = np.zeros(len(points), dtype=np.int64)
        work = [(0, np.arange(len(points)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if self.children[node] is None:
                out[rows] = self.leaf[node]
                continue
            a, b = self.children[node]
            near = (points[rows] @ self.centres[a:b].T).argmax(axis=1)
            work += [(a + c, rows[near == c]) for c in range(b - a)]
        return out

    def visits(self, point: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for a unit vector, best bin first."""
        near = self.centres @ point
        queue, out = [(-1.0, 0)], []
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            while (own := self.children[node]) is not None:
                # siblings wait in the queue, the nearest child is gone down to at once
                best = own[0] + int(near[own[0] : own[1]].argmax())
                for c in range(*own):
                    if c != best:
                        heapq.heappush(queue, (-float(near[c]), c))
                node = best
            out.append(int(self.leaf[node]))
        return out


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors from exactly rounded sums."""
    a, b = scaled(a), scaled(b)
    return math.fsum((a * b).tolist()) / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


def nearest(query_ids, queries: np.ndarray, row_ids: list[list[int]], rows: np.ndarray, k: int, block: int = 256):
    """Each query's k nearest among rows: rough scores by a matrix product, exact ones for all that may count."""
    units = unit(rows)
    for at in range(0, len(queries), block):
        rough = unit(queries[at : at + block]) @ units.T
        most = min(k + 1, len(rows))
        bound = np.partition(rough, len(rows) - most, axis=1)[:, len(rows) - most] - 1e-9
        for i, near in enumerate(rough >= bound[:, None]):
            q, own = queries[at + i], int(query_ids[at + i])
            found = sorted((-cosine(q, rows[j]), v) for j in np.flatnonzero(near).tolist() for v in row_ids[j] if v != own)
            yield own, [(v, -s) for s, v in found[:k]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pack(found) -> pa.RecordBatch:
    rows = [(q, v, s) for q, near in found for v, s in near]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(df: DataFrame, query: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, sample_rows: int = 20_000, leaf_rows: int = 400, calibration: int = 256, recall: float = 0.97, part_rows: int = 50_000, query_rows: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest; ``query`` picks the rows that are queries (all by default)."""
    spark = df.sparkSession
    picked = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    good = df.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), picked.alias("q"))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = materialize(good.where(F.size("v") == lengths["n"]), "vectors")
    # of equal vectors, k + 1 ids can show: k, and one that may be the query's own
    ranked = good.select("id", "v").withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    rows = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "distinct-vectors")
    n = rows.count()
    sample = unit(_matrix(lowest_hashes(rows, F.xxhash64("v"), sample_rows, n).select("v").toArrow().column(0).combine_chunks()))
    tree = Tree(sample, max(1, min(n // leaf_rows, len(sample) // 16)))
    queries = good.where("q").select("id", "v").dropDuplicates(["id", "v"])
    n_queries = queries.count()
    tests = lowest_hashes(queries, F.xxhash64("v", "id"), calibration, n_queries).toArrow()
    test_ids, test_vecs = tests.column(0).to_pylist(), _matrix(tests.column(1).combine_chunks()) if tests.num_rows else np.zeros((0, 1))

    def compare(batches):
        for b in batches:
            if b.num_rows:
                yield _pack(nearest(test_ids, test_vecs, b.column(1).to_pylist(), _matrix(b.column(0)), k))

    most = tree.n_leaves
    if tests.num_rows and most > 1:
        exact = _top(rows.select("v", "ids").mapInArrow(compare, RESULT), k)
        truth = exact.join(good.select(F.col("id").alias("vec_id"), "v").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "v").toArrow()
        leaf = tree.assign(unit(_matrix(truth.column(1).combine_chunks()))) if truth.num_rows else np.zeros(0)
        place = {i: {x: p for p, x in enumerate(tree.visits(v, most))} for i, v in zip(test_ids, unit(test_vecs), strict=True)}
        needed = np.sort([place[q][int(x)] for q, x in zip(truth.column(0).to_pylist(), leaf, strict=True)])
        if len(needed):
            most = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1
    shared = spark.sparkContext.broadcast(tree)

    def put(batches):
        for b in batches:
            leaf = shared.value.assign(unit(_matrix(b.column(0)))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], ["v", "ids", "leaf"])

    placed = materialize(rows.select("v", "ids").mapInArrow(put, "v array<double>, ids array<bigint>, leaf bigint"), "leaves")
    parts = {r["leaf"]: -(-r["count"] // part_rows) for r in placed.groupBy("leaf").count().where(F.col("count") > part_rows).collect()}
    cuts = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else None
    cut = F.coalesce(cuts[F.col("leaf")], F.lit(1)).cast("bigint") if parts else F.lit(1).cast("bigint")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("v"), cut))

    def visit(batches):
        for b in batches:
            own, leaves = [], []
            for i, v in enumerate(unit(_matrix(b.column(1))) if b.num_rows else []):
                for x in shared.value.visits(v, most):
                    for _ in range(parts.get(x, 1)):
                        own.append(i)
                    leaves += [(x, p) for p in range(parts.get(x, 1))]
            t = b.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array([x for x, _ in leaves], pa.int64()), pa.array([p for _, p in leaves], pa.int64())], ["id", "v", "leaf", "part"])

    visits = queries.select("id", "v").mapInArrow(visit, "id bigint, v array<double>, leaf bigint, part bigint")
    slices = F.lit(1).cast("bigint")
    if n_queries > query_rows:  # else no leaf is visited by more
        heavy = {r["leaf"]: -(-r["count"] // query_rows) for r in visits.where("part = 0").groupBy("leaf").count().where(F.col("count") > query_rows).collect()}
        if heavy:
            slices = F.coalesce(F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv])[F.col("leaf")], F.lit(1)).cast("bigint")
    visits = visits.withColumn("slice", F.pmod(F.xxhash64("id"), slices))
    placed = placed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_pack([])])
        q, r = left.combine_chunks(), right.combine_chunks()
        return pa.Table.from_batches([_pack(nearest(q.column("id").to_pylist(), _matrix(q.column("v").combine_chunks()), r.column("ids").to_pylist(), _matrix(r.column("v").combine_chunks()), k))])

    found = visits.groupBy("leaf", "part", "slice").cogroup(placed.groupBy("leaf", "part", "slice")).applyInArrow(meet, RESULT)
    return _top(found, k)
