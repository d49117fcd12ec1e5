"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to 2^22 numbers.  The score is the logistic of
``w0 + sum w_i + 1/2 (|sum v_i|^2 - sum |v_i|^2)``: linear weights and, through the factors
v, pairwise interactions, so that two terms which are harmless alone can count together.
A term has a weight and factors if the labels say something about it (``least_z``), or about
it together with another term (``least_pair_z``), even where each alone is balanced.

Learning is the one bounded step: at most ``max_rows`` labelled rows (smallest hash of the
id first), whose term numbers alone reach the driver.  Every row is scored, on its whole
text.  The model (weights and factors of terms of those rows) is all that is broadcast.
Only texts go to Python, and one score for each comes back: rows stay in the JVM.

Nulls: a null or empty text has no terms and scores the model's base rate; a null id counts
as the empty text for the fold; labels null or other than 0 and 1 are not learnt from, and
of an id labelled twice the highest label counts.  Rows that repeat are scored each.
Without rows to learn from, all scores are 0.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashes, small_batches, utf8

TERM = re.compile(r"[^\W\d_]+")
FOLDS = 5
SPACE = (1 << 22) - 1
MEMO = 1 << 16  # terms whose number a worker remembers


def terms(blob: bytes | None) -> set[str]:
    """The lower-case words of a text."""
    return set(TERM.findall(blob.decode("utf-8", "replace").lower())) if blob else set()


def number(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "replace")) & SPACE


def held_out(id_column: Column) -> Column:
    """True for the fold that is never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Machine:
    """w0, and for each kept term a weight and a vector of factors."""

    def __init__(self, base: float, kept: np.ndarray, weights: np.ndarray, factors: np.ndarray) -> None:
        self.base, self.kept, self.weights, self.factors = base, kept, weights, factors
        self.place = {int(k): i for i, k in enumerate(kept)}
        self.memo: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def active(self, found: set[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = set()
        for t in found:
            i = memo.get(t)
            if i is None:
                i = memo[t] = self.place.get(number(t), -1)
            if i >= 0:
                out.add(i)
        return sorted(out)

    def logit(self, at: list[int]) -> float:
        v = self.factors[at]
        s = v.sum(axis=0)
        return float(self.base + self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, blob: bytes | None) -> float:
        z = self.logit(self.active(terms(blob)))
        return 1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0)))


def _log_odds(y: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """|z| of the log odds of ``n`` rows with a term, ``pos`` of them labelled 1, by label."""
    p1, p0 = (pos + 0.5) / (y.sum() + 1), (n - pos + 0.5) / (len(y) - y.sum() + 1)
    return np.abs(np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))) / np.sqrt(1 / (pos + 0.5) + 1 / (n - pos + 0.5))


def pair_terms(present: np.ndarray, y: np.ndarray, least_z: float, block: int = 256) -> np.ndarray:
    """Which terms (columns of a 0/1 matrix) interact with another: the odds ratio of one and the label differs by the other.

    Eight counts a pair come from two products of the matrix, taken in blocks of columns.
    """
    out = np.zeros(present.shape[1], dtype=bool)
    toxic = present[y > 0]
    sides = [(m.sum(axis=0, dtype=np.float64), float(len(m)), m) for m in (toxic, present[y <= 0])]
    for at in range(0, present.shape[1], block):
        contrast, variance = 0.0, 0.0
        for sign, (n, rows, m) in zip((1, -1), sides, strict=True):
            both = (m[:, at : at + block].T @ m).astype(np.float64)
            one, other = n[at : at + block, None], n[None]
            for s, cell in ((1, both), (-1, one - both), (-1, other - both), (1, rows - one - other + both)):
                contrast = contrast + sign * s * np.log(cell + 0.5)
                variance = variance + 1 / (cell + 0.5)
        strong = np.abs(contrast) >= least_z * np.sqrt(variance)
        strong[np.arange(len(strong)), np.arange(at, at + len(strong))] = False
        out |= strong.any(axis=0)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 6, epochs: int = 15, seed: int = 7, least_z: float = 3.5, least_rows: int = 5, least_pair_z: float = 6.0, pair_share: float = 0.05, l2: float = 1e-4) -> Machine:
    """AdaGrad on the logistic loss, for the terms that the labels tell apart.

    Those are terms in ``least_rows`` rows whose log odds differ by label with ``least_z``
    deviations, and, of the terms in a share ``pair_share`` of the rows at least, those with
    an interaction of ``least_pair_z`` deviations (rarer terms cannot be balanced alone and
    tell together).  A term that one class has by chance alone is noise.
    """
    y = labels.astype(np.float64)
    if not len(rows) or y.min() == y.max():
        return Machine(-500.0 if not len(rows) or y.max() == 0 else 500.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    names, at = np.unique(flat, return_inverse=True)
    at = at.astype(np.int32)
    n = np.bincount(at, minlength=len(names))
    pos = np.bincount(at[y[owner] > 0], minlength=len(names))
    chosen = (_log_odds(y, pos, n) >= least_z) & (n >= least_rows)
    common = np.flatnonzero((n >= max(least_rows, pair_share * len(y))) & (n < len(y)))
    column = np.full(len(names), -1, dtype=np.int32)
    column[common] = np.arange(len(common))
    shown = column[at] >= 0
    present = np.zeros((len(y), len(common)), dtype=np.float32)
    present[owner[shown], column[at[shown]]] = 1
    chosen[common[pair_terms(present, y, least_pair_z)]] = True
    del present, shown
    good = np.flatnonzero(chosen)
    place = np.full(len(names), -1)
    place[good] = np.arange(len(good))
    keep = place[at] >= 0
    starts = np.searchsorted(owner[keep], np.arange(len(rows) + 1))
    ids = place[at][keep]
    rng = np.random.default_rng(seed)
    base = float(np.log(y.mean() / (1 - y.mean())))
    w, v = np.zeros(len(good)), rng.normal(0, 0.01, (len(good), rank))
    gw, gv, gb = np.full(len(good), 1e-6), np.full(v.shape, 1e-6), 1e-6
    rate = 0.1
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            x = ids[starts[i] : starts[i + 1]]
            vx = v[x]
            s = vx.sum(axis=0)
            t = base + w[x].sum() + 0.5 * (s @ s - (vx * vx).sum())
            g = 1 / (1 + np.exp(-min(max(t, -30.0), 30.0))) - y[i]
            gb += g * g
            base -= rate * g / gb**0.5
            if len(x):
                dw, dv = g + l2 * w[x], g * (s - vx) + l2 * vx
                gw[x] += dw * dw
                w[x] -= rate * dw / np.sqrt(gw[x])
                gv[x] += dv * dv
                v[x] -= rate * dv / np.sqrt(gv[x])
    return Machine(base, names[good].astype(np.int64), w, v)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 16_000) -> Machine:
    """A machine from at most ``max_rows`` labelled rows outside the held-out fold."""
    small_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    chosen = lowest_hashes(known, F.xxhash64("__id"), max_rows, known.count())

    def number_all(batches):
        for b in batches:
            found = [np.array(sorted({number(t) for t in terms(x.as_py())}), dtype=np.int32) for x in b.column(2)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))], ["h", "label", "terms"])

    docs = df.select(F.col(id_col).alias("__doc"), utf8(text_col).alias("__text"))
    # at most max_rows small rows: their size is bounded by the parameter
    rows = docs.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select(F.xxhash64("__id", "__text"), "__label", "__text")
    got = rows.mapInArrow(number_all, "h bigint, label int, terms array<int>").toArrow().combine_chunks()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    labels_ = got.column("label").to_numpy()[order].astype(np.int64)
    if not len(order):
        return fit([], labels_)
    lists = got.column("terms").chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit([flat[ends[i] : ends[i + 1]] for i in order.tolist()], labels_)


def score(df: DataFrame, machine: Machine, text_col: str = "text") -> Column:
    """The score of each row's text: an Arrow function of that one column."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array((m.score(x.as_py()) for x in texts), pa.float64())

    return F.arrow_udf(run, "double")(utf8(text_col))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 16_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    machine = learn(df, labels, id_col, text_col, label_col, max_rows)
    scored = df.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(df, machine, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(df: DataFrame, labels: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of ``df``, all columns kept, whose text is not predicted toxic; without a join."""
    return df.where(score(df, learn(df, labels, text_col=text_col, **names), text_col) < 0.5)


def crc_fold(value: object) -> int:
    """The fold of one id, as :func:`held_out` computes it."""
    return zlib.crc32(("" if value is None else str(value)).encode()) % FOLDS
