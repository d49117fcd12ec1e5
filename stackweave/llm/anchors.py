"""Substring dedup with fixed-block anchors.

A passage counts as repeated when a window of 35 consecutive words of one document starts
anywhere else too.  A window of 35 words holds a whole aligned block of 18 words (the
reference block), wherever it starts; so of two equal windows, each one's block is met by
a rolling window of the other.  The steps:

1. Documents are bundled into chunks of bounded size, written once.
2. Each chunk sends the distinct hashes of all its rolling 18-word windows, marked where an
   aligned block has that hash or the hash occurs twice.  They are dealt out by hash.
   A hash that is an aligned block somewhere and starts at two places or more is an anchor;
   the reply is one bit for each hash sent.  A passage in a third of all documents costs one
   hash a chunk, so no hash is hot.
3. Hits are extended word by word to both sides, to every 35-word window around an anchored
   block; a window is repeated if its fingerprint, again one distinct one a chunk, starts at
   two places.  Consecutive repeated windows are the maximal exact repeats; their words are
   covered.

The 18-word step compares 32 bits within a bucket and only proposes, so a false hit costs
time and nothing else.  The last step compares fingerprints in place of the 35 words, so that
a passage in a third of all documents is never compared in pairs: 96 bits from the two
independent halves of each word's XXH3-128, within a bucket that further bits choose.  Of
10^12 windows, equal fingerprints of different words are to be expected in one run of 10^10.
A chunk's words and hashes are all that a task holds: ``chunk_bytes`` is its measure and
grows with the machine, not with the data.  A chunk sends one row for each bucket at most,
and never more rows than keys.

Nulls: a null text has no words; a null id is carried through.  Rows that repeat repeat
each other.  Documents under 35 words lose nothing.  Other columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8

WINDOW = 35
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
S29, S32 = np.uint64(29), np.uint64(32)


def block_words(window: int) -> int:
    """The longest block that every window of so many words holds whole and aligned."""
    return (window + 1) // 2


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * K1 + (y ^ (y >> S29)) * K2
    h ^= h >> S32
    h *= K3
    h ^= h >> S29
    return h


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive items, put together from powers of two."""
    out, taken, part, span = None, 0, h, 1
    while True:
        if size & span:
            out = part if out is None else _join(out[: len(part) - taken], part[taken:])
            taken += span
        span *= 2
        if span > size:
            return out
        part = _join(part[: len(part) - span // 2], part[span // 2 :]) if len(part) > span // 2 else part[:0]
        if out is not None and len(part) <= taken:
            return out[:0]


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as zlib-packed byte planes of their differences."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return zlib.compress(d.view(np.uint8).reshape(len(d), -1).T.tobytes(), 1)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


class Chunk:
    """The words of a bundle of texts, with hashes of the words of all that are long enough."""

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        self.window, self.block = window, block_words(window)
        self.words = [t.split() if t else [] for t in texts]
        counts = np.array([len(w) if len(w) >= window else 0 for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        n = int(counts.sum())
        digest = xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join(b"".join(map(digest, w)) for w in self.words if len(w) >= window), dtype=np.uint64).reshape(-1, 2)
        self.hashes, self.checks = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
        del halves
        self.offset = (np.arange(n) - np.repeat(self.starts, counts)).astype(np.int32)
        self.left = (np.repeat(self.ends, counts) - np.arange(n)).astype(np.int32)

    def anchors(self, buckets: int):
        """Keys of all rolling blocks (bucket and 32 bits), ascending and distinct; each start's place in them."""
        size = self.block
        at = np.flatnonzero(self.left >= size)
        h = rolling(self.hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
        keys = (((h >> S32) * np.uint64(buckets)) >> S32) << S32 | (h & np.uint64(0xFFFFFFFF))
        keys, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        aligned = self.offset[at] % size == 0
        is_block = np.zeros(len(keys), dtype=bool)
        is_block[inverse[aligned]] = True
        return at, keys, inverse, count > 1, is_block, aligned

    def candidates(self, anchored: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchored aligned block."""
        mark = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        mark[1:][anchored] = 1
        total = np.cumsum(mark)
        at = np.flatnonzero(self.left >= self.window)
        return at[total[at + self.window - self.block + 1] > total[at]]

    def windows(self, at: np.ndarray, buckets: int):
        """Fingerprints (bucket, 64 bits, 32 bits) of the windows that start at ``at``: distinct, ascending; each one's place."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        keys, checks = rolling(self.hashes, self.window)[at], rolling(self.checks, self.window)[at]
        bucket = ((checks >> S32) * np.uint64(buckets)) >> S32
        order, new = _sorted(bucket, keys, checks.astype(np.uint32))
        place = np.empty(len(at), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return bucket[first].astype(np.int64), keys[first], checks[first].astype(np.uint32), place, np.bincount(place) > 1


def _sorted(*lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by all lanes, the first one foremost; and which of that order differ from those before."""
    order = np.lexsort(lanes[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
    for x in lanes:
        sorted_ = x[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    return order, new


def _bundle(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = made = 0
        first = TaskContext.get().partitionId() << 32

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_pydict({"chunk": [first + made], "docs": [sink.getvalue().to_pybytes()]}, pa.schema([("chunk", pa.int64()), ("docs", pa.binary())]))

        from .common import batches_of

        for b in batches:
            for part in batches_of(b, "text", limit):
                if held and size + part.nbytes > limit:
                    yield flush()
                    held, size, made = [], 0, made + 1
                # a copy: a slice would keep, and send, the whole batch's buffers
                held.append(pa.RecordBatch.from_pylist(part.to_pylist(), part.schema))
                size += held[-1].nbytes
        if held:
            yield flush()

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one in memory at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _docs(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("flags", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("good", pa.binary())])
SENT_DDL, ANSWER_DDL = "bucket bigint, chunk bigint, keys binary, checks binary, flags binary", "chunk bigint, bucket bigint, good binary"


def _send(chunk: int, bucket: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, flags: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that a chunk has keys for."""
    if not len(keys):
        return
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    last = np.append(first[1:], len(bucket))
    for at in range(0, len(first), 4096):
        rows: dict = {"bucket": bucket[first[at : at + 4096]].tolist(), "keys": [], "checks": [], "flags": []}
        rows["chunk"] = [chunk] * len(rows["bucket"])
        for a, b in zip(first[at : at + 4096].tolist(), last[at : at + 4096].tolist(), strict=True):
            rows["keys"].append(pack(keys[a:b]))
            rows["checks"].append(checks[a:b].tobytes() if checks is not None else None)
            rows["flags"].append(b"".join(np.packbits(f[a:b]).tobytes() for f in flags))
        yield pa.RecordBatch.from_pydict(rows, SENT)


def _resolver(kind: type, n_flags: int):
    """For the rows of one bucket: which of each chunk's keys start at two places or more (and, of two flags, are a block somewhere)."""

    def resolve(rows: pa.Table) -> pa.Table:
        sent = [unpack(k.as_py(), kind) for k in rows["keys"]]
        sizes = [len(k) for k in sent]
        flags = [[np.unpackbits(np.frombuffer(f, np.uint8)[i * ((n + 7) // 8) : (i + 1) * ((n + 7) // 8)], count=n).astype(bool) for i in range(n_flags)] for f, n in zip((x.as_buffer() for x in rows["flags"]), sizes, strict=True)]
        lanes = [np.concatenate(sent)]
        del sent
        if rows["checks"][0].is_valid:
            lanes.append(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows["checks"]]))
        order, new = _sorted(*lanes)
        del lanes
        inverse = np.empty(len(order), dtype=np.int32)
        inverse[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        count = np.bincount(inverse)
        any_of = []
        for i in range(n_flags):
            got = np.zeros(len(count), dtype=bool)
            got[inverse[np.concatenate([f[i] for f in flags])]] = True
            any_of.append(got)
        good = (count > 1) | any_of[0]
        for got in any_of[1:]:
            good &= got
        out, at = [], 0
        for chunk, bucket, n in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), sizes, strict=True):
            mine = good[inverse[at : at + n]]
            at += n
            if mine.any():
                out.append({"chunk": chunk, "bucket": bucket, "good": np.packbits(mine).tobytes()})
        return pa.Table.from_pylist(out, ANSWER)

    return resolve


def _replies(sent: DataFrame, kind: type, n_flags: int) -> DataFrame:
    """Per chunk the list of (bucket, bits)."""
    answers = sent.groupBy("bucket").applyInArrow(_resolver(kind, n_flags), ANSWER_DDL)
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "good")).alias("replies"))


def _marked(bucket: np.ndarray, replies: list[dict] | None) -> np.ndarray:
    """A chunk's keys that a reply calls good, in the order they were sent in."""
    good = np.zeros(len(bucket), dtype=bool)
    for r in replies or []:
        a, b = np.searchsorted(bucket, [r["bucket"], r["bucket"] + 1])
        good[a:b] = np.unpackbits(np.frombuffer(r["good"], np.uint8), count=int(b - a)).astype(bool)
    return good


def _result(ids, n_words, n_removed, shas) -> dict:
    return {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}


def _sha(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = 2 << 20, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row; ``with_text`` adds the kept words as ``kept``."""
    spark = df.sparkSession
    chunks = materialize(df.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(_bundle(chunk_bytes), "chunk bigint, docs binary"), "chunks")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count() // 4, 1)
    extra = ", kept binary" if with_text else ""

    def probe(batches):
        for b in batches:
            for row in _rows(b):
                c = Chunk(_docs(row["docs"]).column("text").to_pylist(), window)
                _, keys, _, multi, is_block, _ = c.anchors(buckets)
                del c
                yield from _send(row["chunk"], (keys >> S32).astype(np.int64), keys.astype(np.uint32), None, [multi, is_block])

    anchored = _replies(chunks.mapInArrow(probe, SENT_DDL), np.uint32, 2)

    def extend(batches):
        """Results of the documents without a candidate window, and bundles of the others with theirs."""
        for b in batches:
            for row in _rows(b):
                docs = _docs(row["docs"])
                ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
                c = Chunk(texts, window)
                at, keys, inverse, _, _, aligned = c.anchors(buckets)
                good = _marked((keys >> S32).astype(np.int64), row["replies"])
                starts = c.candidates(at[aligned & good[inverse]]) if len(at) else at
                has = np.zeros(len(ids), dtype=bool)
                owner = np.searchsorted(c.ends, starts, "right")
                has[owner] = True
                plain = np.flatnonzero(~has).tolist()
                kept = [c.words[i] for i in plain]
                out = _result([ids[i] for i in plain], list(map(len, kept)), [0] * len(plain), list(map(_sha, kept)))
                out |= {"chunk": pa.nulls(len(plain), pa.int64()), "docs": pa.nulls(len(plain), pa.binary())}
                if with_text:
                    out["kept"] = pa.array([b" ".join(w) for w in kept], pa.binary())
                yield pa.RecordBatch.from_pydict(out)
                held = np.flatnonzero(has).tolist()
                if held:
                    cuts = np.searchsorted(starts, c.starts[held]).tolist(), np.searchsorted(starts, c.ends[held]).tolist()
                    places = [pack((starts[x:y] - c.starts[i]).astype(np.uint32)) for i, x, y in zip(held, *cuts, strict=True)]
                    rest = pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[i] for i in held], pa.int64()), "text": pa.array([texts[i] for i in held], pa.binary()), "places": pa.array(places, pa.binary())})
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(rest)
                    out = _result([None], [None], [None], [None]) | {"chunk": pa.array([row["chunk"]], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
                    if with_text:
                        out["kept"] = pa.nulls(1, pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    first = materialize(chunks.join(anchored, "chunk", "left").mapInArrow(extend, f"{RESULT}, chunk bigint, docs binary{extra}"), "first-pass")
    rest = first.where("chunk is not null").select("chunk", "docs")

    def load(blob):
        docs = _docs(blob)
        c = Chunk(docs.column("text").to_pylist(), window)
        return docs.column("doc_id").to_pylist(), c, np.concatenate([unpack(p, np.uint32).astype(np.int64) + s for p, s in zip(docs.column("places").to_pylist(), c.starts.tolist(), strict=True)])

    def send(batches):
        for b in batches:
            for row in _rows(b):
                _, c, starts = load(row["docs"])
                bucket, keys, checks, _, multi = c.windows(starts, buckets)
                del c
                yield from _send(row["chunk"], bucket, keys, checks, [multi])

    repeated = _replies(rest.mapInArrow(send, SENT_DDL), np.uint64, 1)

    def cut(batches):
        for b in batches:
            for row in _rows(b):
                ids, c, starts = load(row["docs"])
                bucket, _, _, place, _ = c.windows(starts, buckets)
                found = starts[_marked(bucket, row["replies"])[place]]
                edge = np.zeros(len(c.hashes) + window + 1, dtype=np.int64)
                np.add.at(edge, found, 1)
                np.add.at(edge, found + window, -1)
                covered = np.cumsum(edge) > 0
                kept, removed = [], []
                for w, s, e in zip(c.words, c.starts.tolist(), c.ends.tolist(), strict=True):
                    gone = covered[s:e]
                    kept.append([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                    removed.append(int(gone.sum()))
                out = _result(ids, list(map(len, c.words)), removed, list(map(_sha, kept)))
                if with_text:
                    out["kept"] = pa.array([b" ".join(k) for k in kept], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    second = rest.join(repeated, "chunk", "left").mapInArrow(cut, RESULT + extra)
    out = first.where("chunk is null").select(*names).unionByName(second)
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out
