"""URL filters by a sorted digest array.

A rule list becomes one file: 64-bit xxhash keys in ascending order, offsets and the full
rule strings.  The file is shipped to every executor once and memory-mapped there; the
probes of a batch of urls are hashed, looked up with one vectorised binary search, and a
digest that matches counts only if the stored string is equal.

Semantics: a rule is a host and a path.  It fits that host and all its subdomains, for
paths that start with the rule's path.  The longest fitting rule (host and path together)
decides; a null url, or one without ``://``, has an empty host and path and fits no rule.
Repeated rules keep the first verdict.  Extra columns of the input are dropped; the output
has the id column, host, path, rule and verdict.  An empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
HEAD = struct.Struct("<4Q")
_open: dict[str, RuleFile] = {}


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def build_rules(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """Writes (verdict, host, path) rules as a digest file; a rule's text is host + path."""
    unique: dict[bytes, int] = {}
    for verdict, host, prefix in rules:
        unique.setdefault((host + prefix).encode(), VERDICTS.index(verdict))
    texts = list(unique)
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype="<u8")
    order = np.argsort(keys, kind="stable")
    blob = [texts[i] for i in order]
    ends = np.cumsum([0, *map(len, blob)], dtype="<u8")
    paths = sorted({len(p.encode()) for _, _, p in rules})
    with open(path, "wb") as f:
        f.write(HEAD.pack(len(texts), len(paths), int(ends[-1]), 0))
        f.write(keys[order].tobytes())
        f.write(ends.tobytes())
        f.write(np.array(paths, dtype="<u8").tobytes())
        f.write(np.array([unique[t] for t in blob], dtype="u1").tobytes())
        f.write(b"".join(blob))


class RuleFile:
    """A memory-mapped digest file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, n_paths, _, _ = HEAD.unpack_from(self.map, 0)
        at = HEAD.size
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        at += 8 * n
        self.ends = np.frombuffer(self.map, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.path_lengths = np.frombuffer(self.map, "<u8", n_paths, at).tolist()
        at += 8 * n_paths
        self.verdicts = np.frombuffer(self.map, "u1", n, at)
        self.text_at = at + n

    def text(self, i: int) -> bytes:
        return self.map[self.text_at + int(self.ends[i]) : self.text_at + int(self.ends[i + 1])]

    def lookup(self, probes: list[bytes]) -> np.ndarray:
        """For each probe its rule's index, or -1: binary search, then a check of the string."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype=np.uint64, count=len(probes))
        low = np.searchsorted(self.keys, digests, "left")
        found = np.full(len(probes), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        hits = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == digests)
        for i in hits.tolist():
            j = int(low[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.text(j) == probes[i]:
                    found[i] = j
                    break
                j += 1  # another string with the same digest
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule of each (host, path), and its verdict."""
        probes: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            raw, tail = path.encode(), host.encode()
            prefixes = [raw[:n] for n in self.path_lengths if n <= len(raw)]
            while True:
                probes += [tail + p for p in prefixes]
                owner += [i] * len(prefixes)
                dot = tail.find(b".")
                if dot < 0:
                    break
                tail = tail[dot + 1 :]
                if not tail:
                    break
        found = self.lookup(probes)
        best: dict[int, tuple[int, int]] = {}
        for at in np.flatnonzero(found >= 0).tolist():
            i, j = owner[at], int(found[at])
            best[i] = max(best.get(i, (-1, -1)), (len(probes[at]), -j), key=lambda x: x[0])
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        for i, (_, j) in best.items():
            rules[i], verdicts[i] = self.text(-j).decode(), VERDICTS[self.verdicts[-j]]
        return rules, verdicts


def _rule_file(name: str) -> RuleFile:
    if name not in _open:
        _open[name] = RuleFile(SparkFiles.get(name))
    return _open[name]


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of each row; ``default`` is the verdict without a rule."""
    spark = df.sparkSession
    name = f"rules-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="rules-"), name)
    build_rules(rules, local)
    spark.sparkContext.addFile(local)
    slim = df.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))

    def probe(batches):
        index = _rule_file(name)
        for b in batches:
            found, verdicts = index.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array([v or default for v in verdicts], pa.string())], [*b.schema.names, "rule", "verdict"])

    id_type = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(probe, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")


#: The rules of the pages query.
PAGE_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
