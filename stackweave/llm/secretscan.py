"""Secret scans: patterns, and a character convolutional network over every candidate.

Base spans come from three fixed patterns and always stay.  Beyond them every token of 12
and more credential characters is a candidate; a small character CNN, in numpy, reads the
candidate with 24 characters around it and adds a span of kind ``cnn`` if its calibrated
score reaches the threshold.  A token of more than 48 characters is read whole, in windows
of 48 that overlap by half or more; its score is the largest of theirs.

The network is trained on labelled findings: base spans (credential or not is what the
patterns say) against ordinary tokens and made-up numbers in the same contexts, and again
without the word that announces them, with their own values or made-up ones of credentials'
alphabets, from at most ``max_docs`` documents with a finding and as many without (smallest hash of the id
first, of the texts of ``max_chars`` characters at most; the only bounded step: every text
is scanned).  A quarter of them is held back, to fit a slope and an offset to the scores
(Platt), and to choose the threshold: one half, or as far below it as finding ``recall`` of
the held-back secrets that no word announces asks for.

Nulls: a null text counts as empty; a null id is carried through.  Rows that repeat are
scanned each.  Offsets are code points, ends exclusive.  Other columns are ignored.  An
empty table, or one without findings to learn from, gets base spans only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashes, utf8

KINDS = ("assign", "access", "hex", "cnn")
# The base patterns and the least lengths they need.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # every maximal run of 32 and more, as [0-9a-f]+ would find it
LEAST = {"assign": 8, "access": 16}

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}(?![A-Za-z0-9+/_=-])")
# The alphabets of credentials.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
AROUND, INSIDE = 24, 48
WIDTH = 2 * AROUND + INSIDE
CLASSES = 96
BLOCK = 8192  # windows scored at once


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that no base span touches."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    out = []
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            out.append(m.span())
    return out


def _classes(shown: str) -> np.ndarray:
    codes = np.frombuffer(shown.encode("utf-32-le", "replace"), dtype="<u4")
    return np.where((codes >= 32) & (codes < 127), codes - 31, 0).astype(np.uint8)


def offsets(length: int) -> range | list[int]:
    """Where the windows of a token begin."""
    return [0] if length <= INSIDE else [*range(0, length - INSIDE, INSIDE // 2), length - INSIDE]


def picture(text: str, start: int, end: int, at: int = 0) -> np.ndarray:
    """Character classes of the token's window from ``at`` on, between its surroundings."""
    start, end = start + at, min(end, start + at + INSIDE)
    return _classes(text[max(0, start - AROUND) : start].rjust(AROUND) + text[start:end].ljust(INSIDE) + text[end : end + AROUND].ljust(AROUND))


class Network:
    """Embedding, one convolution of five characters, maximum and mean over places, logistic."""

    def __init__(self, seed: int = 11, dim: int = 8, filters: int = 24, span: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.span, self.dim = span, dim
        self.p = {
            "e": rng.normal(0, 0.3, (CLASSES, dim)),
            "k": rng.normal(0, 1 / np.sqrt(span * dim), (span * dim, filters)),
            "b": np.zeros(filters),
            "w": rng.normal(0, 0.1, 2 * filters),
            "o": np.zeros(1),
        }
        self.slope, self.offset, self.threshold = 1.0, 0.0, 2.0

    def forward(self, x: np.ndarray):
        p = self.p
        emb = p["e"][x]
        cols = np.concatenate([emb[:, i : x.shape[1] - self.span + 1 + i] for i in range(self.span)], axis=2)
        pre = cols @ p["k"] + p["b"]
        act = np.maximum(pre, 0)
        top = act.argmax(axis=1)
        feats = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1)
        return feats @ p["w"] + p["o"], (cols, pre, top, feats)

    def logits(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + step])[0] for i in range(0, len(x), step)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.offset, -50, 50)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                z, (cols, pre, top, feats) = self.forward(x[at])
                g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[at]) / len(at)
                n, places, filters = pre.shape
                d = np.repeat((g[:, None] * self.p["w"][filters:] / places)[:, None], places, axis=1)
                peak = g[:, None] * self.p["w"][:filters]
                np.put_along_axis(d, top[:, None], np.take_along_axis(d, top[:, None], 1) + peak[:, None], 1)
                d *= pre > 0
                back = (d @ self.p["k"].T).reshape(n, places, self.span, self.dim)
                de = np.zeros_like(self.p["e"])
                for i in range(self.span):
                    np.add.at(de, x[at][:, i : i + places], back[:, :, i])
                grads = {"e": de, "k": np.tensordot(cols, d, ([0, 1], [0, 1])), "b": d.sum(axis=(0, 1)), "w": g @ feats, "o": np.array([g.sum()])}
                step += 1
                for k, v in grads.items():
                    a, b = m[k]
                    a += 0.1 * (v - a)
                    b += 0.001 * (v * v - b)
                    self.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt's slope and offset by Newton steps, then the recall-constrained threshold."""
        z = self.logits(x)
        n = (y > 0).sum()
        target = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            r, h = s - target, np.maximum(s * (1 - s), 1e-9)
            ga, gb = (r * z).sum() + 1e-3 * a, r.sum()
            haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-3
            det = haa * hbb - hab * hab
            if det <= 0:
                break
            # short steps: the classes may be separable, and the slope must not run away
            a += float(np.clip(-(hbb * ga - hab * gb) / det, -0.5, 0.5))
            b += float(np.clip(-(haa * gb - hab * ga) / det, -0.5, 0.5))
        if a > 0:
            self.slope, self.offset = float(a), float(b)
        found = np.sort(self.score(x[y == 2]))[::-1]  # the kind that candidates are
        wanted = float(found[max(0, int(np.ceil(recall * len(found))) - 1)]) if len(found) else 2.0
        self.threshold = min(0.5, wanted) if len(found) else 2.0


def _examples(text: str, rng: np.random.Generator) -> tuple[list[np.ndarray], list[int]]:
    """Pictures and labels: 0 ordinary, 1 a finding, 2 a finding that nothing before it announces."""
    base = base_spans(text)
    x, y = [], []

    def one(text: str, s: int, e: int) -> np.ndarray:
        at = offsets(e - s)
        return picture(text, s, e, at[int(rng.integers(len(at)))] if len(at) > 1 else 0)

    for s, kind, e in base:
        if kind == 0:
            s = ASSIGN.search(text, s).start(1)
        x.append(one(text, s, e))
        y.append(1)
        # the same value, or another in one of credentials' alphabets, with no word before it that gives it away
        value = text[s:e]
        if rng.random() < 0.7:
            value = "".join(rng.choice(list(ALPHABETS[int(rng.integers(len(ALPHABETS)))]), int(rng.integers(16, 65))))
        at = int(rng.integers(0, max(1, len(text) - 60)))
        bare = text[at : at + 40].rsplit(" ", 1)[0] + " "
        x.append(one(bare + value + " " + text[at + 40 : at + 80], len(bare), len(bare) + len(value)))
        y.append(2)
    plain = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for i in rng.permutation(len(plain))[: 4 + 2 * len(base)].tolist():
        s, e = plain[i]
        if not any(a < e and s < b for a, _, b in base):
            x.append(one(text, s, e))
            y.append(0)
            # the same context round a token that is none: numbers, versions, words joined
            other = str(rng.choice(["".join(map(str, rng.integers(0, 10, 16))), f"v{rng.integers(99)}.{rng.integers(99)}.{rng.integers(999)}-rc{rng.integers(9)}", "_".join(text[a:b] for a, b in plain[max(0, i - 1) : i + 2])[:60] + str(rng.integers(9)), f"2024-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(24):02d}"]))
            x.append(one(text[:s] + other + text[e:], s, s + len(other)))
            y.append(0)
    return x, y


LIKELY = r"AKIA[A-Z0-9]{12}|(?<![0-9a-f])[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 400, max_chars: int = 20_000, recall: float = 0.95) -> Network:
    """A network from at most ``max_docs`` documents that look like they hold findings and as many others."""
    short = df.where(F.length(text_col) <= max_chars).select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    likely = F.col("text").rlike(LIKELY)
    counts = short.agg(F.count_if(likely).alias("likely"), F.count(F.lit(1)).alias("all")).first()
    texts = [r["text"] for kind, n in ((likely, counts["likely"]), (F.lit(True), counts["all"])) for r in lowest_hashes(short, F.col("h"), max_docs, n, kind).collect()]
    rng = np.random.default_rng(5)
    x, y = [], []
    for t in texts:
        a, b = _examples(t, rng)
        x += a
        y += b
    net = Network()
    x, y = np.array(x), np.array(y)
    back = rng.random(len(y)) < 0.25
    if min((y[back] == 2).sum(), (y[~back] > 0).sum(), (y[back] == 0).sum()) < 5:
        return net
    net.train(x[~back], (y[~back] > 0).astype(np.float64))
    net.calibrate(x[back], y[back], recall)
    return net


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn) for each row."""
    net = df.sparkSession.sparkContext.broadcast(learn(df, id_col, text_col, **training))

    def run(batches):
        n = net.value
        for b in batches:
            bases, shown, owner, spots = [], [], [], []
            best: list[float] = []

            def settle() -> None:
                for j, sc in zip(owner, n.score(np.array(shown)).tolist(), strict=True):
                    best[j] = max(best[j], sc)
                shown.clear()
                owner.clear()

            for i, v in enumerate(b.column(1)):
                blob = v.as_py()
                text = blob.decode("utf-8", "replace") if blob else ""
                bases.append(base_spans(text))
                for s, e in candidates(text, bases[-1]):
                    spots.append((i, (s, 3, e)))
                    best.append(0.0)
                    for at in offsets(e - s):
                        owner.append(len(best) - 1)
                        shown.append(picture(text, s, e, at))
                        if len(shown) == BLOCK:
                            settle()
            if shown:
                settle()
            added: list[list] = [[] for _ in bases]
            for (i, spot), sc in zip(spots, best, strict=True):
                if sc >= n.threshold:
                    added[i].append(spot)
            kinds = [[sum(k == kind for _, k, _ in x) for x in bases] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(k, pa.int64()) for k in kinds), pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in bases]), pa.array([_joined(sorted(x + a)) for x, a in zip(bases, added, strict=True)], pa.string()), pa.array(list(map(len, added)), pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"],
            )

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_cnn bigint")
