"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern; each distinct word of a bundle of texts is
encoded once, and the words that are frequent in a bounded sample once for all bundles.
The encoding is a Spark higher-order fold over the word's bytes: the state holds the parts'
ids and the ranks of all adjacent pairs; a step merges the leftmost pair of the lowest rank.
Ranks come from a literal map of (left id, right id) to the merged id, which is its rank too.
That fold touches all pairs at every merge.  Words of more than ``LONG`` bytes are folded by
distinct pairs instead: a step merges every place of the lowest pair in one native replacement
of the state's string, so its steps are as many as there are different merges, not places.
Decoding concatenates the ids' binary pieces, first of a word, then of a text.

Around the fold, Arrow batches carry each bundle: its new words, and for every text the
numbers of its words.  A bundle ends at ``max_words`` new words or ``max_codes`` words; the
later bundles of a task know its words, until ``keep_words`` are known and all are forgotten.
So memory is bounded by parameters (or by one text, if that is longer), and nothing is
shuffled: a hot source or a word in every text costs nothing extra.

Nulls: a null text counts as empty and has no ids; a null id is carried through.  Rows that
repeat are encoded each.  Other columns are ignored.  An empty table gives an empty result.
The vocabulary must hold every single byte; its file's path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.classic.column import Column
from pyspark.sql import functions as F

from .common import lowest_hashes, small_batches, utf8


#: Ids are kept as characters from here on, so that none is a control character.
SHIFT = 256
#: Words of more bytes than this are folded by distinct pairs.
LONG = 512


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    return ranks


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the id of the two joined, for all tokens that two tokens make."""
    return {(left, right): rank for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}


class RankMap:
    """The literal rank map, a perfect hash of pairs of letters (ids plus ``SHIFT``).

    A pair's number is (left - middle) * base + right, which fits 32 signed bits, so that
    the fold calculates in ints.  Its group (the number mod ``groups``) has a displacement;
    the pair stands at that plus its number mod ``slots``.  A lookup reads one displacement
    and one key.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.base = max(ranks.values()) + 1 + SHIFT
        self.middle = self.base // 2
        if self.middle * self.base >= 1 << 31:
            raise ValueError("pairs of more than 65,000 ids need wider numbers")
        pairs = {self.number(left + SHIFT, right + SHIFT): merged + SHIFT for (left, right), merged in merges(ranks).items()}
        self.groups, self.slots = len(pairs) // 3 + 1, len(pairs) * 5 // 2 + 1
        members: dict[int, list[int]] = {}
        for p in pairs:
            members.setdefault(p % self.groups, []).append(p)
        while any(len({p % self.slots for p in m}) < len(m) for m in members.values()):
            self.slots += 1
        self.shift = np.zeros(self.groups, dtype=np.int32)
        taken: dict[int, int] = {}
        for group, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            places = [p % self.slots for p in own]
            shift = 0
            while any(x + shift in taken for x in places):
                shift += 1
            self.shift[group] = shift
            for x, p in zip(places, own, strict=True):
                taken[x + shift] = p
        size = max(taken, default=0) + 1
        # no pair has the largest number: its right part would be above all letters
        self.keys, self.merged = np.full(size, (1 << 31) - 1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for place, p in taken.items():
            self.keys[place], self.merged[place] = p, pairs[p]

    def number(self, left: int, right: int) -> int:
        return (left - self.middle) * self.base + right


def _literal(numbers: np.ndarray) -> Column:
    """A literal array of 32-bit numbers.

    ``F.lit`` would box every number, in each task anew and in each printed plan; this holds
    them as the bytes that rows have.
    """
    from pyspark import SparkContext

    gateway = SparkContext._active_spark_context._gateway
    jvm = gateway.jvm
    array = gateway.new_array(jvm.int, len(numbers))
    jvm.java.nio.ByteBuffer.wrap(bytearray(numbers.astype(">i4").tobytes())).asIntBuffer().get(array)
    data = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData.fromPrimitiveArray(array)
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("array<int>")
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(data, kind)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    An aggregate of nothing that ends in ``body``: an element of a transformed array would
    work out the body's type anew for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def word_encoder(ranks: dict[bytes, int]):
    """A function from a string column to a string with one letter for each id: its code point less ``SHIFT``.

    The fold's state is that string, which a merge overlays in place, and the array of the
    ranks of each part with the next; slices and concatenations of arrays would cost more
    than all else.
    """
    table = RankMap(ranks)
    shift, keys, merged = _literal(table.shift), _literal(table.keys), _literal(table.merged)
    single = _literal(np.array([ranks[bytes([i])] + SHIFT for i in range(256)], dtype=np.int32))
    letters = F.split(F.lit("".join(chr(i) for i in range(1, table.base))), "")  # letter n at n - 1

    def rank(left: Column, right: Column) -> Column:
        """The letter's number of two letters' numbers joined, null if there is none."""

        def look(p: Column) -> Column:
            return _let(F.get(shift, F.pmod(p, F.lit(table.groups))) + F.pmod(p, F.lit(table.slots)), lambda x: F.when(F.get(keys, x) == p, F.get(merged, x)))

        return _let((left - table.middle) * table.base + right, look)

    def merge(state: Column, _: Column) -> Column:
        """One merge: of the lowest rank, the leftmost pair."""
        text, ranks_ = state["text"], state["ranks"]

        def at_lowest(low: Column) -> Column:
            def at(j: Column) -> Column:
                """``j`` is the pair's place from 1."""
                before = rank(F.ascii(F.substring(text, j - 1, F.lit(1))), low)
                after = rank(low, F.ascii(F.substring(text, j + 2, F.lit(1))))
                fewer = F.filter(ranks_, lambda _, k: k != j)
                new = F.transform(fewer, lambda x, k: F.when(k == j - 1, after).otherwise(F.when(k == j - 2, before).otherwise(x)))
                return F.struct(F.overlay(text, F.get(letters, low - 1), j, F.lit(2)).alias("text"), new.alias("ranks"))

            return F.when(low.isNull(), state).otherwise(_let(F.array_position(ranks_, low).cast("int"), at))

        return _let(F.array_min(ranks_), at_lowest)

    def letter_of(number: Column) -> Column:
        # not from ``letters``: each mention of it in the plan would be another array of them all
        return F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")

    def pair_list(text: Column, found: Column) -> Column:
        """Of pairs of letters (strings of two): those that merge, as (rank, pair)."""

        def with_rank(p: Column) -> Column:
            return F.struct(rank(F.ascii(p), F.ascii(F.substring(p, 2, 1))).alias("rank"), p.alias("pair"))

        return F.filter(F.transform(F.array_distinct(found), with_rank), lambda p: p["rank"].isNotNull())

    def merge_all(state: Column, _: Column) -> Column:
        """All merges of the lowest pair; or only the leftmost, where a new pair has a lower rank or another pair the same."""
        text, pairs = state["text"], state["pairs"]

        def at_lowest(low: Column) -> Column:
            return F.when(low.isNull(), state).otherwise(_let(letter_of(low["rank"]), lambda letter: merged_at(low, letter)))

        def merged_at(low: Column, letter: Column) -> Column:
            def neighbours(new: Column) -> Column:
                before = F.regexp_extract_all(new, F.concat(F.lit("(?<=([\\s\\S]))"), letter), F.lit(1))
                after = F.regexp_extract_all(new, F.concat(letter, F.lit("(?=([\\s\\S]))")), F.lit(1))
                return F.concat(F.transform(F.array_distinct(before), lambda x: F.concat(x, letter)), F.transform(F.array_distinct(after), lambda x: F.concat(letter, x)))

            def next_state(new: Column, old: Column) -> Column:
                return F.struct(new.alias("text"), F.array_distinct(F.concat(old, pair_list(new, neighbours(new)))).alias("pairs"))

            alike = F.exists(pairs, lambda p: (p["rank"] == low["rank"]) & (p["pair"] != low["pair"]))

            def leftmost() -> Column:
                ways = F.transform(F.filter(pairs, lambda p: p["rank"] == low["rank"]), lambda p: F.instr(text, p["pair"]))
                # pairs that are gone have no place
                return _let(F.array_min(F.filter(ways, lambda i: i > 0)), lambda at: F.when(at.isNull(), F.struct(text.alias("text"), F.filter(pairs, lambda p: p["rank"] != low["rank"]).alias("pairs"))).otherwise(next_state(F.overlay(text, letter, at, F.lit(2)), pairs)))

            def checked(new: Column) -> Column:
                lower = F.exists(new["pairs"], lambda p: p["rank"] < low["rank"])
                return F.when(lower, leftmost()).otherwise(new)

            others = F.filter(pairs, lambda p: p["pair"] != low["pair"])
            every = _let(F.replace(text, low["pair"], letter), lambda new: next_state(new, others))
            return F.when(alike, leftmost()).otherwise(_let(every, checked))

        return _let(F.array_min(pairs), at_lowest)

    def encode_long(word: Column) -> Column:
        text = F.array_join(F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: letter_of(F.get(single, F.ascii(c)))), "")

        def fold(t: Column) -> Column:
            start = F.struct(t.alias("text"), pair_list(t, F.regexp_extract_all(t, F.lit("(?=([\\s\\S]{2}))"), F.lit(1))).alias("pairs"))
            # each step takes a pair off the list, of at most 3 n ever made, or merges one place, of at most n
            return F.aggregate(F.sequence(F.lit(1), 4 * F.length(t)), start, merge_all)["text"]

        return _let(text, fold)

    def encode(word: Column) -> Column:
        return F.when(F.octet_length(word) > LONG, encode_long(word)).otherwise(encode_short(word))

    def encode_short(word: Column) -> Column:
        # ISO-8859-1 makes one character of each byte
        first_letters = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(single, F.ascii(c)))

        def fold(first: Column) -> Column:
            text = F.array_join(F.transform(first, lambda i: F.get(letters, i - 1)), "")
            pairs = F.transform(first, lambda x, k: rank(x, F.get(first, k + 1)))
            return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(first), F.lit(2))), F.struct(text.alias("text"), pairs.alias("ranks")), merge)["text"]

        return _let(first_letters, fold)

    encode.short, encode.long = encode_short, encode_long
    return encode


class Words:
    """Encoded words: how many ids each has, the ids in decimal, and the bytes they decode to."""

    def __init__(self, letters: list[str], pieces: list[bytes]) -> None:
        self.count = np.fromiter(map(len, letters), dtype=np.int64, count=len(letters))
        every = (np.frombuffer("".join(letters).encode("utf-32-le"), dtype="<u4").astype(np.int64) - SHIFT).tolist()
        texts, blobs = [str(i) for i in range(len(pieces))], pieces
        self.decimal, self.decoded, at = [], [], 0
        for n in self.count.tolist():
            own = every[at : at + n]
            at += n
            self.decimal.append(",".join([texts[i] for i in own]))
            self.decoded.append(b"".join([blobs[i] for i in own]))


class Numbers(dict):
    """Numbers words by their first occurrence."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def ascii_finder(pattern: str):
    """The pattern's ``findall`` for ASCII texts, by ``re``, which is faster than ``regex``; None if it says more than ``re`` can."""
    made, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\[\s\S]|[\s\S]", pattern):
        inside = part == "[" or inside and part != "]"
        own = {"\\p{L}": "A-Za-z", "\\p{N}": "0-9"}.get(part)
        made.append(part if own is None else own if inside else f"[{own}]")
    try:
        # of ASCII, white space is the same six characters for both
        return re.compile("".join(made), re.ASCII).findall
    except re.error:
        return None


class Splitter:
    """The matches of a pattern as numbers of distinct words, in the order they were first seen."""

    def __init__(self, pattern: str, known: dict[str, int]) -> None:
        self.find = regex.compile(pattern).findall
        self.find_ascii = ascii_finder(pattern) or self.find
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.number, self.given = Numbers(self.known), len(self.known)

    def new_words(self) -> list[str]:
        """The words since this was last asked."""
        start, self.given = self.given, len(self.number)
        return list(islice(self.number, start, None))

    def codes(self, blob: bytes | None) -> np.ndarray:
        found = (self.find_ascii if blob.isascii() else self.find)(blob.decode("utf-8", "replace")) if blob else ()
        return np.fromiter(map(self.number.__getitem__, found), dtype=np.int32, count=len(found))


def _packed(texts: list[str]) -> tuple[str, np.ndarray]:
    """Strings as one, with their lengths: a list of them would be many objects in every worker."""
    return "".join(texts), np.array(list(map(len, texts)), dtype=np.int32)


def _unpacked(packed: tuple[str, np.ndarray]) -> list[str]:
    text, lengths = packed
    ends = np.cumsum(lengths).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def frequent_words(df: DataFrame, encode, pattern: str, docs: int, most: int) -> tuple[list[str], list[str]]:
    """(words, their letters): words that occur twice or more in a bounded sample, the most frequent first.

    They are a cache, encoded once by the same fold; words that it lacks are encoded where
    they occur, so the sample changes no result.
    """

    def count(batches):
        for b in batches:
            split, found = Splitter(pattern, {}), []
            for v in b.column(0):
                found.append(split.codes(v.as_py()))
            if found:
                n = np.bincount(np.concatenate(found), minlength=len(split.number))
                yield pa.RecordBatch.from_arrays([pa.array(split.new_words(), pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    sample = lowest_hashes(df, F.xxhash64("doc_id", "text"), docs, df.count()).select("text")
    counts = sample.repartition(8).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # a word longer than this would make the cache's size unknown
    top = counts.where((F.col("n") > 1) & (F.length("word") <= 64)).orderBy(F.desc("n"), "word").limit(most)
    got = top.repartition(12).select("word", encode(F.col("word")).alias("letters")).toArrow()
    return got.column(0).to_pylist(), got.column(1).to_pylist()


def _bundles(pattern: str, cached, max_words: int, max_codes: int, keep_words: int):
    """Arrow step: rows (doc_id, text) to bundles (ids, word numbers of each text, new words, whether the numbers begin anew)."""

    def run(batches):
        known = {w: i for i, w in enumerate(_unpacked(cached.value))}
        split, ids, codes, total, anew = Splitter(pattern, known), [], [], 0, True

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.binary())), pa.array([split.new_words()], pa.list_(pa.string())), pa.array([anew])], ["ids", "codes", "words", "anew"])

        for b in batches:
            for i, v in zip(b.column(0), b.column(1), strict=True):
                found = split.codes(v.as_py())
                ids.append(i.as_py())
                codes.append(found.tobytes())
                total += len(found)
                if len(split.number) - split.given >= max_words or total >= max_codes:
                    yield flush()
                    ids, codes, total, anew = [], [], 0, len(split.number) - len(known) >= keep_words
                    if anew:
                        split.clear()
        if ids:
            yield flush()

    return run


_cached: dict[str, Words] = {}


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1 << 16, max_codes: int = 1 << 21, keep_words: int = 1 << 18, cache_docs: int = 8000, cache_words: int = 1 << 18, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; ``with_ids`` adds the ids and the decoded bytes."""
    small_batches(df.sparkSession)
    ranks = load_ranks(ranks_path)
    encode = word_encoder(ranks)
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    words, letters = frequent_words(slim, encode, pattern, cache_docs, cache_words)
    key = uuid.uuid4().hex
    context = df.sparkSession.sparkContext
    shared = context.broadcast((_packed(letters), pieces))
    bundles = slim.mapInArrow(_bundles(pattern, context.broadcast(_packed(words)), max_words, max_codes, keep_words), "ids array<bigint>, codes array<binary>, words array<string>, anew boolean")
    encoded = bundles.select("ids", "codes", F.transform("words", encode).alias("words"), "anew")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def digest(batches):
        if key not in _cached:
            _cached.clear()
            _cached[key] = Words(_unpacked(shared.value[0]), shared.value[1])
        cache = _cached[key]
        n, decimal, decoded, count = len(cache.count), cache.decimal, cache.decoded, cache.count
        for b in batches:
            for r in range(b.num_rows):
                own = Words(b.column(2)[r].values.to_pylist(), shared.value[1])
                # the cache's lists grow by the task's words, and shrink again
                if b.column(3)[r].as_py():
                    del decimal[n:], decoded[n:]
                    count = cache.count
                decimal += own.decimal
                decoded += own.decoded
                count = np.concatenate([count, own.count])
                rows = []
                for i, c in zip(b.column(0)[r].as_py(), b.column(1)[r].values, strict=True):
                    codes = np.frombuffer(c.as_buffer(), dtype=np.int32)
                    at = codes.tolist()
                    whole = b"".join(map(decoded.__getitem__, at))
                    listed = ",".join(map(decimal.__getitem__, at))
                    extra = [list(map(int, listed.split(","))) if listed else [], whole] if with_ids else []
                    rows.append((i, int(count[codes].sum()), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(whole).hexdigest(), *extra))
                    if len(rows) >= 2000 or with_ids and len(rows) >= 100:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32()), pa.binary()] * with_ids]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return encoded.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids)
