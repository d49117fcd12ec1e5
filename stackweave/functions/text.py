"""Text functions: the analyzer, term matching, excerpts, anchors, fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

EXCERPT_CHARS = 240
WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")
# Code points that are indexed in pairs.
CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x3040, 0x30FF), (0xAC00, 0xD7AF))
CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
RUNS = regex.compile(f"[{CJK}]+|[^{CJK}]+")
IS_CJK = regex.compile(f"[{CJK}]")
CJK_AND_WORD = regex.compile(rf"[\p{{Alphabetic}}\p{{N}}{CJK}]+")
#: Letters that NFKC leaves as they are; texts of these and ASCII stay in the JVM.
PLAIN = r"^[\x00-\x7FÀ-įĴ-ľŁ-ňŊ-ž]*$"


def analyze(text: str | None) -> list[str]:
    """Distinct terms in order: NFKC, lower case, words; runs of CJK in overlapping pairs."""
    out: dict[str, None] = {}
    for piece in CJK_AND_WORD.findall(unicodedata.normalize("NFKC", text or "").lower()):
        for run in RUNS.findall(piece):
            if IS_CJK.match(run) and len(run) > 1:
                out.update(dict.fromkeys(run[i : i + 2] for i in range(len(run) - 1)))
            else:
                out[run] = None
    return list(out)


@F.pandas_udf(ArrayType(StringType()))
def _analyze(texts: pd.Series) -> pd.Series:
    return texts.map(analyze)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC of a text; Latin texts, which it leaves as they are, stay in the JVM."""
    plain = text.rlike(PLAIN)
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def terms(text: Column) -> Column:
    """The analyzer's terms.  Latin texts are analysed by JVM functions, others by an Arrow batch; null has none."""
    value = F.coalesce(text, F.lit(""))
    plain = value.rlike(PLAIN)
    fast = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}]+"), 0))
    # rows of the fast path reach Python as null, not as text
    return F.when(plain, fast).otherwise(_analyze(F.when(~plain, value)))


def latin_terms(text: Column) -> Column:
    """The analyzer for texts that are known to be Latin, without any Python."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))


def matched_terms(query: list[str], indexed: Column) -> Column:
    """The query's terms that are indexed, in the query's order."""
    return F.filter(F.array(*map(F.lit, query)), lambda t: F.array_contains(indexed, t))


def all_match(query: list[str], indexed: Column) -> Column:
    return F.size(matched_terms(query, indexed)) == len(query)


def excerpt(text: Column, query: list[str], chars: int = EXCERPT_CHARS) -> Column:
    """``chars`` characters from a third before the first query term on, with ellipses where text is left out.

    All places are characters, and a text shorter than the place found is clamped.
    """
    value = F.coalesce(text, F.lit(""))
    places = F.filter(F.array(*[F.instr(F.lower(value), t) for t in query]), lambda p: p > 0)
    anchor = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start = F.greatest(anchor - chars // 3, F.lit(0))
    end = F.least(start + chars, F.length(value))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(value, (start + 1).cast("int"), (end - start).cast("int")), F.when(end < F.length(value), "…").otherwise(""))


def contains_text(column: Column, text: str) -> Column | None:
    """Case-insensitive literal search; a blank text is no filter."""
    if not text.strip():
        return None
    quoted = text.replace("\\E", "\\E\\\\E\\Q")
    return column.rlike(f"(?iu)\\Q{quoted}\\E")


def occurrences(text: Column, pattern: Column) -> Column:
    """How often a pattern occurs without overlap; an empty pattern never does."""
    removed = F.length(text) - F.length(F.replace(text, pattern, F.lit("")))
    return F.when(F.length(pattern) == 0, F.lit(0)).otherwise((removed / F.length(pattern)).cast("int"))


def location(text: Column, selected: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    """(state, place): NotFound, Found with the place in characters from 0, or Ambiguous."""
    pattern = F.concat(prefix if prefix is not None else F.lit(""), selected, suffix if suffix is not None else F.lit(""))
    n = occurrences(text, pattern)
    state = F.when(n == 0, "NotFound").when(n == 1, "Found").otherwise("Ambiguous")
    return F.struct(state.alias("state"), F.when(n == 1, F.instr(text, pattern) - 1).alias("place"))


def fingerprint(title: Column, authors: Column, tags: Column) -> Column:
    """SHA-256 over the title, the authors and the tags with their separators."""
    zero = F.unhex(F.lit("00"))

    def ended(values: Column) -> Column:
        return F.aggregate(values, F.unhex(F.lit("")), lambda a, v: F.concat(a, F.encode(v, "UTF-8"), zero))

    return F.sha2(F.concat(F.encode(title, "UTF-8"), zero, ended(authors), F.unhex(F.lit("FF")), ended(tags)), 256)


def abstract_text(inverted: Column) -> Column:
    """The text of a map word -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.concat_ws(" ", F.transform(F.array_sort(pairs), lambda x: x["w"])), F.lit(""))
