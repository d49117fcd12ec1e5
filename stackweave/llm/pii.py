"""PII: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Personal numbers, dates and addresses are found by one pattern, validated (Luhn digit,
octets up to 255, calendar dates, issued social security ranges) and permuted with a key
within their format; what fails validation stays.  Of a run of digit groups every sub-run of whole
groups is tried as a card.  Equal values get equal pseudonyms in
every document, so records stay linked, and different values of a format get different ones.

- Phone, card and social security numbers and mailbox names: a Feistel network over the two
  halves of the value's letters and digits; a round shifts each character within its class
  (digit, lower, upper) by a byte of SHA-256(key, kind, round, other half).  Separators stay.
  A card's last digit is the Luhn digit of the new number; a phone's country code and an
  address's domain stay.
- IPv4 addresses: a Feistel network over two halves of 16 bits.
- Dates: a Feistel network over the day numbers of the date's era (300 x 320 days from
  1850-01-01 on, all days before, all after), in the same layout.  ``01/02/2024`` is a date
  by month and day or by day and month, so dates with slashes are permuted as strings, among
  all that are a date in either way.  Where a network's numbers are more than the valid
  ones, it is applied until it gives a valid one (cycle walking), which is a permutation too.
- Phone numbers have no check digit; whatever has their layout counts.

Nulls: a null text stays null, and nothing is found in it.  Rows that repeat get equal
results.  All columns of the input are kept by :func:`pseudonymize`; the text is replaced.
Texts of any length go through whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ROUNDS = 8
# The formats, by their order in the pattern.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:\d|[ -]\d(?!\d*+\.\d)){12,}+(?!\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
}
PATTERN = "|".join(KINDS.values())
# Runs have no longest size: possessive, so that Java matches them without recursion.
# What else a run of digits may hold; layouts of cards that go before other groupings.
REST = "|".join(v for k, v in KINDS.items() if k not in ("email", "card"))
RUN = r"^\d(?:[ -]?\d){12,}+$"
LAYOUTS = r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5})$"
# A letter before a group says how many groups from there on are a card.
MARKS = "abcdefghijklmnopqrs"
MARKED = "|".join(rf"{c}\d+(?:[ -][a-s]?\d+){{{n}}}" for n, c in enumerate(MARKS))
EPOCH, DAY_HALVES = "1850-01-01", (300, 320)
# Days before and after those, years of dates with slashes: (kind, first, count) of each era.
DAYS_BEFORE, DAYS_AFTER = 675_333, 2_880_726
YEARS = [("slash0", 1, 1849), ("slash1", 1850, 263), ("slash2", 2113, 7887)]
MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Of the numbers of dates with slashes 61 % are valid: 0.39^96 is the chance that so many steps find none.
WALK = 96
CLASSES = {"digit": ("0", 10), "lower": ("a", 26), "upper": ("A", 26)}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    An aggregate of nothing that ends in ``body``: an element of a transformed array would
    work out the body's type anew for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def _digest(key: str, kind: Column | str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, round_.cast("string"), half.cast("string")).cast("binary"), 256)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def _shift(c: Column, by: Column) -> Column:
    """A character moved on within its class; others stay."""
    code = F.ascii(c)

    def moved(name: str) -> Column:
        first, size = CLASSES[name]
        return F.chr((code - ord(first) + by) % size + ord(first))

    return F.when(c.between("0", "9"), moved("digit")).when(c.between("a", "z"), moved("lower")).when(c.between("A", "Z"), moved("upper")).otherwise(c)


def feistel_text(value: Column, key: str, kind: Column | str) -> Column:
    """A permutation of the strings of one layout: classes, length and other characters stay."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))

    def step(s: Column, r: Column) -> Column:
        digest = _digest(key, kind, r, s["b"])

        def shifted(h: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s["a"])), lambda i: _shift(F.substring(s["a"], i, F.lit(1)), _number(F.substring(h, 2 * ((i - 1) % 32) + 1, F.lit(2))))), "")

        return F.struct(s["b"].alias("a"), F.when(F.length(s["a"]) == 0, s["a"]).otherwise(_let(digest, shifted)).alias("b"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(done, lambda s: F.concat(s["a"], s["b"]))


def feistel_number(value: Column, left: int, right: int, key: str, kind: str) -> Column:
    """A permutation of 0 .. left * right - 1."""
    start = F.struct(F.floor(value / right).cast("bigint").alias("a"), (value % right).cast("bigint").alias("b"))

    def step(s: Column, r: Column) -> Column:
        size = F.when(r % 2 == 1, F.lit(left)).otherwise(F.lit(right))
        return F.struct(s["b"].alias("a"), ((s["a"] + _number(F.substring(_digest(key, kind, r, s["b"]), 1, 12))) % size).cast("bigint").alias("b"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(done, lambda s: s["a"] * right + s["b"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts once."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    head = F.substring(m, F.lit(1), F.length(m) - 1)

    def closed(new: Column) -> Column:
        return F.concat(new, (F.pmod(-luhn_sum(F.concat(F.regexp_replace(new, r"\D", ""), F.lit("0"))), F.lit(10))).cast("string"))

    # the separators are not part of the value, so that one number has one pseudonym
    bare = F.regexp_replace(head, r"\D", "")
    return _let(_let(feistel_text(bare, key, "card"), closed), lambda new: _relayout(m, new))


def _relayout(m: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``m``."""
    plain = F.regexp_replace(m, r"\D", "") == m
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.when(plain, digits).otherwise(F.aggregate(F.split(m, ""), state, step)["out"])


def _tail(m: Column, keep: str, key: str, kind: str) -> Column:
    """The digits after the part that matches ``keep`` permuted, in their places."""
    head = F.regexp_extract(m, keep, 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    return F.concat(head, _relayout(rest, feistel_text(F.regexp_replace(rest, r"\D", ""), key, kind)))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    octets = _let(feistel_number(value, 1 << 16, 1 << 16, key, "ip"), lambda v: F.concat_ws(".", *[(F.shiftrightunsigned(v, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.exists(parts, lambda x: x > 255), m).otherwise(octets)


def walked(value: Column, left: int, right: int, key: str, kind: str, valid) -> Column:
    """A permutation of the valid ones of 0 .. left * right - 1; ``value`` is one of them."""
    steps = F.sequence(F.lit(1), F.lit(WALK))
    return F.aggregate(steps, feistel_number(value, left, right, key, kind), lambda v, _: F.when(valid(v), v).otherwise(feistel_number(v, left, right, key, kind)))


def _day(day: Column, key: str) -> Column:
    """A day number from ``EPOCH`` on, permuted within its era."""
    size = DAY_HALVES[0] * DAY_HALVES[1]

    def era(offset: Column, count: int, kind: str) -> Column:
        return walked(offset, (count - 1) // 1700 + 1, 1700, key, kind, lambda v: v < count)

    return (
        F.when(day.between(0, size - 1), feistel_number(day, *DAY_HALVES, key, "date"))
        .when(day < 0, era(day + DAYS_BEFORE, DAYS_BEFORE, "date0") - DAYS_BEFORE)
        .otherwise(era(day - size, DAYS_AFTER, "date2") + size)
    )


def _slash_valid(n: Column, first: int) -> Column:
    """Whether a number names a date by month and day or by day and month."""
    year, a, b = F.floor(n / 961) + first, F.floor(n / 31) % 31 + 1, n % 31 + 1
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))

    def fits(month: Column, day: Column) -> Column:
        length = F.get(F.array(*map(F.lit, MONTHS)), (month - 1).cast("int")) + F.when((month == 2) & leap, 1).otherwise(0)
        return F.coalesce(day <= length, F.lit(False))

    return fits(a, b) | fits(b, a)


def _slashes(m: Column, key: str) -> Column:
    """A date with slashes, permuted among the strings that are one; null if it is none."""
    a, b, year = (F.substring(m, F.lit(at), F.lit(n)).cast("bigint") for at, n in ((1, 2), (4, 2), (7, 4)))

    def era(kind: str, first: int, years: int) -> Column:
        def printed(v: Column) -> Column:
            return F.concat(F.lpad((F.floor(v / 31) % 31 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((v % 31 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.floor(v / 961) + first).cast("string"), 4, "0"))

        n = ((year - first) * 31 + a - 1) * 31 + b - 1
        return _let(n, lambda v: F.when(_slash_valid(v, first), _let(walked(v, 31 * years, 31, key, kind, lambda x: _slash_valid(x, first)), printed)))

    out = F.lit(None).cast("string")
    for kind, first, years in YEARS:
        out = F.when(year.between(first, first + years - 1), era(kind, first, years)).otherwise(out)
    return F.when(a.between(1, 31) & b.between(1, 31), out)


def _date(m: Column, key: str) -> Column:
    def permuted(layout: str) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(layout)).cast("date"), F.lit(EPOCH).cast("date"))
        return _let(day, lambda d: F.when(d.isNotNull(), F.date_format(F.date_add(F.lit(EPOCH).cast("date"), _day(d, key).cast("int")), layout)))

    return F.coalesce(F.when(m.contains("/"), _slashes(m, key)).when(m.contains("-"), permuted("yyyy-MM-dd")).otherwise(permuted("dd.MM.yyyy")), m)


def kind_of(m: Column) -> Column:
    """The format of a match, null if its value is not valid."""
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})$"), F.lit("date"))
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(~F.exists(F.split(m, r"\."), lambda x: x.cast("int") > 255), F.lit("ip")))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$"), F.lit("ssn")))
        .when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.when(luhn_sum(digits) % 10 == 0, F.lit("card")))
        .otherwise(F.lit("phone"))
    )


def pseudonym(m: Column, key: str) -> Column:
    """The keyed pseudonym of a match; the match itself if it is not valid."""
    kind = kind_of(m)

    def permuted(k: Column) -> Column:
        return (
            F.when(k == "email", F.concat(feistel_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1)))
            .when(k == "date", _date(m, key))
            .when(k == "ip", _ip(m, key))
            .when(k == "ssn", _tail(m, "^", key, "ssn"))
            .when(k == "card", _card(m, key))
            .when(k == "phone", _tail(m, r"^\+\d{1,3}", key, "phone"))
            .otherwise(m)
        )

    return _let(kind, permuted)


def _pieces(text: Column, pattern: str) -> Column:
    """What is before each match, and the match; last what is behind, and a null."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))


def _marked(run: Column) -> Column:
    """A run with a letter before each digit group where a card begins.

    Cards are whole groups of 13 to 19 digits with a right Luhn sum: in the usual layouts, or
    else the longest that reach into none of these and hold no date or social security number.
    """

    def marked(groups: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(groups))

        def longest(i: Column, fits) -> Column:
            def card(n: Column) -> Column:
                def valid(t: Column) -> Column:
                    return F.when(t.rlike(r"^\d(?:[ -]?\d){12,18}$") & fits(t, n), luhn_sum(F.regexp_replace(t, r"\D", "")) % 10 == 0).otherwise(False)

                return _let(F.regexp_replace(F.array_join(F.slice(groups, i, n), ""), "^[ -]", ""), valid)

            return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(len(MARKS)), F.size(groups) - i + 1)), card)), F.lit(0))

        def letters(usual: Column) -> Column:
            def mark(i: Column) -> Column:
                def free(t: Column, n: Column) -> Column:
                    return ~t.rlike(KINDS["date"] + "|" + KINDS["ssn"]) & ~F.exists(F.slice(usual, i, n), lambda u: u > 0)

                own = F.get(usual, i - 1)
                n = F.when(own > 0, own).otherwise(longest(i, free))
                group = F.get(groups, i - 1)
                return _let(n, lambda k: F.concat(F.regexp_extract(group, "^[ -]?", 0), F.when(k > 0, F.substring(F.lit(MARKS), k, F.lit(1))).otherwise(""), F.regexp_extract(group, r"\d+", 0)))

            return F.array_join(F.transform(every, mark), "")

        return _let(F.transform(every, lambda i: longest(i, lambda t, n: t.rlike(LAYOUTS))), letters)

    return _let(F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), 0), marked)


def _cut(run: Column) -> Column:
    """The pieces of a run of digits: its cards, and what else is between them."""

    def between(p: Column) -> Column:
        bare = [F.regexp_replace(p[k], "[a-s]", "") for k in ("gap", "hit")]
        return F.concat(_pieces(bare[0], REST), F.array(F.struct(F.lit("").alias("gap"), bare[1].alias("hit"))))

    return F.flatten(F.transform(_let(_marked(run), lambda t: _pieces(t, MARKED)), between))


def found(text: Column) -> Column:
    """The pieces of a text, in order; none where it has no digit and no address."""

    def whole(p: Column) -> Column:
        before = F.array(F.struct(p["gap"].alias("gap"), F.lit(None).cast("string").alias("hit")))
        return F.when(p["hit"].rlike(RUN), F.concat(before, _cut(p["hit"]))).otherwise(F.array(p))

    none = F.array().cast("array<struct<gap:string,hit:string>>")
    return F.when(text.rlike("[0-9@]"), F.flatten(F.transform(_pieces(text, PATTERN), whole))).otherwise(none)


def replaced(text: Column, pieces: Column, values: Column) -> Column:
    """The text with the hits of its pieces replaced by ``values``."""
    return F.when(F.size(pieces) == 0, text).otherwise(F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p["gap"], F.coalesce(v, F.lit("")))), ""))


def pseudonymize(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with its text pseudonymized; all else as it is."""
    text = F.col(text_col)
    new = F.when(text.isNull(), text).otherwise(_let(found(text), lambda m: replaced(text, m, F.transform(m, lambda x: F.when(x["hit"].isNotNull(), pseudonym(x["hit"], key))))))
    return df.withColumn(text_col, new)


def pseudonym_table(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_email, n_date, n_ip, n_ssn, n_card, n_phone, n_changed) for each row."""
    text = F.col(text_col)
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), found(F.coalesce(text, F.lit(""))).alias("__m"))
    pairs = slim.withColumn("__v", F.transform("__m", lambda x: F.when(x["hit"].isNotNull(), F.struct(kind_of(x["hit"]).alias("k"), pseudonym(x["hit"], key).alias("v")))))

    def count(kind: str) -> Column:
        return F.size(F.filter("__v", lambda x: x["k"] == kind)).cast("bigint").alias(f"n_{kind}")

    changed = F.size(F.filter(F.zip_with("__m", "__v", lambda m, v: m["hit"] != v["v"]), lambda c: c)).cast("bigint")
    return pairs.select("doc_id", F.when(F.col("text").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("__m"), F.transform("__v", lambda x: x["v"]))).alias("text"), *map(count, KINDS), changed.alias("n_changed"))
