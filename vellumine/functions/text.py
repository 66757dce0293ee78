"""Column functions on text: white space, lines, numbers, names, paths. All row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of Unicode white space; ``\s`` alone misses some of it.
WS = r"[\s\x{0B}\x{85}\p{Z}]+"
#: Scripts that are written without spaces.
CJK = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable instead of a repeated expression."""
    return F.transform(F.array(value), body)[0]


def utrim(x: Column) -> Column:
    """``x`` without white space at either end."""
    return F.regexp_replace(x, rf"^{WS}|{WS}$", "")


def collapse(x: Column) -> Column:
    """White space runs become one space, ends are trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(x, WS, " ")), F.lit(""))


def normal_newlines(x: Column) -> Column:
    """CRLF, CR, NEL and the two Unicode separators become LF; a leading byte-order mark goes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^\\x{FEFF}", ""), r"\r\n?", "\n"), r"[\x{85}\x{2028}\x{2029}]", "\n")


def newline_changes(x: Column) -> Column:
    """How many line ends ``normal_newlines`` changes."""
    return F.regexp_count(x, F.lit(r"\r\n?|[\x{85}\x{2028}\x{2029}]"))


def lines(x: Column) -> Column:
    """The lines of a text with normal newlines; a last newline ends the last line. Empty text has none."""
    text = F.regexp_replace(x, r"\n\z", "")
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def is_blank(x: Column) -> Column:
    return ~x.rlike(r"[^\s\x{0B}\x{85}\p{Z}]")


def ordered_distinct(x: Column) -> Column:
    """The entries of an array but empty ones, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(x, lambda v: v.isNotNull() & (v != "")))


def normal_list(x: Column) -> Column:
    """``ordered_distinct`` after collapsing white space."""
    return F.array_distinct(F.filter(F.transform(x, collapse), lambda v: v.isNotNull()))


def append_unique(x: Column, more: Column) -> Column:
    """``x`` with those entries of ``more`` that it lacks, ASCII case aside."""
    def add(out: Column, v: Column) -> Column:
        return F.when(F.exists(out, lambda o: ascii_lower(o) == ascii_lower(v)), out).otherwise(F.concat(out, F.array(v)))

    return F.aggregate(more, x, add)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def language_tag(x: Column) -> Column:
    """A language tag with usual casing: language lower, Script title, REGION upper; ``_`` counts as ``-``."""
    parts = F.split(F.replace(F.trim(x), F.lit("_"), F.lit("-")), "-")

    def cased(p: Column, i: Column) -> Column:
        return (
            F.when(i == 0, F.lower(p))
            .when((F.length(p) == 4) & p.rlike("^[A-Za-z]+$"), F.concat(F.upper(F.left(p, F.lit(1))), F.lower(p.substr(F.lit(2), F.length(p)))))
            .when((F.length(p) == 2) & p.rlike("^[A-Za-z]+$"), F.upper(p))
            .otherwise(F.lower(p))
        )

    return F.nullif(F.array_join(F.filter(F.transform(parts, cased), lambda p: p != ""), "-"), F.lit(""))


def sort_key(sort_title: Column, title: Column) -> Column:
    """The lower-cased, trimmed title that lists are ordered by."""
    return F.lower(utrim(F.coalesce(sort_title, title, F.lit(""))))


def safe_path(x: Column) -> Column:
    """A relative path without ``.`` and empty parts; null if it is empty, absolute or climbs with ``..``."""
    parts = F.filter(F.split(F.replace(x, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    bad = F.startswith(x, F.lit("/")) | F.startswith(x, F.lit("\\")) | x.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def roman(x: Column) -> Column:
    """The value of a Roman numeral from 1 to 3999, read leniently; null for anything else."""
    value = F.create_map(*[F.lit(v) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in pair])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))

    def add(s: Column, c: Column) -> Column:
        v = value[c]
        return F.struct(F.when(v < s["last"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), F.greatest(v, s["last"]).alias("last"))

    total = F.aggregate(F.reverse(F.split(F.upper(x), "")), start, add, lambda s: s["sum"])
    return F.when(x.rlike("^[IVXLCDMivxlcdm]{1,15}$") & total.between(1, 3999), total)


_HAN_DIGITS = "〇零一二三四五六七八九两"
_HAN_VALUES = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 2)


def chinese_number(x: Column) -> Column:
    """The value of a Chinese numeral: digits in place notation or with 十 百 千 万; null for anything else."""
    values = F.create_map(*[F.lit(v) for c, n in zip(_HAN_DIGITS, _HAN_VALUES) for v in (c, n)])
    units = F.create_map(*[F.lit(v) for pair in (("十", 10), ("百", 100), ("千", 1000), ("万", 10000)) for v in pair])
    chars = F.split(x, "")
    place = F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n * 10 + values[c])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("digit"))

    def add(s: Column, c: Column) -> Column:
        unit, d = units[c], values[c]
        one = F.when(s["digit"] < 0, F.when(c == "十", 1).otherwise(0)).otherwise(s["digit"])
        big = F.struct((s["total"] + (s["part"] + F.greatest(s["digit"], F.lit(0))) * 10000).alias("total"), F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("digit"))
        small = F.struct(s["total"].alias("total"), (s["part"] + one * unit).alias("part"), F.lit(-1).cast("long").alias("digit"))
        plain = F.struct(s["total"].alias("total"), s["part"].alias("part"), d.cast("long").alias("digit"))
        return F.when(c == "万", big).when(unit.isNotNull(), small).otherwise(plain)

    spelled = F.aggregate(chars, start, add, lambda s: s["total"] + s["part"] + F.greatest(s["digit"], F.lit(0)))
    han = x.rlike(f"^[{_HAN_DIGITS}十百千万]{{1,12}}$")
    return F.when(han, F.when(x.rlike(f"^[{_HAN_DIGITS}]+$"), place).otherwise(spelled)).cast("int")


_ENGLISH = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def number(x: Column) -> Column:
    """A chapter number: decimal, else Roman, else English one to ten, else Chinese; null if none of these."""
    english = F.create_map(*[F.lit(v) for i, w in enumerate(_ENGLISH) for v in (w, i + 1)])

    def value(plain: Column) -> Column:
        return F.coalesce(F.when(plain.rlike("^[0-9]{1,9}$"), plain.cast("int")), roman(plain), english[F.lower(plain)], chinese_number(plain))

    return let(F.translate(utrim(x), "０１２３４５６７８９", "0123456789"), value)


def natural_key(x: Column) -> Column:
    """A string whose plain order is the natural order of names: digit runs by value, case aside.

    Runs of up to six digits of length are padded to their significant
    digits; of equal values the one with more leading zeros comes first.
    """
    runs = F.regexp_extract_all(F.lower(x), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def keyed(r: Column) -> Column:
        digits = F.regexp_replace(r, "^0+(?=.)", "")
        return F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits, F.lpad((999_999 - F.length(r)).cast("string"), 6, "0"))).otherwise(r)

    return F.concat(F.array_join(F.transform(runs, keyed), ""), F.lit("\x00"), F.lower(x), F.lit("\x00"), x)
