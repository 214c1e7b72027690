"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables are composed by rule: 19 leading, 21 vowel and 27 trailing letters.
SYLLABLE, LEADING, VOWEL, TRAILING, VOWELS, TRAILINGS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28
#: White space as Unicode has it that compatibility forms leave as it is.
SPACES = r"[\t-\r\x1c-\x20\x85\u1680\u2028\u2029]"


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, tuple[str, ...], tuple[str, ...]]:
    """From the Unicode tables: characters that fold to one character or to none, in that order, with what they fold to; and those that fold to several, with these."""
    one, none, many = {}, [], {}
    for code in [*range(0x80, SYLLABLE), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)]:
        c = chr(code)
        to = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not to:
            none.append(c)
        elif len(to) > 1:
            many[c] = to
        elif to != c:
            one[c] = to
    return "".join(one) + "".join(none), "".join(one.values()), tuple(many), tuple(many.values())


def fold(c: Column) -> Column:
    """Compatibility forms (NFKD) without combining marks, of any script; all in the JVM.

    All marks go, so their canonical order doesn't matter and characters fold one by one. Text in
    ASCII is left as it is. Characters that fold to one or none are translated; only texts
    that hold others are taken apart.
    """
    source, target, wide, wider = _foldings()
    held = "".join(wide)
    values = F.split(F.lit("\x00".join(wider)), "\x00")

    def apart(x: Column) -> Column:
        code, at = F.ascii(x) - SYLLABLE, F.instr(F.lit(held), x)
        tail = code % TRAILINGS
        jamo = lambda first, k, n: F.element_at(F.split(F.lit("".join(chr(first + i) for i in range(n))), ""), k.cast("int") + 1)
        syllable = F.concat(jamo(LEADING, F.floor(code / (VOWELS * TRAILINGS)), 19), jamo(VOWEL, F.floor(code % (VOWELS * TRAILINGS) / TRAILINGS), VOWELS), F.when(tail > 0, jamo(TRAILING, tail, TRAILINGS)).otherwise(""))
        return F.when(x <= "\x7f", x).when((x >= "\uac00") & (x <= "\ud7a3"), syllable).when(at > 0, F.element_at(values, at)).otherwise(x)

    several = F.array_join(F.transform(F.split(c, ""), apart), "")
    ranges = _ranges(wide)
    opened = F.when(c.rlike(f"[\uac00-\ud7a3{ranges}]"), several).otherwise(c)
    return F.when(c.rlike("[^\\x00-\\x7f]"), F.translate(opened, source, target)).otherwise(c)


def _ranges(chars: tuple[str, ...]) -> str:
    """The characters as ranges of a pattern's class."""
    out: list[list[int]] = []
    for code in map(ord, chars):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACES}+", " "))


def upper_norm(c: Column) -> Column:
    return squeeze(F.upper(fold(F.coalesce(c, F.lit("")))))


def lower_norm(c: Column) -> Column:
    return squeeze(fold(F.lower(F.coalesce(c, F.lit("")))))


def compact(c: Column) -> Column:
    """Letters a-z and digits only."""
    return F.regexp_replace(lower_norm(c), "[^a-z0-9]", "")


def key(c: Column) -> Column:
    """An identifier as text: trimmed, without a decimal .0, blank as null; leading zeros stay."""
    return F.nullif(F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0+$", "$1"), F.lit(""))


def before(c: Column, pattern: str) -> Column:
    """What stands before the first match."""
    return F.split(c, pattern, 2)[0]


def matches(c: Column, pattern: str) -> Column:
    """What stands between a pattern's matches, and the matches, from left to right; empty where there is none. Most texts lack most patterns, which costs one search to see."""
    found = F.struct(F.split(c, pattern, -1).alias("gaps"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.array().cast("array<string>")
    return F.when(c.rlike(pattern), found).otherwise(F.struct(none.alias("gaps"), none.alias("found")))


def placed(m: Column) -> Column:
    """Of matches(): an array of (start, hit); start counts characters from 1."""
    empty = F.array().cast("array<struct<start:int,hit:string>>")
    # The end of what has been passed, and the hits so far.
    begin = F.struct(F.lit(0).alias("end"), empty.alias("hits"))

    def step(state: Column, x: Column) -> Column:
        start = state["end"] + F.length(x["gap"]) + 1
        one = F.struct(start.alias("start"), x["hit"].alias("hit"))
        return F.struct((start + F.length(x["hit"]) - 1).alias("end"), F.concat(state["hits"], F.array(one)).alias("hits"))

    pairs = F.zip_with(F.slice(m["gaps"], 1, F.size(m["found"])), m["found"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, begin, step, lambda state: state["hits"])


def hits(c: Column, pattern: str) -> Column:
    """A pattern's matches with their places. The pattern matches no empty text."""
    return placed(matches(c, pattern))


def masked(c: Column, pattern: str, keep: int = 0) -> Column:
    """Matches of a pattern blotted out, each character but white space by an underscore, so that what follows keeps its place; with keep, a group at the match's beginning stays."""
    between, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def blot(hit: Column) -> Column:
        kept = F.regexp_extract(hit, f"^(?:{pattern})", keep) if keep else F.lit("")
        return F.concat(kept, F.regexp_replace(F.substring(hit, F.length(kept) + 1, F.length(hit)), r"\S", "_"))

    both = F.zip_with(between, found, lambda g, h: F.concat(g, F.when(h.isNotNull(), blot(h)).otherwise("")))
    return F.when(c.rlike(pattern), F.array_join(both, "")).otherwise(c)


def escaped(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula, made plain."""
    return F.when(c.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), c)).otherwise(c)


def day(c: Column) -> Column:
    """d/m/yyyy or yyyy-mm-dd text as a date; anything else is null."""
    return F.coalesce(F.try_to_date(c, "d/M/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def serial_day(c: Column, low: int = 30000, high: int = 80000) -> Column:
    """A spreadsheet's day number as a date, if it is plausible."""
    n = c.try_cast("int")
    return F.when(n.between(low, high), F.date_add(F.lit("1899-12-30").cast("date"), n))


def numbers_in(c: Column, pattern: str) -> Column:
    """The numbers that a pattern's first group finds, in order; numbers beyond 64 bits as the largest there is."""
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.coalesce(x.try_cast("long"), F.lit((1 << 63) - 1)))


def missing_numbers(found: Column, most: int = 100_000, shown: int = 200) -> Column:
    """Numbers of 1..max that aren't there, the first `shown`; null beyond `most`."""
    top = F.array_max(found).cast("long")
    gaps = F.array_except(F.sequence(F.lit(1).cast("long"), F.when(top.between(1, most), top).otherwise(1)), found.cast("array<bigint>"))
    return F.when(top.between(1, most), F.slice(gaps, 1, shown))
