"""Column functions on texts: match offsets, context, keys, keyed hashes. All built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,text:string>>"


def unicode_pattern(pattern: str) -> str:
    r"""``\d \s \w \b`` over all of Unicode, as in most regex engines but Java's."""
    return f"(?U){pattern}"


def find_all(text: Column, pattern: str | Column) -> Column:
    """All non-empty matches with code-point offsets from 0. One replacement sets the matches off from what
    stands between them, and offsets are running sums over the pieces, so nothing is searched twice."""
    literal = isinstance(pattern, str)
    p = F.lit(unicode_pattern(pattern)) if literal else pattern
    none = F.array().cast(MATCHES)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a.at + F.length(x)
        found = F.concat(a.out, F.array(F.struct(a.at.alias("start"), end.alias("end"), x.alias("text"))))
        return F.struct(end.alias("at"), (~a.match).alias("match"), F.when(a.match, found).otherwise(a.out).alias("out"))

    # A text that holds the mark itself is split at the matches, which are searched for once more.
    pairs = F.zip_with(F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda g, m: F.array(g, m))
    marked = lambda m: F.when(F.contains(m, F.lit("\0")), F.aggregate(F.split(m, "\0", -1), zero, step).out).otherwise(none)
    apart = F.aggregate(F.filter(F.flatten(pairs), lambda x: x.isNotNull()), zero, step).out
    return F.when(F.contains(text, F.lit("\0")), apart).otherwise(let(F.regexp_replace(text, p, F.lit("\0$0\0")), marked))


def digit_guarded(text: Column, start: Column, end: Column) -> Column:
    """Neither neighbour of the match is a digit."""
    return ~F.coalesce(F.when(start > 0, F.substring(text, start, F.lit(1))).rlike(r"(?U)\d"), F.lit(False)) & ~F.coalesce(F.substring(text, end + 1, F.lit(1)).rlike(r"(?U)\d"), F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def casefold(text: Column) -> Column:
    """Lower case, with the one frequent expansion of case folding."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def phrase_pattern(words: tuple[str, ...] | list[str]) -> str:
    escaped = [r"".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in w.lower()) for w in words]
    return r"(?U)\b(?:" + "|".join(escaped) + r")\b"


def has_context(text: Column, start: Column, end: Column, words: tuple[str, ...], scope: int | str) -> Column:
    """A context word stands, whole, within ``scope`` characters of the span, or anywhere on the page."""
    if not words:
        return F.lit(False)
    if isinstance(scope, str):
        around = text
    else:
        first = F.greatest(start - scope, F.lit(0))
        around = F.substring(text, first + 1, end + scope - first)
    return F.lower(around).rlike(phrase_pattern(words))


def name_tokens(text: Column, honorifics: tuple[str, ...]) -> Column:
    """Tokens without outer punctuation; titles and bare punctuation are left out."""
    cores = F.transform(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)^\W+", ""), r"(?U)\W+$", ""))
    return F.filter(cores, lambda t: (t != "") & ~casefold(F.rtrim(t, F.lit("."))).isin(list(honorifics)))


def hmac_hex(key: str, message: Column) -> Column:
    """HMAC-SHA256 of the UTF-8 message, as lower-case hex. The key is known on the driver."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def seed_number(hex_digest: Column, modulus: int, draw: int = 0) -> Column:
    """A number below ``modulus`` from hex digits 15*draw.. of a digest (60 bits of it)."""
    return F.pmod(F.conv(F.substring(hex_digest, 15 * draw + 1, 15), 16, 10).cast("long"), F.lit(modulus))


def words_before(text: Column, at: Column) -> Column:
    """How many words of a single-spaced text end before offset ``at``."""
    head = F.substring(text, F.lit(1), at)
    return (F.length(head) - F.length(F.replace(F.replace(head, F.lit(" ")), F.lit("\n")))).cast("int")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
