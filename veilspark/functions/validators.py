"""Checks of identifier candidates, by name: Column of text -> Column of boolean, never null for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    d = _digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    """Multiplication in the dihedral group of ten elements, and the permutation's first eight powers."""
    mul = [[(a + b) % 5 if a < 5 and b < 5 else (a + b) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed values: the check's permutation
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([base[x] for x in powers[-1]])
    return mul, powers


def verhoeff(text: Column) -> Column:
    """Twelve digits, the first of them 2 to 9, with a valid check digit."""
    mul, powers = verhoeff_tables()
    m, p = F.array(*(F.lit(x) for row in mul for x in row)), F.array(*(F.lit(x) for row in powers for x in row))
    d = _digits(text)
    value = lambda i: F.substring(d, F.lit(13) - i, F.lit(1)).cast("int")
    check = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda c, i: F.get(m, c * 10 + F.get(p, F.pmod(i - 1, F.lit(8)) * 10 + value(i))))
    return F.when(d.rlike("^[2-9][0-9]{11}$"), F.coalesce(check, F.lit(1)) == 0).otherwise(False)


def pan(text: Column) -> Column:
    return text.rlike("^[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]$")


def phone(text: Column) -> Column:
    """Ten digits from 2 to 9 on, or eleven after a 0, or twelve after 91; no repeated single digit, no
    round 00000 end, fewer than two groups that look like years."""
    d, n = _digits(text), F.length(_digits(text))
    years = F.size(F.filter(F.split(text, r"[\s\-()+]+"), lambda t: t.rlike("^(19|20)[0-9]{2}$")))
    shape = ((n == 10) & d.rlike("^[2-9]")) | ((n == 11) & d.rlike("^0")) | ((n == 12) & d.rlike("^91"))
    return shape & ~d.rlike("^([0-9])\\1*$") & (years < 2) & ~d.endswith("00000")


def ssn(text: Column) -> Column:
    return text.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def ip(text: Column) -> Column:
    four = F.forall(F.split(text, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) <= 255)
    return F.when(text.contains(":"), text.rlike("^(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}$")).otherwise(text.rlike(r"^\d+(\.\d+){3}$") & four)


def din(text: Column) -> Column:
    return text.rlike("^[0-9]{8}$") & ~text.rlike("^([0-9])\\1*$")


VALIDATORS = {"luhn": luhn, "verhoeff": verhoeff, "pan": pan, "phone": phone, "ssn": ssn, "ip": ip, "din": din}
