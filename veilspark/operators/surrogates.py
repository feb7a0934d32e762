"""Surrogates: fakes that are a function of the salt and the real value, and valid in the real one's format.

A keyed hash of the value gives a stream of numbers; each generator spends it on the value's own shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import Settings
from ..functions.text import casefold, hmac_hex, let, seed_number
from ..functions.validators import verhoeff_tables
from ..plans.tables import written
from .entities import normal_key

# Own word lists for fakes.
FIRST_NAMES = ("Avery", "Blake", "Casey", "Devon", "Ellis", "Finley", "Gray", "Harper", "Indigo", "Jules", "Kendall", "Logan", "Morgan", "Noel", "Oakley", "Parker", "Quinn", "Reese", "Sage", "Taylor")
LAST_NAMES = ("Alder", "Birch", "Cedar", "Dale", "Elm", "Fern", "Glen", "Heath", "Ivy", "Juniper", "Knoll", "Linden", "Maple", "North", "Orchard", "Pine", "Quarry", "Ridge", "Spruce", "Thorne")
COMPANY_WORDS = ("Amber", "Beacon", "Copper", "Delta", "Ember", "Falcon", "Garnet", "Harbor", "Ivory", "Jasper", "Keystone", "Lumen", "Meridian", "Nimbus", "Onyx", "Pioneer", "Quartz", "Raven", "Summit", "Topaz")
COMPANY_KINDS = ("Works", "Systems", "Foods", "Textiles", "Motors", "Energy", "Logistics", "Media", "Labs", "Trading")
STREETS = ("Oak", "Mill", "Station", "Garden", "Lake", "Temple", "Market", "Bridge", "Canal", "Hillside")
CITIES = ("Norwick", "Eastham", "Velmora", "Karsted", "Brookfell", "Santavia", "Lindholm", "Torvale", "Ashgrove", "Melbury")
#: Fixed value: legal forms that a fake company keeps.
ORG_SUFFIX = r"(?i)\s*(private limited|pvt\.?\s*ltd\.?|limited|ltd\.?|llp|inc\.?|corporation|corp\.?|plc|trust|bank|&\s*co\.?|and co\.?)\s*$"


def stream(salt: str, key: Column) -> Column:
    """256 hex digits, a function of salt and key."""
    return F.concat(*(hmac_hex(salt, F.concat(key, F.lit(f"|{i}"))) for i in range(4)))


def pick(words: tuple[str, ...], digest: Column, draw: int) -> Column:
    return F.get(F.array(*map(F.lit, words)), seed_number(digest, len(words), draw).cast("int"))


def reshape(text: Column, digest: Column, keep: int | Column = 0) -> Column:
    """The same punctuation with other digits and letters, case by case; the first ``keep`` characters stay."""
    keep = F.lit(keep) if isinstance(keep, int) else keep

    def swap(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(digest, F.pmod(i * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int")
        letter = lambda base: F.char(F.lit(base) + F.pmod(n, F.lit(26)))
        fake = F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike(r"\p{Lu}"), letter(65)).when(c.rlike(r"\p{L}"), letter(97)).otherwise(c)
        return F.when(i < keep, c).otherwise(fake)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def refit(skeleton: Column, chars: Column) -> Column:
    """``chars`` in the letter and digit places of the skeleton."""
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(a: Column, c: Column, chars: Column) -> Column:
        slot = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.when(slot, a.n + 1).otherwise(a.n).alias("n"), F.concat(a.out, F.when(slot, F.substring(chars, a.n + 1, F.lit(1))).otherwise(c)).alias("out"))

    return let(chars, lambda known: F.aggregate(F.split(skeleton, ""), zero, lambda a, c: step(a, c, known)).out)


def alnum(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def digits_of(digest: Column, n: int | Column) -> Column:
    """``n`` digits out of the stream."""
    n = F.lit(n) if isinstance(n, int) else n
    spaced = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.pmod(F.conv(F.substring(digest, i * 2 - 1, F.lit(2)), 16, 10).cast("int"), F.lit(10)).cast("string"))
    return F.substring(F.array_join(spaced, ""), F.lit(1), n)


def _luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` and it valid."""
    n = F.length(body)
    value = lambda i: F.substring(body, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.pmod(value(i) * 2, F.lit(10)) + F.floor(value(i) * 2 / 10).cast("int")).otherwise(value(i))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + doubled(i))
    return F.pmod(-total, F.lit(10)).cast("string")


def _verhoeff_digit(body: Column) -> Column:
    """The digit that makes eleven digits valid."""
    mul, powers = verhoeff_tables()
    m, p = F.array(*(F.lit(x) for row in mul for x in row)), F.array(*(F.lit(x) for row in powers for x in row))
    value = lambda i: F.substring(body, F.lit(12) - i, F.lit(1)).cast("int")
    check = F.aggregate(F.sequence(F.lit(1), F.lit(11)), F.lit(0), lambda c, i: F.get(m, c * 10 + F.get(p, F.pmod(i, F.lit(8)) * 10 + value(i))))
    inverse = [row.index(0) for row in mul]
    return F.get(F.array(*map(F.lit, inverse)), check).cast("string")


def ssn(digest: Column) -> Column:
    area = seed_number(digest, 898, 0) + 1
    area = F.when(area >= 666, area + 1).otherwise(area)  # 001 to 899 without 666
    return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((seed_number(digest, 99, 1) + 1).cast("string"), 2, "0"), F.lpad((seed_number(digest, 9999, 2) + 1).cast("string"), 4, "0"))


def ip(text: Column, digest: Column) -> Column:
    """Addresses of the documentation networks."""
    net = pick(("192.0.2.", "198.51.100.", "203.0.113."), digest, 0)
    four = F.concat(net, (seed_number(digest, 254, 1) + 1).cast("string"))
    groups = [F.lower(F.substring(digest, 5 + 4 * i, 4)) for i in range(6)]
    return F.when(text.contains(":"), F.concat_ws(":", F.lit("2001:db8"), *groups)).otherwise(four)


def _letters(digest: Column, start: int, n: int) -> Column:
    return F.concat(*(F.char(F.lit(65) + F.pmod(F.conv(F.substring(digest, start + 2 * i, 2), 16, 10).cast("int"), F.lit(26))) for i in range(n)))


def pan(text: Column, digest: Column) -> Column:
    return F.concat(_letters(digest, 1, 3), F.substring(alnum(text), 4, 1), _letters(digest, 7, 1), F.lpad(seed_number(digest, 9999, 2).cast("string"), 4, "0"), _letters(digest, 61, 1))


def org(text: Column, digest: Column) -> Column:
    """A fake company of about the real one's length, with its legal form."""
    drafts = F.array(*(F.concat_ws(" ", pick(COMPANY_WORDS, digest, i), pick(COMPANY_KINDS, digest, i + 5)) for i in range(8)), *(pick(COMPANY_WORDS, digest, i) for i in range(4)))
    far = lambda d, wanted: F.when(F.abs(F.length(d) - wanted) * 5 <= wanted, F.lit(0)).otherwise(F.abs(F.length(d) - wanted))

    def fitted(suffix: Column) -> Column:
        ranked = lambda wanted: F.transform(drafts, lambda d, i: F.struct(far(d, wanted).alias("far"), i.alias("i"), d.alias("d")))
        return F.concat(let(F.length(text) - F.length(suffix), lambda wanted: F.array_min(ranked(wanted)).d), suffix)

    found = F.regexp_extract(text, ORG_SUFFIX, 0)
    return let(F.when(F.length(found) < F.length(text), found).otherwise(""), fitted)


def address(text: Column, digest: Column) -> Column:
    """As many lines as the real address."""
    lines = F.size(F.split(text, "\n"))
    street = F.concat((seed_number(digest, 899, 0) + 1).cast("string"), F.lit(" "), pick(STREETS, digest, 1), F.lit(" Street"))
    end = F.concat(pick(CITIES, digest, 2), F.lit(" "), (seed_number(digest, 800000, 3) + 100000).cast("string"))
    middle = F.transform(F.sequence(F.lit(1), F.greatest(lines - 2, F.lit(1))), lambda i: F.concat(F.lit("Block "), i.cast("string")))
    several = F.concat_ws("\n", street, F.when(lines > 2, F.array_join(middle, "\n")), end)
    return F.when(lines == 1, F.concat_ws(", ", street, end)).otherwise(several)


def dob(text: Column, digest: Column) -> Column:
    """30 to 400 days away; day first if that is a date, else month first; separator kept."""
    a, sep, b, year = (F.regexp_extract(text, r"^\s*(\d{1,2})([/-])(\d{1,2})[/-](\d{4})\s*$", i) for i in range(1, 5))
    first = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(b, 2, "0"), F.lpad(a, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    second = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    days = (seed_number(digest, 371, 0) + 30).cast("int") * F.when(seed_number(digest, 2, 1) == 0, 1).otherwise(-1)
    moved = F.date_add(F.coalesce(first, second), days)
    out = F.when(first.isNotNull(), F.concat(F.date_format(moved, "dd"), sep, F.date_format(moved, "MM"))).otherwise(F.concat(F.date_format(moved, "MM"), sep, F.date_format(moved, "dd")))
    return F.coalesce(F.concat(out, sep, F.date_format(moved, "yyyy")), reshape(text, digest))


def _card(text: Column, digest: Column) -> Column:
    body = digits_of(digest, F.length(alnum(text)) - 1)
    return refit(text, let(body, lambda b: F.concat(b, _luhn_digit(b))))


def _aadhaar(text: Column, digest: Column) -> Column:
    body = F.concat((seed_number(digest, 8, 0) + 2).cast("string"), digits_of(F.substring(digest, 61, 100), 10))
    return refit(text, let(body, lambda b: F.concat(b, _verhoeff_digit(b))))


def _gstin(text: Column, digest: Column) -> Column:
    plain = alnum(text)
    return refit(text, F.concat(F.substring(plain, 1, 2), pan(F.substring(plain, 3, 10), digest), F.substring(plain, 13, 1), F.lit("Z"), seed_number(digest, 10, 3).cast("string")))


def _ifsc(text: Column, digest: Column) -> Column:
    return refit(text, F.concat(_letters(digest, 1, 4), F.lit("0"), F.lpad(seed_number(digest, 1000000, 1).cast("string"), 6, "0")))


def _mailbox(text: Column, digest: Column) -> Column:
    return F.lower(F.concat(pick(FIRST_NAMES, digest, 0), F.lit("."), pick(LAST_NAMES, digest, 1), seed_number(digest, 100, 2).cast("string"), F.lit("@example.com")))


#: By type: text and digest to surrogate. Types without an entry keep their shape.
GENERATORS = {
    "SSN": lambda text, digest: ssn(digest), "IP": ip, "PAN": lambda text, digest: refit(text, pan(text, digest)), "CREDIT_CARD": _card, "AADHAAR": _aadhaar, "GSTIN": _gstin,
    "IFSC": _ifsc, "DIN": lambda text, digest: refit(text, digits_of(digest, F.length(alnum(text)))), "EMAIL": _mailbox, "ORG": org, "ADDRESS": address, "DOB": dob,
    "PHONE": lambda text, digest: reshape(text, digest, F.length(F.regexp_extract(text, r"^\+\s?\d{1,3}", 0))),
}


def entity_surrogate(type_: Column, text: Column, digest: Column) -> Column:
    """The surrogate of every type but PERSON and those e-mails that follow a person. ``digest`` should be
    a column that has been computed, as it is used many times."""
    out = reshape(text, digest)
    for name, make in GENERATORS.items():
        out = F.when(type_ == name, make(text, digest)).otherwise(out)
    return out


#: Draws for a fake of about the real one's length, and how far lengths may differ.
LENGTH_DRAWS, LENGTH_SLACK = 20, 0.2


def length_match(real: Column, drafts: Column) -> Column:
    """The first draft within a fifth of the real value's length, else the nearest in length, the earlier
    on ties."""
    far = lambda d: F.abs(F.length(d) - F.length(real))
    near = F.filter(drafts, lambda d: far(d) <= F.length(real) * LENGTH_SLACK)
    ranked = F.transform(drafts, lambda d, i: F.struct(far(d).alias("far"), i.alias("i"), d.alias("d")))
    return F.coalesce(F.get(near, 0), F.array_min(ranked).d)


def _drafts(digest: Column, names: tuple[str, ...]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LENGTH_DRAWS - 1)), lambda i: pick(names, F.sha2(F.concat(digest, i.cast("string")).cast("binary"), 256), 0))


def name_dictionary(entities: DataFrame, salt: str) -> DataFrame:
    """(doc_id, names): a map from each real name word to its fake. A word's role, first or last name, is
    the one in which the document uses it first; single letters have no fake of their own."""
    people = entities.where("type = 'PERSON'").select("doc_id", "first", F.split("key", " ").alias("words"))
    each = people.select("doc_id", "first", F.size("words").alias("n"), F.posexplode("words").alias("i", "token")).where(F.length("token") > 1)
    role = each.groupBy("doc_id", "token").agg(F.min_by(F.col("i") == F.col("n") - 1, F.struct("first", "i")).alias("last"))
    # Each word's draws are worked out once, wherever and however often documents use it.
    words = role.select("token", "last").distinct().withColumn("digest", hmac_hex(salt, F.concat(F.lit("PERSON|token|"), "token")))
    drawn = words.withColumn("drafts", F.when(F.col("last"), _drafts(F.col("digest"), LAST_NAMES)).otherwise(_drafts(F.col("digest"), FIRST_NAMES)))
    fakes = written(drawn.select("token", "last", length_match(F.col("token"), F.col("drafts")).alias("fake")), "name-fakes")
    fakes = role.join(fakes, ["token", "last"])
    return fakes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "fake"))).alias("names"))


def _cased(real: Column, fake: Column) -> Column:
    return F.when((F.length(real) > 1) & (F.upper(real) == real), F.upper(fake)).when(F.lower(real) == real, F.lower(fake)).otherwise(fake)


def render_person(text: Column, names: Column) -> Column:
    """Each name word by its fake; titles, punctuation and case as in the text; initials by the initial
    of the fake of a name that they may stand for."""

    def token(t: Column) -> Column:
        return let(F.regexp_extract(t, r"(?U)^(\W*)(.*?)(\W*)$", 2), lambda core: rendered(t, core))

    def rendered(t: Column, core: Column) -> Column:
        pre, post = (F.regexp_extract(t, r"(?U)^(\W*)(.*?)(\W*)$", i) for i in (1, 3))
        low = casefold(core)
        title = F.lower(core).isin(list(config.CLUSTER_HONORIFICS))
        starts = F.filter(F.array_sort(F.map_keys(names)), lambda k: k.startswith(low))
        fake = F.coalesce(F.try_element_at(names, low), F.when(F.length(core) == 1, F.substring(F.try_element_at(names, F.get(starts, 0)), 1, 1)), core)
        return F.when((core == "") | title, t).otherwise(F.concat(pre, _cased(core, fake), post))

    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), token), " ")


def person_email(local: Column, names: Column) -> Column:
    """The mailbox by a known person's fakes, separators kept, also where two names are glued; null if a
    part is no known name. ``names`` should be a plain column: it is looked up in many times."""
    parts = F.regexp_extract_all(F.lower(local), F.lit(r"[a-z]+|[^a-z]+"), F.lit(0))

    def part(p: Column) -> Column:
        rest = lambda k: F.substring(p, F.length(k) + 1, F.length(p))
        head = F.get(F.filter(F.array_sort(F.map_keys(names)), lambda k: p.startswith(k) & F.map_contains_key(names, rest(k))), 0)
        glued = F.concat(F.try_element_at(names, head), F.try_element_at(names, rest(head)))
        return F.when(p.rlike("^[a-z]"), F.lower(F.when(F.map_contains_key(names, p), F.try_element_at(names, p)).otherwise(glued))).otherwise(p)

    mapped = F.transform(parts, part)
    whole = F.array_join(F.transform(mapped, lambda m: F.coalesce(m, F.lit("\0"))), "")
    return F.when(~whole.contains("\0") & local.rlike("(?i)[a-z]"), whole)


def salted(settings: Settings) -> Settings:
    if not settings.salt:
        raise ValueError("set PII_SALT or Settings.salt: without a secret salt surrogates can be guessed back")
    return settings


def assign(entities: DataFrame, mentions: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) with a ``surrogate`` column. Same salt and value, same surrogate."""
    s = salted(settings or Settings())
    digest = stream(s.salt, F.concat(F.col("type"), F.lit("|"), normal_key(F.col("type"), F.col("canonical"))))
    names = F.coalesce("names", F.create_map().cast("map<string,string>"))
    known = entities.join(name_dictionary(entities, s.salt), "doc_id", "left").withColumn("names", names)
    known = known.withColumn("local", F.when(F.col("type") == "EMAIL", F.substring_index("canonical", "@", 1)))
    # Exploded, else each of the many uses of a mailbox or a digest works it out anew.
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    known = once(known, "mailbox", F.when(F.col("type") == "EMAIL", person_email(F.col("local"), F.col("names"))))
    fake = F.when(F.col("type") == "PERSON", render_person(F.col("canonical"), F.col("names")))
    fake = once(known, "named", fake.when(F.col("mailbox").isNotNull(), F.concat("mailbox", F.lit("@example.com"))))
    # Names and mailboxes of people need no digest.
    fake = once(fake, "digest", F.when(F.col("named").isNull(), digest))
    fake = fake.withColumn("surrogate", F.when(F.col("named").isNotNull(), F.col("named")).otherwise(entity_surrogate(F.col("type"), F.col("canonical"), F.col("digest"))))
    named = written(fake.drop("local", "mailbox", "named", "digest"), "named")
    each = mentions.join(named.select("doc_id", "entity_id", F.col("surrogate").alias("whole"), "names"), ["doc_id", "entity_id"])
    shaped = F.col("type").isin(list(config.SHAPE_TYPES)) & (F.length(alnum(F.col("text"))) == F.length(alnum(F.col("whole"))))
    own = F.when(F.col("type") == "PERSON", render_person(F.col("text"), F.col("names"))).when(shaped, refit(F.col("text"), alnum(F.col("whole")))).otherwise(_cased(F.col("text"), F.col("whole")))
    return named.drop("names"), each.withColumn("surrogate", own).drop("whole", "names")
