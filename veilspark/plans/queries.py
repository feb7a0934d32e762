"""The registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import validators as val
from ..functions.text import hmac_hex, seed_number
from ..operators import entities, evaluate, finders, merge, rewrite, surrogates, views
from ..operators import judge as jdg
from ..sources import readers
from . import cases, engine
from .tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SALT = "oracle-salt"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_views(spark: SparkSession, d: str) -> DataFrame:
    return views.page_views(table(spark, d, "documents"), split_slashes=False)


VIEWS = r"""WITH lines AS (SELECT doc_id, i - 1 AS block, trim(regexp_replace(l, '\s+', ' ', 'g')) AS l
  FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
views AS (SELECT doc_id, (block // 50 + 1)::INTEGER AS page_no, string_agg(l, chr(10) ORDER BY block) AS text FROM lines WHERE l <> '' GROUP BY 1, 2)"""


def _matches(pattern: str) -> str:
    """SQL for the matches of a pattern in the views: doc_id, page_no, text, s, m."""
    start = "a.pos + strpos(a.rest, x.rest) - 1"
    empty = "[]::STRUCT(s BIGINT, m VARCHAR)[]"
    return rf"""{VIEWS},
hits AS (SELECT doc_id, page_no, text, list_reduce(list_prepend({{'rest': text, 'pos': 0::BIGINT, 'found': {empty}}}, list_transform(m, lambda x: {{'rest': x, 'pos': 0::BIGINT, 'found': {empty}}})),
    lambda a, x: {{'rest': substr(a.rest, strpos(a.rest, x.rest) + length(x.rest)), 'pos': {start} + length(x.rest), 'found': list_append(a.found, {{'s': {start}, 'm': x.rest}})}}).found AS f
  FROM (SELECT doc_id, page_no, text, regexp_extract_all(text, '{pattern}') AS m FROM views) WHERE len(m) > 0),
matches AS (SELECT doc_id, page_no, h.s AS s, h.m AS m FROM (SELECT doc_id, page_no, text, unnest(f) AS h FROM hits)
  WHERE NOT regexp_matches(substr(text, h.s::BIGINT, 1), '\d') AND NOT regexp_matches(substr(text, (h.s + length(h.m) + 1)::BIGINT, 1), '\d'))"""


# ---------------------------------------------------------------- views and sources


@query(VIEWS + " SELECT doc_id, page_no, (length(text) - length(translate(text, ' ' || chr(10), '')) + 1)::BIGINT AS n_words, sha256(text) AS text_sha256 FROM views")
def doc_pages(spark, d):
    return doc_views(spark, d).select("doc_id", "page_no", F.size(F.split("text", "[ \n]")).cast("long").alias("n_words"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query(VIEWS + " SELECT doc_id, page_no, sha256(text) AS text_sha256 FROM views")
def raw_view(spark, d):
    """The view rebuilt from its words table."""
    return views.view_of_words(views.words(table(spark, d, "documents"))).select("doc_id", "page_no", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query(VIEWS + ", w AS (SELECT doc_id, page_no, unnest(string_split_regex(text, '[ \\n]')) AS w FROM views) SELECT page_no, w AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1, 2")
def doc_tokens(spark, d):
    return views.words(table(spark, d, "documents")).groupBy("page_no", F.col("text").alias("word")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(VIEWS + r""", s AS (SELECT doc_id, page_no, length(regexp_replace(text, '\s+', '', 'g')) / 250000.0 AS text_density,
  len(list_filter(string_split_regex(text, '[ \n]'), lambda w: length(w) = 1)) / len(string_split_regex(text, '[ \n]')) AS single_letter_ratio FROM views)
SELECT doc_id, page_no, round(text_density, 9) AS text_density, round(single_letter_ratio, 9) AS single_letter_ratio, text_density < 0.0005 OR single_letter_ratio > 0.15 AS hard,
  text_density < 0.0005 OR single_letter_ratio > 0.15 OR page_no % 10 = 0 AS to_model FROM s""")
def routing_signals(spark, d):
    signals = views.routing_signals(doc_views(spark, d), area="250000.0D")
    return signals.select("doc_id", "page_no", F.round("text_density", 9).alias("text_density"), F.round("single_letter_ratio", 9).alias("single_letter_ratio"), "hard", (F.col("hard") | (F.pmod("page_no", F.lit(10)) == 0)).alias("to_model"))


@query(r"""WITH w AS (SELECT p_partkey, '(' || replace(p_name, ' ', '/') || '),' AS w FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(w, '([(\[]?)([A-Za-z]{2,}(?:/[A-Za-z]{2,})+)([,.;:)\]]*)') THEN replace(w, '/', ' ') ELSE w END AS parts FROM w""")
def slash_split(spark, d):
    word = F.concat(F.lit("("), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("),"))
    return table(spark, d, "part").select("p_partkey", F.array_join(views.slash_parts(word), " ").alias("parts"))


@query("""SELECT page_id AS doc_id, (i - 1)::INTEGER AS pos, t AS text FROM (SELECT page_id, unnest(m) AS t, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS m FROM pages))""")
def href_words(spark, d):
    return readers.link_words(table(spark, d, "pages"), only_identifying=False).select("doc_id", "pos", "text")


@query(r"SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page_no, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''")
def conversation_pages(spark, d):
    return readers.from_conversations(table(spark, d, "conversations"))


@query()
def html_addresses(spark, d):
    return finders.find_addresses(views.page_views(readers.from_html(table(spark, d, "pages")))).select("doc_id", "page_no", "start", "end", "text")


_CUT = r"regexp_extract(substr(text, pos::BIGINT + 1001, 500), '(?s)^.*(\n|\. )')"


@query(f"""WITH RECURSIVE {VIEWS.removeprefix('WITH ')}, c AS (
  SELECT doc_id, page_no, text, 0::BIGINT AS pos, 1 AS n FROM views
  UNION ALL SELECT doc_id, page_no, text, pos + (CASE WHEN length({_CUT}) = 0 THEN 1500 ELSE 1000 + length({_CUT}) - ends_with({_CUT}, ' ')::INTEGER END) - 200, n + 1 FROM c WHERE pos + 1500 < length(text))
SELECT doc_id, page_no, max(n)::BIGINT AS n_chunks, max(pos)::BIGINT AS last_start FROM c GROUP BY 1, 2""")
def chunk_counts(spark, d):
    """Chunks of every page: how many, and where the last one starts."""
    parts = views.chunks(F.col("text"), 1500, 200)
    sized = doc_views(spark, d).select("doc_id", "page_no", F.transform(parts, lambda p: p.start).alias("starts"))
    return sized.select("doc_id", "page_no", F.size("starts").cast("long").alias("n_chunks"), F.element_at("starts", -1).cast("long").alias("last_start"))


# ---------------------------------------------------------------- pattern finder


def _found(spark, d, kind: str) -> DataFrame:
    spans, _ = finders.find_regex(doc_views(spark, d), types=[kind])
    return spans


@query(_matches(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") + " SELECT doc_id, page_no, s::INTEGER AS start, m AS text, 0.8::DOUBLE AS confidence FROM matches")
def regex_email(spark, d):
    return _found(spark, d, "EMAIL").select("doc_id", "page_no", "start", "text", "confidence")


@query(_matches(r"\b(?:\d{1,3}\.){3}\d{1,3}\b") + " SELECT doc_id, page_no, s::INTEGER AS start, m AS text, 1.0::DOUBLE AS confidence FROM matches WHERE len(list_filter(string_split(m, '.'), lambda o: o::INTEGER > 255)) = 0")
def regex_ip(spark, d):
    return _found(spark, d, "IP").where(~F.col("text").contains(":")).select("doc_id", "page_no", "start", "text", "confidence")


LUHN = """list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN (length(c) - i) % 2 = 0 THEN substr(c, i, 1)::INTEGER ELSE (substr(c, i, 1)::INTEGER * 2) % 10 + (substr(c, i, 1)::INTEGER * 2) // 10 END)) % 10 = 0"""


@query(_matches(r"\b(?:\d[ -]?){13,19}\b") + rf", c AS (SELECT doc_id, page_no, s, regexp_replace(m, '\D', '', 'g') AS c FROM matches) SELECT doc_id, page_no, s::INTEGER AS start, c AS digits FROM c WHERE length(c) BETWEEN 13 AND 19 AND {LUHN}")
def regex_card(spark, d):
    return _found(spark, d, "CREDIT_CARD").select("doc_id", "page_no", "start", F.regexp_replace("text", "[^0-9]", "").alias("digits"))


@query(_matches(r"(?:\+\s?\d{1,3}[\s-]?)?(?:\(?\d{2,5}\)?[\s-]?)?\d{3,5}[\s-]?\d{3,5}(?:[\s-]?\d{2,4})?") + r""", c AS (SELECT doc_id, page_no, s, regexp_replace(m, '\s+', '', 'g') AS v, regexp_replace(m, '\D', '', 'g') AS c FROM matches)
SELECT doc_id, page_no, s::INTEGER AS start, c AS digits FROM c
WHERE (length(c) = 10 AND c[1] BETWEEN '2' AND '9' OR length(c) = 11 AND c[1] = '0' OR length(c) = 12 AND c[1:2] = '91') AND len(list_distinct(string_split(c, ''))) > 1
  AND len(list_filter(string_split_regex(v, '[-()+]+'), lambda t: regexp_full_match(t, '(19|20)[0-9][0-9]'))) < 2 AND NOT ends_with(c, '00000')""")
def regex_phone(spark, d):
    return _found(spark, d, "PHONE").select("doc_id", "page_no", "start", F.regexp_replace("text", "[^0-9]", "").alias("digits"))


# ---------------------------------------------------------------- validators on synthesised identifiers


@query("""WITH c AS (SELECT c_custkey, lpad(((c_custkey * 37) % 1000)::VARCHAR, 3, '0') AS a, lpad(((c_custkey * 7) % 100)::VARCHAR, 2, '0') AS g, lpad(((c_custkey * 101) % 10000)::VARCHAR, 4, '0') AS s FROM customer)
SELECT c_custkey, a || '-' || g || '-' || s AS value, NOT (a IN ('000', '666') OR a[1] = '9' OR g = '00' OR s = '0000') AS ok FROM c""")
def valid_ssn(spark, d):
    part = lambda k, m, n: F.lpad((F.col("c_custkey") * k % m).cast("string"), n, "0")
    value = F.concat_ws("-", part(37, 1000, 3), part(7, 100, 2), part(101, 10000, 4))
    return table(spark, d, "customer").select("c_custkey", value.alias("value"), val.ssn(value).alias("ok"))


_LETTER = "chr((65 + {0} % 26)::INTEGER)"


@query(f"""WITH c AS (SELECT c_custkey, {_LETTER.format('c_custkey')} || {_LETTER.format('(c_custkey * 3)')} || {_LETTER.format('(c_custkey * 5)')} || {_LETTER.format('(c_custkey * 7)')} || {_LETTER.format('(c_custkey * 11)')} || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || {_LETTER.format('(c_custkey * 13)')} AS value FROM customer)
SELECT c_custkey, value, regexp_full_match(value, '[A-Z][A-Z][A-Z][PCHFATBLJG][A-Z][0-9][0-9][0-9][0-9][A-Z]') AS ok FROM c""")
def valid_pan(spark, d):
    letter = lambda k: F.char(F.lit(65) + F.col("c_custkey") * k % 26)
    value = F.concat(*(letter(k) for k in (1, 3, 5, 7, 11)), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), letter(13))
    return table(spark, d, "customer").select("c_custkey", value.alias("value"), val.pan(value).alias("ok"))


@query("SELECT c_custkey, v AS value, len(list_distinct(string_split(v, ''))) > 1 AS ok FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN repeat((c_custkey // 10 % 10)::VARCHAR, 8) ELSE lpad((c_custkey * 12345 % 100000000)::VARCHAR, 8, '0') END AS v FROM customer)")
def valid_din(spark, d):
    k = F.col("c_custkey")
    value = F.when(k % 10 == 0, F.repeat(F.floor(k / 10 % 10).cast("string"), F.lit(8))).otherwise(F.lpad((k * 12345 % 100000000).cast("string"), 8, "0"))
    return table(spark, d, "customer").select("c_custkey", value.alias("value"), val.din(value).alias("ok"))


@query(f"SELECT o_orderkey, c AS value, {LUHN} AS ok FROM (SELECT o_orderkey, '4' || lpad((o_orderkey * 987654321 % 1000000000000000)::VARCHAR, 15, '0') AS c FROM orders)")
def valid_card(spark, d):
    value = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 987654321 % 1000000000000000).cast("string"), 15, "0"))
    return table(spark, d, "orders").select("o_orderkey", value.alias("value"), val.luhn(value).alias("ok"))


def _verhoeff_sql() -> str:
    mul, powers = val.verhoeff_tables()
    m, p = str([x for r in mul for x in r]), str([x for r in powers for x in r])
    fold = f"list_reduce(list_prepend(0, range(1, 13)), lambda c, i: ({m})[c * 10 + ({p})[(i - 1) % 8 * 10 + substr(v, 13 - i, 1)::INTEGER + 1] + 1])"
    return f"SELECT o_orderkey, v AS value, v[1] BETWEEN '2' AND '9' AND {fold} = 0 AS ok FROM (SELECT o_orderkey, (o_orderkey % 10)::VARCHAR || lpad((o_orderkey * 7654321 % 100000000000)::VARCHAR, 11, '0') AS v FROM orders)"


@query(_verhoeff_sql())
def valid_aadhaar(spark, d):
    value = F.concat((F.col("o_orderkey") % 10).cast("string"), F.lpad((F.col("o_orderkey") * 7654321 % 100000000000).cast("string"), 11, "0"))
    return table(spark, d, "orders").select("o_orderkey", value.alias("value"), val.verhoeff(value).alias("ok"))


@query("""SELECT o_orderkey AS doc_id, 'DOB' AS type, strftime(o_orderdate, '%d/%m/%Y') AS text FROM orders WHERE o_orderkey % 2 = 0""")
def context_window(spark, d):
    """Dates count as births only near a context word."""
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Date of birth: ").otherwise("Shipped on "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), line.alias("text"))
    return finders.find_regex(pages, types=["DOB"])[0].select("doc_id", "type", "text")


_DIN_PAGES = "SELECT c_custkey // 20 AS doc_id, (c_custkey % 20 + CASE WHEN c_custkey % 20 > 12 THEN 2 ELSE 1 END)::INTEGER AS page_no, c_custkey % 3 = 0 AS header, lpad((10000001 + c_custkey)::VARCHAR, 8, '0') AS v FROM customer"


@query(f"WITH p AS ({_DIN_PAGES}) SELECT doc_id, page_no, v AS text FROM p WHERE NOT header AND EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.page_no = p.page_no - 1 AND q.header)")
def din_prev_page(spark, d):
    """Parked numbers whose page before, by number, had the header."""
    k = F.col("c_custkey")
    page = (k % 20 + F.when(k % 20 > 12, 2).otherwise(1)).cast("int")
    value = F.lpad((F.lit(10000001) + k).cast("string"), 8, "0")
    pages = table(spark, d, "customer").select(F.floor(k / 20).alias("doc_id"), page.alias("page_no"), F.concat(F.when(k % 3 == 0, "DIN ").otherwise("No "), value).alias("text"))
    parked = finders.find_regex(pages, types=["DIN"])[1]
    return jdg.resolve_parked(parked, pages).select("doc_id", "page_no", "text")


# ---------------------------------------------------------------- spans, entities, surrogates


def _line_spans(spark, d) -> DataFrame:
    """Spans with word intervals out of order lines: a line's place and length by its keys."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_partkey") % 40).cast("int").alias("w0"), (F.col("l_partkey") % 40 + F.col("l_suppkey") % 5).cast("int").alias("w1"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_partkey % 40 AS w0, l_partkey % 40 + l_suppkey % 5 AS w1, l_partkey * 100 + l_linenumber AS seq FROM lineitem),
r AS (SELECT *, max(w1) OVER (PARTITION BY doc_id ORDER BY w0, w1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR w0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY w0, w1, seq ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, island::BIGINT AS island, min(w0)::INTEGER AS w0, max(w1)::INTEGER AS w1, count(*) AS members FROM i GROUP BY 1, 2""")
def span_islands(spark, d):
    return merge.groups(_line_spans(spark, d)).groupBy("doc_id", "island").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.count("*").alias("members"))


@query()
def span_merge(spark, d):
    pages = doc_views(spark, d)
    raw = written(finders.union(finders.find_regex(pages)[0], finders.find_addresses(pages)), "raw")
    return merge.merge(written(merge.trim_at_identifiers(raw, pages), "trimmed")).select("doc_id", "page_no", "start", "end", "type", F.array_join("finders", "+").alias("finder"), "confidence")


@query(_matches(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") + """, g AS (SELECT doc_id, regexp_replace(lower(m), '[^0-9a-z]+', '', 'g') AS key, count(*) AS mention_count, min((page_no, s)) AS first FROM matches GROUP BY 1, 2)
SELECT doc_id, 'EMAIL' || row_number() OVER (PARTITION BY doc_id ORDER BY first) AS entity_id, key, mention_count FROM g""")
def entity_ids(spark, d):
    return entities.cluster(_found(spark, d, "EMAIL"))[0].select("doc_id", "entity_id", "key", "mention_count")


FIRST, LAST = ("Asha", "Ravi", "Meera"), ("Nair", "Iyer", "Bose", "Shah")


_LINKED = """WITH c AS (SELECT c_custkey AS k, c_custkey // 12 AS doc_id, ['asha', 'ravi', 'meera'][(c_custkey % 3 + 1)::INTEGER] AS f, ['kumar', 'devi'][(c_custkey % 2 + 1)::INTEGER] AS m, ['nair', 'iyer', 'bose', 'shah'][(c_custkey // 3 % 4 + 1)::INTEGER] AS l FROM customer),
keys AS (SELECT doc_id, w, min(k) AS first FROM (SELECT doc_id, k, CASE k % 4 WHEN 0 THEN [f, m, l] WHEN 1 THEN [f, l] WHEN 2 THEN [l] ELSE [f[1], l] END AS w FROM c) GROUP BY 1, 2),
fits AS (SELECT a.doc_id, a.w, a.first, b.w AS t, b.first AS t_first FROM keys a JOIN keys b ON a.doc_id = b.doc_id AND len(b.w) > len(a.w) AND length(b.w[1]) > 1 AND a.w[-1] = b.w[-1]
  AND (len(a.w) = 1 OR a.w[1] = b.w[1] OR length(a.w[1]) = 1 AND (starts_with(b.w[1], a.w[1]) OR len(b.w) = 3 AND starts_with(b.w[2], a.w[1])))),
inner_ AS (SELECT DISTINCT doc_id, w FROM fits WHERE len(w) >= 2 AND length(w[1]) > 1),
open_ AS (SELECT f.* FROM fits f LEFT JOIN inner_ i ON f.doc_id = i.doc_id AND f.t = i.w WHERE i.w IS NULL)
SELECT doc_id, array_to_string(w, ' ') AS key, array_to_string(arg_min(t, (t_first, array_to_string(t, ' '))), ' ') AS target FROM open_ GROUP BY 1, 2, w"""


@query(_LINKED)
def person_links(spark, d):
    """Names of customers, whole and in part, 12 customers a document."""
    k = F.col("c_custkey")
    name = lambda names, by: F.get(F.array(*map(F.lit, names)), by.cast("int"))
    first, middle, last = name(FIRST, k % 3), name(("Kumar", "Devi"), k % 2), name(LAST, F.floor(k / 3) % 4)
    text = F.when(k % 4 == 0, F.concat_ws(" ", first, middle, last)).when(k % 4 == 1, F.concat_ws(" ", first, last)).when(k % 4 == 2, F.concat(F.lit("Mr. "), last)).otherwise(F.concat(F.substring(first, 1, 1), F.lit(". "), last))
    spans = table(spark, d, "customer").select(F.floor(k / 12).alias("doc_id"), F.lit("PERSON").alias("type"), text.alias("text"), k.alias("seq"))
    keys = entities.mentions(spans).groupBy("doc_id", "type", "key").agg(F.min("seq").alias("first"))
    return entities.person_links(keys)


_PAD = {n: bytes(b ^ x for b in SALT.encode().ljust(64, b"\0")).hex() for n, x in (("i", 0x36), ("o", 0x5C))}
_HMAC = f"sha256(unhex('{_PAD['o']}') || unhex(sha256(unhex('{_PAD['i']}') || encode({{0}}))))"


@query(f"SELECT c_custkey, {_HMAC.format(chr(39) + 'SSN|' + chr(39) + ' || c_name')} AS seed FROM customer")
def hmac_seed(spark, d):
    return table(spark, d, "customer").select("c_custkey", hmac_hex(SALT, F.concat(F.lit("SSN|"), F.col("c_name"))).alias("seed"))


def _number(draw: int, modulus: int) -> str:
    return f"(('0x' || substr(h, {15 * draw + 1}, 15))::BIGINT % {modulus})"


@query(f"""WITH s AS (SELECT c_custkey, {_HMAC.format(chr(39) + 'SSN|' + chr(39) + ' || c_name || ' + chr(39) + '|0' + chr(39))} AS h FROM customer),
a AS (SELECT c_custkey, {_number(0, 898)} + 1 AS a, {_number(1, 99)} + 1 AS g, {_number(2, 9999)} + 1 AS n FROM s)
SELECT c_custkey, lpad((CASE WHEN a >= 666 THEN a + 1 ELSE a END)::VARCHAR, 3, '0') || '-' || lpad(g::VARCHAR, 2, '0') || '-' || lpad(n::VARCHAR, 4, '0') AS surrogate FROM a""")
def surrogate_ssn(spark, d):
    digest = surrogates.stream(SALT, F.concat(F.lit("SSN|"), F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", surrogates.ssn(digest).alias("surrogate"))


@query(f"""WITH s AS (SELECT c_custkey, {_HMAC.format(chr(39) + 'IP|' + chr(39) + ' || c_name || ' + chr(39) + '|0' + chr(39))} AS h FROM customer)
SELECT c_custkey, ['192.0.2.', '198.51.100.', '203.0.113.'][{_number(0, 3)} + 1] || ({_number(1, 254)} + 1)::VARCHAR AS surrogate FROM s""")
def surrogate_ip(spark, d):
    digest = surrogates.stream(SALT, F.concat(F.lit("IP|"), F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", surrogates.ip(F.lit("10.0.0.1"), digest).alias("surrogate"))


@query("SELECT c_custkey, true AS credit_card_ok, true AS aadhaar_ok, true AS pan_ok, true AS ssn_ok, true AS din_ok, 1::BIGINT AS same_again FROM customer")
def surrogate_formats(spark, d):
    """Surrogates of every shape for every customer: each passes its own validator, differs from the real
    value and keeps its punctuation, and the same key gives the same surrogate."""
    keyed = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"), surrogates.stream(SALT, F.col("c_name")).alias("digest"))
    real = {"CREDIT_CARD": "4111 1111 1111 1111", "AADHAAR": "2345 6789 0124", "PAN": "ABCPK1234F", "SSN": "123-45-6789", "DIN": "01234567"}
    checks = {"CREDIT_CARD": val.luhn, "AADHAAR": val.verhoeff, "PAN": val.pan, "SSN": val.ssn, "DIN": lambda v: v.rlike("^[0-9]{8}$")}
    fakes = keyed.select("c_custkey", *(surrogates.GENERATORS[k](F.lit(v), F.col("digest")).alias(k) for k, v in real.items()))
    plain = lambda x: F.regexp_replace(x, "[A-Z0-9]", "x")
    good = [F.bool_and(check(F.replace(k, F.lit(" "))) & (F.col(k) != real[k]) & (plain(F.col(k)) == plain(F.lit(real[k])))).alias(f"{k.lower()}_ok") for k, check in checks.items()]
    return fakes.groupBy("c_custkey").agg(*good, F.count_distinct(F.struct(*real)).alias("same_again"))


# ---------------------------------------------------------------- whole runs


@query()
def redacted_text(spark, d):
    return engine.run(table(spark, d, "documents"), Settings(salt=SALT)).pages


@query()
def mapping(spark, d):
    return rewrite.mapping(engine.run(table(spark, d, "documents"), Settings(salt=SALT)).entities)


@query()
def leak_scan(spark, d):
    return engine.run(table(spark, d, "documents"), Settings(salt=SALT)).leaks


@query()
def judge_decisions(spark, d):
    return engine.run(table(spark, d, "documents"), Settings(salt=SALT)).judged.groupBy("type", "decision", "reason").agg(F.count("*").alias("n"))


@query()
def propagate_email(spark, d):
    pages = written(doc_views(spark, d), "views")
    seeds = written(finders.find_regex(pages, types=["EMAIL", "PHONE"])[0], "seeds")
    one = seeds.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "type", "text").orderBy("page_no", "start"))).where("n = 1").drop("n")
    return finders.propagate(pages, one).select("doc_id", "page_no", "start", "end", "type", "confidence")


# ---------------------------------------------------------------- scoring

_FLAG = "contains(text, '!!') OR contains(text, '***')"


@query(f"""WITH c AS (SELECT lang, (quality = 0 AND f)::INTEGER AS tp, (quality = 1 AND f)::INTEGER AS fp, (quality = 0 AND NOT f)::INTEGER AS fn FROM (SELECT lang, quality, {_FLAG} AS f FROM documents JOIN labels USING (doc_id))),
g AS (SELECT coalesce(lang, 'all') AS lang, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP (lang)),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM g)
SELECT lang, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM p""")
def eval_rollup(spark, d):
    flagged = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("***"))
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 0).alias("bad"), flagged.alias("f"))
    counted = both.select("lang", (F.col("bad") & F.col("f")).cast("int").alias("tp"), (~F.col("bad") & F.col("f")).cast("int").alias("fp"), (F.col("bad") & ~F.col("f")).cast("int").alias("fn"))
    scored = evaluate.prf(counted.rollup("lang").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    return scored.select(F.coalesce("lang", F.lit("all")).alias("lang"), "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "benchmark").select((F.col("item_id") % 10).cast("int").alias("page"), F.explode(F.split("text", r"\. ")).alias("text")).withColumn("type", F.lit("ORG"))
    return evaluate.numbered(items.where("length(text) % 3 <> 0")), evaluate.numbered(items.where("length(text) % 5 <> 0"))


@query(r"""WITH i AS (SELECT item_id % 10 AS page, unnest(string_split(text, '. ')) AS text FROM benchmark), n AS (SELECT page, length(text) AS l, replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss') AS t FROM i)
SELECT p.page::INTEGER AS page, p.t AS pred_norm, q.t AS truth_norm, count(*) AS n FROM n p JOIN n q ON p.page = q.page AND p.l % 3 <> 0 AND q.l % 5 <> 0 AND p.t <> '' AND q.t <> '' AND (contains(p.t, q.t) OR contains(q.t, p.t)) GROUP BY 1, 2, 3""")
def eval_candidates(spark, d):
    return evaluate.candidates(*_sides(spark, d)).groupBy("page", "pred_norm", "truth_norm").agg(F.count("*").alias("n"))


@query()
def eval_greedy(spark, d):
    pred, truth = _sides(spark, d)
    scored = evaluate.scores(pred, truth, evaluate.match(pred, truth))
    return scored.withColumn("type", F.coalesce("type", F.lit("all")))


@query()
def token_accuracy(spark, d):
    pred, truth = _sides(spark, d)
    pages = table(spark, d, "benchmark").groupBy((F.col("item_id") % 10).cast("int").alias("page")).agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    return evaluate.token_accuracy(pages, pred, truth)


# ---------------------------------------------------------------- whole runs over letters that are made up


def _case(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "customer"))


for _name in cases.ORACLES:
    QUERIES[_name], ORACLES[_name] = _case(getattr(cases, _name.removeprefix("case_"))), cases.ORACLES[_name]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One row for each mention of a kept value, with its entity and surrogate."""
    return engine.run(table(spark, d, "documents"), Settings(salt=SALT)).mentions.select("doc_id", "page_no", "start", "end", "type", "text", "entity_id", "surrogate")


QUERIES["flagship"] = flagship
