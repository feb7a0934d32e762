"""Whole runs over letters made up from the customers table, two pages each, in which every stage has work:
names and organisations from a model, e-mails, cards and addresses, what to keep, to review and to drop.
What must come out follows from how the letters are made, and is stated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import evaluate, finders, rewrite
from . import engine

FIRST, LAST = ("Asha", "Ravi", "Meera"), ("Nair", "Iyer", "Bose", "Shah")
FIRM, LONE, EXEMPT, ROLE = "Borealis Trading Limited", "Quorum", "SEBI", "company secretary"
#: The address begins behind the last full stop from which it has a number, three words and a street word.
CARD, PLOT, ADDRESS = "4111 1111 1111 1111", "Plot No. ", "12, MG Road, Pune 411 001, Maharashtra, India"
KNOWN = {f"{a} {b}": "PERSON" for a in FIRST for b in LAST} | {FIRM: "ORG", LONE: "ORG", EXEMPT: "ORG", ROLE: "PERSON"}

_PAGE_1 = f"""'Contact Mr. ' || f || ' ' || l || ' by mail to ' || m || ' now.' || chr(10) || l || ' signed for {FIRM}.' || chr(10) || 'Card {CARD} was used.' || chr(10)
  || 'Registered office: {PLOT}{ADDRESS}' || chr(10) || CASE WHEN k % 2 = 1 THEN '{LONE} met. ' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'The {EXEMPT} order stands. ' ELSE '' END || 'Ask the {ROLE} too.'"""
_PAGE_2 = "f || ' ' || l || ' wrote again from ' || m || ' today.'"
LETTERS = f"""WITH n AS (SELECT c_custkey AS k, ['{"', '".join(FIRST)}'][(c_custkey % 3 + 1)::INTEGER] AS f, ['{"', '".join(LAST)}'][(c_custkey // 3 % 4 + 1)::INTEGER] AS l FROM customer),
c AS (SELECT *, lower(f) || '.' || lower(l) || k || '@mail.example' AS m FROM n),
p AS (SELECT *, {_PAGE_1} AS t1, {_PAGE_2} AS t2 FROM c)"""


def letters(customers: DataFrame) -> DataFrame:
    """(doc_id, page_no, text)."""
    k = F.col("c_custkey")
    name = lambda names, by: F.get(F.array(*map(F.lit, names)), by.cast("int"))
    # A key becomes two pages, so a small file of keys is dealt out before the texts are made.
    customers = customers.select("c_custkey").repartition(int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = customers.select(k.alias("doc_id"), name(FIRST, k % 3).alias("f"), name(LAST, F.floor(k / 3) % 4).alias("l"))
    both = named.withColumn("m", F.concat(F.lower("f"), F.lit("."), F.lower("l"), "doc_id", F.lit("@mail.example"))).withColumn("n", F.concat_ws(" ", "f", "l"))
    extra = [F.when(F.col("doc_id") % 2 == 1, f"{LONE} met. ").otherwise(""), F.when(F.col("doc_id") % 3 == 0, f"The {EXEMPT} order stands. ").otherwise("")]
    one = F.concat(
        F.lit("Contact Mr. "), "n", F.lit(" by mail to "), "m", F.lit(" now.\n"), "l", F.lit(f" signed for {FIRM}.\nCard {CARD} was used.\nRegistered office: {PLOT}{ADDRESS}\n"), *extra, F.lit(f"Ask the {ROLE} too."),
    )
    two = F.concat("n", F.lit(" wrote again from "), "m", F.lit(" today."))
    return both.select("doc_id", F.posexplode(F.array(one, two)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def run(customers: DataFrame) -> engine.Run:
    model = finders.gazetteer(KNOWN)
    return engine.run(None, Settings(salt="oracle-salt"), views=letters(customers), models=[lambda v: finders.find_with_model(v, model)])


def entities(customers: DataFrame) -> DataFrame:
    return run(customers).clustered[0].select("doc_id", "entity_id", "type", F.col("canonical").alias("real"), "mention_count", "pages")


def surrogates(customers: DataFrame) -> DataFrame:
    """Whether each mention's surrogate keeps what it must: another value, of the value's own kind."""
    mentions = run(customers).mentions
    shape = F.when(F.col("type") == "EMAIL", r"^[a-z0-9.]+@example\.com$").when(F.col("type") == "CREDIT_CARD", "^[0-9]{4}( [0-9]{4}){3} $").when(F.col("type") == "ORG", " Limited$").when(F.col("type") == "PERSON", "^[A-Z][a-z]+( [A-Z][a-z]+)?$").otherwise(".")
    fits = (F.col("surrogate") != F.col("text")) & F.expr("surrogate rlike shape")
    return mentions.withColumn("shape", shape).groupBy("doc_id", "entity_id").agg(F.count_if(fits).alias("fitting"), F.countDistinct(F.when(F.col("text").contains(" ") | (F.col("type") != "PERSON"), F.col("surrogate"))).alias("spellings"))


def decisions(customers: DataFrame) -> DataFrame:
    return run(customers).judged.select("doc_id", "page_no", "type", "text", "decision", "reason", F.array_join("finders", "+").alias("finder"), "confidence")


def tagged(customers: DataFrame) -> DataFrame:
    """The pages with each mention's entity in place of its surrogate."""
    result = run(customers)
    return rewrite.rewrite(result.views, result.clustered[1].withColumn("surrogate", F.concat(F.lit("<"), "entity_id", F.lit(">"))))


def leaks(customers: DataFrame) -> DataFrame:
    """What the leak scan reports of pages that nobody has rewritten; none is left in those that are."""
    result = run(customers)
    wanted = rewrite.needles(result.entities, result.mentions, Settings())
    found = rewrite.leaks(result.views, wanted).select("doc_id", "page_no", "entity_id", F.lit("original").alias("pages"))
    return found.unionByName(result.leaks.select("doc_id", "page_no", "entity_id", F.lit("rewritten").alias("pages"))).distinct()


def scores(customers: DataFrame) -> DataFrame:
    """The run's mentions against a truth that lacks two of them in each letter and has one more."""
    found = run(customers).clustered[1].select("doc_id", F.col("page_no").alias("page"), "text", "type")
    both = letters(customers).where("page_no = 1").select("doc_id", "text")
    name = F.regexp_extract("text", r"Mr[.] (\w+ \w+) by", 1)
    mail = F.regexp_extract("text", r"to (\S+) now", 1)
    row = lambda page, text, kind: F.struct(F.lit(page).alias("page"), text.alias("text"), F.lit(kind).alias("type"))
    known = [row(1, name, "PERSON"), row(2, name, "PERSON"), row(1, mail, "EMAIL"), row(2, F.upper(mail), "EMAIL"), row(1, F.lit(FIRM), "ORG"), row(1, F.lit("Someone Missed"), "PERSON")]
    truth = both.select("doc_id", F.explode(F.array(*known)).alias("x")).select("doc_id", "x.page", "x.text", "x.type")
    pred, truth = evaluate.numbered(found), evaluate.numbered(truth)
    scored = evaluate.scores(pred, truth, evaluate.match(pred, truth))
    return scored.select(F.coalesce("type", F.lit("all")).alias("type"), "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


# ---------------------------------------------------------------- what must come out
# A card's pattern takes one separator after the last digit too.

_FOUND = f"""{LETTERS},
x AS (
  SELECT k, 1 AS page_no, 'PERSON' AS type, f || ' ' || l AS text, 'P1' AS entity_id, 'kept' AS decision, 'kept' AS reason, 'gliner' AS finder, 0.9 AS confidence FROM p
  UNION ALL SELECT k, 1, 'EMAIL', m, 'EMAIL1', 'kept', 'kept', 'regex', 0.8 FROM p
  UNION ALL SELECT k, 1, 'PERSON', l, 'P1', 'kept', 'kept', 'propagate', 0.9 FROM p
  UNION ALL SELECT k, 1, 'ORG', '{FIRM}', 'ORG1', 'kept', 'kept', 'gliner', 0.9 FROM p
  UNION ALL SELECT k, 1, 'CREDIT_CARD', '{CARD} ', 'CREDIT_CARD1', 'kept', 'kept', 'regex', 1.0 FROM p
  UNION ALL SELECT k, 1, 'ADDRESS', '{ADDRESS}', 'ADDR1', 'kept', 'kept', 'regex', 0.85 FROM p
  UNION ALL SELECT k, 1, 'ORG', '{LONE}', NULL, 'review', 'judge_org_context', 'gliner', 0.9 FROM p WHERE k % 2 = 1
  UNION ALL SELECT k, 1, 'ORG', '{EXEMPT}', NULL, 'dropped', 'judge_exempt', 'gliner', 0.9 FROM p WHERE k % 3 = 0
  UNION ALL SELECT k, 1, 'PERSON', '{ROLE}', NULL, 'dropped', 'no_capital', 'gliner', 0.9 FROM p
  UNION ALL SELECT k, 2, 'PERSON', f || ' ' || l, 'P1', 'kept', 'kept', 'gliner', 0.9 FROM p
  UNION ALL SELECT k, 2, 'EMAIL', m, 'EMAIL1', 'kept', 'kept', 'regex', 0.8 FROM p)"""

_SCORES = """WITH n AS (SELECT count(*) AS n FROM customer), s(type, tp, fp, fn) AS (VALUES ('PERSON', 2, 1, 1), ('EMAIL', 2, 0, 0), ('ORG', 1, 0, 0), ('ADDRESS', 0, 1, 0), ('CREDIT_CARD', 0, 1, 0), ('all', 5, 3, 1)),
r AS (SELECT *, CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM s)
SELECT type, tp * n AS tp, fp * n AS fp, fn * n AS fn, round(p, 9)::DOUBLE AS precision, round(q, 9)::DOUBLE AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9)::DOUBLE AS f1 FROM r, n"""

ORACLES = {
    "case_scores": _SCORES,
    "case_entities": f"""{_FOUND} SELECT k AS doc_id, entity_id, type, trim(max_by(text, length(text))) AS real, count(*) AS mention_count, string_agg(DISTINCT page_no::VARCHAR, ';' ORDER BY page_no::VARCHAR) AS pages
FROM x WHERE decision = 'kept' GROUP BY 1, 2, 3""",
    "case_surrogates": f"{_FOUND} SELECT k AS doc_id, entity_id, count(*) AS fitting, 1::BIGINT AS spellings FROM x WHERE decision = 'kept' GROUP BY 1, 2",
    "case_decisions": f"{_FOUND} SELECT k AS doc_id, page_no, type, text, decision, reason, finder, confidence::DOUBLE AS confidence FROM x",
    "case_tagged": f"""{LETTERS} SELECT k AS doc_id, 1 AS page_no, replace(replace(replace(replace(replace(replace(t1, f || ' ' || l, '<P1>'), m, '<EMAIL1>'), chr(10) || l || ' ', chr(10) || '<P1> '), '{FIRM}', '<ORG1>'), '{CARD}', '<CREDIT_CARD1>'), '{ADDRESS}', '<ADDR1>') AS text FROM p
UNION ALL SELECT k, 2, replace(replace(t2, f || ' ' || l, '<P1>'), m, '<EMAIL1>') FROM p""",
    "case_leaks": f"{_FOUND} SELECT DISTINCT k AS doc_id, page_no, entity_id, 'original' AS pages FROM x WHERE decision = 'kept'",
}
