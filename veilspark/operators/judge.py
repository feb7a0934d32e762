"""Judge: an ordered list of rules, first match wins, as one CASE that gives decision and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PiiType, Settings
from ..functions.text import any_of, has_context, phrase_pattern, strip_space, unicode_pattern
from ..functions.validators import VALIDATORS
from .. import config
from .finders import SPAN_COLUMNS, context_pages

PAGE = ["doc_id", "page_no"]


def resolve_parked(parked: DataFrame, views: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Parked spans whose page before, by number, has a context word of their type."""
    s = settings or Settings()
    out = parked.limit(0).select(SPAN_COLUMNS)
    for t in s.enabled():
        if t.requires_context and t.context_scope == "doc":
            seen = context_pages(views, t).withColumn("page_no", F.col("page_no") + 1)
            out = out.unionByName(parked.where(F.col("type") == t.name).join(seen, PAGE, "left_semi").select(SPAN_COLUMNS))
    return out


def _by_type(settings: Settings, test) -> Column:
    out = F.lit(False)
    for t in settings.types:
        if (rule := test(t)) is not None:
            out = F.when(F.col("type") == t.name, rule).otherwise(out)
    return F.coalesce(out, F.lit(False))


def shape_ok(t: PiiType, text: Column) -> Column:
    """At most 60 characters, with a match of the type's pattern that its validator passes."""
    tests = []
    for p in t.regex:
        found = F.regexp_extract_all(text, F.lit(unicode_pattern(p)), F.lit(0))
        value = (lambda m: strip_space(m)) if t.name in config.SPACE_TOLERANT else (lambda m: m)
        tests.append(F.exists(found, lambda m: F.coalesce(VALIDATORS[t.validator](value(m)), F.lit(False))) if t.validator else F.size(found) > 0)  # noqa: B023
    return (F.length(text) <= 60) & any_of(tests)


def is_generic(t: PiiType, text: Column) -> Column:
    """No word, only role words, or one bare acronym."""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'&.-]*"), F.lit(0))
    one = F.get(tokens, 0)
    upper, lower = F.length(F.regexp_replace(one, "[^A-Z]", "")), F.length(F.regexp_replace(one, "[^a-z]", ""))
    acronym = (F.size(tokens) == 1) & (F.length(one) <= 6) & (upper >= 2) & (lower <= 1)
    return (F.size(tokens) == 0) | F.forall(tokens, lambda w: F.lower(w).isin(list(t.generic_words))) | F.coalesce(acronym, F.lit(False))


def judge(merged: DataFrame, views: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Adds decision (kept, review, dropped) and reason to every merged span."""
    s = settings or Settings()
    text = F.col("text")
    flat = F.regexp_replace(F.trim(text), r"(?U)\s+", " ")
    one_finder = F.size("finders") == 1
    independent = F.size(F.array_remove("finders", "propagate"))
    named = F.col("type").isin("PERSON", "ORG")
    words = F.filter(F.split(flat, " "), lambda w: w != "")

    exempt = _by_type(s, lambda t: F.lit(True) if t.policy == "exempt" else F.lower(flat).rlike(phrase_pattern(t.allowlist)) if t.allowlist else None)
    misshapen = _by_type(s, lambda t: ~shape_ok(t, text) if t.structured else None)
    short = _by_type(s, lambda t: F.length(F.trim(text)) < t.min_chars if t.min_chars else None)
    to_review = _by_type(s, lambda t: F.lit(True) if t.policy == "review" else None)
    generic = _by_type(s, lambda t: is_generic(t, text) if t.name in ("PERSON", "ORG") else None)
    corporate = _by_type(s, lambda t: has_context(F.col("view_text"), F.col("start"), F.col("end"), t.context_words, 60) if t.name == "ORG" else None)
    lone = _by_type(s, lambda t: F.size(words) == 1 if t.single_token_needs_context else None)
    llm_only = F.col("finders") == F.array(F.lit("llm"))

    rules = [
        (exempt, "dropped", "judge_exempt"),
        (misshapen | ((F.col("type") == "ADDRESS") & ~text.rlike(r"\p{L}")), "dropped", "judge_shape"),
        (short, "dropped", "judge_short"),
        (to_review, "review", "policy_review"),
        (named & ~text.rlike(r"\p{Lu}"), "dropped", "no_capital"),
        (generic, "dropped", "judge_generic"),
        (one_finder & (F.col("confidence") < s.drop_below), "dropped", "judge_drop"),
        (one_finder & (F.col("confidence") < s.review_below), "review", "low_confidence"),
        ((F.col("type") == "ORG") & lone & (independent <= 1) & ~corporate, "review", "judge_org_context"),
        (llm_only & (((F.col("type") == "ORG") & ~corporate) | ((F.col("type") == "ADDRESS") & ~text.rlike("[0-9]"))), "review", "judge_llm_only"),
    ]
    verdict = F.struct(F.lit("kept").alias("decision"), F.lit("kept").alias("reason"))
    for test, decision, reason in reversed(rules):
        verdict = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(verdict)
    seen = merged.join(views.select(*PAGE, F.col("text").alias("view_text")), PAGE)
    return seen.withColumn("v", verdict).select(*SPAN_COLUMNS, "v.decision", "v.reason")


def seed_filter(spans: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Raw spans sure enough to search the rest of their document for."""
    s = settings or Settings()
    text = F.col("text")
    exempt = _by_type(s, lambda t: F.lit(True) if t.policy == "exempt" else F.lower(text).rlike(phrase_pattern(t.allowlist)) if t.allowlist else None)
    misshapen = _by_type(s, lambda t: ~shape_ok(t, text) if t.structured else None)
    generic = _by_type(s, lambda t: is_generic(t, text) if t.name in ("PERSON", "ORG") else None)
    named = ~F.col("type").isin("PERSON", "ORG") | text.rlike(r"\p{Lu}")
    return spans.where((F.col("confidence") >= 0.7) & ~exempt & ~misshapen & ~generic & named & (F.length(text) >= 4))
