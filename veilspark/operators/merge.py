"""Merge: one span for each set of words, whichever finders and views reported it.

Spans share a word exactly if their word intervals overlap, so groups are islands over a running maximum
of interval ends: two windows on (doc, page), no graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..config import Settings
from ..functions.text import any_of, unicode_pattern, words_before
from .finders import SPAN_COLUMNS

PAGE = ["doc_id", "page_no"]


def validated(settings: Settings) -> Column:
    """Found by pattern alone and passed by a validator: such a span fixes its boundaries."""
    names = [t.name for t in settings.types if t.structured]
    return F.col("type").isin(names) & (F.col("confidence") >= 1.0) & (F.col("finders") == F.array(F.lit("regex")))


def finder_rank(name: Column) -> Column:
    out = F.lit(9)
    for finder, rank in config.FINDER_RANK.items():
        out = F.when(name == finder, F.lit(rank)).otherwise(out)
    return out


def type_rank() -> Column:
    """0 for a validated pattern hit, else the best rank among the span's finders."""
    best = F.array_min(F.transform("finders", finder_rank))
    return F.when(F.array_contains("finders", "regex") & (F.col("confidence") >= 1.0), F.lit(0)).otherwise(best)


def _recut(spans: DataFrame, views: DataFrame) -> DataFrame:
    """Text and words of spans whose offsets have changed. Edges skip what is no letter or digit."""
    joined = spans.join(views.select(*PAGE, F.col("text").alias("view_text")), PAGE)
    cut = F.expr("substring(view_text, start + 1, end - start)")
    lead = F.when(F.col("skip_start"), F.length(F.regexp_extract(cut, r"(?U)^[^\p{L}\p{N}]*", 0))).otherwise(0)
    trail = F.when(F.col("skip_end"), F.length(F.regexp_extract(cut, r"(?U)[^\p{L}\p{N}]*$", 0))).otherwise(0)
    moved = joined.withColumn("start", F.col("start") + lead).withColumn("end", F.greatest(F.col("end") - trail, F.col("start") + lead))
    text = F.col("view_text")
    moved = moved.withColumn("text", F.expr("substring(view_text, start + 1, end - start)"))
    return moved.withColumn("w0", words_before(text, F.col("start"))).withColumn("w1", words_before(text, F.col("end"))).select(SPAN_COLUMNS)


def trim_at_identifiers(spans: DataFrame, views: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A span that overlaps a validated identifier of its view becomes it, if it is hardly longer, or else
    loses the shorter side and the identifier. Identifiers act one after the other, in order of ``seq``."""
    s = settings or Settings()
    marked = spans.withColumn("fixed", validated(s))
    fixed = marked.where("fixed").groupBy(PAGE).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("start").alias("s"), F.col("end").alias("e")))).alias("ids"))
    joined = marked.join(fixed, PAGE, "left")

    def step(a: Column, v: Column) -> Column:
        apart = (v.e <= a.start) | (v.s >= a.end)
        become = a.end - a.start < v.e - v.s + 8
        head = v.s - a.start <= a.end - v.e
        start = F.when(apart, a.start).when(become, v.s).when(head, v.e).otherwise(a.start)
        end = F.when(apart, a.end).when(become, v.e).when(head, a.end).otherwise(v.s)
        return F.struct(start.alias("start"), end.alias("end"), (a.cut_start | (~apart & ~become & head)).alias("cut_start"), (a.cut_end | (~apart & ~become & ~head)).alias("cut_end"))

    first = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.lit(False).alias("cut_start"), F.lit(False).alias("cut_end"))
    moved = joined.withColumn("m", F.when(~F.col("fixed") & F.col("ids").isNotNull(), F.aggregate("ids", first, step)).otherwise(first))
    same = moved.where((F.col("m.start") == F.col("start")) & (F.col("m.end") == F.col("end"))).select(SPAN_COLUMNS)
    changed = moved.where((F.col("m.start") != F.col("start")) | (F.col("m.end") != F.col("end")))
    changed = changed.withColumn("skip_start", F.col("m.cut_start")).withColumn("skip_end", F.col("m.cut_end")).withColumn("start", F.col("m.start")).withColumn("end", F.col("m.end"))
    return same.unionByName(_recut(changed.select(*SPAN_COLUMNS, "skip_start", "skip_end"), views)).where("end > start")


def trim_addresses(spans: DataFrame, views: DataFrame) -> DataFrame:
    """An address found by its PIN starts after the last person or director number inside it, or after a
    company that begins before its first digit."""
    address = (F.col("type") == "ADDRESS") & F.array_contains("finders", "regex")
    inner = spans.where(F.col("type").isin("PERSON", "DIN", "ORG") & (F.col("confidence") >= 0.7)).select(*PAGE, F.col("start").alias("s"), F.col("end").alias("e"), F.col("type").alias("t"))
    first_digit = F.length(F.regexp_extract("text", r"^[^0-9]*", 0))
    whole = spans.where(address)
    cuts = whole.join(inner, PAGE).where((F.col("s") >= F.col("start")) & (F.col("e") <= F.col("end") - 8) & ((F.col("t") != "ORG") | (F.col("s") - F.col("start") < first_digit)))
    cuts = cuts.groupBy(*PAGE, "seq").agg(F.max("e").alias("cut"))
    joined = whole.join(cuts, [*PAGE, "seq"], "left")
    changed = joined.where("cut > start").withColumn("start", F.col("cut")).withColumn("skip_start", F.lit(True)).withColumn("skip_end", F.lit(False))
    kept = joined.where("cut is null or cut <= start").select(SPAN_COLUMNS)
    return spans.where(~address).select(SPAN_COLUMNS).unionByName(kept).unionByName(_recut(changed.select(*SPAN_COLUMNS, "skip_start", "skip_end"), views))


def groups(spans: DataFrame) -> DataFrame:
    """Adds ``island``: spans of a page whose word intervals chain."""
    return _groups(spans).drop("alone")


def _groups(spans: DataFrame) -> DataFrame:
    """``groups``, and whether a span is its island's only one."""
    order = W.partitionBy(PAGE).orderBy("w0", "w1", "seq")
    reach = F.max("w1").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("w0") > reach), 1).otherwise(0)
    alone = (F.col("new") == 1) & (F.coalesce(F.lead("new").over(order), F.lit(1)) == 1)
    return spans.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("alone", alone).drop("new")


def merge(spans: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row an island. The representative has the most words, then the longest text, then the best type
    rank and confidence, then the lowest ``seq``; if an identifier is validated only such members count,
    and the words are its own. Else the words are the members' union, and the type is the best ranked
    among members whose own pattern fits the representative's text. Exact ties go by ``seq``."""
    s = settings or Settings()
    size = F.col("w1") - F.col("w0") + 1
    rank = type_rank()
    islands = _groups(spans)
    ranked = lambda f: F.transform(F.array_sort(F.transform(f, lambda x: F.struct(finder_rank(x).alias("r"), x.alias("x")))), lambda x: x.x)
    # Most islands are one span, which stays as it is.
    own = F.when(F.size("finders") == 1, F.col("finders")).otherwise(ranked(F.array_distinct("finders")))
    single = islands.where("alone").withColumn("finders", own).select(SPAN_COLUMNS)
    marked = islands.where("not alone").withColumn("fixed", validated(s)).withColumn("rank", rank)
    body = F.struct("start", "end", "text", "type", "w0", "w1", "seq")
    key = F.struct(F.when(F.col("fixed"), 0).otherwise(1).alias("a"), (-size).alias("b"), (-F.length("text")).alias("c"), F.col("rank").alias("d"), (-F.col("confidence")).alias("e"), F.col("seq").alias("f"))
    votes = F.struct(F.col("rank").alias("rank"), (-F.col("confidence")).alias("c"), F.col("seq").alias("seq"), F.col("type").alias("type"))
    grouped = marked.groupBy(*PAGE, "island").agg(
        F.min_by(body, key).alias("best"), F.max("fixed").alias("fixed"), F.min("w0").alias("g0"), F.max("w1").alias("g1"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_list(votes)).alias("votes"), F.array_distinct(F.flatten(F.collect_list("finders"))).alias("f"),
    )
    fitting = F.filter("votes", lambda v: fits_type(v.type, F.col("best.text"), s))
    chosen = F.when(F.size(fitting) > 0, F.get(fitting, 0).type).otherwise(F.get("votes", 0).type)
    merged = grouped.select(
        *PAGE, F.col("best.start").alias("start"), F.col("best.end").alias("end"), F.col("best.text").alias("text"),
        F.when(F.col("fixed"), F.col("best.type")).otherwise(chosen).alias("type"), ranked(F.col("f")).alias("finders"), "confidence",
        F.when(F.col("fixed"), F.col("best.w0")).otherwise(F.col("g0")).alias("w0"), F.when(F.col("fixed"), F.col("best.w1")).otherwise(F.col("g1")).alias("w1"), F.col("best.seq").alias("seq"),
    )
    return single.unionByName(merged)


def fits_type(type_: Column, text: Column, settings: Settings) -> Column:
    """A structured type must match its own pattern in a text of at most 60 characters."""
    out = F.lit(True)
    for t in settings.types:
        if t.structured:
            out = F.when(type_ == t.name, (F.length(text) <= 60) & any_of([text.rlike(unicode_pattern(p)) for p in t.regex])).otherwise(out)
    return out
