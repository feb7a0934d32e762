"""Rewriting pages, checking them for leaks, and the tables that go with a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import casefold, strip_space

PAGE = ["doc_id", "page_no"]


def word_offsets(text: Column, word: Column) -> Column:
    """Offset at which word number ``word`` of a single-spaced text begins."""
    before = F.call_function("substring_index", F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(" "), word)
    return F.when(word > 0, F.length(before) + 1).otherwise(0)


def apply_edits(text: Column, edits: Column) -> Column:
    """Non-overlapping (start, end, repl) edits, sorted: untouched stretches and replacements in turn."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, e: F.struct(F.greatest(e.end, a.at).alias("at"), F.concat(a.out, F.substring(text, a.at + 1, F.greatest(e.start - a.at, F.lit(0))), e.repl).alias("out"))
    done = F.aggregate(edits, zero, step)
    return F.concat(done.out, F.substring(text, done.at + 1, F.length(text)))


def rewrite(views: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) with surrogates. A mention's whole words go; punctuation that its text left
    out at either end stays."""
    tight = mentions.withColumn("end", F.col("start") + F.length(F.rtrim(F.col("text"), F.lit(" \n")))).withColumn("surrogate", F.rtrim(F.col("surrogate"), F.lit(" \n")))
    with_text = tight.join(views.select(*PAGE, F.col("text").alias("view_text")), PAGE)
    first = word_offsets(F.col("view_text"), F.col("w0"))
    last = F.length(F.regexp_extract(F.expr("substring(view_text, end + 1, length(view_text))"), r"^[^ \n]*", 0)) + F.col("end")
    head, tail = F.expr("substring(view_text, lo + 1, greatest(start - lo, 0))"), F.expr("substring(view_text, end + 1, greatest(hi - end, 0))")
    bare = lambda c: F.regexp_replace(c, r"[\p{L}\p{N}].*$", "")
    wide = with_text.withColumn("lo", F.least(first, F.col("start"))).withColumn("hi", F.greatest(last, F.col("end")))
    edits = wide.select(*PAGE, F.struct(F.col("lo").alias("start"), F.col("hi").alias("end"), F.concat(bare(head), F.col("surrogate"), F.regexp_extract(tail, r"[^\p{L}\p{N}]*$", 0)).alias("repl")).alias("edit"))
    by_page = edits.groupBy(PAGE).agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    return views.join(by_page, PAGE, "left").select(*PAGE, F.when(F.col("edits").isNull(), F.col("text")).otherwise(apply_edits(F.col("text"), F.col("edits"))).alias("text"))


def needle(text: Column) -> Column:
    return casefold(strip_space(text))


def needles(entities: DataFrame, mentions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, entity_id, needle): what must not be found again. Short ones, short numbers and mere role
    words are left out."""
    s = settings or Settings()
    raw = entities.select("doc_id", "entity_id", "type", F.col("canonical").alias("raw")).union(mentions.select("doc_id", "entity_id", "type", F.col("text").alias("raw")))
    role = F.lit(False)
    words = F.regexp_extract_all("raw", F.lit(r"(?U)\w+"), F.lit(0))
    for t in s.types:
        if t.generic_words:
            role = F.when(F.col("type") == t.name, _all_in(words, t.generic_words)).otherwise(role)
    n = F.col("needle")
    ok = (F.length(n) >= 5) & ~(n.rlike("^[0-9]+$") & (F.length(n) < 7)) & ~role
    return raw.withColumn("needle", needle(F.col("raw"))).where(ok).select("doc_id", "entity_id", "needle").distinct()


def _all_in(words: Column, known: tuple[str, ...]) -> Column:
    return (F.size(words) > 0) & F.forall(words, lambda w: F.lower(w).isin(list(known)))


def leaks(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page_no, entity_id, needle): real values that still stand in rewritten pages."""
    flat = pages.select(*PAGE, needle(F.col("text")).alias("hay"))
    return flat.join(wanted, "doc_id").where(F.contains("hay", "needle")).select(*PAGE, "entity_id", "needle")


def before_legend(units: DataFrame, heading: str, order: str = "page_no") -> DataFrame:
    """Units before the first that begins with the legend's heading."""
    cut = units.where(F.ltrim("text").startswith(heading)).groupBy("doc_id").agg(F.min(order).alias("cut"))
    return units.join(cut, "doc_id", "left").where(F.col("cut").isNull() | (F.col(order) < F.col("cut"))).drop("cut")


def mapping(entities: DataFrame) -> DataFrame:
    return entities.select("doc_id", "entity_id", "type", F.col("canonical").alias("real"), "surrogate", "mention_count", "pages")


def nested_mapping(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``mapping`` with each entity's mentions, in order, for a JSON file."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("page"), "start", "text", "surrogate")))
    each = mentions.groupBy("doc_id", "entity_id").agg(F.transform(listed, lambda m: F.struct(m.page.alias("page"), m.text.alias("text"), m.surrogate.alias("surrogate"))).alias("mentions"))
    return mapping(entities).join(each, ["doc_id", "entity_id"], "left")


def legend(entities: DataFrame, mode: str) -> DataFrame:
    """Rows of the table appended to a document: none, surrogates only, or also the real values."""
    chosen = entities.select("doc_id", "entity_id", "type", "surrogate", *([F.col("canonical").alias("real")] if mode == "full" else []))
    return chosen.limit(0) if mode == "none" else chosen


def mentions_by_page(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(PAGE).agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_id", "type", "surrogate"))).alias("mentions"))


def reading_order(spans: DataFrame) -> DataFrame:
    """Spans by document, page and first word, the longer first: the order of files."""
    return spans.orderBy("doc_id", "page_no", "w0", F.desc("w1"), "type")


def span_rows(mentions: DataFrame) -> DataFrame:
    """The columns of a spans file."""
    return reading_order(mentions).select("doc_id", F.col("page_no").alias("page"), "text", "type", "entity_id", F.array_join("finders", "+").alias("finder"), F.round("confidence", 2).alias("confidence"), "surrogate")


def review_rows(judged: DataFrame) -> DataFrame:
    """The columns of a review file, for a person to label."""
    return reading_order(judged.where("decision = 'review'")).select("doc_id", F.col("page_no").alias("page"), "text", "type", F.array_join("finders", "+").alias("finder"), "confidence", F.lit("").alias("human_label"))


def audit_rows(judged: DataFrame, events: DataFrame | None, run_id: str) -> DataFrame:
    """One record for each judged span, and for each event of a finder."""
    evidence = F.to_json(F.struct("text", "type", "confidence", "finders"))
    rows = judged.select("doc_id", "page_no", F.lit("judge").alias("stage"), F.col("reason").alias("backend"), "confidence", evidence.alias("evidence"))
    if events is not None:
        told = F.to_json(F.struct("type", "detail"))
        rows = rows.unionByName(events.select("doc_id", "page_no", F.concat_ws("_", "stage", "event").alias("stage"), F.col("stage").alias("backend"), F.lit(None).cast("double").alias("confidence"), told.alias("evidence")))
    return rows.select(F.current_timestamp().alias("ts"), F.lit(run_id).alias("run_id"), "*")


def split_over_lines(surrogate: str, lengths: list[int]) -> list[str]:
    """A surrogate over line pieces in proportion to their lengths, cut at spaces where one is near."""
    total, out, at, done = sum(lengths) or 1, [], 0, 0
    for n in lengths[:-1]:
        done += n
        want = round(len(surrogate) * done / total)
        near = [i for i in range(max(at, want - 4), min(len(surrogate), want + 4) + 1) if surrogate[i : i + 1] == " "]
        cut = min(near, key=lambda i: abs(i - want)) if near else max(at, want)
        out.append(surrogate[at:cut].strip())
        at = cut
    return [*out, surrogate[at:].strip()]
