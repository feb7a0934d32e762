"""Text views of documents: paragraphs, words, pages, and what finders read.

A text without page geometry has one view: paragraphs are lines, a page holds a fixed number of them,
words are runs of non-space. Inside the view words are single-spaced and paragraphs end lines, so a
word's number is the count of separators before it, and spans carry intervals of word numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings

SLASHED = r"^([(\[]?)([A-Za-z]{2,}(?:/[A-Za-z]{2,})+)([,.;:)\]]*)$"


def page_views(docs: DataFrame, settings: Settings | None = None, split_slashes: bool = True) -> DataFrame:
    """(doc_id, page_no, text): one row a page that has a word. Narrow: no shuffle.

    Null texts have no pages. Slash-joined words are split as in ``slash_split``.
    """
    per = (settings or Settings()).paragraphs_per_page
    paragraphs = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    if split_slashes:
        paragraphs = F.transform(paragraphs, lambda x: F.when(x.contains("/"), F.array_join(F.flatten(F.transform(F.split(x, " "), slash_parts)), " ")).otherwise(x))
    last = F.floor((F.size("p") - 1) / per).cast("int")
    pages = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i + 1).alias("page_no"), F.array_join(F.filter(F.slice(F.col("p"), i * per + 1, F.lit(per)), lambda x: x != ""), "\n").alias("text")))
    return docs.select("doc_id", paragraphs.alias("p")).select("doc_id", F.explode(pages).alias("v")).select("doc_id", "v.page_no", "v.text").where("text <> ''")


def slash_parts(word: Column) -> Column:
    """``(Alpha/Beta,`` becomes ``(Alpha`` and ``Beta,``; other words stay."""
    core = F.split(F.regexp_extract(word, SLASHED, 2), "/")
    lead, tail = F.regexp_extract(word, SLASHED, 1), F.regexp_extract(word, SLASHED, 3)
    parts = F.transform(core, lambda p, i: F.concat(F.when(i == 0, lead).otherwise(""), p, F.when(i == F.size(core) - 1, tail).otherwise("")))
    return F.when(word.rlike(SLASHED), parts).otherwise(F.array(word))


def words(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, page_no, word_id, text, block): one row a word; ids restart on every page."""
    per = (settings or Settings()).paragraphs_per_page
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block", "line"))
    each = lines.select("doc_id", "block", F.posexplode(F.filter(F.split("line", r"(?U)\s+"), lambda w: w != "")).alias("pos", "text"))
    paged = each.select("doc_id", (F.floor(F.col("block") / per) + 1).cast("int").alias("page_no"), "block", "pos", "text")
    order = W.partitionBy("doc_id", "page_no").orderBy("block", "pos")
    return paged.select("doc_id", "page_no", (F.row_number().over(order) - 1).alias("word_id"), "text", "block")


def view_of_words(table: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) from a words table: a space inside a block, a line end between blocks."""
    order = W.partitionBy("doc_id", "page_no").orderBy("word_id")
    before = F.lag("block").over(order)
    sep = F.when(before.isNull(), "").when(before == F.col("block"), " ").otherwise("\n")
    glued = table.select("doc_id", "page_no", "word_id", F.concat(sep, "text").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("word_id", "part")))
    return glued.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(ordered, lambda x: x.part), "").alias("text"))


def routing_signals(pages: DataFrame, settings: Settings | None = None, area: str = "width * height", image_area: str = "0.0D") -> DataFrame:
    """(doc_id, page_no, text_density, single_letter_ratio, image_area_ratio, hard) of pages with text
    and, where the source has any, geometry (``area`` and ``image_area`` are SQL expressions)."""
    s = settings or Settings()
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    chars = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    ones = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    out = pages.select("doc_id", "page_no", (chars / F.expr(area)).alias("text_density"), F.coalesce(F.try_divide(ones, F.size(tokens)), F.lit(0.0)).alias("single_letter_ratio"), (F.expr(image_area) / F.expr(area)).alias("image_area_ratio"))
    return out.withColumn("hard", (F.col("text_density") < s.min_text_density) | (F.col("single_letter_ratio") > s.max_single_letter_ratio) | (F.col("image_area_ratio") > s.max_image_area_ratio))


def model_pages(signals: DataFrame, sample: float) -> DataFrame:
    """Pages that go to an expensive finder: hard ones, and every 1/sample-th page number."""
    easy = F.pmod("page_no", F.lit(round(1 / sample))) == 0 if sample > 0 else F.lit(False)
    return signals.where(F.col("hard") | easy)


def only_pages(views: DataFrame, spec: str) -> DataFrame:
    """``1-6,128``: those page numbers."""
    tests = F.lit(False)
    for part in filter(None, spec.split(",")):
        lo, _, hi = part.partition("-")
        tests = tests | F.col("page_no").between(int(lo), int(hi or lo))
    return views.where(tests)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start,text>>: pieces of at most ``size`` characters, each but the last ending with the last
    line end or sentence end of its final third, if that has any; the next one starts ``overlap`` before.

    A fold over as many steps as the shortest pieces would need; steps past the last piece do nothing.
    """
    third = size * 2 // 3
    steps = F.ceil(F.length(text) / max(1, third + 1 - overlap)).cast("int") + 1
    state = "struct<at:int,out:array<struct<start:int,text:string>>>"

    def step(a: Column, _: Column) -> Column:
        piece = F.substring(text, a.at + 1, F.lit(size))
        # Greedy up to a line end or to a full stop before a space.
        kept = F.length(F.regexp_extract(F.substring(piece, third + 1, size), r"(?s)^.*(?:\n|[.](?= ))", 0))
        ends = a.at + F.length(piece) >= F.length(text)
        cut = F.when(ends | (kept == 0), F.length(piece)).otherwise(kept + third)
        following = F.when(ends, F.length(text)).otherwise(F.greatest(a.at + cut - overlap, a.at + 1))
        item = F.struct(a.at.alias("start"), F.substring(piece, F.lit(1), cut).alias("text"))
        return F.when(a.at >= F.length(text), a).otherwise(F.struct(following.cast("int").alias("at"), F.concat(a.out, F.array(item)).alias("out")).cast(state))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")).cast(state)
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    return F.when(F.length(text).between(1, size), whole).otherwise(F.aggregate(F.sequence(F.lit(1), steps), begin, step).out)
