"""Office files end to end: words with their places in runs, the engine, and the files written anew.

A file's words know the paragraph and the character where they begin among its runs' text; words cut by
a change of format are glued in the view. A mention's characters go back through the words that they
belong to, so each becomes an edit of one paragraph, or of several if it crosses line ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import finders, geometry, rewrite
from ..sources import readers
from . import engine
from .tables import written

PAGE = ["doc_id", "page_no"]


def placed(words: DataFrame) -> DataFrame:
    """Words with ``token``, their token's number on the page, and ``at_view``, where they begin in the view."""
    order = W.partitionBy(PAGE).orderBy("word_id")
    new = ~(F.col("block").eqNullSafe(F.lag("block").over(order)) & F.col("line").eqNullSafe(F.lag("line").over(order)))
    numbered = words.withColumn("new", new.cast("int")).withColumn("token", F.sum("new").over(order) - 1)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumn("at_view", before + F.col("token"))  # one sign between two tokens


def edits(words: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, edits): for each file the (mention, para, start, end, link, surrogate) that rewrite it."""
    named = mentions.select(*PAGE, F.col("start").alias("from"), F.col("end").alias("to"), "w0", "w1", "surrogate").withColumn("mention", F.struct("page_no", "from"))
    spot = placed(words).select(*PAGE, "token", "at_view", "para", "at", "link", F.length("text").alias("n"))
    met = named.join(spot, PAGE).where(F.col("token").between(F.col("w0"), F.col("w1")))
    low, high = F.greatest(F.col("from"), F.col("at_view")), F.least(F.col("to"), F.col("at_view") + F.col("n"))
    parts = met.where(low < high).withColumn("lo", F.col("at") + low - F.col("at_view")).withColumn("hi", F.col("at") + high - F.col("at_view"))
    whole = parts.groupBy("doc_id", "mention", "para", "link", "surrogate").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))
    return whole.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mention", "para", "start", "end", "link", "surrogate"))).alias("edits"))


def rewritten(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, path, content) of all files with their edits made."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, path, content, found in frame[["doc_id", "path", "content", "edits"]].itertuples(index=False):
                by_mention: dict[tuple, list] = {}
                for e in found if found is not None else []:
                    by_mention.setdefault(tuple(e["mention"].values()), []).append(e)
                changes, links = {}, {}
                for parts in by_mention.values():
                    if parts[0]["link"] is not None:
                        links[parts[0]["link"]] = parts[0]["surrogate"]
                        continue
                    texts = rewrite.split_over_lines(parts[0]["surrogate"].replace("\n", " "), [p["end"] - p["start"] for p in parts])
                    for p, text in zip(parts, texts):
                        changes.setdefault(p["para"], []).append((p["start"], p["end"], text))
                rows.append((doc_id, path, readers.write_docx(bytes(content), changes, links)))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "content"])

    return files.join(wanted, "doc_id", "left").mapInPandas(run, "doc_id string, path string, content binary")


def redact_files(spark: SparkSession, path: str, settings: Settings | None = None, models: Sequence[finders.Finder] = ()) -> tuple[engine.Run, DataFrame]:
    """A run over the DOCX files at ``path``, and (doc_id, path, content) of the files to hand on: those of
    which no page leaks."""
    s = settings or Settings()
    files = written(readers.open_files(spark, path).where("format = 'docx'"), "files")
    words = written(readers.docx_words(files, s.paragraphs_per_page), "words")
    result = engine.run(None, s, models, views=geometry.layout_views(words))
    out = written(rewritten(files, edits(words, result.mentions)), "rewritten")
    return result, out.join(result.leaks.select("doc_id").distinct(), "doc_id", "left_anti")
