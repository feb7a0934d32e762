"""The whole run: pages, spans, merged, judged, entities, rewritten pages, leaks. Tables that several
later stages read are written once; what comes after judging is worked out when it is first asked for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import entities as ent
from ..operators import finders, rewrite
from ..operators import judge as jdg
from ..operators import merge as mrg
from ..operators import surrogates as sur
from ..operators.views import model_pages, only_pages, page_views
from .tables import written


@dataclass
class Run:
    views: DataFrame
    raw: DataFrame
    merged: DataFrame
    judged: DataFrame
    settings: Settings
    events: DataFrame | None = None
    signals: DataFrame | None = None

    @cached_property
    def clustered(self) -> tuple[DataFrame, DataFrame]:
        """Entities and mentions, as yet without surrogates."""
        entities, mentions = ent.cluster(self.judged.where("decision = 'kept'").drop("decision", "reason"), self.settings.redact_empty_keys)
        return written(entities, "entities"), written(mentions, "mentions")

    @cached_property
    def assigned(self) -> tuple[DataFrame, DataFrame]:
        entities, mentions = sur.assign(*self.clustered, self.settings)
        return written(entities, "entities"), written(mentions, "mentions")

    @property
    def entities(self) -> DataFrame:
        return self.assigned[0]

    @property
    def mentions(self) -> DataFrame:
        return self.assigned[1]

    @cached_property
    def pages(self) -> DataFrame:
        return written(rewrite.rewrite(self.views, self.mentions), "pages")

    @cached_property
    def leaks(self) -> DataFrame:
        return rewrite.leaks(self.pages, rewrite.needles(self.entities, self.mentions, self.settings))

    def safe_pages(self) -> DataFrame:
        """The rewritten pages of documents that do not leak: what may be handed on."""
        return self.pages.join(self.leaks.select("doc_id").distinct(), "doc_id", "left_anti")

    def summary(self) -> DataFrame:
        """A row for each document with pages: what was found, and whether nothing leaks. With signals also
        the hard pages and those that went to a model."""
        tables = {"pages": self.views, "spans": self.mentions, "entities": self.entities, "review_items": self.judged.where("decision = 'review'"), "leaks": self.leaks}
        if self.events is not None:
            tables |= {e: self.events.where(F.col("event") == e) for e in ("failed", "unlocated")}
        if self.signals is not None:
            tables |= {"hard_pages": self.signals.where("hard"), "model_pages": self.signals.where("to_model")}
        parts = [t.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(k)) for k, t in tables.items()]
        counts = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in tables))
        return counts.withColumn("verify", F.when(F.col("leaks") == 0, "ok").otherwise("verify_failed"))


def run(
    docs: DataFrame, settings: Settings | None = None, models: Sequence[finders.Finder] = (), pages: str | None = None, views: DataFrame | None = None, addresses: bool = True, propagate: bool = True,
    signals: DataFrame | None = None,
) -> Run:
    """``docs``: doc_id and text. ``models``: further finders, functions from views to spans (and events). Only
    the pages in ``pages`` ("1-6,128") are read. ``signals``: routing signals of pages; with them, models
    get only the pages that ``model_pages`` picks. All shuffles are on doc_id or (doc_id, page_no)."""
    s = sur.salted(settings or Settings())
    views = page_views(docs, s) if views is None else views
    views = written(only_pages(views, pages) if pages else views, "views")
    hits = written(finders.regex_candidates(views, s), "hits")
    found, parked = finders.split_parked(hits, s)
    routed = views
    if signals is not None:
        chosen = model_pages(signals, s.easy_page_sample).select("doc_id", "page_no", F.lit(True).alias("to_model"))
        signals = written(signals.join(chosen, ["doc_id", "page_no"], "left").withColumn("to_model", F.coalesce("to_model", F.lit(False))), "signals")
        routed = views.join(signals.where("to_model"), ["doc_id", "page_no"], "left_semi")
    told = [x if isinstance(x, tuple) else (x, None) for x in (m(routed) for m in models)]
    events = [e for _, e in told if e is not None]
    others = ([finders.find_addresses(views, s)] if addresses else []) + [x for x, _ in told]
    raw = written(finders.union(found, *others), "raw") if others else found
    more = [jdg.resolve_parked(parked, views, s)]
    if propagate:
        more.append(finders.propagate(views, written(jdg.seed_filter(raw, s), "seeds"), raw, s))
    raw = finders.union(raw, written(finders.union(*more), "more"))
    trimmed = written(mrg.trim_at_identifiers(raw, views, s), "trimmed")
    merged = written(mrg.merge(mrg.trim_addresses(trimmed, views), s), "merged")
    judged = written(jdg.judge(merged, views, s), "judged")
    return Run(views, raw, merged, judged, s, reduce(DataFrame.unionByName, events) if events else None, signals)


def write(result: Run, path: str, legend: str = "none", run_id: str = "run") -> bool:
    """Pages, mapping, spans, review, audit and summary under ``path``. True if nothing leaks; else pages
    of documents that leak are left out, and their summary rows say ``verify_failed``."""
    summary = written(result.summary(), "summary")
    result.safe_pages().write.mode("overwrite").parquet(f"{path}/pages")
    rewrite.mapping(result.entities).write.mode("overwrite").option("header", True).csv(f"{path}/mapping")
    rewrite.nested_mapping(result.entities, result.mentions).write.mode("overwrite").json(f"{path}/mapping_json")
    rewrite.span_rows(result.mentions).write.mode("overwrite").option("header", True).csv(f"{path}/spans")
    rewrite.review_rows(result.judged).write.mode("overwrite").option("header", True).csv(f"{path}/review")
    rewrite.audit_rows(result.judged, result.events, run_id).write.mode("overwrite").json(f"{path}/audit")
    summary.write.mode("overwrite").json(f"{path}/summary")
    if legend != "none":
        rewrite.legend(result.entities, legend).write.mode("overwrite").json(f"{path}/legend")
    return summary.where("verify <> 'ok'").isEmpty()
