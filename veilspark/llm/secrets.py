"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger knows which (blob,
rule version) pairs have been scanned and what was found; a run asks it by hashes, scans each unseen blob
once, by the rules whose version the ledger lacks for it, and joins the findings back to all paths. Texts
are scanned where they lie: no shuffle carries them. What is written has no texts, so it is gathered into
few files, not one for each task that read texts: on local disks Hadoop starts processes for each file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Most blobs that go to all executors at once, 60 bytes or so each.
MAX_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; ``least`` code points are needed in ``group`` of the match.
    ``hint``: a literal without which a text has no match, tried first."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of a class that ends a pattern are taken whole, so "{24,}" drops just those that "+" would find too short.
RULES = [
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", hint="AKIA", base=True),
    Rule("hex", 1, "[0-9a-f]{24,}", base=True),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN"),
]
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of a rule, with code-point offsets from 0. The text between two matches is what
    ``split`` leaves, so lengths add up to offsets without a search."""
    none = F.array().cast(SPANS)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(a: Column, x: Column) -> Column:
        start = a.at + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(F.length(x["2"]) >= rule.least, F.concat(a.out, F.array(span))).otherwise(a.out)
        return F.struct(end.alias("at"), out.alias("out"))

    pairs = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("0"), m.alias("1"))), value, lambda p, v: F.struct(p["0"].alias("0"), p["1"].alias("1"), v.alias("2")))
    walked = F.aggregate(F.filter(pairs, lambda p: p["1"].isNotNull()), first, add).out
    may = text.contains(rule.hint) if rule.hint else text.rlike(rule.pattern)
    return F.when(may, walked).otherwise(none)


def _gathered(rows: DataFrame) -> DataFrame:
    """Small rows in a partition for each core, split where they exceed the size that Spark advises; no key
    decides where a row goes."""
    return rows.hint("rebalance", rows.sparkSession.sparkContext.defaultParallelism)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the ledger rows that this run adds.

    ``versions``: doc_id (the path's version) and text. ``ledger``: (blob, rule, spans) rows of earlier
    runs, or None. Returns (doc_id, blob, spans) with all findings of the rules' present versions, and
    the ledger rows added: one for each (blob, rule version) scanned, empty ones too. Both are written
    tables. Null texts count as empty. Repeated rows and equal texts share a blob, of which one row is
    scanned (all its copies, if they share the doc_id too). An empty table has no paths and adds no
    rows. Columns other than doc_id and text are not read.

    The ledger is asked by hashes alone; texts are read again only if some blob is due, and scanned
    where they lie: of the due blobs and of those that are not plain new ones the smaller set, if it has
    ``max_broadcast_rows`` rows at most, goes to the texts. If neither has, texts meet their blobs in a
    shuffle.
    """
    rules = rules or RULES
    keys = [r.key for r in rules]
    text = F.coalesce(F.col("text"), F.lit(""))
    blob = F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob")
    paths = materialize(_gathered(versions.select("doc_id", blob)), "paths")
    all_due = F.array(*map(F.lit, keys))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    if ledger is None:
        blobs = blobs.withColumn("due", all_due)
    else:
        done = [F.bool_or(F.col("rule") == k).alias(f"done{i}") for i, k in enumerate(keys)]
        known = ledger.where(F.col("rule").isin(keys)).select(F.unhex("blob").alias("blob"), "rule").groupBy("blob").agg(*done)
        lacking = F.array(*(F.when(~F.coalesce(f"done{i}", F.lit(False)), k) for i, k in enumerate(keys)))
        blobs = blobs.join(known, "blob", "left").select("blob", "owner", "n", F.array_compact(lacking).alias("due"))
    blobs = materialize(_gathered(blobs), "blobs")
    due, plain = F.size("due") > 0, (F.col("n") == 1) & (F.size("due") == len(keys))
    n_due, n_special = blobs.agg(F.count_if(due), F.count_if(~plain)).first()

    texts = versions.select("doc_id", text.alias("text"), blob)
    if n_due == 0:
        texts = texts.where("false").withColumn("due", all_due)
    elif min(n_due, n_special) > max_broadcast_rows:
        chosen = blobs.where(due).select("blob", "owner", "due")
        texts = texts.join(chosen, "blob").where(F.col("doc_id").eqNullSafe(F.col("owner")))
    elif n_due <= n_special:
        chosen = F.broadcast(blobs.where(due).select("blob", "owner", "due"))  # n_due rows, checked
        texts = texts.join(chosen, "blob").where(F.col("doc_id").eqNullSafe(F.col("owner")))
    else:
        special = F.broadcast(blobs.where(~plain).select("blob", "owner", "due", F.lit(True).alias("special")))  # n_special rows, checked
        mine = F.col("special").isNull() | ((F.size("due") > 0) & F.col("doc_id").eqNullSafe(F.col("owner")))
        texts = texts.join(special, "blob", "left").where(mine).withColumn("due", F.coalesce("due", all_due))

    # Gathered before anything filters on it, so that each pattern runs once over a text, and no text is sorted.
    scanned = _gathered(texts.select("blob", *(F.when(F.array_contains("due", r.key), spans(F.col("text"), r, i)).alias(f"r{i}") for i, r in enumerate(rules))))
    scanned = materialize(_gathered(scanned.dropDuplicates(["blob"])), "scanned")
    each = F.array(*(F.struct(F.lit(r.key).alias("rule"), F.col(f"r{i}").alias("spans")) for i, r in enumerate(rules)))
    added = scanned.select("blob", F.explode(F.filter(each, lambda x: x.spans.isNotNull())).alias("x"))
    added = added.select(F.lower(F.hex("blob")).alias("blob"), "x.rule", "x.spans")

    none = F.array().cast(SPANS)
    found = scanned.select("blob", F.concat(*(F.coalesce(f"r{i}", none) for i in range(len(rules)))).alias("spans")).where(F.size("spans") > 0)
    if ledger is not None:
        old = ledger.where(F.col("rule").isin(keys) & (F.size("spans") > 0)).select(F.unhex("blob").alias("blob"), "spans")
        found = found.unionByName(old).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a row for each rule and blob
    found = found.select("blob", F.sort_array("spans").alias("spans"))
    joined = paths.join(found, "blob", "left").select("doc_id", F.lower(F.hex("blob")).alias("blob"), F.coalesce("spans", none).alias("spans"))
    return joined, added


def listed(spans_col: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
