"""Entities: mentions of one document grouped by key, partial person names linked, ids by appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions.text import casefold, name_tokens
from ..plans.tables import written


def normal_key(type_: Column, text: Column) -> Column:
    """Persons: case-folded name words; others: the letters a-z and digits of the case-folded text."""
    names = F.array_join(F.transform(name_tokens(text, config.CLUSTER_HONORIFICS), casefold), " ")
    return F.when(type_ == "PERSON", names).otherwise(F.regexp_replace(casefold(text), "[^0-9a-z]+", ""))


def contains_name(longer: Column, shorter: Column) -> Column:
    """The shorter name's words stand in the longer in order; a single letter stands for a first letter.
    Greedy matching from the left finds an embedding if there is one."""

    def step(left: Column, word: Column) -> Column:
        first = F.get(left, 0)
        hit = (first == word) | ((F.length(first) == 1) & word.startswith(first))
        return F.when((F.size(left) > 0) & F.coalesce(hit, F.lit(False)), F.slice(left, 2, F.size(left))).otherwise(left)

    return F.size(F.aggregate(longer, shorter, step)) == 0


def mentions(kept: DataFrame, keep_empty_keys: bool = False) -> DataFrame:
    """Kept spans with their key. Spans whose key is empty are left out, or keyed by their own text."""
    keyed = kept.withColumn("key", normal_key(F.col("type"), F.col("text")))
    if keep_empty_keys:
        return keyed.withColumn("key", F.when(F.col("key") == "", F.concat(F.lit("="), F.col("text"))).otherwise(F.col("key")))
    return keyed.where("key <> ''")


def person_links(keys: DataFrame) -> DataFrame:
    """(doc_id, key, target): for each person key the key it is a part of.

    Targets have two words or more, none a single letter, and are no part of a longer such name: one
    self-join decides that, for containment among such names is transitive. Of several targets one with
    the same last word comes first, then the one that appears earliest.
    """
    people = keys.where("type = 'PERSON'").select("doc_id", "key", "first", F.split("key", " ").alias("words"))
    people = people.withColumn("able", (F.size("words") >= 2) & ~F.exists("words", lambda w: F.length(w) == 1))
    big = people.where("able").select("doc_id", F.col("key").alias("target"), F.col("words").alias("target_words"), F.col("first").alias("target_first"))
    inside = people.join(big, "doc_id").where((F.size("target_words") > F.size("words")) & contains_name(F.col("target_words"), F.col("words")))
    linked = inside.where("able").select("doc_id", F.col("key").alias("target")).distinct()
    open_ = inside.join(linked, ["doc_id", "target"], "left_anti")
    other = F.when(F.element_at("target_words", -1) == F.element_at("words", -1), 0).otherwise(1)
    return open_.groupBy("doc_id", "key").agg(F.min_by("target", F.struct(other.alias("o"), "target_first", "target")).alias("target"))


def cluster(kept: DataFrame, keep_empty_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions). Entities: doc_id, entity_id, type, key, canonical, mention_count, pages;
    ids count up within a document and prefix by first mention. Mentions: spans with entity_id and key."""
    spans = written(mentions(kept, keep_empty_keys), "keyed")
    place = F.struct("page_no", "w0", "seq")
    keys = spans.groupBy("doc_id", "type", "key").agg(F.min(place).alias("first"))
    links = person_links(keys).withColumn("type", F.lit("PERSON"))
    joined = written(spans.join(links, ["doc_id", "type", "key"], "left").withColumn("root", F.coalesce("target", "key")).drop("target"), "linked")
    size = F.when(F.col("type") == "PERSON", F.size(name_tokens(F.col("text"), config.CLUSTER_HONORIFICS))).otherwise(0)
    tidy = F.trim(F.regexp_replace("text", r"[^\S\n]+", " "))
    untitled = F.array_join(F.filter(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "), lambda t: ~F.lower(F.rtrim(t, F.lit("."))).isin(list(config.CLUSTER_HONORIFICS))), " ")
    found = joined.groupBy("doc_id", "type", "root").agg(
        F.min_by(F.when(F.col("type") == "PERSON", untitled).otherwise(tidy), F.struct((-size).alias("n"), "page_no", "w0", "seq")).alias("canonical"),
        F.min(place).alias("first"), F.count("*").alias("mention_count"), F.array_join(F.sort_array(F.collect_set("page_no")), ";").alias("pages"),
    )
    prefix = F.col("type")
    for name, short in config.ID_PREFIX.items():
        prefix = F.when(F.col("type") == name, short).otherwise(prefix)
    order = W.partitionBy("doc_id", "prefix").orderBy("first", "root")
    entities = found.withColumn("prefix", prefix).withColumn("entity_id", F.concat("prefix", F.row_number().over(order).cast("string")))
    entities = entities.select("doc_id", "entity_id", "type", F.col("root").alias("key"), "canonical", "mention_count", "pages", "first")
    named = joined.join(entities.select("doc_id", "type", F.col("key").alias("root"), "entity_id"), ["doc_id", "type", "root"])
    return entities, named.select("doc_id", "page_no", "start", "end", "text", "type", "finders", "confidence", "w0", "w1", "seq", "entity_id", "key")
