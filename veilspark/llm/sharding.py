"""Sharding by sampled splitters, under the law ``bytes``: all shards get nearly the same size.

A record's key is a hash of its text, one of its id, and its place in the written key table, so copies of
a text stand together and yet any group, of repeated rows too, can be cut. A size-weighted sample of the
keys, of bounded expected size, gives splitters at its quantiles, and they cut the records into ranges.
Ranges of more than a small part of a shard are overfull; they are sampled again, by themselves, and
subdivided. A shard is a stretch of whole consecutive ranges, so it differs from its share by about one
range. Records are numbered inside their range; a range of very many small records is numbered in parts.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Expected sample, ranges for each shard (beyond a shard's bytes over half of that a range is overfull),
#: rows of a range that are numbered at once, and rounds of subdividing.
SAMPLE, RANGES_PER_SHARD, RANGE_ROWS, ROUNDS = 40_000, 200, 250_000, 4
#: Keys drawn for each part that an overfull range falls into.
DRAWN_PER_PART = 8
OVERHEAD = 16
#: Bytes of a key: hash of the text, hash of the id, place in the table.
KEY_BYTES = 24


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digits = (F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(text), F.xxhash64("doc_id"), F.monotonically_increasing_id()))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.concat(*digits)).alias("key"),
    )


def drawn(rows: DataFrame, per_byte: float, nth: int) -> list:
    """Rows drawn with a chance of ``per_byte`` for each byte, by a hash of the key; ``w`` is what each stands for."""
    expected = F.col("size") * F.lit(per_byte)
    draw = F.pmod(F.xxhash64("key", F.lit(nth)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted(rows.where(draw < expected).select("key", F.greatest(expected, F.lit(1.0)).alias("w"), *(c for c in rows.columns if c == "r")).collect())


def quantiles(sample: list, parts: int) -> list[bytes]:
    """The keys that cut a sorted weighted sample into ``parts`` of equal weight."""
    upto, out, i = list(accumulate(x.w for x in sample)), [], 0
    for q in range(1, parts if sample else 0):
        while upto[i] < upto[-1] * q / parts:
            i += 1
        out.append(bytes(sample[i].key))
    return out


def range_of(cuts: list[bytes]) -> Column:
    """How many cuts are at most a row's key: a binary search over the cuts, one after the other in a constant."""
    if not cuts:
        return F.lit(0)
    bounds, key = F.lit(b"".join(cuts)), F.col("key")

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span.lo + span.hi) / 2).cast("int")
        low = F.substring(bounds, middle * KEY_BYTES + 1, F.lit(KEY_BYTES)) <= key
        open_ = span.lo < span.hi
        return F.struct(F.when(open_ & low, middle + 1).otherwise(span.lo).alias("lo"), F.when(open_ & ~low, middle).otherwise(span.hi).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), begin, halve).lo


def splitters(rows: DataFrame, total: int, ranges: int, sample: int) -> list[bytes]:
    """Cuts after which no range of several records has much over 2 / ``ranges`` of all bytes, as far as a
    few rounds of sampling get."""
    limit = 2 * max(total, 1) / ranges
    cuts = sorted(set(quantiles(drawn(rows, sample / max(total, 1), 0), ranges)))
    for nth in range(1, ROUNDS):
        ranged = rows.withColumn("r", range_of(cuts))
        sizes = ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        over = {x.r: x.b for x in sizes.where((F.col("b") > limit) & (F.col("n") > 1)).collect()}  # ranges / 2 rows at most
        if not over:
            break
        again: dict[int, list] = {}
        for x in drawn(ranged.where(F.col("r").isin(list(over))), 2 * DRAWN_PER_PART / limit, nth):
            again.setdefault(x.r, []).append(x)
        more = sorted({*cuts, *(c for r, keys in again.items() for c in quantiles(keys, int(2 * over[r] / limit) + 1))})
        if len(more) == len(cuts):
            break
        cuts = more
    return cuts


def shard(docs: DataFrame, shards: int = 40, sample: int = SAMPLE, ranges_per_shard: int = RANGES_PER_SHARD, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the text's UTF-8 bytes plus 16 (null texts: none). A range goes to the shard in whose share of
    the bytes its middle lies, so shards differ from their share by about a range (1 / 100 of a share) or
    a single record, if that is larger. Slots run gapless from 0. Rows that repeat a doc_id, or all of a
    row, are placed each on their own; a null doc_id is allowed. With fewer records than shards some
    shards stay empty; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = materialize(keyed(docs), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(rows, total, shards * ranges_per_shard, sample)
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(range_rows))).cast("int").alias("parts")
    ranged = materialize(rows.withColumn("r", range_of(cuts)), "shard-ranges")
    sizes = ranged.groupBy("r").agg(F.count("*").alias("n"), F.sum("size").alias("b"))  # a row a range
    before = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    middle = 2 * F.coalesce(F.sum("b").over(before), F.lit(0)) + F.col("b")
    to_shard = sizes.select("r", many, "n", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(total, 1)))).cast("int").alias("shard"))
    to_shard = materialize(to_shard, "shard-of-range")
    # Records of very full ranges are numbered in parts; which part is first does not matter.
    placed = ranged.join(F.broadcast(to_shard.drop("n")), "r").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    cells = placed.where("parts > 1").groupBy("r", "part").agg(F.count("*").alias("n"))
    cells = to_shard.where("parts = 1").select("shard", "r", F.lit(0).cast("long").alias("part"), "n").unionByName(cells.join(F.broadcast(to_shard.select("r", "shard")), "r"))
    ahead = W.partitionBy("shard").orderBy("r", "part").rowsBetween(W.unboundedPreceding, -1)  # a row a cell
    cells = cells.select("r", F.col("part").cast("long").alias("part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("r", "part").orderBy("key")
    numbered = placed.withColumn("part", F.col("part").cast("long")).withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(cells, ["r", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
