"""SimHash near-duplicates: fingerprints, and links by pivot distance tables.

Equal fingerprints become one class first, and the distances of each class to all pivots are computed once
and written. Classes meet in bands: the 64 bits are cut into ``blocks`` parts, and two fingerprints that
differ in at most ``max_bits`` agree on some ``blocks - max_bits`` of them, so no link is missed. Inside a
band bucket a pair whose distances differ by more than ``max_bits`` for any pivot cannot link, by the
triangle inequality, and the others are verified. Large buckets are split by the distance to one pivot,
each part together with what may link to it. A bucket gives a spanning forest, never its pairs, and the
forests are joined by star contraction.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_text, materialize, record, small_batches, texts_of, values_of

SEED = 42
#: Reference fingerprints: hashes of their own number.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(16)], np.uint64)
#: Distinct fingerprints in a bucket that a full matrix compares at once.
MATRIX = 192


def fingerprint(text: bytes, words_per_shingle: int = 4) -> bytes:
    """Eight bytes, the highest bit first. A bit is set if over half of the shingles' hashes set it."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest, view = xxhash.xxh64_digest, memoryview(joined)
    hashes = b"".join([digest(view[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist())])
    count = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 65536):
        part = np.frombuffer(hashes, np.uint8, min(65536, count - at) * 8, at * 8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count).tobytes()


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            bits = b"".join([fingerprint(t, words_per_shingle) for t in texts_of(batch)])
            yield record(out, values_of(batch, "doc_id"), np.frombuffer(bits, ">i8").astype(np.int64))

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def band_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks (signed) of every choice of ``blocks - max_bits`` parts."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivot_table() -> list[Column]:
    """The distances of ``fp`` to all pivots, eight to a long, one byte each; built-in expressions."""
    signed = [int(p) - (1 << 64) if int(p) >> 63 else int(p) for p in PIVOTS]
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in signed]
    return [reduce(add, (F.shiftleft(d, 8 * i) for i, d in enumerate(distance[at : at + 8]))).alias(f"t{at // 8}") for at in range(0, len(PIVOTS), 8)]


def distances(*packed: np.ndarray) -> np.ndarray:
    """The table's rows as small numbers, a column a pivot."""
    return np.column_stack([np.ascontiguousarray(t).view(np.int8).reshape(-1, 8) for t in packed])


def _forest(fps: np.ndarray, table: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Index pairs that span the linked fingerprints of one bucket."""
    n = len(fps)
    if n <= MATRIX:
        near = np.abs(table[:, None, 0] - table[None, :, 0]) <= max_bits
        for p in range(1, table.shape[1]):
            near &= np.abs(table[:, None, p] - table[None, :, p]) <= max_bits
        left, right = np.nonzero(np.triu(near, 1))
        good = np.bitwise_count(fps[left] ^ fps[right]) <= max_bits
        yield from zip(left[good].tolist(), right[good].tolist())
        return
    order = np.argsort(table[:, 1], kind="stable")  # rows of a split bucket have the first distance in common
    fps, table = fps[order], table[order]
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            lo, hi = np.searchsorted(table[rest, 1], (table[x, 1] - max_bits, table[x, 1] + max_bits + 1))
            window = rest[lo:hi]
            for p in range(table.shape[1]):
                window = window[np.abs(table[window, p] - table[x, p]) <= max_bits]
            window = window[np.bitwise_count(fps[window] ^ fps[x]) <= max_bits]
            if len(window):
                yield from ((int(order[x]), int(order[y])) for y in window)
                queue += window.tolist()
                rest = rest[~np.isin(rest, window, assume_unique=True)]


def _spanned(pairs: Iterator[tuple[int, int]], n: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Of the pairs, those that join two trees; and each node's tree."""
    root, joins = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if (ra := top(a)) != (rb := top(b)):
            root[rb] = ra
            joins.append((a, b))
    return joins, list(map(top, range(n)))


class Owners:
    """The rows of one block, against which its guests are held."""

    def __init__(self, fps: np.ndarray, reps: np.ndarray, table: np.ndarray, max_bits: int):
        joins, tree = _spanned(_forest(fps, table, max_bits), len(fps))
        self.max_bits, self.edges = max_bits, [(int(reps[a]), int(reps[b])) for a, b in joins]
        order = np.argsort(table[:, 1], kind="stable")
        self.fps, self.reps, self.table, self.tree = fps[order], reps[order], table[order], np.array(tree)[order]

    def links(self, fp: np.uint64, rep: int, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Edges from a guest to one owner of each tree that it links to."""
        window = np.arange(*np.searchsorted(self.table[:, 1], (row[1] - self.max_bits, row[1] + self.max_bits + 1)))
        for p in (0, 2, 3):
            window = window[np.abs(self.table[window, p] - row[p]) <= self.max_bits]
        window = window[np.bitwise_count(self.fps[window] ^ fp) <= self.max_bits]
        for i in window[np.unique(self.tree[window], return_index=True)[1]].tolist():
            yield int(self.reps[i]), rep


def split_links(hot: DataFrame, histogram: DataFrame, max_bits: int, most_rows: int) -> DataFrame:
    """Links inside buckets of over ``most_rows`` rows. A bucket falls into blocks by distance to the first
    pivot, and values that still hold too many rows into parts. A row owns its place in one block and is a
    guest, by the triangle inequality, of the blocks up to ``max_bits`` distances below, and of the parts
    before its own, so every pair that may link meets once. A task holds one block's owners and takes its
    guests one after the other."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most_rows))).cast("int").alias("parts")
    by_bucket = histogram.select("band", "key", F.struct("v", parts).alias("x")).groupBy("band", "key").agg(F.collect_list("x").alias("blocks"))  # 65 values a bucket at most
    rows = hot.join(by_bucket, ["band", "key"])
    own = F.filter("blocks", lambda x: x.v == F.col("v"))[0].parts
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), own).cast("int"))
    below = F.filter("blocks", lambda x: x.v.between(F.col("v") - max_bits, F.col("v")))
    blocks = F.flatten(F.transform(below, lambda x: F.transform(F.sequence(F.lit(0), x.parts - 1), lambda i: F.struct(x.v.alias("v"), i.alias("part")))))
    met = F.filter(blocks, lambda b: (b.v < F.col("v")) | (b.part <= F.col("part")))
    dealt = rows.select("band", "key", F.explode(met).alias("b"), "fp", "rep", "t0", "t1", F.struct("v", "part").alias("own"))
    dealt = dealt.select("band", "key", "b.v", "b.part", (F.col("b") != F.col("own")).alias("guest"), "fp", "rep", "t0", "t1")
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    block = ["band", "key", "v", "part"]

    def run(batches):
        last, held, owners = None, [], None
        for batch in batches:
            at = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            guest = batch.column(4).to_numpy(zero_copy_only=False)
            fps, reps = batch.column(5).to_numpy().view(np.uint64), batch.column(6).to_numpy()
            table = distances(batch.column(7).to_numpy(), batch.column(8).to_numpy()).astype(np.int16)
            edges = []
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for lo, hi in itertools.pairwise(cuts):
                if hi == lo:
                    continue
                if last is None or (at[lo] != last).any():
                    if owners is None and held:
                        edges += Owners(*map(np.concatenate, zip(*held)), max_bits).edges
                    last, held, owners = at[lo], [], None
                middle = lo + int((~guest[lo:hi]).sum())  # owners come first
                if middle > lo:
                    held.append((fps[lo:middle], reps[lo:middle], table[lo:middle]))
                if middle < hi and held:
                    if owners is None:
                        owners = Owners(*map(np.concatenate, zip(*held)), max_bits)
                        edges += owners.edges
                    for i in range(middle, hi):
                        edges += owners.links(fps[i], int(reps[i]), table[i])
            if edges:
                yield record(out, *zip(*edges))
        if owners is None and held and (edges := Owners(*map(np.concatenate, zip(*held)), max_bits).edges):
            yield record(out, *zip(*edges))

    return dealt.repartition(*block).sortWithinPartitions(*block, "guest").mapInArrow(run, "u long, v long")


def links(classes: DataFrame, max_bits: int = 4, bucket_rows: int = 512, most_rows: int = 20_000) -> DataFrame:
    """(u, v): edges between the representatives of linked fingerprints, enough to connect them all.

    ``classes`` has (fp, rep), each fp once. The number of parts follows the number of classes, so that
    a bucket of evenly spread fingerprints holds about ``bucket_rows`` of them at most; buckets of over
    ``most_rows`` are split by their distances to a pivot.
    """
    classes = materialize(classes.select("fp", "rep", *pivot_table()), "pivots")  # distances once a fingerprint
    n = classes.count()
    blocks = max_bits + 1
    while n / 2 ** (64 * (blocks - max_bits) / blocks) > bucket_rows and blocks < max_bits + 4:
        blocks += 1
    masks = band_masks(blocks, max_bits)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks))))
    banded = classes.select("fp", "rep", "t0", "t1", keys.alias("b")).select("b.band", "b.key", "fp", "rep", "t0", "t1", F.col("t0").bitwiseAND(F.lit(255)).cast("int").alias("v"))
    sizes = banded.groupBy("band", "key", "v").agg(F.count("*").alias("n"))  # a bucket has 65 of them at most
    histogram = sizes.join(sizes.groupBy("band", "key").agg(F.sum("n").alias("all")).where(F.col("all") > most_rows), ["band", "key"])
    histogram = materialize(histogram.select("band", "key", "v", "n"), "hot-buckets")
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(tuple(batch.column(i).to_numpy() for i in range(6)))
                last = (held[-1][0][-1], held[-1][1][-1]) if len(held[-1][0]) else None
                if last is None or (held[0][0][0], held[0][1][0]) == last:
                    continue
            if not held:
                return
            band, key, *columns = (np.concatenate(c) for c in zip(*held))
            cuts = [0, *(np.flatnonzero((np.diff(band) != 0) | (np.diff(key) != 0)) + 1).tolist()]
            if batch is None:
                cuts.append(len(band))
            held = [(band[cuts[-1] :], key[cuts[-1] :], *(c[cuts[-1] :] for c in columns))] if batch is not None else []
            edges = []
            for lo, hi in itertools.pairwise(cuts):
                if hi - lo > 1:
                    fps, reps, *packed = (c[lo:hi] for c in columns)
                    edges += ((reps[a], reps[b]) for a, b in _spanned(_forest(fps.view(np.uint64), distances(*packed).astype(np.int16), max_bits), hi - lo)[0])
            if edges:
                yield record(out, *zip(*edges))

    small_batches(banded.sparkSession)
    if histogram.isEmpty():
        plain, split = banded, None
    else:
        hot = histogram.select("band", "key").distinct()
        plain, split = banded.join(hot, ["band", "key"], "left_anti"), split_links(banded, histogram, max_bits, most_rows)
    found = plain.select("band", "key", "fp", "rep", "t0", "t1").repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(run, "u long, v long")
    return (found if split is None else found.union(split)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root): for every node with an edge, the smallest node that it reaches. Star contraction, one
    written table a round; rounds grow with the logarithm of the longest chain."""

    def directed(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()

    now = materialize(directed(edges), "edges")
    before = state(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = directed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        after_df = materialize(directed(small), "edges")
        after = state(after_df)
        discard(now)
        now = after_df
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach.

    Null texts and texts without a word have fingerprint zero and link like any other. Rows that share
    a doc_id each keep a row. A null doc_id gets the component of its fingerprint (null if no other
    document has it). Other columns are not read.
    """
    fps = materialize(fingerprints(docs, words_per_shingle), "fingerprints")
    classes = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(links(classes, max_bits)).withColumnRenamed("u", "rep")
    named = classes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
