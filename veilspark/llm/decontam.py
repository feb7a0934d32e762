"""Benchmark decontamination with a distributed positional inverted index.

The texts are cut into blocks of about half a million words. Each block's row in the index, a written
table, holds the list of its positions for every term in it (terms by 64-bit hashes). A query, a window
of a benchmark item, starts from the rarest of its terms in the block, moves that list by the term's
place in the window, and intersects it with the other terms' lists, the rarer first. A large benchmark
goes over the same index in parts of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize, record, texts_of, values_of

#: A-Z become a-z, other ASCII characters but digits and letters separate; bytes from 0x80 belong to words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words in one block of the index, and distinct terms in a worker's memory.
BLOCK_WORDS, HELD_TERMS = 500_000, 500_000

INDEX = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary())])
INDEX_DDL = "block long, ids array<long>, starts binary, terms binary, counts binary, postings binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Queries:
    """The distinct windows of some benchmark items, as places in ``hashes`` (the terms', ascending)."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        owners: dict[tuple[bytes, ...], list] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owned = owners[tuple(words[i : i + window])]
                if not owned or owned[-1] != item_id:
                    owned.append(item_id)
        self.hashes = np.unique(term_hashes({t for w in owners for t in w}))
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.terms = np.full((len(owners), window), -1, np.int64)
        for i, w in enumerate(owners):
            self.terms[i, : len(w)] = np.searchsorted(self.hashes, term_hashes(w))
        self.owners = list(owners.values())


def term_hashes(terms: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def query_parts(benchmark: DataFrame, window: int, max_words: int) -> Iterator[Queries]:
    """The benchmark in parts of about ``max_words`` words, read row by row."""
    part, size = [], 0
    for row in benchmark.where("item_id is not null").select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        if row.text:
            part.append((row.item_id, bytes(row.text)))
            size += len(row.text) // 4
            if size >= max_words:
                yield Queries(part, window)
                part, size = [], 0
    yield Queries(part, window)


def build_index(docs: DataFrame) -> DataFrame:
    """One row a block: its number, its documents, where each begins (positions, one free place between two),
    the hashes of its terms, ascending, how many postings each has, and the postings, term by term."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        local: dict[bytes, int] = {}
        hashes = np.empty(0, np.uint64)

        def block(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
            words = np.concatenate(parts)
            places = np.arange(len(words)) + np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            used, term = np.unique(words, return_inverse=True)
            order = np.argsort(hashes[used])  # of the block's terms
            rank = np.empty(len(used), np.int64)
            rank[order] = np.arange(len(used))
            keys = np.sort((rank[term] << 32) | places)
            counts = np.bincount(keys >> 32, minlength=len(used)).astype(np.int32)
            postings = (keys & 0xFFFFFFFF).astype(np.int32)
            return record(INDEX, [number], [ids], [starts.astype(np.int32).tobytes()], [hashes[used][order].tobytes()], [counts.tobytes()], [postings.tobytes()])

        ids, parts, size = [], [], 0
        for batch in batches:
            split = [words_of(t) for t in texts_of(batch)]
            new = list(set().union(*split).difference(local))
            local.update(zip(new, range(len(local), len(local) + len(new))))
            hashes = np.append(hashes, term_hashes(new))
            for doc_id, words in zip(values_of(batch, "doc_id"), split):
                parts.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
                ids.append(doc_id)
                size += len(words) + 1
                if size >= BLOCK_WORDS:
                    yield block(ids, parts)
                    number, ids, parts, size = number + 1, [], [], 0
            if len(local) > HELD_TERMS:  # numbers are of one memory, so the block ends with it
                if ids:
                    yield block(ids, parts)
                number, ids, parts, size = number + 1, [], [], 0
                local, hashes = {}, np.empty(0, np.uint64)
        if ids:
            yield block(ids, parts)

    return materialize(map_text(docs.select(F.col("doc_id").cast("long"), "text"), run, INDEX_DDL), "postings")


class Postings:
    """The posting lists of one block, for the terms of some queries; ``keys`` are (term, position), ascending."""

    def __init__(self, queries: Queries, terms: bytes, counts: bytes, postings: bytes):
        own, n = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64)
        at = np.minimum(np.searchsorted(own, queries.hashes), max(len(own) - 1, 0))
        there = own[at] == queries.hashes if len(own) else np.zeros(len(queries.hashes), bool)
        self.size = np.where(there, n[at] if len(own) else 0, 0)
        first = (np.cumsum(n) - n)[at] if len(own) else self.size
        places = np.frombuffer(postings, np.int32).astype(np.int64)
        term = np.repeat(np.arange(len(self.size)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.keys = (term << 32) | places[np.arange(len(term)) - self.first[term] + first[term]]

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each of some terms, and which of them each belongs to."""
        size = self.size[term]
        which = np.repeat(np.arange(len(term)), size)
        at = np.arange(len(which)) - (np.cumsum(size) - size)[which] + self.first[term][which]
        return self.keys[at] & 0xFFFFFFFF, which

    def next(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first position of each term at or after the given one; a far one if there is none."""
        at = np.searchsorted(self.keys, (term << 32) | position)
        found = np.append(self.keys, np.int64(-1))[at]
        return np.where(found >> 32 == term, found & 0xFFFFFFFF, np.int64(1 << 40))


def matching(queries: Queries, lists: Postings, starts: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, document) where every term of a window has a posting within ``slop`` places of its own
    in the document (0: exact phrases): the rarest term's list, moved by the term's place, cut down by the
    others' lists, the rarer first. Each of the rarest term's postings gives the first such place at most."""
    size = np.append(lists.size, np.iinfo(np.int64).max)  # what pads a short window is never the rarest
    counts = size[queries.terms]
    alive = np.flatnonzero(counts.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
    if not len(alive):
        return (np.empty(0, np.int64),) * 3
    order = np.argsort(counts[alive], axis=1, kind="stable")
    position, window = lists.of(queries.terms[alive, order[:, 0]])
    doc = np.searchsorted(starts, position, "right") - 1
    start = position - order[window, 0]
    loose = np.arange(-slop, slop + 1)
    anchor = np.repeat(np.arange(len(start)), len(loose))
    start, window, doc = (start[:, None] + loose).ravel(), window[anchor], doc[anchor]
    for k in range(1, queries.terms.shape[1]):
        offset = order[window, k]
        term = queries.terms[alive[window], offset]
        low = np.maximum(start + offset - slop, starts[doc])
        high = np.minimum(start + offset + slop, starts[doc + 1] - 2)
        ok = (term < 0) | ((low <= high) & (lists.next(np.maximum(term, 0), low) <= high))
        window, start, doc, anchor = window[ok], start[ok], doc[ok], anchor[ok]
    _, first = np.unique(anchor, return_index=True)
    return alive[window[first]], (start - starts[doc])[first], doc[first]


def search(index: DataFrame, queries: Queries, slop: int = 0, only_hits: bool = False) -> DataFrame:
    """(block, place, doc_id, n_words, hits, items): for every document the covered places as [from, to)
    pairs, and the items with an occurring window. ``block`` and ``place`` tell rows apart."""
    held = index.sparkSession.sparkContext.broadcast(queries)
    ddl = "block long, place int, doc_id long, n_words long, hits array<struct<s: int, e: int>>, items array<string>"
    span = pa.struct([("s", pa.int32()), ("e", pa.int32())])
    out = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def run(batches):
        q: Queries = held.value
        for batch in batches:
            for number, ids, starts, terms, counts, postings in zip(*(c.to_pylist() for c in batch.columns)):
                starts = np.frombuffer(starts, np.int32).astype(np.int64)
                n_words = np.diff(starts) - 1
                hits, items = defaultdict(set), defaultdict(set)
                for w, s, d in zip(*(x.tolist() for x in matching(q, Postings(q, terms, counts, postings), starts, slop))):
                    hits[d].add((max(s, 0), min(s + int(q.lengths[w]), int(n_words[d]))))
                    items[d].update(map(str, q.owners[w]))
                rows = sorted(hits) if only_hits else range(len(ids))
                if len(rows):
                    spans = [[{"s": a, "e": b} for a, b in sorted(hits[d])] if d in hits else [] for d in rows]
                    yield record(out, [number] * len(rows), list(rows), [ids[d] for d in rows], n_words[list(rows)], spans, [sorted(items[d]) if d in items else [] for d in rows])

    return map_text(index, run, ddl)


def searched(docs: DataFrame, benchmark: DataFrame, window: int, slop: int, max_words: int) -> DataFrame:
    """``search`` for the whole benchmark, a row for each document: one index, and one pass over it for
    each part of the benchmark. What parts find is brought together by the row's place in the index."""
    index = build_index(docs)
    found = [search(index, q, slop, only_hits=n > 0) for n, q in enumerate(query_parts(benchmark, window, max_words))]
    if len(found) == 1:
        return found[0]
    key = ["block", "place"]
    more = reduce(DataFrame.union, found).groupBy(*key).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return more


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every document.

    A word is hit if an occurrence of any window covers it; items are sorted as strings. A document is
    contaminated if ``share * n_hit >= n_words`` and a word is hit. Null and empty texts have no words
    and are clean; null or empty items have no windows, and items without an id are no items; an empty
    benchmark hits nothing, an empty table gives no rows. Equal windows of several items count for each.
    Repeated rows, and rows without a doc_id, are searched each on their own, also where a benchmark of
    more than ``max_words`` words goes over the index in parts. Other columns are not read.
    """
    found = searched(docs, benchmark, window, 0, max_words)
    # Covered words: walk the spans by start, counting what lies beyond the furthest end so far.
    first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    walked = F.aggregate(
        F.array_sort("hits"), first,
        lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a.n + F.greatest(x.e - F.greatest(a.end, x.s), F.lit(0))).cast("long").alias("n")),
    )
    return found.select("doc_id", "n_words", walked.n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int | None = None, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, start, end, items): where phrases, or with ``slop`` loose ones, stand in each document.
    ``items`` are all items that match anywhere in the document."""
    found = searched(docs, benchmark, window, slop or 0, max_words)
    return found.select("doc_id", F.explode("hits").alias("h"), "items").select("doc_id", F.col("h.s").alias("start"), F.col("h.e").alias("end"), "items")
