"""Line de-duplication across documents with two Bloom filters.

One pass over the texts fills two filters: *once* holds the hashes of all line keys, *twice* those that
arrived when *once* already held them. A second pass sends only lines that *twice* holds, as 16-byte
digests with their document, through a shuffle that confirms repeats exactly and picks the smallest
document of each; the most frequent lines go back to their suspects by broadcast, so none of them gathers
its documents in one task. A third pass rewrites the texts.

The filters grow with the input up to ``max_filter_mb``; beyond that more lines are suspected and
shuffled, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize, record, texts_of, values_of

SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BITS = 1 << 20
#: Bits a document adds to a filter's size, and bits set for each hash.
BITS_PER_DOC, PROBES = 512, 3
#: Lines so frequent that fewer than so many can be; they meet their suspects without a shuffle.
MOST_HOT = 2000
#: Hashes that a task holds before it hands on what it has.
FLUSH = 1 << 20

FILTER = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("dense", pa.bool_()), ("once", pa.binary()), ("twice", pa.binary())])
FILTER_DDL = "block int, salt int, dense boolean, once binary, twice binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without outer white space, A-Z lower-cased; None if it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(x, min_chars) for x in text.split(b"\n")}
    keys.discard(None)
    return {xxhash.xxh3_128_digest(k) for k in keys}


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each digest, and its bits there (n x PROBES)."""
    block = (hashes[:, 1] % np.uint64(blocks)).astype(np.int32)
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(20)
    bits = (hashes[:, :1] >> shifts) & np.uint64(BLOCK_BITS - 1)
    return block, bits.astype(np.uint32)


def _pack(bits: np.ndarray) -> tuple[bool, bytes]:
    if bits.nbytes < BLOCK_BITS // 8:
        return False, bits.tobytes()
    full = np.zeros(BLOCK_BITS, np.uint8)
    full[bits] = 1
    return True, np.packbits(full).tobytes()


def _unpack(dense: bool, data: bytes) -> np.ndarray:
    if dense:
        return np.frombuffer(data, np.uint8)
    full = np.zeros(BLOCK_BITS, np.uint8)
    full[np.frombuffer(data, np.uint32)] = 1
    return np.packbits(full)


def _filter_rows(hashes: np.ndarray, blocks: int, salt: int) -> Iterator[pa.RecordBatch]:
    once, counts = np.unique(hashes, axis=0, return_counts=True) if len(hashes) else (hashes, np.empty(0, int))
    block, bits = _places(once, blocks)
    order = np.argsort(block, kind="stable")
    block, bits, again = block[order], bits[order], counts[order] > 1
    cuts = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(block)]):
        if hi > lo:
            dense, first = _pack(bits[lo:hi].ravel())
            second = bits[lo:hi][again[lo:hi]].ravel()
            if dense:
                full = np.zeros(BLOCK_BITS, np.uint8)
                full[second] = 1
                packed = np.packbits(full).tobytes()
            else:
                packed = second.tobytes()
            yield record(FILTER, [int(block[lo])], [salt], [dense], [first], [packed])


def _merge(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
    """OR the rows of a block, which come one after the other; what two rows' *once* share goes to *twice*."""
    at: tuple[int, int] | None = None
    once = twice = None
    for batch in batches:
        for block, salt, dense, first, second in zip(*(c.to_pylist() for c in batch.columns)):
            key = (block, salt if salted else 0)
            if key != at:
                if at is not None:
                    yield record(FILTER, [at[0]], [at[1]], [True], [once.tobytes()], [twice.tobytes()])
                at, once, twice = key, np.zeros(BLOCK_BITS // 8, np.uint8), np.zeros(BLOCK_BITS // 8, np.uint8)
            new = _unpack(dense, first)
            twice |= _unpack(dense, second) | (once & new)
            once |= new
    if at is not None:
        yield record(FILTER, [at[0]], [at[1]], [True], [once.tobytes()], [twice.tobytes()])


def twice_filter(docs: DataFrame, min_chars: int = 10, max_filter_mb: int = 64) -> tuple[np.ndarray, int]:
    """The *twice* filter's blocks, at most ``max_filter_mb``, and their number."""
    wanted = docs.count() * BITS_PER_DOC // BLOCK_BITS + 1
    blocks = min(1 << (wanted - 1).bit_length() if wanted > 1 else 1, max_filter_mb * (8 << 20) // BLOCK_BITS)

    def fill(batches):
        salt, held, size = TaskContext.get().partitionId() % 32, [], 0
        for batch in batches:
            for text in texts_of(batch):
                if found := _digests(text, min_chars):
                    held.append(b"".join(found))
                    size += len(found)
            if size >= FLUSH:
                yield from _filter_rows(np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2), blocks, salt)
                held, size = [], 0
        yield from _filter_rows(np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2), blocks, salt)

    rows = map_text(docs.select("text"), fill, FILTER_DDL)
    rows = map_text(rows.repartition("block", "salt").sortWithinPartitions("block", "salt"), lambda b: _merge(b, True), FILTER_DDL)
    rows = map_text(rows.repartition("block").sortWithinPartitions("block"), lambda b: _merge(b, False), FILTER_DDL)
    twice = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for row in rows.select("block", "twice").toLocalIterator():
        twice[row.block] = np.frombuffer(bytes(row.twice), np.uint8)
    return twice, blocks


def repeated_lines(docs: DataFrame, min_chars: int = 10, max_filter_mb: int = 64) -> DataFrame:
    """(doc_id, keys): for each document the digests of the line keys that it must lose."""
    spark = docs.sparkSession
    twice, blocks = twice_filter(docs, min_chars, max_filter_mb)
    held = spark.sparkContext.broadcast(twice.tobytes())
    out = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def suspects(batches):
        bitmap = np.frombuffer(held.value, np.uint8).reshape(blocks, -1)
        for batch in batches:
            keys, ids = [], []
            for text, doc_id in zip(texts_of(batch), values_of(batch, "doc_id")):
                if doc_id is not None:
                    found = list(_digests(text, min_chars))
                    keys += found
                    ids += [doc_id] * len(found)
            if keys:
                block, bits = _places(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2), blocks)
                seen = (bitmap[block[:, None], bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1
                hit = np.flatnonzero(seen.all(axis=1)).tolist()
                yield record(out, [keys[i] for i in hit], [ids[i] for i in hit])

    found = materialize(map_text(docs.select(F.col("doc_id").cast("long"), "text"), suspects, "key binary, doc_id long"), "line-suspects")
    repeated = found.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("first_doc < last_doc").drop("last_doc")
    repeated = materialize(repeated, "line-repeats")
    often = F.col("n") > found.count() / MOST_HOT
    hot = F.broadcast(repeated.where(often).drop("n"))  # fewer than MOST_HOT rows, as each has over 1 / MOST_HOT of them all
    drops = found.join(hot, "key").unionByName(found.join(hot, "key", "left_anti").join(repeated.where(~often).drop("n"), "key"))
    return drops.where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def rewrite(docs: DataFrame, columns: list[str], min_chars: int = 10) -> DataFrame:
    """``columns`` of the documents without the lines in ``keys``, and n_lines and n_dropped. ``text`` is
    rewritten, ``n_chars``, if asked for, recomputed; the rest passes through."""
    fields = [f for f in docs.schema if f.name in columns and f.name != "text"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text binary, n_lines long, n_dropped long"])

    def run(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, keys in zip(texts_of(batch), values_of(batch, "keys")):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if keys:
                    gone = set(keys)
                    stay = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                else:
                    n_dropped.append(0)
                    kept.append(text)
            passed = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            names = [*(f.name for f in fields), "text", "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)

    out = map_text(docs.select(*(f.name for f in fields), "text", "keys"), run, ddl).withColumn("text", F.col("text").cast("string"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out


def dedup_lines(docs: DataFrame, min_chars: int = 10, max_filter_mb: int = 64) -> DataFrame:
    """Drop every line whose key stands in an earlier document: (doc_id, text, n_lines, n_dropped).

    A line's key is the line without outer white space, A-Z lower-cased. Keys of ``min_chars`` code
    points or more that at least two documents hold lose all their lines except in the smallest
    doc_id. Null and empty texts are one empty line; a null doc_id keeps its lines and takes none from
    others; rows that share a doc_id are one document for the count, each rewritten on its own.
    Other columns are not read.
    """
    drops = repeated_lines(docs, min_chars, max_filter_mb)
    return rewrite(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(drops, "doc_id", "left"), ["doc_id", "text"], min_chars)
