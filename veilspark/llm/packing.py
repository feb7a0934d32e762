"""Best-fit packing by a plan over the length histogram.

Tokenised pieces are written with their length and their rank among equal lengths in their task. The
driver sees only the histogram (one count for each length up to the capacity), packs counts instead of
pieces, best fit in decreasing order, and gets a list of runs: "ranks r to r+n of length L go to
sequences s to s+n at offset o". The pieces then look up their run by rank within length. The number of
runs depends on the capacity, not on the number of pieces.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_text, materialize, record, texts_of, values_of

#: Words and runs whose ids a worker remembers, and the longest word it keeps, in bytes.
CACHE_WORDS, CACHE_BYTES = 900_000, 64
#: Up to here, letter classes and composition are the same in all Unicode versions in use.
LATIN_END = "\u0250"
#: ASCII signs that, after letters, are one run; the apostrophe may begin a contraction.
TEXT_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARKS = TEXT_MARKS.encode()

PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("task_rank", pa.int64())])


class WordTokenizer:
    """Ids of whole texts, word by word.

    The tokenizer's rules never look across white space, so a text's ids are those of its words, one
    after the other, and known words are looked up instead of tokenised again. A new word is cut into
    runs by the tokenizer's own pattern - mostly letters and what follows them - and only runs that are
    new as well are tokenised, many in one call: each run's last id is one that ends words. Words with
    letters beyond Latin, or with what could be a special token, go through the tokenizer as they are.
    A worker's memory is bounded by the size of the cache. Ids are little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        suffix, split = model["model"]["end_of_word_suffix"], model["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # The same model behind a plain split: runs arrive normalised and cut.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.ids: dict[bytes, bytes] = {}

    def _direct(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_runs(self, runs: list[bytes]) -> None:
        for at in range(0, len(runs), 4000):
            part = runs[at : at + 4000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                self.ids.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                self.ids.update(zip(part, self._direct([r.decode("utf-8") for r in part])))

    def _runs(self, word: bytes) -> tuple[bytes, ...] | None:
        """The runs of a word whose A-Z are lower-cased; None if it must be tokenised as it is."""
        head = word.rstrip(MARKS)
        if head.isalpha():
            return head, word[len(head) :]
        if b"<|" in word:
            return None
        text = word.decode("utf-8")
        if not text.isascii():
            if max(text) >= LATIN_END:
                return None
            text = unicodedata.normalize("NFC", text).lower()
            letters = text.rstrip(TEXT_MARKS)
            if letters.isalpha():
                return (letters.encode(), text[len(letters) :].encode()) if len(letters) < len(text) else (letters.encode(),)
        return tuple([r.encode() for r in self.pattern.findall(text)])

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the cache lacks. Letter words and runs stay in the cache."""
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        cut = [self._runs(w) for w in others]
        known = self.ids
        self._learn_runs(list({r for runs in cut if runs for r in runs}.union(letters).difference(known)))
        odd = [w for w, runs in zip(others, cut) if runs is None]
        found = dict(zip(odd, self._direct([w.decode("utf-8") for w in odd]))) if odd else {}
        for w, runs in zip(others, cut):
            if runs is not None:
                found[w] = known[runs[0]] + known[runs[1]] if len(runs) == 2 else b"".join([known[r] for r in runs])
        return found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if len(self.ids) > CACHE_WORDS:
            self.ids = {}
        # Case is folded first, unless that could make a special token of an ordinary word.
        split = [t.lower().split() if b"<|" not in t else [w if b"<|" in w else w.lower() for w in t.split()] for t in texts]
        fresh = self.learn(set().union(*split).difference(self.ids))
        if all(len(w) <= CACHE_BYTES for w in fresh):
            self.ids.update(fresh)
            look = self.ids
        else:
            look = self.ids | fresh
        for words in split:
            yield b"".join([look[w] for w in words])


_tokenizers: dict[str, WordTokenizer] = {}  # of this worker process, for all its tasks


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document, with its rank among its task's pieces of that length.

    The ids are those of the whole text and then ``end_id``; only longer documents are cut, every
    ``capacity`` ids. Null texts are empty: one piece with ``end_id`` alone.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, ranks, task = tokenizer_at(tokenizer_path), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(values_of(batch, "doc_id"), words.encode(texts_of(batch))):
                ids += tail
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((doc_id, n, at // 4, length, zlib.crc32(part), task, ranks[length]))
                    ranks[length] += 1
            if rows:
                yield record(PIECE, *zip(*rows))

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECE_DDL)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over counts: runs (length, first rank, n, first sequence, offset), and
    the number of sequences. Sequences with the same free space are held as ranges of their numbers."""
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []  # free spaces that some range has, ascending
    runs, sequences = [], 0

    def hold(space: int, first: int, n: int) -> None:
        if space and n:
            if not free[space]:
                bisect.insort(sizes, space)
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                space = sizes[at]
                first, n = free[space].pop()
                if not free[space]:
                    del sizes[at]
                m = min(n, left)
                hold(space, first + m, n - m)
            else:  # open as many as these pieces fill to the brim, and one more if some are left
                space, m = capacity, max(1, left // (capacity // length))
                first, sequences = sequences, sequences + m
            runs.append((length, rank, m, first, capacity - space))
            hold(space - length, first, m)
            rank, left = rank + m, left - m
    return runs, sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    Sequences hold ``capacity`` ids at most and are gapless from offset 0. Rows that share a doc_id are
    packed each on its own. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(by_task.select("length", "task", "n", before.alias("before")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(histogram, capacity)
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    # The table has a row for each length and task, so it grows with the input and is not broadcast.
    ranked = cut.join(counts.drop("n").hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank"))
    out = pa.schema([*list(PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        length, first, _, sequence, offset = table.value.T
        key = length * (1 << 44) + first
        order = np.argsort(key)
        key = key[order]
        for batch in batches:
            rank = batch.column(5).to_numpy()
            run = order[np.searchsorted(key, batch.column(3).to_numpy() * (1 << 44) + rank, "right") - 1]
            yield record(out, *batch.columns[:5], sequence[run] + rank - first[run], offset[run])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
