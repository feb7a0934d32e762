"""Quality rules by distribution divergence.

Each document becomes two small histograms: its characters by class, and its words by the common words
of its language (with one class for all other words). The reference of a language pools the histograms
of all its documents that pass the base rules. A document is kept if its Jensen-Shannon distance to the
reference is small in both; histograms below a minimum length say too little and are not judged. The
word distance must be below that of a text without any common word, which follows from the reference,
unless common words are so few there that their lack says nothing.

Only built-in expressions: every text is read once, inside one projection, and only counts are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: The commonest words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "a", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "are", "be"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "que", "qui", "dans", "par", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "dem"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
#: Any other language, and none: judged by its own pooled reference over all the words above.
OTHER = "other"
CHAR_CLASSES = ["lower", "space", "upper", "digit", "stop", "symbol", "rest"]

#: Largest distances (0 to 1) and least lengths for which they count.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.50
MIN_CHARS, MIN_WORDS = 120, 40
#: Part of the distance without common words that is too far, and the least such distance that counts.
WORD_PART, MIN_BLANK = 0.9, 0.2


def _vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words})


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang_ref, the base rules' counts, and the two histograms as arrays of long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = _vocabulary()
    one = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(OTHER).alias("lang_ref"),
        text.alias("text"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"),
        F.regexp_replace(text, "[a-z]+", "").alias("t1"),
    )
    two = one.select(
        "doc_id", "lang_ref", "words", "t1",
        F.length("text").alias("n_chars"),
        F.regexp_replace("t1", SPACES, "").alias("t2"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.filter(F.transform("words", F.lower), lambda w: w.isin(kinds)).alias("common"),
    )
    # Hashes of the 8-word windows, by index into the words' hashes: no slices, so linear in the text.
    window = F.when(F.size("h") >= 8, F.transform(F.sequence(F.lit(0), F.size("h") - 8), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(8))))).otherwise(F.array().cast("array<long>"))
    three = two.select("*", window.alias("win"), F.regexp_replace("t2", "[A-Z]+", "").alias("t3"))
    four = three.select("*", (F.size(F.array_distinct("win")) < F.size("win")).alias("repeats"), F.regexp_replace("t3", "[0-9]+", "").alias("t4"))
    sorted_win = F.when(F.col("repeats"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    five = four.select("*", sorted_win.alias("sw"), F.regexp_replace("t4", r"[.,;:!?'\"()-]+", "").alias("t5"))
    twins = F.filter("sw", lambda x, i: F.coalesce(x.h == F.get("sw", i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("sw", i + 1).h, F.lit(False)))
    six = five.select("*", F.sort_array(F.transform(twins, lambda x: x.i)).alias("at"), F.regexp_replace("t5", SYMBOLS, "").alias("t6"))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(8), F.coalesce(F.get("at", i + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    length = {k: F.length(k) for k in ("t1", "t2", "t3", "t4", "t5", "t6")}
    chars = [F.col("n_chars") - length["t1"], length["t1"] - length["t2"], length["t2"] - length["t3"], length["t3"] - length["t4"], length["t4"] - length["t5"], length["t5"] - length["t6"], length["t6"]]

    # The language's words as one array, so that one small expression counts them all.
    listed = F.array(*map(F.lit, kinds))
    for lang, words in COMMON_WORDS.items():
        listed = F.when(F.col("lang_ref") == lang, F.array(*map(F.lit, words))).otherwise(listed)
    named = F.transform(listed, lambda w: F.size("common") - F.size(F.array_remove("common", w)))
    return six.select(
        "doc_id", "lang_ref",
        F.size("words").cast("long").alias("n_words"),
        (F.col("n_chars") - length["t1"] + length["t2"]).cast("long").alias("word_chars"),
        (length["t5"] - length["t6"]).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.array(*chars).cast("array<long>").alias("chars"),
        F.concat(named, F.array(F.size("words"))).cast("array<long>").alias("words"),
    )


def _last_is_rest(hist: Column) -> Column:
    """The word histogram's last entry holds all words; make it those that no other entry counts."""
    named = F.slice(hist, 1, F.size(hist) - 1)
    total = F.aggregate(named, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.concat(named, F.array(F.element_at(hist, -1) - total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two count arrays of one length; null if either is all zero."""
    total_p = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)
    total_q = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(0.0)

    shares = F.zip_with(p, q, lambda x, y: F.struct((x / total_p).alias("x"), (y / total_q).alias("y")))
    divergence = F.aggregate(shares, F.lit(0.0), lambda a, s: a + term(s.x, s.y) + term(s.y, s.x))
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(F.lit(0.0), divergence / 2)))


def references(measured: DataFrame) -> DataFrame:
    """(lang_ref, ref_chars, ref_words): pooled histograms of the documents that pass the base rules.
    One row for each language with a word list and one for all others."""
    good = measured.where("not base_failed")

    def pooled(name: str) -> DataFrame:
        each = good.select("lang_ref", F.posexplode(name)).groupBy("lang_ref", "pos").agg(F.sum("col").alias("n"))
        listed = F.sort_array(F.collect_list(F.struct("pos", "n")))
        return each.groupBy("lang_ref").agg(F.transform(listed, lambda x: x.n).alias(f"ref_{name}"))

    return pooled("chars").join(pooled("words"), "lang_ref")


def quality_rules(
    docs: DataFrame, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    distances char_distance and word_distance (null where the text is shorter than the guard).

    Null and empty texts have no words and fail the base rules. An unknown or null language is judged by
    the pooled reference of all such documents. If no document of a language passes the base rules there
    is no reference and the distances are null. Repeated rows are judged alike, each in its own row.
    Columns other than doc_id, text and lang are not read.
    """
    base = ((F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))).alias("base_failed")
    measured = materialize(counts(docs).withColumn("words", _last_is_rest(F.col("words"))).select("*", base), "rule-counts")
    judged = measured.join(F.broadcast(references(measured)), "lang_ref", "left")  # five rows at most
    judged = judged.withColumn("char_distance", F.when(F.col("n_chars") >= min_chars, js_distance(F.col("chars"), F.col("ref_chars"))))
    judged = judged.withColumn("word_distance", F.when(F.col("n_words") >= min_words, js_distance(F.col("words"), F.col("ref_words"))))
    none = F.concat(F.transform(F.slice("ref_words", 1, F.size("ref_words") - 1), lambda x: F.lit(0).cast("long")), F.array(F.lit(1).cast("long")))
    blank = js_distance(none, F.col("ref_words"))
    max_word_distance = F.when(blank >= MIN_BLANK, F.least(F.lit(max_word_distance), blank * WORD_PART)).otherwise(max_word_distance)
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance")
