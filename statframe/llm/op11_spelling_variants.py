"""Spelling variant grouping by one-edit neighbourhoods over a reduced alphabet.

Words: maximal letter runs of every whole text, A-Z lower-cased, with a typing-error draw (one
run in ``ERROR_ONE_IN`` loses a code point) and a least length and count. Two words are
near if one code point is inserted, deleted or replaced between them.

1. Every code point is hashed to one of ``SYMBOLS`` symbols; a word becomes its reduced word.
   One edit between words is one edit, or none, between their reduced words.
2. A word generates the full one-edit neighbourhood of its reduced word: itself, all
   deletions, replacements and insertions of a symbol. Each is named by a 64-bit polynomial
   hash of its symbols, put together from prefix and suffix hashes, so a neighbour of a word of
   any length costs 8 bytes and constant work.
3. The neighbours meet the reduced vocabulary in one join on that hash. Equal reduced words
   have equal hashes, so no near pair is lost; words that meet by a hash collision or by
   equal symbols are told apart in the next step.
4. Each meeting is verified on the original words (edit distance exactly one).

The join is the only step over pairs, and its rows are tested as they meet: a word's near
words alone pass (at most its length times the letters of the alphabet, twice, as they
differ in one code point), and a word's own rows are reduced by partial aggregation. Counting words
is a partial aggregate too, so a word that fills a third of all texts costs a row per task.
``root`` follows the forms by pointer doubling; counts grow by ``RATIO`` or more with every
form, so the rounds follow from the largest count.

Defined results: null and empty texts and texts without a long run give no word; an empty table
gives no row; null ids draw as an empty string; repeated rows count again each; ties between
forms go to the word that is smaller in code-point order; a run of any length is a word
like the others. Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.session import shared_folder

from .common import table

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
ERROR_ONE_IN = 199
SYMBOLS = 8
#: Neighbour hashes of one Arrow batch, and the longest word that travels with each of its neighbours.
BATCH_KEYS, INLINE = 1 << 17, 48
#: Words that one task spreads into their neighbourhoods (about 150 rows each).
TASK_WORDS = 10_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -------------------------------------------------------------- vocabulary
def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, error_one_in: int | None = ERROR_ONE_IN) -> DataFrame:
    """(word, n) of all words of ``docs`` with ``min_length`` code points and ``min_count``
    occurrences. ``error_one_in`` None draws no errors."""
    # a run can only lose a code point, so shorter ones are never words
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS + "{%d,}" % min_length), F.lit(0))
    words = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
             .withColumn("run", F.translate("run", UPPER, LOWER)))
    if error_one_in:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.expr("substring(run, 1, int(h % length(run)))"), F.col("run").substr(at + 2, F.length("run")))
        words = words.select(F.when(F.col("h") % error_one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    else:
        words = words.select(F.col("run").alias("word"))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") >= min_count) & (F.length("word") >= min_length)))


# ----------------------------------------------------------- reduced words
def symbols_of(code_points: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Symbol 1..``symbols`` of each code point, by a multiplicative hash."""
    x = code_points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def reduced_key(symbols: np.ndarray) -> np.uint64:
    """Hash of a reduced word: sum of symbol times base to its place, modulo 2 ** 64."""
    return np.sum(symbols * _powers(len(symbols)), dtype=np.uint64)


def neighbour_keys(symbols: np.ndarray, alphabet: int = SYMBOLS) -> np.ndarray:
    """Distinct hashes of the full one-edit neighbourhood of a reduced word, itself included."""
    n = len(symbols)
    power = _powers(n + 1)
    term = symbols * power[:n]
    before = np.r_[np.uint64(0), np.cumsum(term, dtype=np.uint64)]  # hash of the first i symbols
    total = before[n]
    # what follows place i, one place further up and one place further down
    up = (total - before) * _BASE
    shifted = np.r_[symbols[1:] * power[:n - 1], np.zeros(1, np.uint64)] if n else symbols
    down = np.r_[np.cumsum(shifted[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)] if n else np.zeros(1, np.uint64)
    letters = np.arange(1, alphabet + 1, dtype=np.uint64)
    deleted = before[:n] + down[:n]
    replaced = (total - term)[:, None] + letters[None, :] * power[:n, None]
    inserted = (before + up)[:, None] + letters[None, :] * power[:, None]
    return np.unique(np.concatenate([before[n:], deleted, replaced.ravel(), inserted.ravel()]))


def _code_points(word: bytes) -> np.ndarray:
    return np.frombuffer(word.decode("utf-8").encode("utf-32-le"), np.uint32)


def _neighbours(batches, symbols: int):
    """(key, *columns of the word) for every neighbour of every word, in batches of bounded size."""
    for batch in batches:
        names = ["key", *batch.schema.names[1:]]
        keys, rows, held = [], [], 0

        def close():
            at = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))] + [c.take(at) for c in batch.columns[1:]], names=names)

        for i, w in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
            got = neighbour_keys(symbols_of(_code_points(w), symbols), symbols)
            for lo in range(0, len(got), BATCH_KEYS):
                part = got[lo:lo + BATCH_KEYS]
                keys.append(part)
                rows.append(np.full(len(part), i, np.int64))
                held += len(part)
                if held >= BATCH_KEYS:
                    yield close()
                    keys, rows, held = [], [], 0
        if keys:
            yield close()


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS, inline: int = INLINE) -> DataFrame:
    """(word, n, near, near_n) of every ordered pair of words at edit distance one.
    ``vocabulary`` is a written table (id, word, n)."""
    @F.arrow_udf("long")
    def key_of(words: pa.Array) -> pa.Array:
        keys = [reduced_key(symbols_of(_code_points(w), symbols)) for w in words.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(keys, np.uint64).view(np.int64))

    tasks = max(1, -(-vocabulary.count() // TASK_WORDS))

    def probes(words: DataFrame, kind: str, *carried) -> DataFrame:
        return words.repartition(tasks, "word").select("word", *carried).mapInArrow(lambda it: _neighbours(it, symbols), "key long, " + kind)

    long = F.length("word") > inline
    reduced = vocabulary.select(key_of("word").alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    one = F.levenshtein("word", "near", 1) == 1
    short = probes(vocabulary.where(~long), "word string, n long", F.col("word").alias("w"), "n").join(reduced, "key").where(one)
    # a long word's neighbours travel without it and meet it again where a reduced word is equal
    met = probes(vocabulary.where(long), "id long", "id").join(reduced, "key").drop("key")
    far = met.join(vocabulary.where(long), "id").where(one)
    cols = ["word", "n", "near", "near_n"]
    return short.select(cols).unionByName(far.select(cols))


# ------------------------------------------------------------------- forms
def variant_groups(vocabulary: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of ``vocabulary`` (word, n)."""
    vocabulary = _kept(vocabulary.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "op11-words")
    near = near_words(vocabulary, symbols)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    far = -F.col("best.m") >= ratio * F.col("n")
    forms = vocabulary.join(found, "word", "left").select(
        "word", "n", F.when(far, F.col("best.w")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"))
    forms = _kept(forms, "op11-forms")
    top = forms.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    steps = int(math.log(max(top["hi"] / max(top["lo"], 1), 1), ratio) + 1e-9) if top["hi"] and ratio > 1 else 0
    return forms.join(_roots(forms, steps), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of the words that have a form; a chain has at most ``steps`` forms."""
    at = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = _kept(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "op11-roots")
    return at


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      error_one_in: int | None = ERROR_ONE_IN, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of all words of ``docs`` (doc_id, text)."""
    return variant_groups(word_counts(docs, min_length, min_count, error_one_in), ratio, symbols)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
