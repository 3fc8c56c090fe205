"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words (white-space words, lower-cased, punctuation
stripped at both ends), the edit distance counts word insertions, deletions and
substitutions, and a text contains an item if some window of it is within
``floor((1 - similarity) * n)`` edits of the item's n words.

The CGK walk maps a sequence to its embedding: step j emits the word under the pointer
and moves the pointer on by bit j of that word's hash under the walk's own key, so equal
stretches stay in step and an edit is left behind after a few steps with constant
probability; edit distance becomes Hamming distance. Each of ``tables`` repetitions has
its own walk key and its own sample of embedding coordinates (one per stratum of the
first ``steps`` steps); equal samples make a candidate. A walk from a position does not
depend on where its window ends, so one walk serves windows of every item's size; the
coordinates at which an item has ended are not sampled for it. Walks start from every
position of a text and, in a long item, from its longest word in every ``stride`` words, so
that an edited stretch costs only the walks that cross it. Coordinates are compared in
order and a start is left at the first one that no item shares.

Short items have few anchors that an edit could spare, so items of fewer than ``SHORT`` words
are walked from every word up to their last ``SHORT_TAIL``, and every walk ends with its item:
coordinates beyond the item's end are not compared, so what is embedded is the whole item-sized window from
the anchor on. Long items are embedded for ``steps`` steps from each of their anchors, which together span
the item. Recall at the allowed edits is measured by length in the tests (0.95 at least is asked of each class).

Candidates are verified exactly: a semi-global alignment of the item in the window
around the candidate's diagonal. Nothing is shuffled; items are broadcast in blocks of at
most ``block_items`` and every block meets all documents.

Defined results: null and empty texts contain nothing; items of fewer than ``min_words``
words are left out (the query and the pipeline leave out none: items of fewer than five
words have no edits allowed and are found as exact word sequences); rows with equal ids are
judged one by one; an item found several times in a text is reported once, at its best
(then first) place; an empty table on either side gives no hit and drops no row; texts of any length are
searched whole, slice by slice of whole texts; further columns of any name travel along in
:func:`drop_contaminated` and are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.session import shared_folder

from .common import free_name, table, text_slices, words_of

SIMILARITY = 0.8
TABLES = 12
STEPS = 20
SAMPLES = 6
STRIDE = 4
MIN_WORDS = 5
#: No anchor in the last words of an item: too few coordinates would be left.
MIN_TAIL = 10
#: Items of fewer words are walked from every word but the last ones.
SHORT, SHORT_TAIL = 18, 5
BLOCK_ITEMS = 20_000
PUNCT = ".,;:!?\"'()[]{}<>«»“”‘’…*#$%&|-_"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(uniq: list[str]) -> np.ndarray:
    x = xxhash.xxh64_intdigest
    return np.fromiter((x(w.lower().strip(PUNCT) or w) | 1 for w in uniq), np.uint64, len(uniq))


def _step(h: np.ndarray, key: np.uint64, j: int) -> np.ndarray:
    """Bit j of each word's hash under the walk's key."""
    return (((h ^ (h >> np.uint64(29))) * key) >> np.uint64(63 - j)) & np.uint64(1)


@dataclass
class Walks:
    """Coordinates and keys of every table, and the item index they give."""

    words: np.ndarray          # all items' word hashes, one after the other
    first: np.ndarray          # start of each item in ``words`` (one more at the end)
    ids: list                  # item ids
    anchor_item: np.ndarray
    anchor_at: np.ndarray      # anchor position in its item
    starts: np.ndarray         # sorted distinct hashes of anchor words
    tables: list               # (walk key, sampled steps, [(keys that go on, (end keys, anchors))])
    similarity: float
    sorted_words: list         # each item's word hashes in order

    def max_edits(self, item: int) -> int:
        return edits_of(int(self.first[item + 1] - self.first[item]), self.similarity)


def edits_of(n: int, similarity: float) -> int:
    """Edits that an item of n words is allowed."""
    return int((1.0 - similarity) * n + 1e-9)


def sample_steps(rng: np.random.Generator, steps: int, samples: int) -> np.ndarray:
    """Coordinate 0 and one random coordinate from each of samples - 1 even strata."""
    cut = np.linspace(1, steps, samples).round().astype(int)
    return np.r_[0, [rng.integers(lo, hi) for lo, hi in zip(cut, cut[1:])]]


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def index_items(ids: list, texts: list, similarity: float = SIMILARITY, tables: int = TABLES, steps: int = STEPS,
                samples: int = SAMPLES, stride: int = STRIDE, min_words: int = MIN_WORDS, seed: int = 11) -> Walks:
    rows, codes, uniq = words_of(pa.array(texts, pa.string()))
    h = word_hashes(uniq)[codes] if len(codes) else np.zeros(0, np.uint64)
    size = np.array([len(w) for w in uniq], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    count = np.bincount(rows, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    use = np.flatnonzero(count >= max(min_words, 1))
    off = np.r_[0, np.cumsum(count)]
    words = np.concatenate([h[off[i]:off[i + 1]] for i in use]) if len(use) else np.zeros(0, np.uint64)
    first = np.r_[0, np.cumsum(count[use])].astype(np.int64)
    item, at = [], []
    for k, i in enumerate(use):
        ln = size[off[i]:off[i + 1]]
        if len(ln) < SHORT:
            n = max(1, len(ln) - SHORT_TAIL) if len(ln) > 2 * SHORT_TAIL else len(ln)
            item += [k] * n
            at += range(n)
            continue
        last = max(1, len(ln) - MIN_TAIL + 1)
        for lo in range(0, last, stride):
            item.append(k)
            at.append(lo + int(np.argmax(ln[lo:min(lo + stride, last)])))
    item, at = np.array(item, np.int64), np.array(at, np.int64)
    rng = np.random.default_rng(seed)
    out = []
    end = first[item + 1] if len(item) else item
    for _ in range(tables):
        key = np.uint64(int(rng.integers(1, 2**63)) * 2 + 1)
        sampled = sample_steps(rng, steps, samples)
        pos = first[item] + at if len(item) else item
        live = np.arange(len(item))
        chain = np.zeros(len(item), np.uint64)
        levels, j = [], 0
        for level, s in enumerate(sampled):
            while j < s:
                ok = pos < end[live]
                pos = pos + (_step(words[np.minimum(pos, len(words) - 1)], key, j).astype(np.int64) * ok)
                j += 1
            inside = pos < end[live]
            ended = live[~inside]
            if level and len(ended):  # these anchors were complete one coordinate before
                ek = chain[~inside]
                o = np.argsort(ek, kind="stable")
                levels[-1][1] = (np.concatenate([levels[-1][1][0], ek[o]]), np.concatenate([levels[-1][1][1], ended[o]]))
            live, pos, chain = live[inside], pos[inside], chain[inside]
            chain = (chain ^ words[pos]) * _MIX if len(live) else chain
            levels.append([np.unique(chain), (np.zeros(0, np.uint64), np.zeros(0, np.int64))])
        o = np.argsort(chain, kind="stable")
        levels[-1][1] = (chain[o], live[o])
        for lv in levels:
            o = np.argsort(lv[1][0], kind="stable")
            lv[1] = (lv[1][0][o], lv[1][1][o])
        out.append((key, sampled, levels))
    starts = np.unique(words[first[item] + at]) if len(item) else np.zeros(0, np.uint64)
    return Walks(words, first, [ids[i] for i in use], item, at, starts, out, similarity, [np.sort(words[a:b]) for a, b in zip(first, first[1:])])


def candidates(w: Walks, h: np.ndarray, row_end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, anchor) pairs whose sampled coordinates agree in at least one table.
    ``start`` are the positions to walk from, ``row_end`` the end of each one's text."""
    found_p, found_a = [], []
    for key, sampled, levels in w.tables:
        p, pos, end = start, start, row_end
        chain = np.zeros(len(p), np.uint64)
        j = 0
        for level, s in enumerate(sampled):
            while j < s:
                pos = pos + _step(h[np.minimum(pos, len(h) - 1)], key, j).astype(np.int64) * (pos < end)
                j += 1
            inside = pos < end
            p, pos, end, chain = p[inside], pos[inside], end[inside], chain[inside]
            chain = (chain ^ h[pos]) * _MIX
            on, (last, anchor) = levels[level]
            if not len(p) or not len(on):
                break
            keep = _member(on, chain)
            p, pos, end, chain = p[keep], pos[keep], end[keep], chain[keep]
            if len(last):
                lo, hi = np.searchsorted(last, chain, "left"), np.searchsorted(last, chain, "right")
                n = hi - lo
                if n.any():
                    found_p.append(np.repeat(p, n))
                    found_a.append(anchor[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
    if not found_p:
        z = np.zeros(0, np.int64)
        return z, z
    both = np.unique(np.stack([np.concatenate(found_p), np.concatenate(found_a)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _edit_ends(a: np.ndarray, b: np.ndarray, free_start: bool) -> np.ndarray:
    """Edit distance of all of ``a`` to b[s:j] for every end j: best s if ``free_start``, else s = 0."""
    j = np.arange(len(b) + 1)
    d = np.zeros(len(b) + 1, np.int64) if free_start else j.copy()
    for i, x in enumerate(a, 1):
        t = np.empty_like(d)
        t[0] = i
        np.minimum(d[1:] + 1, d[:-1] + (b != x), out=t[1:])
        d = np.minimum.accumulate(t - j) + j
    return d


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the window of ``b`` nearest to ``a`` (first end, longest window)."""
    d = _edit_ends(a, b, True)
    end = int(np.argmin(d))
    back = _edit_ends(a[::-1], b[:end][::-1], False)
    return int(d[end]), end - int(len(back) - 1 - np.argmin(back[::-1])), end


def find_items(w: Walks, texts: pa.Array):
    """Rows (text row, item, distance, first word, words of the window) of one slice."""
    rows, codes, uniq = words_of(texts)
    if not len(codes) or not len(w.starts):
        return []
    uh = word_hashes(uniq)
    h = uh[codes]
    row_end = np.searchsorted(rows, rows, side="right") if len(rows) < 2 else np.r_[
        np.flatnonzero(rows[1:] != rows[:-1]) + 1, len(rows)][np.r_[0, np.cumsum(rows[1:] != rows[:-1])]]
    start = np.flatnonzero(_member(w.starts, uh)[codes])
    p, anchor = candidates(w, h, row_end[start], start)
    if not len(p):
        return []
    item = w.anchor_item[anchor]
    diag = p - w.anchor_at[anchor]
    order = np.lexsort((diag, item, rows[p]))
    best: dict = {}
    tried: dict = {}
    for k in order:
        r, i, g = int(rows[p[k]]), int(item[k]), int(diag[k])
        edits = w.max_edits(i)
        if (r, i) in tried and g - tried[r, i] <= 0:
            continue  # the window verified before reaches this diagonal
        if (r, i) in best and best[r, i][0] == 0:
            continue  # found without an edit
        tried[r, i] = g + edits
        a = w.words[w.first[i]:w.first[i + 1]]
        lo_row, hi_row = int(np.searchsorted(rows, r)), int(row_end[p[k]])
        lo, hi = max(lo_row, g - edits), min(hi_row, g + len(a) + 2 * edits)
        if np.count_nonzero(_member(w.sorted_words[i], h[lo:hi])) < len(a) - edits:
            continue  # each of the item's words but ``edits`` must be met
        d, s, e = align(a, h[lo:hi])
        if d <= edits and ((r, i) not in best or d < best[r, i][0]):
            best[r, i] = (d, lo + s - lo_row, e - s)
    return [(r, i, *v) for (r, i), v in sorted(best.items())]


def item_blocks(bench: DataFrame, block_items: int = BLOCK_ITEMS, **index_args):
    """The items' index in blocks of about ``block_items`` (by id hash), one after the other: what one
    broadcast holds. There is one block at least."""
    blocks = max(1, -(-bench.count() // block_items))
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", F.col("text").cast("string"))
        rows = sorted(part.collect(), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
        yield index_items([r[0] for r in rows], [r[1] for r in rows], **index_args)


def contaminations(docs: DataFrame, bench: DataFrame, block_items: int = BLOCK_ITEMS, **index_args) -> DataFrame:
    """(doc_id, item_id, distance, n_words, first_word, window_words): every item found in a text. With
    several blocks of items, each block's hits are written in the shared folder and its index is released before the
    next one is built."""
    spark = docs.sparkSession
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "item_id": bench.schema["item_id"].dataType.simpleString()}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, distance int, n_words int, first_word long, window_words int"
    several = bench.count() > block_items
    parts = []
    for walks in item_blocks(bench, block_items, **index_args):
        shared = spark.sparkContext.broadcast(walks)

        def search(batches, shared=shared):
            w = shared.value
            id_type = pa.array(w.ids).type if w.ids else pa.int64()
            for batch in batches:
                for lo, part in text_slices(batch.column(1)):
                    hits = find_items(w, part)
                    if hits:
                        r, i, d, s, n = (list(x) for x in zip(*hits))
                        size = np.diff(w.first)[i]
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array([lo + x for x in r])), pa.array([w.ids[x] for x in i], id_type),
                            pa.array(d, pa.int32()), pa.array(size, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int32())],
                            names=["doc_id", "item_id", "distance", "n_words", "first_word", "window_words"])

        hits = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(search, schema)
        if several:
            path = shared_folder(spark, "op2-hits")
            hits.write.parquet(path)
            hits = spark.read.parquet(path)
            shared.destroy()
        parts.append(hits)
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, bench: DataFrame, block_items: int = BLOCK_ITEMS, **index_args) -> DataFrame:
    """Rows whose text contains no item, with the columns of ``docs``. With several blocks of items, the rows that
    a block leaves are written in the shared folder before the next block's index is built."""
    spark = docs.sparkSession
    flag = free_name(docs, "_hit")
    several = bench.count() > block_items
    for walks in item_blocks(bench, block_items, **index_args):
        shared = spark.sparkContext.broadcast(walks)
        docs = docs.withColumn(flag, _hit_column(shared)(F.col("text").cast("string"))).where(~F.col(flag)).drop(flag)
        if several:
            path = shared_folder(spark, "op2-left")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            shared.destroy()
    return docs


def _hit_column(shared):
    """Arrow function: whether a text contains an item of the broadcast block."""
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for lo, part in text_slices(texts):
            for found in find_items(shared.value, part):
                out[lo + found[0]] = True
        return pa.array(out)

    return hit


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)
