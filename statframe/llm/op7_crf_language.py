"""Language ID by a linear-chain conditional random field over words.

Every word gets a label; a text's languages are the mean label marginals of its words, so a
code-switched text shows its shares. A word's emission score sums learned weights of its
affixes and character n-grams (2 to 4 letters of ``^word$``, hashed; those with a boundary
mark are its affixes) and a weighted lexicon entry (smoothed log share of each language
among the word's uses, for words seen in several training documents). Transitions between
neighbouring words are learned with them. Training maximises the conditional
likelihood; training and prediction take their marginals from the forward-backward
recursion, run on many chains at once. A chain is a run of up to ``CHAIN`` words; in prediction it is
read with ``CONTEXT`` more words of its text on both sides, whose own marginals come from the neighbouring
chains, so messages pass the cuts. In training, every ``SPLICE``-th chain goes on in one of another
language, so that switches are seen and learned as the rare transitions they are.

Training uses at most about ``docs_per_lang`` documents of each language, drawn by a hash of id and
text (equal rows give equal chains, which are taken once), and of each at most ``chains_per_doc`` evenly spread chains; lang, source and id are no
inputs of a prediction. All words of all texts are labelled in prediction.

Defined results: null text, or a text without a letter: ``und``, score 0; no labelled row:
``und`` everywhere; words without a letter take no part in the mean; ties go to the first
language in alphabetical order; the languages are the non-null values in the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, id_bucket, table, text_slices, words_of

DIMS = 1 << 16
CHAIN = 64
#: Words read beside a chain in prediction, and how many training chains there are to one that is spliced.
CONTEXT, SPLICE = 8, 4
DOCS_PER_LANG = 250
CHAINS_PER_DOC = 12
MIN_LEXICON_DOCS = 3
ROUNDS = 30
MAX_LANGS = 200
UNKNOWN = "und"


def letters_of(uniq: list[str]) -> list[str]:
    """Lower-cased letters (general category L) of each word."""
    s = "\n".join(w.replace("\n", " ") for w in uniq).lower()
    return regex.sub(r"[^\p{L}\n]", "", s).split("\n") if uniq else []


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, dimension) of every 2-, 3- and 4-gram of ``^word$``; none for an empty word."""
    s = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    full = np.fromiter((bool(w) for w in words), bool, len(words))
    rows, dims = [], []
    key = c
    for n in (2, 3, 4):
        if len(c) < n:
            break
        key = key[:len(c) - n + 1] * np.uint64(0x100000001B3) ^ c[n - 1:]
        inside = (at[:len(key)] == at[n - 1:]) & full[at[:len(key)]]
        h = (key[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(at[:len(key)][inside])
        dims.append((h >> np.uint64(48)).astype(np.int64) % DIMS)
    z = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(dims)) if rows else (z, z)


def _sum_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(rows, weights=values[:, k], minlength=n)
    return out


def chains_of(rows: np.ndarray, length: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the chains of a word stream whose texts are given by ``rows``."""
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    pos = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    start = np.flatnonzero(pos % length == 0)
    return start, np.diff(np.r_[start, len(rows)])


def overlapped(rows: np.ndarray, length: int = CHAIN, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, left, inner) for prediction: the chains of :func:`chains_of` with up to ``context``
    words of the same text before (``left`` of them) and after their ``inner`` own words."""
    start, n = chains_of(rows, length)
    end = start + n
    left = np.where((start > 0) & (rows[np.maximum(start - 1, 0)] == rows[start]), np.minimum(context, start), 0) if len(start) else start
    right = np.where((end < len(rows)) & (rows[np.minimum(end, len(rows) - 1)] == rows[start]), context, 0) if len(start) else start
    if len(start):  # no further than the text's end
        last = np.searchsorted(rows, rows[start], side="right")
        right = np.minimum(right, last - end)
    return start - left, n + left + right, left, n


@dataclass
class Crf:
    langs: list
    weights: np.ndarray      # (DIMS, K)
    trans: np.ndarray        # (K, K)
    start: np.ndarray        # (K,)
    lexicon: dict            # letters of a word -> row of lex
    lex: np.ndarray          # (words, K) centred log shares
    lex_weight: float

    def emissions(self, uniq: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emission score of each distinct word, and whether it has a letter."""
        words = letters_of(uniq)
        at, dim = ngram_features(words)
        e = _sum_rows(self.weights[dim], at, len(words)) if len(words) else np.zeros((0, len(self.langs)))
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            i, j = np.array(known).T
            e[i] += self.lex_weight * self.lex[j]
        return e, np.fromiter((bool(w) for w in words), bool, len(words))


def forward_backward(em: np.ndarray, start: np.ndarray, length: np.ndarray, crf: Crf, block: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label marginals of every word, and the expected transitions and chain starts.
    ``em`` are emission scores; chains of falling length run side by side, each step on
    those that still go."""
    k = em.shape[1]
    e = np.exp(em - em.max(axis=1, keepdims=True)) if len(em) else em
    a, pi = np.exp(crf.trans), np.exp(crf.start)
    marg = np.zeros_like(e)
    pairs, firsts = np.zeros((k, k)), np.zeros(k)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), block):
        s, n = start[order[lo:lo + block]], length[order[lo:lo + block]]
        live = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]))]  # chains longer than t
        alpha = [pi * e[s]]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for t in range(1, int(n[0])):
            x = (alpha[-1][:live[t]] @ a) * e[s[:live[t]] + t]
            alpha.append(x / x.sum(axis=1, keepdims=True))
        beta = np.ones((live[-1], k))
        for t in range(int(n[0]) - 1, -1, -1):
            m = alpha[t] * beta
            m /= m.sum(axis=1, keepdims=True)
            marg[s[:live[t]] + t] = m
            if t:
                eb = e[s[:live[t]] + t] * beta
                back = eb @ a.T
                z = (alpha[t - 1][:live[t]] * back).sum(axis=1, keepdims=True)
                pairs += (alpha[t - 1][:live[t]] / z).T @ eb * a
                back /= back.sum(axis=1, keepdims=True)
                beta = np.ones((live[t - 1], k)) / k
                beta[:live[t]] = back
            else:
                firsts += m.sum(axis=0)
    return marg, pairs, firsts


def train(texts: pa.Array, labels: list[str], rounds: int = ROUNDS) -> Crf:
    """Fit on chains (space-joined words) whose words all carry the chain's label. Chains are put in a fixed
    random order; every ``SPLICE``-th one whose predecessor has another label goes on from it."""
    langs = sorted(set(labels))
    k = len(langs)
    mixed = np.random.default_rng(7).permutation(len(labels))
    texts, labels = texts.take(pa.array(mixed)), [labels[i] for i in mixed]
    rows, codes, uniq = words_of(texts)
    y_row = np.fromiter((langs.index(x) for x in labels), np.int64, len(labels))
    words = letters_of(uniq)
    n = len(words)
    uses = np.zeros((n, k))
    y = y_row[rows]
    np.add.at(uses, (codes, y), 1.0)
    doc_uses = np.bincount(np.unique(np.stack([codes, rows], axis=1), axis=0)[:, 0], minlength=n) if len(codes) else np.zeros(n)
    share = (uses + 0.5) / (uses.sum(axis=1, keepdims=True) + 0.5 * k) if k else uses
    entry = np.log(share) - np.log(share).mean(axis=1, keepdims=True) if k else uses
    often = [i for i in np.flatnonzero(doc_uses >= MIN_LEXICON_DOCS) if words[i]]
    lexicon: dict = {}
    for i in often:  # several spellings of the same letters: the most used one speaks
        w = words[i]
        if w not in lexicon or uses[i].sum() > uses[lexicon[w]].sum():
            lexicon[w] = int(i)
    keep = list(lexicon.values())
    crf = Crf(langs, np.zeros((DIMS, k)), np.zeros((k, k)), np.zeros(k), {w: j for j, w in enumerate(lexicon)}, entry[keep], 0.0)
    if not len(codes) or k < 2:
        return crf
    at, dim = ngram_features(words)
    lex_row = np.fromiter((crf.lexicon.get(w, -1) for w in words), np.int64, n)
    start, _ = chains_of(rows)
    here = rows[start]
    spliced = np.r_[False, (y_row[here[1:]] != y_row[here[:-1]]) & (here[1:] != here[:-1]) & (here[1:] % SPLICE == 0)]
    start = start[~spliced]
    length = np.diff(np.r_[start, len(rows)])
    inner = np.ones(len(rows), bool)
    inner[start] = False
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (y[np.flatnonzero(inner) - 1], y[inner]), 1.0)
    seen_first = np.bincount(y[start], minlength=k)
    spoken = np.fromiter((bool(w) for w in words), bool, n)
    gold = np.zeros((len(rows), k))
    gold[np.arange(len(rows)), y] = 1.0
    total = len(rows)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (crf.weights, crf.trans, crf.start, np.zeros(()))]
    for step in range(1, rounds + 1):
        e = _sum_rows(crf.weights[dim], at, n)
        has = lex_row >= 0
        e[has] += crf.lex_weight * crf.lex[lex_row[has]]
        marg, pairs, firsts = forward_backward(e[codes], start, length, crf)
        gap = _sum_rows(gold - marg, codes, n) * spoken[:, None]
        grads = [_sum_rows(gap[at], dim, DIMS) / total - 1e-6 * crf.weights, (seen_pairs - pairs) / total - 1e-3 * crf.trans,
                 (seen_first - firsts) / total - 1e-3 * crf.start, np.asarray((gap[has] * crf.lex[lex_row[has]]).sum() / total - 1e-3 * crf.lex_weight)]
        new = []
        for p, g, (m, v) in zip((crf.weights, crf.trans, crf.start, np.asarray(crf.lex_weight)), grads, state):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            new.append(p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9))
        crf.weights, crf.trans, crf.start, crf.lex_weight = new[0], new[1], new[2], float(new[3])
    crf.weights = crf.weights.astype(np.float32)
    return crf


def language_shares(crf: Crf, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(mean marginals per text, number of words with a letter)."""
    k = len(crf.langs)
    share, count = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    for lo, part in text_slices(texts):
        rows, codes, uniq = words_of(part)
        if not len(codes):
            continue
        e, spoken = crf.emissions(uniq)
        count[lo:lo + len(part)] = np.bincount(rows[spoken[codes]], minlength=len(part))
        if k:
            start, length, left, n = overlapped(rows)
            # the words of all chains one after the other, contexts included
            begin = np.cumsum(length) - length
            word = np.repeat(start - begin, length) + np.arange(int(length.sum()))
            own = np.repeat(begin + left - (np.cumsum(n) - n), n) + np.arange(len(rows))
            marg = forward_backward(e[codes[word]], begin, length, crf)[0][own] * spoken[codes][:, None]
            share[lo:lo + len(part)] = _sum_rows(marg, rows, len(part))
    return share / np.maximum(count, 1)[:, None], count


def fit(docs: DataFrame, fold: tuple[int, int] | None = (4, 2), docs_per_lang: int = DOCS_PER_LANG,
        chains_per_doc: int = CHAINS_PER_DOC, rounds: int = ROUNDS) -> Crf:
    """Train on a bounded, hash-drawn sample of the rows with a language; ids whose crc32 leaves
    ``fold[1]`` modulo ``fold[0]`` are held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if fold:
        rows = rows.where(id_bucket("doc_id", fold[0]) != fold[1])
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(many) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = F.lit(0.0)
    for r in many:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, docs_per_lang / r["n"]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", F.col("text").cast("string")), F.lit(1_000_000)) < share * 1_000_000
    picked = rows.where(draw).select("doc_id", "text", "lang")

    def spread(batches):
        for batch in batches:
            out, lang = [], []
            for text, name in zip(batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().split()
                starts = np.arange(0, len(words), CHAIN)
                for i in starts[np.unique(np.linspace(0, len(starts) - 1, chains_per_doc).round().astype(int))] if len(starts) else []:
                    out.append(" ".join(words[i:i + CHAIN]))
                    lang.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(lang, pa.string())], names=["chain", "lang"])

    got = picked.mapInArrow(spread, "chain string, lang string").distinct().orderBy("lang", "chain").toArrow()
    return train(pc.cast(got["chain"].combine_chunks(), pa.string()), got["lang"].to_pylist(), rounds)


def detect(docs: DataFrame, crf: Crf) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the predicted language's mean marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        share, count = language_shares(m, texts)
        best = share.argmax(axis=1) if m.langs else np.zeros(len(texts), np.int64)
        ok = (count > 0) & bool(m.langs)
        lang = [m.langs[b] if o else UNKNOWN for b, o in zip(best, ok)]
        score = np.where(ok, share.max(axis=1) if m.langs else 0.0, 0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=["lang_pred", "score"])

    p = predict(F.col("text").cast("string"))
    c = free_name(docs, "_crf")
    return docs.withColumn(c, p).withColumn("lang_pred", F.col(c)["lang_pred"]).withColumn("score", F.col(c)["score"]).drop(c)


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = fit(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return detect(docs.select("doc_id", "text"), crf).select("doc_id", held, "lang_pred", "score")
