"""SimHash near-dedup with bit-sliced fingerprint comparison.

Fingerprints: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles (repeats
count; a shorter text is one shingle of all its words; no word: fingerprint zero),
XXH64 seed 42 of each; bit b is set if more than half of the hashes have it.

Links: fingerprints at ``radius`` or fewer differing bits. The 64 bits are cut into
``radius + 2`` blocks; two fingerprints in reach agree on at least two blocks whole, so
only fingerprints that share a pair of blocks (ten pairs for radius 3) meet. Inside
such a bucket the distances are bit-sliced: bit planes are stored vertically, one
XOR gives one bit of 64 distances, carry-save counters add them up and a block of
lanes is left as soon as all its counters exceed the radius. A bucket of more than
``TILE`` fingerprints is cut into tiles (pairs of its parts), each a task's unit of
bounded size; every pair of the bucket still meets. A tile returns a star per local
component (never all its pairs), and the stars are merged by large-star / small-star
rounds, checkpointed in the shared folder.

Exact copies share a fingerprint and meet only once, as one row. Defined results:
null text counts as empty; empty texts all link (fingerprint zero); rows with equal
doc_id are separate members of their groups; a group without any non-null doc_id has
a null ``component_id``; an empty table gives no row; texts of any length are hashed whole, shingle by
shingle; columns besides ``doc_id`` and ``text`` are not read, and :func:`keep_one` carries them along under any
name. A bucket of n fingerprints costs n / ``TILE`` copies of each, so one block pair shared by a large part
of all *distinct* fingerprints would be quadratic in them; copies share one fingerprint and cost one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.session import shared_folder

from .common import free_name, local_components, table

SHINGLE = 3
RADIUS = 3
TILE = 4096
#: Buckets below this size are compared lane by lane over a whole batch.
SMALL = 64
STAR_ROUNDS = 60


# ------------------------------------------------------------ fingerprints
def _hashes(text: bytes | None, width: int) -> np.ndarray:
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    x = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([x(b" ".join(words), 42)], np.uint64)
    grams = zip(*[words[i:] for i in range(width)])
    return np.fromiter((x(b" ".join(g), 42) for g in grams), np.uint64, len(words) - width + 1)


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = hashes[lo:lo + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(width: int = SHINGLE):
    """Arrow function: text -> fingerprint as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        fps = np.fromiter((_majority(_hashes(t.as_py(), width)) for t in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(fps.view(np.int64))

    return fingerprint


# ------------------------------------------------- bit-sliced comparison
def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    pad = -n % 64
    if pad:
        bits = np.vstack([bits, np.zeros((pad, 64), np.uint8)])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lanes_within(planes_xor, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (bits of ``valid``) whose distance is at most ``radius``. ``planes_xor(b)`` gives
    the lanes' difference in bit b. Two planes enter each carry-save step; counters hold
    ``radius.bit_length()`` bits and what carries out of them is over the radius for good."""
    k = max(1, radius.bit_length())
    counter = [np.zeros_like(valid) for _ in range(k)]
    over = ~valid
    for b in range(0, 64, 2):
        x, y = planes_xor(b), planes_xor(b + 1)
        u = counter[0] ^ x
        carry = (counter[0] & x) | (u & y)
        counter[0] = u ^ y
        for j in range(1, k):
            t = counter[j] & carry
            counter[j] = counter[j] ^ carry
            carry = t
        over |= carry
        if b % 8 == 6 and not (~over).any():  # every lane of the block is out of reach
            return np.zeros_like(valid)
    less, same = np.zeros_like(valid), np.full_like(valid, ~np.uint64(0))
    for j in reversed(range(k)):  # counter <= radius, from the top bit
        if radius >> j & 1:
            less |= same & ~counter[j]
            same &= counter[j]
        else:
            same &= ~counter[j]
    return (less | same) & ~over


def _lane_ids(lanes: np.ndarray) -> np.ndarray:
    return np.unpackbits(lanes.view(np.uint8), axis=-1, bitorder="little")


def links_in_rows(fps: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small buckets laid out one after the other; ``end[i]`` is the end of
    row i's bucket. Distance ``i`` to ``i + d`` for all rows at once, d growing."""
    a, b = [], []
    at = np.arange(len(fps))
    d = 1
    while len(at):
        at = at[at + d < end[at]]
        for lo in range(0, len(at), 65536):
            left = at[lo:lo + 65536]
            p, q = bit_planes(fps[left]), bit_planes(fps[left + d])
            valid = np.zeros(p.shape[1] * 64, np.uint8)
            valid[:len(left)] = 1
            valid = np.packbits(valid, bitorder="little").view(np.uint64)
            hit = left[np.flatnonzero(_lane_ids(lanes_within(lambda i: p[i] ^ q[i], valid, radius)))]
            a.append(hit)
            b.append(hit + d)
        d += 1
    z = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (z, z)


def components_in_bucket(fps: np.ndarray, radius: int, part: np.ndarray | None = None) -> np.ndarray:
    """Component label of each fingerprint of one bucket; with ``part`` (0 / 1) only pairs
    between the two parts are compared."""
    n = len(fps)
    left = np.arange(n) if part is None else np.flatnonzero(part == 0)
    right = left if part is None else np.flatnonzero(part == 1)
    planes = bit_planes(fps[right])
    valid = np.packbits(np.r_[np.ones(len(right), np.uint8), np.zeros(-len(right) % 64, np.uint8)], bitorder="little").view(np.uint64)
    lab = np.arange(n)
    ones = ~np.uint64(0)
    for lo in range(0, len(left), 128):
        q = left[lo:lo + 128]
        mask = np.where((fps[q][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ones, np.uint64(0))
        w0 = lo // 64 if part is None else 0  # within one part: lanes at or after the query
        grid = np.broadcast_to(valid[w0:], (len(q), len(valid) - w0)).copy()
        hit = _lane_ids(lanes_within(lambda i: planes[i, w0:][None, :] ^ mask[:, i][:, None], grid, radius))
        i, j = np.nonzero(hit)
        lab = lab[local_components(n, lab[q[i]], lab[right[j + 64 * w0]])[lab]] if len(i) else lab
    return lab


def _star_edges(fps: np.ndarray, lab: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(lab != np.arange(len(lab)))
    return pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[lab[at]].view(np.int64))], names=["a", "b"])


def _bucket_links(batches, radius: int):
    """Stars of each (key, tile) run of a partition sorted by them; rows (key, tile, part, fp)."""
    def flush(cols):
        key, tile, part, fps = cols
        n = len(fps)
        if not n:
            return
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
        size = np.diff(cut)
        small = np.repeat((size > 1) & (size < SMALL), size)
        if small.any():
            f = fps[small]
            end = np.repeat(np.cumsum(size[(size > 1) & (size < SMALL)]), size[(size > 1) & (size < SMALL)])
            yield _star_edges(f, local_components(len(f), *links_in_rows(f, end, radius)))
        for g in np.flatnonzero(size >= SMALL):
            f, p = fps[cut[g]:cut[g + 1]], part[cut[g]:cut[g + 1]]
            two = tile[cut[g]] >= 0 and p.min() != p.max()
            if tile[cut[g]] >= 0 and not two and p[0] >= 0:
                continue  # the other part of this pair has no fingerprint
            yield _star_edges(f, components_in_bucket(f, radius, p if two else None))

    hold = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols[3] = cols[3].view(np.uint64)
        if not len(cols[0]):
            continue
        if hold is not None:
            cols = [np.concatenate(x) for x in zip(hold, cols)]
        key, tile = cols[0], cols[1]
        last = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        yield from flush([c[:at] for c in cols])
        hold = [c[at:] for c in cols]
    if hold is not None:
        yield from flush(hold)


# ----------------------------------------------------------------- plans
def block_keys(radius: int) -> list:
    """A key per pair of ``radius + 2`` blocks of the 64 bits: pair number and both blocks."""
    n = radius + 2
    cut = [round(64 * i / n) for i in range(n + 1)]
    block = [F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cut, cut[1:])]
    return [F.xxhash64(F.lit(i), block[a], block[b]) for i, (a, b) in enumerate(combinations(range(n), 2))]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Star edges (a, b) that connect all distinct ``fp`` within ``radius`` bits."""
    spark = fps.sparkSession
    keys = fps.select("fp", F.explode(F.array(*block_keys(radius))).alias("key"))
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = keys.join(many, "key").withColumn("parts", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int")
    whole = met.where(F.col("parts") == 1).select("key", F.lit(-1).alias("tile"), F.lit(-1).alias("part"), "fp")
    cut = (met.where(F.col("parts") > 1).withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .withColumn("tile", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
           .select("key", "tile", F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("part"), "fp"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.unionByName(cut).repartition(n, "key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(lambda it: _bucket_links(it, radius), "a long, b long")


def components(edges: DataFrame, rounds: int = STAR_ROUNDS) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's smallest,
    by alternating large-star and small-star rounds until the edges stand still."""
    def star(e, large: bool):
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = both.join(low, "a")
        if large:
            out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = mark(e)
    for _ in range(rounds):
        if not before[0]:
            break
        e = star(star(e, True), False).checkpoint()
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: whole-text fingerprints, linked."""
    fps = docs.select("doc_id", fingerprint_column(width)(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fp")).checkpoint()
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate group stays, the one with the smallest doc_id (of
    rows that repeat this id: the smallest text hash, then the first read). Rows without doc_id are
    not judged."""
    gid, rank = free_name(docs, "_gid"), free_name(docs, "_rank")
    near = near_duplicates(docs, radius, width).where(F.col("doc_id").isNotNull()).checkpoint()

    def ids(d):
        return d.select(F.col("doc_id").alias(gid))

    gone = ids(near.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    left = docs.join(gone, F.col("doc_id") == F.col(gid), "left_anti")
    twice = ids(near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if twice.isEmpty():
        return left
    # rows that repeat an id are written with a number; a partial aggregate picks one of each
    path = shared_folder(docs.sparkSession, "op5-repeated")
    (left.join(twice, F.col("doc_id") == F.col(gid), "left_semi")
     .withColumn(rank, F.monotonically_increasing_id()).write.parquet(path))
    again = docs.sparkSession.read.parquet(path)
    one = again.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), rank)).alias("m")).select(F.col(f"m.{rank}").alias(gid))
    again = again.join(one, F.col(rank) == F.col(gid), "left_semi").drop(rank)
    return left.join(twice, F.col("doc_id") == F.col(gid), "left_anti").unionByName(again)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
