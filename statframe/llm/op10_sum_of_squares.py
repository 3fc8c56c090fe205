"""Best-fit packing by the sum-of-squares rule.

Every document's ids (end id included) become pieces of at most ``capacity`` tokens; only
longer documents are cut, their first piece is the short one. A piece goes to the open
sequence, or to a new one, for which the sum over residual gaps of (number of open
sequences with that gap) squared becomes smallest; of equal ones the tightest. Pieces are
dealt to shards of about ``shard_pieces`` by a hash of a row number taken at a checkpoint, and a shard places its
pieces in falling length. Sequences a shard leaves with ``reopen`` or more tokens free
are opened again and their pieces packed once more, in fewer shards, so that the loss does
not grow with the number of shards.

Whole texts meet the tokenizer in place; only (doc_id, piece, start, length, crc32) is
shuffled. Defined results: null text is empty (one piece, the end id alone); rows with
equal doc_id are packed as separate documents; offsets in a sequence are gapless; an empty table gives
no row; a text of any length is encoded whole and cut into pieces; only ``doc_id`` and ``text`` are
read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoded_slices, task_done, vocabulary_path

CAPACITY = 2048
SHARD_PIECES = 8192
ROUNDS = 2
REOPEN = 16


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first takes what full pieces leave over."""
    full = (n - 1) // capacity
    return [n - full * capacity] + [capacity] * full


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    path = vocabulary or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for lo, count, ids in encoded_slices(batch.column(1), path):
                at, part, start, length, crc = [], [], [], [], []
                ends = np.cumsum(count)
                for r, (n, end) in enumerate(zip(count.tolist(), ends.tolist())):
                    s = 0
                    for k, m in enumerate(piece_lengths(n, capacity)):
                        at.append(lo + r)
                        part.append(k)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(ids[end - n + s:end - n + s + m].astype("<u4", copy=False)))
                        s += m
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        task_done(path)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the given order, and the gap left in each bin."""
    open_ = np.zeros(capacity + 1, np.int64)  # open bins by gap; a closed bin (gap 0) never counts
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        bin_, gap = -1, capacity
        if s < capacity:
            here = open_[s:capacity]
            cost = np.where(here > 0, 2 * (open_[:capacity - s] - here) + 2, none)
            if here[0] > 0:
                cost[0] = 1 - 2 * here[0]
            g = int(np.argmin(cost))
            if cost[g] <= 2 * open_[capacity - s] + 1:
                gap = s + g
                bin_ = by_gap[gap].pop()
                open_[gap] -= 1
        if bin_ < 0:
            bin_ = len(gaps)
            gaps.append(capacity)
        where[i], offset[i] = bin_, capacity - gap
        gaps[bin_] = gap = gap - s
        if gap:
            by_gap[gap].append(bin_)
            open_[gap] += 1
    return where, offset, np.array(gaps, np.int64)


def _pack_round(p: DataFrame, n: int, capacity: int, shard_pieces: int, seed: int) -> DataFrame:
    """Adds (shard, seq, offset, gap) to the pieces, packed shard by shard. Shards are dealt by the
    pieces' numbers, so repeated rows spread as others do."""
    shards = max(1, math.ceil(n / shard_pieces))
    dealt = p.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "no"), F.lit(shards)).cast("int"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        seq, offset, gaps = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(seq=seq, offset=offset, gap=gaps[seq])

    return dealt.groupBy("shard").applyInPandas(pack, fields + ", seq long, offset long, gap long")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, rounds: int = ROUNDS,
         reopen: int = REOPEN, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    todo = pieces(docs, capacity, vocabulary)
    out = None
    cols = todo.columns
    todo = todo.withColumn("no", F.monotonically_increasing_id()).checkpoint()
    for r in range(rounds):
        packed = _pack_round(todo, todo.count(), capacity, shard_pieces, r)
        last = r == rounds - 1
        if not last:
            packed = packed.checkpoint()
        done = packed if last else packed.where(F.col("gap") < reopen)
        named = done.select(*cols, (F.lit(r).cast("long") * F.lit(1 << 60) + F.col("shard").cast("long") * F.lit(1 << 31)
                                    + F.col("seq")).alias("sequence_id"), "offset")
        out = named if out is None else out.unionByName(named)
        if not last:
            todo = packed.where(F.col("gap") >= reopen).select(*cols, "no")
    return out


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
