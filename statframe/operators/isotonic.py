"""Distributed isotonic regression (X4): pool adjacent violators per score bucket, merged by bucket order.

1. Equal scores are summed (partial aggregate) and put in buckets of the global score order.
2. Every bucket is pooled on its own: its stack of blocks (weight, sum, score range) has rising means
   and is written as a table.
3. What bucket borders change is decided on the ends of the stacks alone: the first and last
   ``ends`` blocks of each, with a gap where blocks are hidden between them. Neighbouring stacks are merged ``FAN``
   at a time in rounds; a task sees at most ``FAN`` times twice the ends. Pooling that would reach a
   hidden block is not guessed: the rounds are run again with 16 times the ends, up to whole stacks.
4. Blocks pooled across borders are at most as many as there are borders; they replace the
   blocks of the written stacks that they cover.

The fitted blocks stay a distributed table, and scores meet them by an as-of search in the
same global order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import GlobalOrder
from ..session import shared_folder

FAN, ENDS = 64, 16
#: Rounds in which all falling runs of a bucket are pooled at once, before the rest is pooled in order.
SWEEPS = 12
BLOCK = "lo double, hi double, weight double, total double"


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple:
    """Blocks of rising means of points or blocks in score order; equal means are one block."""
    for _ in range(SWEEPS):
        mean = s / w
        rise = mean[1:] > mean[:-1]
        if rise.all():
            return lo, hi, w, s
        first = np.flatnonzero(np.r_[True, rise])
        last = np.r_[first[1:], len(lo)] - 1
        lo, hi, w, s = lo[first], hi[last], np.add.reduceat(w, first), np.add.reduceat(s, first)
    out: list[list[float]] = []
    for a, b, x, t in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist()):
        while out and out[-1][3] / out[-1][2] >= t / x:
            p = out.pop()
            a, x, t = p[0], x + p[2], t + p[3]
        out.append([a, b, x, t])
    return tuple(np.array(c) for c in zip(*out))


def _stacks(batches):
    """Pooled blocks of each bucket of a partition sorted by (bucket, score)."""
    hold: list[tuple] = []

    def close(bucket):
        lo, hi, w, s = pool(*(np.concatenate(c) for c in zip(*hold)))
        hold.clear()
        n = len(lo)
        pos = np.arange(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(pos), pa.array(n - 1 - pos), pa.array(lo), pa.array(hi),
                                           pa.array(w), pa.array(s)], names=["bucket", "pos", "rest", "lo", "hi", "weight", "total"])

    last = None
    for batch in batches:
        b, x, w, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        cut = np.flatnonzero(b[1:] != b[:-1]) + 1
        for lo, hi in zip([0, *cut], [*cut, len(b)]):
            if lo == hi:
                continue
            if last is not None and b[lo] != last:
                yield close(last)
            last = b[lo]
            hold.append(pool(x[lo:hi], x[lo:hi], w[lo:hi], s[lo:hi]))  # pooled so far: what is kept stays small
    if hold:
        yield close(last)


def merge_stacks(rows: list[dict]) -> tuple[list[dict], bool]:
    """Pools the items (blocks and gaps) of neighbouring stacks, in order. True if pooling met a gap:
    a hidden block could take part."""
    out: list[dict] = []
    for r in rows:
        r = dict(r)
        if not r["gap"]:
            while out and not out[-1]["gap"] and out[-1]["total"] * r["weight"] >= r["total"] * out[-1]["weight"]:
                p = out.pop()
                r.update(lo=p["lo"], weight=r["weight"] + p["weight"], total=r["total"] + p["total"], pooled=True)
        out.append(r)
    beside = any(a["gap"] and b["pooled"] or b["gap"] and a["pooled"] for a, b in zip(out, out[1:]))
    return out, beside


ITEM = f"node long, seq long, {BLOCK}, pooled boolean, gap boolean, state string"


def _merge_round(batch_of_nodes: pd.DataFrame, ends: int, fan: int) -> pd.DataFrame:
    """One stack from the stacks of neighbouring nodes; blocks that become hidden behind the new
    ends are final, and those of them that were pooled are returned as ``done``."""
    d = batch_of_nodes.sort_values(["node", "seq"])
    rows, deeper = merge_stacks(d.to_dict("records"))
    shown = set(range(min(len(rows), ends + 1))) | set(range(max(0, len(rows) - ends - 1), len(rows)))
    out = []
    hidden = False
    for i, r in enumerate(rows):
        if i in shown:
            if r["gap"] and hidden:
                continue
            hidden = r["gap"]
            out.append({**r, "state": "open"})
            continue
        if r["pooled"] and not r["gap"]:
            out.append({**r, "state": "done"})
        if not hidden:
            out.append({**r, "pooled": False, "gap": True, "state": "open", "lo": np.nan, "hi": np.nan, "weight": 0.0, "total": 0.0})
            hidden = True
    out = [{**r, "node": int(d["node"].iloc[0]) // fan, "seq": i} for i, r in enumerate(out)]
    if deeper:
        out.append({"node": -1, "seq": 0, "lo": np.nan, "hi": np.nan, "weight": 0.0, "total": 0.0, "pooled": False, "gap": False, "state": "deeper"})
    return pd.DataFrame(out)[["node", "seq", "lo", "hi", "weight", "total", "pooled", "gap", "state"]]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _border_blocks(stacks: DataFrame, buckets: int, ends: int, fan: int) -> list | None:
    """Blocks pooled across bucket borders, or None if the ends do not reach."""
    shown = stacks.where((F.col("pos") <= ends) | (F.col("rest") <= ends))
    block = shown.select(F.col("bucket").cast("long").alias("node"), (F.col("pos") * 2).alias("seq"), "lo", "hi", "weight", "total",
                         F.lit(False).alias("pooled"), F.lit(False).alias("gap"), F.lit("open").alias("state"))
    # one gap behind the first ends + 1 blocks of a stack that has more than is shown
    gap = stacks.where((F.col("pos") == ends) & (F.col("rest") > ends + 1)).select(
        F.col("bucket").cast("long").alias("node"), (F.col("pos") * 2 + 1).alias("seq"), F.lit(float("nan")).alias("lo"), F.lit(float("nan")).alias("hi"),
        F.lit(0.0).alias("weight"), F.lit(0.0).alias("total"), F.lit(False).alias("pooled"), F.lit(True).alias("gap"), F.lit("open").alias("state"))
    level = block.unionByName(gap)
    done: list = []
    while True:
        out = _written(level.groupBy(F.floor(F.col("node") / F.lit(fan)).alias("up")).applyInPandas(
            lambda pdf: _merge_round(pdf, ends, fan), ITEM), "isotonic-level")
        if out.where("state = 'deeper'").limit(1).count():
            return None
        done += out.where("state = 'done'").select("lo", "hi", "weight", "total").collect()
        buckets = -(-buckets // fan)
        level = out.where("state = 'open'")
        if buckets <= 1:
            return done + level.where("pooled").select("lo", "hi", "weight", "total").collect()


@dataclass
class IsotonicFit:
    """``blocks``: (lo, hi, weight, value), disjoint score ranges of rising values."""
    blocks: DataFrame
    pooled_over_borders: int

    def knots(self) -> DataFrame:
        """(score, value) at both ends of every block (once where they are one score)."""
        both = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
        return self.blocks.select(F.explode(both).alias("score"), "value")

    def predict(self, df: DataFrame, score: str, name: str = "isotonic", n_buckets: int | None = None) -> DataFrame:
        """``df`` with the fitted value of ``score``: linear between knots, constant beyond the ends,
        null for a null score."""
        x = F.col(score).cast("double")
        has = df.where(x.isNotNull() & ~F.isnan(x))
        rows = has.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), x.alias("_x"), F.lit(1).alias("_k"),
                          F.lit(None).cast("double").alias("_kx"), F.lit(None).cast("double").alias("_kv"))
        knots = self.knots().select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("score").alias("_x"), F.lit(0).alias("_k"),
                                    F.col("score").alias("_kx"), F.col("value").alias("_kv"))
        near = GlobalOrder(rows.unionByName(knots), ["_x", "_k"], n_buckets).with_neighbors(["_kx", "_kv"]).where("_k = 1")
        a, b, u, v, at = (F.col(c) for c in ("_kx_prev", "_kx_next", "_kv_prev", "_kv_next", "_x"))
        value = (F.when(a.isNull(), v).when(b.isNull() | (a == at) | (u == v), u).otherwise(u + (v - u) * (at - a) / (b - a)))
        out = near.select("_row.*", value.alias(name))
        rest = df.where(x.isNull() | F.isnan(x)).withColumn(name, F.lit(None).cast("double"))
        return out.unionByName(rest)


def isotonic(df: DataFrame, y: str, score: str, weight: str | None = None, n_buckets: int | None = None, ends: int = ENDS, fan: int = FAN) -> IsotonicFit:
    """Least-squares non-decreasing fit of ``y`` by ``score``. Rows with a null in y, score or weight,
    or without positive weight, are left out; rows of equal score are one point."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(score).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).dropna().where("w > 0")
    points = rows.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    order = GlobalOrder(_written(points, "isotonic-points"), ["x"], n_buckets)
    if not order.n_rows:
        raise ValueError("no complete rows")
    dealt = order.bucketed.select("_b", "x", "w", "s").repartition("_b").sortWithinPartitions("_b", "x")
    stacks = _written(dealt.mapInArrow(_stacks, f"bucket int, pos long, rest long, {BLOCK}"), "isotonic-stacks")
    buckets = (stacks.agg(F.max("bucket")).first()[0] or 0) + 1
    found = _border_blocks(stacks, buckets, ends, fan)
    while found is None:
        ends *= 16
        found = _border_blocks(stacks, buckets, ends, fan)
    found = sorted(found, key=lambda r: r["lo"])
    low, high = np.array([r["lo"] for r in found]), np.array([r["hi"] for r in found])

    def uncovered(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            i = np.searchsorted(low, at, side="right") - 1
            inside = (i >= 0) & (at <= high[np.maximum(i, 0)]) if len(low) else np.zeros(len(at), bool)
            yield batch.filter(pa.array(~inside))

    own = stacks.select("lo", "hi", "weight", "total").mapInArrow(uncovered, BLOCK)
    both = own.unionByName(df.sparkSession.createDataFrame([tuple(r) for r in found], BLOCK))
    blocks = both.select("lo", "hi", "weight", (F.col("total") / F.col("weight")).alias("value"))
    return IsotonicFit(_written(blocks, "isotonic-blocks"), len(found))
