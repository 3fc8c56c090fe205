"""GIDX: a scalable global row order without a single-partition window.

``Window.orderBy(...)`` with no partition pulls every row into one task. The
global order here is two-level:

1. cut points in the space of *all* order columns, from the distinct keys of a bounded
   hash sample (about ``SAMPLE_PER_BUCKET`` rows per bucket, counted on the executors); a
   binary search over the cut tuples maps each row to its bucket. A key that is heavy
   in its leading columns is split by the later ones, and only rows equal in every order
   column must share a bucket;
2. ``row_number`` / ``lag`` / running sums inside
   ``Window.partitionBy(bucket).orderBy(keys)``;
3. one summary row per bucket (count, column sums, last values), broadcast back as
   offsets and edge values.

The number of buckets follows from the row count alone (:func:`bucket_count`). Up to
``ONE_LEVEL`` buckets the cut tuples are literals of the plan. Beyond that the cuts inside each
of ``ONE_LEVEL`` coarse buckets are found on the executors from the written sample, and are
a broadcast table (a row per coarse bucket) that each row searches after its coarse bucket, so the plan does not
grow with the cuts and no row leaves the JVM. The driver holds the cuts and the per-bucket summary, bounded by buckets x lags,
never the rows or the sample.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_table, shared_folder

MAX_EDGE_CELLS = 50_000_000
MIN_BUCKETS = 8
ROWS_PER_BUCKET = 500_000
#: Beyond this many buckets their number grows with the square root of the rows.
LINEAR_BUCKETS = 20_000
SAMPLE_PER_BUCKET = 64
#: Cut tuples that are written into the plan at most.
ONE_LEVEL = 64


def bucket_count(n_rows: int) -> int:
    """Buckets for ``n_rows``: one per ``ROWS_PER_BUCKET``, and 155,000 for 6e11 rows
    (3.9 million rows in each, an external sort)."""
    linear = n_rows / ROWS_PER_BUCKET
    if linear > LINEAR_BUCKETS:
        linear = math.sqrt(linear * LINEAR_BUCKETS)
    return max(MIN_BUCKETS, math.ceil(linear))


def order_image(df: DataFrame, name: str) -> Column:
    """Image of an order column that compares as the column does, of a type with literals."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dt, (T.IntegralType, T.BooleanType)):
        return c.cast("long")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    if isinstance(dt, (T.DecimalType, T.StringType)):
        return c
    raise TypeError(f"order column {name!r} must be numeric, text, date or timestamp, not {dt}")


def _cut_array(values: list, dt: T.DataType) -> Column:
    """Array literal of one order column's cut values."""
    if isinstance(dt, T.StringType):
        return F.lit(values)
    if isinstance(dt, T.DoubleType):
        return F.expr("array(" + ", ".join(f"double('{v!r}')" for v in values) + ")")
    if isinstance(dt, T.DecimalType):
        return F.expr("array(" + ", ".join(f"cast('{v}' as {dt.simpleString()})" for v in values) + ")")
    return F.expr("array(" + ", ".join(f"{v}L" if v > -2**63 else "cast('-9223372036854775808' as bigint)" for v in values) + ")")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _drawn(keys: DataFrame, img: list[str], share: float, seed: int = 17) -> DataFrame:
    """(keys, ``_n``): a share of the distinct keys, drawn by hash, with their rows counted."""
    limit = int(min(1.0, share) * (1 << 31))
    drawn = keys.where(F.pmod(F.xxhash64(F.lit(seed), *img), F.lit(1 << 31)) <= limit)
    return drawn if "_n" in keys.columns else drawn.groupBy(*img).agg(F.count(F.lit(1)).alias("_n"))


def _sortable(r: tuple) -> list:
    """Sort key of a sample row (keys and count): NaN follows all numbers, as in Spark."""
    return [(isinstance(v, float) and math.isnan(v), v) for v in r[:-1]]


def _cut_points(sample: list[tuple], want: int) -> list[tuple]:
    """Keys at which about each 1 / ``want`` of the sample's rows begins, from sorted (keys, count) rows."""
    cuts: list[tuple] = []
    total, seen, step = sum(r[-1] for r in sample), 0, 1
    for r in sample:
        if seen >= step * total / want and seen:
            cuts.append(r[:-1])
            while seen >= step * total / want:
                step += 1
        seen += r[-1]
    return cuts


def _search(key: list[Column], lead: Column, rest: Column | None, n_cuts: int) -> Column:
    """How many of the cut tuples (ascending, at most ``n_cuts``) are not above the row's key, by binary search.
    ``lead`` holds the cuts' first values, ``rest`` their others as structs, read on a tie only. One expression
    whose size does not grow with the cuts: a column a step would name the one before it several times, and the optimizer, which writes them
    out in each other, would need memory exponential in the steps. Few cuts are compared one by one in generated code, which is
faster where no first value ties."""
    if not n_cuts:
        return F.lit(0)
    steps = [1 << i for i in range(n_cuts.bit_length() - 1, -1, -1)]

    def halve(at: Column, step: Column) -> Column:
        i = at + step - F.lit(1)
        cut = F.get(lead, i)
        if rest is None:
            return F.when(cut <= key[0], at + step).otherwise(at)
        return F.when((cut < key[0]) | ((cut == key[0]) & (F.get(rest, i) <= F.struct(*key[1:]))), at + step).otherwise(at)

    found = F.aggregate(F.lit(steps), F.lit(0), halve)
    if n_cuts > ONE_LEVEL:
        return found
    below = sum((F.when(F.get(lead, F.lit(i)) < key[0], 1).otherwise(0) for i in range(n_cuts)), F.lit(0))
    return F.when(F.array_contains(lead, key[0]), found).otherwise(below)


def _literal_search(key: list[Column], img: list[str], types: list, cuts: list[tuple]) -> Column:
    """:func:`_search` among cuts that are literals of the plan."""
    if not cuts:
        return F.lit(0)
    arrays = [_cut_array([c[j] for c in cuts], dt) for j, dt in enumerate(types)]
    return _search(key, arrays[0], _tuples(arrays[1:], img[1:]), len(cuts))


def _tuples(arrays: list[Column], names: list[str]) -> Column | None:
    """Arrays of equal length as one array of structs."""
    if not arrays:
        return None
    return F.transform(arrays[0], lambda v, i: F.struct(v.alias(names[0]), *[F.get(a, i).alias(k) for a, k in zip(arrays[1:], names[1:])]))


def _fine_cuts(sample: DataFrame, img: list[str], fine: int) -> DataFrame:
    """The cut tuples inside each coarse bucket of the sample (its share of ``SAMPLE_PER_BUCKET``
    keys per bucket), as :func:`_cut_points` places them."""
    rows = Window.partitionBy("_b").orderBy(*img).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sample.select("_b", *img, "_n", (F.sum("_n").over(rows) - F.col("_n")).alias("_seen"), F.sum("_n").over(Window.partitionBy("_b")).alias("_all"))
    step = F.floor(F.col("_seen") * F.lit(fine) / F.col("_all"))
    first = F.lag(step, 1, 0).over(Window.partitionBy("_b").orderBy(*img))
    return seen.withColumn("_cut", step > first).where("_cut").select(*img)


def _places(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """2 i + 1 where a value is the i-th of ``known`` (ascending, distinct), 2 i where it lies before it."""
    at = np.searchsorted(known, values, side="left")
    near = np.minimum(at, len(known) - 1)
    same = known[near] == values
    if values.dtype.kind == "f":
        same |= np.isnan(values) & np.isnan(known[near])
    return 2 * at + ((at < len(known)) & same)


class CutTable:
    """Cut tuples for vectorised search of NumPy columns (:func:`_two_levels` searches table rows): column by column, a row's place among the cuts' distinct
    prefixes. A row that equals no prefix keeps its even place whatever follows."""

    def __init__(self, cuts: list[tuple]):
        self.known, self.prefixes = [], []
        place = None
        for j in range(len(cuts[0])):
            values = _as_array([c[j] for c in cuts])
            self.known.append(np.unique(values))
            place = self._next(place, j, values)
            self.prefixes.append(np.unique(place))
            place = 2 * np.searchsorted(self.prefixes[-1], place) + 1

    def _next(self, place, j: int, values: np.ndarray) -> np.ndarray:
        own = _places(values, self.known[j])
        return own if place is None else place * (2 * len(self.known[j]) + 1) + own

    def buckets(self, columns: list[np.ndarray]) -> np.ndarray:
        """How many cuts are not above each row's key."""
        place = None
        for j, values in enumerate(columns):
            key = self._next(place, j, values)
            place = _places(key, self.prefixes[j])
        return (place + 1) // 2


def _as_array(values) -> np.ndarray:
    kind = np.float64 if isinstance(values[0], float) else np.int64 if isinstance(values[0], int) else object
    return np.array(values, dtype=kind)


def _two_levels(df: DataFrame, key: list[Column], img: list[str], types: list, coarse: list[tuple], cuts: list[tuple]) -> DataFrame:
    """Adds ``_b``: how many of ``cuts`` (ascending, the ``coarse`` ones among them) are not above the row's key.
    The row's coarse bucket names the row of a broadcast table that holds the cuts inside that bucket."""
    marks = set(coarse)
    starts = [0, *(i for i, c in enumerate(cuts) if c in marks), len(cuts)]
    table = [(k, lo, *[[c[j] for c in cuts[lo:hi]] for j in range(len(types))]) for k, (lo, hi) in enumerate(zip(starts, starts[1:]))]
    # names that no column of the rows has
    at, low, lead, rest, *inner = _unused(df, "_at", "_low", "_lead", "_rest", *[f"_cut{j}" for j in range(len(types))])
    schema = T.StructType([T.StructField(at, T.IntegerType()), T.StructField(low, T.IntegerType())]
                          + [T.StructField(c, T.ArrayType(dt)) for c, dt in zip(inner, types)])
    others = _tuples([F.col(c) for c in inner[1:]], img[1:])
    edges = local_table(df.sparkSession, table, schema).select(at, low, F.col(inner[0]).alias(lead), *([] if others is None else [others.alias(rest)]))
    out = df.withColumn(at, _literal_search(key, img, types, coarse)).join(F.broadcast(edges), at)
    found = _search(key, F.col(lead), None if others is None else F.col(rest), max(hi - lo for lo, hi in zip(starts, starts[1:])))
    # not null for the optimizer, which would else put a filter with this search before the next join
    return out.withColumn("_b", F.coalesce(F.col(low) + found, F.lit(0))).drop(at, low, lead, *([] if others is None else [rest]))


def _unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such columns (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


class GlobalOrder:
    """Bucketed global order over ``order_by``. For lags the list must be unique (rows equal
    in all of it share a bucket, so a tie is seen there); null order keys are an error."""

    def __init__(self, df: DataFrame, order_by: list[str] | str, n_buckets: int | None = None,
                 rows_per_bucket: int | None = None):
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        missing = [c for c in self.order_by if c not in df.columns]
        if missing:
            raise ValueError(f"order columns not found: {missing}")
        img = [f"_k{j}" for j in range(len(self.order_by))]
        keys = df.select(*[order_image(df, c).alias(k) for c, k in zip(self.order_by, img)])
        complete = F.lit(True)
        for k in img:
            complete = complete & F.col(k).isNotNull()
        got = keys.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(complete, 1)).alias("ok")).first()
        if got["n"] != got["ok"]:
            raise ValueError(f"{got['n'] - got['ok']} rows have a null in order_by {self.order_by}: filter them first")
        self.n_rows = n = got["n"]
        want = n_buckets or (max(1, math.ceil(n / rows_per_bucket)) if rows_per_bucket else bucket_count(n))
        coarse = want if want <= ONE_LEVEL else min(ONE_LEVEL, math.ceil(math.sqrt(want)))
        self.n_buckets, out = 1, df.withColumn("_b", F.lit(0))
        if want > 1 and n:
            drawn = _drawn(keys, img, SAMPLE_PER_BUCKET * want / n)
            if want > ONE_LEVEL:
                drawn = _written(drawn, "order-sample")
                # of the written sample, the keys for the coarse cuts alone come to the driver
                first = _drawn(drawn, img, SAMPLE_PER_BUCKET * coarse / max(drawn.count(), 1), seed=18)
            else:
                first = drawn
            # equal keys are counted, not repeated: what arrives is bounded by the sample size
            sample = sorted((tuple(r) for r in first.groupBy(*img).agg(F.sum("_n").alias("_n")).collect()), key=_sortable)
            cuts = _cut_points(sample, coarse)
            types = [keys.schema[k].dataType for k in img]
            # the first key is read for every cut: a column of its own
            first, = _unused(df, "_first")
            out = df.withColumn(first, order_image(df, self.order_by[0]))
            key = [F.col(first), *[order_image(df, c) for c in self.order_by[1:]]]
            if want <= ONE_LEVEL:
                out = out.withColumn("_b", F.coalesce(_literal_search(key, img, types, cuts), F.lit(0)))
            else:
                inner = _fine_cuts(drawn.withColumn("_b", _literal_search([F.col(k) for k in img], img, types, cuts)), img, math.ceil(want / coarse))
                upper = cuts
                cuts = sorted({*upper, *(tuple(r) for r in inner.collect())}, key=lambda c: _sortable((*c, 1)))
                out = _two_levels(out, key, img, types, upper, cuts)
            self.n_buckets = len(cuts) + 1
            out = out.drop(first)
        self.bucketed = out
        self.window = Window.partitionBy("_b").orderBy(*[F.col(c).asc() for c in self.order_by])

    def _tie(self) -> Column:
        """1 when the row's full order key equals the previous row's (a duplicate key), else 0.
        Equal keys always share a bucket, so the in-bucket comparison finds every duplicate;
        callers sum it in the aggregate they already run (see :func:`check_unique`)."""
        tie = F.lit(True)
        for c in self.order_by:
            tie = tie & (F.col(c) == F.lag(c).over(self.window))
        return F.coalesce(tie.cast("int"), F.lit(0))

    # ------------------------------------------------------------ lags
    def with_lags(self, cols: list[str], lags: int = 1, inside_of: str | None = None) -> DataFrame:
        """Adds ``_idx`` (1..n, global) and ``{c}_lag{l}`` for l = 1..lags. With ``inside_of``, the first order
        column (a long), lags that leave a row's value of it are undefined: of each bucket only the rows with its last value are
        then sorted for the next one's edge."""
        L = int(lags)
        bd = self.bucketed
        if self.n_buckets * L * max(1, len(cols)) > MAX_EDGE_CELLS:
            raise ValueError("edge table too large; lower n_buckets or lags")
        wdesc = Window.partitionBy("_b").orderBy(*[F.col(c).desc() for c in self.order_by])
        last = F.struct("_rd", *[F.col(c).cast("double").alias(f"_c{j}") for j, c in enumerate(cols)])
        # a limit by row number keeps each task's last rows of a bucket before the shuffle
        sizes = bd.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), *([F.max(inside_of).alias("_last")] if inside_of else [])).collect()
        late = bd
        if inside_of:
            last_value = local_table(bd.sparkSession, [(r["_b"], r["_last"]) for r in sizes], "_b int, _last bigint")
            late = bd.join(F.broadcast(last_value), "_b").where(F.col(inside_of) == F.col("_last"))
        ends = late.withColumn("_rd", F.row_number().over(wdesc)).where(F.col("_rd") <= L).groupBy("_b").agg(F.collect_list(last).alias("tail"))
        tails = {r["_b"]: [list(t[1:]) for t in sorted(r["tail"], key=lambda t: t["_rd"])] for r in ends.collect()}
        counts = sorted((r["_b"], r["n"]) for r in sizes)
        edges = []
        off = 0
        history: list[list] = []  # most recent first, at most L entries
        for bkt, cnt in counts:
            prev = [history[i] if i < len(history) else [None] * len(cols) for i in range(L)]
            edges.append((bkt, off, *[[p[j] for p in prev] for j in range(len(cols))]))
            off += cnt
            history = (tails.get(bkt, []) + history)[:L]
        schema = T.StructType([T.StructField("_b", T.IntegerType()), T.StructField("_off", T.LongType())]
                              + [T.StructField(f"_prev_{j}", T.ArrayType(T.DoubleType())) for j in range(len(cols))])
        edf = local_table(bd.sparkSession, edges, schema)
        # one window pass over narrow rows; the edge arrays join its result and are not sorted
        pairs = [(j, c, lag) for j, c in enumerate(cols) for lag in range(1, L + 1)]
        inside = {f"_in{j}_{lag}": F.lag(F.col(c).cast("double"), lag).over(self.window) for j, c, lag in pairs}
        out = bd.withColumns({"_rn": F.row_number().over(self.window), "_same": self._tie(), **inside}).join(F.broadcast(edf), "_b")
        out = out.withColumns({"_idx": F.col("_off") + F.col("_rn"), "_tie": F.col("_same"), **{
            f"{c}_lag{lag}": F.when(F.col("_rn") > lag, F.col(f"_in{j}_{lag}"))
            .otherwise(F.try_element_at(F.col(f"_prev_{j}"), F.lit(lag) - F.col("_rn") + F.lit(1))) for j, c, lag in pairs}})
        return out.drop("_off", "_rn", "_same", *inside, *[f"_prev_{j}" for j in range(len(cols))])

    # --------------------------------------------------- running sums
    def with_running_sums(self, cols: list[str]) -> DataFrame:
        """Adds ``_idx`` and ``{c}_cum`` = inclusive global prefix sums."""
        bd = self.bucketed
        summ = bd.groupBy("_b").agg(F.count(F.lit(1)).alias("cnt"),
                                    *[F.sum(F.col(c)).alias(f"s{j}") for j, c in enumerate(cols)]).collect()
        rows = sorted(summ, key=lambda r: r["_b"])
        edges = []
        off = 0
        acc = [0.0] * len(cols)
        for r in rows:
            edges.append((r["_b"], off, *acc))
            off += r["cnt"]
            acc = [a + float(r[f"s{j}"] or 0.0) for j, a in enumerate(acc)]
        schema = T.StructType([T.StructField("_b", T.IntegerType()), T.StructField("_off", T.LongType())]
                              + [T.StructField(f"_o{j}", T.DoubleType()) for j in range(len(cols))])
        edf = local_table(bd.sparkSession, edges, schema)
        run = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = bd.join(F.broadcast(edf), "_b")
        out = out.withColumn("_idx", F.col("_off") + F.row_number().over(self.window))
        for j, c in enumerate(cols):
            out = out.withColumn(f"{c}_cum", F.col(f"_o{j}") + F.sum(F.col(c).cast("double")).over(run))
        return out.drop("_off", *[f"_o{j}" for j in range(len(cols))]).withColumn("_tie", self._tie())

    # ------------------------------------------------ as-of neighbours
    def with_neighbors(self, cols: list[str]) -> DataFrame:
        """Adds ``{c}_prev`` / ``{c}_next``: the last non-null value of ``c`` at or
        before the row and the first non-null value at or after it, in the global
        order. One windowed pass; bucket edges come from a per-bucket summary
        (``max_by`` / ``min_by`` over non-null rows) carried across buckets on
        the driver (at most ``n_buckets`` rows), then broadcast.
        """
        bd = self.bucketed
        okey = F.struct(*[F.col(c) for c in self.order_by])
        aggs = []
        for j, c in enumerate(cols):
            v = F.col(c).cast("double")
            aggs += [F.max_by(v, F.when(v.isNotNull(), okey)).alias(f"l{j}"),
                     F.min_by(v, F.when(v.isNotNull(), okey)).alias(f"f{j}")]
        summ = sorted(bd.groupBy("_b").agg(*aggs).collect(), key=lambda r: r["_b"])
        m = len(cols)
        prev_edge: dict = {}
        acc = [None] * m
        for r in summ:
            prev_edge[r["_b"]] = list(acc)
            acc = [r[f"l{j}"] if r[f"l{j}"] is not None else acc[j] for j in range(m)]
        next_edge: dict = {}
        acc = [None] * m
        for r in reversed(summ):
            next_edge[r["_b"]] = list(acc)
            acc = [r[f"f{j}"] if r[f"f{j}"] is not None else acc[j] for j in range(m)]
        rows = [(b, *prev_edge[b], *next_edge[b]) for b in prev_edge]
        schema = T.StructType([T.StructField("_b", T.IntegerType())]
                              + [T.StructField(f"_pe{j}", T.DoubleType()) for j in range(m)]
                              + [T.StructField(f"_ne{j}", T.DoubleType()) for j in range(m)])
        edf = local_table(bd.sparkSession, rows, schema)
        back = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # "next" = growing frame over the reversed order: a shrinking suffix frame
        # (currentRow..unboundedFollowing) is re-aggregated per row (quadratic per bucket)
        fwd = (Window.partitionBy("_b").orderBy(*[F.col(c).desc() for c in self.order_by])
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = bd.join(F.broadcast(edf), "_b")
        for j, c in enumerate(cols):
            v = F.col(c).cast("double")
            out = out.withColumn(f"{c}_prev", F.coalesce(F.last(v, ignorenulls=True).over(back), F.col(f"_pe{j}")))
            out = out.withColumn(f"{c}_next", F.coalesce(F.last(v, ignorenulls=True).over(fwd), F.col(f"_ne{j}")))
        return out.drop(*[f"_pe{j}" for j in range(m)], *[f"_ne{j}" for j in range(m)])


def series_lags(df: DataFrame, series: list[str] | str, order_by: list[str] | str, cols: list[str],
                lags: int = 1, n_buckets: int | None = None) -> DataFrame:
    """Lags inside each series without ``Window.partitionBy(series)``.

    The global order is led by a hash of the series key (then the key itself, then
    ``order_by``), so each series is contiguous; a hot series is split across buckets by
    ``order_by``. Lags that would reach into the
    previous series are null (checked with two independent hashes of the key).
    """
    series = [series] if isinstance(series, str) else list(series)
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = [F.col(c) for c in series]
    d = df.withColumn("_sh", F.xxhash64(*keys)).withColumn("_sh2", F.xxhash64(F.lit(7), *keys).cast("double"))
    go = GlobalOrder(d, ["_sh"] + series + ob, n_buckets)
    out = go.with_lags(list(cols) + ["_sh2"], lags, inside_of="_sh")
    for lag in range(1, lags + 1):
        same = F.col(f"_sh2_lag{lag}") == F.col("_sh2")
        for c in cols:
            out = out.withColumn(f"{c}_lag{lag}", F.when(same, F.col(f"{c}_lag{lag}")))
    return out.drop("_sh", "_sh2", "_tie", *[f"_sh2_lag{lag}" for lag in range(1, lags + 1)])


def bucket_reduce(go: GlobalOrder, window_cols: dict, aggs: list[Column]) -> list:
    """Windowed columns inside each bucket, then one grouped aggregate per bucket;
    returns the per-bucket rows sorted by bucket (at most ``n_buckets`` rows) for the
    caller to stitch with bucket offsets. Saves the separate summary pass and the
    broadcast join of :meth:`GlobalOrder.with_running_sums` when only totals are needed."""
    d = go.bucketed
    for name, expr in window_cols.items():
        d = d.withColumn(name, expr)
    return sorted(d.groupBy("_b").agg(*aggs).collect(), key=lambda r: r["_b"])


def series_running_sums(df: DataFrame, series: list[str] | str, order_by: list[str] | str, col: str,
                        n_buckets: int | None = None) -> DataFrame:
    """Running sum of ``col`` inside each series, on the series-led global order (a hot series
    is split across buckets): global prefix minus the prefix just before the series starts."""
    series = [series] if isinstance(series, str) else list(series)
    ob = [order_by] if isinstance(order_by, str) else list(order_by)
    d = df.withColumn("_sh", F.xxhash64(*[F.col(c) for c in series]))
    go = GlobalOrder(d, ["_sh"] + series + ob, n_buckets)
    cum = go.with_running_sums([col])
    start = cum.groupBy(*series).agg(F.min_by(F.col(f"{col}_cum") - F.col(col).cast("double"), F.col("_idx"))
                                     .alias("_before"))
    return (cum.join(start, series).withColumn(f"{col}_scum", F.col(f"{col}_cum") - F.col("_before"))
            .drop("_before", "_sh", "_tie", f"{col}_cum"))


def check_unique(ties: int | None, order_by) -> None:
    """Raise when an order used for lags has duplicate keys (results would depend on tie order)."""
    if ties:
        raise ValueError(f"order_by {list(order_by)} has {ties} duplicate keys: add a tie-break column so the "
                         "order is unique")
