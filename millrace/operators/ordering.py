"""Sorting, top-k, order statistics, search, batches and ranks.

DataFrames have no order, so every operator takes its order column and a tiebreak.
Global positions are found in two passes: split points from an approximate quantile (a
fixed number) deal values into ranges, the ranges' counts give offsets, and positions
are numbered inside each range. No window runs over all rows in one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ColumnLike, col, valid

#: Value ranges that a column is dealt into for global positions.
RANGES = 64
#: Query rows of a nearest search that are broadcast at a time, about.
QUERY_BLOCK = 5000


def buckets_of(df: DataFrame, c: str, n: int = RANGES) -> list[float]:
    """At most n - 1 distinct split points of a numeric column's valid values."""
    if n < 2:
        return []
    points = df.agg(F.percentile_approx(valid(c), [i / n for i in range(1, n)], 10_000)).first()[0] or []
    return sorted(set(points))


def with_bucket(c: ColumnLike, points: list[float]) -> Column:
    """How many split points lie below the value: equal values share a bucket."""
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p < col(c)))


def _offsets(rows: DataFrame, bucket: str = "_b") -> dict[int, int]:
    counts = {r[0]: r[1] for r in rows.groupBy(bucket).count().collect()}  # at most RANGES rows
    keys = sorted(counts)
    return dict(zip(keys, accumulate((counts[k] for k in keys), initial=0)))


def _offset_column(offsets: dict[int, int], bucket: str = "_b") -> Column:
    if not offsets:
        return F.lit(0).cast("long")
    pairs = [x for k, v in offsets.items() for x in (F.lit(k), F.lit(v).cast("long"))]
    return F.element_at(F.create_map(*pairs), F.col(bucket))


def with_position(df: DataFrame, c: str, tiebreak: str, descending: bool = False, out: str = "position") -> DataFrame:
    """Adds the 0-based global position by value and tiebreak; missing values come last."""
    key = (-valid(c)) if descending else valid(c)
    df = df.withColumn("_x", F.coalesce(key, F.lit(float("inf"))))
    df = df.withColumn("_b", with_bucket("_x", buckets_of(df, "_x")))
    w = Window.partitionBy("_b").orderBy(F.col("_x"), valid(c).isNull(), F.col(tiebreak))
    return df.withColumn(out, F.row_number().over(w) - 1 + _offset_column(_offsets(df))).drop("_x", "_b")


def order_statistics(df: DataFrame, c: str, ks: list[int]) -> dict[int, float]:
    """The k-th smallest valid values (0-based), all in one pass over the ranges that hold one.

    Equal values are counted before they are ordered, so that a frequent one is one row.
    """
    rows = df.select(valid(c).alias("_x")).where("_x IS NOT NULL")
    rows = rows.withColumn("_b", with_bucket("_x", buckets_of(rows, "_x")))
    counts = dict(sorted((r[0], r[1]) for r in rows.groupBy("_b").count().collect()))  # at most RANGES rows
    start = dict(zip(counts, accumulate(counts.values(), initial=0)))
    held = {}
    for k in ks:
        if not 0 <= k < sum(counts.values()):
            raise ValueError(f"no value at {k}")
        held[k] = max(b for b, at in start.items() if at <= k)
    distinct = rows.where(F.col("_b").isin(*set(held.values()))).groupBy("_b", "_x").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    placed = distinct.withColumn("_to", upto)
    inside = [(F.col("_b") == b) & (F.col("_to") > k - start[b]) & (F.col("_to") - F.col("_n") <= k - start[b]) for k, b in held.items()]
    found = placed.where(reduce(Column.__or__, inside)).collect() if inside else []  # a row for each k at most
    return {k: next(r["_x"] for r in found if r["_b"] == b and r["_to"] - r["_n"] <= k - start[b] < r["_to"]) for k, b in held.items()}


def quickselect(df: DataFrame, c: str, k: int) -> float:
    """The k-th smallest value, 0-based."""
    if not isinstance(k, int) or isinstance(k, bool):
        raise TypeError("k is an integer")
    return order_statistics(df, c, [k])[k]


def sort_values(df: DataFrame, c: str, tiebreak: str | None = None) -> DataFrame:
    """Ascending, NaN greatest."""
    return df.orderBy(c, *([tiebreak] if tiebreak else []))


def sort_within(arr: ColumnLike) -> Column:
    """Each packed row sorted on its own."""
    return F.array_sort(col(arr))


def sort_columns(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Every column sorted independently: row i holds each column's i-th smallest."""
    parts = [with_position(df.select(row_id, c), c, row_id, out="position").select("position", c) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "position")
    return out


def effective_directions(ascending: list[bool], compat: bool) -> list[bool]:
    """compat: a descending key also turns round every key after it and the tiebreak (prefix parity)."""
    if not compat:
        return list(ascending)
    return [not odd for odd in accumulate((not a for a in ascending), lambda x, y: x ^ y)]


def sort_rows(df: DataFrame, keys: list[str | int] | None = None, ascending: bool | list[bool] = True, row_id: str | None = None, compat: bool = False) -> DataFrame:
    """Whole rows by key columns; keys are names or positions, negative ones from the end."""
    names = df.columns if keys is None else keys
    if not names:
        raise ValueError("at least one key")
    try:
        names = [df.columns[k] if isinstance(k, int) else k for k in names]
    except IndexError as e:
        raise ValueError("key out of range") from e
    flags = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if any(not isinstance(a, bool) for a in flags):
        raise TypeError("ascending holds booleans")
    if len(flags) != len(names):
        raise ValueError("one flag for each key")
    last = True
    if compat:
        flags = effective_directions(flags, True)
        last = flags[-1]
    order = [F.col(n).asc() if a else F.col(n).desc() for n, a in zip(names, flags)]
    if row_id:
        order.append(F.col(row_id).asc() if last else F.col(row_id).desc())
    return df.orderBy(*order)


multi_key_sort = sort_rows


def topk(df: DataFrame, c: str, k: int, largest: bool = True, tiebreak: str | None = None, by: str | list[str] | None = None) -> DataFrame:
    """The k largest or smallest rows (NaN is the largest value), of all rows or of each group."""
    if not isinstance(k, int) or isinstance(k, bool):
        raise TypeError("k is an integer")
    if k < 1:
        raise ValueError("k is at least 1")
    order = [F.col(c).desc() if largest else F.col(c).asc(), *([F.col(tiebreak)] if tiebreak else [])]
    if by is None:
        return df.orderBy(*order).limit(k)
    keys = [by] if isinstance(by, str) else by
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


top_k = topk


def topk_indices(df: DataFrame, c: str, k: int, row_id: str, largest: bool = True) -> DataFrame:
    """The row ids of the k largest or smallest values, in their order."""
    return topk(df, c, k, largest, row_id).select(row_id)


def topk_values(df: DataFrame, c: str, k: int, largest: bool = True) -> DataFrame:
    """The k largest or smallest values, in their order."""
    return topk(df.select(c), c, k, largest)


def search_sorted(values: DataFrame, c: str, probes: DataFrame, probe: str) -> DataFrame:
    """(probe, idx, found): left insertion point of each probe among the values and whether one equals it.

    Values are counted by range; a probe adds its range's offset to the smaller values of
    its own range, found by a running sum over the union of both, range by range.
    """
    v = values.select(valid(c).alias("_x")).where("_x IS NOT NULL")
    points = buckets_of(v, "_x")
    v = v.groupBy("_x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", with_bucket("_x", points))
    offsets = {r[0]: r[1] for r in v.groupBy("_b").agg(F.sum("_n")).collect()}
    keys = list(range(len(points) + 1))
    before = dict(zip(keys, accumulate((offsets.get(k, 0) for k in keys), initial=0)))
    p = probes.select(F.col(probe).cast("double").alias("_x")).distinct().select("_x", F.lit(0).cast("long").alias("_n"), with_bucket("_x", points).alias("_b"), F.lit(True).alias("_probe"))
    both = v.select("_x", "_n", "_b", F.lit(False).alias("_probe")).unionByName(p)
    w = Window.partitionBy("_b").orderBy("_x", F.desc("_probe")).rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("_b", "_x")
    both = both.select("_x", "_probe", (F.sum("_n").over(w) + _offset_column(before)).cast("long").alias("idx"), (F.sum("_n").over(same) > 0).alias("found"))
    return both.where("_probe").select(F.col("_x").alias(probe), "idx", "found")


def make_batches(df: DataFrame, batch_size: int, order: str, drop_last: bool = False, shuffle: bool = False, seed: int = 0, out: str = "batch") -> DataFrame:
    """Adds a batch number to consecutive rows by order, or by a seeded hash of it."""
    if not isinstance(batch_size, int) or batch_size < 1:
        raise ValueError("batch_size is a positive integer")
    if shuffle:
        df = df.withColumn("_h", F.xxhash64(F.col(order), F.lit(seed)).cast("double"))
        df = with_position(df, "_h", order, out="_p").drop("_h")
    else:
        df = with_position(df, order, order, out="_p")
    df = df.withColumn(out, F.floor(F.col("_p") / batch_size).cast("long")).drop("_p")
    if drop_last:
        full = df.groupBy(out).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == batch_size).select(out)
        df = df.join(full, out, "left_semi")
    return df


def rank(df: DataFrame, c: str, row_id: str, method: str = "average", out: str = "rank") -> DataFrame:
    """Adds the 1-based rank of valid values; missing values get NaN and are not counted.

    Ties share a value range, so ranks inside a range plus its offset are the global ones.
    """
    if method not in ("average", "dense", "ordinal"):
        raise ValueError("method is average, dense or ordinal")
    df = df.withColumn("_x", valid(c))
    ok = df.where("_x IS NOT NULL")
    points = buckets_of(ok, "_x")
    ok = ok.withColumn("_b", with_bucket("_x", points))
    if method == "dense":
        offsets = _offsets(ok.select("_b", "_x").distinct())
    else:
        offsets = _offsets(ok)
    w = Window.partitionBy("_b").orderBy("_x")
    if method == "ordinal":
        r = F.row_number().over(Window.partitionBy("_b").orderBy("_x", row_id))
    elif method == "dense":
        r = F.dense_rank().over(w)
    else:
        r = F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("_b", "_x")) - 1) / 2
    ranked = ok.withColumn(out, (r + _offset_column(offsets)).cast("double")).drop("_x", "_b")
    missing = df.where("_x IS NULL").withColumn(out, F.lit(float("nan"))).drop("_x")
    return ranked.unionByName(missing)


def pairwise_nearest(queries: DataFrame, points: DataFrame, distance, k: int, query_id: str, point_id: str) -> DataFrame:
    """The k nearest points of each query row; any number of query rows, compared in blocks.

    Blocks are cut by a hash of the query id, about QUERY_BLOCK rows each, and broadcast one
    by one; rows of equal id share a block. Within a task only the k best of a query leave it.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    w = Window.partitionBy(query_id).orderBy("distance", point_id)

    def best(q: DataFrame) -> DataFrame:
        pairs = points.join(F.broadcast(q), F.lit(True)).withColumn("distance", distance)
        return pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select(query_id, point_id, "distance", F.col("_rn").cast("long").alias("nearest"))

    if blocks == 1:
        return best(queries)
    of = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, [best(queries.where(of == b)) for b in range(blocks)])
