"""Exact quantiles (linear interpolation, NULL/NaN skipped), selected on the
executors in two passes over the rows.

Spark's exact ``percentile`` keeps a map of every distinct value of a group
and merges it in one task; on a continuous column of a large table that is
the whole column. Here:

* pass 1 builds one mergeable sketch for each group and column
  (``percentile_approx``, whose answers are at most ``n / ACCURACY`` ranks
  off) and reads from it a bracket around every wanted probability. One
  bracket serves both neighbouring ranks of an interpolated quantile. Groups
  with fewer than ``4 * ACCURACY`` values are their own bracket;
* pass 2 counts the values inside the brackets one by one and all other
  values by the gap between brackets they fall in, combined map-side: a
  value repeated in a third of all rows is one counted row.

The counted rows are range-partitioned in value order. The partitions' sums,
added up in order, tell which partition holds a wanted rank; a running sum
inside that partition alone finds it. So no task holds a group's values, and
the driver gets the wanted order statistics and nothing else. A rank that falls
outside every bracket (the counts are exact, the sketch need not be) is searched
once more over all values of its group.

Infinities are ordinary values here: they sort first and last and are counted
like any other.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import unpivot
from riskframe.functions.joins import bounded_broadcast
from riskframe.session import materialize

#: A sketch's answer is at most n / ACCURACY ranks off.
ACCURACY = 10_000
#: Half width of a bracket, in sketch errors.
MARGIN = 2.0
#: Brackets or hits up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def _valid(c: str) -> Column:
    """The column as double; NaN is missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _interp(a: float, b: float, t: float) -> float:
    """Linear interpolation as NumPy/pandas compute it."""
    if t == 0.0 or a == b:
        return a
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def quantile_ranks(n: int, p: float) -> tuple[int, int, float]:
    pos = p * (n - 1)
    lo = math.floor(pos)
    return lo, min(lo + 1, n - 1), pos - lo


def _brackets(df: DataFrame, columns: list[str], probs: list[float], keys: list[str]) -> DataFrame:
    """(keys..., cid, n, l0, u0, l1, u1, ...) with one row for each group and
    column that has values: the bracket of every probability."""
    half = MARGIN / ACCURACY
    asked = [min(1.0, max(0.0, p + side)) for p in probs for side in (-half, half)]
    x = df.select(*keys, *[_valid(c).alias(f"x{i}") for i, c in enumerate(columns)])
    aggs = [a for i in range(len(columns)) for a in (
        F.count(f"x{i}").alias(f"n{i}"), F.percentile_approx(f"x{i}", asked, ACCURACY).alias(f"q{i}"))]
    # the aggregate has one row for each group; its columns become rows only here
    wide = x.groupBy(*keys).agg(*aggs)
    long = unpivot(wide, keys, [(i, F.col(f"n{i}"), F.col(f"q{i}")) for i in range(len(columns))], ["cid", "n", "q"])
    small = F.col("n") < 4 * ACCURACY
    bounds = []
    for j in range(len(probs)):
        bounds += [F.when(small, F.lit(-math.inf)).otherwise(F.col("q")[2 * j]).alias(f"l{j}"),
                   F.when(small, F.lit(math.inf)).otherwise(F.col("q")[2 * j + 1]).alias(f"u{j}")]
    return long.where(F.col("n") > 0).select(*keys, "cid", "n", *bounds)


def _same(keys: list[str]) -> Column:
    """Null-safe equality of the keys with those of a ``_keyed`` side."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cond


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its key columns renamed, for a null-safe join."""
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def _counted(df: DataFrame, columns: list[str], brackets: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys..., cid, v, gap, c, pid): the values inside brackets with their
    counts, and (gap = 1) the counts between brackets at the bracket end
    below; in value order over the partitions ``pid``."""
    group = [*keys, "cid"]
    long = unpivot(df, keys, [(i, _valid(c)) for i, c in enumerate(columns)], ["cid", "x"]).where(F.col("x").isNotNull())
    rows = long.join(bounded_broadcast(_keyed(brackets, group), BROADCAST_ROWS), _same(group))
    x, inside, below = F.col("x"), F.lit(False), [F.lit(None).cast("double")] * 2
    for j in range(k):
        inside = inside | ((x >= F.col(f"l{j}")) & (x <= F.col(f"u{j}")))
        below.append(F.when(F.col(f"u{j}") < x, F.col(f"u{j}")))
    counted = rows.groupBy(*group, F.when(inside, x).otherwise(F.greatest(*below)).alias("v"),
                           F.when(inside, 0).otherwise(1).alias("gap")).agg(F.count(F.lit(1)).alias("c"))
    ordered = counted.repartitionByRange(*group, F.col("v").asc_nulls_first(), "gap")
    return materialize(ordered.withColumn("pid", F.spark_partition_id()), "quantile-counts")


def _selected(counted: DataFrame, brackets: DataFrame, probs: list[float], keys: list[str]) -> DataFrame:
    """(keys..., cid, n, rank, v, gap) of every wanted rank."""
    group = [*keys, "cid"]
    ranks = []
    for p in probs:
        lo = F.floor(F.lit(p) * (F.col("n") - 1))
        ranks += [lo, F.least(lo + 1, F.col("n") - 1)]
    wanted = brackets.select(*group, "n", F.explode(F.array_distinct(F.array(*ranks))).alias("rank"))
    # sums of the partitions in value order: as many rows as groups and partitions
    in_order = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*group, "pid").agg(F.sum("c").alias("s"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(in_order), F.lit(0)))
    other = _keyed(wanted, group)
    hits = sums.join(other, _same(group)).where("before <= rank AND rank < before + s")
    hits = materialize(hits.select(*group, "pid", "before", "n", "rank"), "quantile-hits")
    # a partition of counted rows is numbered once for each rank that it holds
    asked = _keyed(hits, [*group, "pid"])
    held = counted.join(bounded_broadcast(asked, BROADCAST_ROWS), _same([*group, "pid"]))
    inside = Window.partitionBy(*group, "pid", "rank").orderBy(F.col("v").asc_nulls_first(), "gap")
    held = held.withColumn("upto", F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return (held.where("before + upto - c <= rank AND rank < before + upto")
            .select(*group, "n", "rank", "v", "gap"))


def order_statistics(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None):
    """The exact order statistics next to each probability.

    Returns ``(sizes, values)``: ``sizes[(by..., cid)] = n`` and
    ``values[(by..., cid)][rank] = value`` for both ranks of ``quantile_ranks``.
    """
    by, probs = list(by or []), sorted(set(probs))
    if not columns or not probs:
        return {}, {}
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *columns)
    brackets = materialize(_brackets(rows, columns, probs, keys), "quantile-brackets")
    sizes: dict[tuple, int] = {}
    values: dict[tuple, dict[int, float]] = defaultdict(dict)
    while True:
        counted = _counted(rows, columns, brackets, keys, len(probs))
        missed = []
        for r in _selected(counted, brackets, probs, keys).collect():
            group = tuple(r[k] for k in keys) + (r["cid"],)
            sizes[group] = r["n"]
            if r["gap"]:
                missed.append(group)
            else:
                values[group][r["rank"]] = r["v"]
        if not missed:
            return sizes, values
        everything = [F.lit(-math.inf if side == "l" else math.inf).alias(f"{side}{j}")
                      for j in range(len(probs)) for side in ("l", "u")]
        redo = df.sparkSession.createDataFrame(
            sorted(set(missed), key=repr), brackets.select(*keys, "cid").schema)
        other = _keyed(redo, [*keys, "cid"])
        brackets = brackets.join(other, _same([*keys, "cid"]), "left_semi").select(*keys, "cid", "n", *everything)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    by: list[str] | None = None) -> dict[tuple, dict[float, float | None]]:
    """Exact linear-interpolated quantiles of each column (per group).

    Returns ``{(by..., column_name): {p: value}}``; groups where a column has
    no values are absent.
    """
    sizes, values = order_statistics(df, columns, probs, by)
    result: dict[tuple, dict[float, float | None]] = {}
    for key, n in sizes.items():
        stats = values[key]
        out = {}
        for p in probs:
            lo, hi, frac = quantile_ranks(n, p)
            out[p] = _interp(stats[lo], stats[hi], frac)
        result[key[:-1] + (columns[key[-1]],)] = out
    return result
