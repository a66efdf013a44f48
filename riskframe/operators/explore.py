"""Exploratory aggregates on the raw training rows (AGG3, AGG9-20, JOIN3,
PRJ11, PRJ12, PRJ15, FLT1-4).

Each function takes column names, returns a lazy DataFrame where possible,
and does its heavy work as map-side-combined aggregates; only results with a
proven small size are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from riskframe.functions.columns import label_text, rate, round_even, sig, unpivot
from riskframe.functions.joins import small_frame
from riskframe.operators.comoments import co_moments, named_pairs
from riskframe.operators.quantiles import exact_quantiles

MAX_GROUPS_BROADCAST = 10_000
MAX_PREDICATES = 64
# Order of a bin's expansion in kde_density.
KDE_ORDER = 6


def target_distribution(df: DataFrame, label: str) -> DataFrame:
    """Value counts of the label with label text and share of all rows
    (AGG3, PRJ11, PRJ12)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the aggregated result (one row per class)
    total = F.sum("n").over(Window.partitionBy())
    return (counts.select(label, label_text(label).alias("label"), "n",
                          (F.col("n").cast("double") / total * 100).alias("pct"))
            .orderBy(F.desc("n"), label))


def rate_by_category(df: DataFrame, category: str, label: str) -> DataFrame:
    """Event rate (percent) and size per category, NULL keys dropped like
    pandas ``groupby``; highest rate first (AGG11, SRT3)."""
    return (df.where(F.col(category).isNotNull())
            .groupBy(category)
            .agg((F.avg(F.col(label).cast("double")) * 100).alias("default_rate_pct"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("default_rate_pct"), category))


def rate_in_fixed_order(df: DataFrame, category: str, label: str, order: list[str]) -> DataFrame:
    """Event rate per category aligned to a fixed category list; categories
    absent from the data give NULL (AGG12, JOIN3, SRT5)."""
    spark = df.sparkSession
    order_df = spark.createDataFrame(list(enumerate(order, start=1)),
                                     T.StructType([T.StructField("ord", T.IntegerType(), False),
                                                   T.StructField(category, T.StringType(), False)]))
    # only the listed categories can match: at most len(order) rate rows,
    # a proven-small build side for the outer join that keeps every listed one
    rates = rate_by_category(df.where(F.col(category).isin(order)), category, label)
    return (order_df.join(F.broadcast(rates), category, "left")
            .select("ord", category, "default_rate_pct", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy("ord"))


def rate_by_small_int(df: DataFrame, column: str, label: str, cap: int) -> DataFrame:
    """Event rate per integer value up to ``cap``, key order (FLT3, AGG13, SRT4)."""
    return (df.where(F.col(column) <= cap)
            .groupBy(column)
            .agg((F.avg(F.col(label).cast("double")) * 100).alias("default_rate_pct"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(column))


def pivot_counts(df: DataFrame, group: str, label: str, classes=(0, 1)) -> DataFrame:
    """Counts per (group, class) pivoted to one column per class, zero-filled,
    with total and event rate to 2 decimals (AGG14, AGG15, SRT4)."""
    names = {0: "n_no_default", 1: "n_default"}
    piv = (df.where(F.col(group).isNotNull())
           .groupBy(group).pivot(label, list(classes)).agg(F.count(F.lit(1))))
    for c in classes:
        piv = piv.withColumnRenamed(str(c), names.get(c, f"n_{c}"))
    cols = [names.get(c, f"n_{c}") for c in classes]
    piv = piv.na.fill(0, subset=cols)
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return (piv.withColumn("total", total)
            .withColumn("default_rate_pct", round_even(rate(F.col(names[1]), F.col("total")) * 100, 2))
            .orderBy(group))


def sentinel_counts(df: DataFrame, column: str, sentinel) -> DataFrame:
    """Rows equal to the sentinel vs all others (NULL counts as "normal", as
    pandas ``!=`` does), with shares of all rows (AGG16, PRJ12)."""
    is_s = F.col(column).eqNullSafe(F.lit(sentinel))
    agg = df.agg(F.sum(F.when(is_s, 1).otherwise(0)).alias("n_sentinel"),
                 F.sum(F.when(~is_s, 1).otherwise(0)).alias("n_normal"),
                 F.count(F.lit(1)).alias("n_rows"))
    return agg.select(
        F.coalesce("n_sentinel", F.lit(0)).cast("bigint").alias("n_sentinel"),
        F.coalesce("n_normal", F.lit(0)).cast("bigint").alias("n_normal"),
        "n_rows",
        (rate(F.col("n_sentinel"), F.col("n_rows")) * 100).alias("pct_sentinel"),
        (rate(F.col("n_normal"), F.col("n_rows")) * 100).alias("pct_normal"))


def equal_width_histogram(df: DataFrame, value: F.Column, by: str, bins: int) -> DataFrame:
    """Equal-width histogram per group with edges from the group's own min and
    max, last bin closed, empty bins present (AGG17).

    Output: (by, bin, bin_lo, bin_hi, n)."""
    x = df.select(F.col(by), value.cast("double").alias("x")).where(F.col("x").isNotNull())
    stats = (x.groupBy(by).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"))
             .select(by,
                     F.when(F.col("xmin") == F.col("xmax"), F.col("xmin") - 0.5)
                     .otherwise(F.col("xmin")).alias("lo"),
                     F.when(F.col("xmin") == F.col("xmax"), F.col("xmax") + 0.5)
                     .otherwise(F.col("xmax")).alias("hi")))
    stats_b = F.broadcast(small_frame(stats, MAX_GROUPS_BROADCAST))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    b = F.least(F.floor((F.col("x") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                F.lit(bins - 1)).cast("int")
    counts = x.join(stats_b, by).groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = stats_b.select(by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, [by, "bin"], "left")
            .select(by, "bin",
                    (F.col("bin") * width + F.col("lo")).alias("bin_lo"),
                    F.when(F.col("bin") == bins - 1, F.col("hi"))
                    .otherwise((F.col("bin") + 1) * width + F.col("lo")).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
            .orderBy(by, "bin"))


def box_summary(df: DataFrame, value: str, by: str, factor: float = 1.5) -> DataFrame:
    """Box-plot statistics per group: quartiles (exact, interpolated),
    whiskers at the furthest points inside Q1 - f*IQR / Q3 + f*IQR, outlier
    count (AGG10)."""
    q = exact_quantiles(df.where(F.col(by).isNotNull()), [value], [0.25, 0.5, 0.75], by=[by])
    spark = df.sparkSession
    rows = [(k[0], v[0.25], v[0.5], v[0.75]) for k, v in q.items()]
    key_type = df.schema[by].dataType
    qdf = spark.createDataFrame(rows, T.StructType([
        T.StructField(by, key_type), T.StructField("q1", T.DoubleType()),
        T.StructField("median", T.DoubleType()), T.StructField("q3", T.DoubleType())]))
    qdf = (qdf.withColumn("iqr", F.col("q3") - F.col("q1"))
           .withColumn("fence_lo", F.col("q1") - F.lit(factor) * F.col("iqr"))
           .withColumn("fence_hi", F.col("q3") + F.lit(factor) * F.col("iqr")))
    x = F.col(value).cast("double")
    inside = (x >= F.col("fence_lo")) & (x <= F.col("fence_hi"))
    # One row per group from collected quantiles: bounded by the group count.
    agg = (df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
           .join(F.broadcast(qdf), by)
           .groupBy(by)
           .agg(F.count(F.lit(1)).alias("n"),
                F.min(F.when(inside, x)).alias("whisker_lo"),
                F.max(F.when(inside, x)).alias("whisker_hi"),
                F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers")))
    return F.broadcast(qdf).join(agg, by).select(by, "n", "q1", "median", "q3", "iqr", "whisker_lo",
                                   "whisker_hi", "n_outliers")


def box_outliers(df: DataFrame, value: str, by: str, factor: float = 1.5) -> DataFrame:
    """The rows outside their group's box-plot fences, with ``side`` below or
    above (AGG10). The fences become one range predicate for each group, which
    reaches the scan; with more than ``MAX_PREDICATES`` groups they are joined."""
    q = exact_quantiles(df.where(F.col(by).isNotNull()), [value], [0.25, 0.75], by=[by])
    fences = [(k[0], v[0.25] - factor * (v[0.75] - v[0.25]), v[0.75] + factor * (v[0.75] - v[0.25])) for k, v in q.items()]
    x = F.col(value)
    if len(fences) > MAX_PREDICATES:
        table = df.sparkSession.createDataFrame(fences, T.StructType([
            T.StructField("_by", df.schema[by].dataType), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())]))
        joined = df.join(table, F.col(by) == F.col("_by")).where((x < F.col("_lo")) | (x > F.col("_hi")))
        return joined.withColumn("side", F.when(x < F.col("_lo"), "below").otherwise("above")).drop("_by", "_lo", "_hi")
    outside, below = F.lit(False), F.lit(False)
    for group, lo, hi in fences:
        mine = F.col(by) == F.lit(group)
        outside = outside | (mine & ((x < F.lit(lo)) | (x > F.lit(hi))))
        below = below | (mine & (x < F.lit(lo)))
    return df.where(outside).withColumn("side", F.when(below, "below").otherwise("above"))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair (i > j, lower triangle), pairwise
    complete; NULL for a constant column (AGG18, PRJ15).

    One pass of mergeable co-moments (``comoments``); ``corr`` itself would
    raise on a constant column under ANSI mode, hence ``try_divide``.
    """
    m = named_pairs(co_moments(df, columns), columns).where("i > j")
    return m.select("col_a", "col_b", "n", F.try_divide(F.col("c"), F.sqrt(F.col("m2_a") * F.col("m2_b"))).alias("corr"))


def p_quantile_filter(df: DataFrame, column: str, p: float) -> tuple[DataFrame, float | None]:
    """Rows strictly below the column's p-quantile (NULLs dropped) (FLT2, AGG9)."""
    q = exact_quantiles(df, [column], [p])
    v = q.get((column,), {}).get(p)
    if v is None:
        return df.limit(0), None
    return df.where(F.col(column) < F.lit(v)), v


def kde_density(df: DataFrame, columns: list[str], by: str, grid_points: int = 100, cut: float = 2.0,
                bins_per_bandwidth: int = 64) -> DataFrame:
    """Gaussian KDE per (column, group) on a grid, Scott bandwidth, as a
    violin plot uses it (AGG19).

    Bandwidth ``h = std_samp * n^(-1/5)``; grid: ``grid_points`` points from
    ``min - cut*h`` to ``max + cut*h``. Rows are first reduced to bins of width
    ``h / bins_per_bandwidth``, each with its count, mean and central moments of
    orders 2 to 6, and a bin's kernel sum is expanded about its mean to order 6.
    So the grid evaluation costs bins x grid, not rows x grid; the bin count
    grows like ``n^(1/5)``.

    Error: no deviation from a bin's mean exceeds ``d = 1 / bins_per_bandwidth``
    bandwidths, and no 7th derivative of ``exp(-z*z/2)`` exceeds 36, so the
    kernel of a row is off by at most ``36 * d^7 / 5040``: with 64 bins a
    bandwidth, 1.7e-15 of a kernel's peak, whatever the data and their number.
    All columns go through one statistics job and one binning pass, in which a
    bin's moments come from power sums about its lower edge, in bandwidths.
    Output: (column_name, by, grid_index, x, density).
    """
    items = [(c, F.col(c).cast("double")) for c in columns]
    base = (unpivot(df, [by], items, ["column_name", "x"])
            .where(F.col(by).isNotNull() & F.col("x").isNotNull()))
    keys = ["column_name", by]
    stats = (base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                                     F.min("x").alias("xmin"), F.max("x").alias("xmax"))
             .where(F.col("n") >= 2)
             .withColumn("h", scott_bandwidth(F.col("n"), F.col("sd")))
             .where(F.col("h") > 0))
    stats = stats.withColumn("w", F.col("h") / F.lit(float(bins_per_bandwidth)))
    stats_b = F.broadcast(small_frame(stats, MAX_GROUPS_BROADCAST))
    # position in bins: whole part and rest; the rest, in (0, 1), is exact
    at = (F.col("x") - F.col("xmin")) / F.col("w")
    rows = (base.join(stats_b.select(*keys, "xmin", "w", "h"), keys)
            .withColumn("at", at).withColumn("bin", F.floor("at"))
            .withColumn("r", F.col("at") - F.col("bin")))
    binned = rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("c"), F.first("xmin").alias("xmin"), F.first("w").alias("w"),
        *[F.avg(_power(F.col("r"), k)).alias(f"r{k}") for k in range(1, KDE_ORDER + 1)])
    # central moments by the binomial theorem, in bandwidths
    step = 1.0 / bins_per_bandwidth
    mean = F.col("r1")
    raw = [F.lit(1.0)] + [F.col(f"r{k}") for k in range(1, KDE_ORDER + 1)]
    central = {j: sum((math.comb(j, k) * (-1.0) ** (j - k) * raw[k] * _power(mean, j - k) for k in range(j + 1)), F.lit(0.0))
               * step ** j for j in range(2, KDE_ORDER + 1)}
    binned = binned.select(*keys, "c", (F.col("xmin") + F.col("w") * (F.col("bin") + mean)).alias("m"),
                           *[m.alias(f"m{j}") for j, m in central.items()])
    lo = F.col("xmin") - F.lit(cut) * F.col("h")
    hi = F.col("xmax") + F.lit(cut) * F.col("h")
    grid = stats_b.select(
        *keys, "n", "h", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("grid_index"),
        lo.alias("lo"), hi.alias("hi"))
    grid = grid.withColumn(
        "gx", F.col("grid_index") * ((F.col("hi") - F.col("lo")) / F.lit(grid_points - 1)) + F.col("lo"))
    z = (F.col("gx") - F.col("m")) / F.col("h")
    # grid is groups x grid_points rows: bounded, broadcast as the build side.
    dens = (binned.join(F.broadcast(grid.select(*keys, "grid_index", "gx", "n", "h")), keys)
            .groupBy(*keys, "grid_index", "gx", "n", "h")
            .agg(F.sum(F.col("c") * F.exp(-0.5 * z * z) * _kernel_factor(z)).alias("s")))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    return dens.select(*keys, "grid_index", F.col("gx").alias("x"), (F.col("s") / norm).alias("density"))


def _power(x: F.Column, k: int) -> F.Column:
    """``x`` to a small whole power, by products."""
    out = F.lit(1.0)
    for _ in range(k):
        out = out * x
    return out


def _kernel_factor(z: F.Column) -> F.Column:
    """Mean of ``exp(-(z - t)^2 / 2) / exp(-z^2 / 2)`` over a bin with central
    moments ``m2``, ``m3``, ... of ``t``: the sum of ``He_j(z) m_j / j!`` over the
    Hermite polynomials (``He_{j+1} = z He_j - j He_{j-1}``)."""
    before, now = F.lit(1.0), z
    total = F.lit(1.0)  # the first moment about the mean is 0
    for j in range(2, KDE_ORDER + 1):
        before, now = now, z * now - (j - 1) * before
        total = total + now * F.col(f"m{j}") / math.factorial(j)
    return total


def scott_bandwidth(n: F.Column, sd: F.Column) -> F.Column:
    """Scott's rule for one dimension, ``std_samp * n^(-1/5)``, kept to 9
    significant digits so every engine bins with the same width."""
    return sig(sd * F.pow(n.cast("double"), F.lit(-0.2)), 9)


def violin_summary(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Per (column, group): size, quartiles, min, max and KDE bandwidth of
    the complete (value, group) pairs, with label text (FLT4, PRJ11, AGG19)."""
    spark = df.sparkSession
    items = [(c, F.col(c).cast("double")) for c in columns]
    long = (unpivot(df, [by], items, ["column_name", "v"])
            .where(F.col("v").isNotNull() & F.col(by).isNotNull()))
    stats = long.groupBy("column_name", by).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.stddev_samp("v").alias("sd"))
    q = exact_quantiles(df.where(F.col(by).isNotNull()), columns, [0.25, 0.5, 0.75], by=[by])
    qdf = spark.createDataFrame(
        [(k[1], k[0], v[0.25], v[0.5], v[0.75]) for k, v in q.items()],
        T.StructType([T.StructField("column_name", T.StringType()),
                      T.StructField(by, df.schema[by].dataType),
                      T.StructField("q1", T.DoubleType()), T.StructField("median", T.DoubleType()),
                      T.StructField("q3", T.DoubleType())]))
    # qdf holds one row per (column, group) built on the driver: broadcast it
    return (stats.join(F.broadcast(qdf), ["column_name", by])
            .select("column_name", by, label_text(by).alias("label"), "n", "q1", "median", "q3",
                    "vmin", "vmax", scott_bandwidth(F.col("n"), F.col("sd")).alias("bandwidth")))
