"""Stratified split / subsample with exact per-class quotas, and uniform
samples, all by deterministic hash order (SMP1, SMP2, SMP3, JOIN1, JOIN6).

Contract: the rows picked in class ``c`` are the ``q_c`` rows with the
lowest ``(h, key)``, ``h = hash_order(key, salt)`` (32 bits); the quotas
``q_c`` split the total by largest remainder.

A ``row_number()`` over ``partition by class`` would sort a whole class in
one task (the majority class is ~92 % of the rows). Instead the ``q_c``-th
smallest ``(h, key)`` is located with two bounded histograms: counts per
(class, top 16 hash bits) -- at most 65,536 rows per class -- then counts per
exact hash value inside the one boundary bucket per class. Membership is then
a map-side comparison with the per-class threshold, no shuffle of the rows.

Every function takes ``hash_col``: a column holding ``hash_order(key, salt)``
written with the table, so no md5 is computed per row. ``split_predicates``
adds a plain bound on that column to each side's membership test, which
Parquet row-group statistics can use when the files are sorted by it.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskframe.functions.columns import hash_order

TOP_BITS_SHIFT = 16
MAX_STRATA = 10_000
# Rows the first histogram may bring to the driver (65,536 per stratum at most).
MAX_HIST_ROWS = 4_000_000


def as_fraction(f) -> Fraction:
    """Exact fraction of a decimal given as str/float/Fraction ("0.2" -> 1/5)."""
    return f if isinstance(f, Fraction) else Fraction(str(f))


def largest_remainder(counts: dict, total: int) -> dict:
    """Split ``total`` over classes in proportion to ``counts``: floors first,
    then one more to the classes with the largest remainders (ties: smaller
    class value first)."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    base = {c: (k * total) // n for c, k in counts.items()}
    rem = {c: (k * total) % n for c, k in counts.items()}
    left = total - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return base


def _eq(c: str, v) -> Column:
    return F.col(c).isNull() if v is None else F.col(c) == F.lit(v)


def _order(key: str, salt: str, hash_col: str | None) -> Column:
    """The hash order of the rows: a stored column when the table carries it
    (computed once when the table was written), else ``md5`` per row."""
    return F.col(hash_col) if hash_col else hash_order(key, salt)


def top_bucket_counts(df: DataFrame, label: str, key: str, salt: str,
                      hash_col: str | None = None) -> dict:
    """Counts per (class, top 16 hash bits): at most 65,536 rows per class.
    Summed per class they are the class sizes, so one job gives both."""
    top = F.shiftright(_order(key, salt, hash_col), TOP_BITS_SHIFT).alias("hb")
    rows = df.groupBy(label, top).count().limit(MAX_HIST_ROWS + 1).collect()
    if len(rows) > MAX_HIST_ROWS:
        raise ValueError(f"too many strata in {label} for an exact stratified pick")
    hist = defaultdict(list)
    for r in rows:
        hist[r[label]].append((r["hb"], r["count"]))
    if len(hist) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata in {label}")
    return hist


def lowest_k_thresholds(df: DataFrame, label: str, key: str, salt: str,
                        quotas: dict, counts: dict, hist: dict | None = None,
                        hash_col: str | None = None) -> dict:
    """Per class, the ``(h, key)`` of its ``quotas[c]``-th smallest row.

    Returns ``{c: None}`` for "pick none", ``{c: "all"}`` for "pick all",
    otherwise ``{c: (h_star, key_star)}``.
    """
    h = _order(key, salt, hash_col)
    out: dict = {}
    need = {c: q for c, q in quotas.items() if 0 < q < counts[c]}
    for c, q in quotas.items():
        if q <= 0:
            out[c] = None
        elif q >= counts[c]:
            out[c] = "all"
    if not need:
        return out
    # level 1: counts per (class, top hash bits); <= 65,536 rows per class
    if hist is None:
        hist = top_bucket_counts(df, label, key, salt, hash_col)
    boundary = {}
    for c, q in need.items():
        below = 0
        for hb, n in sorted(hist[c]):
            if q <= below + n:
                boundary[c] = (hb, q - below)
                break
            below += n
    # level 2: counts per exact hash inside the boundary bucket of each class
    cond = F.lit(False)
    for c, (hb, _) in boundary.items():
        cond = cond | (_eq(label, c) & (F.shiftright(h, TOP_BITS_SHIFT) == F.lit(hb)))
    rows = (df.where(cond).groupBy(label, h.alias("h"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("kmin")).collect())
    per_h = defaultdict(list)
    for r in rows:
        per_h[r[label]].append((r["h"], r["n"], r["kmin"]))
    ties = {}
    for c, (hb, rank) in boundary.items():
        below = 0
        for hv, n, kmin in sorted(per_h[c]):
            if rank <= below + n:
                if rank - below == 1:
                    out[c] = (hv, kmin)
                else:
                    ties[c] = (hv, rank - below)
                break
            below += n
    # level 3 (rare): several keys share the boundary hash; rank them by key
    if ties:
        cond = F.lit(False)
        for c, (hv, _) in ties.items():
            cond = cond | (_eq(label, c) & (h == F.lit(hv)))
        w = Window.partitionBy(label).orderBy(key)
        ranked = (df.where(cond).select(label, key).withColumn("rn", F.row_number().over(w)))
        pick = F.lit(False)
        for c, (hv, r) in ties.items():
            pick = pick | (_eq(label, c) & (F.col("rn") == F.lit(r)))
        for r in ranked.where(pick).collect():
            out[r[label]] = (ties[r[label]][0], r[key])
    return out


def membership(label: str, key: str, salt: str, thresholds: dict,
               hash_col: str | None = None) -> Column:
    """Boolean column: the row is among the lowest ``(h, key)`` of its class."""
    h = _order(key, salt, hash_col)
    picked = F.lit(False)
    for c, t in thresholds.items():
        if t is None:
            continue
        if t == "all":
            picked = picked | _eq(label, c)
            continue
        hs, ks = t
        below = (h < F.lit(hs)) | ((h == F.lit(hs)) & (F.col(key) <= F.lit(ks)))
        picked = picked | (_eq(label, c) & below)
    return F.coalesce(picked, F.lit(False))  # a NULL label must not make the answer NULL


def hash_bounds(thresholds: dict) -> tuple[int | None, int | None]:
    """Bounds on the hash order implied by per-class thresholds: every picked
    row has ``h <= hi`` and every other row ``h >= lo`` (``None``: no bound).
    They are redundant with ``membership`` but are plain column-vs-literal
    comparisons, which Parquet row-group statistics can evaluate even though
    the class label is mixed inside every row group."""
    ts = list(thresholds.values())
    cut = [t[0] for t in ts if t is not None and t != "all"]
    hi = None if any(t == "all" for t in ts) else max(cut, default=-1)
    lo = None if any(t is None for t in ts) else min(cut, default=None)
    return hi, lo


def _thresholds(df: DataFrame, label: str, key: str, fraction, salt: str, round_up: bool,
                hash_col: str | None) -> tuple[dict, dict, dict]:
    f = as_fraction(fraction)
    hist = top_bucket_counts(df, label, key, salt, hash_col)
    counts = {c: sum(n for _, n in b) for c, b in hist.items()}
    n = sum(counts.values())
    total = -((-n * f.numerator) // f.denominator) if round_up else (n * f.numerator) // f.denominator
    quotas = largest_remainder(counts, total)
    return lowest_k_thresholds(df, label, key, salt, quotas, counts, hist, hash_col), quotas, counts


def split_predicates(df: DataFrame, label: str, key: str, test_fraction, salt: str,
                     hash_col: str | None = None) -> tuple[Column, Column]:
    """``(test, train)`` row predicates of the stratified split (SMP1), each
    the exact membership test plus the redundant hash bound of
    ``hash_bounds``. On a table whose files are sorted by the stored hash
    order, the bound lets the scan skip the row groups of the other side."""
    thresholds, _, _ = _thresholds(df, label, key, test_fraction, salt, True, hash_col)
    member = membership(label, key, salt, thresholds, hash_col)
    h = _order(key, salt, hash_col)
    hi, lo = hash_bounds(thresholds)
    test, train = member, ~member
    if hi is not None:
        test = (h <= F.lit(hi)) & test
    if lo is not None:
        train = (h >= F.lit(lo)) & train
    return test, train


def stratified_pick(df: DataFrame, label: str, key: str, fraction, salt: str,
                    round_up: bool, hash_col: str | None = None) -> tuple[Column, dict, dict]:
    """Pick ``ceil`` (``round_up``) or ``floor`` of ``fraction * n`` rows with
    class shares kept. Returns the membership column, quotas and class counts.
    ``hash_col`` names a stored ``hash_order(key, salt)`` column, if any."""
    thresholds, quotas, counts = _thresholds(df, label, key, fraction, salt, round_up, hash_col)
    return membership(label, key, salt, thresholds, hash_col), quotas, counts


def stratified_split(df: DataFrame, label: str, key: str, test_fraction, salt: str,
                     split_col: str = "split", hash_col: str | None = None) -> DataFrame:
    """Add ``split`` = 'test' for ceil(f*n) rows (class shares kept), else 'train' (SMP1)."""
    picked, _, _ = stratified_pick(df, label, key, test_fraction, salt, round_up=True,
                                   hash_col=hash_col)
    return df.withColumn(split_col, F.when(picked, F.lit("test")).otherwise(F.lit("train")))


def stratified_subsample(df: DataFrame, label: str, key: str, fraction, salt: str,
                         hash_col: str | None = None) -> DataFrame:
    """Rows of a floor(f*n) stratified subsample (SMP2)."""
    picked, _, _ = stratified_pick(df, label, key, fraction, salt, round_up=False, hash_col=hash_col)
    return df.where(picked)


def hash_sample(df: DataFrame, key: str, n: int, salt: str, hash_col: str | None = None) -> DataFrame:
    """Uniform sample of ``n`` rows without replacement: the ``n`` lowest
    ``(h, key)`` (SMP3).

    ``orderBy(..).limit(n)`` would plan as TakeOrderedAndProject, whose one
    final task receives ``n`` rows from every input partition (n x
    partitions rows on a large table). Instead the exact ``(h, key)`` of the
    ``n``-th row is found with the split's two bounded histograms (the whole
    table as one stratum), and the sample is a map-side filter."""
    one = df.withColumn("_stratum", F.lit(0))
    hist = top_bucket_counts(one, "_stratum", key, salt, hash_col)
    total = sum(c for _, c in hist.get(0, []))
    thresholds = lowest_k_thresholds(one, "_stratum", key, salt, {0: min(n, total)}, {0: total}, hist,
                                     hash_col)
    return one.where(membership("_stratum", key, salt, thresholds, hash_col)).drop("_stratum")


def train_rows(table: DataFrame, split_col: str = "split") -> DataFrame:
    """Raw rows of the training split (JOIN1 + JOIN2: the label stays in the row,
    so the semi join on the row id reduces to a filter on the split column)."""
    return table.where(F.col(split_col) == "train").drop(split_col)


def test_rows(table: DataFrame, split_col: str = "split") -> DataFrame:
    """The complement of the training rows (JOIN6)."""
    return table.where(F.col(split_col) == "test").drop(split_col)
