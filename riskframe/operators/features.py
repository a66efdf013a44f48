"""Fit-on-train feature preparation: sentinel cleaning, clipping to fitted
fences, median / most-frequent imputation, standardisation with the
population std, one-hot encoding with sorted categories (unseen -> all
zeros), and assembly into one vector (FE1-FE7, FE9, JOIN4).

Fitting costs two aggregate jobs plus one categorical count job (run
concurrently with the first):

1. exact order statistics for Q1 / median / Q3 of every numeric column (one
   bounded search for all columns, see ``quantiles``) -- the median is taken
   from the clipped order statistics, so it equals the median after clipping;
2. value counts per categorical column (modes and the category lists);
3. mean and population std of every clipped, imputed numeric column.

The fitted state is a small JSON-able dict; applying it is one narrow
projection (literals only), so it runs on train, test, applicants or a
stream alike and never shuffles.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.columns import clip, unpivot
from riskframe.operators.comoments import co_moments, named_pairs
from riskframe.operators.cleaning import clean_sentinels, drop_id_and_label
from riskframe.operators.quantiles import _interp, order_statistics, quantile_ranks

MAX_CATEGORIES = 100_000
#: Fitted encodings of up to this many columns are packed into dense vectors.
DENSE_WIDTH = 200


def _clip_value(v: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, v))


def fit_state(train_raw: DataFrame, factor: float = S.IQR_FACTOR) -> dict:
    """Fit all preprocessing statistics on the raw training rows."""
    clean = clean_sentinels(drop_id_and_label(train_raw))
    num_cols = S.numeric_columns(clean)
    cat_cols = S.categorical_columns(clean)
    probs = (0.25, 0.5, 0.75)

    def category_counts():
        if not cat_cols:
            return []
        items = [(c, F.col(c).cast("string")) for c in cat_cols]
        rows = (unpivot(clean, [], items, ["column_name", "value"])
                .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
                .limit(MAX_CATEGORIES + 1).collect())
        if len(rows) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories to one-hot encode")
        return rows

    # the categorical counts do not depend on the quantile search: both run
    # as concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=1) as pool:
        cat_future = pool.submit(category_counts)
        sizes, stats = order_statistics(clean, num_cols, list(probs))
        cat_rows = cat_future.result()
    # a column without any value has no median or mode: it is no feature, as the imputer drops it
    num_cols_all, num_cols = num_cols, [c for i, c in enumerate(num_cols) if (i,) in sizes]
    valued = {r["column_name"] for r in cat_rows if r["value"] is not None}
    cat_cols = [c for c in cat_cols if c in valued]
    fences, medians = {}, {}
    for (cid,), n in sizes.items():
        c = num_cols_all[cid]
        o = stats[(cid,)]
        q = {}
        for p in probs:
            lo, hi, frac = quantile_ranks(n, p)
            q[p] = (o[lo], o[hi], frac)
        q1 = _interp(*q[0.25])
        q3 = _interp(*q[0.75])
        iqr = q3 - q1
        lo_b, hi_b = q1 - factor * iqr, q3 + factor * iqr
        a, b, frac = q[0.5]
        fences[c] = [q1, q3]
        medians[c] = _interp(_clip_value(a, lo_b, hi_b), _clip_value(b, lo_b, hi_b), frac)
    # categorical value counts: modes (ties -> smallest) and category lists
    modes, categories, onehot_means = {}, {}, {}
    if cat_cols:
        per, nulls = defaultdict(list), defaultdict(int)
        for r in cat_rows:
            if r["value"] is None:
                nulls[r["column_name"]] += r["n"]
            else:
                per[r["column_name"]].append((r["value"], r["n"]))
        for c in cat_cols:
            vals = per[c]
            modes[c] = min(vals, key=lambda t: (-t[1], t[0]))[0]
            categories[c] = sorted(v for v, _ in vals)
            # one-hot column means after imputation (the mode takes the NULLs):
            # the centring vector of the encoded matrix, known without a pass
            n_c = sum(n for _, n in vals) + nulls.get(c, 0)
            cnt = dict(vals)
            onehot_means[c] = [(cnt[v] + (nulls.get(c, 0) if v == modes[c] else 0)) / n_c
                               for v in categories[c]]
    state = dict(num_cols=num_cols, cat_cols=cat_cols, factor=factor, fences=fences,
                 medians=medians, modes=modes, categories=categories, means={}, stds={},
                 onehot_means=onehot_means)
    # mean and population std after clipping and imputation
    imp = impute(clip_fitted(clean, state), state)
    if num_cols:
        row = imp.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(num_cols)],
                      *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(num_cols)]).first()
        for i, c in enumerate(num_cols):
            state["means"][c] = row[f"m{i}"]
            state["stds"][c] = row[f"s{i}"]
    return state


def clip_fitted(df: DataFrame, state: dict) -> DataFrame:
    """Clip numeric columns to the fitted fences (PRJ7, JOIN4 by literals)."""
    f = state["factor"]
    out = []
    for c in df.columns:
        if c in state["fences"]:
            q1, q3 = state["fences"][c]
            iqr = q3 - q1
            out.append(clip(F.col(c).cast("double"), F.lit(q1 - f * iqr), F.lit(q3 + f * iqr)).alias(c))
        elif c in state["num_cols"]:
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def impute(df: DataFrame, state: dict) -> DataFrame:
    """Fill numeric NULLs with the median, categorical NULLs with the mode (FE1, FE2)."""
    out = []
    for c in df.columns:
        if c in state["num_cols"] and state["medians"].get(c) is not None:
            out.append(F.coalesce(F.col(c), F.lit(state["medians"][c])).alias(c))
        elif c in state["cat_cols"] and state["modes"].get(c) is not None:
            out.append(F.coalesce(F.col(c), F.lit(state["modes"][c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def scale(df: DataFrame, state: dict) -> DataFrame:
    """(x - mean) / population std; a zero std counts as 1, as in the
    reference's scaler, so a constant training column scales to 0 (FE3)."""
    out = []
    for c in df.columns:
        if c in state["means"] and state["means"][c] is not None:
            sd = state["stds"][c] or 1.0
            out.append(((F.col(c) - F.lit(state["means"][c])) / F.lit(sd)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def feature_names(state: dict) -> list[tuple[str, str, str | None]]:
    """(feature name, source column, category) in vector order (FE7)."""
    out = [(c, c, None) for c in state["num_cols"]]
    for c in state["cat_cols"]:
        out += [(f"{c}_{v}", c, v) for v in state["categories"][c]]
    return out


def _num_expr(c: str, state: dict, present: bool, apply_clip: bool) -> F.Column:
    x = F.col(c).cast("double") if present else F.lit(None).cast("double")
    if c == "DAYS_EMPLOYED":
        x = F.nullif(x, F.lit(float(S.DAYS_EMPLOYED_SENTINEL)))
    if apply_clip and c in state["fences"]:
        q1, q3 = state["fences"][c]
        f = state["factor"]
        x = clip(x, F.lit(q1 - f * (q3 - q1)), F.lit(q3 + f * (q3 - q1)))
    if state["medians"].get(c) is not None:
        x = F.coalesce(x, F.lit(state["medians"][c]))
    if state["means"].get(c) is not None:
        x = (x - F.lit(state["means"][c])) / F.lit(state["stds"][c] or 1.0)
    return F.coalesce(x, F.lit(0.0))


def _cat_expr(c: str, state: dict, present: bool) -> F.Column:
    x = F.col(c).cast("string") if present else F.lit(None).cast("string")
    if c == "CODE_GENDER":
        x = F.nullif(x, F.lit(S.GENDER_SENTINEL))
    if state["modes"].get(c) is not None:
        x = F.coalesce(x, F.lit(state["modes"][c]))
    return x


def encoded_means(state: dict) -> list[float]:
    """Training mean of every encoded column: 0 for the scaled numeric block,
    the category frequency (after imputation) for each one-hot column."""
    out = [0.0] * len(state["num_cols"])
    for c in state["cat_cols"]:
        out += state.get("onehot_means", {}).get(c) or [0.0] * len(state["categories"][c])
    return out


def prepared_features(df: DataFrame, state: dict, apply_clip: bool = True,
                      output_col: str = "features", packed: bool = False) -> DataFrame:
    """``df`` with the ``features`` vector of raw rows appended: sentinels ->
    NULL, clip, impute, scale, one-hot (unseen / NULL -> zeros); training
    columns missing from ``df`` count as NULL (FE4-FE6, PRJ9). No shuffle.

    Categories become indices by a hash lookup held in the indexer and the
    one-hot block stays sparse, so neither the plan nor a row grows with the
    number of categories; that costs one vector for each categorical column and
    row. ``packed`` builds the same numbers as one dense vector of compiled
    expressions instead, for encodings of few columns (``DENSE_WIDTH``)."""
    have, cats = set(df.columns), state["cat_cols"]
    taken = {c.lower() for c in df.columns}

    def own(name):
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    number = [own(f"_numeric{i}") for i in range(len(state["num_cols"]))]
    text, index, hot = ([own(f"_{kind}{i}") for i in range(len(cats))] for kind in ("category", "index", "hot"))
    if packed:
        out = df.withColumns({t: _cat_expr(c, state, c in have) for t, c in zip(text, cats)})
        cells = [_num_expr(c, state, c in have, apply_clip) for c in state["num_cols"]]
        cells += [F.when(F.col(t) == v, F.lit(1.0)).otherwise(F.lit(0.0)) for t, c in zip(text, cats) for v in state["categories"][c]]
        vector = own("_vector")
        return out.withColumn(vector, array_to_vector(F.array(*cells))).drop(output_col, *text).withColumnRenamed(vector, output_col)
    out = df.withColumns({n: _num_expr(c, state, c in have, apply_clip) for c, n in zip(state["num_cols"], number)}
                         | {t: _cat_expr(c, state, c in have) for t, c in zip(text, cats)})
    if cats:
        for c, t, i in zip(cats, text, index):
            out = StringIndexerModel.from_labels(state["categories"][c], inputCol=t, outputCol=i, handleInvalid="keep").transform(out)
        # the sizes come from the indexers' metadata: fitted on no row, so a stream is encoded the same way
        sizes = df.sparkSession.createDataFrame([], out.select(*index).schema)
        out = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True, handleInvalid="error").fit(sizes).transform(out)
    # single numbers and vectors of known size: assembling reads no row either
    assembled = VectorAssembler(inputCols=[*number, *hot], outputCol=output_col, handleInvalid="keep").transform(out.drop(output_col))
    return assembled.drop(*number, *text, *index, *hot)


def covariance_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population covariance of every pair i >= j (diagonal = variance) in one
    pass of mergeable co-moments (FE9)."""
    m = named_pairs(co_moments(df, columns), columns)
    return m.select("col_a", "col_b", "n", (F.col("c") / F.col("n")).alias("cov"))
