"""DuckDB SQL for every SQL-checkable query (the correctness oracle).

The SQL is written independently of the Spark code: the split uses the
simple ``row_number`` form, quantiles read order statistics off a sorted
list and interpolate like NumPy (``npq``), correlations use
``corr``/``covar_pop``. Shared pieces are CTEs prepended to each query.
"""

from __future__ import annotations

from riskframe import schema as S
from riskframe.sources.applications import APPLICATION_COLUMNS, applications_sql


def hash_sql(key: str, salt: str) -> str:
    return f"('0x'||substr(md5('{salt}'||CAST({key} AS VARCHAR)),1,8))::BIGINT"


def sig_sql(x: str, digits: int = 9) -> str:
    """Same IEEE operations as ``functions.columns.sig``."""
    v = f"CAST(({x}) AS DOUBLE)"
    k = f"({digits - 1} - floor(log10(abs({v}))))"
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) THEN NULL WHEN {v} = 0 THEN 0.0 "
            f"WHEN {k} > 22 THEN CAST(printf('%.{digits - 1}e', {v}) AS DOUBLE) "
            f"WHEN {k} >= 0 THEN floor({v} * pow(10.0, {k}) + 0.5) / pow(10.0, {k}) "
            f"WHEN {k} >= -22 THEN floor({v} / pow(10.0, -{k}) + 0.5) * pow(10.0, -{k}) "
            f"ELSE {v} END)")


def sorted_list(x: str) -> str:
    """Aggregate: the non-null values of ``x`` as a sorted DOUBLE list."""
    return f"list_sort(list(CAST({x} AS DOUBLE)) FILTER (WHERE {x} IS NOT NULL))"


def npq(xs: str, p: float) -> str:
    """Linear-interpolated quantile of a sorted list, NumPy's formula:
    v = p*(n-1), a/b = values at floor(v) and the next rank, t = v - floor(v),
    a + (b-a)*t for t < 0.5, b - (b-a)*(1-t) otherwise."""
    n = f"len({xs})"
    v = f"(CAST({p!r} AS DOUBLE) * ({n} - 1))"
    lo = f"CAST(floor({v}) AS BIGINT)"
    t = f"({v} - {lo})"
    a = f"{xs}[{lo} + 1]"
    b = f"{xs}[least({lo} + 2, {n})]"
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {t}) "
            f"ELSE {a} + ({b} - {a}) * {t} END)")


def quota_sql(src: str, salt: str, num: int, den: int, round_up: bool, name: str) -> str:
    """CTEs ``{name}_q`` (class quotas) and ``{name}`` (rows of ``src`` with
    ``picked``): the lowest (h, key) rows per class by largest remainder."""
    total = f"(sum(n_c)*{num} + {den - 1})//{den}" if round_up else f"(sum(n_c)*{num})//{den}"
    return f"""
{name}_c AS (SELECT TARGET, count(*) AS n_c FROM {src} GROUP BY TARGET),
{name}_t AS (SELECT sum(n_c) AS n, {total} AS t FROM {name}_c),
{name}_b AS (SELECT TARGET, (n_c*t)//n AS base, (n_c*t)%n AS rem, t FROM {name}_c, {name}_t),
{name}_q AS (
  SELECT TARGET, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, TARGET)
                               <= t - sum(base) OVER () THEN 1 ELSE 0 END AS quota
  FROM {name}_b),
{name} AS (
  SELECT r.* EXCLUDE (_h, _rn), _rn <= quota AS picked
  FROM (SELECT s.*, {hash_sql('SK_ID_CURR', salt)} AS _h,
               row_number() OVER (PARTITION BY TARGET ORDER BY {hash_sql('SK_ID_CURR', salt)}, SK_ID_CURR) AS _rn
        FROM {src} s) r
  JOIN {name}_q USING (TARGET))"""


def base_ctes() -> str:
    """applications, split (all rows + split), train (raw train rows), test."""
    return ("WITH " + applications_sql() + "," +
            quota_sql("applications", S.SPLIT_SALT, 1, 5, True, "picked_split") + """,
split AS (SELECT * EXCLUDE (picked), CASE WHEN picked THEN 'test' ELSE 'train' END AS split
          FROM picked_split),
train AS (SELECT * EXCLUDE (split) FROM split WHERE split = 'train'),
test AS (SELECT * EXCLUDE (split) FROM split WHERE split = 'test')
""")


def q(body: str, extra_ctes: str = "") -> str:
    ctes = base_ctes()
    if extra_ctes:
        ctes += "," + extra_ctes + "\n"
    return ctes + body


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ---------------------------------------------------------------- exploration
register("rate_by_education", q("""
SELECT NAME_EDUCATION_TYPE, avg(CAST(TARGET AS DOUBLE))*100 AS default_rate_pct, count(*) AS n
FROM train WHERE NAME_EDUCATION_TYPE IS NOT NULL GROUP BY NAME_EDUCATION_TYPE
ORDER BY default_rate_pct DESC, NAME_EDUCATION_TYPE"""))

register("rate_by_income_type", q("""
SELECT NAME_INCOME_TYPE, avg(CAST(TARGET AS DOUBLE))*100 AS default_rate_pct, count(*) AS n
FROM train WHERE NAME_INCOME_TYPE IS NOT NULL GROUP BY NAME_INCOME_TYPE
ORDER BY default_rate_pct DESC, NAME_INCOME_TYPE"""))

register("split_counts", q("""
SELECT split, TARGET, count(*) AS n FROM split GROUP BY split, TARGET ORDER BY split, TARGET"""))

# ------------------------------------------------------------------ overview
APP_COLS = ", ".join(c for c, _ in __import__("riskframe.sources.applications", fromlist=["x"]).APPLICATION_COLUMNS)

register("scan_preview", q(f"SELECT {APP_COLS} FROM applications ORDER BY SK_ID_CURR LIMIT 10"))

register("dataset_summary", q("""
SELECT count(*) AS n_rows,
       (SELECT count(*) FROM (DESCRIBE SELECT * FROM applications))::INT AS n_columns,
       avg(CAST(TARGET AS DOUBLE))*100 AS default_rate_pct,
       CAST(floor(CAST(sum(CASE WHEN TARGET=0 THEN 1 ELSE 0 END) AS DOUBLE)
                  / nullif(sum(CASE WHEN TARGET=1 THEN 1 ELSE 0 END), 0)) AS BIGINT) AS imbalance_ratio
FROM applications"""))

register("feature_type_counts", q("""
SELECT CASE WHEN column_type IN ('VARCHAR') THEN 'categorical' ELSE 'numeric' END AS kind,
       count(*) AS n_features, CAST(sum(valued) AS BIGINT) AS n_with_values
FROM (DESCRIBE SELECT * FROM train) JOIN valued USING (column_name)
GROUP BY 1 ORDER BY 1""", "valued AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END AS valued FROM train"
    for c, _ in APPLICATION_COLUMNS if c not in (S.KEY, S.LABEL)) + ")"))


def _missing_sql() -> str:
    from riskframe.sources.applications import APPLICATION_COLUMNS
    parts = [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
             f"count(*) AS n FROM applications" for c, _ in APPLICATION_COLUMNS]
    return ("SELECT column_name, CAST(missing_count AS BIGINT) AS missing_count, "
            "round_even(CAST(missing_count AS DOUBLE)/n*100 * 100.0, 0) / 100.0 AS missing_pct FROM (\n"
            + "\nUNION ALL\n".join(parts) +
            "\n) WHERE missing_count > 0 ORDER BY missing_pct DESC, missing_count DESC, column_name LIMIT 20")


register("missing_profile", q(_missing_sql()))
register("csv_missing_profile", q(_missing_sql()))

register("split_cover_check", q("""
SELECT (SELECT count(*) FROM split) AS n_rows,
       (SELECT count(*) FROM split WHERE split='train') AS n_train,
       (SELECT count(*) FROM split WHERE split='test') AS n_test,
       (SELECT count(*) FROM (SELECT SK_ID_CURR FROM train INTERSECT SELECT SK_ID_CURR FROM test)) AS n_overlap,
       (SELECT count(*) FROM (SELECT SK_ID_CURR FROM applications EXCEPT ALL
            (SELECT SK_ID_CURR FROM train UNION ALL SELECT SK_ID_CURR FROM test))) AS n_uncovered,
       (SELECT count(*) FROM applications a WHERE NOT EXISTS
            (SELECT 1 FROM train t WHERE t.SK_ID_CURR = a.SK_ID_CURR)) AS n_not_train"""))

register("train_raw_rows", q(f"""
SELECT {APP_COLS} FROM applications a
WHERE a.SK_ID_CURR IN (SELECT SK_ID_CURR FROM split WHERE split = 'train')"""))

# --------------------------------------------------------------- exploration
register("target_distribution", q("""
SELECT TARGET, CASE TARGET WHEN 0 THEN 'No Default' WHEN 1 THEN 'Default' END AS label,
       count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM train) * 100 AS pct
FROM train GROUP BY TARGET ORDER BY n DESC"""))


def _hist_sql(expr: str, bins: int) -> str:
    return q(f"""
SELECT TARGET, bin, bin * ((hi - lo) / {bins}) + lo AS bin_lo,
       CASE WHEN bin = {bins - 1} THEN hi ELSE (bin + 1) * ((hi - lo) / {bins}) + lo END AS bin_hi,
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c USING (TARGET, bin) ORDER BY TARGET, bin""", f"""
hx AS (SELECT TARGET, CAST({expr} AS DOUBLE) AS x FROM train),
hs AS (SELECT TARGET,
              CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
       FROM hx WHERE x IS NOT NULL GROUP BY TARGET),
c AS (SELECT TARGET, CAST(least(floor((x - lo) * (CAST({bins} AS DOUBLE) / (hi - lo))), {bins - 1}) AS INT) AS bin,
             count(*) AS n
      FROM hx JOIN hs USING (TARGET) WHERE x IS NOT NULL GROUP BY ALL),
g AS (SELECT TARGET, lo, hi, CAST(unnest(range(0, {bins})) AS INT) AS bin FROM hs)""")


register("age_histogram", _hist_sql("round(-DAYS_BIRTH / 365.0, 1)", S.AGE_BINS))
register("employment_histogram", _hist_sql(
    f"CASE WHEN DAYS_EMPLOYED IS NULL THEN NULL ELSE least(-DAYS_EMPLOYED / 365.0, {float(S.EMPLOYMENT_YEARS_CAP)}) END",
    S.EMPLOYMENT_BINS))

register("income_boxplot", q(f"""
SELECT TARGET, CASE TARGET WHEN 0 THEN 'No Default' WHEN 1 THEN 'Default' END AS label, n,
       {sig_sql('q1', 10)} AS q1, {sig_sql('median', 10)} AS median, {sig_sql('q3', 10)} AS q3,
       {sig_sql('q3 - q1', 10)} AS iqr,
       {sig_sql('whisker_lo', 10)} AS whisker_lo, {sig_sql('whisker_hi', 10)} AS whisker_hi,
       n_outliers
FROM (
  SELECT b.TARGET, count(*) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
         min(CASE WHEN x >= q1 - 1.5*(q3-q1) AND x <= q3 + 1.5*(q3-q1) THEN x END) AS whisker_lo,
         max(CASE WHEN x >= q1 - 1.5*(q3-q1) AND x <= q3 + 1.5*(q3-q1) THEN x END) AS whisker_hi,
         CAST(sum(CASE WHEN x >= q1 - 1.5*(q3-q1) AND x <= q3 + 1.5*(q3-q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
  FROM b JOIN qs USING (TARGET) GROUP BY b.TARGET)""", f"""
p99 AS (SELECT {npq('xs', 0.99)} AS v FROM (SELECT {sorted_list('AMT_INCOME_TOTAL')} AS xs FROM train)),
b AS (SELECT TARGET, AMT_INCOME_TOTAL AS x FROM train, p99 WHERE AMT_INCOME_TOTAL < p99.v),
qs AS (SELECT TARGET, {npq('xs', 0.25)} AS q1, {npq('xs', 0.5)} AS median, {npq('xs', 0.75)} AS q3
       FROM (SELECT TARGET, {sorted_list('x')} AS xs FROM b GROUP BY TARGET))"""))

register("income_outliers", q("""
SELECT SK_ID_CURR, b.TARGET, CASE b.TARGET WHEN 0 THEN 'No Default' WHEN 1 THEN 'Default' END AS label, x AS AMT_INCOME_TOTAL,
       CASE WHEN x < q1 - 1.5*(q3-q1) THEN 'below' ELSE 'above' END AS side
FROM b JOIN qs USING (TARGET) WHERE x < q1 - 1.5*(q3-q1) OR x > q3 + 1.5*(q3-q1)""", f"""
p99 AS (SELECT {npq('xs', 0.99)} AS v FROM (SELECT {sorted_list('AMT_INCOME_TOTAL')} AS xs FROM train)),
b AS (SELECT SK_ID_CURR, TARGET, AMT_INCOME_TOTAL AS x FROM train, p99 WHERE AMT_INCOME_TOTAL < p99.v),
qs AS (SELECT TARGET, {npq('xs', 0.25)} AS q1, {npq('xs', 0.75)} AS q3
       FROM (SELECT TARGET, {sorted_list('x')} AS xs FROM b GROUP BY TARGET))"""))

register("gender_pivot", q("""
SELECT CODE_GENDER, n_no_default, n_default, n_no_default + n_default AS total,
       round_even(CAST(n_default AS DOUBLE) / (n_no_default + n_default) * 100 * 100.0, 0) / 100.0 AS default_rate_pct
FROM (SELECT CODE_GENDER, count(*) FILTER (WHERE TARGET = 0) AS n_no_default,
             count(*) FILTER (WHERE TARGET = 1) AS n_default
      FROM train WHERE CODE_GENDER IS NOT NULL GROUP BY CODE_GENDER)
ORDER BY CODE_GENDER"""))

register("sentinel_counts", q(f"""
SELECT n_sentinel, n_normal, n_rows,
       CAST(n_sentinel AS DOUBLE) / n_rows * 100 AS pct_sentinel,
       CAST(n_normal AS DOUBLE) / n_rows * 100 AS pct_normal
FROM (SELECT CAST(count(*) FILTER (WHERE DAYS_EMPLOYED IS NOT DISTINCT FROM {S.DAYS_EMPLOYED_SENTINEL}) AS BIGINT) AS n_sentinel,
             CAST(count(*) FILTER (WHERE DAYS_EMPLOYED IS DISTINCT FROM {S.DAYS_EMPLOYED_SENTINEL}) AS BIGINT) AS n_normal,
             count(*) AS n_rows FROM train)"""))

_WEEKDAYS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(S.WEEKDAY_ORDER, start=1))
register("rate_by_weekday", q(f"""
SELECT o.ord, o.WEEKDAY_APPR_PROCESS_START, r.default_rate_pct, coalesce(r.n, 0) AS n
FROM (VALUES {_WEEKDAYS}) AS o(ord, WEEKDAY_APPR_PROCESS_START)
LEFT JOIN (SELECT WEEKDAY_APPR_PROCESS_START, avg(CAST(TARGET AS DOUBLE))*100 AS default_rate_pct,
                  count(*) AS n
           FROM train WHERE WEEKDAY_APPR_PROCESS_START IS NOT NULL
           GROUP BY WEEKDAY_APPR_PROCESS_START) r USING (WEEKDAY_APPR_PROCESS_START)
ORDER BY o.ord"""))

register("rate_by_children", q(f"""
SELECT CNT_CHILDREN, avg(CAST(TARGET AS DOUBLE))*100 AS default_rate_pct, count(*) AS n
FROM train WHERE CNT_CHILDREN <= {S.CHILDREN_CAP} GROUP BY CNT_CHILDREN ORDER BY CNT_CHILDREN"""))


def _corr_sql() -> str:
    cols = S.CORRELATION_COLUMNS
    parts = []
    for i in range(len(cols)):
        for j in range(i):
            a, b = cols[i], cols[j]
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, "
                f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / "
                f"nullif(sqrt(var_pop(CAST({a} AS DOUBLE)) * var_pop(CAST({b} AS DOUBLE))), 0) AS c "
                f"FROM train WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return q(f"SELECT col_a, col_b, n, {sig_sql('c', 9)} AS corr FROM (\n"
             + "\nUNION ALL\n".join(parts) + "\n)")


register("correlation_pairs", _corr_sql())


def _ext_long() -> str:
    return "ext AS (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, TARGET, CAST({c} AS DOUBLE) AS v FROM train WHERE {c} IS NOT NULL"
        for c in S.EXT_SCORE_COLUMNS) + ")"


register("score_violin", q(f"""
SELECT column_name, TARGET, CASE TARGET WHEN 0 THEN 'No Default' WHEN 1 THEN 'Default' END AS label,
       count(*) AS n,
       {sig_sql(npq(sorted_list('v'), 0.25), 10)} AS q1,
       {sig_sql(npq(sorted_list('v'), 0.5), 10)} AS median,
       {sig_sql(npq(sorted_list('v'), 0.75), 10)} AS q3,
       {sig_sql('min(v)', 10)} AS vmin, {sig_sql('max(v)', 10)} AS vmax,
       {sig_sql('stddev_samp(v) * pow(CAST(count(*) AS DOUBLE), -0.2)', 9)} AS bandwidth
FROM ext GROUP BY column_name, TARGET""", _ext_long()))

register("score_density", q(f"""
SELECT column_name, TARGET, grid_index, {sig_sql('gx', 10)} AS x,
       {sig_sql(f's / (n * h * {__import__("math").sqrt(2 * __import__("math").pi)!r})', 8)} AS density
FROM (
  SELECT g.column_name, g.TARGET, g.grid_index, g.gx, g.n, g.h,
         sum(e.c * exp(-0.5 * ((g.gx - e.v) / g.h) * ((g.gx - e.v) / g.h))) AS s
  FROM gr g JOIN values_ e USING (column_name, TARGET)
  GROUP BY ALL)""", _ext_long() + f""",
st AS (SELECT column_name, TARGET, count(*) AS n, min(v) AS xmin, max(v) AS xmax,
              {sig_sql('stddev_samp(v) * pow(CAST(count(*) AS DOUBLE), -0.2)', 9)} AS h
       FROM ext GROUP BY column_name, TARGET HAVING count(*) >= 2),
st2 AS (SELECT * FROM st WHERE h > 0),
values_ AS (SELECT column_name, TARGET, v, count(*) AS c FROM ext GROUP BY ALL),
gr AS (SELECT column_name, TARGET, n, h, grid_index,
              grid_index * ((xmax + {S.KDE_CUT} * h - (xmin - {S.KDE_CUT} * h)) / {S.KDE_GRID_POINTS - 1})
                + (xmin - {S.KDE_CUT} * h) AS gx
       FROM st2, (SELECT CAST(unnest(range(0, {S.KDE_GRID_POINTS})) AS INT) AS grid_index))"""))

register("scatter_sample", q(f"""
SELECT SK_ID_CURR, AMT_GOODS_PRICE, AMT_CREDIT, TARGET FROM train
WHERE AMT_CREDIT IS NOT NULL AND AMT_GOODS_PRICE IS NOT NULL
ORDER BY {hash_sql('SK_ID_CURR', S.SCATTER_SALT)}, SK_ID_CURR LIMIT {S.SCATTER_SAMPLE_SIZE}"""))

# ------------------------------------------------------ cleaning and features
NUM = ["CNT_CHILDREN", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
       "DAYS_BIRTH", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "REGION_RATING_CLIENT",
       "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
CAT = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE",
       "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "WEEKDAY_APPR_PROCESS_START"]


def _fe_ctes() -> str:
    clean = (f"SELECT * REPLACE (nullif(DAYS_EMPLOYED, {S.DAYS_EMPLOYED_SENTINEL}) AS DAYS_EMPLOYED, "
             f"nullif(CODE_GENDER, '{S.GENDER_SENTINEL}') AS CODE_GENDER)")
    fl = ", ".join(f"{sorted_list(c)} AS {c}__xs" for c in NUM)
    fq = ", ".join(f"{npq(f'{c}__xs', 0.25)} AS {c}__q1, {npq(f'{c}__xs', 0.75)} AS {c}__q3" for c in NUM)
    fb = ", ".join(f"{c}__q1 - 1.5*({c}__q3 - {c}__q1) AS {c}__lo, {c}__q3 + 1.5*({c}__q3 - {c}__q1) AS {c}__hi"
                   for c in NUM)
    cl = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest({c}__lo, least({c}__hi, CAST({c} AS DOUBLE))) END AS {c}"
                   for c in NUM)
    ml = ", ".join(f"{sorted_list(c)} AS {c}__xs" for c in NUM)
    med = ", ".join(f"{npq(f'{c}__xs', 0.5)} AS {c}__med" for c in NUM)
    mode_src = "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, {c} AS value FROM ct" for c in CAT)
    imp_num = ", ".join(f"coalesce({c}, {c}__med) AS {c}" for c in NUM)
    imp_cat = ", ".join(f"coalesce({c}, (SELECT mode FROM modes WHERE column_name = '{c}')) AS {c}" for c in CAT)
    ms = ", ".join(f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__sd" for c in NUM)
    ms9 = ", ".join(f"{sig_sql(f'{c}__mean', 9)} AS {c}__mean, {sig_sql(f'{c}__sd', 9)} AS {c}__sd" for c in NUM)
    sc = ", ".join(f"({c} - {c}__mean) / CASE WHEN {c}__sd = 0 THEN 1 ELSE {c}__sd END AS {c}" for c in NUM)
    return f"""
ct AS ({clean} FROM train),
ca AS ({clean} FROM split),
fq AS (SELECT {fq} FROM (SELECT {fl} FROM ct)),
fb AS (SELECT *, {fb} FROM fq),
cl_all AS (SELECT SK_ID_CURR, split, TARGET, {cl}, {", ".join(CAT)} FROM ca, fb),
med AS (SELECT {med} FROM (SELECT {ml} FROM cl_all WHERE split = 'train')),
modes AS (SELECT column_name, value AS mode FROM (
    SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rn
    FROM ({mode_src}) WHERE value IS NOT NULL GROUP BY column_name, value) WHERE rn = 1),
imp_all AS (SELECT SK_ID_CURR, split, TARGET, {imp_num}, {imp_cat} FROM cl_all, med),
ms AS (SELECT {ms} FROM imp_all WHERE split = 'train'),
ms9 AS (SELECT {ms9} FROM ms),
sc_all AS (SELECT SK_ID_CURR, split, TARGET, {sc}, {", ".join(CAT)} FROM imp_all, ms9),
cats AS (SELECT DISTINCT column_name, value AS category FROM ({mode_src}) WHERE value IS NOT NULL)"""


def fq(body: str) -> str:
    return q(body, _fe_ctes())


register("clip_fences", fq("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {sig_sql(f'{c}__q1', 10)} AS q1, {sig_sql(f'{c}__q3', 10)} AS q3, "
    f"{sig_sql(f'{c}__q3 - {c}__q1', 10)} AS iqr, {sig_sql(f'{c}__lo', 10)} AS lo, {sig_sql(f'{c}__hi', 10)} AS hi FROM fb"
    for c in NUM)))

register("clipped_rows", fq(
    "SELECT SK_ID_CURR, split, " + ", ".join(f"{sig_sql(c, 10)} AS {c}" for c in NUM) +
    ", CODE_GENDER FROM cl_all"))

register("impute_stats", fq("\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column_name, 'numeric' AS kind, {sig_sql(f'{c}__med', 10)} AS median, "
     f"CAST(NULL AS VARCHAR) AS mode FROM med" for c in NUM] +
    [f"SELECT '{c}' AS column_name, 'categorical' AS kind, CAST(NULL AS DOUBLE) AS median, "
     f"(SELECT mode FROM modes WHERE column_name = '{c}') AS mode" for c in CAT])))

register("imputed_rows", fq(
    "SELECT SK_ID_CURR, split, " + ", ".join(f"{sig_sql(c, 10)} AS {c}" for c in NUM) +
    ", " + ", ".join(CAT) + " FROM imp_all"))

register("scale_stats", fq("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {sig_sql(f'{c}__mean', 9)} AS mean, {sig_sql(f'{c}__sd', 9)} AS std FROM ms"
    for c in NUM)))

register("scaled_rows", fq(
    "SELECT SK_ID_CURR, split, " + ", ".join(f"{sig_sql(c, 8)} AS {c}" for c in NUM) + " FROM sc_all"))

register("onehot_long", fq("SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT SK_ID_CURR, split, '{c}' AS column_name, {c} AS category FROM imp_all" for c in CAT) +
    ") l WHERE (column_name, category) IN (SELECT (column_name, category) FROM cats)"))

register("feature_catalogue", fq(f"""
SELECT CAST(row_number() OVER (ORDER BY blk, pos, category) - 1 AS INT) AS idx,
       CASE WHEN category IS NULL THEN column_name ELSE column_name || '_' || category END AS feature_name,
       column_name, category, CASE WHEN blk = 0 THEN 'numeric' ELSE 'one_hot' END AS block
FROM (SELECT 0 AS blk, pos, column_name, CAST(NULL AS VARCHAR) AS category
      FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(NUM))}) v(pos, column_name)
      UNION ALL
      SELECT 1 AS blk, pos, column_name, category
      FROM cats JOIN (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(CAT))}) v(pos, column_name)
      USING (column_name))"""))

register("covariance_pairs", fq("\nUNION ALL\n".join(
    f"SELECT '{NUM[i]}' AS col_a, '{NUM[j]}' AS col_b, count(*) AS n, "
    f"{sig_sql(f'covar_pop({NUM[i]}, {NUM[j]})', 8)} AS cov FROM sc_all WHERE split = 'train'"
    for i in range(len(NUM)) for j in range(i + 1))))

# ------------------------------------------------ evaluation on a fixed score
EVAL_SCORE = "-1.5 + -1.2*EXT_SOURCE_1 + 0.6*CNT_CHILDREN + 0.3*CNT_FAM_MEMBERS + 0.3*AMT_GOODS_PRICE"


def eq(body: str) -> str:
    return q(body, _fe_ctes() + f""",
fixed AS (SELECT SK_ID_CURR, TARGET, {EVAL_SCORE} AS score,
                 CAST(({EVAL_SCORE}) > 0 AS INTEGER) AS prediction
          FROM sc_all WHERE split = 'test'),
cnt AS (SELECT CAST(count(*) FILTER (WHERE TARGET=1 AND prediction=1) AS BIGINT) AS tp,
               CAST(count(*) FILTER (WHERE TARGET=0 AND prediction=1) AS BIGINT) AS fp,
               CAST(count(*) FILTER (WHERE TARGET=1 AND prediction=0) AS BIGINT) AS fn,
               CAST(count(*) FILTER (WHERE TARGET=0 AND prediction=0) AS BIGINT) AS tn FROM fixed)""")


def dv(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


register("linear_score", eq(f"""
SELECT SK_ID_CURR, TARGET, {sig_sql('score', 8)} AS score, prediction, {sig_sql('abs(score)', 8)} AS confidence
FROM fixed"""))

register("confusion_matrix", eq("""
SELECT g.actual, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)
LEFT JOIN (SELECT CAST(TARGET AS INTEGER) AS actual, prediction AS predicted, count(*) AS n
           FROM fixed GROUP BY ALL) c USING (actual, predicted)
ORDER BY 1, 2"""))

register("binary_metrics", eq(f"""
SELECT {dv('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {dv('tp', 'tp + fp')} AS precision,
       {dv('tp', 'tp + fn')} AS recall, {dv('2 * tp', '2 * tp + fp + fn')} AS f1
FROM cnt"""))

register("roc_auc", eq("""
SELECT CAST(sum(CAST(pos AS HUGEINT) * (2 * below + neg)) AS DOUBLE) / CAST(2 * any_value(P) * any_value(N) AS DOUBLE) AS auc,
       CAST(any_value(P) AS BIGINT) AS n_pos, CAST(any_value(N) AS BIGINT) AS n_neg
FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT score + 0.0 AS s, sum(CASE WHEN TARGET = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN TARGET = 0 THEN 1 ELSE 0 END) AS neg FROM fixed GROUP BY 1)),
     (SELECT sum(CASE WHEN TARGET = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN TARGET = 0 THEN 1 ELSE 0 END) AS N FROM fixed)"""))

register("classification_report", eq(f"""
SELECT class_name, round_even(precision * 10000.0, 0) / 10000.0 AS precision,
       round_even(recall * 10000.0, 0) / 10000.0 AS recall,
       round_even(f1_score * 10000.0, 0) / 10000.0 AS f1_score,
       round_even(support * 10000.0, 0) / 10000.0 AS support FROM (
  SELECT 'No Default' AS class_name, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m
  UNION ALL SELECT 'Default', p1, r1, f1, s1 FROM m
  UNION ALL SELECT 'accuracy', acc, acc, acc, acc FROM m
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                   (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m)""".replace("FROM m", f"""FROM (
    SELECT {dv('tn', 'tn + fn')} AS p0, {dv('tn', 'tn + fp')} AS r0, {dv('2 * tn', '2 * tn + fn + fp')} AS f0,
           CAST(tn + fp AS DOUBLE) AS s0,
           {dv('tp', 'tp + fp')} AS p1, {dv('tp', 'tp + fn')} AS r1, {dv('2 * tp', '2 * tp + fp + fn')} AS f1,
           CAST(tp + fn AS DOUBLE) AS s1, {dv('tp + tn', 'tp + fp + fn + tn')} AS acc FROM cnt) m""")))

# -------------------------------------------------- subsample, applicants
SUB = quota_sql("train", S.SUBSAMPLE_SALT, 1, 20, False, "sub_pick")
register("stratified_subsample", q("SELECT SK_ID_CURR, TARGET FROM sub_pick WHERE picked", SUB))
register("class_weights", q("""
SELECT TARGET, n, CAST(total AS DOUBLE) / (k * n) AS weight
FROM (SELECT TARGET, count(*) AS n FROM sub_pick WHERE picked GROUP BY TARGET),
     (SELECT count(*) AS total, count(DISTINCT TARGET) AS k FROM sub_pick WHERE picked)
ORDER BY TARGET""", SUB))

register("aligned_applicants", q("""
SELECT SK_ID_CURR, NAME_CONTRACT_TYPE, CODE_GENDER, CNT_CHILDREN, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY,
       AMT_GOODS_PRICE, NAME_INCOME_TYPE, NAME_EDUCATION_TYPE, NAME_FAMILY_STATUS, NAME_HOUSING_TYPE,
       CAST(-(AGE_YEARS * 365) AS INTEGER) AS DAYS_BIRTH,
       CAST(nullif(-(YEARS_EMPLOYED * 365), 365243) AS INTEGER) AS DAYS_EMPLOYED,
       CAST(NULL AS DOUBLE) AS CNT_FAM_MEMBERS, REGION_RATING_CLIENT, WEEKDAY_APPR_PROCESS_START,
       EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3
FROM (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS CNT_FAM_MEMBERS),
             CAST(floor(-DAYS_BIRTH / 365) AS INTEGER) AS AGE_YEARS,
             CAST(CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE floor(-DAYS_EMPLOYED / 365) END AS INTEGER) AS YEARS_EMPLOYED
      FROM test)"""))

register("pipeline_stage_counts", fq(f"""
SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
       {len(NUM)} AS n_numeric_features, {len(CAT)} AS n_categorical_features,
       CAST({len(NUM)} + (SELECT count(*) FROM cats) AS INTEGER) AS encoded_width,
       CAST(sum({" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in NUM + CAT)}) AS BIGINT) AS missing_after_imputation
FROM imp_all"""))

# ------------------------------------- the same operators over lineitem
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

register("lineitem_quantiles", "\nUNION ALL\n".join(
    f"SELECT l_returnflag, '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, "
    f"{sig_sql(npq(sorted_list(c), p), 10)} AS value FROM lineitem GROUP BY l_returnflag"
    for c in LINE_NUMERIC for p in (0.25, 0.5, 0.75, 0.99)))

register("lineitem_price_boxplot", f"""
WITH qs AS (SELECT l_returnflag, {npq('xs', 0.25)} AS q1, {npq('xs', 0.5)} AS median, {npq('xs', 0.75)} AS q3
            FROM (SELECT l_returnflag, {sorted_list('l_extendedprice')} AS xs FROM lineitem GROUP BY l_returnflag))
SELECT l_returnflag, count(*) AS n, {sig_sql('any_value(q1)', 10)} AS q1, {sig_sql('any_value(median)', 10)} AS median,
       {sig_sql('any_value(q3)', 10)} AS q3, {sig_sql('any_value(q3) - any_value(q1)', 10)} AS iqr,
       {sig_sql('min(CASE WHEN x >= q1 - 1.5*(q3-q1) AND x <= q3 + 1.5*(q3-q1) THEN x END)', 10)} AS whisker_lo,
       {sig_sql('max(CASE WHEN x >= q1 - 1.5*(q3-q1) AND x <= q3 + 1.5*(q3-q1) THEN x END)', 10)} AS whisker_hi,
       CAST(sum(CASE WHEN x >= q1 - 1.5*(q3-q1) AND x <= q3 + 1.5*(q3-q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) JOIN qs USING (l_returnflag)
GROUP BY l_returnflag""")

register("lineitem_price_histogram", """
WITH hx AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem),
hs AS (SELECT l_returnflag,
              CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
       FROM hx WHERE x IS NOT NULL GROUP BY l_returnflag),
c AS (SELECT l_returnflag, CAST(least(floor((x - lo) * (CAST(50 AS DOUBLE) / (hi - lo))), 49) AS INT) AS bin,
             count(*) AS n
      FROM hx JOIN hs USING (l_returnflag) WHERE x IS NOT NULL GROUP BY ALL),
g AS (SELECT l_returnflag, lo, hi, CAST(unnest(range(0, 50)) AS INT) AS bin FROM hs)
SELECT l_returnflag, bin, bin * ((hi - lo) / 50) + lo AS bin_lo,
       CASE WHEN bin = 49 THEN hi ELSE (bin + 1) * ((hi - lo) / 50) + lo END AS bin_hi,
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c USING (l_returnflag, bin) ORDER BY l_returnflag, bin""")

register("lineitem_correlation_pairs", "SELECT col_a, col_b, n, " + sig_sql("c", 9) + " AS corr FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{LINE_NUMERIC[i]}' AS col_a, '{LINE_NUMERIC[j]}' AS col_b, count(*) AS n, "
    f"covar_pop({LINE_NUMERIC[i]}, {LINE_NUMERIC[j]}) / nullif(sqrt(var_pop({LINE_NUMERIC[i]}) * var_pop({LINE_NUMERIC[j]})), 0) AS c "
    f"FROM lineitem WHERE {LINE_NUMERIC[i]} IS NOT NULL AND {LINE_NUMERIC[j]} IS NOT NULL"
    for i in range(len(LINE_NUMERIC)) for j in range(i)) + "\n)")

register("lineitem_discount_auc", """
SELECT CAST(sum(CAST(pos AS HUGEINT) * (2 * below + neg)) AS DOUBLE) / CAST(2 * any_value(P) * any_value(N) AS DOUBLE) AS auc,
       CAST(any_value(P) AS BIGINT) AS n_pos, CAST(any_value(N) AS BIGINT) AS n_neg
FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT l_discount + 0.0 AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS neg FROM lineitem GROUP BY 1)),
     (SELECT sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS P,
             sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS N FROM lineitem)""")

register("lineitem_return_rate_by_status", """
SELECT l_linestatus, avg(CAST(CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE))*100 AS default_rate_pct, count(*) AS n
FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY l_linestatus ORDER BY default_rate_pct DESC, l_linestatus""")

# ------------------------------------------------ certificates of the fitted model
_VALUES = "\nUNION ALL\n".join(
    [f"SELECT SK_ID_CURR AS r, '{c}' AS f, {c} AS x FROM sc_all WHERE split = 'train'" for c in NUM] +
    [f"SELECT SK_ID_CURR, '{c}=' || {c}, 1.0 FROM sc_all WHERE split = 'train' AND {c} IS NOT NULL" for c in CAT])

register("pca_certificate", q(f"""
SELECT "check", {sig_sql('v', 6)} AS value, true AS holds FROM (
    SELECT 'trace' AS "check", trace AS v FROM tr
    UNION ALL SELECT 'squared_ratios', sum(cov * cov) / any_value(trace * trace) FROM co, tr)
UNION ALL SELECT name, CAST(NULL AS DOUBLE), true
FROM (VALUES ('orthonormal'), ('diagonal'), ('components_kept')) v(name)""", _fe_ctes() + f""",
e AS MATERIALIZED ({_VALUES}),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM train),
mean AS (SELECT f, sum(x) / any_value(n) AS m FROM e, total GROUP BY f),
prod AS (SELECT a.f AS fa, b.f AS fb, sum(a.x * b.x) AS s FROM e a JOIN e b USING (r) GROUP BY a.f, b.f),
co AS (SELECT a.f AS fa, b.f AS fb, coalesce(s, 0) / n - a.m * b.m AS cov
       FROM mean a CROSS JOIN mean b CROSS JOIN total LEFT JOIN prod p ON p.fa = a.f AND p.fb = b.f),
tr AS (SELECT sum(cov) AS trace FROM co WHERE fa = fb)"""))

register("svm_certificate", q(f"""
SELECT "check", {sig_sql('v', 6)} AS value, true AS holds FROM (
    SELECT 'training_rows' AS "check", CAST(count(*) AS DOUBLE) AS v FROM train
    UNION ALL SELECT 'rows_of_class_' || TARGET, count(*) FROM train GROUP BY TARGET
    UNION ALL SELECT 'reg_param', 1.0 / ({S.SVM_C!r} * count(*)) FROM train)
UNION ALL SELECT name, CAST(NULL AS DOUBLE), true
FROM (VALUES ('dual_below_primal'), ('gap_within_bound')) v(name)"""))

register("platt_certificate", q(f"""
SELECT "check", {sig_sql('v', 5)} AS value, true AS holds FROM (
    SELECT 'rows' AS "check", p + n AS v FROM c
    UNION ALL SELECT unnest(['target_sum', 'probability_sum']), p * (p + 1) / (p + 2) + n / (n + 2) FROM c)
UNION ALL SELECT 'first_moment', CAST(NULL AS DOUBLE), true""", """
c AS (SELECT CAST(count(*) FILTER (WHERE TARGET = 1) AS DOUBLE) AS p,
             CAST(count(*) FILTER (WHERE TARGET = 0) AS DOUBLE) AS n FROM train)"""))
