"""The ``applications`` table derived from the TPC-H-style test tables.

One row per order: ``orders ⋈ customer ⋈ nation ⟕ (lineitem grouped by
order)``. The column expressions are shared with the SQL oracle so both
engines compute the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.joins import bounded_broadcast

# (name, expression) in output order; the expressions are plain SQL text that
# Spark and DuckDB evaluate identically (the weekday is the one exception).
APPLICATION_COLUMNS: list[tuple[str, str]] = [
    ("SK_ID_CURR", "o_orderkey"),
    ("TARGET", "CAST(CASE WHEN n_ret>=4 OR (n_ret=3 AND n_lines<=4) THEN 1 ELSE 0 END AS INT)"),
    ("NAME_CONTRACT_TYPE", "CASE WHEN o_orderkey%10=0 THEN 'Revolving loans' ELSE 'Cash loans' END"),
    ("CODE_GENDER", "CASE WHEN o_orderkey%500=0 THEN 'XNA' WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'M' ELSE 'F' END"),
    ("CNT_CHILDREN", "CAST(CASE WHEN coalesce(n_lines,0)>3 THEN n_lines-3 ELSE 0 END AS INT)"),
    ("AMT_INCOME_TOTAL", "25000 + c_acctbal*20"),
    ("AMT_CREDIT", "o_totalprice"),
    ("AMT_ANNUITY", "CASE WHEN o_orderkey%97=0 THEN NULL ELSE o_totalprice/20 END"),
    ("AMT_GOODS_PRICE", "CAST(goods AS DOUBLE)"),
    ("NAME_INCOME_TYPE", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Working' WHEN 'BUILDING' THEN 'Commercial associate' WHEN 'FURNITURE' THEN 'Pensioner' WHEN 'HOUSEHOLD' THEN 'State servant' ELSE 'Unemployed' END"),
    ("NAME_EDUCATION_TYPE", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Higher education' WHEN '2-HIGH' THEN 'Secondary / secondary special' WHEN '3-MEDIUM' THEN 'Incomplete higher' WHEN '4-NOT SPECIFIED' THEN 'Lower secondary' ELSE 'Academic degree' END"),
    ("NAME_FAMILY_STATUS", "CASE WHEN o_orderkey%211=0 THEN NULL WHEN o_custkey%5=0 THEN 'Married' WHEN o_custkey%5=1 THEN 'Single / not married' WHEN o_custkey%5=2 THEN 'Civil marriage' WHEN o_custkey%5=3 THEN 'Separated' ELSE 'Widow' END"),
    ("NAME_HOUSING_TYPE", "CASE o_orderstatus WHEN 'F' THEN 'House / apartment' WHEN 'O' THEN 'Rented apartment' ELSE 'With parents' END"),
    ("DAYS_BIRTH", "CAST(-(7000 + (o_custkey*7919)%18000) AS INT)"),
    ("DAYS_EMPLOYED", "CAST(CASE WHEN o_custkey%6=0 THEN 365243 ELSE -((o_orderkey*31)%9000) END AS INT)"),
    ("CNT_FAM_MEMBERS", "CAST(CASE WHEN o_orderkey%1000=7 THEN NULL ELSE (CASE WHEN coalesce(n_lines,0)>3 THEN n_lines-3 ELSE 0 END)+1+o_custkey%2 END AS DOUBLE)"),
    ("REGION_RATING_CLIENT", "CAST(1+n_regionkey%3 AS INT)"),
    ("WEEKDAY_APPR_PROCESS_START", "upper(date_format(o_orderdate,'EEEE'))"),
    ("EXT_SOURCE_1", "CASE WHEN o_orderkey%2=0 THEN NULL ELSE 1 - CAST(n_ret AS DOUBLE)/(n_lines+1) END"),
    ("EXT_SOURCE_2", "CASE WHEN o_orderkey%400=3 THEN NULL ELSE CAST(disc AS DOUBLE)/n_lines*10 END"),
    ("EXT_SOURCE_3", "CASE WHEN o_orderkey%5=0 THEN NULL ELSE (o_totalprice-1000)/499000 END"),
]

# Nation is a fixed 25-row dimension; broadcast it only after checking.
NATION_BROADCAST_ROWS = 10_000
# A customer is "hot" when it holds at least this share of all orders (and at
# least MIN_HOT_ROWS of them); there are at most 1 / HOT_KEY_SHARE such keys.
HOT_KEY_SHARE = 0.001
MIN_HOT_ROWS = 1_000_000
# Rows of one partition of the application table: some 100 MB while they are
# joined and sorted, whatever the number of orders.
PARTITION_ROWS = 250_000
# A side of fewer rows may be one that Spark broadcasts by itself.
LARGE_SIDE_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_partitions(spark: SparkSession, rows: int = 0) -> int:
    """Partitions of the application table: at least one for each core, as many
    as the session's shuffles have, and enough that none has many more than
    ``PARTITION_ROWS`` of ``rows``."""
    return max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark), -(-rows // PARTITION_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Per-order line statistics. Decimal sums make the result independent of
    summation order. Partial aggregation runs map-side; the output stays
    hash-partitioned by order key, which the join to ``orders`` reuses."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("goods"),
        F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("disc"),
    )


def hot_keys(df: DataFrame, key: str, share: float = HOT_KEY_SHARE,
             min_rows: int = MIN_HOT_ROWS) -> list:
    """Keys holding at least ``share`` of the rows of ``df`` (and ``min_rows``):
    one map-side-combined count per key, of which at most ``1 / share`` rows
    pass the filter and reach the driver. They only choose the join's plan, and
    no key of a table of fewer than ``min_rows`` rows can be one."""
    total = df.count()
    if total < min_rows:
        return []
    cut = max(min_rows, int(total * share))
    bound = int(1 / share) + 1
    rows = (df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cut)
            .limit(bound + 1).collect())
    if len(rows) > bound:
        raise AssertionError("more hot keys than the share allows")
    return [r[key] for r in rows if r[key] is not None]


def join_splitting_hot_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                            hot: list, parts: int | None = None) -> DataFrame:
    """Inner equi-join where the ``hot`` keys of ``left`` (a bounded list)
    meet a broadcast of their few ``right`` rows, and all other keys take
    the ordinary shuffle join. A key holding a third of ``left`` is then
    spread over all of ``left``'s partitions instead of one reducer. With
    ``parts`` the shuffle join has that many partitions."""
    def shuffled(a: DataFrame, b: DataFrame) -> DataFrame:
        if parts is not None:
            a, b = a.repartition(parts, left_key), b.repartition(parts, right_key)
        return a.join(b, F.col(left_key) == F.col(right_key))

    if not hot:
        return shuffled(left, right)
    is_hot_l = F.col(left_key).isin(hot)
    is_hot_r = F.col(right_key).isin(hot)
    # at most len(hot) rows when the right key is unique; checked, not assumed
    hot_right = bounded_broadcast(right.where(is_hot_r), 10 * len(hot) + 1000)
    return (left.where(is_hot_l).join(hot_right, F.col(left_key) == F.col(right_key))
            .unionByName(shuffled(left.where(~is_hot_l), right.where(~is_hot_r))))


def applications(spark: SparkSession, sf_dir: str, hot_share: float = HOT_KEY_SHARE,
                 min_hot_rows: int = MIN_HOT_ROWS, partitions: int | None = None) -> DataFrame:
    """Build the 21-column application table from the test tables. Where
    ``partitions`` exceeds the session's shuffles, the joins have that many."""
    more = partitions if partitions is not None and partitions > shuffle_partitions(spark) else None
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    lines = order_lines(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_extendedprice", "l_discount"))
    cust = customer.join(bounded_broadcast(nation, NATION_BROADCAST_ROWS),
                         F.col("c_nationkey") == F.col("n_nationkey"))
    # orders first meet customers, as narrow rows on the customer key, with
    # customers that hold a large share of all orders split off to a broadcast
    # join. The order key comes last: the line statistics already lie by it, and
    # so does the result, which a table partitioned by that key is written from
    # without another shuffle of the whole rows.
    hot = hot_keys(orders.select("o_custkey"), "o_custkey", hot_share, min_hot_rows)
    large = more is not None and customer.count() > LARGE_SIDE_ROWS
    owned = join_splitting_hot_keys(orders, cust, "o_custkey", "c_custkey", hot, more if large else None)
    if more is not None:
        owned, lines = owned.repartition(more, "o_orderkey"), lines.repartition(more, "l_orderkey")
    joined = owned.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select(*[F.expr(expr).alias(name) for name, expr in APPLICATION_COLUMNS])


def applications_sql() -> str:
    """The same table as DuckDB SQL (two CTEs: ``li`` and ``applications``)."""
    cols = []
    for name, expr in APPLICATION_COLUMNS:
        if name == "WEEKDAY_APPR_PROCESS_START":
            expr = "upper(dayname(o_orderdate))"
        cols.append(f"    {expr} AS {name}")
    select = ",\n".join(cols)
    return (
        "li AS (\n"
        "  SELECT l_orderkey, count(*) AS n_lines,\n"
        "         sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n_ret,\n"
        "         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS goods,\n"
        "         sum(CAST(l_discount AS DECIMAL(18,2))) AS disc\n"
        "  FROM lineitem GROUP BY l_orderkey\n"
        "),\n"
        "applications AS (\n"
        "  SELECT\n"
        f"{select}\n"
        "  FROM orders\n"
        "  JOIN customer ON c_custkey=o_custkey\n"
        "  JOIN nation ON n_nationkey=c_nationkey\n"
        "  LEFT JOIN li ON l_orderkey=o_orderkey\n"
        ")"
    )
