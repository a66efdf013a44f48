"""CSV scan with pandas-style missing-value tokens and one-pass type
inference (SRC1), and a clear error for a missing path (SRC2).

Spark's ``nullValue`` takes one string and an ``NA`` token makes a numeric
column infer as string, so the file is read as strings, the tokens are
nulled, and each column's type is chosen by one aggregate pass that counts,
per column, the non-null values that do not parse as int / long / double.
With an explicit schema the inference pass is skipped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: pandas' default missing-value tokens for read_csv --------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
# --- end of fixed values ----------------------------------------------------


def _null_tokens(c: str, tokens: list[str]) -> F.Column:
    x = F.col(c)
    return F.when(x.isin(tokens), F.lit(None).cast("string")).otherwise(x)


def line_shape(spark: SparkSession, path: str) -> tuple[bool, int]:
    """(whether records span lines, most fields of a line), from one pass over
    the text lines. A line with an odd number of quotes opens or closes a quoted
    line break: where every line has an even number, every line is a record."""
    line = F.col("value")
    unquoted = F.regexp_replace(line, r'"[^"]*"', "")  # doubled quotes are two quoted parts
    row = spark.read.text(path).agg(
        F.max((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2).alias("odd"),
        F.max(F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1).alias("fields")).first()
    return bool(row.odd), row.fields or 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_tokens: list[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """Read a headed CSV like ``pandas.read_csv``: NA tokens become NULL,
    columns become int / bigint / double / boolean, the rest stay strings.

    Quotes in a quoted field are doubled, a short row is padded with NULL, and
    a row with more fields than the header raises. Whether records span lines
    is found from the text (``multi_line`` None) before anything is parsed; only
    such a file is read by one task."""
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    try:
        spans, most = line_shape(spark, path)
        multi = spans if multi_line is None else multi_line
        reader = (spark.read.option("header", "true").option("inferSchema", "false")
                  .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
                  .option("multiLine", str(multi).lower()))
        raw = reader.csv(path)
        names = raw.columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"File not found: {path}") from e
        raise
    if multi and spans:
        # one more column: a surplus field lands in it
        wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
        rows = reader.schema(wide).option("enforceSchema", "true").csv(path)
        surplus = not rows.where(F.col(f"c{len(names)}").isNotNull()).isEmpty()
    else:
        surplus = most > len(names)
    if surplus:
        raise ValueError(f"{path}: expected {len(names)} fields, a row has more")
    cleaned = raw.select(*[_null_tokens(c, tokens).alias(c) for c in names])
    if schema is not None:
        return cleaned.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    types = infer_types(cleaned)
    return cleaned.select(*[F.trim(F.col(c)).cast(types[c]).alias(c)
                            if not isinstance(types[c], T.StringType) else F.col(c) for c in names])


#: The texts that pandas reads as booleans.
BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]
INT_RE = r"^[+-]?[0-9]{1,19}$"
FLOAT_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Infinity)$"


def infer_types(df: DataFrame) -> dict[str, T.DataType]:
    """Smallest of int / bigint / double every non-null value parses as,
    boolean if all values are, else string: one aggregate job for all columns, pattern tests only (a
    failing cast would raise and be caught per value, far slower)."""
    checks = []
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(c))
        present = F.col(c).isNotNull()
        whole = F.when(x.rlike(INT_RE), x.try_cast("bigint"))
        integral = whole.isNotNull()
        checks += [
            F.sum(F.when(present & ~integral, 1).otherwise(0)).alias(f"nonint_{i}"),
            F.sum(F.when(present & ~x.rlike(FLOAT_RE), 1).otherwise(0)).alias(f"nonfloat_{i}"),
            F.min(whole).alias(f"min_{i}"),
            F.max(whole).alias(f"max_{i}"),
            F.sum(F.when(x.isin(BOOLEANS), 0).otherwise(1)).alias(f"nonbool_{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("n"), *checks).first()
    out: dict[str, T.DataType] = {}
    for i, c in enumerate(df.columns):
        if not row[f"nonint_{i}"]:
            lo, hi = row[f"min_{i}"], row[f"max_{i}"]
            fits = lo is None or (lo >= -(2 ** 31) and hi <= 2 ** 31 - 1)
            out[c] = T.IntegerType() if fits else T.LongType()
        elif not row[f"nonfloat_{i}"]:
            out[c] = T.DoubleType()
        elif row["n"] and not row[f"nonbool_{i}"]:  # with a missing value it stays text, as in pandas
            out[c] = T.BooleanType()
        else:
            out[c] = T.StringType()
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV, NULL written as an empty field."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
