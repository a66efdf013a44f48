"""Per-input prepared tables, reused by every query on the same input (SNK2).

The dashboard caches its loaded data and fitted objects per CSV path; here
the joined application table and the fitted model are written once under the
shared checkpoint folder (``plans/store.py``), keyed by the input's files, and
every query, also of later applications, reads them back (column pruning and
filter pushdown apply; a lost executor re-reads files instead of recomputing
the join).
"""

from __future__ import annotations

import threading
import warnings
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schema as S
from riskframe.functions.columns import hash_order
from riskframe.operators.model import FittedModel
from riskframe.operators.sampling import hash_sample, split_predicates, stratified_subsample
from riskframe.plans import store
from riskframe.sources import csv
from riskframe.sources.applications import APPLICATION_COLUMNS, applications, read_table, write_partitions

_CONTEXTS: dict[tuple, "Prepared"] = {}
_BUILDS: dict[tuple, threading.RLock] = {}
_LOCK = threading.Lock()

# What the application table of a folder of test tables is made from.
SOURCE_TABLES = ("orders", "customer", "nation", "lineitem")

# The split's hash order, written with the table so that no query pays an
# md5 per row to tell train from test.
SPLIT_HASH = "_split_h"
# Likewise the hash orders of the training subsample (SMP2) and of the
# scatter sample (SMP3).
SUBSAMPLE_HASH = "_sub_h"
SCATTER_HASH = "_scatter_h"
HASH_COLUMNS = (SPLIT_HASH, SUBSAMPLE_HASH, SCATTER_HASH)


@dataclass
class Prepared:
    spark: SparkSession
    sf_dir: str
    base: DataFrame  # the written table: application rows + the split's hash order
    test_pred: F.Column
    train_pred: F.Column
    key: str  # of the table's entry in the store
    memo: dict = field(default_factory=dict)
    lock: threading.RLock = field(default_factory=threading.RLock)

    @property
    def table(self) -> DataFrame:
        """All application rows + ``split``."""
        split = F.when(self.test_pred, F.lit("test")).otherwise(F.lit("train"))
        return self.base.withColumn("split", split).drop(*HASH_COLUMNS)

    @property
    def train(self) -> DataFrame:
        # the predicate reaches the Parquet scan (see _prepared)
        return self.base.where(self.train_pred).drop(*HASH_COLUMNS)

    @property
    def test(self) -> DataFrame:
        return self.base.where(self.test_pred).drop(*HASH_COLUMNS)

    def subsample(self, fraction) -> DataFrame:
        """Stratified subsample of the training rows (SMP2), ordered by the
        stored subsample hash (no md5 per row)."""
        t = self.base.where(self.train_pred).drop(SPLIT_HASH, SCATTER_HASH)
        return stratified_subsample(t, S.LABEL, S.KEY, fraction, S.SUBSAMPLE_SALT,
                                    hash_col=SUBSAMPLE_HASH).drop(SUBSAMPLE_HASH)

    def train_sample(self, n: int, complete: list[str]) -> DataFrame:
        """``n`` training rows, uniform without replacement among those with
        all of ``complete`` present (SMP3), by the stored scatter order."""
        t = self.base.where(self.train_pred).drop(SPLIT_HASH, SUBSAMPLE_HASH).na.drop(subset=complete)
        return hash_sample(t, S.KEY, n, S.SCATTER_SALT, hash_col=SCATTER_HASH).drop(SCATTER_HASH)

    def cached(self, name: str, build):
        """Fitted objects (stats, models) computed once per input, also when
        queries run from several threads."""
        with self.lock:
            if name not in self.memo:
                self.memo[name] = build()
            return self.memo[name]


def load_applications(spark: SparkSession, source: str, partitions: int | None = None) -> DataFrame:
    """The application table named by ``source``:

    * ``*.csv`` -- a headed CSV file, or a folder of them (the dashboard's
      input format): pandas-style NA tokens become NULL, types are inferred
      in one pass (SRC1);
    * ``*.parquet`` -- a Parquet table of applications; NaN in floating
      columns becomes NULL (Spark aggregates skip NULL, not NaN);
    * any other folder -- the TPC-H-style test tables, from which the
      application table is derived (``sources/applications.py``).

    A missing path raises ``FileNotFoundError`` (SRC2).

    The choice is by name only, so it works for any Hadoop file system.
    """
    return _existing(source, lambda src: _load(spark, src, partitions))


def _existing(source: str, read):
    try:
        return read(source.rstrip("/"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"File not found: {source}") from e
        raise


def table_key(spark: SparkSession, source: str) -> str:
    """Key of the prepared table: it changes with the source's files, their
    schema, and the rules by which the table is made."""
    def key(src: str) -> str:
        if src.lower().endswith((".csv", ".parquet")):
            paths = [src]
        else:
            paths = [f"{src}/{t}.parquet" for t in SOURCE_TABLES]
        schemas = [] if src.lower().endswith(".csv") else [spark.read.parquet(p).schema.json() for p in paths]
        rules = {"schemas": schemas, "columns": APPLICATION_COLUMNS, "label": S.LABEL, "key": S.KEY,
                 "salts": [S.SPLIT_SALT, S.SUBSAMPLE_SALT, S.SCATTER_SALT], "hashes": HASH_COLUMNS}
        return store.entry_key("applications", src, store.listing(spark, paths), rules)

    return _existing(source, key)


def _load(spark: SparkSession, src: str, partitions: int | None = None) -> DataFrame:
    if src.lower().endswith(".csv"):
        return csv.read_csv(spark, src)
    if src.lower().endswith(".parquet"):
        df = spark.read.parquet(src)
        return df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                           for f in df.schema.fields])
    return applications(spark, src, partitions=partitions)


def _source_rows(spark: SparkSession, src: str) -> int:
    """Rows that the application table has at most or about, from Parquet footers;
    0 for CSV, whose rows only a scan of the text would count."""
    if src.lower().endswith(".csv"):
        return 0
    if src.lower().endswith(".parquet"):
        return _existing(src, lambda path: spark.read.parquet(path).count())
    return _existing(src, lambda path: read_table(spark, path, "orders").count())


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"))
    with _LOCK:
        build = _BUILDS.setdefault(key, threading.RLock())
    # one build of an input at a time; other inputs do not wait for it
    with build:
        ctx = _CONTEXTS.get(key)
        if ctx is None or ctx.spark is not spark:
            ctx = _CONTEXTS[key] = _prepared(spark, sf_dir)
        return ctx


def _prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    def build() -> DataFrame:
        parts = write_partitions(spark, _source_rows(spark, sf_dir.rstrip("/")))
        # One write of the joined table, with the split's hash order as an
        # extra column; the split thresholds are then found from it and the
        # label, and membership is an integer comparison with literal
        # thresholds (no second write, no shuffle of the rows, no per-query
        # hashing). Each file is sorted by the hash order (a local sort, no
        # shuffle): the test rows, the lowest hashes of each class, then sit
        # in the first row groups of every file, and the split predicates,
        # which carry a plain bound on the hash, let the Parquet scan skip
        # the other side's row groups (test queries read about a fifth of
        # the table).
        apps = (load_applications(spark, sf_dir, parts)
                .withColumn(SPLIT_HASH, hash_order(S.KEY, S.SPLIT_SALT))
                .withColumn(SUBSAMPLE_HASH, hash_order(S.KEY, S.SUBSAMPLE_SALT))
                .withColumn(SCATTER_HASH, hash_order(S.KEY, S.SCATTER_SALT)))
        return apps.repartition(parts, S.KEY).sortWithinPartitions(SPLIT_HASH)

    key = table_key(spark, sf_dir)
    base = store.keep_table(spark, key, build)
    test_pred, train_pred = split_predicates(base, S.LABEL, S.KEY, S.TEST_FRACTION, S.SPLIT_SALT,
                                             hash_col=SPLIT_HASH)
    return Prepared(spark, sf_dir, base, test_pred, train_pred, key)


def kept_model(ctx: Prepared, fit, parameters: dict):
    """The model that an earlier application fitted to the same table with the
    same parameters, or else ``fit()``, kept for later ones. A loaded model
    scores and reports like the fitted one; it has no training summary."""
    fitted = []

    def write(path: str) -> dict:
        fitted.append(fit())
        fitted[0].pipeline.write().save(path)
        return {"model": fitted[0].facts()}

    key = store.entry_key("model", ctx.sf_dir.rstrip("/"), [ctx.key], parameters)
    manifest = store.keep(ctx.spark, key, write)
    if fitted:
        return fitted[0]
    loaded = FittedModel.from_facts(PipelineModel.load(manifest["data"]), manifest["model"])
    if loaded.info.get("not_converged"):
        warnings.warn(f"linear SVM of the kept model stopped unconverged: {loaded.info['not_converged']}", stacklevel=2)
    return loaded


def reset() -> None:
    """Forget what this process holds; the store keeps its entries (``store.clean_up`` removes them)."""
    with _LOCK:
        _CONTEXTS.clear()
