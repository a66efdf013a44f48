"""Join helpers that keep broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` provably has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops the scan
    early), so it is cheap even when the answer is "too big"; in that case
    the plain DataFrame is returned and Spark picks a shuffle join (or AQE
    converts it at run time if the real size turns out small).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def small_frame(df: DataFrame, max_rows: int) -> DataFrame:
    """Evaluate a small result once (e.g. per-group statistics that several
    later steps join) and return it as a local table with a proven size
    bound; raises if ``df`` has more than ``max_rows`` rows. The returned
    frame is safe to ``F.broadcast`` and is not recomputed per use."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows, got more")
    return df.sparkSession.createDataFrame(rows, df.schema)
