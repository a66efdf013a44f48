"""Row cleaning (PRJ1, PRJ5, PRJ6). Clipping to fences fitted on training
rows (AGG8, PRJ7) lives with the other fitted statistics in ``features``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskframe import schema as S
from riskframe.functions.columns import sentinel_to_null


def drop_id_and_label(df: DataFrame) -> DataFrame:
    """Feature columns only (PRJ1)."""
    return df.drop(S.KEY, S.LABEL)


def clean_sentinels(df: DataFrame) -> DataFrame:
    """Sentinel codes to NULL: ``DAYS_EMPLOYED = 365243``, ``CODE_GENDER = 'XNA'``
    (PRJ5, PRJ6). Columns that are absent are left alone."""
    out = df
    if "DAYS_EMPLOYED" in df.columns:
        out = out.withColumn("DAYS_EMPLOYED",
                             sentinel_to_null("DAYS_EMPLOYED", S.DAYS_EMPLOYED_SENTINEL))
    if "CODE_GENDER" in df.columns:
        out = out.withColumn("CODE_GENDER", sentinel_to_null("CODE_GENDER", S.GENDER_SENTINEL))
    return out
