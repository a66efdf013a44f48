"""Applicant records to score: any DataFrame (table or stream) holding some
of the training columns, aligned to the training schema (SRC3, PRJ9, PRJ10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions.columns import sentinel_to_null, years_to_days


def form_to_columns(df: DataFrame) -> DataFrame:
    """Form units to table units: ``AGE_YEARS`` / ``YEARS_EMPLOYED`` become
    negative day counts ``DAYS_BIRTH`` / ``DAYS_EMPLOYED`` (PRJ10)."""
    out = df
    if "AGE_YEARS" in df.columns:
        out = out.withColumn("DAYS_BIRTH", years_to_days("AGE_YEARS")).drop("AGE_YEARS")
    if "YEARS_EMPLOYED" in df.columns:
        out = out.withColumn("DAYS_EMPLOYED", years_to_days("YEARS_EMPLOYED")).drop("YEARS_EMPLOYED")
    return out


def align_to_schema(df: DataFrame, template: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every column of ``template`` in its order and type: taken from ``df``
    when present, NULL otherwise; unknown columns of ``df`` are dropped; the
    employment sentinel is mapped to NULL as at scoring time (PRJ9)."""
    keep = [c for c in (keep or []) if c in df.columns]
    have = set(df.columns)
    cols = []
    for f in template.schema.fields:
        if f.name in keep:
            continue
        src = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(src.cast(f.dataType).alias(f.name))
    out = df.select(*[F.col(k) for k in keep], *cols)
    if "DAYS_EMPLOYED" in out.columns:
        out = out.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED", S.DAYS_EMPLOYED_SENTINEL))
    return out
