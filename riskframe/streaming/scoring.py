"""Applicant scoring on a stream (ML6 on Structured Streaming).

The fitted pipeline is a stateless projection (literals, a d x k matrix
product, a dot product), so a streaming DataFrame goes through the same
plan as a batch one: no state store, no watermark. Files dropped into the
source folder are aligned to the training schema, scored without clipping
(like the live form) and appended to the sink; the checkpoint folder makes
the sink exactly-once across restarts and executor loss.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskframe.operators.model import score
from riskframe.sources.applicants import align_to_schema, form_to_columns

SCORE_COLUMNS = ["prediction", "confidence", "p_default"]


def scored_stream(spark: SparkSession, model: PipelineModel, source_dir: str,
                  source_schema: T.StructType, template: DataFrame, key: str,
                  max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of (key, prediction, confidence, p_default)."""
    forms = (spark.readStream.schema(source_schema)
             .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    aligned = align_to_schema(form_to_columns(forms), template, keep=[key])
    return score(model, aligned, apply_clip=False).select(key, *SCORE_COLUMNS)


def start_scoring(stream: DataFrame, sink_dir: str, checkpoint_dir: str,
                  available_now: bool = True) -> StreamingQuery:
    """Append scores as Parquet; ``available_now`` drains what is there and stops."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink_dir)
