"""The training-data pipeline: documents through five operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of ``documents``; the last one returns their piece ids.
``run`` writes each stage's result as Parquet under the shared checkpoint
folder and reads it again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, linededup, neardup, toxicity
from riskframe.llm.common import held_out, read_table
from riskframe.llm.queries import piece_ids
from riskframe.session import ensure_checkpoint_dir, materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores below 0.5."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, model)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one repeats within one edit."""
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and whether they decode to the text."""
    return piece_ids(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("MinHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

#: The toxicity network has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
