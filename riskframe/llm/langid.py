"""Language identification by compression.

Per language, a raw-content zstandard dictionary is filled from labelled
texts. Texts are lower-cased and everything but letters becomes a space, so
capitals, digits and punctuation say nothing. A text is cut into segments (all of it is used), every segment is
compressed once with each language's dictionary, and the language with the
smallest total wins. The prediction is rejected (``rejected``) when the margin
between the two best, in compressed bytes per input byte, is narrow.

The dictionaries come from a bounded sample: per language at most
``SAMPLE_DOCS`` documents, the lowest by a hash of the key and the text; of a
long one, a bounded first part teaches. Every language's dictionary is filled on its own, up to
``DICT_BYTES`` bytes, with an equal share of each document and all of those
that are shorter; one with few labelled texts has a smaller dictionary and
changes no other.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; rows with a null label or no letter teach nothing; without any
labelled text everything is ``und``; ties go to the first language by name;
repeated rows are ordinary rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructType

from riskframe.llm.common import map_slices
from riskframe.session import materialize

SAMPLE_DOCS = 160
DICT_BYTES = 160_000
SEGMENT_BYTES = 4096
LEVEL = 9
NARROW = 0.01
TEMPERATURE = 0.02
_ASCII_LETTER = re.compile("[A-Za-z]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def letters_of(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


SAMPLE = StructType().add("lang", StringType()).add("h", LongType()).add("letters", BinaryType())


def learn_dictionaries(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text",
                       lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary bytes, from a bounded sample of the labelled rows."""
    rows = docs.filter(learn_from & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.xxhash64(F.col(key).cast("string"), F.col(text))
    ranked = rows.select(F.col(lang).cast("string").alias("lang"), order.alias("h")).distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = ranked.filter(F.col("r") <= SAMPLE_DOCS).select("lang", "h")
    picked = picked.collect()  # SAMPLE_DOCS rows for each language
    if not picked:
        return {}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r.lang, r.h) for r in picked], "_l string, _h long"))
    got = (rows.select(F.col(lang).cast("string").alias("lang"), order.alias("h"), F.col(text).cast("string").alias("text"))
           .join(wanted, (F.col("lang") == F.col("_l")) & (F.col("h") == F.col("_h")), "left_semi"))
    letters = map_slices(got, lambda batch: {
        "lang": batch.column("lang"), "h": batch.column("h"),
        "letters": [letters_of(t)[:DICT_BYTES] for t in batch.column("text").to_pylist()]}, SAMPLE, chars_of="text")
    sample = materialize(letters.dropDuplicates(["lang", "h"]), "op5-sample")
    lengths: dict[str, list[int]] = {}
    for r in sample.select("lang", F.octet_length("letters").alias("n")).collect():
        lengths.setdefault(r.lang, []).append(r.n)
    shares = spark.createDataFrame([(name, equal_share(n, DICT_BYTES)) for name, n in lengths.items()], "lang string, share int")
    cut = (sample.join(F.broadcast(shares), "lang")
           .select("lang", "h", F.col("letters").substr(F.lit(1), F.col("share")).alias("letters")))
    texts: dict[str, list[bytes]] = {}
    for r in cut.orderBy("lang", "h").collect():  # about DICT_BYTES for each language
        texts.setdefault(r.lang, []).append(bytes(r.letters))
    return {name: b"".join(parts)[-DICT_BYTES:] for name, parts in sorted(texts.items())}


def equal_share(lengths: list[int], size: int) -> int:
    """The least number of bytes of each text that gives ``size`` bytes together, or the longest text's length."""
    for i, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - i) >= size:
            return -(-size // (len(lengths) - i))
        size -= n
    return max(lengths)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.coders = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False))

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language or ``und``, score, margin, rejected)."""
        if not self.names or not has_letter(text):
            return "und", 0.0, 0.0, True
        raw = letters_of(text)
        cuts = [raw[i:i + SEGMENT_BYTES] for i in range(0, len(raw), SEGMENT_BYTES)]
        rates = np.array([sum(len(c.compress(s)) for s in cuts) for c in self.coders]) / len(raw)
        best = int(rates.argmin())
        weights = np.exp((rates[best] - rates) / TEMPERATURE)
        margin = float(np.sort(rates)[1] - rates[best]) if len(rates) > 1 else 1.0
        return self.names[best], float(weights[best] / weights.sum()), margin, margin < NARROW


RESULT = (StructType().add("key", LongType()).add("held_out", BooleanType()).add("lang_pred", StringType())
          .add("score", DoubleType()).add("margin", DoubleType()).add("rejected", BooleanType()))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], held: Column, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per document: key, held_out, lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES for each language

    state: dict = {}

    def run(batch):
        if "c" not in state:
            state["c"] = Classifier(shared.value)
        got = [state["c"].classify(t) for t in batch.column("text").to_pylist()]
        return {"key": batch.column("key"), "held_out": batch.column("held_out")} | {
            name: [g[i] for g in got] for i, name in enumerate(("lang_pred", "score", "margin", "rejected"))}

    rows = docs.select(F.col(key).cast("long").alias("key"), held.alias("held_out"),
                       F.col(text).cast("string").alias("text"))
    return map_slices(rows, run, RESULT, chars_of="text")
