"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line (split at "\\n", compared without surrounding spaces, tabs and carriage
returns) is removed when an earlier line of the corpus, in the order of (document
key, text digest, line number), equals it or is within one character edit
(insertion, deletion or substitution). Blank lines always stay. Lines of fewer
than ``MIN_CHARS`` characters are only matched exactly: among them one edit
changes what a line is.

1. Lines are reduced to 128-bit hashes and counted once with their earliest
   place (map-side combined, so a line that a third of all documents hold is
   one row for each task).
2. Two lines within one edit agree on the half of the line without the edit.
   Lines whose half-line keys (by length) no other line shares are done; this
   filter loses nothing.
3. The rest emit all their deletion variants as hashed keys (prefix hashes
   modulo 2^64, one vectorised pass for each line): equal variants at one
   place are a substitution, a variant that equals a whole line is an
   insertion. A window over equal keys names the earliest partner, so a group
   of many lines never becomes pairs. The edit distance of each (line,
   partner) is verified on the texts.
4. Each document gets the numbers of its lines to keep: the texts move through
   one shuffle.

Defined results: a null text stays null and has no lines; a text of which no
line stays becomes empty; rows that agree in key and text are one place and
each return the same cleaned text; null keys come first; an empty table gives
an empty result. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from riskframe.functions.joins import bounded_broadcast
from riskframe.llm.common import fresh, map_batches, slices
from riskframe.session import materialize

MIN_CHARS = 10
BROADCAST_ROWS = 200_000
_BLANK = " \t\r"
_FIRST = -(1 << 63)  # a null key stands before all others
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(line: str) -> tuple[np.ndarray, int]:
    """Hashes of the line without its character at each place, and of the whole line."""
    codes = _mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                 + np.uint64(0x632BE59BD9B4E019))
    n = len(codes)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:n], dtype=np.uint64)])
    without = before[:n] + (before[n] - before[1:]) * _INVERSE
    return _mix(without + np.uint64(n - 1)).view(np.int64), int(_mix(before[n:] + np.uint64(n)).view(np.int64)[0])


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:])


def _half_keys(line: Column, n: Column) -> list[Column]:
    keys = []
    for shorter, length in (("n", n), ("n-1", n - 1)):
        half = (length / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), length, F.left(line, half)))
        keys.append(F.xxhash64(F.lit("tail"), length, F.right(line, half)))
    return keys


def _wanted_lines(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The texts of the wanted lines: h1, h2, doc, digest, line_no, line."""
    by_doc = wanted.groupBy("doc", "digest").agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("wanted"))
    schema = (StructType().add("h1", LongType()).add("h2", LongType()).add("doc", LongType())
              .add("digest", LongType()).add("line_no", LongType()).add("line", StringType()))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, chars_of="text"):
            out = []
            for row in batch.to_pylist():
                lines = row["text"].split("\n")
                out += [w | {"doc": row["doc"], "digest": row["digest"], "line": lines[w["line_no"]].strip(_BLANK)}
                        for w in row["wanted"]]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("digest"),
                       F.col(text).alias("text")).filter("text IS NOT NULL")
    small = bounded_broadcast(materialize(by_doc, "op7-wanted"), BROADCAST_ROWS)
    same = rows["doc"].eqNullSafe(small["doc"]) & (rows["digest"] == small["digest"])
    joined = rows.join(small, same).select(rows["doc"], rows["digest"], "text", "wanted")
    return map_batches(joined, run, schema).dropDuplicates(["h1", "h2"])


def _keys_of(lines: DataFrame) -> DataFrame:
    """Hashed variants: h1, h2, place (line order), key, at (-1 for the whole line)."""
    schema = (StructType().add("h1", LongType()).add("h2", LongType()).add("doc", LongType()).add("digest", LongType())
              .add("line_no", LongType()).add("key", LongType()).add("at", LongType()))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, chars_of="line", max_bytes=1 << 18):
            parts = []
            for row in batch.to_pylist():
                without, whole = variants(row["line"])
                size = len(without) + 1
                parts.append([np.full(size, _FIRST if row[c] is None else row[c], np.int64) for c in ("h1", "h2", "doc", "digest", "line_no")]
                             + [np.append(without, whole), np.append(np.arange(size - 1), -1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=arrow)

    return map_batches(lines, run, schema)


def near_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that an earlier line is within one edit of.
    ``lines``: h1, h2, doc, digest, line_no, line; distinct in (h1, h2)."""
    place = F.struct("doc", "digest", "line_no", "h1", "h2")
    keys = _keys_of(lines.filter(F.length("line") >= MIN_CHARS))
    same_key = Window.partitionBy("key")
    partner = (keys.withColumn("place", place)
               # earliest line with the same variant at the same place; the whole line of that
               # hash; and for whole lines the earliest line that has it as a variant
               .withColumn("whole", F.min(F.when(F.col("at") == -1, F.col("place"))).over(same_key))
               .withColumn("longer", F.min(F.when(F.col("at") >= 0, F.col("place"))).over(same_key))
               .withColumn("substituted", F.min("place").over(Window.partitionBy("key", "at")))
               .withColumn("partner", F.explode(F.array(
                   F.when(F.col("at") >= 0, F.col("substituted")),
                   F.when(F.col("at") >= 0, F.col("whole")),
                   F.when(F.col("at") == -1, F.col("longer")))))
               .filter(F.col("partner") < F.col("place"))
               .select("h1", "h2", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2")).distinct())

    def verify(batches):
        for batch in batches:
            keep = [within_one_edit(a, b) for a, b in zip(batch.column("line").to_pylist(), batch.column("other").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["h1", "h2"])

    other = lines.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("other"))
    pairs = partner.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).join(other, ["p1", "p2"])
    return map_batches(pairs.select("h1", "h2", "line", "other"), verify, "h1 long, h2 long").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """The documents with duplicate lines removed from their text; with
    ``counts`` also the columns _n_lines and _n_kept (0 for a null text)."""
    docs = docs.withColumn(text, F.col(text).cast("string"))
    line = F.btrim(F.col("line"), F.lit(_BLANK))
    n = F.length("line")
    seen = (docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("digest"),
                        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
            .withColumn("line", line).filter(n > 0)
            .select("doc", "digest", F.col("line_no").cast("long").alias("line_no"),
                    F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
                    *[F.when(n >= MIN_CHARS, k).alias(f"k{i}") for i, k in enumerate(_half_keys(F.col("line"), n))]))
    halves = [f"k{i}" for i in range(4)]
    distinct = materialize(
        seen.groupBy("h1", "h2", *halves).agg(F.min(F.struct("doc", "digest", "line_no")).alias("place"))
        .select("h1", "h2", *halves, "place.*"), "op7-lines")
    by_half = distinct.filter("k0 IS NOT NULL").select("h1", "h2", F.explode(F.array(*halves)).alias("k"))
    shared = materialize(by_half.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
                         .filter("a <> b").select("k"), "op7-shared")
    near = by_half.join(bounded_broadcast(shared, BROADCAST_ROWS), "k", "left_semi").select("h1", "h2").distinct()
    near = distinct.select("h1", "h2", "doc", "digest", "line_no").join(
        bounded_broadcast(materialize(near, "op7-near"), BROADCAST_ROWS), ["h1", "h2"], "left_semi")
    lines = materialize(_wanted_lines(docs, near, key, text), "op7-texts")
    gone = materialize(near_lines(lines), "op7-gone")
    kept = (distinct.select("h1", "h2", "doc", "digest", "line_no")
            .join(bounded_broadcast(gone, BROADCAST_ROWS), ["h1", "h2"], "left_anti")
            .groupBy("doc", "digest").agg(F.collect_list("line_no").alias("_keep")))
    return _keep_lines(docs, kept, key, text, counts)


def _keep_lines(docs: DataFrame, kept: DataFrame, key: str, text: str, counts: bool) -> DataFrame:
    doc_, digest_, d_, g_, keep_ = fresh(docs.columns, "_doc", "_digest", "_d", "_g", "_keep")
    if counts:  # the counts replace columns of their names
        docs = docs.drop("_n_lines", "_n_kept")
    rows = docs.withColumn(doc_, F.col(key).cast("long")).withColumn(digest_, F.xxhash64(F.col(text)))
    kept = kept.select(F.col("doc").alias(d_), F.col("digest").alias(g_), F.col("_keep").alias(keep_))
    same = F.col(doc_).eqNullSafe(F.col(d_)) & (F.col(digest_) == F.col(g_))
    joined = rows.join(kept, same, "left").select(*docs.columns, keep_)
    schema = StructType(list(docs.schema))
    own = set(docs.columns)
    if counts:
        schema = schema.add("_n_lines", LongType()).add("_n_kept", LongType())

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, chars_of=text):
            texts, total, stay = [], [], []
            for value, keep in zip(batch.column(text).to_pylist(), batch.column(keep_).to_pylist()):
                lines = [] if value is None else value.split("\n")
                keep = set(keep or ())
                out = [x for i, x in enumerate(lines) if i in keep or not x.strip(_BLANK)]
                texts.append(None if value is None else "\n".join(out))
                total.append(len(lines))
                stay.append(len(out))
            columns = [pa.array(texts, f.type) if f.name == text else batch.column(f.name) if f.name in own
                       else pa.array(total if f.name == "_n_lines" else stay, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_batches(joined, run, schema)
