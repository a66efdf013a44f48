"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``CHUNK`` + ``OVERLAP`` characters is cut at the white space
among its stable positions (below), and each distinct segment is encoded once in
a task (a memo of at most ``MEMO`` segments). A longer one is cut into chunks that overlap, the chunks are spread over the
cluster and encoded with offsets, and neighbours are spliced at a boundary
that both encodings have in the overlap:

1. Only *stable* positions count: places where the encoding of what follows is
   proven not to depend on what stands before (and the other way round).
2. Both encodings must have a token boundary there, and the same token ids
   from there to the next stable position.

Where the overlap of two neighbours holds no such boundary, the document is
cut again with overlaps ``WIDEN`` times as wide, until it aligns; an overlap as
long as the text is the text encoded whole, so this ends.

Why the positions of ``STABLE`` are stable for a tokenizer of ``PROVEN``
(composition, white space to one blank, lower case; then the split pattern):

* the character after the position is ASCII (after white space also a Latin
  letter up to U+024F), a starter that never composes with what is before it, so
  normalisation works on each side alone;
* no match of the split pattern, and no added token (``<|...|>``, letters
  between bars), holds white space or a digit beside another character, so none
  spans a position after one of them; a letter followed by punctuation other
  than a bar ends its match likewise;
* the pattern looks neither back nor ahead, so matching starts anew there, and
  merges never leave a match.

For another tokenizer a caller names its own ``stable`` pattern.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null and
repeated keys and repeated rows each keep their row; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from riskframe.llm.common import fields, slices
from riskframe.session import materialize

CHUNK = 65_536  # characters of a chunk without its overlap
OVERLAP = 1_024
WIDEN = 4
CANDIDATES = 16  # stable positions compared in the middle of an overlap

MEMO = 400_000

#: White space before a stable position; it has no tokens itself.
SEPARATOR = "[ \t\n\r]+(?=[!-~À-ɏ])"
#: Zero-width: after white space, after a digit, or between a letter and punctuation but a bar.
STABLE = "(?<=[ \t\n\r])(?=[!-~À-ɏ])" r"|(?<=[0-9])(?=[\t\n\r -~])|(?<=[A-Za-z])(?=[!-/:-@\[-`{}~])"

#: Normaliser and pre-tokenizer for which STABLE is proven: fixed values of the tokenizer file.
PROVEN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_ADDED = re.compile(r"<\|[a-z]+\|>")

_TOKENIZERS: dict = {}


def tokenizer_of(path: str):
    """The tokenizer of a file, read once in a process; no truncation, no padding."""
    if path not in _TOKENIZERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _TOKENIZERS[path] = found
    return _TOKENIZERS[path]


def check_proven(path: str) -> None:
    """Raise unless STABLE is proven for the tokenizer of this file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    odd = [k for k, v in PROVEN.items() if spec.get(k) != v]
    odd += [t["content"] for t in spec.get("added_tokens", []) if not _ADDED.fullmatch(t["content"]) or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"no stable positions are proven for {path} ({', '.join(odd)}): name a stable pattern")


def _boundaries(text: str, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray,
                at: int, stable: re.Pattern) -> list[dict]:
    """The stable positions in the middle of text[lo:hi], each with the number of
    tokens before it (-1: not a token boundary) and a digest of the ids up to the next."""
    places = [m.start() for m in stable.finditer(text, lo + 1, hi - 1)]
    first = max(0, (len(places) - CANDIDATES - 1) // 2)
    places = places[first:first + CANDIDATES + 1]
    before = np.searchsorted(starts, places, "left")
    out = []
    for k in range(len(places) - 1):
        n, m = int(before[k]), int(before[k + 1])
        clean = (n == 0 or ends[n - 1] <= places[k]) and (m == 0 or ends[m - 1] <= places[k + 1])
        out.append({"p": at + places[k], "n": n if clean else -1,
                    "seg": xxhash.xxh3_64_intdigest(ids[n:m].tobytes()) >> 1})
    return out


def _chunks(batches, chunk: int, overlap: int, schema: StructType):
    """Rows (key, digest, n_bytes, part, parts, at, before, after, text) of every long text."""
    arrow = to_arrow_schema(schema)
    for batch in slices(batches, rows=64, chars_of="text"):
        for key, digest, n_bytes, text in zip(batch.column("key"), *(batch.column(c).to_pylist() for c in ("digest", "n_bytes", "text"))):
            whole = overlap >= len(text)
            parts = 1 if whole else -(-len(text) // chunk)
            for part in range(parts):
                at = part * chunk
                end = len(text) if whole else min(len(text), at + chunk + overlap)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key.as_py()], arrow.field("key").type), pa.array([digest]), pa.array([n_bytes], pa.int64()),
                    pa.array([part], pa.int32()), pa.array([parts], pa.int32()), pa.array([at], pa.int64()),
                    pa.array([overlap if part else 0], pa.int64()),
                    pa.array([chunk if part < parts - 1 else -1], pa.int64()), pa.array([text[at:end]])], schema=arrow)


def _spliced(long: DataFrame, path: str, chunk: int, overlap: int, stable: str) -> DataFrame:
    """(key, digest, n_bytes, copies, n_tokens, failed) of every distinct (key, text)."""
    key_type = long.schema["key"].dataType
    cut = fields(key=key_type, digest="string", n_bytes="long", part="int", parts="int", at="long", head="long", tail="long", text="string")
    edge = ArrayType(fields(p="long", n="long", seg="long"))
    encoded = fields(key=key_type, digest="string", n_bytes="long", part="int", parts="int", n="long", head=edge, tail=edge)

    def encode(batches):
        arrow, pattern, tokenizer = to_arrow_schema(encoded), re.compile(stable), tokenizer_of(path)
        for batch in slices(batches, rows=64, chars_of="text"):
            ns, heads, tails = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "at", "head", "tail"))
            for text, at, head, tail in zip(*columns):
                found = tokenizer.encode(text, add_special_tokens=False)
                ids = np.array(found.ids, np.int64)
                spans = np.array(found.offsets, np.int64).reshape(-1, 2)
                shared = (spans[:, 0], spans[:, 1], ids, at, pattern)
                ns.append(len(ids))
                heads.append(_boundaries(text, 0, min(head, len(text)), *shared) if head else [])
                tails.append(_boundaries(text, tail, len(text), *shared) if tail >= 0 else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("key", "digest", "n_bytes", "part", "parts")]
                + [pa.array(ns, pa.int64()), pa.array(heads, arrow.field("head").type), pa.array(tails, arrow.field("tail").type)],
                schema=arrow)

    spread = long.mapInArrow(lambda b: _chunks(b, chunk, overlap, cut), cut).repartition("key", "digest", "part")
    # copies of a row are encoded alike: one of them stands for all
    rows = (spread.mapInArrow(encode, encoded).groupBy("key", "digest", "part")
            .agg(F.first(F.struct("n_bytes", "parts", "n", "head", "tail")).alias("c"), F.count(F.lit(1)).alias("copies"))
            .select("key", "digest", "part", "c.*", "copies"))
    document = Window.partitionBy("key", "digest").orderBy("part")
    seams = F.filter(F.arrays_zip(F.lag("tail").over(document).alias("left"), F.col("head").alias("right")),
                     lambda z: (z["left"]["p"] == z["right"]["p"]) & (z["left"]["seg"] == z["right"]["seg"])
                     & (z["left"]["n"] >= 0) & (z["right"]["n"] >= 0))
    seam = F.when(F.size(seams) > 0, F.element_at(seams, 1))
    rows = rows.withColumn("seam", F.when(F.col("part") > 0, seam))
    # a chunk's tokens run from its seam with the last chunk to its seam with the next
    own = F.col("n") - F.coalesce(F.col("seam.right.n"), F.lit(0)) - F.coalesce(F.col("n_before") - F.col("seam.left.n"), F.lit(0))
    rows = rows.withColumn("n_before", F.lag("n").over(document))
    return rows.groupBy("key", "digest").agg(
        F.first("n_bytes").alias("n_bytes"), F.first("copies").alias("copies"), F.sum(own).alias("n_tokens"),
        F.max((F.col("part") > 0) & F.col("seam").isNull()).alias("failed"))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP, stable: str | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row, as the tokenizer of ``path`` encodes the whole text."""
    proven = stable is None
    if proven:
        check_proven(path)
        stable = STABLE
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.length("text") > chunk + overlap
    counted = fields(key=rows.schema["key"].dataType, n_bytes="long", n_tokens="long")

    def whole(batches):
        arrow, tokenizer = to_arrow_schema(counted), tokenizer_of(path)
        separator, memo = re.compile(SEPARATOR) if proven else None, {}
        for batch in slices(batches, chars_of="text", max_bytes=2 << 20):
            texts = batch.column("text").to_pylist()
            segments = [separator.split(t) for t in texts] if proven else [[t] for t in texts]
            distinct = set(chain.from_iterable(segments))
            if len(memo) > MEMO or not proven:
                memo.clear()
            new = [x for x in distinct if x not in memo]
            memo.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False))))
            totals = [sum(map(memo.__getitem__, found)) for found in segments]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(totals, pa.int64())], schema=arrow)

    out = rows.filter(~is_long).mapInArrow(whole, counted)
    long = rows.filter(is_long).withColumn("digest", F.md5("text"))
    while True:
        spliced = materialize(_spliced(long, path, chunk, overlap, stable), "op11-spliced")
        done = spliced.filter("NOT failed").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        out = out.unionByName(done.select("key", "n_bytes", "n_tokens"))
        failed = spliced.filter("failed").select(F.col("key").alias("k"), F.col("digest").alias("d"))
        if failed.isEmpty():
            return out.withColumnRenamed("key", key)
        overlap *= WIDEN
        long = long.join(failed, long["key"].eqNullSafe(failed["k"]) & (long["digest"] == failed["d"]), "left_semi")
