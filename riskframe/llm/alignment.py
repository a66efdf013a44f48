"""Alignment of two tokenizers over a corpus, by external spill counting.

Both tokenizers cut the same bytes (a space and the text). Two token
occurrences are linked when their byte ranges overlap; byte offsets where both
end a token cut the text into groups. The tokens of each side cover the bytes
without gap, so every interval between neighbouring ends of either side is
exactly one link, and a whole slice of documents is aligned as one sequence.

1. *Runs.* Each slice of documents gives its (pair, document, links) records,
   sorted side-major (id of A, id of B, document), radix-partitioned by the id
   of A and packed into one zstd run for each radix: the distinct pairs with
   their number of documents, and apart from them the documents and links.
2. *Counting.* Only the pair lists are shuffled. A task merges the runs of one
   radix with a heap over the runs' blocks, ``FAN_IN`` at a time, and adds up
   the documents of equal pairs; the merged run stays compressed. More than
   ``GROUP`` runs of a radix are merged in a tree of such groups. Side-major
   order has all pairs of an id of A together, so its highest count is known as
   soon as they are passed.
3. *Streaming back.* Runs are dealt by groups of slices, each group with every
   radix's counts before that radix's runs. A task adds each record's count to
   its document, slice by slice, and closes the group with the documents' rows.

Bounds: a run holds one slice (``SLICE_BYTES`` of text or one longer text), the
counts of a radix at most its pairs of ids, whatever the corpus. A hot id is
one pair list entry in each run, its documents stay with their slice.

Defined results: a null or empty text, and one whose tokens do not spell a space
and the text on both sides, has zeros and an empty digest and takes no part in
the counts; null and repeated keys and repeated rows are documents of their own;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType

from riskframe.llm.common import fields, slices
from riskframe.session import materialize

RADIX = 64
SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096
FAN_IN = 64  # runs merged at a time
GROUP = 512  # runs of a radix that one task merges
BLOCK = 1 << 16  # pairs of a run that are open in a merge
BACK_RUNS = 1024  # most slices of a group on the way back
_ID, _DOC = 20, 17  # bits of an id, of a document's number in its slice
_STATS = ("n_a", "n_b", "n_groups", "n_links")


# -- tokenizers ---------------------------------------------------------------

#: Split pattern of the byte-level tokenizer: a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here both libraries class characters alike (letters, digits, white space; tested one by one).
_COMMON = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteSide:
    """Side A: a byte-level BPE file of the ``tokenizers`` library.

    Texts of Latin characters are encoded with ``tiktoken`` on the same ranks,
    five times as fast; all others, and vocabularies whose ids are not the merge
    order, with ``tokenizers``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._slow, self._fast = path, None, None
        alphabet, model = byte_alphabet(), spec["model"]
        vocab = {t: i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*model["vocab"].values(), *added]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        for i, token in added.items():
            self.bytes[i] = token
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        in_order = all(vocab.get(m.replace(" ", "", 1)) == 256 + n for n, m in enumerate(merges))
        if spec["normalizer"] is None and spec["pre_tokenizer"] == {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and in_order:
            import tiktoken
            self._fast = tiktoken.Encoding("side", pat_str=BYTE_LEVEL, special_tokens={},
                                           mergeable_ranks={t: i for t, i in ranks.items() if i not in added})

    def _library(self):
        if self._slow is None:
            import os
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.no_truncation()
            self._slow.no_padding()
            self._slow.encode_special_tokens = True
        return self._slow

    def encode(self, texts: list[str]) -> list[list[int]]:
        out, hard = [None] * len(texts), []
        for i, text in enumerate(texts):
            if self._fast is None or _COMMON.search(text):
                hard.append(i)
            else:
                out[i] = self._fast.encode_ordinary(text)
        if hard:
            for i, found in zip(hard, self._library().encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)):
                out[i] = found.ids
        return out


class PieceSide:
    """Side B: a SentencePiece model; it adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size()) for p in (self.model.id_to_piece(i),)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Sides:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.len_a = np.array([len(t) for t in self.a.bytes], np.int64)
        self.len_b = np.array([len(t) for t in self.b.bytes], np.int64)
        self.text = np.array([f"{i}{end}" for n, ends in ((len(self.len_a), ",|"), (len(self.len_b), ",;"))
                              for end in ends for i in range(n)], object)  # a, a| b, b;
        self.of_b = 2 * len(self.len_a)


_SIDES: dict = {}


def sides_of(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


# -- runs ---------------------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers as zstd-compressed byte planes."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c, "<i8")
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        parts += [len(c).to_bytes(8, "little"), bytes([width]), c.view(np.uint8).reshape(-1, 8).T[:width].tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at:at + 8], "little"), raw[at + 8]
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(planes.reshape(-1).view("<i8"))
        at += 9 + n * width
    return out


def pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=0), *columns)


def unpack_sorted(blob: bytes) -> list[np.ndarray]:
    keys, *columns = unpack(blob)
    return [np.cumsum(keys), *columns]


def align(sides: Sides, texts: list[str | None]) -> tuple[dict, list[tuple]]:
    """Per-document numbers and digests of a slice, and a run (radix, pairs, documents) for each radix."""
    n = len(texts)
    given = [i for i, t in enumerate(texts) if t]
    ids_a = sides.a.encode([" " + texts[i] for i in given])
    ids_b = sides.b.encode([texts[i] for i in given])
    good = []
    for i, a, b in zip(given, ids_a, ids_b):
        spelled = (" " + texts[i]).encode()
        if b"".join(map(sides.a.bytes.__getitem__, a)) == spelled == b"".join(map(sides.b.bytes.__getitem__, b)):
            good.append((i, a, b))
    stats = {name: np.zeros(n, np.int64) for name in _STATS} | {"sha": [""] * n}
    if not good:
        return stats, []
    docs = np.array([g[0] for g in good])
    size_a, size_b = (np.array([len(g[s]) for g in good]) for s in (1, 2))
    stats["n_a"][docs], stats["n_b"][docs] = size_a, size_b
    a, b = (np.fromiter((x for g in good for x in g[s]), np.int64, int(sizes.sum())) for s, sizes in ((1, size_a), (2, size_b)))
    end_a, end_b = np.cumsum(sides.len_a[a]), np.cumsum(sides.len_b[b])
    mark = np.zeros(int(end_a[-1]) + 1, np.uint8)
    mark[end_a] = 1
    mark[end_b] += 2
    ends = mark[np.flatnonzero(mark)]  # one for each link: the side(s) that end there
    in_a, in_b, cut = (ends & 1).astype(np.int64), (ends >> 1).astype(np.int64), ends == 3
    of_a, of_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    group = np.cumsum(cut) - cut
    doc = np.repeat(docs, size_a)[of_a]
    stats["n_links"] += np.bincount(doc, minlength=n)
    stats["n_groups"] += np.bincount(doc[cut], minlength=n)
    _digests(sides, stats["sha"], docs, a, b, group[in_a == 1], group[in_b == 1], size_a, size_b)
    # records, radix by radix, side-major within
    la, lb = a[of_a], b[of_b]
    code = ((((la % RADIX) << _ID | la // RADIX) << _ID | lb) << _DOC) | doc
    code, links = np.unique(code, return_counts=True)
    pair, doc = code >> _DOC, code & ((1 << _DOC) - 1)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    radix = pair[first] >> (2 * _ID)
    runs, cuts = [], np.flatnonzero(np.diff(radix, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(first)]):
        start, stop = first[lo], first[hi] if hi < len(first) else len(pair)
        keys, held = pair[first[lo:hi]], np.diff(np.append(first[lo:hi], stop))
        runs.append((int(radix[lo]), pack_sorted(keys & ((1 << 2 * _ID) - 1), held), pack(doc[start:stop], links[start:stop])))
    return stats, runs


def _digests(sides: Sides, out: list[str], docs, a, b, group_a, group_b, size_a, size_b) -> None:
    """SHA-256 of every document's groups, written ``a1,a2|b1;...``."""
    upto_a, upto_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    place_a = np.arange(len(a)) + upto_b[group_a] - np.bincount(group_b)[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a] = a + len(sides.len_a) * (np.arange(1, len(a) + 1) == upto_a[group_a])
    order[place_b] = sides.of_b + b + len(sides.len_b) * (np.arange(1, len(b) + 1) == upto_b[group_b])
    stops = np.cumsum(size_a + size_b)
    for i, start, stop in zip(docs, np.append(0, stops[:-1]), stops):
        written = "".join(sides.text[order[start:stop]].tolist())
        out[i] = hashlib.sha256(written[:-1].encode()).hexdigest()


def merge_runs(runs: list[bytes]) -> bytes:
    """One run of all: the sums of equal pairs, merged block by block in pair order.

    The heap holds the last pair of every run's open block; all that is not
    above the least of them is complete in the open blocks and leaves at once.
    """
    held = [unpack_sorted(r) for r in runs]
    at, upto = [0] * len(held), [min(BLOCK, len(k)) for k, _ in held]
    heap = [(int(k[u - 1]), r) for r, ((k, _), u) in enumerate(zip(held, upto)) if u]
    heapq.heapify(heap)
    out_keys, out_counts = [], []
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for _, r in heap:
            k, c = held[r]
            stop = at[r] + int(np.searchsorted(k[at[r]:upto[r]], bound, "right"))
            keys.append(k[at[r]:stop])
            counts.append(c[at[r]:stop])
            at[r] = stop
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        out_keys.append(keys[first])
        out_counts.append(np.add.reduceat(counts, first))
        while heap and heap[0][0] == bound:  # their blocks are used up: open the next
            _, r = heapq.heappop(heap)
            if at[r] < len(held[r][0]):
                upto[r] = min(at[r] + BLOCK, len(held[r][0]))
                heapq.heappush(heap, (int(held[r][0][upto[r] - 1]), r))
    if not out_keys:
        return pack_sorted(np.empty(0, np.int64), np.empty(0, np.int64))
    return pack_sorted(np.concatenate(out_keys), np.concatenate(out_counts))


def highest(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each pair's count is the highest of its id of A (ties included)."""
    if not len(keys):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(keys >> _ID, prepend=-1))
    best = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
    return (counts == best).astype(np.int64)


def _grouped(batches, *columns: str):
    """(value of the columns, rows as dicts one by one) of sorted batches, streaming."""
    from itertools import groupby
    rows = (row for batch in slices(batches, rows=16) for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[c] for c in columns))


# -- stages -------------------------------------------------------------------

def spill_runs(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """Run rows (run, radix, pairs, docs) and, with radix = RADIX, the documents of each run."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = _run_schema(rows.schema["key"].dataType)

    def run(batches):
        arrow, sides = to_arrow_schema(schema), sides_of(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, rows=SLICE_ROWS, chars_of="text", max_bytes=SLICE_BYTES):
            stats, runs = align(sides, batch.column("text").to_pylist())
            m = len(runs) + 1
            columns = [[number] * m, [r[0] for r in runs] + [RADIX], [r[1] for r in runs] + [None],
                       [r[2] for r in runs] + [None], [None] * (m - 1) + [batch.column("key").to_pylist()]]
            columns += [[None] * (m - 1) + [list(stats[s])] for s in (*_STATS, "sha")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            number += 1

    return rows.mapInArrow(run, schema)


def _run_schema(key_type: DataType) -> StructType:
    return fields(run="long", radix="int", pairs="binary", docs="binary", keys=ArrayType(key_type),
                  **{name: "long[]" for name in _STATS}, sha="string[]")


def count_pairs(runs: DataFrame, n_runs: int) -> DataFrame:
    """(radix, pairs): for each radix one run of all pairs, their counts and whether they are the highest."""
    merged = "radix int, part long, pairs binary"

    def merge(batches):
        for (radix, part), rows in _grouped(batches, "radix", "part"):
            held: list[bytes] = []
            for row in rows:
                held.append(row["pairs"])
                if len(held) == FAN_IN:
                    held = [merge_runs(held)]
            yield pa.RecordBatch.from_pydict({"radix": pa.array([radix], pa.int32()), "part": pa.array([part], pa.int64()),
                                              "pairs": pa.array([merge_runs(held)], pa.binary())})

    def close(batches):
        for batch in merge(batches):
            keys, counts = unpack_sorted(batch.column("pairs")[0].as_py())
            yield pa.RecordBatch.from_pydict({"radix": batch.column("radix"), "pairs": pa.array(
                [pack_sorted(keys, counts, highest(counts, keys))], pa.binary())})

    level, parts = runs.filter(F.col("radix") < RADIX).select("radix", "run", "pairs"), max(1, math.ceil(n_runs / GROUP))
    part = F.pmod(F.xxhash64("run"), F.lit(parts))
    level = level.select("radix", part.alias("part"), "pairs")
    while True:
        sorted_ = level.repartition("radix", "part").sortWithinPartitions("radix", "part")
        if parts == 1:
            return sorted_.mapInArrow(close, "radix int, pairs binary")
        parts = math.ceil(parts / GROUP)
        level = sorted_.mapInArrow(merge, merged).withColumn("part", F.pmod("part", F.lit(parts)))


def stream_back(runs: DataFrame, counts: DataFrame, n_runs: int, key_type: DataType) -> DataFrame:
    """(key, numbers, n_best, count_sum, sha) of every document."""
    spark = runs.sparkSession
    groups = max(math.ceil(n_runs / BACK_RUNS), min(math.ceil(n_runs / 8), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    schema = fields(key=key_type, **{name: "long" for name in (*_STATS, "n_best", "count_sum")}, sha="string")

    def back(batches):
        arrow = to_arrow_schema(schema)
        for _, rows in _grouped(batches, "part"):
            sums: dict[int, np.ndarray] = {}  # run -> (count_sum, n_best) of its documents
            keys = counts = best = None
            for row in rows:
                if row["run"] is None:
                    keys, counts, best = unpack_sorted(row["pairs"])
                elif row["radix"] < RADIX:
                    pairs, held = unpack_sorted(row["pairs"])
                    doc, links = unpack(row["docs"])
                    at = np.repeat(np.searchsorted(keys, pairs), held)
                    total = sums.setdefault(row["run"], np.zeros((2, SLICE_ROWS), np.int64))
                    np.add.at(total[0], doc, counts[at] * links)
                    np.add.at(total[1], doc, best[at] * links)
                else:
                    n = len(row["keys"])
                    total = sums.pop(row["run"], np.zeros((2, n), np.int64))[:, :n]
                    columns = [row["keys"], *(row[s] for s in _STATS), total[1], total[0], row["sha"]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    part = F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int")
    each = counts.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "radix", "pairs")
    dealt = runs.withColumn("part", part).unionByName(each, allowMissingColumns=True)
    # nulls first: a radix's counts stand before its runs, the documents last
    return dealt.repartition("part").sortWithinPartitions("part", "radix", "run").mapInArrow(back, schema)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    runs = materialize(spill_runs(docs, path_a, path_b, key, text), "op12-runs")
    n_runs = runs.filter(F.col("radix") == RADIX).count()
    counts = materialize(count_pairs(runs, n_runs), "op12-counts")
    found = stream_back(runs, counts, n_runs, docs.schema[key].dataType)
    return found.withColumnsRenamed({"key": key, "sha": "groups_sha256"})
