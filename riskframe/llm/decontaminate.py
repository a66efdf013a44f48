"""Benchmark decontamination with suffix arrays over the training text.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Each
task cuts its documents into shards of whole documents (about ``SHARD_WORDS``
words), sorts every word position of a shard by the words that follow it (a
suffix array, by prefix doubling up to the window length) and binary-searches
every suffix of the test items in it. Matching windows that continue each
other are joined to longest verbatim matches (item, place in the item, place
in the document, words). Nothing is shuffled: the documents are read once.

The items are held by every task only in blocks of at most about
``BLOCK_BYTES`` bytes of text; a larger test set passes the documents through
one search for each block.

A window is ``window`` consecutive item words; an item of fewer words, but not
none, is one window. Defined results: null or empty texts have no words and no
matches; items with a null id, null text or no words match nothing; items that
share an id count as one; repeated rows are ordinary rows; without items
nothing matches. Other columns of the documents pass through unread; the added
column is named by ``out`` and replaces one of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from riskframe.llm.common import fresh, map_batches, slices

WINDOW = 10
SHARD_WORDS = 500_000
BLOCK_BYTES = 16 << 20

_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))

MATCH = StructType().add("item_id", LongType()).add("item_word", LongType()).add(
    "doc_word", LongType()).add("n_words", LongType())
FOUND = StructType().add("n_words", LongType()).add("n_hit", LongType()).add("matches", ArrayType(MATCH))


def words_of(utf8: bytes | None) -> list[bytes]:
    return utf8.translate(_WORD_BYTES).split() if utf8 else []


class Windows:
    """The distinct test windows and where each stands in the items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        places: dict[tuple[bytes, ...], dict[tuple[int, int], None]] = {}
        for item_id, utf8 in items:
            words = words_of(utf8)
            n = min(window, len(words))
            for at in range(len(words) - n + 1 if n else 0):
                places.setdefault(tuple(words[at:at + n]), {})[item_id, at] = None
        self.windows = list(places)
        self.places = [np.array(list(p), np.int64).reshape(-1, 2) for p in places.values()]


class SuffixArray:
    """Word positions of a shard ordered by their next ``depth`` words."""

    def __init__(self, codes: np.ndarray, n_codes: int, depth: int) -> None:
        self.bits = max(1, int(n_codes).bit_length())
        self.step = 3 if 3 * self.bits <= 62 else 1
        padded = np.concatenate([codes, np.zeros(depth + self.step, np.int64)])
        n = len(codes)
        key = padded[:n + depth].copy()
        for k in range(1, self.step):
            key = (key << self.bits) | padded[k:n + depth + k]
        self.key, self.n = key, n  # the first ``step`` words at every position
        order = np.argsort(key[:n])
        self.order = order
        have = self.step
        sorted_key = key[order]
        self.sorted_key = sorted_key
        while have < depth and n:
            first = np.empty(n, bool)
            first[0] = True
            np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:])
            group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            rank = np.zeros(n + have, np.int64)
            rank[order] = group + 1
            tied = ~first
            tied[:-1] |= tied[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            sub = (group[slots] << 32) | rank[order[slots] + have]
            again = np.argsort(sub)
            order[slots] = order[slots][again]
            sorted_key = group << 32
            sorted_key[slots] = sub[again]
            have *= 2

    def find(self, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that begin with each row of ``test``
        (word codes; all rows of one length)."""
        length = test.shape[1]
        parts = []  # (offset, shift, packed words)
        for at in range(0, length, self.step):
            take = min(self.step, length - at)
            packed = np.zeros(len(test), np.int64)
            for k in range(take):
                packed = (packed << self.bits) | test[:, at + k]
            parts.append((at, self.bits * (self.step - take), packed))
        first = self.sorted_key >> parts[0][1] if parts[0][1] else self.sorted_key
        low = np.searchsorted(first, parts[0][2], "left")
        high = np.searchsorted(first, parts[0][2], "right")
        if len(parts) > 1:
            live = np.flatnonzero(low < high)
            a, b = low[live], high[live]
            low[live] = self._bound(parts[1:], live, a, b, False)
            high[live] = self._bound(parts[1:], live, a, b, True)
        return low, high

    def _bound(self, parts, live, a, b, upper: bool) -> np.ndarray:
        a, b = a.copy(), b.copy()
        going = np.arange(len(live))
        while len(going):
            mid = (a[going] + b[going]) >> 1
            at = self.order[mid]
            less = np.zeros(len(going), bool)
            equal = np.ones(len(going), bool)
            for offset, shift, packed in parts:
                got, want = self.key[at + offset] >> shift, packed[live[going]]
                less |= equal & (got < want)
                equal &= got == want
            right = less | equal if upper else less
            a[going] = np.where(right, mid + 1, a[going])
            b[going] = np.where(right, b[going], mid)
            going = going[a[going] < b[going]]
        return a


def search_shard(texts: list[list[bytes]], wanted: Windows) -> list[tuple[int, list[tuple]]]:
    """For each document (its words): words hit, and its longest matches."""
    codes_of: dict[bytes, int] = {b"": 0}
    flat, starts = [], []
    for words in texts:
        starts.append(len(flat))
        flat += words
        flat.append(b"")  # no window crosses two documents
    codes = np.empty(len(flat), np.int64)
    for i, w in enumerate(flat):
        code = codes_of.get(w)
        if code is None:
            code = codes_of[w] = len(codes_of)
        codes[i] = code
    depth = max((len(w) for w in wanted.windows), default=0)
    found = [(0, [])] * len(texts)
    if not depth or len(flat) == len(texts):
        return found
    array = SuffixArray(codes, len(codes_of), depth)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(wanted.windows):
        if all(x in codes_of for x in w):
            by_length.setdefault(len(w), []).append(i)
    hits = []  # item, diagonal, place in the shard, words
    for length, which in by_length.items():
        test = np.array([[codes_of[x] for x in wanted.windows[i]] for i in which], np.int64)
        low, high = array.find(test)
        for k in np.flatnonzero(low < high):
            at = array.order[low[k]:high[k]]
            for item, place in wanted.places[which[k]]:
                hits.append(np.stack([np.full(len(at), item), at - place, at, np.full(len(at), length)]))
    if not hits:
        return found
    item, diagonal, at, length = np.concatenate(hits, axis=1)
    order = np.lexsort((at, diagonal, item))
    item, diagonal, at, length = item[order], diagonal[order], at[order], length[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + length[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    run_at, run_end = at[first], at[last] + length[last]
    starts_of = np.array(starts)
    doc = np.searchsorted(starts_of, run_at, "right") - 1
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, run_at, 1)
    np.add.at(edge, run_end, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    out: dict[int, list[tuple]] = {}
    for d, i, g, a, e in zip(doc.tolist(), item[first].tolist(), diagonal[first].tolist(),
                             run_at.tolist(), run_end.tolist()):
        out.setdefault(d, []).append((i, a - g, a - starts[d], e - a))
    for d, matches in out.items():
        end = starts[d] + len(texts[d])
        found[d] = (int(covered[end] - covered[starts[d]]), sorted(matches))
    return found


def _search_block(docs: DataFrame, items: list[tuple[int, bytes]], window: int, text: str,
                  out: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)  # at most about BLOCK_BYTES of text
    keep = [f for f in docs.schema if f.name != out]
    schema = StructType(list(keep)).add(out, FOUND)
    previous = any(f.name == out for f in docs.schema)

    def run(batches):
        arrow = to_arrow_schema(schema)
        wanted = Windows(shared.value, window)
        waiting: list[tuple[pa.RecordBatch, list[list[bytes]]]] = []

        def done():
            texts = [t for _, ts in waiting for t in ts]
            found = iter(search_shard(texts, wanted))
            for batch, ts in waiting:
                got = [{"n_words": len(t), "n_hit": h, "matches": [
                    {"item_id": i, "item_word": p, "doc_word": d, "n_words": n} for i, p, d, n in m]}
                    for t, (h, m) in zip(ts, found)]
                if previous:  # another block has searched before
                    for g, old in zip(got, batch.column(out).to_pylist()):
                        g["matches"] += old["matches"]
                        g["n_hit"] = _union(g["matches"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in keep] + [pa.array(got, arrow.field(out).type)], schema=arrow)
            waiting.clear()

        total = 0
        for batch in slices(batches, chars_of=text):
            raw = batch.column(text)
            ts = [words_of(x.encode("utf-8") if isinstance(x, str) else x) for x in raw.to_pylist()]
            waiting.append((batch, ts))
            total += sum(map(len, ts))
            if total >= SHARD_WORDS:
                yield from done()
                total = 0
        if waiting:
            yield from done()

    return map_batches(docs, run, schema)


def _union(matches: list[dict]) -> int:
    total, end = 0, -1
    for at, stop in sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in matches):
        total += max(0, stop - max(at, end))
        end = max(end, stop)
    return total


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", out: str = "contamination") -> DataFrame:
    """The documents with a column ``out``: n_words, n_hit (words inside any
    occurrence of a window), matches (longest, with locations)."""
    tests = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).cast("string").cast("binary").alias("t"))
    tests = tests.filter("k IS NOT NULL AND t IS NOT NULL")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = docs.drop(out)
    for block in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block)
        docs = _search_block(docs, [(r.k, bytes(r.t)) for r in part.collect()], window, text, out)
    return docs


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no test window occurs, with their own columns."""
    out, = fresh(docs.columns, "_contamination")
    found = find_matches(docs, items, window, out=out)
    return found.filter(F.col(out)["n_hit"] == 0).select(*docs.columns)


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
