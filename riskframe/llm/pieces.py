"""SentencePiece encoding by forward-filtering backward-sampling, and decoding.

All segmentations of a text into pieces form a lattice. With piece weights
p(piece)^alpha, the forward pass sums the weight of all segmentations of every
prefix; the backward pass draws the last piece in proportion to prefix sum
times weight, and so on to the front: an exact sample of a segmentation. The
draws come from a counter-based generator seeded by the row key, so a row gets
the same pieces in any task, batch or cluster.

No piece crosses certain places (before a space that follows a non-space; around
characters that only occur as pieces of their own), so the lattice of a text is
a chain of independent units; equal units of a batch share one forward pass,
and all units of a batch are drawn together in numpy.

Weights: a unigram model's own log probabilities; a BPE model has ranks instead,
and weight 1 / (rank + ``RANK_OFFSET``) is used.

Decoding is lossless for every text: a space mark is put in front and removed
again, a literal U+2581 and all characters without a piece are written as
UTF-8 byte pieces. The model file is a parameter and read on the driver; its
piece table (bounded by the vocabulary) is shipped to the tasks.

Defined results: a null text has null ids; an empty text has the ids of the
single space mark; a null key seeds as its own value; repeated rows get equal
ids; lone surrogates cannot occur in Spark strings. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from riskframe.llm.common import fresh, map_batches, slices

ALPHA = 1.0
RANK_OFFSET = 10
BATCH_BYTES = 1 << 18
SPACE = "▁"
LITERAL = "\0" + SPACE  # no unit of a text begins so: a mark follows its own kind alone


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceTable:
    """Pieces with their log weights, bytes and the places no piece crosses."""

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        """``pieces``: (text, log weight, kind), kind one of normal, byte, other."""
        self.ids: dict[str, int] = {}
        self.weights = np.array([w for _, w, _ in pieces])
        self.byte_ids = [-1] * 256
        self.raw: list[bytes] = [b""] * len(pieces)
        joined: set[str] = set()
        for i, (text, _, kind) in enumerate(pieces):
            if kind == "byte":
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                self.raw[i] = bytes([value])
            elif kind == "normal":
                body = text.lstrip(SPACE)
                if SPACE in body:
                    continue  # would cross a cut; decoding never meets it
                self.ids[text] = i
                self.raw[i] = text.replace(SPACE, " ").encode()
                if len(text) > 1:
                    joined |= set(body)
        self.suffixes = Suffixes(self.ids)
        inner = "".join(re.escape(c) for c in sorted(joined))
        self.units = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|.", re.DOTALL) if joined else re.compile(".", re.DOTALL)
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte pieces: decoding could not be lossless")


def load_pieces(model_file: str) -> list[tuple[str, float, str]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    scores = [model.get_score(i) for i in range(n)]
    kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i)
             or model.is_unused(i) else "normal" for i in range(n)]
    ranked = all(s == int(s) for s in scores)  # BPE: minus the rank of the merge
    return [(model.id_to_piece(i), -float(np.log(RANK_OFFSET - scores[i])) if ranked else float(scores[i]), k)
            for i, k in enumerate(kinds)]


class Suffixes:
    """All suffixes of all pieces by hash, to extend many substrings leftwards at once."""

    BITS = 20

    def __init__(self, ids: dict[str, int]) -> None:
        self.longest = max(map(len, ids))
        self.powers = np.cumprod(np.concatenate([[1], np.full(self.longest, 0x100000001B3)]).astype(np.uint64), dtype=np.uint64)
        letters = sorted(set("".join(ids)))
        mixed = dict(zip(letters, _mix(np.array([ord(c) + 1 for c in letters], np.uint64)).tolist()))
        powers = self.powers.tolist()
        known: dict[str, int] = {}
        hash_of: dict[str, int] = {"": 0}
        for text, i in ids.items():
            for at in range(len(text) - 1, -1, -1):
                suffix = text[at:]
                if suffix not in known:
                    known[suffix] = -1
                    hash_of[suffix] = (hash_of[text[at + 1:]] + mixed[text[at]] * powers[len(suffix) - 1]) % (1 << 64)
            known[text] = i
        texts = list(known)
        hashes = np.array([hash_of[t] for t in texts], np.uint64)
        self.hashes = np.concatenate([hashes, [np.uint64(0)]])
        self.piece = np.array([*known.values(), -1], np.int32)
        self.slots: list[np.ndarray] = []  # tables of suffix numbers; what collides goes to the next one
        left = np.arange(len(texts))
        while len(left):
            table = np.full(1 << self.BITS, len(texts), np.int32)
            slot = self._slot(hashes[left], len(self.slots))
            table[slot] = left
            self.slots.append(table)
            left = left[table[slot] != left]

    def _slot(self, hashes: np.ndarray, level: int) -> np.ndarray:
        return (((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The suffix number of each hash; the last number where there is none."""
        none = len(self.hashes) - 1
        out = np.full(len(hashes), none, np.int64)
        left = np.arange(len(hashes))
        for level, table in enumerate(self.slots):
            got = table[self._slot(hashes[left], level)]
            same = self.hashes[got] == hashes[left]
            out[left[same]] = got[same]
            left = left[~same & (got != none)]  # an empty slot ends the search
        return out


class Lattice:
    """The forward pass of many distinct units at once. Units are ranked by
    falling length; character e of the unit of rank r is at ``column[e] + r``."""

    def __init__(self, table: PieceTable, units: list[str], alpha: float) -> None:
        lengths = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(units), np.int64)
        self.rank[order] = np.arange(len(units))
        self.lengths = lengths
        down = lengths[order]
        longest, n = int(down[0]), int(down.sum())
        self.live = np.searchsorted(-down, -np.arange(1, longest + 1), "right")  # units with a character e
        self.column = np.concatenate([[0], np.cumsum(self.live)])
        text = "".join([units[i] for i in order])
        r = np.repeat(np.arange(len(down)), down)
        e = np.arange(n) - np.repeat(np.cumsum(down) - down, down)
        place = self.column[e] + r
        codes, ends, rank = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64)
        codes[place] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends[place], rank[place] = e, r
        mixed = _mix(codes + np.uint64(1))
        found = []  # by length: places and their pieces
        at, hashes = np.arange(n), mixed
        for size in range(1, table.suffixes.longest + 1):
            suffix = table.suffixes.find(hashes)
            piece = table.suffixes.piece[suffix]
            hit = piece >= 0
            found.append((at[hit], piece[hit]))
            on = (suffix < len(table.suffixes.hashes) - 1) & (ends[at] >= size)
            at = at[on]
            if not len(at):
                break
            hashes = hashes[on] + mixed[self.column[ends[at] - size] + rank[at]] * table.suffixes.powers[size]
        while len(found) > 1 and not len(found[-1][0]):
            found.pop()
        self.piece = np.full((n, len(found)), -1, np.int32)  # that ends at a character, by its length
        for size, (at, piece) in enumerate(found):
            self.piece[at, size] = piece
        weights = np.append(np.exp(alpha * table.weights), 0.0).astype(np.float32)
        share = weights[self.piece]
        bare = np.flatnonzero(self.piece[:, 0] < 0)
        if len(bare):  # a character without a piece: its bytes
            which, back = np.unique(codes[bare].astype(np.int64), return_inverse=True)
            ids = [[table.byte_ids[b] for b in chr(c).encode()] for c in which.tolist()]
            self.piece[bare, 0] = np.array([i[0] if len(i) == 1 else -2 - c for c, i in zip(which.tolist(), ids)])[back]
            share[bare, 0] = np.array([np.exp(alpha * table.weights[i].sum()) for i in ids])[back]
        self._forward(share)

    def _forward(self, share: np.ndarray) -> None:
        """Turn weights into cumulative shares of each last piece. ``sums`` holds the
        sums over all segmentations of the last prefixes, scaled by the latest one."""
        width = share.shape[1]
        sums = np.zeros((len(self.lengths), width))
        sums[:, 0] = 1.0
        for e in range(len(self.live)):
            sums = sums[:self.live[e]]
            here = slice(self.column[e], self.column[e + 1])
            terms = np.cumsum(share[here] * sums, axis=1)
            total = terms[:, -1:].copy()
            terms /= total
            share[here] = terms
            sums[:, 1:] = np.minimum(sums[:, :-1] / total, 1e280)
            sums[:, 0] = 1.0
        self.share = share

    def draw(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences in order, and how many each has."""
        rank, end = self.rank[unit], self.lengths[unit] - 1
        live = np.arange(len(unit))
        steps, counts = [], np.zeros(len(unit), np.int64)
        while len(live):
            turn = np.uint64((len(steps) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            u = (_mix(seed[live] + turn) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
            place = self.column[end[live]] + rank[live]
            size = (self.share[place] <= u[:, None]).sum(axis=1)
            steps.append((live, self.piece[place, size]))
            counts[live] += 1
            end[live] -= size + 1
            live = live[end[live] >= 0]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (who, piece) in enumerate(steps):
            out[ends[who] - 1 - k] = piece
        return out, counts


def encode_batch(table: PieceTable, texts: list[str | None], seeds: np.ndarray, alpha: float) -> list[np.ndarray | None]:
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    units, owners = [], []
    for i, text in enumerate(texts):
        if text is None:
            continue
        if SPACE not in text:
            found = table.units.findall(SPACE + text.replace(" ", SPACE))
        else:  # literal marks stay apart, as units that only bytes can write
            found = []
            for k, part in enumerate((" " + text).split(SPACE)):
                found += ([LITERAL] if k else []) + table.units.findall(part.replace(" ", SPACE))
        units.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        owners.append(i)
    out: list[np.ndarray | None] = [None] * len(texts)
    if not owners:
        return out
    literal = number.get(LITERAL)
    names = list(number)
    if literal is not None:
        names[literal] = "\0"  # drawn as one character, replaced by the mark's bytes below
    lattice = Lattice(table, names, alpha)
    lengths = np.array([len(u) for u in units])
    flat = np.concatenate(units)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    seed = _mix(np.repeat(seeds[owners], lengths) + inside.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    pieces, counts = lattice.draw(flat, seed)
    if literal is not None:
        pieces[np.cumsum(counts)[flat == literal] - 1] = -2 - ord(SPACE)
    if len(pieces) and pieces.min() < 0:  # characters of several bytes
        pieces, counts = _expand(table, pieces, counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    ends = bounds[np.cumsum(lengths)]
    for i, a, b in zip(owners, np.concatenate([[0], ends[:-1]]), ends):
        out[i] = pieces[a:b]
    return out


def _expand(table: PieceTable, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odd = np.flatnonzero(pieces < 0)
    written = [np.array([table.byte_ids[b] for b in chr(-2 - int(pieces[p])).encode()], np.int32) for p in odd]
    times = np.ones(len(pieces), np.int64)
    times[odd] = [len(w) for w in written]
    out = np.repeat(pieces, times)
    start = np.cumsum(times) - times
    for p, w in zip(odd, written):
        out[start[p]:start[p] + len(w)] = w
    owner = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(owner, weights=times, minlength=len(counts)).astype(np.int64)


def decode(table: PieceTable, ids) -> str | None:
    """The text of the ids; the space mark in front is removed."""
    if ids is None:
        return None
    text = b"".join([table.raw[i] for i in ids]).decode("utf-8")
    return text[1:]


def encode(docs: DataFrame, model_file: str, alpha: float = ALPHA, key: str = "doc_id",
           text: str = "text", out: str = "ids", lossless: str | None = None) -> DataFrame:
    """The documents with a sampled segmentation (array of piece ids) in ``out``.
    With ``lossless`` the ids are decoded again in the same task, and that
    column says whether this gave the text (true for a null text)."""
    table = PieceTable(load_pieces(model_file))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the vocabulary
    keep = [f for f in docs.schema if f.name not in (out, lossless)]
    schema = StructType(list(keep)).add(out, ArrayType(IntegerType()))
    if lossless:
        schema = schema.add(lossless, BooleanType())
    seed_, text_ = fresh(docs.columns, "_seed", "_text")

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, rows=4096, chars_of=text_, max_bytes=BATCH_BYTES):
            seeds = batch.column(seed_).to_numpy(zero_copy_only=False).view(np.uint64)
            texts = batch.column(text_).to_pylist()
            ids = encode_batch(shared.value, texts, _mix(seeds.copy()), alpha)
            offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
            null = pa.array([x is None for x in ids], pa.bool_())
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=null)
            same = [pa.array([decode(shared.value, x if x is None else x.tolist()) == t for x, t in zip(ids, texts)],
                             pa.bool_())] if lossless else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in keep] + [column.cast(arrow.field(out).type), *same], schema=arrow)

    rows = docs.select(*[f.name for f in keep], F.xxhash64(F.lit("pieces"), F.col(key)).alias(seed_),
                       F.col(text).cast("string").alias(text_))
    return map_batches(rows, run, schema)


def decoded(encoded: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The rows with the decoded text of ``ids`` in ``out``."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceTable(load_pieces(model_file)).raw)
    keep = [f for f in encoded.schema if f.name != out]
    schema = StructType(list(keep)).add(out, StringType())

    def run(batches):
        arrow = to_arrow_schema(schema)
        raw = shared.value
        for batch in slices(batches, rows=256):
            column = batch.column(ids)
            offsets = column.offsets.to_numpy()  # of a slice: places in the whole batch's values
            values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).tolist()
            offsets = (offsets - offsets[0]).tolist()
            texts = [b"".join(map(raw.__getitem__, values[a:b])).decode("utf-8")[1:] if ok else None
                     for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(texts, pa.string())], schema=arrow)

    return map_batches(encoded.select(*[f.name for f in keep]), run, schema)
