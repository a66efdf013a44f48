"""Toxicity: a bidirectional gated recurrent network with attention pooling.

The input at each word is a learned word vector plus the scaled sum of learned
vectors of its character n-grams (3 to 5, with word ends), both in hashed
tables; only buckets that at least ``LEAST_DOCS`` sampled documents use have
vectors, so rare words say no more than their n-grams. Two gated recurrent passes, one in each direction, read a window of
``WINDOW`` words; attention pools their states to one logit. One window in
``STRIDE`` of a text is scored (each starts ``STRIDE`` words after the last, so
all words are read and neighbours share 8) and the highest counts; a passage
longer than the words they share may lie whole in no window.

The network is trained here in numpy (backpropagation through time, Adam) on a
bounded sample: the ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents
lowest by hash, with at most ``TEXTS_OF_ID`` different texts of an id. A document's label belongs to its highest-scoring window, which
is chosen anew as training goes on; at first, and later for some of the clean
documents, every step takes a random window. At last the highest logits of the
sample are mapped to probabilities by Platt scaling.

Defined results: a null or empty text, or one without letters, is scored as a
window without words; labels null or not 0 or 1 teach nothing, documents with
several labels count once for each; without labels of both classes every score
is the share of toxic labels (0 without labels); repeated rows are ordinary
rows. Extra columns are ignored by ``score`` and pass through ``keep_clean``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructType

from riskframe.llm.common import fresh, map_batches, slices

WINDOW = 32
STRIDE = 24
WIDTH = 16  # of a word's input
HIDDEN = 8  # of each direction
ATTENTION = 8
WORD_BUCKETS = 1 << 13
GRAM_BUCKETS = 1 << 14
SAMPLE_TOXIC = 500
SAMPLE_CLEAN = 1500
TEXTS_OF_ID = 4
STEPS = 380
FIRST_STEPS = 170  # with random windows
BATCH = 96
CHOOSE_EVERY = 70
RATE = 0.01
DECAY = 0.02
LEAST_DOCS = 5
DROP = 0.2  # share of a training window's words that are hidden

_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_GRAMS = (3, 4, 5)


def words_of(utf8: bytes | None) -> list[bytes]:
    return utf8.translate(_LETTERS).split() if utf8 else []


class Vocabulary:
    """Bucket of each distinct word and buckets of its character n-grams."""

    def __init__(self, words: list[bytes]) -> None:
        self.word = np.array([xxhash.xxh32_intdigest(w) % WORD_BUCKETS for w in words], np.int64)
        marked = ["^" + w.decode("utf-8", "replace") + "$" for w in words]
        lengths = np.array([len(m) for m in marked], np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(of))  # characters from here to the word's end
        grams, owners = [], []
        for n in _GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            grams.append((h % np.uint64(GRAM_BUCKETS)).astype(np.int64))
            owners.append(of[at])
        owner = np.concatenate(owners)
        self.grams = np.concatenate(grams)[np.argsort(owner, kind="stable")].astype(np.int32)
        self.sizes = np.bincount(owner, minlength=len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.scale = (1 / np.sqrt(np.maximum(1, self.sizes)))[:, None].astype(np.float32)

    def grams_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words' n-grams, and the word (by place in ``which``) of each."""
        sizes = self.sizes[which]
        of = np.repeat(np.arange(len(which)), sizes)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.grams[np.repeat(self.starts[which], sizes) + inside], of

    def inputs(self, p: dict, which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros((0, WIDTH), np.float32)
        out = p["word"][self.word[which]]
        for at in range(0, len(which), 4096):
            part = which[at:at + 4096]
            grams, of = self.grams_of(part)
            starts = np.searchsorted(of, np.arange(len(part)))
            out[at:at + 4096] += np.add.reduceat(p["gram"][grams], starts, axis=0) * self.scale[part]
        return out


def window_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and first word of every overlapping window; at least one each."""
    counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, nth * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def new_parameters(seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    normal = lambda scale, *shape: (scale * r.standard_normal(shape)).astype(np.float32)
    p = {"word": normal(0.1, WORD_BUCKETS, WIDTH), "gram": normal(0.1, GRAM_BUCKETS, WIDTH)}
    for d in "fb":
        p |= {f"w{d}": normal(WIDTH ** -0.5, WIDTH, 3 * HIDDEN), f"u{d}": normal(HIDDEN ** -0.5, HIDDEN, 3 * HIDDEN),
              f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"wa": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32),
                "va": normal(ATTENTION ** -0.5, ATTENTION), "wo": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN),
                "bo": np.zeros(1, np.float32)}


def _pass(projected: np.ndarray, at: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool):
    """One direction over (batch, time) word places; states (time, batch, hidden)."""
    batch, steps = at.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    states = np.empty((steps, batch, HIDDEN), np.float32)
    trace = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, g = projected[at[:, t]], h @ u
        gates = _sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
        m = mask[:, t:t + 1]
        new = h + m * (1 - z) * (n - h)
        if keep:
            trace.append((t, h, z, r, n, g[:, 2 * HIDDEN:], m))
        h = states[t] = new
    return states, trace


def forward(p: dict, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window; ``at``: rows of ``inputs`` by (window, time)."""
    sides = {d: _pass(inputs @ p[f"w{d}"] + p[f"c{d}"], at, mask, p[f"u{d}"], d == "b", keep) for d in "fb"}
    h = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
    q = np.tanh(h @ p["wa"] + p["ba"])
    e = np.exp((q @ p["va"]) - ATTENTION) * mask.T
    total = e.sum(axis=0) + 1e-20
    a = e / total
    pooled = (a[:, :, None] * h).sum(axis=0)
    logit = pooled @ p["wo"] + p["bo"][0]
    return logit, (sides, h, q, a, pooled) if keep else None


def gradients(p: dict, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, label: np.ndarray):
    """Gradients of the mean log loss by parameter, and by row of ``inputs``."""
    logit, (sides, h, q, a, pooled) = forward(p, inputs, at, mask, True)
    d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
    out = {"bo": np.array([d.sum()]), "wo": pooled.T @ d}
    dpooled = d[:, None] * p["wo"]
    dh = a[:, :, None] * dpooled
    da = (h * dpooled).sum(axis=2)
    ds = a * (da - (a * da).sum(axis=0))
    out["va"] = np.tensordot(ds, q, ([0, 1], [0, 1]))
    dq = ds[:, :, None] * p["va"] * (1 - q * q)
    out["wa"] = np.tensordot(h, dq, ([0, 1], [0, 1]))
    out["ba"] = dq.sum(axis=(0, 1))
    dh += dq @ p["wa"].T
    dinputs = np.zeros_like(inputs)
    for k, side in enumerate("fb"):
        u, carried = p[f"u{side}"], np.zeros((len(label), HIDDEN), np.float32)
        dprojected = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
        du = np.zeros_like(u)
        for t, before, z, r, n, gn, m in reversed(sides[side][1]):
            dnew = dh[t, :, k * HIDDEN:(k + 1) * HIDDEN] + carried
            dn = dnew * m * (1 - z) * (1 - n * n)
            dz = -dnew * m * (n - before) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            carried = dnew * (1 - m * (1 - z)) + dg @ u.T
            du += before.T @ dg
            np.add.at(dprojected, at[:, t], np.concatenate([dz, dr, dn], axis=1))
        out[f"u{side}"], out[f"c{side}"] = du, dprojected.sum(axis=0)
        out[f"w{side}"] = inputs.T @ dprojected
        dinputs += dprojected @ p[f"w{side}"].T
    return out, dinputs


class Texts:
    """The windows of many texts over their common distinct words (row 0: no word)."""

    def __init__(self, texts: list[bytes | None]) -> None:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = lambda: len(number) + 1
        codes = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
        self.vocabulary = Vocabulary(list(number))
        lengths = np.array([len(c) for c in codes], np.int64)
        self.owner, first = window_table(lengths)
        flat = np.concatenate([*codes, np.zeros(1, np.int64)])
        begin = np.cumsum(lengths) - lengths
        place = first[:, None] + np.arange(WINDOW)
        self.mask = place < lengths[self.owner][:, None]
        place += begin[self.owner][:, None]
        self.at = np.where(self.mask, flat[np.minimum(place, len(flat) - 1)], 0).astype(np.int32)

    def inputs(self, p: dict, rows: np.ndarray) -> np.ndarray:
        """Inputs of the given rows (ascending); row 0 stands for no word."""
        real = self.vocabulary.inputs(p, rows[rows > 0] - 1)
        return np.concatenate([np.zeros((1, WIDTH), np.float32), real]) if rows[0] == 0 else real

    def logits(self, p: dict, block: int = 1024) -> np.ndarray:
        inputs = self.inputs(p, np.arange(len(self.vocabulary.word) + 1))
        return np.concatenate([forward(p, inputs, self.at[i:i + block], self.mask[i:i + block].astype(np.float32))[0]
                               for i in range(0, len(self.at), block)] or [np.empty(0, np.float32)])


def _common_buckets(data: Texts) -> dict[str, np.ndarray]:
    """By table: whether at least LEAST_DOCS texts use a bucket (as 0 or 1)."""
    counts = {"word": np.zeros(WORD_BUCKETS), "gram": np.zeros(GRAM_BUCKETS)}
    begin = np.append(np.flatnonzero(np.diff(data.owner, prepend=-1)), len(data.owner))
    for first, last in zip(begin, begin[1:]):
        used = np.unique(data.at[first:last][data.mask[first:last]]) - 1
        counts["word"][np.unique(data.vocabulary.word[used])] += 1
        counts["gram"][np.unique(data.vocabulary.grams_of(used)[0])] += 1
    out = {k: (c >= LEAST_DOCS).astype(np.float32) for k, c in counts.items()}
    return out


def train(texts: list[bytes | None], labels: list[int], seed: int = 7) -> dict:
    """Parameters of the network, or the share of toxic labels where a class is missing."""
    label = np.array(labels, np.float32)
    if not len(label) or label.min() == label.max():
        return {"share": float(label.mean()) if len(label) else 0.0}
    r, p, data = np.random.default_rng(seed), new_parameters(seed), Texts(texts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    windows = np.split(np.arange(len(data.owner)), np.flatnonzero(np.diff(data.owner)) + 1)
    begin = np.array([w[0] for w in windows])
    sizes = np.array([len(w) for w in windows])
    chosen = None
    toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    vocabulary = data.vocabulary
    common = _common_buckets(data)
    for k, seen in common.items():
        p[k] *= seen[:, None]
    for step in range(STEPS):
        if step >= FIRST_STEPS and (step - FIRST_STEPS) % CHOOSE_EVERY == 0:
            logits = data.logits(p)
            chosen = np.array([w[logits[w].argmax()] for w in windows])
        docs = np.concatenate([r.choice(toxic, BATCH // 3), r.choice(clean, BATCH - BATCH // 3)])
        which = begin[docs] + (r.random(BATCH) * sizes[docs]).astype(np.int64)
        if chosen is not None:
            which = np.where((label[docs] == 1) | (r.random(BATCH) < 0.7), chosen[docs], which)
        at, mask = data.at[which], data.mask[which].astype(np.float32)
        at = np.where(r.random(at.shape) < DROP, 0, at)
        used, back = np.unique(at, return_inverse=True)
        got, dinputs = gradients(p, data.inputs(p, used), back.reshape(at.shape), mask, label[docs])
        real, dreal = used[used > 0] - 1, dinputs[used > 0]
        dword, dgram = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(dword, vocabulary.word[real], dreal)
        grams, of = vocabulary.grams_of(real)
        np.add.at(dgram, grams, (dreal * vocabulary.scale[real])[of])
        dword *= common["word"][:, None]
        dgram *= common["gram"][:, None]
        for k, g in (got | {"word": dword, "gram": dgram}).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            if k in ("word", "gram", "wf", "wb"):
                p[k] *= 1 - RATE * DECAY * (step + 1 < STEPS)
            p[k] -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)
    logits = data.logits(p)
    return p | {"platt": _platt(np.array([logits[w].max() for w in windows], np.float64), label)}


def _platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds, fitted by Newton steps on smoothed targets."""
    toxic = label.sum()
    target = np.where(label == 1, (toxic + 1) / (toxic + 2), 1 / (len(label) - toxic + 2))
    x, w = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step /= 2
        w = w - step
    return max(float(w[0]), 1e-3), float(w[1])


def score_texts(p: dict, texts: list[bytes | None]) -> np.ndarray:
    """Highest window score of each text."""
    if "share" in p:
        return np.full(len(texts), p["share"])
    if not texts:
        return np.empty(0)
    data = Texts(texts)
    logits = data.logits(p)
    best = np.maximum.reduceat(logits, np.searchsorted(data.owner, np.arange(len(texts))))
    slope, offset = p["platt"]
    return _sigmoid(slope * best.astype(np.float64) + offset)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> dict:
    """Train on the bounded sample; ``learn_from`` says which documents may teach."""
    mine = docs.filter(learn_from & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    sample = []
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        ids = (known.filter(F.col("y") == value).join(mine.select("k").distinct(), "k", "left_semi")
               .select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(most))
        # at most ``most``; an Arrow table becomes a local one, rows of Python objects start workers that stay
        bounded = docs.sparkSession.createDataFrame(pa.table({"k": pa.array([r.k for r in ids.collect()], pa.int64())}))
        texts = mine.join(F.broadcast(bounded), "k", "left_semi").distinct().withColumn(
            "r", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("t"), "t")))
        sample += [(bytes(r.t.encode()) if r.t else b"", value) for r in  # at most ``most`` x TEXTS_OF_ID rows
                   texts.filter(F.col("r") <= TEXTS_OF_ID).orderBy(F.xxhash64("k"), "k", "t").collect()]
    return train([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """The documents with the toxicity score of their text in ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters
    keep = [f for f in docs.schema if f.name != out]
    schema = StructType(list(keep)).add(out, DoubleType())

    # the text travels once: a string column that is kept is also what is scored
    source = text if text != out and isinstance(docs.schema[text].dataType, StringType) else fresh(docs.columns, "_scored")[0]
    rows = docs if source == text else docs.withColumn(source, F.col(text).cast("string"))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, rows=4096, chars_of=source, max_bytes=1 << 20):
            got = score_texts(shared.value, batch.column(source).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(got, pa.float64())], schema=arrow)

    return map_batches(rows.select(*dict.fromkeys([*[f.name for f in keep], source])), run, schema)


def keep_clean(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The documents with a score below 0.5, with their own columns."""
    out, = fresh(docs.columns, "_toxicity")
    return score(docs, model, text, out).filter(F.col(out) < 0.5).select(*docs.columns)
