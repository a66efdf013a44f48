"""Personal data: rules plus a skip-chain conditional random field.

Base spans come from fixed rules (email, ip, card, phone). The field labels the
tokens (runs without white space) that hold a digit or an ``@``; all others are
not part of personal data by definition. Its potentials: token features (shape,
neighbouring words, number and check digit of the digits), transitions between
neighbouring tokens, and skip edges that link each token to the next one of the
document with the same form (equal digits, or equal lower-cased text) or a
similar one (equal last ``TAIL`` digits, as of a number without its country
code), and each token that the rules miss also to the nearest one of either kind
that they know, however far.
Base spans are observed; loopy sum-product message passing carries them to the
other mentions, so an entity written once in a form that the rules know is found
in the forms that they do not. A document's messages are passed until none
changes by more than ``SETTLED``; where loops keep them from settling, for
``SPARE_ROUNDS`` and two rounds for each of its tokens, more than its longest
path. A document's result does not depend on the others of its batch. The
method only adds spans; base spans stay. A span is added only where a skip edge
ties one of its tokens, by a form of at least ``MIN_DIGITS`` digits or with an
``@``, to a mention that the rules found, and with that mention's kind: what the
token looks like never makes a span by itself. Shorter tokens beside it join it. A document without a rule-found
mention has nothing to carry, and its field is not computed.

Weights are fitted by pseudo-likelihood on a bounded sample of documents (the
``SAMPLE_DOCS`` lowest by hash that hold a digit or ``@``) with the base rules
as labels. A token that the rules miss but whose form, or a similar one, they know in
the same document has no label there; it and its edges are left out. All skip edges
share one agreement weight, with a prior at ``AGREEMENT``.

Positions are code points, ends exclusive. Defined results: a null or empty
text has no spans; repeated rows are ordinary rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from riskframe.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 400
BUCKETS = 1 << 12
FIT_STEPS = 150
SETTLED = 1e-6
SPARE_ROUNDS = 100
DAMPING = 0.3
AGREEMENT = 4.0
ADD_AT = 0.5
MIN_DIGITS = 6
TAIL = 9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[0-9@]\S*")
_EDGE = ".,;:!?()[]{}<>\"'"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, free = text.find("@"), 0  # leftmost match: the whole run of local characters before an @
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    if not _DIGIT.search(text):
        return out
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        where = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((1, where, where + size))
            where += size + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _valid(digits: str) -> str:
    """The card rule's verdict on a token's digits."""
    return ("y" if _luhn(digits) else "n") if 16 <= len(digits) <= 19 else ""


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]", "9", token[:32])
    return re.sub(r"[^\W\d_]+", "a", s)


class Tokens:
    """The active tokens of one text, their features and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        self.spans, self.features, forms, tails, named = [], [], [], [], []
        free = 0
        for m in _TOKEN.finditer(text):
            start = m.start()
            while start > free and not text[start - 1].isspace():
                start -= 1
            free = m.end()
            self.spans.append((start, free))
            token = text[start:free]
            digits = "".join(_DIGIT.findall(token))
            forms.append(digits if len(digits) >= MIN_DIGITS else token.strip(_EDGE).lower())
            tails.append("~" + digits[-TAIL:] if len(digits) >= TAIL else "")
            named.append(len(digits) >= MIN_DIGITS or "@" in token)
            before = text[max(0, start - 40):start].split()[-1:]
            after = text[free:free + 40].split()[:1]
            names = (f"s{_shape(token)}", f"d{min(len(digits), 20)}", f"b{_shape(before[0].lower()) if before else ''}",
                     f"a{_shape(after[0].lower()) if after else ''}", f"v{_valid(digits)}", "bias")
            self.features.append([xxhash.xxh32_intdigest(n) % BUCKETS for n in names])
        n = len(self.spans)
        self.chain = [(i, i + 1) for i in range(n - 1) if text[self.spans[i][1]:self.spans[i + 1][0]].isspace()]
        self.forms = forms
        linked = set()
        for keys in (forms, tails):
            last: dict[str, int] = {}
            for i, key in enumerate(keys):
                if key:
                    if key in last:
                        linked.add((last[key], i))
                    last[key] = i
        self.observed = [0] * n
        i = 0
        for kind, start, end in sorted(base, key=lambda b: b[1]):
            while i and self.spans[i - 1][1] > start:
                i -= 1
            while i < n and self.spans[i][1] <= start:
                i += 1
            j = i
            while j < n and self.spans[j][0] < end:
                self.observed[j] = kind + 1
                j += 1
        known: dict[str, list[int]] = {}
        for i in range(n):
            if self.observed[i]:
                for key in filter(None, (forms[i], tails[i])):
                    known.setdefault(key, []).append(i)
        self.unknown = [not y and (f in known or t in known) for f, t, y in zip(forms, tails, self.observed)]
        self.tied = [set() for _ in range(n)]  # kinds of the mentions that skip edges tie a token to
        for i in range(n):
            for key in (forms[i], tails[i]) if self.unknown[i] else ():
                if key in known:
                    place = bisect(known[key], i)
                    near = min(known[key][max(0, place - 1):place + 1], key=lambda j: abs(j - i))
                    linked.add((min(i, near), max(i, near)))
                    if named[i]:
                        self.tied[i] |= {self.observed[j] for j in known[key]}
        self.named, self.skip = named, sorted(linked)


def _edges(tokens: list[Tokens], name: str) -> np.ndarray:
    out, at = [], 0
    for t in tokens:
        out += [(a + at, b + at) for a, b in getattr(t, name)]
        at += len(t.spans)
    return np.array(out, np.int64).reshape(-1, 2)


def fit(texts: list[str]) -> dict:
    """Pseudo-likelihood weights: features, chain and skip transitions."""
    n = len(KINDS) + 1
    w = {"f": np.zeros((BUCKETS, n)), "chain": np.zeros((n, n)), "skip": AGREEMENT * np.eye(n)}
    tokens = [Tokens(t, base_spans(t)) for t in texts]
    feats = np.array([f for t in tokens for f in t.features], np.int64)
    label = np.array([y for t in tokens for y in t.observed], np.int64)
    if not len(label):
        return w
    known = ~np.array([u for t in tokens for u in t.unknown])
    edges = {k: e[known[e].all(axis=1)] for k in ("chain", "skip") for e in (_edges(tokens, k),)}
    squares = {k: np.full_like(v, 1e-8) for k, v in w.items()}
    truth = np.eye(n)[label]
    for _ in range(FIT_STEPS):
        logits = w["f"][feats].sum(axis=1)
        for k, e in edges.items():
            np.add.at(logits, e[:, 1], w[k][label[e[:, 0]]])
            np.add.at(logits, e[:, 0], w[k].T[label[e[:, 1]]])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = known[:, None] * (p / p.sum(axis=1, keepdims=True) - truth) / len(label)
        g = {"f": 1e-5 * w["f"]}
        np.add.at(g["f"], feats.ravel(), np.repeat(d, feats.shape[1], axis=0))
        for k, e in edges.items():
            g[k] = 1e-4 * (w[k] - (AGREEMENT * np.eye(n) if k == "skip" else 0))
            np.add.at(g[k], label[e[:, 0]], d[e[:, 1]])
            np.add.at(g[k].T, label[e[:, 1]], d[e[:, 0]])
        g["skip"] = np.trace(g["skip"]) / n * np.eye(n)
        for k in w:
            squares[k] += g[k] ** 2
            w[k] -= 0.3 * g[k] / np.sqrt(squares[k])
    return w


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logs(message: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(message, 1e-30))


def marginals(w: dict, tokens: list[Tokens]) -> np.ndarray:
    """Label marginals of all tokens by loopy sum-product with observed base labels."""
    feats = np.array([f for t in tokens for f in t.features], np.int64)
    label = np.array([y for t in tokens for y in t.observed], np.int64)
    total = np.clip(w["f"][feats].sum(axis=1), -30, 30)
    seen = label > 0
    sides, pots = [], []
    for k in ("chain", "skip"):
        e = _edges(tokens, k)
        for a, b, pot in ((0, 1, w[k]), (1, 0, w[k].T)):
            told = e[seen[e[:, a]] & ~seen[e[:, b]]]  # what an observed token says never changes
            np.add.at(total, told[:, b], pot[label[told[:, a]]])
        e = e[~seen[e].any(axis=1)]
        sides += [e, e[:, ::-1]]
        pots += [np.broadcast_to(np.exp(p), (len(e), *p.shape)) for p in (w[k], w[k].T)]
    edge = np.concatenate(sides)  # directed; the reverse of each stands one block away
    pot = np.concatenate(pots)
    sizes = [len(s) for s in sides]
    starts = np.cumsum([0, *sizes])
    reverse = np.concatenate([np.arange(sizes[b]) + starts[b] for b in (1, 0, 3, 2)])
    lengths = np.array([len(t.spans) for t in tokens], np.int64)
    document = np.repeat(np.arange(len(tokens)), lengths)[edge[:, 0]]
    message = np.full((len(edge), total.shape[1]), 1 / total.shape[1])
    out, rounds = total.copy(), 0
    while len(edge):  # the edges of documents whose messages still change
        nodes, local = np.unique(edge, return_inverse=True)
        local = local.reshape(edge.shape)
        unary, going = total[nodes], np.ones(len(tokens), bool)
        while going[document].all():
            logs, sums = _logs(message), unary.copy()
            np.add.at(sums, local[:, 1], logs)
            new = np.einsum("ei,eij->ej", _softmax(sums[local[:, 0]] - logs[reverse]), pot)
            new = DAMPING * message + (1 - DAMPING) * new / new.sum(axis=1, keepdims=True)
            change = np.zeros(len(tokens))
            np.maximum.at(change, document, np.abs(new - message).max(axis=1))
            message = new
            rounds += 1
            going = (change > SETTLED) & (rounds < SPARE_ROUNDS + 2 * lengths)
        keep = going[document]
        np.add.at(out, edge[~keep, 1], _logs(message[~keep]))
        reverse = (np.cumsum(keep) - 1)[reverse[keep]]
        edge, pot, document, message = edge[keep], pot[keep], document[keep], message[keep]
    out = _softmax(out)
    out[seen] = np.eye(out.shape[1])[label[seen]]
    return out


def find_spans(w: dict, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; spans are (kind, start, end)."""
    base = [base_spans(t) for t in texts]
    tokens, owner = [], []
    for i, text in enumerate(texts):
        if base[i]:  # without an observed mention nothing is carried to others
            tokens.append(Tokens(text, base[i]))
            owner.append(i)
    out = [(b, list(b)) for b in base]
    if not tokens:
        return out
    found, at = marginals(w, tokens), 0
    for i, t in zip(owner, tokens):
        text, spans = texts[i], t.spans
        own = found[at:at + len(spans)]
        at += len(spans)
        touching = {a for a, _ in t.chain}
        added: list[list[int]] = []
        for j in np.flatnonzero((own[:, 1:].max(axis=1) >= ADD_AT) & (np.array(t.observed) == 0)).tolist():
            kind = int(own[j, 1:].argmax())
            token = text[slice(*spans[j])]
            start = spans[j][0] + len(token) - len(token.lstrip(_EDGE))
            end = spans[j][1] - (len(token) - len(token.rstrip(_EDGE)))
            if start >= end:
                continue
            tied = kind + 1 in t.tied[j]
            if t.named[j] and not tied:  # a number of its own, not a part of a tied one
                continue
            if added and added[-1][0] == kind and added[-1][3] == j - 1 and j - 1 in touching:
                added[-1][2:] = [end, j, tied or added[-1][4]]
            else:
                added.append([kind, start, end, j, tied])
        out[i] = (base[i], sorted(base[i] + [(k, a, b) for k, a, b, _, tied in added if tied]))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id") -> dict:
    """Fit the field on the bounded sample of documents with a digit or @."""
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.filter(F.col("t").rlike("[0-9@]"))
    h = F.xxhash64("k", "t")
    picked = [r.h for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCS).collect()]
    if not picked:
        return fit([])
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in picked], "h long"))  # SAMPLE_DOCS rows
    got = rows.withColumn("h", h).join(wanted, "h", "left_semi").dropDuplicates(["h"]).orderBy("h").collect()
    return fit([r.t for r in got])


def find(docs: DataFrame, weights: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans (text form), found (array of kind, start, end, value)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed number of weights
    value = StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()).add("value", StringType())
    schema = StructType().add("doc_id", LongType())
    for k in KINDS:
        schema = schema.add(f"n_{k}", LongType())
    schema = schema.add("base_sha256", StringType()).add("spans", StringType()).add("found", ArrayType(value))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, chars_of="t"):
            texts = batch.column("t").to_pylist()
            got = find_spans(shared.value, texts)
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got]),
                        pa.array([written(a) for _, a in got]),
                        pa.array([[{"kind": KINDS[k], "start": a, "end": b, "value": t[a:b]} for k, a, b in s]
                                  for t, (_, s) in zip(texts, got)], arrow.field("found").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
