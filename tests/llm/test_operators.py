"""Training-data operators on small fixtures, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import (decontaminate, langid, linededup, neardup, pieces, pii, revisits, sharding,
                           topk, toxicity)
from riskframe.llm.queries import MODEL_FILE

DOCS = "doc_id long, text string"
WORDS = ["alpha", "beta", "gamma", "delta", "Äpfel", "omega", "sigma", "tau", "rho", "pi", "中文"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable(pieces.load_pieces(MODEL_FILE))


ODD_TEXTS = [None, "", " ", "a▁b ▁ \n\t中文 🎉 x  y \0 \0lit", "x" * 30_000, prose(1, 3000), "▁", "é" * 7, "  a  "]


def test_pieces_round_trip_and_reproducible(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "null key"), (5, ODD_TEXTS[5])], DOCS)
    encoded = pieces.encode(docs.withColumnRenamed("text", "original"), MODEL_FILE, text="original")
    rows = pieces.decoded(encoded, MODEL_FILE).collect()
    assert len(rows) == docs.count()
    assert all(r.text == r.original for r in rows)
    again = pieces.encode(docs.repartition(3), MODEL_FILE).collect()
    assert collections.Counter((r.doc_id, str(r.ids)) for r in rows) == collections.Counter((r.doc_id, str(r.ids)) for r in again)
    assert pieces.encode(docs.limit(0), MODEL_FILE).collect() == []


def test_pieces_follow_the_lattice_distribution(table):
    """Sampled segmentations of a word occur as often as their weights say."""
    word, n = "the", 20_000
    marked = pieces.SPACE + word
    ways = {}

    def walk(at, ids, weight):
        if at == len(marked):
            ways[tuple(ids)] = weight
        for end in range(at + 1, len(marked) + 1):
            i = table.ids.get(marked[at:end])
            if i is not None:
                walk(end, [*ids, i], weight * np.exp(table.weights[i]))

    walk(0, [], 1.0)
    total = sum(ways.values())
    got = collections.Counter(tuple(x.tolist()) for x in pieces.encode_batch(
        table, [word] * n, pieces._mix(np.arange(n, dtype=np.uint64)), 1.0))
    assert set(got) <= set(ways)
    for way, weight in ways.items():
        p = weight / total
        assert abs(got[way] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_topk_matches_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in r.normal(size=(400, 6)).round(2)]
    vectors[30:200] = [vectors[30]] * 170  # a hot vector: ties
    rows = list(enumerate(vectors)) + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 6), (1050, []), (50, vectors[50]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in enumerate(vectors)} | {1050: []}
    want = []
    for a in sorted(i for i in q if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:5]
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_topk_of_large_components(spark):
    """Scores beyond 2^53 are exact, beyond a long they are held to its range."""
    v = {50: [1.0], 1: [2.0 ** 33], 2: [2.0 ** 34], 3: [2.0 ** 35], 4: [2.0 ** 46 + 2.0 ** -6], 5: [-2.0 ** 80], 6: [2.0 ** 80]}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 50, k=9).orderBy("rank").collect()]
    assert got == [(6, 2 ** 63 - 1), (4, 256 * (2 ** 54 + 4)), (3, 2 ** 51), (2, 2 ** 50), (1, 2 ** 49), (5, -2 ** 63)]


def test_topk_copies_a_shard_only_for_those_who_ask(spark, monkeypatch):
    """Far clusters: the second round leaves the cells out that no query reaches."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    seen, plain = spark.sparkContext.accumulator(0), topk._search_shard

    def counting(k, width):
        run = plain(k, width)

        def wrapped(key, asked, held):
            seen.add(len(held))
            return run(key, asked, held)
        return wrapped
    monkeypatch.setattr(topk, "_search_shard", counting)
    r = np.random.default_rng(6)
    away = np.repeat(np.eye(8) * 1000, 100, axis=0) + r.normal(size=(800, 8))
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(away)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id").isin(10, 20)).collect()
    assert len(got) == 10 and all(x.vec_id < 100 for x in got)
    assert seen.value < 2 * 800  # no shard of another cluster was copied in the second round


def test_topk_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    r = np.random.default_rng(4)
    v = r.normal(size=(500, 4))
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    q = np.floor(256 * v).astype(int)
    s = q @ q.T
    want = [(a, n + 1, b, int(s[a, b])) for a in range(0, 500, 20)
            for n, b in enumerate(sorted((b for b in range(500) if b != a), key=lambda b: (-s[a, b], b))[:5])]
    assert got == want


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item, w in items:
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[j:j + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(hit), found


def test_decontamination_matches_brute_force(spark):
    items = [(1, prose(50, 30)), (2, "Short Passage here"), (3, None), (4, "..."), (1, prose(51, 12)), (None, prose(52, 20)), (5, prose(50, 30))]
    texts = [prose(i, 80) for i in range(12)] + [None, "", prose(50, 30).upper() + " end", "a b short passage, HERE c", prose(52, 20)]
    texts += [prose(9, 40) + " " + " ".join(prose(50, 30).split()[5:25]) + " " + prose(51, 12)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_matches(docs, bench).collect()}
    split = [(i, decontaminate.words_of((t or "").encode())) for i, t in items if i is not None]
    for i, t in enumerate(texts):
        words = decontaminate.words_of((t or "").encode())
        n, found = brute_hits(words, split, 10)
        c = got[i].contamination
        assert (c.n_words, c.n_hit, {m.item_id for m in c.matches}) == (len(words), n, found), i
        for m in c.matches:  # locations are verbatim
            assert any(w[m.item_word:m.item_word + m.n_words] == words[m.doc_word:m.doc_word + m.n_words] for k, w in split if k == m.item_id)
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].contamination.n_hit}


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(100 + i, 15)) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(i, 9) + " " + prose(100 + i % 7, 15)) for i in range(9)], DOCS)
    one = sorted(map(str, decontaminate.find_matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    many = decontaminate.find_matches(docs, bench).collect()
    assert len(many) == 9
    assert {r.doc_id: r.contamination.n_hit for r in many if r.doc_id % 7 < 6} == {
        i: 15 for i in range(9) if i % 7 < 6} and len(one) == 9


def test_toxicity_learns_planted_words(spark):
    r = random.Random(5)
    bad = ["grukk", "zzorn", "blarg"]

    def doc(toxic):
        words = prose(r.random(), r.randrange(10, 120)).split()
        for _ in range(len(words) // 12 + 2 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        return " ".join(words)

    rows = [(i, doc(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "123 !"), (None, "x")], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (2, 7)], "doc_id long, toxic int")
    held = F.col("doc_id") % 5 == 0
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.learn(docs, labels, ~held)).collect()}
    test = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert np.mean(test) >= 0.95
    assert got[1000] == got[1001] == got[1002] and 0 <= got[1000] < 0.5
    none = toxicity.learn(docs, labels.limit(0), ~held)
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_sample_counts_ids(spark, monkeypatch):
    """Repeated label rows take no place in the sample; an id brings a fixed number of different texts."""
    rows = [(i, f"text {i}") for i in range(20)] * 3 + [(i, f"other {i} {n}") for i in range(20) for n in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 9, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 7)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: list(zip(texts, labels)))
    got = toxicity.learn(docs, labels, F.lit(True))
    ids = collections.Counter((int(t.split()[1]), y) for t, y in set(got))
    assert len(got) == len(set(got)) == 12 * 4 and set(ids.values()) == {4}
    assert collections.Counter(y for _, y in ids) == {1: 5, 0: 7} and all(i % 2 == y for i, y in ids)


def test_toxicity_gradients_are_right():
    data = toxicity.Texts([b"one two three two", b"four", b""])
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters(1).items()}
    rows = np.arange(len(data.vocabulary.word) + 1)
    inputs, mask, label = data.inputs(p, rows).astype(np.float64), data.mask.astype(np.float64), np.array([1.0, 0.0, 1.0])

    def loss(q, x):
        z = toxicity.forward(q, x, data.at, mask)[0].astype(np.float64)
        return (np.logaddexp(0, z) - label * z).mean()

    got, dx = toxicity.gradients(p, inputs, data.at, mask, label)
    for name in ("wf", "ub", "cf", "wa", "va", "wo", "bo"):
        at = tuple(s // 2 for s in p[name].shape)
        up, down = dict(p), dict(p)
        up[name], down[name] = p[name].copy(), p[name].copy()
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up, inputs) - loss(down, inputs)) / 2e-2 - got[name][at]) < 2e-4, name


def test_language_held_out(spark):
    tongues = {"aa": "the of and with this house water", "bb": "der die und mit haus wasser nicht", "cc": "que los una con casa agua para"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(tongues[k].split()) for _ in range(40)), k) for i in range(150) for k in [list(tongues)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 ,.", "cc"), (903, rows[0][1], None), (904, rows[0][1].upper() + "!!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.learn_dictionaries(docs, ~held)
    got = {x.key: x for x in langid.identify(docs, model, held).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:150])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "aa"]
    assert got[900].rejected and got[0].held_out == (zlib.crc32(b"0") % 5 == 0)
    assert langid.learn_dictionaries(docs.limit(0), ~held) == {}
    assert {x.lang_pred for x in langid.identify(docs, {}, held).collect()} == {"und"}


def test_language_dictionaries_fill_on_their_own(spark, monkeypatch):
    """A rare language, a language of few long documents and one repeated row shrink no dictionary."""
    r = random.Random(5)
    word = lambda k: k + "".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 7)))
    words = {k: [word(k) for _ in range(400)] for k in "bdg"}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    rows = [(i, text(k, 300), k) for i in range(60) for k in "bd"]
    rows += [(200 + i, "1 " * 9000 + text("g", 8000), "g") for i in range(3)] + [(300, "rare words of a small tongue", "z")]
    rows += [(400, "the same row", "b")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "DICT_BYTES", 30_000)
    model = langid.learn_dictionaries(docs, F.lit(True))
    assert {k: len(v) for k, v in model.items()} == {"b": 30_000, "d": 30_000, "g": 30_000, "z": 28}
    alone = langid.learn_dictionaries(docs.filter("lang <> 'z'"), F.lit(True))
    assert alone == {k: v for k, v in model.items() if k != "z"}
    new = [(i, text(k, 12), k) for i, k in enumerate("bdg" * 30)] + [(90, "rare words of a small tongue", "z")]
    found = langid.identify(spark.createDataFrame(new, docs.schema), model, F.lit(True)).collect()
    assert [x.lang_pred for x in sorted(found, key=lambda x: x.key)] == [k for *_, k in new]


def test_language_equal_share():
    r = random.Random(3)
    for _ in range(300):
        lengths = [r.randrange(1, 30) for _ in range(r.randrange(1, 9))]
        size = r.randrange(1, 200)
        want = next((e for e in range(1, max(lengths)) if sum(min(n, e) for n in lengths) >= size), max(lengths))
        assert langid.equal_share(lengths, size) == want


def test_personal_data_base_rules_match_the_patterns():
    import re

    def plain(t):
        out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 16 <= len(d) <= 19 and pii._luhn(d):
                out.append((2, m.start(), m.end()))
        return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                      if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]

    r = random.Random(8)
    fixed = ["a@b.c@d.e x@@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 x", "+1 (555) 123-4567.", "é@a.b ü+1 2345678"]
    for t in fixed + ["".join(r.choice("a1.@+- ()é9\n25") for _ in range(60)) for _ in range(3000)]:
        assert pii.base_spans(t) == plain(t), t


def test_personal_data_adds_other_mentions(spark):
    card = "4111111111111111"
    texts = [f"pay {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]} now {prose(i, 12)} again {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}, ok" for i in range(20)]
    texts += [f"mail a{i}.b@c.org {prose(i, 9)} x{i} a 77" for i in range(60)] + [None, "", "no digits", "x" * 50_000 + "1"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in pii.find(docs, pii.learn(docs)).collect()}
    assert got[0].n_card == 1 and got[0].n_ip == 0
    assert any(f.value == f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}" for f in got[0].found)
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(got[i].spans.split(","))


def test_personal_data_reaches_every_mention(spark):
    """50 mentions after, or around, the only one in a form that the rules know."""
    card = "4111111111111111"
    known, other = (sign.join(card[i:i + 4] for i in (0, 4, 8, 12)) for sign in "-.")
    after = [f"pay {known} now " + " ".join(f"{prose(50 * i + k, 7)} again {other}, ok" for k in range(50)) for i in range(12)]
    around = " ".join(f"{prose(k, 7)} again {other}, ok" for k in range(25))
    texts = after + [f"{around} pay {known} now {around}", f"no mention {prose(3, 9)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    weights = pii.learn(docs)
    got = {r.doc_id: r for r in pii.find(docs, weights).collect()}
    for i, text in enumerate(texts):
        assert sum(f.value == other for f in got[i].found) == text.count(other), i
    for w in (weights, pii.fit([])):
        alone = [pii.find_spans(w, [t])[0] for t in texts]
        assert pii.find_spans(w, texts) == alone
        assert [sum(t[a:b] == other for _, a, b in s) for t, (_, s) in zip(texts, alone)] == [50] * 13 + [0]


def test_personal_data_adds_only_what_an_edge_carries(spark):
    """Numbers that only look like a card stay out; other forms, and a phone
    number without its country code, are found in documents that name them."""
    r = random.Random(4)

    def number(valid):
        while True:
            digits = "".join(r.choice("123456789") for _ in range(16))
            if pii._luhn(digits) == valid:
                return digits

    texts = [f"host 97.51.17.{i} {prose(i, 9)} order {number(False)} {prose(i, 5)} card {number(True)} end" for i in range(80)]
    plain = len(texts)
    for i in range(3):  # a run of 32 digits that the rules drop: only its known half is added
        one, two = number(True), number(False)
        texts.append(f"card {one}, {prose(i, 5)} {two} {one} {prose(i, 5)}")
    halves = [x.split()[1][:-1] for x in texts[plain:]]
    texts += [f"call +49 30 {i + 100}4567890 {prose(i, 6)} or (0)30/{i + 100}4567890, {prose(i, 6)} host 10.0.0.{i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {x.doc_id: x for x in pii.find(docs, pii.learn(docs)).collect()}
    for i, t in enumerate(texts):
        base = {(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)}
        more = [f.value for f in got[i].found if (f.kind, f.start, f.end) not in base]
        want = [] if i < plain else [halves[i - plain]] if i < plain + 3 else [f"0)30/{i - plain + 97}4567890"]
        assert more == want, (t, more)
    assert [f.kind for f in got[plain + 3].found].count("phone") == 2


def test_personal_data_marginals_against_all_labellings():
    """On a small graph with loops the field picks the labels that the sum over all labellings does."""
    import itertools

    text = "pay 4111-1111-1111-1111 or 77a 4111.1111.1111.1111 88b then 99c 4111/1111/1111/1111 77a"
    tokens = pii.Tokens(text, pii.base_spans(text))
    n, kinds = len(tokens.spans), len(pii.KINDS) + 1
    r = np.random.default_rng(11)
    w = pii.fit([])
    w["f"] = 0.5 * r.standard_normal(w["f"].shape)
    w["chain"] = 0.3 * r.standard_normal(w["chain"].shape)
    unary = np.array([w["f"][f].sum(axis=0) for f in tokens.features])
    assert len(tokens.skip) + len(tokens.chain) > n - 1 and n == 7  # loops
    total = np.zeros((n, kinds))
    for ways in itertools.product(*[[y] if y else range(kinds) for y in tokens.observed]):
        score = sum(unary[i, y] for i, y in enumerate(ways))
        score += sum(w["chain"][ways[a], ways[b]] for a, b in tokens.chain)
        score += sum(w["skip"][ways[a], ways[b]] for a, b in tokens.skip)
        total[np.arange(n), ways] += np.exp(score)
    exact, got = total / total.sum(axis=1, keepdims=True), pii.marginals(w, [tokens])
    assert (exact.argmax(axis=1) == got.argmax(axis=1)).all() and np.abs(exact - got).max() < 0.05


def test_personal_data_messages_settle():
    """On a chain without loops the marginals are exact at any distance."""
    text = "a1@b.org " + " ".join(f"{i}x" for i in range(40))
    tokens = pii.Tokens(text, pii.base_spans(text))
    w = pii.fit([])
    w["chain"] = np.random.default_rng(3).standard_normal(w["chain"].shape) + 3 * np.eye(len(w["chain"]))
    step = np.exp(w["chain"])
    ahead = np.eye(len(step))[1]
    behind = [np.ones(len(step))]
    for _ in range(40):
        behind.append(step @ behind[-1] / (step @ behind[-1]).sum())
    for i, got in enumerate(pii.marginals(w, [tokens])):
        assert np.allclose(got, ahead * behind[40 - i] / (ahead @ behind[40 - i]), atol=1e-4), i
        ahead = ahead @ step / (ahead @ step).sum()


def brute_lines(rows):
    order = sorted({(d is not None, d or 0, n) for d, t in rows if t is not None for n in range(len(t.split("\n")))})
    lines = {(d is not None, d or 0): t.split("\n") for d, t in rows if t is not None}
    seen, keep = [], set()
    for some, d, n in order:
        line = lines[some, d][n].strip(" \t\r")
        if not line or not any(line == o or (min(len(line), len(o)) >= linededup.MIN_CHARS and abs(len(line) - len(o)) < 2
                                             and edit(line, o) <= 1) for o in seen):
            keep.add((some, d, n))
        seen.append(line)
    return {(d if some else None): "\n".join(x for n, x in enumerate(t) if (some, d, n) in keep) for (some, d), t in lines.items()}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(11)
    base = [prose(i, 4) for i in range(12)] + ["", "  ", "}", ")", "aaaaaaaaaaaa", "short"]

    def near(s):
        if len(s) < 2 or r.random() < 0.5:
            return s
        at, kind = r.randrange(len(s)), r.randrange(4)
        return s[:at] + ["", "Q", s[at] + "é", s[at]][kind] + s[at + 1:] + (" \t" if kind == 3 else "")

    rows = [(i, "\n".join(near(r.choice(base)) for _ in range(r.randrange(1, 9)))) for i in range(25)]
    rows += [(100, None), (101, ""), (-3, "\n\n"), (None, near(base[0]) + "\nnull key line here"), (102, "y" * 9000 + "\n" + "y" * 9001)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("line", F.lit(1))
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    want = brute_lines(rows)
    for x in got.collect():
        assert x.text == want.get(x.doc_id), (x.doc_id, x.text, want.get(x.doc_id))
    twice = linededup.dedup_lines(docs.union(docs), counts=True)
    assert twice.count() == 2 * len(rows) and twice.filter("text IS NOT NULL AND _n_kept > _n_lines").count() == 0
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_revisits(spark):
    h = "map('Date', 'd1', 'Content-Length', '5', 'VARY', 'x', 'vary', 'y')"
    rows = spark.sql(f"""SELECT * FROM VALUES
        (1L, 'http://www.A.com/x/?utm_a=1#f', 10L, 200, 'e1', 'm1', {h}), (2L, 'https://a.com/x', 20L, 304, 'e1', null, map('DATE', 'd2', 'content-length', '0')),
        (3L, 'a.com/x?ref=q', 30L, 200, 'e2', 'm2', null), (4L, 'a.com/x', 40L, 304, 'e1', 'm2', null), (5L, 'a.com/x', 5L, 304, 'e1', null, null),
        (6L, 'a.com/x', 30L, 304, 'e1', null, null), (7L, null, 50L, 304, 'e1', null, null), (8L, 'a.com/x', 60L, 304, null, null, null),
        (9L, 'a.com/x', 60L, 500, null, null, null), (10L, 'a.com/x', 30L, 200, 'e3', 'm2', null), (11L, 'a.com/x', 70L, 304, null, 'm2', null), (1L, 'http://www.A.com/x/?utm_a=1#f', 10L, 200, 'e1', 'm1', {h})
        AS t(record_id, url, ts, status, etag, last_modified, headers)""").withColumn("own", F.lit(1))
    got = {r.record_id: (r.response_id, r.resolution) for r in revisits.resolve_revisits(rows).collect()}
    assert got == {2: (1, "resolved"), 4: (10, "changed"), 5: (None, "no_response"), 6: (1, "resolved"), 7: (None, "no_response"),
                   8: (10, "unverified"), 11: (10, "resolved")}
    merged = {r.record_id: r.headers for r in revisits.resolve_revisits(rows).collect()}
    assert merged[2] == {"date": "d2", "content-length": "5", "vary": "x"}
    assert revisits.resolve_revisits(rows.limit(0)).collect() == []


def test_revisits_keep_the_index_page(spark):
    """As in the SQL, an index page is a URL of its own."""
    rows = [(1, "http://x.org/a/index.html", 10, 200, "e"), (2, "http://x.org/a/", 20, 304, "e"), (3, "www.x.org/a/index.html#f", 30, 304, "e")]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string").select(
        "*", F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("map<string,string>").alias("headers"))
    got = {r.record_id: (r.canonical, r.response_id, r.resolution) for r in revisits.resolve_revisits(df).collect()}
    assert got == {2: ("x.org/a", None, "no_response"), 3: ("x.org/a/index.html", 1, "resolved")}


def test_revisits_across_time_buckets(spark):
    """One URL with most records: the carried response equals a plain as-of search."""
    r = random.Random(4)
    rows = [(i, "u.com/" + ("hot" if i % 3 else str(i % 7)), r.randrange(300), 200 if r.random() < 0.2 else 304, "e", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified string")
    got = {x.record_id: x.response_id for x in revisits.resolve_revisits(df.withColumn("headers", F.lit(None).cast("map<string,string>"))).collect()}
    for i, url, ts, status, *_ in rows:
        if status == 304:
            best = max(((t, k) for k, u, t, s, *_ in rows if u == url and s == 200 and t < ts), default=(None, None))
            assert got[i] == best[1]


def test_bin_tree_is_best_fit():
    r = random.Random(6)
    for _ in range(200):
        sizes = sorted((r.randrange(1, 40) for _ in range(r.randrange(1, 60))), reverse=True)
        capacity = r.randrange(30, 80)
        room, want = [], []
        for s in sizes:
            fit = [(c, i) for i, c in enumerate(room) if c >= s]
            i = min(fit)[1] if fit else len(room)
            if not fit:
                room.append(max(capacity, s))
            room[i] -= s
            want.append(i)
        assert sharding.best_fit_decreasing(sizes, capacity) == want


def test_sharding(spark):
    texts = [None, "", None] + ["same text"] * 300 + [prose(i, 5 + i % 50) for i in range(200)] + ["é" * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x")], DOCS).withColumn("g", F.lit(1))
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.doc_id and texts[r.doc_id] == "same text"}) == 1
    loads = [sum(x.size for x in by[k]) for k in range(8)]
    assert max(loads) <= max(1.02 * sum(loads) / 8, 3010)
    assert sharding.shard_documents(docs.limit(0)).collect() == []


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        words = prose(g, r.choice([3, 5, 30, 200])).split()
        for _ in range(r.randrange(1, 9)):
            w = list(words)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = "changed" + str(r.random())
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  \n", "one two", "ONE\ttwo", prose(77, 60)])] + [(None, prose(77, 60)), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("clash"))
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = [d for d in sets if d is not None]
    root = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    for x in neardup.near_duplicates(docs).collect():
        assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), root.get(x.doc_id), x.doc_id is None or root[x.doc_id] == x.doc_id), x
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # the row with the null key has the text of one with a key
    stays = {d for d in ids if root[d] == d}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(stays)
    assert neardup.near_duplicates(docs.limit(0)).collect() == []
    assert neardup.drop_near_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_class_stays(spark):
    """Repeated rows, null keys and repeated keys with other texts."""
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, a), (None, prose(3, 30)), (None, prose(3, 30)), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_key", F.lit("own")).withColumn("_digest", F.lit("own")).withColumn("copies", F.lit("own"))
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {x._key for x in kept.collect()} == {"own"}
    got = collections.Counter((x.doc_id, x.text) for x in kept.collect())
    assert got == collections.Counter([(1, a), (2, b), (None, prose(3, 30)), (9, ""), (9, ""), (None, None)])


def test_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A hot passage in many documents that are no near copies, among them pairs that are;
    blocks of 4 members, slices of 7 rows: as brute force."""
    for name, value in {"BLOCK": 4, "COMPARE_ROWS": 7, "COMPARE_PAIRS": 32}.items():
        monkeypatch.setattr(neardup, name, value)
    hot = prose(500, 60)
    rows = []
    for g in range(25):
        own = prose(g, 30 + g % 7)
        rows.append((len(rows), hot + " " + own))
        if g % 3 == 0:
            rows.append((len(rows), hot + " " + own + " more"))
    docs = spark.createDataFrame(rows, DOCS)
    sets = {d: {tuple(t.encode().lower().split()[i:i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(docs).collect()} == root
    assert 1 < len(set(root.values())) < len(root)


def test_columns_named_like_helpers_pass_through(spark, table):
    """Every internal name as a column of the user's: kept as it is."""
    names = ["_doc", "_digest", "_keep", "_d", "_g", "_n_lines", "_n_kept", "_text", "_seed", "_toxicity", "_scored", "_contamination",
             "_key", "_copies", "_utf8", "node", "digest", "key", "k", "d", "h1", "doc"]
    docs = spark.createDataFrame([(1, "same line here\nother line there"), (2, "same line here\nthird line now")], DOCS)
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    items = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    for out in (linededup.dedup_lines(docs), neardup.drop_near_duplicates(docs), toxicity.keep_clean(docs, {"share": 0.1}),
                decontaminate.remove_contaminated(docs, items), pieces.encode(docs, MODEL_FILE)):
        got = out.collect()
        assert len(got) == 2 and out.columns[:len(docs.columns)] == docs.columns
        assert all(r[name] == f"own {name}" for r in got for name in names)
    counted = linededup.dedup_lines(docs, counts=True).orderBy("doc_id").collect()
    assert [(r._n_lines, r._n_kept, r._doc) for r in counted] == [(2, 2, "own _doc"), (2, 1, "own _doc")]


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(2)
    for n in (10, 300, 5000):
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 8:], r.integers(0, 1 << 62, n // 9, dtype=np.uint64)]))
        x, y = (np.frombuffer(neardup.parity(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_batches_to_python_are_bounded_in_bytes(spark):
    """A task's rows go to Python a few MB at a time, unless the session names a size."""
    import pyarrow as pa
    from riskframe.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    docs = spark.range(0, 3000, 1, 1).withColumn("text", F.repeat(F.lit("words "), 1000))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        found = common.map_batches(docs, sizes, "n long, b long").collect()
        assert sum(r.n for r in found) == 3000
        assert max(r.b for r in found) <= common.ARROW_BYTES + 20_000
        spark.conf.set(key, str(1 << 20))
        found = common.map_batches(docs, sizes, "n long, b long").collect()
        assert spark.conf.get(key).rstrip("b") == str(1 << 20)
        assert max(r.b for r in found) <= (1 << 20) + 20_000
    finally:
        spark.conf.unset(key)


def test_toxicity_sample_starts_no_python_worker(spark, monkeypatch):
    """The sampled ids become a local table: rows of Python objects would be an RDD of Python workers."""
    from pyspark.sql import SparkSession

    given = []
    made = SparkSession.createDataFrame
    docs = made(spark, [(i, f"some words {i % 7} here") for i in range(40)], DOCS)
    labels = made(spark, [(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def watched(self, data, *a, **b):
        given.append(made(self, data, *a, **b))
        return given[-1]

    monkeypatch.setattr(SparkSession, "createDataFrame", watched)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: (len(texts), sum(labels)))
    assert toxicity.learn(docs, labels, F.lit(True)) == (40, 20)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in given]
    assert len(plans) == 2 and all("LocalTableScan" in p for p in plans)
