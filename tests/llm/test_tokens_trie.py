"""Token counts, token alignment and the prefix trie, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import alignment, prefixtrie, tokencounts
from riskframe.llm.queries import rebuilt_conversations, tokenizer_path

WORD, BYTE, PIECE = map(tokenizer_path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string"


def text_of(seed, n, alphabet="ab cd, e'f 12\n\té ß Ω中文.|<|endoftext|>'s 'll Ünï"):
    r = random.Random(seed)
    parts = ["the ", "Straße ", "l'été ", "don't ", "12345", "中文字", "<|endoftext|>", " \n", "é", "x" * 9, "!?| ", " ", "ǅ", "İ"]
    return "".join(r.choice(parts) if r.random() < 0.5 else r.choice(alphabet) for _ in range(n))


# -- token counts ---------------------------------------------------------------

def library_counts(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def counted(df, **kw):
    return collections.Counter(tuple(r) for r in tokencounts.count_tokens(df, WORD, **kw).select("doc_id", "n_bytes", "n_tokens").collect())


def test_token_counts_match_the_library(spark):
    texts = [None, "", " ", text_of(1, 4000), text_of(2, 900), "a" * 3000, "中" * 2500, ("word " * 800), text_of(3, 4000),
             "é" * 1000 + " tail " * 300, "<|endoftext|>" * 200, "é" * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, texts[3]), (3, texts[8])]
    df = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("own")).withColumn("part", F.lit(7)).withColumn("key", F.lit("k"))
    want = collections.Counter((i, len((t or "").encode()), n) for (i, t), n in zip(rows, library_counts([t for _, t in rows])))
    for kw in ({}, {"chunk": 200, "overlap": 60}, {"chunk": 64, "overlap": 8}):
        assert counted(df, **kw) == want
    assert counted(df, chunk=200, overlap=60, stable=tokencounts.STABLE) == want
    assert tokencounts.count_tokens(df.limit(0), WORD).collect() == []


def test_wider_overlaps_when_nothing_aligns(spark, monkeypatch):
    """A run of letters of 3,000 characters has no stable position: three widenings, then whole."""
    seen = []
    real = tokencounts._spliced
    monkeypatch.setattr(tokencounts, "_spliced", lambda *a: seen.append(a[3]) or real(*a))
    texts = ["start " + "abcdefg" * 430 + " end of it " * 20, "plain words " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = sorted(tokencounts.count_tokens(df, WORD, chunk=256, overlap=64).select("doc_id", "n_tokens").collect())
    assert [r.n_tokens for r in got] == library_counts(texts)
    assert seen == [64, 256, 1024, 4096][:len(seen)] and len(seen) > 2


def test_stable_positions_split_the_encoding():
    """Encoding the two sides of any stable position apart gives the tokens of the whole."""
    import re
    from tokenizers import Tokenizer
    t, stable, separator = Tokenizer.from_file(WORD), re.compile(tokencounts.STABLE), re.compile(tokencounts.SEPARATOR)
    for code in range(0xC0, 0x250):
        assert [x for s in ("ab", chr(code) + "b") for x in t.encode(s, add_special_tokens=False).ids] == t.encode(f"ab {chr(code)}b", add_special_tokens=False).ids
    for seed in range(30):
        text = text_of(seed, 300)
        whole = t.encode(text, add_special_tokens=False).ids
        assert [x for s in separator.split(text) for x in t.encode(s, add_special_tokens=False).ids] == whole
        for m in stable.finditer(text):
            p = m.start()
            assert t.encode(text[:p], add_special_tokens=False).ids + t.encode(text[p:], add_special_tokens=False).ids == whole


def test_unproven_tokenizer_needs_a_pattern():
    with pytest.raises(ValueError, match="stable"):
        tokencounts.check_proven(BYTE)


# -- alignment ------------------------------------------------------------------

def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    ta = Tokenizer.from_file(BYTE)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    vocab = {i: t for t, i in ta.get_vocab(with_added_tokens=True).items()}
    alphabet = alignment.byte_alphabet()

    def bytes_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        ba, bb = [bytes(alphabet[c] for c in vocab[i]) for i in a], list(map(bytes_b, b))
        if not text or not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            docs.append(([], [], []))
            continue
        sa, sb = np.cumsum([0, *map(len, ba)]), np.cumsum([0, *map(len, bb)])
        links = [(i, j) for i in range(len(a)) for j in range(max(0, np.searchsorted(sb, sa[i], "right") - 1), len(b))
                 if sb[j] < sa[i + 1] and sa[i] < sb[j + 1]]
        cuts = sorted(set(sa[1:]) & set(sb[1:]))
        groups = []
        lo = 0
        for cut in cuts:
            groups.append((",".join(str(a[i]) for i in range(len(a)) if lo < sa[i + 1] <= cut) + "|"
                           + ",".join(str(b[j]) for j in range(len(b)) if lo < sb[j + 1] <= cut)))
            lo = cut
        docs.append((a, b, [(a[i], b[j]) for i, j in links], groups))
    counts = collections.Counter(p for d in docs for p in set(d[2]))
    best = collections.defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(len(d[0]), len(d[1]), len(d[3]) if d[0] else 0, len(d[2]), sum(counts[p] == best[p[0]] for p in d[2]),
             sum(counts[p] for p in d[2]), hashlib.sha256(";".join(d[3]).encode()).hexdigest() if d[0] else "") for d in docs]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_matches_brute_force(spark, monkeypatch):
    texts = [None, "", " ", "▁ literal", "hello world", "hello world", "Straße été don't 12345", "日本語 and 🎉 \x00 tail", "  two  blanks ",
             "<|endoftext|> plain <s>", "x" * 400] + [text_of(s, 60) for s in range(25)]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(5, "hello world")]
    df = spark.createDataFrame(rows, DOCS).withColumn("run", F.lit(1)).withColumn("key", F.lit("k")).withColumn("pairs", F.lit("p"))
    want = collections.Counter((i, *row) for (i, _), row in zip(rows, brute_alignment([t for _, t in rows])))
    for small in (False, True):
        if small:  # many runs, a tree of merges, several groups on the way back
            for name, value in {"SLICE_ROWS": 3, "FAN_IN": 2, "GROUP": 3, "BLOCK": 5, "BACK_RUNS": 2}.items():
                monkeypatch.setattr(alignment, name, value)
        got = alignment.align_tokens(df.repartition(3), BYTE, PIECE).select("doc_id", *COLUMNS).collect()
        assert collections.Counter(map(tuple, got)) == want
    assert alignment.align_tokens(df.limit(0), BYTE, PIECE).collect() == []


def test_both_byte_level_libraries_agree_up_to_their_common_characters():
    side = alignment.ByteSide(BYTE)
    assert side._fast is not None
    r = random.Random(5)
    texts = [chr(c) + chr(d) for c in range(0x250) for d in (32, 0x61, 0x31, 0x27, 0xA0, 0xE9, 0x85, 0x1C)]
    texts += ["".join(chr(r.randrange(0x250)) for _ in range(200)) for _ in range(300)]
    texts += ["".join(r.choice(" \t\n \x85ab'sé1") for _ in range(200)) for _ in range(300)] + ["a" * 5000, " " * 5000]
    slow = [x.ids for x in side._library().encode_batch_fast(texts, add_special_tokens=False)]
    assert side.encode(texts) == slow


def test_merged_runs_are_sums():
    r = np.random.default_rng(1)
    runs, total = [], collections.Counter()
    for n in (0, 1, 500, 4000, 3):
        keys = np.unique(r.integers(0, 6000, n))
        counts = r.integers(1, 9, len(keys))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append(alignment.pack_sorted(keys, counts))
    old, alignment.BLOCK = alignment.BLOCK, 100
    try:
        keys, counts = alignment.unpack_sorted(alignment.merge_runs(runs))
    finally:
        alignment.BLOCK = old
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(total) and (np.diff(keys) > 0).all()
    big = np.array([0, 1 << 40, 3])
    assert [list(x) for x in alignment.unpack(alignment.pack(big, np.arange(2)))] == [list(big), [0, 1]]


# -- prefix trie ----------------------------------------------------------------

def brute_trie(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), m, (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        words = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * words
    return collections.Counter(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()) for p, m in nodes.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("turns_a_shard", [100_000, 6])
def test_trie_matches_brute_force(spark, monkeypatch, turns_a_shard):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", turns_a_shard)
    r = random.Random(turns_a_shard)
    rows = []
    for c in range(-25, 160):
        if c % 20 == 0 and c % 40:
            continue  # absent bases
        for t in range(r.choice([1, 1, 2, 5])):
            rows.append((c, r.choice([t, t, None, 1]), r.choice(["user", "bot", None]), r.choice(["a b", "hot turn here", None, "", "c\x0bd e"])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 420) for t in range(4)]  # equal conversations
    rows += [(500, t, "user", f"long {t}") for t in range(300)] + [(None, 1, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("path", F.lit("own")).withColumn("bone", F.lit(1)).withColumn("turns", F.lit(2)).withColumn("digest", F.lit("d"))
    got = prefixtrie.prefix_trie(rebuilt_conversations(df.repartition(4))).select(*NODE).collect()
    assert collections.Counter(map(tuple, got)) == brute_trie(rows)
    assert prefixtrie.prefix_trie(rebuilt_conversations(df.limit(0))).collect() == []


def test_trie_with_a_small_skeleton(spark, monkeypatch):
    """Splitters beyond the skeleton's bound are left out; shards join."""
    monkeypatch.setattr(prefixtrie, "SKELETON_BYTES", 60)
    rows = [(c, t, "user", f"{c % 7} {t}") for c in range(100) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefixtrie.prefix_trie(rebuilt_conversations(df)).select(*NODE).collect()
    assert collections.Counter(map(tuple, got)) == brute_trie(rows)
