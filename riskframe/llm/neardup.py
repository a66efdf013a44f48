"""Near-duplicate documents: tensored MinHash banding, verified on full sets.

A document's set holds its distinct five-word shingles (64-bit hashes). Two
small collections of hashes, A_1..A_m and B_1..B_m, each the combination of
``ROWS`` minhashes, are computed for a set; a table key combines one hash of
each, (A_i, B_j), so 2 m hashes give m^2 tables. Two sets of similarity s meet
in a table with probability (1 - (1 - s^ROWS)^m)^2; at 0.75 and m = 16 a link
is missed once in 270,000.

1. Documents with equal sets form one class (map-side combined, so thousands
   of copies are one row for each task).
2. Two sets share a table exactly when they share some A_i and some B_j: only
   hashes that at least two classes share are combined to table keys.
3. The buckets of the ``DIAGONALS`` * m tables (A_i, B_i), (A_i, B_i+1), ... are
   first resolved as stars: every member against the bucket's representative. Links are confirmed on the full
   sets; connected components are found by alternating large and small stars.
4. Buckets of the same members count once. In a bucket of any table that still
   holds several components, the members outside its
   largest component are compared with all others, in blocks of at most
   ``BLOCK`` members, first on parity bitmaps of the sets (their differing
   bits are never more than the differing shingles, so no link is lost) and
   then on the full sets.
   Two documents that meet in many tables are compared in the first of them
   only. No bucket is capped, and pairs within a component are never made.

Defined results: without words or text a set is empty and linked with nothing
(n_shingles 0, its own component); a null key has component null and is kept;
rows that share a key are judged each by its own text; an empty table gives an
empty result. Extra columns are ignored by ``near_duplicates`` and pass through
``drop_near_duplicates``, which keeps one row of each group also where keys are
null or repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from riskframe.functions.joins import bounded_broadcast
from riskframe.llm.common import binary_text, fresh, map_batches, slices
from riskframe.session import materialize

WORDS = 5
SIDE = 16  # hashes in each of the two collections
ROWS = 2  # minhashes combined to one of them
PARITY_BITS = 2048
DIAGONALS = 3
BLOCK = 256
COMPARE_ROWS = 16_384  # rows of buckets compared together in a task
COMPARE_PAIRS = 1 << 18
BROADCAST_ROWS = 200_000

_RANDOM = np.random.default_rng(20240607)
_SEEDS = _RANDOM.integers(1, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64) | np.uint64(1)
_SHINGLE = _RANDOM.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed(dict):
    """Word -> 64-bit hash, remembered within one batch."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(utf8: bytes | None, hashes: Hashed) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = utf8.lower().split() if utf8 else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    total = np.full(len(h) - n + 1, _SHINGLE[WORDS] * np.uint64(n), np.uint64)
    for k in range(n):
        total = _mix(total + h[k:len(h) - n + 1 + k] * _SHINGLE[k])
    return np.unique(total)


def parity(shingle_set: np.ndarray) -> bytes:
    """Bitmap in which every shingle flips one bit."""
    bit = (_mix(shingle_set) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=PARITY_BITS) % 2 == 1).tobytes()


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minhashes, one row for each (non-empty) set."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), len(_SEEDS)), np.uint32)
    low = (flat >> np.uint64(17)).astype(np.uint32)
    for k, seed in enumerate(_SEEDS):
        mixed = ((flat * seed) >> np.uint64(32)).astype(np.uint32) ^ low
        out[:, k] = np.minimum.reduceat(mixed * np.uint32(2654435761), starts)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of the text, n, node (64-bit digest of the set; null if empty), mins."""
    schema = (StructType().add("key", LongType()).add("digest", BinaryType()).add("n", LongType()).add("node", LongType())
              .add("mins", BinaryType()))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, chars_of="_utf8", max_bytes=1 << 20):
            hashes = Hashed()
            sets = [shingles(t, hashes) for t in batch.column("_utf8").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            mins: list = [None] * len(sets)
            if full:
                for i, row in zip(full, minhashes([sets[i] for i in full])):
                    mins[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("digest").cast(pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) for s in sets], pa.int64()), pa.array(mins, pa.binary())], schema=arrow)

    rows = binary_text(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    return map_batches(rows.select("key", F.unhex(F.md5("_utf8")).alias("digest"), "_utf8"), run, schema)


def node_of(shingle_set: np.ndarray) -> int | None:
    if not len(shingle_set):
        return None
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


def _tables(classes: DataFrame) -> DataFrame:
    """(node, side, k): the combined hashes of both collections."""
    schema = (StructType().add("node", LongType()).add("n", LongType())
              .add("a", ArrayType(LongType())).add("b", ArrayType(LongType())))

    def run(batches):
        arrow = to_arrow_schema(schema)
        number = np.arange(2 * SIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint32).reshape(batch.num_rows, 2 * SIDE, ROWS)
            total = np.broadcast_to(number, (batch.num_rows, 2 * SIDE)).copy()
            for r in range(ROWS):
                total = _mix(total + mins[:, :, r].astype(np.uint64) + np.uint64(r))
            total = _signed(total)
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("n"), pa.array(list(total[:, :SIDE]), arrow.field("a").type),
                pa.array(list(total[:, SIDE:]), arrow.field("b").type)], schema=arrow)

    return map_batches(classes.select("node", "n", "mins"), run, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes), parity of the wanted (key, digest of the text, node)."""
    schema = StructType().add("node", LongType()).add("shingles", BinaryType()).add("parity", BinaryType())

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches, chars_of="_utf8", max_bytes=1 << 20):
            hashes = Hashed()
            sets = [shingles(t, hashes) for t in batch.column("_utf8").to_pylist()]
            keep = [(w, s.tobytes(), parity(s)) for w, s in zip(batch.column("node").to_pylist(), sets) if node_of(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64())] + [
                pa.array([k[i] for k in keep], pa.binary()) for i in (1, 2)], schema=arrow)

    rows = binary_text(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    rows = rows.withColumn("digest", F.unhex(F.md5("_utf8")))
    wanted = bounded_broadcast(wanted.withColumnsRenamed({"key": "k", "digest": "d"}), BROADCAST_ROWS)
    joined = rows.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d"))).select("node", "_utf8")
    return map_batches(joined, run, schema).dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that satisfy 100 * intersection >= 75 * union on the full sets."""
    def run(batches):
        for batch in slices(batches, rows=256):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, by alternating large and small stars
    until the links no longer change; root is the smallest node of the component."""
    def fingerprint(edges):
        return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    def star(edges, both_ways: bool) -> DataFrame:
        """Large stars hang larger neighbours, small stars smaller ones (and the node) on the minimum."""
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(least, "u")
        if both_ways:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u <> v").distinct(), "op10-edges")
    before = None
    while (now := fingerprint(edges)) != before:
        before = now
        edges = materialize(star(materialize(star(edges, True), "op10-large"), False), "op10-small")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _first_table(equal: np.ndarray) -> np.ndarray:
    """Number (i * SIDE + j) of the first table that each row of equal minhashes shares; -1 for none."""
    sides = equal.reshape(len(equal), 2, SIDE, ROWS).all(axis=3)
    return np.where(sides.any(axis=2).all(axis=1), sides[:, 0].argmax(axis=1) * SIDE + sides[:, 1].argmax(axis=1), -1)


def _pairs_of(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a left and a right row of the same group that may be a link
    and whose first shared table is this group's. Both are sorted by group."""
    start = np.searchsorted(right["group"], left["group"], "left")
    many = np.searchsorted(right["group"], left["group"], "right") - start
    upto = np.cumsum(many)
    out = [], []
    at = 0
    while at < len(upto):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] - many[at] + COMPARE_PAIRS, "right")))
        l = np.repeat(np.arange(at, stop), many[at:stop])
        r = np.arange(len(l)) - np.repeat(upto[at:stop] - many[at:stop] - (upto[at] - many[at]), many[at:stop]) + start[l]
        at = stop
        n, m = left["n"][l], right["n"][r]
        # two outer members are compared once
        ok = (left["root"][l] != right["root"][r]) & (right["inner"][r] | (right["node"][r] > left["node"][l]))
        ok &= 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        l, r = l[ok], r[ok]
        for lo in range(0, len(l), COMPARE_PAIRS // 16):
            x, y = l[lo:lo + COMPARE_PAIRS // 16], r[lo:lo + COMPARE_PAIRS // 16]
            # a link differs in at most a seventh of the summed sizes
            apart = np.bitwise_count(left["parity"][x] ^ right["parity"][y]).sum(axis=1, dtype=np.int64)
            near = 7 * apart <= left["n"][x] + right["n"][y]
            x, y = x[near], y[near]
            first = _first_table(left["mins"][x] == right["mins"][y]) == left["table"][x]
            out[0].append(left["node"][x[first]])
            out[1].append(right["node"][y[first]])
    return tuple(np.concatenate([np.empty(0, np.int64), *o]) for o in out)


def _open_pairs(keyed: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may be
    similar enough by their parity bitmaps; each bucket's members outside its largest component
    against all of its members, in blocks. Buckets of the same members count
    once: the one of the first table stands for them."""
    rooted = materialize(keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "op10-rooted")
    rows = rooted.select("node", "n", "root", F.inline("places"))
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"m{salt}") for salt in (1, 2)]
    by_root = rows.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"), F.min("table").alias("table"), *marks)
    open_ = (by_root.groupBy("k").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots"),
                                      F.sum("c").alias("size"), F.min("table").alias("table"), F.bit_xor("m1").alias("m1"),
                                      F.bit_xor("m2").alias("m2"))
             .filter("roots > 1").groupBy("size", "m1", "m2")
             .agg(F.min(F.struct("table", "k", F.col("top.root").alias("top"))).alias("first"))
             .select("first.k", "first.top", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(bounded_broadcast(materialize(open_, "op10-open"), BROADCAST_ROWS), "k")
    # a node meets its sketch once and not in each bucket: its list of buckets has SIDE * SIDE entries at most
    by_node = rows.groupBy("node").agg(F.min("n").alias("n"), F.min("root").alias("root"),
                                       F.collect_list(F.struct("k", "table", "top", "blocks")).alias("places"))
    rows = materialize(by_node.join(sketches, "node"), "op10-members")
    rows = rows.select("node", "n", "root", "mins", "parity", F.inline("places"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    held = rows.select("k", "table", "node", "n", "root", "mins", "parity", block.alias("block"), F.lit(0).alias("asks"),
                       (F.col("root") == F.col("top")).alias("inner"))
    asks = rows.filter("root <> top").select(
        "k", "table", "node", "n", "root", "mins", "parity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("asks"), F.lit(False).alias("inner"))

    columns = ("node", "n", "root", "table", "inner")
    sketch = {"mins": np.uint32, "parity": np.uint64}

    def compare(batches):
        """Rows sorted by (k, block, asks): a block's held members stand before
        those that ask, so only the held members of the last block are carried
        from one slice to the next. All blocks of a slice are compared together."""
        carried, last = None, None
        for batch in slices(batches, rows=COMPARE_ROWS):
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "block")], axis=1)
            group = np.cumsum((np.diff(keys, axis=0) != 0).any(axis=1))
            group = np.append(0, group) + (0 if last is None or (keys[0] == last).all() else 1)
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            rows |= {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(batch.num_rows, -1) for c, t in sketch.items()}
            rows["group"] = group  # the carried rows are of group 0
            asks = batch.column("asks").to_numpy(zero_copy_only=False) == 1
            held = {c: v[~asks] for c, v in rows.items()}
            if carried is not None:
                held = {c: np.concatenate([carried[c], v]) for c, v in held.items()}
            found = _pairs_of({c: v[asks] for c, v in rows.items()}, held)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
            own = held["group"] == group[-1]
            carried, last = {c: v[own] for c, v in held.items()} | {"group": np.zeros(int(own.sum()), np.int64)}, keys[-1]

    rows = held.unionByName(asks).repartition("k", "block").sortWithinPartitions("k", "block", "asks")
    found = map_batches(rows, compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketch = materialize(_sketch(docs, key, text), "op10-sketch")
    of_node = _components_of(docs, sketch.filter("key IS NOT NULL"), key, text)
    found = sketch.select("key", "n", "node").join(of_node.drop("root"), "node", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("key").eqNullSafe(component).alias("kept"))


def _components_of(docs: DataFrame, sketch: DataFrame, key: str, text: str) -> DataFrame:
    """node, root (of its component), component_id (smallest key in it) of every set."""
    classes = materialize(sketch.filter("node IS NOT NULL").groupBy("node")
                          .agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "digest", "n", "mins")).alias("s"))
                          .select("node", "s.*"), "op10-classes")
    tables = materialize(_tables(classes), "op10-tables")
    single = tables.select("node", F.explode(F.concat("a", "b")).alias("h"))
    shared = materialize(single.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "op10-shared")
    sides = (single.join(bounded_broadcast(shared, BROADCAST_ROWS), "h", "left_semi")
             .groupBy("node").agg(F.collect_set("h").alias("h")))
    numbered = {c: F.filter(F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: F.array_contains("h", e["x"]))
                for c in ("a", "b")}
    places = F.flatten(F.transform(numbered["a"], lambda p: F.transform(numbered["b"], lambda q: F.struct(
        (p["i"] * SIDE + q["i"]).alias("table"), F.xxhash64(p["x"], q["x"]).alias("k")))))
    keyed = materialize(tables.join(sides, "node").select("node", "n", places.alias("places")).filter(F.size("places") > 0), "op10-keyed")
    wanted = keyed.select("node").join(classes.select("node", "key", "digest"), "node")
    sets = materialize(_sets_of(docs, materialize(wanted, "op10-wanted"), key, text), "op10-sets")

    # first round: stars in the buckets of the first diagonals of the tables
    diagonal = keyed.select("node", "n", F.inline("places")).filter(
        F.pmod(F.col("table") - F.floor(F.col("table") / SIDE), F.lit(SIDE)) < DIAGONALS)
    buckets = diagonal.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("rep")).filter("c > 1")
    buckets = materialize(buckets.select("k", F.col("rep.node").alias("rep"), F.col("rep.n").alias("rep_n")), "op10-buckets")
    star = (diagonal.join(bounded_broadcast(buckets, BROADCAST_ROWS), "k").filter("node <> rep")
            .filter(4 * F.least("n", "rep_n") >= 3 * F.greatest("n", "rep_n"))
            .select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct())
    links = materialize(_verified(star, sets), "op10-links")
    roots = materialize(components(links), "op10-roots")
    sketches = sets.select("node", "parity").join(classes.select("node", "mins"), "node")
    rest = materialize(_verified(_open_pairs(keyed, roots, sketches), sets), "op10-rest")
    # the second round links components: whole stars of the first round and the new links
    all_links = rest.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
    roots = materialize(components(all_links), "op10-final")
    named = (classes.select("node", "key").join(roots, "node", "left")
             .select("node", "key", F.coalesce("root", "node").alias("root")))
    smallest = named.groupBy("root").agg(F.min("key").alias("component_id"))
    return materialize(named.join(smallest, "root").select("node", "root", "component_id"), "op10-named")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: of the rows with the smallest key (null last) that
    with the smallest digest of its text, repeated rows once. Rows without a word are linked with nothing and stay."""
    sketch = materialize(_sketch(docs, key, text), "op10-sketch")
    of_node = _components_of(docs, sketch, key, text)
    placed = sketch.join(of_node, "node").groupBy("root", "key", "digest").agg(F.count(F.lit(1)).alias("copies"))
    best = F.struct(F.col("key").isNull().alias("last"), "key", "digest", "copies")
    key_, digest_, copies_ = fresh(docs.columns, "_key", "_digest", "_copies")
    kept = (placed.groupBy("root").agg(F.min(best).alias("b"))
            .select(F.col("b.key").alias(key_), F.col("b.digest").alias(digest_), F.col("b.copies").alias(copies_)))
    value = docs[text].cast("string")
    own = docs.join(materialize(kept, "op10-kept"), docs[key].cast("long").eqNullSafe(F.col(key_))
                    & (F.unhex(F.md5(value.cast("binary"))) == F.col(digest_)))
    once = own.filter(F.col(copies_) == 1).select(*docs.columns)
    repeated = own.filter(F.col(copies_) > 1).dropDuplicates([key_, digest_]).select(*docs.columns)
    wordless = docs.filter(~F.coalesce(value.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.unionByName(repeated).unionByName(wordless)
