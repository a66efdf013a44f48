"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path: one 16-byte digest for each turn (role and text), in
turn order. Every distinct prefix is a node.

1. Paths are range-partitioned by (path, conversation) at splitters taken from
   a sample, so a path that a third of all conversations share is dealt to many
   shards. The *skeleton* is the trie of the splitters' paths: a node whose
   members lie in two shards is a prefix of the splitter between them, so every
   node outside the skeleton lies whole in one shard.
2. The skeleton is broadcast (at most ``SKELETON_BYTES`` of splitter paths).
   Each shard is sorted and walked once with a stack: nodes outside the
   skeleton are finished there, skeleton nodes give one partial aggregate for
   each shard.
3. The partial aggregates are reduced by node; the ids that end at a node come
   in shard order, which is their numeric order, so their digest is computed in
   one pass without holding them. The skeleton's subtree sums are then closed
   from the leaves up (as many rows as skeleton nodes), and finished nodes whose
   parent is in the skeleton get its smallest member by a broadcast join.

Bounds: a task holds the open nodes of one path and their finished children,
never more than its shard (about ``SHARD_TURNS`` turns); the driver holds the
sampled paths (about ``SAMPLE_BYTES``) and the skeleton; a conversation's path
is one value (20 bytes a turn).

Defined results: turns are ordered by turn number, null first, equal numbers by
the digest of role and text; null role or text is empty; rows without a
conversation id take no part; repeated rows are turns of their own; an empty
table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.llm.common import fields, slices
from riskframe.session import materialize

DIGEST = 16
SHARD_TURNS = 100_000
OVERSAMPLE = 24  # sampled paths for each shard
SAMPLE_BYTES = 64 << 20
SKELETON_BYTES = 16 << 20

_NUMBERS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def conversation_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, each its digest (hex) and words."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_))
    one = F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), one.alias("one")).filter("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def _path(turns: str) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), ""))


def _splitters(paths: DataFrame) -> list[tuple[bytes, int]]:
    """Sorted (path, conv_id) that cut the paths into shards of about ``SHARD_TURNS`` turns, at least one for each shuffle partition."""
    n, size = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path").cast("long") + 1), F.lit(0))).first()
    shards = max(math.ceil(size / DIGEST / SHARD_TURNS), int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = min(n, OVERSAMPLE * shards, max(1, SAMPLE_BYTES * n // max(size, 1)))
    if wanted < 2:
        return []
    kept = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < math.ceil(wanted / n * (1 << 30)))
    sample = sorted((bytes(r.path), r.conv_id) for r in kept.select("path", "conv_id").collect())
    step = max(1, len(sample) // shards)
    chosen, held = [], 0
    for path, conv in sorted(sample[step::step], key=lambda s: len(s[0])):  # a splitter less joins two shards
        held += len(path) + DIGEST
        if held > SKELETON_BYTES:
            break
        chosen.append((path, conv))
    return sorted(set(chosen))


def _skeleton(splitters: list[tuple[bytes, int]]) -> tuple[list[dict[bytes, int]], list[int]]:
    """(children by digest, parent) of each skeleton node; node 0 is the root."""
    children: list[dict[bytes, int]] = [{}]
    parents = [-1]
    for path, _ in splitters:
        node = 0
        for at in range(0, len(path), DIGEST):
            digest = path[at:at + DIGEST]
            if digest not in children[node]:
                children[node][digest] = len(children)
                children.append({})
                parents.append(node)
            node = children[node][digest]
    return children, parents


class _Open:
    """A node on the walk's stack."""
    __slots__ = ("digest", "bone", "words", "n_convs", "least", "n_children", "n_leaves", "saved", "ends", "rows")

    def __init__(self, digest: bytes, bone: int | None, words: int):
        self.digest, self.bone, self.words = digest, bone, words
        self.n_convs, self.least, self.n_children, self.n_leaves, self.saved = 0, None, 0, 0, 0
        self.ends = [] if bone is not None else hashlib.sha256()
        self.rows: list[list] = []  # its finished children, which wait for its smallest member

    def end(self, conv: int) -> None:
        if self.bone is not None:
            self.ends.append(b"%d" % conv)
        else:
            self.ends.update(b",%d" % conv if self.n_convs else b"%d" % conv)
        self._member(conv, 1)

    def _member(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n_convs += n

    def take(self, child: "_Open", depth: int) -> list[list]:
        """Close a child at ``depth``; rows that are complete, or wait for a skeleton parent only, leave."""
        self._member(child.least, child.n_convs)
        if child.bone is not None:
            return []  # its sums need the other shards
        leaves = child.n_leaves if child.n_children else 1
        saved = child.saved + (child.n_convs - 1) * child.words
        self.n_children += 1
        self.n_leaves += leaves
        self.saved += saved
        for below in child.rows:
            below[2] = child.least
        row = [child.least, depth, None, child.n_convs, child.n_children, leaves, saved, child.ends.hexdigest()]
        if self.bone is not None:
            return [*child.rows, row]
        self.rows.append(row)
        return child.rows


_WALKED = fields(bone="int", shard="int", conv_id="long", depth="long", parent_conv_id="long", n_convs="long", n_children="long",
                 n_leaves="long", saved_tokens="long", ends_sha256="string", words="long", ends="binary")


def _walk(rows, shard: int, children: list[dict[bytes, int]]):
    """Rows of one sorted shard (path, conv_id, words): finished nodes with their parent's bone, then partial aggregates."""
    stack = [_Open(b"", 0, 0)]
    partial = []

    def pop():
        node = stack.pop()
        for r in stack[-1].take(node, len(stack)) if stack else ():
            yield [stack[-1].bone if r[2] is None else -1, None, *r, None, None]
        if node.bone is not None:
            partial.append([node.bone, shard, node.least, len(stack), None, node.n_convs, node.n_children, node.n_leaves,
                            node.saved, None, node.words, b",".join(node.ends)])

    for path, conv, words in rows:
        depth = 0
        while depth < len(stack) - 1 and stack[depth + 1].digest == path[depth * DIGEST:(depth + 1) * DIGEST]:
            depth += 1
        while len(stack) - 1 > depth:
            yield from pop()
        for at in range(depth, len(path) // DIGEST):
            digest = path[at * DIGEST:(at + 1) * DIGEST]
            above = stack[-1].bone
            stack.append(_Open(digest, None if above is None else children[above].get(digest), words[at]))
        stack[-1].end(conv)
    while stack:
        yield from pop()
    yield from partial


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of (conv_id, turns) as ``conversation_turns`` gives them."""
    spark = conversations.sparkSession
    paths = materialize(conversations.select("conv_id", _path("turns").alias("path"),
                                             F.transform("turns", lambda t: t["words"]).alias("words")), "op13-paths")
    splitters = _splitters(paths)
    children, parents = _skeleton(splitters)
    shared = spark.sparkContext.broadcast((splitters, children))
    dealt = fields(shard="int", path="binary", conv_id="long", words="int[]")

    def deal(batches):
        cuts = shared.value[0]
        for batch in batches:
            at = [bisect_right(cuts, s) for s in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(batch.column(c) for c in ("path", "conv_id", "words"))],
                                             schema=to_arrow_schema(dealt))

    def walk(batches):
        from itertools import groupby
        arrow, bones = to_arrow_schema(_WALKED), shared.value[1]

        def each():
            for batch in slices(batches, rows=4096):
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")))

        def batched():
            held = []
            for shard, rows in groupby(each(), key=lambda r: r[0]):
                for row in _walk((r[1:] for r in rows), shard, bones):
                    held.append(row)
                    if len(held) == 4096:
                        yield held
                        held = []
            if held:
                yield held

        for rows in batched():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    sorted_ = (paths.select("path", "conv_id", "words").mapInArrow(deal, dealt)
               .repartition(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id"))
    walked = materialize(sorted_.mapInArrow(walk, _WALKED), "op13-walked")
    bones = _closed(walked.filter("shard IS NOT NULL"), parents)
    columns = ["conv_id", "depth", "parent_conv_id", *_NUMBERS, "ends_sha256"]
    above = F.broadcast(bones.select(F.col("bone").alias("above"), F.col("conv_id").alias("least")))
    finished = walked.filter("shard IS NULL").join(above, F.col("bone") == F.col("above"), "left")
    finished = finished.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "least"))
    return finished.select(columns).unionByName(bones.select(columns))


def _closed(partial: DataFrame, parents: list[int]) -> DataFrame:
    """The skeleton's nodes from their partial aggregates; as many rows as the skeleton has nodes."""
    schema = ("bone int, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
              "words long, ends_sha256 string")

    def reduce(batches):
        """Sorted by (bone, shard): one row for each bone; ids are hashed as they come."""
        from itertools import groupby
        rows = (r for batch in slices(batches, rows=64) for r in batch.to_pylist())
        for bone, group in groupby(rows, key=lambda r: r["bone"]):
            digest, some, least, depth, words = hashlib.sha256(), False, None, 0, 0
            sums = [0, 0, 0, 0]
            for r in group:
                if r["ends"]:
                    digest.update(b"," + r["ends"] if some else r["ends"])
                    some = True
                least = r["conv_id"] if least is None else min(least, r["conv_id"])
                depth, words = r["depth"], r["words"]
                sums = [s + r[c] for s, c in zip(sums, _NUMBERS)]
            yield pa.RecordBatch.from_pydict({
                "bone": pa.array([bone], pa.int32()), "conv_id": pa.array([least], pa.int64()), "depth": pa.array([depth], pa.int64()),
                **{c: pa.array([s], pa.int64()) for c, s in zip(_NUMBERS, sums)},
                "words": pa.array([words], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()])})

    reduced = (partial.filter("n_convs > 0").repartition("bone").sortWithinPartitions("bone", "shard").mapInArrow(reduce, schema))
    nodes = {r.bone: r.asDict() for r in reduced.collect()}
    for bone in sorted(nodes, reverse=True):  # a child's number is above its parent's
        node = nodes[bone]
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        above = nodes.get(parents[bone])
        node["parent_conv_id"] = above["conv_id"] if above else None
        if above:
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    columns = ["bone", "conv_id", "depth", "parent_conv_id", *_NUMBERS, "ends_sha256"]
    return partial.sparkSession.createDataFrame(
        [tuple(n[c] for c in columns) for n in nodes.values()],
        "bone int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
