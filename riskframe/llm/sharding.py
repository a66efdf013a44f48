"""Sharding by best-fit-decreasing bin packing of indivisible groups.

All documents with one text form a group. Groups are packed in two levels,
both by best fit decreasing (largest first, each into the bin with the
smallest remaining capacity that still holds it, found in a balanced tree):

1. in Spark, each cell (a hash range of groups) packs its groups into bundles
   of at most ``total / (n_shards * BUNDLES_PER_SHARD)`` bytes; a larger group
   is a bundle of its own;
2. on the driver, the bundles (some for each shard and at least one for each
   cell, of which there are more where documents are more) are packed into shards. The capacity
   is the smallest one, by binary search, at which best fit decreasing needs
   no more than ``n_shards`` bins, so sizes come out near equal.

Only (key, size, checksum, text digest) rows are shuffled, never texts. The
members of a bundle are numbered in units of at most about ``UNIT_ROWS`` rows,
so a text that a third of all rows share never meets in one task.

Defined results: a null text has size 1 and checksum 0 and groups with other
null texts (not with empty ones); null and repeated keys are ordinary rows; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.joins import bounded_broadcast
from riskframe.session import materialize

BUNDLES_PER_SHARD = 512
CELL_GROUPS = 10_000
UNIT_ROWS = 500


class BinTree:
    """A treap of open bins ordered by (remaining capacity, bin number)."""

    def __init__(self) -> None:
        self.root: list | None = None  # node: [key, priority, left, right]
        self._state = 88172645463325252

    def _priority(self) -> int:
        x = self._state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self._state = x
        return x

    def insert(self, key: tuple[int, int]) -> None:
        node = [key, self._priority(), None, None]
        path, at = [], self.root
        while at is not None and at[1] >= node[1]:
            path.append(at)
            at = at[2] if key < at[0] else at[3]
        if path:
            path[-1][2 if key < path[-1][0] else 3] = node
        else:
            self.root = node
        low, low_side, high, high_side = node, 2, node, 3  # split what hung there around the key
        while at is not None:
            if at[0] < key:
                low[low_side] = at
                low, low_side, at = at, 3, at[3]
            else:
                high[high_side] = at
                high, high_side, at = at, 2, at[2]
        low[low_side] = None
        high[high_side] = None

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest key with remaining capacity >= size."""
        best, best_up, best_side = None, None, 0
        up, side, at = None, 0, self.root
        while at is not None:
            if at[0][0] >= size:
                best, best_up, best_side = at, up, side
                up, side, at = at, 2, at[2]
            else:
                up, side, at = at, 3, at[3]
        if best is None:
            return None
        a, b, up, side = best[2], best[3], best_up, best_side
        while a is not None or b is not None:  # merge the children into its place
            left = b is None or (a is not None and a[1] >= b[1])
            child = a if left else b
            if up is None:
                self.root = child
            else:
                up[side] = child
            if left:
                up, side, a = a, 3, a[3]
            else:
                up, side, b = b, 2, b[2]
        if up is None:
            self.root = None
        else:
            up[side] = None
        return best[0]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (bins numbered as they open). ``sizes`` must
    descend; one above the capacity gets a bin of its own."""
    tree, bins, opened = BinTree(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found = (max(capacity, size), opened)
            opened += 1
        bins.append(found[1])
        tree.insert((found[0] - size, found[1]))
    return bins


def pack_into(sizes: list[int], n_bins: int) -> list[int]:
    """Best fit decreasing at the smallest capacity (binary search) that needs
    at most ``n_bins`` bins. ``sizes`` must descend."""
    if not sizes:
        return []
    low, high = max(sizes[0], math.ceil(sum(sizes) / n_bins)), sizes[0] + math.ceil(sum(sizes) / n_bins)
    best = best_fit_decreasing(sizes, high)
    while low < high:
        mid = (low + high) // 2
        bins = best_fit_decreasing(sizes, mid)
        if max(bins) < n_bins:
            best, high = bins, mid
        else:
            low = mid + 1
    return best


def _bundle_cell(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "g"], ascending=[False, True], kind="stable")
        bins = best_fit_decreasing([int(s) for s in pdf["size"]], capacity)
        return pd.DataFrame({"g": pdf["g"], "cell": pdf["cell"], "bin": bins,
                             "size": pdf["size"], "n": pdf["n"]})
    return run


def shard_documents(docs: DataFrame, n_shards: int = 8, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard."""
    t = F.col(text).cast("string")
    rows = materialize(docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.coalesce(F.md5(t.cast("binary")), F.lit("null")).alias("g")), "op9-rows")
    groups = materialize(rows.groupBy("g").agg(F.sum("size").alias("size"),
                                               F.count(F.lit(1)).alias("n")), "op9-groups")
    total, n_groups = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    capacity = max(1, math.ceil(total / (n_shards * BUNDLES_PER_SHARD)))
    cells = max(1, math.ceil(n_groups / CELL_GROUPS))
    bundled = materialize(
        groups.withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(cells)).cast("int"))
        .groupBy("cell").applyInPandas(_bundle_cell(capacity),
                                       "g string, cell int, bin int, size long, n long"), "op9-bundles")
    bundles = (bundled.groupBy("cell", "bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
               .toPandas().sort_values(["size", "cell", "bin"], ascending=[False, True, True]))
    bundles["shard"] = pack_into([int(s) for s in bundles["size"]], n_shards)
    # rows of a bundle are numbered in units; a unit's offset in its shard is a running sum
    bundles = bundles.sort_values(["shard", "cell", "bin"])
    bundles["units"] = (bundles["n"] + UNIT_ROWS - 1) // UNIT_ROWS
    spark = docs.sparkSession
    where = F.broadcast(spark.createDataFrame(
        [(int(r.cell), int(r.bin), int(r.shard), int(r.units)) for r in bundles.itertuples()],
        "cell int, bin int, shard int, units long"))
    placed = materialize(
        rows.join(bundled.select("g", "cell", "bin"), "g").join(where, ["cell", "bin"])
        .select("key", "size", "crc", "shard", "cell", "bin",
                F.pmod(F.xxhash64("key"), F.col("units")).alias("unit")), "op9-placed")
    unit = ["shard", "cell", "bin", "unit"]
    counts = placed.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("cell", "bin", "unit").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    local = F.row_number().over(Window.partitionBy(*unit).orderBy("key", "crc", "size")) - 1
    return (placed.withColumn("local", local)
            .join(bounded_broadcast(offsets, 100_000), unit)
            .select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"),
                    F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("offset") + F.col("local")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
