"""Tables and fitted models kept for later applications (SNK2).

An entry's key is a digest of what it was made from: the source's name, the
listing of the source's files (name, length and modification time of each), the
schema of its tables and the parameters of the job. A changed, added or removed
file therefore leads to another entry; nothing is ever updated in place.

Layout, under the folder that ``spark.checkpoint.dir`` names::

    riskframe-store/<key>/data-<attempt>/        the table or model
    riskframe-store/<key>/manifest-<attempt>.json

The manifest is the commit marker. It is written under another name once the
data are complete, and renamed; data without a manifest do not exist for a
reader, so a job that is lost half-way leaves nothing that could be read.
Writers of the same entry do not disturb each other: each has its own attempt,
and readers take the newest one. The manifest records the listing of the data
and their schema; an entry that no longer agrees with it is not used.

Listings are Spark jobs over file names (no content is read), reduced on the
executors to one row. Use renews a manifest's time, and ``clean_up`` removes
what was not used for a given time.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir

FORMAT = 1


def store_root(spark: SparkSession) -> str:
    """The store's folder. A session adds a folder of its own to the checkpoint
    folder it is given; the store lies beside those, where other sessions find it."""
    own = ensure_checkpoint_dir(spark).rstrip("/")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(named or own.rsplit('/', 1)[0]).rstrip('/')}/riskframe-store"


def listing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Number, bytes and an order-free 128-bit digest of the files below ``paths``."""
    file = (F.col("path"), F.col("length"), F.col("modificationTime"))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select("path", "length", "modificationTime"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                    F.coalesce(F.sum(F.xxhash64(*file).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"),
                    F.coalesce(F.bit_xor(F.xxhash64(F.lit("listing"), *file)), F.lit(0)).alias("mixed")).first()
    return [str(v) for v in row]


def entry_key(kind: str, source: str, files: list[str], parameters: dict) -> str:
    made_from = json.dumps([FORMAT, kind, source, files, parameters], sort_keys=True, default=str)
    return f"{kind}-{hashlib.sha256(made_from.encode()).hexdigest()[:40]}"


class _Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.at = path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._utils = spark._jvm.org.apache.commons.io.IOUtils

    def names(self, name: str = "") -> list[tuple[str, float]]:
        """(name, time of last change in seconds) of what lies in the folder."""
        try:
            found = self.fs.listStatus(self._path(f"{self.at}/{name}" if name else self.at))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return []
            raise
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in found]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.at}/{name}"))
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All of ``text`` or, should the writer be lost, no such file."""
        draft = self._path(f"{self.at}/.{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(draft, self._path(f"{self.at}/{name}")):
            raise OSError(f"cannot commit {self.at}/{name}")

    def touch(self, name: str) -> None:
        self.fs.setTimes(self._path(f"{self.at}/{name}"), int(time.time() * 1000), -1)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.at}/{name}"), True)


def _attempt(name: str) -> str:
    return name.removeprefix("manifest-").removesuffix(".json")


def find(spark: SparkSession, key: str) -> dict | None:
    """The newest committed manifest of an entry whose data are as they were
    written, with their place as ``data``; None if there is none."""
    folder = _Folder(spark, f"{store_root(spark)}/{key}")
    names = [x for x in folder.names() if x[0].startswith("manifest-")]
    for name, _ in sorted(names, key=lambda x: -x[1]):
        manifest = json.loads(folder.read(name))
        data = f"{folder.at}/data-{_attempt(name)}"
        try:
            intact = listing(spark, [data]) == manifest["files"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            intact = False
        if intact:
            folder.touch(name)
            return manifest | {"data": data}
    return None


def keep(spark: SparkSession, key: str, write: Callable[[str], dict]) -> dict:
    """The manifest of an entry; where it has none, ``write(path)`` writes the
    data and returns what the manifest shall hold besides."""
    found = find(spark, key)
    if found is not None:
        return found
    folder = _Folder(spark, f"{store_root(spark)}/{key}")
    attempt = uuid.uuid4().hex
    data = f"{folder.at}/data-{attempt}"
    manifest = write(data) | {"files": listing(spark, [data])}
    folder.write(f"manifest-{attempt}.json", json.dumps(manifest))
    return manifest | {"data": data}


def keep_table(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of an entry, built and written as Parquet only where it has none."""
    def write(path: str) -> dict:
        df = build()
        df.write.parquet(path)
        return {"schema": df.schema.json()}

    return spark.read.parquet(keep(spark, key, write)["data"])


def clean_up(spark: SparkSession, unused_seconds: float) -> list[str]:
    """Remove entries not used for ``unused_seconds``, and data of that age that
    were never committed; the removed manifests and data, by name.

    A manifest goes before its data, so that no reader finds a marker of data
    that are already going. Choose a time longer than any job that reads or
    writes an entry takes.
    """
    root = _Folder(spark, store_root(spark))
    before = time.time() - unused_seconds
    removed = []
    for key, _ in root.names():
        changed = dict(root.names(key))
        for name in sorted(changed, key=lambda n: not n.startswith("manifest-")):
            marker = f"manifest-{name.removeprefix('data-')}.json"
            committed = name.startswith("data-") and marker in changed
            # data live as long as their manifest
            if changed[marker if committed else name] < before:
                root.remove(f"{key}/{name}")
                removed.append(f"{key}/{name}")
        if not root.names(key) and changed:
            root.remove(key)
    return sorted(removed)
