"""Keyed tables in the shared folder, kept in buckets by a hash of the key.

A small JSON manifest per version names the folder of each bucket, so a commit rewrites the buckets
that new rows touch and leaves all others where they are; a reader sees one version or the next.  A
commit may carry the number of its source's batch: a number that is not above the last one committed
changes nothing, so a batch that is delivered again after a failure is counted once.  Manifests hold
as many entries as there are buckets, whatever the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.plans.storage import shuffles_deleted

BUCKETS = 64


class Folder:
    """Small files of a folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, sub: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(sub))) if self._fs.exists(self._at(sub)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write under another name, then rename; an error if the name is taken."""
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            raise RuntimeError(f"{self.path}/{name} was written by another commit")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def set_time(self, name: str, milliseconds: int) -> None:
        self._fs.setTimes(self._at(name), milliseconds, -1)


class Store:
    """A table with one or more rows per key, all of a key in one bucket."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self._folder = Folder(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict:
        versions = [n for n in self._folder.names() if n.startswith("manifest-")]
        return json.loads(self._folder.read(versions[-1])) if versions else {"version": 0, "at": {}, "batches": {}, "schema": None, "prints": {}}

    def read(self, schema: T.StructType | None = None, of: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The newest version, or the buckets ``of`` it; ``schema`` is that of a table without any commit."""
        held = manifest or self.manifest()
        schema = T.StructType.fromJson(held["schema"]) if held["schema"] else schema
        chosen = set(held["at"]) if of is None else {str(b) for b in of} & set(held["at"])
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{held['at'][b]}" for b in sorted(chosen)])

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: no more than there are buckets."""
        return [r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def seen(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.manifest()["batches"].get(batch[0], -1) >= batch[1]

    def commit(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None, prints: dict | None = None, of: list[int] | None = None) -> list[int]:
        """Put ``merge(old, new)`` in place of the buckets that ``new`` touches, or of those given; the buckets written.

        ``new`` is read more than once, so it should be a written table.  ``batch`` is (source,
        number).  ``prints`` are kept with the version.
        """
        held = self.manifest()
        if self.seen(batch):
            return []
        of = self.touched(new) if of is None else of
        if of:
            rows = merge(self.read(new.schema, of, held), new)
            name = f"data/{uuid.uuid4().hex}"
            with shuffles_deleted(self.spark):
                rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{name}")
            written = {n.split("=")[1]: f"{name}/{n}" for n in self._folder.names(name) if n.startswith("_bucket=")}
            at = {b: where for b, where in held["at"].items() if int(b) not in set(of)} | written
            held |= {"at": at, "schema": json.loads(rows.schema.json())}
        batches = held["batches"] | ({batch[0]: batch[1]} if batch else {})
        version = held["version"] + 1
        self._folder.write(f"manifest-{version:09d}.json", json.dumps(held | {"version": version, "batches": batches, "prints": held["prints"] | (prints or {})}))
        return sorted(of)

    def tidy(self) -> None:
        """Delete what the newest version does not name; no reader may still hold an older one."""
        held = self.manifest()
        used = {where.split("/")[1] for where in held["at"].values()}
        for name in self._folder.names("data"):
            if name not in used:
                self._folder.delete(f"data/{name}")
        for name in self._folder.names():
            if name.startswith("_draft-") or name.startswith("manifest-") and name != f"manifest-{held['version']:09d}.json":
                self._folder.delete(name)


def newest_rows(keys: list[str], version: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps the row of the highest version of each key, as an aggregate."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        names = new.columns
        both = old.select(*names).unionByName(new)
        return both.groupBy(*keys).agg(F.max_by(F.struct(*names), version).alias("_row")).select("_row.*")

    return merge


def first_rows(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps what is there and adds one row of each new key."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        names = new.columns
        once = new.groupBy(*keys).agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
        return old.select(*names).unionByName(once.join(old.select(*keys), keys, "left_anti").select(*names))

    return merge


def merged_attributes(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge by key in which given attributes replace old ones and absent ones stay.

    Both tables have a row per key.  Columns that one of them lacks count as absent there.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        names = list(dict.fromkeys([*old.columns, *new.columns]))
        has = lambda df, c, side: F.col(f"{side}.`{c}`") if c in df.columns else F.lit(None)
        joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
        return joined.select(*[F.col(c) if c in keys else F.coalesce(has(new, c, "n"), has(old, c, "o")).alias(c) for c in names])

    return merge
