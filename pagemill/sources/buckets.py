"""Keyed tables that are merged in place of being rewritten: rows lie in hash buckets, and a merge writes only those it touches.

    root/data/version=V/bucket=B/...   files of bucket B as version V left it
    root/manifest/version=V/...        (bucket, since): which version's files each bucket has at V, and the mark of V

A version is its manifest: it is written last, and a merge that is repeated (a micro-batch that comes again) starts from the
version before its own and replaces what it wrote. Readers take the newest manifest, or any that is kept. `keep` versions
are kept; files that none of them names are deleted. One writer at a time, as a streaming query is.

A bucket holds any number of keys and is read and written by Spark in parallel; what passes through the driver is one number
for each bucket. Rows have no column named `bucket`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranks import settled

Merge = Callable[[DataFrame], DataFrame]


def _names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _numbers(names: list[str], prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


@dataclass(frozen=True)
class Buckets:
    """A table at `root` with rows of `schema`, dealt by `key` to `buckets` buckets."""

    spark: SparkSession
    root: str
    schema: StructType
    key: tuple[str, ...]
    buckets: int = 64
    keep: int = 2

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def versions(self) -> list[int]:
        """Versions that are whole, in order."""
        done = _numbers(_names(self.spark, f"{self.root}/manifest"), "version=")
        return [v for v in done if "_SUCCESS" in _names(self.spark, f"{self.root}/manifest/version={v}")]

    def manifest(self, version: int | None) -> tuple[dict[int, int], int | None]:
        """Which version's files each bucket has, and the mark; nothing without a version."""
        if version is None:
            return {}, None
        rows = self.spark.read.schema("bucket int, since long, mark long").parquet(f"{self.root}/manifest/version={version}").collect()  # a row for each bucket, and one with the mark
        return {r.bucket: r.since for r in rows if r.bucket >= 0}, next(r.mark for r in rows if r.bucket < 0)

    def _read(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(held.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as a kept version has them, the newest unless said."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"version {version} is not kept")
        return self._read(self.manifest(version if version is not None else known[-1] if known else None)[0])

    def mark(self, before: int | None = None) -> int | None:
        """The mark of the newest version, or of the newest before one."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.manifest(known[-1] if known else None)[1]

    def merge(self, touched: DataFrame, change: Merge, *, version: int, mark: int | None = None) -> None:
        """Version `version`: in the buckets of the keys of `touched` the rows become change(rows); all other buckets keep their files."""
        known = self.versions()
        before = [v for v in known if v < version]
        held, old_mark = self.manifest(before[-1] if before else None)
        asked = [r.bucket for r in touched.select(self.bucket()).distinct().collect()]  # at most `buckets` numbers
        data = f"{self.root}/data/version={version}"
        _delete(self.spark, f"{self.root}/manifest/version={version}")
        _delete(self.spark, data)
        if asked:
            rows = change(self._read({b: v for b, v in held.items() if b in set(asked)}))
            ordered = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("bucket", self.bucket())
            ordered.repartition("bucket", *self.key).write.partitionBy("bucket").parquet(data)
        now = {b: v for b, v in held.items() if b not in set(asked)} | dict.fromkeys(_numbers(_names(self.spark, data), "bucket="), version)
        entries = [(b, v, None) for b, v in now.items()] + [(-1, version, mark if mark is not None else old_mark)]
        self.spark.createDataFrame(entries, "bucket int, since long, mark long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        self.forget()

    def forget(self) -> None:
        """Delete manifests beyond the newest `keep`, and files that no manifest left names."""
        known = self.versions()
        named = {(v, b) for k in known[-self.keep :] for b, v in self.manifest(k)[0].items()}
        for v in known[: -self.keep]:
            _delete(self.spark, f"{self.root}/manifest/version={v}")
        newest = known[-1] if known else -1
        for v in _numbers(_names(self.spark, f"{self.root}/data"), "version="):
            buckets = _numbers(_names(self.spark, f"{self.root}/data/version={v}"), "bucket=")
            left = [b for b in buckets if (v, b) in named]
            if v <= newest and not left:
                _delete(self.spark, f"{self.root}/data/version={v}")
            elif v <= newest:
                for b in set(buckets) - set(left):
                    _delete(self.spark, f"{self.root}/data/version={v}/bucket={b}")


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """New rows in place of old ones of their key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def replace_rows(table: Buckets, rows: DataFrame, *, version: int, whole: tuple[str, ...] | None = None) -> None:
    """Rows in place of those of their key; with `whole`, in place of all rows that share these columns with one of them (the key's buckets must follow from them)."""
    table.merge(rows, lambda old: upsert(old, rows, whole or table.key), version=version)


def write_accepted(readable: Buckets, audit: Buckets, rows: DataFrame, *, version: int) -> None:
    """Both sinks of a run (S14): of the works in it only valid rows are readable, all are audited, and what an earlier run left of them is gone; other works' buckets are not touched.

    Both tables are dealt by the work, so that a work that has no valid row any more loses its readable ones.
    """
    works = rows.select(*readable.key).distinct()
    for table, own in ((readable, rows.filter("ok")), (audit, rows)):
        merged = functools.partial(lambda old, own, key: old.join(works, list(key), "left_anti").unionByName(own), own=own.select(*table.schema.names), key=table.key)
        table.merge(works, merged, version=version)


def keep_previous(table: Buckets, rows: DataFrame, *, version: int) -> None:
    """New rows are each key's `current`, what was current is its `previous`, what was previous is gone (S15); a key without a new row stays as it is.

    table has a column `slot` beside the key; equal keys in rows are an error of the caller.
    """

    def change(old: DataFrame) -> DataFrame:
        again = rows.select(*table.key).distinct()
        stays = old.join(again, list(table.key), "left_anti")
        moved = old.filter("slot = 'current'").join(again, list(table.key), "left_semi").withColumn("slot", F.lit("previous"))
        return stays.unionByName(moved).unionByName(rows.withColumn("slot", F.lit("current")).select(*table.schema.names))

    table.merge(rows, change, version=version)


def refresh(table: Buckets, digests: DataFrame, made: Callable[[DataFrame], DataFrame], *, version: int, digest: str = "digest") -> None:
    """Bring what a table holds of each work up to date (I3): digests(key, digest) say what the works are now.

    Works whose digest is not the stored one, and new ones, are made anew by `made`(their key and digest) -> rows of the
    table's schema; works that are gone go. Of all others only key and digest are read, and their buckets keep their files.
    """
    key = list(table.key)
    now = digests.select(*key, digest).distinct()
    stored = table.read().select(*key, digest).distinct()
    changed = now.join(stored, [*key, digest], "left_anti")
    gone = stored.join(now, key, "left_anti").select(*key)
    touched = settled(changed.select(*key, F.col(digest)).unionByName(gone.withColumn(digest, F.lit(None).cast(dict(now.dtypes)[digest]))))
    again = touched.filter(F.col(digest).isNotNull())
    table.merge(touched, lambda old: old.join(touched.select(*key), key, "left_anti").unionByName(made(again).select(*table.schema.names)), version=version)
