"""Tables that are never half written: files in hash buckets, and a manifest for each version.

    PATH/data/WRITE/_bucket=7/part-*.parquet    files of one write, never changed afterwards
    PATH/manifests/000000000012.json            version 12: schema, keys, and the folder of each bucket

A write puts the buckets that it touches, merged with their old rows, into a folder of its own and
then names the next manifest. Until that rename nothing that readers see has changed; after it, all
of it has. A job that is killed leaves an unnamed folder behind and the old version as it was.
Two writes that start from one version both try for the next number, and the second one fails.

The rename must be atomic and must not replace a file, as on HDFS or a local disk; an object store
needs a committer that gives it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lectern.operators.durable import durable, first_by

BUCKETS = 64


class ConcurrentWrite(RuntimeError):
    """Another write made the version first; read again and retry."""


class VersionedTable:
    """``keys`` tell rows apart and place them; ``buckets`` holds for the table's first write."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]

    # --- versions -----------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """Of the given or the latest version; None for a table that was never written."""
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        number = known[-1] if version is None else version
        line = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0]
        return json.loads(line)

    def _commit(self, manifest: dict) -> int:
        waiting = self._at(f"manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(waiting, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri() if waiting.toUri().getScheme() else self._fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        try:
            files.rename(waiting, self._at(f"manifests/{manifest['version']:012d}.json"), plain)
        except Exception as error:
            self._fs.delete(waiting, False)
            if "FileAlreadyExists" in str(error):
                raise ConcurrentWrite(f"version {manifest['version']} of {self.path} exists already") from None
            raise
        return manifest["version"]

    # --- rows ---------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of one version, by default the latest."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"{self.path} was never written")
        return self._rows(manifest, None)

    def _rows(self, manifest: dict, buckets: Sequence[int] | None) -> DataFrame:
        schema = Ty.StructType.fromJson(manifest["schema"])
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(count)).cast("int")

    def upsert(self, rows: DataFrame) -> int | None:
        """Rows replace those of equal keys (null equals null) or are added; of several with one key the
        first by its JSON text stays. Only touched buckets are read and written. The new version."""
        rows = durable(first_by(self.keys, F.to_json(F.struct("*")), rows).select(*rows.columns))
        return self._merge(rows, lambda old: self._without(old, rows.select(*self.keys), self.keys), None)

    def replace(self, rows: DataFrame, gone: DataFrame) -> int | None:
        """Rows whose columns are named in ``gone`` go, then ``rows`` are upserted, in one version."""
        rows = durable(first_by(self.keys, F.to_json(F.struct("*")), rows).select(*rows.columns))
        gone = durable(gone.distinct())
        drop = lambda old: self._without(self._without(old, gone, gone.columns), rows.select(*self.keys), self.keys)
        return self._merge(rows, drop, gone)

    @staticmethod
    def _without(old: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
        named = others.toDF(*[f"_{c}" for c in on])
        met = [old[c].eqNullSafe(named[f"_{c}"]) for c in on]
        return old.join(named, met[0] if len(met) == 1 else [*met], "left_anti")

    def _merge(self, rows: DataFrame, drop, gone: DataFrame | None) -> int | None:
        now = self.manifest()
        count = now["buckets"] if now else self.buckets
        touched = {r[0] for r in rows.select(self._bucket(count)).distinct().collect()}  # as many as there are buckets
        if now and gone is not None:
            named = gone.toDF(*[f"_{c}" for c in gone.columns])
            old = self._rows(now, None)
            hit = old.join(named, [old[c].eqNullSafe(named[f"_{c}"]) for c in gone.columns], "left_semi")
            touched |= {r[0] for r in hit.select(self._bucket(count)).distinct().collect()}
        if not touched:
            return None
        merged = rows if not now else drop(self._rows(now, touched)).unionByName(rows, allowMissingColumns=True)
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn("_bucket", self._bucket(count)).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        kept = {b: f for b, f in (now["folders"] if now else {}).items() if int(b) not in touched}
        fresh = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}
        return self._commit({
            "version": now["version"] + 1 if now else 1, "buckets": count, "keys": self.keys,
            "schema": merged.schema.jsonValue(), "folders": kept | fresh})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests older than the last ``keep`` and the files that no kept version names. Not
        while a write runs: its folder has no name yet."""
        known = self.versions()
        held = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        unused = [n for n in self._names("data") if n not in held]
        for n in unused:
            self._fs.delete(self._at(f"data/{n}"), True)
        return unused

