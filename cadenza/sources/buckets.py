"""A table in hash buckets that is changed by replacing the buckets that a change touches.

A manifest names the folder of each bucket; a change writes new folders for its buckets and then a new manifest, under its name
in one step. Readers see one manifest or the next. The latest manifest also holds the last change's number, so a change that is
run again after a failure does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staged import delete, path_of

#: Manifests that stay readable after newer ones, with what they name.
KEPT = 2


class Buckets:
    """The table at a path. keys: the columns whose hash says the bucket; their number of buckets stays as it was at first."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        found = self.manifest()
        self.buckets = found["buckets"] if found else buckets
        if found and found["keys"] != keys:
            raise ValueError(f"{path}: keys are {found['keys']}")

    def _versions(self) -> list[int]:
        fs, target = path_of(self.spark, f"{self.path}/manifest")
        if not fs.exists(target):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(target)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest (or that of a version): version, change, keys, buckets, schema, folders by bucket."""
        versions = self._versions()
        if version is None:
            if not versions:
                return None
            version = versions[-1]
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first change."""
        found = self.manifest()
        if found is None:
            return None
        folders = [f for b, f in sorted(found["folders"].items()) if only is None or int(b) in only]
        schema = T.StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], change: int | None = None) -> list[int]:
        """Puts combine(old rows, new rows) in place of the buckets of the new rows; returns these. combine keeps keys in their
        bucket. change: a number that grows; one that was taken already changes nothing."""
        found = self.manifest()
        if found and change is not None and found["change"] is not None and change <= found["change"]:
            return []
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())  # at most the number of buckets
        if found is None:
            old = new.limit(0)
        else:
            old = self.read(touched)
        rows = combine(old, new)
        data = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
        fs, target = path_of(self.spark, f"{self.path}/{data}")
        written = {f.getPath().getName().split("=")[1]: f"{data}/{f.getPath().getName()}" for f in fs.listStatus(target) if f.getPath().getName().startswith("_bucket=")}
        folders = {b: f for b, f in (found["folders"] if found else {}).items() if int(b) not in touched} | written
        schema = found["schema"] if found else json.loads(rows.schema.json())
        self._publish({"version": found["version"] + 1 if found else 0, "change": change if change is not None or not found else found["change"], "keys": self.keys, "buckets": self.buckets, "schema": schema, "folders": folders})
        self._clean()
        return touched

    def _publish(self, manifest: dict) -> None:
        """Under its final name only once it is whole; the name must be free."""
        final = f"{self.path}/manifest/{manifest['version']}.json"
        fs, target = path_of(self.spark, final)
        _, draft = path_of(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        if fs.exists(target):
            raise RuntimeError(f"{final}: another writer was first")
        out = fs.create(draft)
        out.writeBytes(json.dumps(manifest))  # ASCII
        out.close()
        if not fs.rename(draft, target):
            raise RuntimeError(f"{final}: another writer was first")

    def _clean(self) -> None:
        """Deletes manifests but the newest ones, and data that none of these names."""
        versions = self._versions()
        used = {f.rsplit("/", 1)[0] for v in versions[-KEPT:] for f in self.manifest(v)["folders"].values()}
        for v in versions[:-KEPT]:
            delete(self.spark, f"{self.path}/manifest/{v}.json")
        fs, target = path_of(self.spark, f"{self.path}/data")
        for f in fs.listStatus(target) if fs.exists(target) else []:
            if f"data/{f.getPath().getName()}" not in used:
                delete(self.spark, f"{self.path}/data/{f.getPath().getName()}")
