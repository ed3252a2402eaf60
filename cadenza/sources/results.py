"""Results that are kept: under a name, its arguments and the state of the tables that it was made from, for a time."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.staged import delete, path_of

#: Fixed value: seconds for which a result is good.
TTL = 300


def state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files below these paths; no row is read."""
    rows = []
    for path in sorted(paths):
        fs, target = path_of(spark, path)
        if not fs.exists(target):
            rows.append([path, None, None])
            continue
        files = fs.listFiles(target, True)
        while files.hasNext():
            f = files.next()
            rows.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return hashlib.sha256(json.dumps(sorted(rows, key=str)).encode()).hexdigest()


class Results:
    """Results in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float = TTL, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.seconds, self.clock = spark, folder.rstrip("/"), seconds, clock

    def get(self, name: str, arguments: dict, tables: list[str], make: Callable[[], DataFrame]) -> DataFrame:
        """The result of make(), or the one that was kept if it has the same name and arguments, is not too old, and the files of
        tables (paths) are what they were. Older ones of the same name and arguments are deleted when a new one is made.

        A result is whole before it gets the name under which it is found; if two are made at once, the newest counts."""
        asked = hashlib.sha256(json.dumps([name, arguments], sort_keys=True, default=str).encode()).hexdigest()[:32]
        now, seen = self.clock(), state(self.spark, tables)[:32]
        for made, digest, path in self._kept(asked):
            if digest == seen and 0 <= now - made < self.seconds:
                return self.spark.read.parquet(path)
        path = f"{self.folder}/{asked}/{int(now * 1000):015d}-{seen}-{uuid.uuid4().hex[:8]}"
        make().write.parquet(f"{path}.part")
        fs, draft = path_of(self.spark, f"{path}.part")
        _, final = path_of(self.spark, path)
        if not fs.rename(draft, final):
            raise RuntimeError(f"{path}: can't be named")
        for made, _, old in self._kept(asked):
            if old != path and made <= now:
                delete(self.spark, old)
        return self.spark.read.parquet(path)

    def _kept(self, asked: str) -> list[tuple[float, str, str]]:
        """(time, digest of the tables, path) of what is kept, the newest first."""
        fs, target = path_of(self.spark, f"{self.folder}/{asked}")
        names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
        found = [n.split("-") for n in names if not n.endswith(".part")]
        return sorted(((int(t) / 1000, digest, f"{self.folder}/{asked}/{t}-{digest}-{rest}") for t, digest, rest in found), reverse=True)

    def forget(self, name: str, arguments: dict) -> None:
        delete(self.spark, f"{self.folder}/{hashlib.sha256(json.dumps([name, arguments], sort_keys=True, default=str).encode()).hexdigest()[:32]}")
