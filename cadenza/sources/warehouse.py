"""The star schema as a store: created by numbered steps, loaded with checked keys, published as a whole.

A folder holds one subfolder a version of the data and a log. The log's newest entry names the version that readers see, so a
load that fails leaves what was there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staged import delete, path_of


@dataclass(frozen=True)
class Table:
    """columns: DDL. key: columns that are not null and differ. refers: (columns, table) whose keys must be there; null refers to
    nothing. domain: column to (low, high)."""

    columns: str
    key: tuple[str, ...] = ()
    refers: tuple[tuple[tuple[str, ...], str], ...] = ()
    domain: tuple[tuple[str, float, float], ...] = ()


#: The tables with their keys and the domains of their columns.
STAR = {
    "genres": Table("genre_id int, genre_name string, subgenre_name string", ("genre_id",)),
    "artists": Table("artist_id int, artist_name string", ("artist_id",)),
    "albums": Table("album_id string, album_name string, release_date date, release_year int, release_month int, release_decade string", ("album_id",), (), (("release_month", 1, 12),)),
    "tracks": Table("track_id string, track_name string, artist_id int, album_id string, track_popularity int, duration_ms int, duration_min double, duration_category string", ("track_id",), ((("artist_id",), "artists"), (("album_id",), "albums")), (("track_popularity", 0, 100),)),
    "audio_features": Table("track_id string, danceability double, energy double, loudness double, speechiness double, acousticness double, instrumentalness double, liveness double, valence double, tempo double, key int, mode int", ("track_id",), ((("track_id",), "tracks"),), (("danceability", 0, 1), ("energy", 0, 1), ("loudness", -60, 5), ("valence", 0, 1), ("tempo", 0, 300), ("key", -1, 11), ("mode", 0, 1))),
    "playlist_tracks": Table("track_id string, playlist_id string, playlist_name string, genre_id int", (), ((("track_id",), "tracks"), (("genre_id",), "genres"))),
}


class Rejected(ValueError):
    """A load that broke a rule; violations: (table, rule, rows)."""

    def __init__(self, violations: list[tuple[str, str, int]]):
        super().__init__("; ".join(f"{t}: {rule}: {n} rows" for t, rule, n in violations))
        self.violations = violations


class Warehouse:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table] | None = None):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables or STAR

    # The log.

    def log(self) -> list[dict]:
        """All entries, the oldest first: number, step, version."""
        fs, target = path_of(self.spark, f"{self.path}/log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []
        return [json.loads(self.spark.read.text(f"{self.path}/log/{n}", wholetext=True).first()[0]) for n in names if n.endswith(".json") and n[0] != "."]

    def _enter(self, entry: dict) -> None:
        fs, target = path_of(self.spark, f"{self.path}/log/{entry['number']:08d}.json")
        _, draft = path_of(self.spark, f"{self.path}/log/.{uuid.uuid4().hex}")
        if fs.exists(target):
            raise RuntimeError("another writer was first")
        out = fs.create(draft)
        out.writeBytes(json.dumps(entry))  # ASCII
        out.close()
        if not fs.rename(draft, target):
            raise RuntimeError("another writer was first")

    def migrate(self, steps: list[tuple[str, dict[str, str]]]) -> list[str]:
        """Runs the steps (name, {table: columns to add as DDL}) that the log doesn't have, in their order, and returns their names.
        Run again it does nothing. A new table is an empty one; new columns of an old one are null."""
        log = self.log()
        done, added = {e["step"] for e in log}, []
        for name, change in steps:
            if name in done:
                continue
            log = self.log()
            schema = dict(log[-1]["schema"]) if log else {}
            for table, columns in change.items():
                schema[table] = ", ".join([x for x in (schema.get(table), columns) if x])
            self._enter({"number": len(log), "step": name, "version": log[-1]["version"] if log else None, "schema": schema, "tables": log[-1]["tables"] if log else {}})
            added.append(name)
        return added

    def create(self) -> list[str]:
        return self.migrate([("star", {t: d.columns for t, d in self.tables.items()})])

    # Reading and loading.

    def read(self, table: str) -> DataFrame:
        """The published rows; none before the first load."""
        log = self.log()
        if not log or table not in log[-1]["schema"]:
            raise ValueError(f"{table}: not created")
        schema = T.StructType.fromDDL(log[-1]["schema"][table])
        folders = log[-1]["tables"].get(table, [])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def violations(self, rows: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
        """What these tables, taken as the whole store, break: keys that are null or repeat, references to nothing, values outside
        of their domain. Two aggregations and an anti-join a reference; nothing but counts comes to the driver."""
        out = []
        for name, df in rows.items():
            rule = self.tables.get(name)
            if rule is None:
                continue
            checks = {f"{c} outside of {low} to {high}": F.count_if((F.col(c) < low) | (F.col(c) > high)) for c, low, high in rule.domain if c in df.columns}
            if rule.key:
                null = F.lit(False)
                for c in rule.key:
                    null |= F.col(c).isNull()
                checks[f"null in {', '.join(rule.key)}"] = F.count_if(null)
            if checks:
                found = df.agg(*[v.alias(k) for k, v in checks.items()]).first()
                out += [(name, k, found[k]) for k in checks if found[k]]
            if rule.key:
                n = df.groupBy(*rule.key).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
                out += [(name, f"{', '.join(rule.key)} not unique", n)] * bool(n)
            for columns, other in rule.refers:
                known = rows[other].select(*[F.col(k).alias(c) for c, k in zip(columns, self.tables[other].key, strict=True)])
                n = df.dropna(subset=list(columns)).join(known, list(columns), "left_anti").count()
                out += [(name, f"{', '.join(columns)} not in {other}", n)] * bool(n)
        return out

    def load(self, name: str, new: dict[str, DataFrame]) -> bool:
        """Appends rows to tables as one change: all of it or, if a rule is broken, none (Rejected). A name that the log has is not
        loaded again; false then. Columns are taken by name, missing ones are null."""
        log = self.log()
        if not log:
            raise ValueError("not created")
        if any(e["step"] == name for e in log):
            return False
        version, written = f"data/{uuid.uuid4().hex}", {}
        for table, df in new.items():
            schema = T.StructType.fromDDL(log[-1]["schema"][table])
            rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
            rows.write.parquet(f"{self.path}/{version}/{table}")
            written[table] = f"{version}/{table}"
        tables = dict(log[-1]["tables"])
        for table, folder in written.items():
            tables[table] = [*tables.get(table, []), folder]
        whole = {t: self._folders(log[-1]["schema"][t], tables.get(t, [])) for t in log[-1]["schema"]}
        broken = self.violations(whole)
        if broken:
            delete(self.spark, f"{self.path}/{version}")
            raise Rejected(broken)
        self._enter({"number": len(log), "step": name, "version": version, "schema": log[-1]["schema"], "tables": tables})
        return True

    def _folders(self, ddl: str, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromDDL(ddl)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
