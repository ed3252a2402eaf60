"""Reading and writing tables and small documents: formats by suffix, SQL scripts, JSON artifacts, CSV and Parquet sinks."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURES

#: Raw appearance rows as text files hold them; numbers are read as text, since cleaning coerces them.
RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("track_id", "track_name", "track_artist", "track_popularity", "track_album_id", "track_album_name", "track_album_release_date", "playlist_name", "playlist_id", "playlist_genre", "playlist_subgenre", *FEATURES, "duration_ms")]
)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by its suffix: .parquet, .orc, .json or .csv (header, doubled quotes, line breaks inside of quotes)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    if kind in ("parquet", "orc", "json"):
        return getattr(reader, kind)(path)
    raise ValueError(f"{path}: no reader for this suffix")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw appearance rows with source_row, which ascends with the place in the files."""
    return read(spark, path, RAW if path.endswith(".csv") else None).withColumn("source_row", F.monotonically_increasing_id())


def write(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """A table by its suffix; single: in one file, for small results."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    out = (df.coalesce(1) if single else df).write.mode(mode)
    if kind == "csv":
        out.options(header=True, quote="\"", escape="\"").csv(path)
    elif kind in ("parquet", "orc", "json"):
        getattr(out, kind)(path)
    else:
        raise ValueError(f"{path}: no writer for this suffix")


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def document(df: DataFrame, name: str, most: int = 5000) -> dict[str, Any]:
    """A small result as a JSON document {name: rows}; larger results are refused, since they belong in a table."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return {name: [json.loads(r) for r in rows]}


def save_json(value: Any, path: str, pretty: bool = True) -> None:
    Path(path).write_text(json.dumps(value, indent=2 if pretty else None, separators=None if pretty else (",", ":"), ensure_ascii=False), encoding="utf-8")


def load_json(path: str, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """A JSON object over defaults; objects inside are merged key by key."""

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    found = json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}
    return merge(defaults or {}, found)


def statements(script: str) -> list[str]:
    """The statements of a SQL script: whole-line comments go, semicolons inside of quotes don't end a statement."""
    text = "\n".join(line for line in script.splitlines() if not line.strip().startswith("--"))
    parts = re.findall(r"(?:'(?:[^']|'')*'|\"[^\"]*\"|[^;'\"])+", text)
    return [p.strip() for p in parts if p.strip()]


def run_script(spark: SparkSession, script: str, args: dict[str, Any] | None = None) -> list[DataFrame]:
    """Runs statements one after another, each on its own: there are no transactions."""
    return [spark.sql(s, args=args) if args else spark.sql(s) for s in statements(script)]


def fetch_all(spark: SparkSession, sql: str, args: dict[str, Any] | None = None, most: int = 100_000) -> list[dict[str, Any]]:
    """The rows of a small result as dictionaries; a larger one is refused, since it belongs in a table."""
    rows = (spark.sql(sql, args=args) if args else spark.sql(sql)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def fetch_one(spark: SparkSession, sql: str, args: dict[str, Any] | None = None) -> dict[str, Any] | None:
    """The first row, or none."""
    row = (spark.sql(sql, args=args) if args else spark.sql(sql)).first()
    return None if row is None else row.asDict(recursive=True)


def fetch_scalar(spark: SparkSession, sql: str, args: dict[str, Any] | None = None) -> Any:
    """The first column of the first row, or none."""
    row = (spark.sql(sql, args=args) if args else spark.sql(sql)).first()
    return None if row is None else row[0]


def as_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): the other columns of each row as one JSON object; nulls are written."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("document"))


def from_documents(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the fields of their document (JSON) as columns; a text that is no such document has nulls."""
    return rows.withColumn("document", F.from_json("document", schema)).select(*[c for c in rows.columns if c != "document"], "document.*")
