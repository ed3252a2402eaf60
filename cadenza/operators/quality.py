"""Data checks: nulls, domains, orphans, uniqueness, expected objects and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BOUNDS
from ..sources.catalog import Catalog
from .registry import query

_KEYS = {"genres": "genre_id", "artists": "artist_id", "albums": "album_id", "tracks": "track_id", "audio_features": "track_id"}
_LINKS = [("tracks", "artist_id", "artists"), ("tracks", "album_id", "albums"), ("audio_features", "track_id", "tracks"), ("playlist_tracks", "track_id", "tracks"), ("playlist_tracks", "genre_id", "genres")]
_BOUNDED = [k for k in BOUNDS]


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, different) for every column, in one aggregation."""
    aggs = [f for c in df.columns for f in (F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.count_distinct(c).alias(f"{c}|different"))]
    one = df.agg(F.count("*").alias("|rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("|rows").alias("rows"), F.col(f"{c}|nulls").alias("nulls"), F.col(f"{c}|different").alias("different")) for c in df.columns]
    return one.select(F.inline(F.array(*rows)))


_PROFILED = ("track_id", "artist_id", "album_id", "track_popularity", "duration_ms", "duration_category")


@query("dq_nulls", " union all ".join(f"select '{c}' as column, count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as different from tracks" for c in _PROFILED))
def dq_nulls(c: Catalog) -> DataFrame:
    return profile(c.tracks().select(*_PROFILED))


def violations(df: DataFrame) -> DataFrame:
    """(column, low, high, least, largest, outside): values outside of their domain are counted, never dropped."""
    known = [c for c in _BOUNDED if c in df.columns]
    outside = lambda c: F.count_if((F.col(c) < BOUNDS[c][0]) | (F.col(c) > BOUNDS[c][1]))
    one = df.agg(*[f for c in known for f in (F.min(c).cast("double").alias(f"{c}|a"), F.max(c).cast("double").alias(f"{c}|z"), outside(c).alias(f"{c}|n"))])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(float(BOUNDS[c][0])).alias("low"), F.lit(float(BOUNDS[c][1])).alias("high"), F.round(f"{c}|a", 6).alias("least"), F.round(f"{c}|z", 6).alias("largest"), F.col(f"{c}|n").alias("outside")) for c in known]
    return one.select(F.inline(F.array(*rows)))


@query("dq_bounds", "with x as (select * from tracks join audio_features using (track_id)) " + " union all ".join(f"select '{c}' as column, cast({BOUNDS[c][0]} as double) as low, cast({BOUNDS[c][1]} as double) as high, round(cast(min({c}) as double), 6) as least, round(cast(max({c}) as double), 6) as largest, count(case when {c} < {BOUNDS[c][0]} or {c} > {BOUNDS[c][1]} then 1 end) as outside from x" for c in _BOUNDED))
def dq_bounds(c: Catalog) -> DataFrame:
    return violations(c.relation("tracks audio_features"))


@query("dq_orphans", " union all ".join(f"select '{a}.{k}' as link, count(*) as orphans from {a} where not exists (select 1 from {b} where {b}.{k} = {a}.{k})" for a, k, b in _LINKS))
def dq_orphans(c: Catalog) -> DataFrame:
    parts = [getattr(c, a)().join(getattr(c, b)().select(k), k, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(f"{a}.{k}").alias("link"), "orphans") for a, k, b in _LINKS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_unique", " union all ".join(f"select '{t}.{k}' as key, count(*) - count(distinct {k}) as repeated from {t}" for t, k in _KEYS.items()))
def dq_unique(c: Catalog) -> DataFrame:
    parts = [getattr(c, t)().agg((F.count(k) - F.count_distinct(k)).alias("repeated")).select(F.lit(f"{t}.{k}").alias("key"), "repeated") for t, k in _KEYS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_percentile", "select genre_name, count(*) as n from (select genre_name, percent_rank() over (partition by genre_name order by track_popularity) as p from playlist_tracks join genres using (genre_id) join tracks using (track_id)) where p > 0.98 group by 1")
def dq_percentile(c: Catalog) -> DataFrame:
    """How many appearances lie above the 98th percentile of popularity in their genre. Only the counts of a genre's values
    (at most 101) are put in order."""
    from pyspark.sql import Window as W

    by = W.partitionBy("genre_name")
    n = c.relation("playlist_tracks genres tracks").groupBy("genre_name", "track_popularity").agg(F.count("*").alias("k"))
    below = F.sum("k").over(by.orderBy(F.asc_nulls_last("track_popularity"))) - F.col("k")
    n = n.withColumns({"below": below, "all": F.sum("k").over(by)})
    return n.where(F.col("below") > 0.98 * (F.col("all") - 1)).groupBy("genre_name").agg(F.sum("k").alias("n"))


def expectations(spark: SparkSession, expected: dict[str, int]) -> DataFrame:
    """(table, expected, found, passed) for tables of the session's catalog; a missing table was found with null rows."""
    rows = [(t, n, spark.table(t).count() if spark.catalog.tableExists(t) else None) for t, n in expected.items()]
    out = spark.createDataFrame(rows, "table string, expected long, found long")
    return out.withColumn("passed", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))
