"""The star schema over the input tables: genres, artists, albums, tracks, audio features, playlist appearances.

Each relation exists twice: as a lazy DataFrame and as SQL text for the comparison engine. Nothing is cached: a query reads
the columns that it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DURATION_BIN = "case when ms > 0 and ms <= 150000 then 'Short (<2.5m)' when ms > 150000 and ms <= 210000 then 'Medium (2.5-3.5m)' when ms > 210000 and ms <= 300000 then 'Standard (3.5-5m)' when ms > 300000 and ms <= 6000000 then 'Long (>5m)' end"

#: Expressions of one row or one group, valid in Spark and in the comparison engine.
ALBUM_ID = "o_custkey * 10000 + year(o_orderdate)"
POPULARITY = "cast(least(100, floor(o_totalprice / 5000)) as int)"
DURATION = "60000 + (o_orderkey * 7919) % 400000"
FEATURE = {
    "danceability": "max(l_discount) * 10",
    "energy": "max(l_quantity) / 50",
    "loudness": "-60 + max(l_extendedprice) / 2000",
    "speechiness": "min(l_discount) * 10",
    "acousticness": "min(l_quantity) / 50",
    "instrumentalness": "(max(l_linenumber) - 1) / cast(6 as double)",
    "liveness": "min(l_tax) / cast(0.08 as double)",
    "valence": "max(l_tax) / cast(0.08 as double)",
    "tempo": "60 + min(l_extendedprice) / 700",
    "key": "max(cast(l_orderkey % 12 as int))",
    "mode": "max(cast(l_orderkey % 2 as int))",
}

SQL = {
    "genres": "select n_nationkey as genre_id, r_name as genre_name, n_name as subgenre_name from nation join region on n_regionkey = r_regionkey",
    "artists": "select c_custkey as artist_id, c_name as artist_name from customer",
    "albums": f"""select album_id, 'A' || cast(album_id as varchar) as album_name, cast(d as date) as release_date, cast(year(d) as int) as release_year,
        cast(month(d) as int) as release_month, cast(cast(floor(year(d) / 10) as int) * 10 as varchar) || 's' as release_decade
        from (select {ALBUM_ID} as album_id, min(o_orderdate) as d from orders group by 1)""",
    "tracks": f"""select track_id, 'T' || cast(track_id as varchar) as track_name, artist_id, album_id, track_popularity, ms as duration_ms,
        ms / cast(60000 as double) as duration_min, {_DURATION_BIN} as duration_category
        from (select o_orderkey as track_id, o_custkey as artist_id, {ALBUM_ID} as album_id, {POPULARITY} as track_popularity, {DURATION} as ms from orders)""",
    "audio_features": "select l_orderkey as track_id, " + ", ".join(f"{e} as {n}" for n, e in FEATURE.items()) + " from lineitem group by 1",
    "playlist_tracks": "select l_orderkey as track_id, l_suppkey as playlist_id, s_nationkey as genre_id from lineitem join supplier on l_suppkey = s_suppkey",
}
PREFIX = "with " + ", ".join(f"{n} as ({q})" for n, q in SQL.items()) + " "


class Catalog:
    """Lazy relations over one folder of input tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def genres(self) -> DataFrame:
        joined = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(F.col("n_nationkey").alias("genre_id"), F.col("r_name").alias("genre_name"), F.col("n_name").alias("subgenre_name"))

    def artists(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("artist_name"))

    def albums(self) -> DataFrame:
        d = F.col("d")
        first = self.raw("orders").groupBy(F.expr(ALBUM_ID).alias("album_id")).agg(F.min("o_orderdate").alias("d"))
        return first.select(
            "album_id",
            F.concat(F.lit("A"), F.col("album_id").cast("string")).alias("album_name"),
            d.cast("date").alias("release_date"),
            F.year(d).alias("release_year"),
            F.month(d).alias("release_month"),
            F.concat((F.floor(F.year(d) / 10) * 10).cast("int").cast("string"), F.lit("s")).alias("release_decade"),
        )

    def tracks(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("track_id"),
            F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("track_name"),
            F.col("o_custkey").alias("artist_id"),
            F.expr(ALBUM_ID).alias("album_id"),
            F.expr(POPULARITY).alias("track_popularity"),
            F.expr(DURATION).alias("duration_ms"),
            (F.expr(DURATION) / F.lit(60000.0)).alias("duration_min"),
            F.expr(_DURATION_BIN.replace("ms", f"({DURATION})")).alias("duration_category"),
        )

    def audio_features(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_orderkey").alias("track_id")).agg(*[F.expr(e).alias(n) for n, e in FEATURE.items()])

    def playlist_tracks(self) -> DataFrame:
        joined = self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.select(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("playlist_id"), F.col("s_nationkey").alias("genre_id"))

    def relation(self, path: str) -> DataFrame:
        """Relations joined from left to right on the key they share: "tracks artists albums?" (? keeps rows without a match)."""
        names = path.split()

        def step(left: DataFrame, name: str) -> DataFrame:
            right = getattr(self, name.rstrip("?"))()
            return left.join(right, KEYS[name.rstrip("?")], "left" if name.endswith("?") else "inner")

        return reduce(step, names[1:], getattr(self, names[0])())


#: The key under which a relation is joined to what stands before it.
KEYS = {"genres": "genre_id", "artists": "artist_id", "albums": "album_id", "tracks": "track_id", "audio_features": "track_id", "playlist_tracks": "track_id"}


def relation_sql(path: str) -> str:
    first, *rest = path.split()
    return first + "".join(f" {'left ' if n.endswith('?') else ''}join {n.rstrip('?')} using ({KEYS[n.rstrip('?')]})" for n in rest)
