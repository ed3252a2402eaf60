"""Cleaning of raw appearance rows into the star schema, and row-wise derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.features import archetype_sql
from ..schema import FEATURES
from ..plans.order_stats import running_total
from ..plans.staged import Steps
from ..sources.catalog import Catalog
from .registry import query

#: Texts that mean null in raw files.
NULLS = ("nan", "None", "NULL", "")


def trimmed(df: DataFrame) -> DataFrame:
    """All strings trimmed; texts that mean null are null."""
    clean = lambda c: F.when(F.trim(c).isin(*NULLS), None).otherwise(F.trim(c))
    return df.select(*[clean(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def release_parts(c: Column) -> Column:
    """struct(date, year, month, decade) of yyyy, yyyy-mm or yyyy-mm-dd texts; other texts stay as the date, without parts."""
    year, month = F.substring(c, 1, 4).cast("int"), F.substring(c, 6, 2).cast("int")
    shape = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10))
    known = shape.isNotNull()
    month = F.when(c.rlike(r"^\d{4}$"), 1).when(known, month)
    year = F.when(known, year)
    return F.struct(F.coalesce(shape, c).alias("date"), year.alias("year"), month.alias("month"), F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")).alias("decade"))


def clean(raw: DataFrame) -> DataFrame:
    """Raw appearance rows: strings trimmed, rows without track, artist or album name dropped, dates parsed, numbers coerced
    (bad whole numbers 0, bad features null), minutes and duration class derived. Values out of bounds stay."""
    rows = trimmed(raw).na.drop("any", subset=["track_name", "track_artist", "track_album_name"])
    parts = release_parts(F.col("track_album_release_date"))
    whole = lambda n: F.coalesce(F.expr(f"cast(try_cast({n} as double) as int)"), F.lit(0)).alias(n)
    kept = [c for c in rows.columns if c not in FEATURES and c not in ("track_popularity", "duration_ms", "track_album_release_date")]
    numbers = [whole(n) if n in ("key", "mode", "track_popularity", "duration_ms") else F.expr(f"try_cast({n} as double)").alias(n) for n in (*FEATURES, "track_popularity", "duration_ms")]
    out = rows.select(*kept, *numbers, parts.alias("_p")).select(*kept, *FEATURES, "track_popularity", "duration_ms", F.col("_p.date").alias("release_date"), F.col("_p.year").alias("release_year"), F.col("_p.month").alias("release_month"), F.col("_p.decade").alias("release_decade"))
    minutes = F.bround(F.col("duration_ms") / 60000.0, 2)
    m = F.col("duration_min")
    label = F.when((m > 0) & (m <= 2.5), "Short (<2.5m)").when((m > 2.5) & (m <= 3.5), "Medium (2.5-3.5m)").when((m > 3.5) & (m <= 5), "Standard (3.5-5m)").when((m > 5) & (m <= 100), "Long (>5m)")
    return out.withColumn("duration_min", minutes).withColumn("duration_category", label)


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the least order of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def star(cleaned: DataFrame, order: str) -> dict[str, DataFrame]:
    """Dimension and fact tables of cleaned rows; order: a column with the place of each source row.

    Surrogate ids follow the order of natural keys. Numbering a dimension sorts its distinct keys in parts, see running_total().
    """

    steps = Steps(cleaned.sparkSession, "star")

    def ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        once = df.select(*keys).distinct().withColumn("_one", F.lit(1))
        return running_total(once, keys, "_one", name, steps).withColumn(name, (F.col(name) + 1).cast("int")).drop("_one")

    genres = ids(cleaned, ["playlist_genre", "playlist_subgenre"], "genre_id")
    artists = ids(cleaned.withColumnRenamed("track_artist", "artist_name"), ["artist_name"], "artist_id")
    albums = first_of(cleaned.where("track_album_id is not null"), ["track_album_id"], order).select(F.col("track_album_id").alias("album_id"), F.col("track_album_name").alias("album_name"), F.expr("try_cast(release_date as date)").alias("release_date"), "release_year", "release_month", "release_decade")
    one = first_of(cleaned, ["track_id"], order)
    tracks = one.join(artists, one["track_artist"] == artists["artist_name"]).select("track_id", "track_name", "artist_id", F.col("track_album_id").alias("album_id"), "track_popularity", "duration_ms", "duration_min", "duration_category")
    features = one.select("track_id", *FEATURES)
    bridge = cleaned.join(genres, ["playlist_genre", "playlist_subgenre"]).select("track_id", "playlist_id", "playlist_name", "genre_id").distinct()
    return {"genres": genres, "artists": artists, "albums": albums, "tracks": tracks, "audio_features": features, "playlist_tracks": bridge}


_MAKE = "case cast(o_orderkey % 4 as int) when 0 then cast(year(o_orderdate) as varchar) when 1 then substr(cast(o_orderdate as varchar), 1, 7) when 2 then substr(cast(o_orderdate as varchar), 1, 10) else 'unknown' end"


@query("f_date_parse", f"""select decade, count(*) as n, min(year) as first_year, max(month) as last_month, min(date) as first_date from (select d,
    case when d = 'unknown' then d when length(d) = 4 then d || '-01-01' when length(d) = 7 then d || '-01' else d end as date, try_cast(substr(d, 1, 4) as int) as year,
    case when length(d) = 4 then 1 when d <> 'unknown' then cast(substr(d, 6, 2) as int) end as month, case when d <> 'unknown' then cast(try_cast(substr(d, 1, 4) as int) // 10 * 10 as varchar) || 's' end as decade
    from (select {_MAKE} as d from orders)) group by 1""")
def f_date_parse(c: Catalog) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    made = F.when(k == 0, F.substring(day, 1, 4)).when(k == 1, F.substring(day, 1, 7)).when(k == 2, day).otherwise("unknown")
    rows = c.raw("orders").select(release_parts(made).alias("p")).select("p.*")
    return rows.groupBy("decade").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("month").alias("last_month"), F.min("date").alias("first_date"))


@query("f_archetype", f"select {archetype_sql()} as archetype, count(*) as n from audio_features group by 1")
def f_archetype(c: Catalog) -> DataFrame:
    return c.audio_features().groupBy(F.expr(archetype_sql()).alias("archetype")).agg(F.count("*").alias("n"))


_CLASS = "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in text.CLASSES) + " end"


@query("f_genre_class", f"select {_CLASS} as class, count(*) as n from documents group by 1", prefix=False)
def f_genre_class(c: Catalog) -> DataFrame:
    return c.raw("documents").groupBy(text.genre_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("f_normalize", r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))) as digest from documents", prefix=False)
def f_normalize(c: Catalog) -> DataFrame:
    return c.raw("documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("digest"))


_TRI = "list_distinct([substr(' ' || {0} || ' ', i, 3) for i in range(1, length({0}) + 1)])"


@query(
    "f_trigram_dice",
    f"""with n as (select p_partkey, p_name as x, lag(p_name) over (order by p_partkey) as y from part), t as (select p_partkey, x, y, {_TRI.format('x')} as a, {_TRI.format('y')} as b from n where y is not null)
    select p_partkey, round(case when x = y then 1.0 else 2 * len(list_intersect(a, b)) / (len(a) + len(b)) end, 6) as dice from t""",
    prefix=False,
)
def f_trigram_dice(c: Catalog) -> DataFrame:
    """Neighbouring part names; keys are dense, so the neighbour is found by a join, not by a window over all rows."""
    a = c.raw("part").select("p_partkey", F.col("p_name").alias("x"))
    b = c.raw("part").select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("y"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(text.dice(F.col("x"), F.col("y")), 6).alias("dice"))
