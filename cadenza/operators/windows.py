"""Reports that rank, compare with a total, or list long-form statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.order_stats import in_order, positions, quantiles, running_total
from ..plans.staged import Steps
from ..schema import VECTOR
from ..sources.catalog import Catalog
from .registry import query

TIE = 1.000000000001


def rounded(column, digits: int):
    """Half away from zero, with ties decided on the exact value's side despite floating error."""
    return F.round(column * TIE, digits)


@query(
    "q17a_artist_rank_in_genre",
    """with a as (select artist_name, genre_name, count(distinct track_id) as tracks_in_genre, round(avg(track_popularity) * 1.000000000001, 1) as avg_popularity
        from playlist_tracks join genres using (genre_id) join tracks using (track_id) join artists using (artist_id) group by all having count(distinct track_id) >= 3)
    select * from (select *, dense_rank() over (partition by genre_name order by avg_popularity desc) as rank_within_genre from a) where rank_within_genre <= 5""",
)
def artist_rank_in_genre(c: Catalog, most: int = 5) -> DataFrame:
    rows = c.relation("playlist_tracks genres tracks artists").groupBy("artist_name", "genre_name")
    rows = rows.agg(F.count_distinct("track_id").alias("tracks_in_genre"), rounded(F.avg("track_popularity"), 1).alias("avg_popularity")).where("tracks_in_genre >= 3")
    rank = F.dense_rank().over(W.partitionBy("genre_name").orderBy(F.desc("avg_popularity")))
    return rows.withColumn("rank_within_genre", rank).where(F.col("rank_within_genre") <= most)


@query(
    "q17b_popularity_percentile",
    """select track_name, artist_name, genre_name, track_popularity,
        round(percent_rank() over (partition by genre_name order by track_popularity), 6) as popularity_percentile,
        cast(ntile(10) over (partition by genre_name order by track_popularity, track_id, playlist_id) as int) as popularity_decile
    from tracks join artists using (artist_id) join playlist_tracks using (track_id) join genres using (genre_id)""",
)
def popularity_percentile(c: Catalog) -> DataFrame:
    """Each appearance's percentile and decile in its genre. Genres may be of any size: rows are placed by ranges, and the share
    below a popularity comes from counts."""
    steps = Steps(c.spark, "percentile")
    rows = c.relation("tracks playlist_tracks genres").select("genre_name", "track_popularity", "track_id", "playlist_id")
    placed = positions(steps.write(rows), ["genre_name"], ["track_popularity", "track_id", "playlist_id"], steps, "at", "n")
    counts = placed.groupBy("genre_name", "track_popularity").agg(F.min("at").alias("below")).select(F.col("genre_name").alias("_g"), F.col("track_popularity").alias("_p"), "below")
    placed = placed.join(counts, (F.col("genre_name") == F.col("_g")) & (F.col("track_popularity") == F.col("_p")))
    names = c.relation("tracks artists").select("track_id", "track_name", "artist_name")
    share = F.when(F.col("n") > 1, F.col("below") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(0.0)
    return placed.join(names, "track_id").select("track_name", "artist_name", "genre_name", "track_popularity", F.round(share, 6).alias("popularity_percentile"), nth_part(F.col("at"), F.col("n"), 10).alias("popularity_decile"))


def nth_part(at: Column, n: Column, parts: int) -> Column:
    """In which of so many parts of nearly equal size (the first ones larger) the row at this place of n falls, from 1."""
    small, more = F.floor(n / parts), n % parts
    return F.when(at < more * (small + 1), F.floor(at / (small + 1)) + 1).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1))) + 1).cast("int")


_AGAINST = ("danceability", "energy", "valence", "speechiness", "tempo")


@query(
    "q18a_genre_vs_global",
    "with o as (select "
    + ", ".join(f"avg({f}) as o_{f}" for f in _AGAINST)
    + " from audio_features), g as (select genre_name, "
    + ", ".join(f"avg({f}) as {f}" for f in _AGAINST)
    + " from playlist_tracks join genres using (genre_id) join audio_features using (track_id) group by 1) select genre_name, "
    + ", ".join(f"round(({f} - o_{f}) * 100 / nullif(o_{f}, 0) * 1.000000000001, 1) as {f}_vs_global_pct" for f in _AGAINST)
    + " from g cross join o",
)
def genre_vs_global(c: Catalog) -> DataFrame:
    overall = c.audio_features().agg(*[F.avg(f).alias(f"o_{f}") for f in _AGAINST])
    groups = c.relation("playlist_tracks genres audio_features").groupBy("genre_name").agg(*[F.avg(f).alias(f) for f in _AGAINST])
    share = lambda f: rounded((F.col(f) - F.col(f"o_{f}")) * 100 / F.nullif(F.col(f"o_{f}"), F.lit(0.0)), 1)
    return groups.crossJoin(F.broadcast(overall)).select("genre_name", *[share(f).alias(f"{f}_vs_global_pct") for f in _AGAINST])  # one row


_TABLES = ("artists", "albums", "tracks", "audio_features", "playlist_tracks", "genres")


@query("q21_row_counts", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in _TABLES))
def row_counts(c: Catalog) -> DataFrame:
    parts = [getattr(c, t)().agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "e5_feature_stats",
    " union all ".join(f"select '{f}' as feature, round(min({f}), 4) as min_value, round(max({f}), 4) as max_value, round(avg({f}) * 1.000000000001, 3) as avg_value, round(stddev_samp({f}) * 1.000000000001, 3) as std_value, round(median(cast({f} as double)), 4) as median_value, round(max({f}) - min({f}), 4) as span from audio_features" for f in VECTOR),
)
def feature_stats(c: Catalog) -> DataFrame:
    """Features become rows before they are grouped; medians are exact and hold no group."""
    v, steps = F.col("value"), Steps(c.spark, "features")
    long = c.audio_features().unpivot([], list(VECTOR), "feature", "value")
    long = steps.write(long.withColumn("order", in_order(v)))
    stats = long.groupBy("feature").agg(
        F.round(F.min(v), 4).alias("min_value"),
        F.round(F.max(v), 4).alias("max_value"),
        rounded(F.avg(v), 3).alias("avg_value"),
        rounded(F.stddev_samp(v), 3).alias("std_value"),
        F.round(F.max(v) - F.min(v), 4).alias("span"),
    )
    return stats.join(quantiles(long, ["feature"], "value", "order", [0.5], steps), "feature").withColumn("median_value", F.round(F.col("q")[0], 4)).drop("q")


_LIKES = "select distinct user_id, 1 + cast(json_extract_string(props, '$.k') as bigint) as track_id, max(ts) over (partition by user_id, json_extract_string(props, '$.k')) as liked_at from events where event_type = 'purchase'"


@query(
    "e8_liked_tracks",
    f"""with likes as ({_LIKES}), g as (select track_id, string_agg(distinct genre_name, ', ' order by genre_name) as genres from playlist_tracks join genres using (genre_id) group by 1),
    r as (select user_id, track_id, track_name, artist_name, track_popularity, genres, row_number() over (partition by user_id order by liked_at desc, track_id) as n
        from likes join tracks using (track_id) join artists using (artist_id) left join g using (track_id)) select user_id, track_id, track_name, artist_name, track_popularity, genres, n as position from r where n <= 200""",
)
def liked_tracks(c: Catalog, most: int = 200) -> DataFrame:
    from .signals import likes

    genres = c.relation("playlist_tracks genres").groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_set("genre_name")), ", ").alias("genres"))
    rows = likes(c).join(c.relation("tracks artists"), "track_id").join(genres, "track_id", "left")
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("liked_at"), "track_id")).cast("long")
    return rows.withColumn("position", n).where(F.col("position") <= most).select("user_id", "track_id", "track_name", "artist_name", "track_popularity", "genres", "position")


@query("e11_like_counts", f"with likes as ({_LIKES}) select user_id, count(*) as likes, max(liked_at) as last_liked from likes group by 1")
def like_counts(c: Catalog) -> DataFrame:
    from .signals import likes

    return likes(c).groupBy("user_id").agg(F.count("*").alias("likes"), F.max("liked_at").alias("last_liked"))


@query(
    "eda_multi_playlist",
    "select count(case when n > 1 then 1 end) as tracks_in_many, max(n) as most, round(avg(n), 4) as mean from (select track_id, count(distinct playlist_id) as n from playlist_tracks group by 1)",
)
def multi_playlist(c: Catalog) -> DataFrame:
    per = c.playlist_tracks().groupBy("track_id").agg(F.count_distinct("playlist_id").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("tracks_in_many"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


@query(
    "eda_extremes",
    """select arg_min(track_id, (duration_ms, track_id)) as shortest, arg_max(track_id, (duration_ms, -track_id)) as longest,
        arg_max(track_id, (speechiness, -track_id)) as most_speech, arg_max(track_id, (liveness, -track_id)) as most_live from tracks join audio_features using (track_id)""",
)
def extremes(c: Catalog) -> DataFrame:
    """Ties go to the smallest track id."""
    low, high = F.col("track_id"), -F.col("track_id")
    return c.relation("tracks audio_features").agg(
        F.min_by("track_id", F.struct("duration_ms", low)).alias("shortest"),
        F.max_by("track_id", F.struct(F.col("duration_ms"), high.alias("h"))).alias("longest"),
        F.max_by("track_id", F.struct(F.col("speechiness"), high.alias("h"))).alias("most_speech"),
        F.max_by("track_id", F.struct(F.col("liveness"), high.alias("h"))).alias("most_live"),
    )


@query(
    "eda_genre_radar",
    "with o as (select " + ", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}" for f in VECTOR) + " from audio_features) select genre_name, " + ", ".join(f"round((avg({f}) - any_value(lo_{f})) / nullif(any_value(hi_{f}) - any_value(lo_{f}), 0) * 1.000000000001, 4) as {f}" for f in VECTOR) + " from playlist_tracks join genres using (genre_id) join audio_features using (track_id) cross join o group by 1",
)
def genre_radar(c: Catalog) -> DataFrame:
    ends = c.audio_features().agg(*[g(f).alias(f"{p}_{f}") for f in VECTOR for p, g in (("lo", F.min), ("hi", F.max))])
    means = c.relation("playlist_tracks genres audio_features").groupBy("genre_name").agg(*[F.avg(f).alias(f"m_{f}") for f in VECTOR])
    share = lambda f: rounded((F.col(f"m_{f}") - F.col(f"lo_{f}")) / F.nullif(F.col(f"hi_{f}") - F.col(f"lo_{f}"), F.lit(0.0)), 4)
    return means.crossJoin(F.broadcast(ends)).select("genre_name", *[share(f).alias(f) for f in VECTOR])  # one row


@query("eda_subgenres", "select genre_name, list(distinct subgenre_name order by subgenre_name)::varchar[] as subgenres from genres group by 1".replace("list(distinct subgenre_name order by subgenre_name)::varchar[]", "string_agg(distinct subgenre_name, '|' order by subgenre_name)"))
def subgenres(c: Catalog) -> DataFrame:
    return c.genres().groupBy("genre_name").agg(F.array_join(F.array_sort(F.collect_set("subgenre_name")), "|").alias("subgenres"))


# Reports whose plan is worth writing by hand; the SQL they are compared to stays that of the report.


def _track_genres(c: Catalog) -> DataFrame:
    """(track_id, n, genres): in how many playlists a track appears, and its different genres (as many as there are)."""
    genres = F.broadcast(c.genres().select("genre_id", "genre_name")) if c.genres().count() <= 10_000 else c.genres().select("genre_id", "genre_name")
    return c.playlist_tracks().join(genres, "genre_id").groupBy("track_id").agg(F.count("*").alias("n"), F.collect_set("genre_name").alias("genres"))


@query("q18b_cross_genre_artists")
def cross_genre_artists(c: Catalog, least: int = 3, most: int = 30) -> DataFrame:
    """Artists of three genres or more. Appearances are summed up by track first, so that an artist's tracks are different rows."""
    tracks = c.tracks().select("track_id", "artist_id", "track_popularity").join(_track_genres(c), "track_id").join(c.artists(), "artist_id")
    per = tracks.groupBy("artist_name").agg(F.count("*").alias("total_tracks"), F.sum(F.col("track_popularity") * F.col("n")).alias("s"), F.sum(F.when(F.col("track_popularity").isNotNull(), F.col("n"))).alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("genres")))).alias("g"))
    rows = per.where(F.size("g") >= least)
    rows = rows.select("artist_name", F.size("g").cast("long").alias("genre_count"), F.array_join("g", ", ").alias("genres_list"), "total_tracks", rounded(F.col("s") / F.col("w"), 1).alias("avg_popularity"))
    return rows.orderBy(F.desc("genre_count"), F.desc_nulls_last("avg_popularity"), "artist_name").limit(most)


@query("q15_top_tracks")
def top_tracks(c: Catalog, most: int = 25) -> DataFrame:
    """The most popular tracks; only theirs are joined to features and genres."""
    listed = c.playlist_tracks().select("track_id").distinct()
    some = c.tracks().join(c.artists(), "artist_id").join(listed, "track_id", "left_semi").join(c.raw("lineitem").select(F.col("l_orderkey").alias("track_id")), "track_id", "left_semi")
    top = some.orderBy(F.desc_nulls_last("track_popularity"), "track_id").limit(most)
    keys = F.broadcast(top.select("track_id"))  # `most` rows
    features = Catalog.audio_features(_Few(c, keys))
    lists = _Few(c, keys).playlist_tracks().join(c.genres(), "genre_id").groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_set("genre_name")), ", ").alias("genres"))
    rows = top.join(c.albums(), "album_id", "left").join(features, "track_id").join(lists, "track_id").orderBy(F.desc_nulls_last("track_popularity"), "track_id")
    return rows.select("track_name", "artist_name", "album_name", "release_year", "track_popularity", "duration_min", "danceability", "energy", "valence", "tempo", "genres")


class _Few(Catalog):
    """A catalog whose line items are those of some tracks."""

    def __init__(self, c: Catalog, keys: DataFrame):
        super().__init__(c.spark, c.folder)
        self.keys = keys

    def raw(self, name: str) -> DataFrame:
        df = super().raw(name)
        return df.join(self.keys, df["l_orderkey"] == self.keys["track_id"], "left_semi") if name == "lineitem" else df
