"""Names and sentences for numbers: skew, strength and direction of a correlation, archetype texts, fingerprints, profile lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import ARCHETYPES, archetype_sql
from ..schema import VECTOR
from ..sources.catalog import Catalog
from .listeners import _MEANS, listener_means
from .profiles import _TG, profile_genres
from .registry import query
from .reports import MOOD, mood
from .signals import SIGNALS_SQL, likes, signals

#: The taglines of the archetypes, in their order.
TAGLINES = (
    "Drawn to rich textures, ambient soundscapes, and non-vocal melodies.",
    "Cherishes organic instruments, warm acoustics, and emotional depth.",
    "Thrives on driving rhythms, electrifying drops, and dancefloor anthems.",
    "Radiates positive vibes, infectious hooks, and sun-drenched melodies.",
    "Passionate about intense beats, minor keys, and dark electronic tension.",
    "Attuned to intricate wordplay, rhythmic cadences, and urban beats.",
    "Loves laid-back tempos, warm chords, and relaxed contentment.",
    "A well-rounded listener with dynamic, multi-dimensional musical tastes.",
)


def skew_label(skew: Column) -> Column:
    side = F.when(skew > 0, "positive").otherwise("negative")
    far = F.when(skew > 0, "positive/right").otherwise("negative/left")
    middle = F.concat(F.lit("moderately skewed ("), side, F.lit(")"))
    return F.when(F.abs(skew) < 0.5, "approximately symmetric").when(F.abs(skew) <= 1, middle).when(skew.isNotNull(), F.concat(F.lit("highly skewed ("), far, F.lit(")")))


def strength_label(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate").when(r.isNotNull(), "strong")


def direction_label(r: Column) -> Column:
    return F.when(r > 0, "positive").when(r.isNotNull(), "negative")


def tagline(archetype: Column) -> Column:
    out = F.lit(TAGLINES[-1])
    for (name, _), line in zip(ARCHETYPES[:-1], TAGLINES[:-1], strict=True):
        out = F.when(archetype == name, line).otherwise(out)
    return out


def fingerprint(ids: Column, digits: int = 8) -> Column:
    """The first hex digits of the SHA-256 of ids (an array), as text in order, joined by bars."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), "|"), 256), 1, digits)


def table_fingerprint(rows: DataFrame, column: str, digits: int = 16) -> DataFrame:
    """One row, fingerprint: of the ids' fingerprints by the first two hex digits of their own hash, so that no task holds all ids."""
    key = F.col(column).cast("string")
    parts = rows.groupBy(F.substring(F.sha2(key, 256), 1, 2).alias("part")).agg(fingerprint(F.collect_list(key), 64).alias("f"))
    return parts.agg(fingerprint(F.collect_list(F.concat("part", "f")), digits).alias("fingerprint"))  # 256 rows


def value_counts(rows: DataFrame, by: list[str], value: str, most: int | None = None) -> DataFrame:
    """Per group how often each value occurs, its share in per cent, and its place; the most frequent first, then by value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    out = n.withColumns({"pct": F.round(F.col("n") * 100.0 / F.sum("n").over(w) * 1.000000000001, 2), "position": F.row_number().over(w.orderBy(F.desc("n"), value)).cast("long")})
    return out if most is None else out.where(F.col("position") <= most)


_SIGNAL = "with " + SIGNALS_SQL
SKEW_SQL = "case when abs(s) < 0.5 then 'approximately symmetric' when abs(s) <= 1 then 'moderately skewed (' || case when s > 0 then 'positive' else 'negative' end || ')' when s is not null then 'highly skewed (' || case when s > 0 then 'positive/right' else 'negative/left' end || ')' end"
_STRENGTH = "case when abs(r) < 0.1 then 'negligible' when abs(r) < 0.3 then 'weak' when abs(r) < 0.5 then 'moderate' when r is not null then 'strong' end"


@query("st_skew_labels", "with x as (select genre_name, skewness(track_popularity) as s from tracks join playlist_tracks using (track_id) join genres using (genre_id) group by 1) select genre_name, round(s, 3) as skewness, " + SKEW_SQL + " as label from x")
def st_skew_labels(c: Catalog) -> DataFrame:
    from .statistics import adjusted_skewness

    rows = c.relation("playlist_tracks genres tracks").groupBy("genre_name").agg(F.count("track_popularity").alias("n"), F.skewness("track_popularity").alias("g"))
    s = adjusted_skewness(F.col("n"), F.col("g"))
    return rows.select("genre_name", F.round(s, 3).alias("skewness"), skew_label(s).alias("label"))


@query(
    "st_strength",
    "with x as (select * from tracks join audio_features using (track_id)), y as (" + " union all ".join(f"select '{f}' as feature, corr({f}, track_popularity) as r from x" for f in VECTOR) + ") select feature, round(r, 4) as r, " + _STRENGTH + " as strength, case when r > 0 then 'positive' when r is not null then 'negative' end as direction from y",
)
def st_strength(c: Catalog) -> DataFrame:
    """How strongly each feature goes with popularity, and in which direction."""
    one = c.relation("tracks audio_features").agg(*[F.corr(f, "track_popularity").alias(f) for f in VECTOR])
    long = one.unpivot([], list(VECTOR), "feature", "r")
    return long.select("feature", F.round("r", 4).alias("r"), strength_label(F.col("r")).alias("strength"), direction_label(F.col("r")).alias("direction"))


_TAG = "case archetype " + " ".join("when '{}' then '{}'".format(a[0], t) for a, t in zip(ARCHETYPES, TAGLINES, strict=True)) + " end"


@query("profile_tagline", _SIGNAL + f", m as (select user_id, {_MEANS} from signals join audio_features using (track_id) group by 1), a as (select user_id, {archetype_sql()} as archetype from m) select user_id, archetype, {_TAG} as tagline from a")
def profile_tagline(c: Catalog) -> DataFrame:
    rows = listener_means(c).select("user_id", F.expr(archetype_sql()).alias("archetype"))
    return rows.withColumn("tagline", tagline(F.col("archetype")))


_L = "l as (select distinct user_id, 1 + cast(json_extract_string(props, '$.k') as bigint) as track_id from events where event_type = 'purchase')"


@query("f_fingerprint", f"with {_L} select user_id, left(sha256(string_agg(cast(track_id as varchar), '|' order by cast(track_id as varchar))), 8) as fingerprint from l group by 1", prefix=False)
def f_fingerprint(c: Catalog) -> DataFrame:
    """A short hash of each user's likes."""
    return likes(c).groupBy("user_id").agg(fingerprint(F.collect_list("track_id")).alias("fingerprint"))


@query(
    "ev_catalog_fingerprint",
    """with p as (select left(sha256(cast(track_id as varchar)), 2) as part, sha256(string_agg(cast(track_id as varchar), '|' order by cast(track_id as varchar))) as f from tracks group by 1)
    select left(sha256(string_agg(part || f, '|' order by part || f)), 16) as fingerprint from p""",
)
def ev_catalog_fingerprint(c: Catalog) -> DataFrame:
    return table_fingerprint(c.tracks(), "track_id")


@query("profile_mood_counts", _SIGNAL + f", m as (select user_id, {mood(0.5, MOOD)} as mood, count(*) as n from signals join audio_features using (track_id) group by 1, 2) select user_id, mood, n, round(n * 100.0 / sum(n) over (partition by user_id) * 1.000000000001, 2) as pct, row_number() over (partition by user_id order by n desc, mood) as position from m")
def profile_mood_counts(c: Catalog) -> DataFrame:
    rows = signals(c).join(c.audio_features(), "track_id").select("user_id", F.expr(mood(0.5, MOOD)).alias("mood"))
    return value_counts(rows, ["user_id"], "mood")


def genre_hits(plays: DataFrame, most: int = 6) -> DataFrame:
    """Per user the genres with the most hits: one for each genre in a play's list of genres, two for each that its artist
    declares; a user without any has "pop". plays: user_id, genres (text, by commas), artist_genres (array)."""
    own = plays.select("user_id", F.explode(F.split("genres", ",\\s*")).alias("genre"), F.lit(1).alias("hits"))
    declared = plays.select("user_id", F.explode("artist_genres").alias("genre"), F.lit(2).alias("hits"))
    n = own.unionByName(declared).where(F.trim("genre") != "").groupBy("user_id", F.lower(F.trim("genre")).alias("genre")).agg(F.sum("hits").alias("hits"))
    ranked = n.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("hits"), "genre")).cast("long")).where(F.col("position") <= most)
    none = plays.select("user_id").distinct().join(n, "user_id", "left_anti").select("user_id", F.lit("pop").alias("genre"), F.lit(0).cast("long").alias("hits"), F.lit(1).cast("long").alias("position"))
    return ranked.unionByName(none)


@query(
    "profile_genre_hits",
    _SIGNAL + """, t as (select distinct track_id, genre_name from playlist_tracks join genres using (genre_id)), d as (select c_custkey as artist_id, r_name as genre from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    h as (select user_id, lower(genre_name) as genre, 1 as hits from signals join t using (track_id) union all select user_id, lower(genre), 2 from signals join tracks using (track_id) join d using (artist_id) where track_id in (select track_id from t)),
    n as (select user_id, genre, sum(hits) as hits from h group by 1, 2), r as (select *, row_number() over (partition by user_id order by hits desc, genre) as position from n)
    select user_id, genre, cast(hits as bigint) as hits, position from r where position <= 6""",
)
def profile_genre_hits(c: Catalog) -> DataFrame:
    texts = c.relation("playlist_tracks genres").groupBy("track_id").agg(F.array_join(F.collect_set("genre_name"), ", ").alias("genres"))
    homes = c.raw("customer").join(c.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(c.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    artists = homes.select(F.col("c_custkey").alias("artist_id"), F.array("r_name").alias("artist_genres"))
    plays = signals(c).join(texts, "track_id").join(c.tracks().select("track_id", "artist_id"), "track_id").join(artists, "artist_id")
    return genre_hits(plays.select("user_id", "genres", "artist_genres"))


@query(
    "profile_full",
    _SIGNAL + _TG + f""", m as (select user_id, count(*) as tracks, {_MEANS} from signals join audio_features using (track_id) group by 1),
    o as (select user_id, {mood(0.5, MOOD)} as mood, count(*) as n from signals join audio_features using (track_id) group by 1, 2), f as (select user_id, mood from (select *, row_number() over (partition by user_id order by n desc, mood) as k from o) where k = 1)
    select m.*, {archetype_sql()} as archetype, mood, coalesce(genre_name, 'pop') as genre from m left join f using (user_id) left join (select user_id, genre_name from p where k = 1) g using (user_id)""",
)
def profile_full(c: Catalog) -> DataFrame:
    """One row for each user: means, archetype, the most frequent mood and genre."""
    first = lambda df, name: df.where("position = 1").select("user_id", name)
    rows = listener_means(c).withColumn("archetype", F.expr(archetype_sql())).join(first(profile_mood_counts(c), "mood"), "user_id", "left")
    rows = rows.join(first(profile_genres(c), "genre_name"), "user_id", "left")
    return rows.select("user_id", "tracks", *VECTOR, "archetype", "mood", F.coalesce("genre_name", F.lit("pop")).alias("genre"))


@query("w_dense_rank", "select track_id, track_popularity, dense_rank() over (order by track_popularity desc nulls last) as position from tracks")
def w_dense_rank(c: Catalog) -> DataFrame:
    """The dense rank of popularity over all tracks: only its different values (at most 101) are ordered in one task."""
    rows = c.tracks().select("track_id", "track_popularity")
    values = rows.select("track_popularity").distinct()
    ranks = values.select(F.col("track_popularity").alias("_p"), F.dense_rank().over(W.orderBy(F.desc_nulls_last("track_popularity"))).cast("long").alias("position"))
    return rows.join(ranks, F.col("track_popularity").eqNullSafe(F.col("_p"))).drop("_p")


