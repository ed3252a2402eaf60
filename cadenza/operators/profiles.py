"""Taste profiles: decayed and deduplicated signals, group and user vectors, moods, genres; comparison of two users."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import half_up
from ..schema import VECTOR
from ..sources.catalog import Catalog
from .registry import query
from .reports import MOOD, mood
from .signals import SIGNALS_SQL, signals
from .windows import TIE, rounded

NOW = "2024-02-01 00:00:00"


@dataclass(frozen=True)
class Taste:
    """How much groups count, their order where a track is in several, decay a day, the cap of plays, the
    numbers of tracks from which a profile is limited, developing, established."""

    weights: dict[str, float] = field(default_factory=lambda: {"long_term": 1.0, "medium_term": 0.8, "short_term": 0.6, "recent": 1.0, "liked": 1.2, "manual": 1.2})
    precedence: tuple[str, ...] = ("manual", "liked", "recent", "short_term", "medium_term", "long_term")
    decay: dict[str, float] = field(default_factory=lambda: {"recent": 0.08, "liked": 0.005})
    cap: int = 10
    quality: tuple[int, int, int] = (3, 15, 40)


def _lookup(values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in values.items() for x in p])[F.col("source")], F.lit(default))


def weights(rows: DataFrame, taste: Taste, now: str = NOW) -> DataFrame:
    """Adds decay and weight to signals (user_id, source, track_id, played_at, interaction_count, confidence); a missing time is
    neutral, never dropped."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col("played_at").cast("timestamp"))) / 86400e6)
    decay = F.coalesce(F.exp(-_lookup(taste.decay, 0.0) * age), F.lit(1.0))
    often = F.least(F.greatest(F.coalesce("interaction_count", F.lit(1)), F.lit(1)), F.lit(taste.cap)).cast("double")
    sure = F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.01))
    return rows.withColumns({"decay": decay, "weight": decay * often * sure})


def first_source(rows: DataFrame, taste: Taste) -> DataFrame:
    """Each user's track in the group that comes first in precedence."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in taste.precedence]), F.col("source")), F.lit(99))
    order = F.when(order == 0, 99).otherwise(order)
    n = F.row_number().over(W.partitionBy("user_id", "track_id").orderBy(order, F.desc("played_at")))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def weighted_means(rows: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Per group each feature's weighted mean over the rows that have it, and the total weight."""
    w = F.col(weight)
    mean = lambda f: (F.sum(F.when(F.col(f).isNotNull(), F.col(f) * w)) / F.nullif(F.sum(F.when(F.col(f).isNotNull(), w)), F.lit(0.0))).alias(f)
    return rows.groupBy(*by).agg(*[mean(f) for f in VECTOR], F.sum(w).alias("total_weight"), F.count("*").alias("tracks"))


def taste_vectors(rows: DataFrame, features: DataFrame, taste: Taste, now: str = NOW) -> tuple[DataFrame, DataFrame]:
    """Vectors of each user's groups, and of each user (groups weighed by the source weights)."""
    groups = weighted_means(weights(first_source(rows, taste), taste, now).join(features, "track_id"), ["user_id", "source"])
    users = weighted_means(groups.drop("total_weight", "tracks").withColumn("weight", _lookup(taste.weights, 1.0)), ["user_id"]).drop("tracks")
    counts = groups.groupBy("user_id").agg(F.sum("tracks").alias("tracks"))
    a, b, c = taste.quality
    status = F.when(F.col("tracks") < a, "insufficient_data").when(F.col("tracks") < b, "limited").when(F.col("tracks") < c, "developing").otherwise("established")
    return groups, users.join(counts, "user_id").withColumn("status", status)


_T = Taste()
_SIGNAL = "with " + SIGNALS_SQL
_AGE = f"greatest(0, (epoch_us(timestamp '{NOW}') - epoch_us(played_at)) / 86400e6)"
_DECAY = "exp(-(case source when 'recent' then 0.08 when 'liked' then 0.005 else 0 end) * " + _AGE + ")"
_FIRST = ", d as (select * from (select *, row_number() over (partition by user_id, track_id order by list_position(['" + "', '".join(_T.precedence) + "'], source), played_at desc) as k from signals) where k = 1)"
_W = ", w as (select *, " + _DECAY + " * least(interaction_count, 10) as weight from d)"
_G = ", g as (select user_id, source, count(*) as tracks, sum(weight) as total_weight, " + ", ".join(f"sum({f} * weight) / sum(weight) as {f}" for f in VECTOR) + " from w join audio_features using (track_id) group by 1, 2)"
_U = ", u as (select user_id, sum(tracks) as tracks, " + ", ".join(f"sum({f} * sw) / sum(sw) as {f}" for f in VECTOR) + " from (select *, case source " + " ".join(f"when '{k}' then cast({v} as double)" for k, v in _T.weights.items()) + " end as sw from g) group by 1)"


@query("taste_decay", _SIGNAL + " select user_id, source, track_id, round(" + _DECAY + ", 8) as decay, round(" + _DECAY + " * least(interaction_count, 10), 7) as weight from signals")
def taste_decay(c: Catalog) -> DataFrame:
    rows = weights(signals(c).withColumn("confidence", F.lit(1.0)), _T)
    return rows.select("user_id", "source", "track_id", F.round("decay", 8).alias("decay"), F.round("weight", 7).alias("weight"))


@query("taste_dedup", _SIGNAL + _FIRST + " select user_id, source, count(*) as tracks from d group by 1, 2")
def taste_dedup(c: Catalog) -> DataFrame:
    return first_source(signals(c), _T).groupBy("user_id", "source").agg(F.count("*").alias("tracks"))


def _taste(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return taste_vectors(signals(c).withColumn("confidence", F.lit(1.0)), c.audio_features(), _T)


@query("taste_groups", _SIGNAL + _FIRST + _W + _G + " select user_id, source, tracks, round(total_weight, 5) as total_weight, " + ", ".join(f"round({f} * {TIE}, 5) as {f}" for f in VECTOR) + " from g")
def taste_groups(c: Catalog) -> DataFrame:
    return _taste(c)[0].select("user_id", "source", "tracks", F.round("total_weight", 5).alias("total_weight"), *[rounded(F.col(f), 5).alias(f) for f in VECTOR])


@query("taste_final", _SIGNAL + _FIRST + _W + _G + _U + " select user_id, cast(tracks as bigint) as tracks, case when tracks < 3 then 'insufficient_data' when tracks < 15 then 'limited' when tracks < 40 then 'developing' else 'established' end as status, " + ", ".join(f"round({f} * {TIE}, 5) as {f}" for f in VECTOR) + " from u")
def taste_final(c: Catalog) -> DataFrame:
    return _taste(c)[1].select("user_id", "tracks", "status", *[rounded(F.col(f), 5).alias(f) for f in VECTOR])


@query("profile_mood", _SIGNAL + f", m as (select user_id, {mood(0.5, MOOD)} as mood, count(*) as n from signals join audio_features using (track_id) group by 1, 2) select user_id, mood, n, round(n * 100.0 / sum(n) over (partition by user_id) * 1.000000000001, 1) as pct from m")
def profile_mood(c: Catalog) -> DataFrame:
    rows = signals(c).join(c.audio_features(), "track_id").groupBy("user_id", F.expr(mood(0.5, MOOD)).alias("mood")).agg(F.count("*").alias("n"))
    return rows.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("user_id")) * 1.000000000001, 1))


_TG = ", t as (select distinct track_id, genre_name from playlist_tracks join genres using (genre_id)), q as (select user_id, genre_name, count(*) as n from signals join t using (track_id) group by 1, 2), p as (select *, n * 100.0 / sum(n) over (partition by user_id) as pct, row_number() over (partition by user_id order by n desc, genre_name) as k from q)"


@query("profile_genres", _SIGNAL + _TG + " select user_id, genre_name, n, round(pct * 1.000000000001, 2) as pct, k as position from p where k <= 6")
def profile_genres(c: Catalog) -> DataFrame:
    """Each user's six most frequent genres."""
    by = W.partitionBy("user_id")
    track_genres = c.relation("playlist_tracks genres").select("track_id", "genre_name").distinct()
    n = signals(c).join(track_genres, "track_id").groupBy("user_id", "genre_name").agg(F.count("*").alias("n"))
    out = n.withColumns({"pct": F.round(F.col("n") * 100.0 / F.sum("n").over(by) * 1.000000000001, 2), "position": F.row_number().over(by.orderBy(F.desc("n"), "genre_name")).cast("long")})
    return out.where("position <= 6")


#: The ranges on which features of two users are compared.
RANGES = {f: (0.0, 1.0) for f in VECTOR} | {"loudness": (-60.0, 0.0), "tempo": (0.0, 250.0)}


def blend(pairs: DataFrame, users: DataFrame, genres: DataFrame) -> DataFrame:
    """Compatibility of pairs (a, b) of users: features 70 %, genre profiles 30 %.

    users: user_id and features; genres: user_id, genre_name, pct. Returns a, b, feature_score, genre_score, score.
    """
    left, right = (users.select(F.col("user_id").alias(k), *[F.col(f).alias(f"{k}_{f}") for f in VECTOR]) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    share = lambda c, f: F.least(F.greatest((c - RANGES[f][0]) / (RANGES[f][1] - RANGES[f][0]), F.lit(0.0)), F.lit(1.0))
    alike = [half_up((1 - F.abs(share(F.col(f"a_{f}"), f) - share(F.col(f"b_{f}"), f))) * 100 + 1e-9, 1) for f in VECTOR]
    both = both.select("a", "b", (sum(alike[1:], alike[0]) / len(alike)).alias("feature_score"))
    norms = genres.groupBy("user_id").agg(F.sqrt(F.sum(F.col("pct") * F.col("pct"))).alias("norm"))
    g = genres.join(norms, "user_id")
    x, y = (g.select(F.col("user_id").alias(k), "genre_name", (F.col("pct") / F.nullif(F.col("norm"), F.lit(0.0))).alias(f"{k}_share")) for k in ("a", "b"))
    cosines = pairs.join(x, "a").join(y, ["b", "genre_name"]).groupBy("a", "b").agg(F.sum(F.col("a_share") * F.col("b_share")).alias("s"))
    out = both.join(cosines, ["a", "b"], "left").withColumn("genre_score", half_up(F.coalesce("s", F.lit(0.0)) * 100 + 1e-9, 1))
    return out.select("a", "b", F.round("feature_score", 4).alias("feature_score"), "genre_score", half_up(0.7 * F.col("feature_score") + 0.3 * F.col("genre_score") + 1e-9, 1).alias("score"))


def _pairs(c: Catalog) -> DataFrame:
    ids = c.raw("events").select("user_id").distinct()
    return ids.select(F.col("user_id").alias("a")).join(ids.select(F.col("user_id").alias("b")), F.col("a") + 1 == F.col("b"))


_SHARE = lambda k, f: f"least(greatest(({k}.{f} - {RANGES[f][0]}) / {RANGES[f][1] - RANGES[f][0]}, 0), 1)"
_ALIKE = " + ".join(f"floor(((1 - abs({_SHARE('x', f)} - {_SHARE('y', f)})) * 100 + 1e-9) * 10 + 0.5) / 10" for f in VECTOR)
_BLEND = _SIGNAL + _FIRST + _W + _G + _U + f", f as (select x.user_id as a, y.user_id as b, ({_ALIKE}) / {len(VECTOR)} as fs from u x join u y on x.user_id + 1 = y.user_id)"


@query("blend_features", _BLEND + " select a, b, round(fs, 4) as feature_score from f")
def blend_features(c: Catalog) -> DataFrame:
    return blend(_pairs(c), _taste(c)[1], profile_genres(c)).select("a", "b", "feature_score")


@query(
    "blend_genres",
    _SIGNAL + _TG + """, z as (select user_id, genre_name, round(pct * 1.000000000001, 2) as pct from p where k <= 6), n as (select user_id, sqrt(sum(pct * pct)) as norm from z group by 1)
    select x.user_id as a, y.user_id as b, floor((sum(x.pct / nx.norm * (y.pct / ny.norm)) * 100 + 1e-9) * 10 + 0.5) / 10 as genre_score from z x join z y on x.user_id + 1 = y.user_id and x.genre_name = y.genre_name join n nx on nx.user_id = x.user_id join n ny on ny.user_id = y.user_id group by 1, 2""",
)
def blend_genres(c: Catalog) -> DataFrame:
    return blend(_pairs(c), _taste(c)[1], profile_genres(c)).where("genre_score > 0").select("a", "b", "genre_score")


# Three groups instead of six: explicit likes, recent plays, everything else; each counts the same.

THREE = Taste(weights={"long_term": 1.0, "recent": 1.0, "liked": 1.0}, precedence=("liked", "recent", "long_term"), decay={"recent": 0.08})


def three_groups(rows: DataFrame) -> DataFrame:
    """Signals with their source as one of the three groups, one row for each user, group and track."""
    group = F.when(F.col("source").isin("manual", "liked"), "liked").when(F.col("source") == "recent", "recent").otherwise("long_term")
    return rows.groupBy("user_id", group.alias("source"), "track_id").agg(F.max("played_at").alias("played_at"), F.max("interaction_count").alias("interaction_count"))


def complete(features: DataFrame) -> DataFrame:
    """Tracks whose features are all there and finite."""
    fine = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(f) != float("inf")) for f in VECTOR]
    return features.where(_all(fine))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


_THREE = (
    ", g3 as (select user_id, case when source in ('manual', 'liked') then 'liked' when source = 'recent' then 'recent' else 'long_term' end as source, track_id, max(played_at) as played_at, max(interaction_count) as interaction_count from signals group by 1, 2, 3), d as (select * from (select *, row_number() over (partition by user_id, track_id order by list_position(['liked', 'recent', 'long_term'], source)) as k from g3) where k = 1), w as (select *, exp(-(case source when 'recent' then 0.08 else 0 end) * "
    + _AGE
    + ") * least(interaction_count, 10) as weight from d)"
)


@query("taste_three", _SIGNAL + _THREE + _G + " select user_id, cast(sum(tracks) as bigint) as tracks, " + ", ".join(f"round(avg({f}) * {TIE}, 5) as {f}" for f in VECTOR) + " from g group by 1")
def taste_three(c: Catalog) -> DataFrame:
    rows = three_groups(signals(c)).withColumn("confidence", F.lit(1.0))
    return taste_vectors(rows, complete(c.audio_features()), THREE)[1].select("user_id", "tracks", *[rounded(F.col(f), 5).alias(f) for f in VECTOR])


# Keeping signals up to date.


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by (user_id, source, track_id): the later time that is known, the larger count. New rows may repeat a key."""
    once = new.groupBy("user_id", "source", "track_id").agg(F.max("played_at").alias("played_at"), F.max("interaction_count").alias("interaction_count"))
    both = old.select("user_id", "source", "track_id", "played_at", "interaction_count").unionByName(once)
    return both.groupBy("user_id", "source", "track_id").agg(F.max("played_at").alias("played_at"), F.max("interaction_count").alias("interaction_count"))


def like(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds likes (user_id, track_id) that aren't there yet; those that are stay as they are."""
    fresh = new.dropDuplicates(["user_id", "track_id"]).join(old, ["user_id", "track_id"], "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def unlike(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone, ["user_id", "track_id"], "left_anti")


_HALF = "select user_id, case event_type when 'signup' then 'manual' when 'purchase' then 'liked' when 'click' then 'recent' when 'view' then 'short_term' else 'long_term' end as source, 1 + cast(json_extract_string(props, '$.k') as bigint) as track_id, ts, event_id % 2 as h from events"


@query("upsert_signals", f"with e as ({_HALF}), s as (select user_id, source, track_id, h, max(ts) as ts, count(*) as n from e group by 1, 2, 3, 4) select user_id, source, track_id, max(ts) as played_at, max(n) as interaction_count from s group by 1, 2, 3", prefix=False)
def upsert_signals(c: Catalog) -> DataFrame:
    """The second half of the events merged into the first."""
    half = lambda k: signals(_Half(c, k))
    return upsert(half(0), half(1))


class _Half(Catalog):
    """A catalog whose events are those with an even or an odd id."""

    def __init__(self, c: Catalog, k: int):
        super().__init__(c.spark, c.folder)
        self.k = k

    def raw(self, name: str) -> DataFrame:
        df = super().raw(name)
        return df.where(F.col("event_id") % 2 == self.k) if name == "events" else df
