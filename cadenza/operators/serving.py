"""What a request asks for: bounds of its arguments, filtered recommendations with relaxation, seeds by text, replaced rows,
invitations with an expiry, shared recommendations of two users."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import cosine
from ..plans.staged import Steps
from ..schema import VECTOR
from ..sources.catalog import Catalog
from .profiles import _TG, profile_genres
from .recommend import Scaler
from .registry import query
from .signals import SIGNALS_SQL, likes, signals
from .windows import rounded

#: Bounds and defaults of a request's arguments.
LIMITS = {"limit": (1, 50, 10), "min_popularity": (0, 90, 0), "artists": (1, 100, 20)}
GENRE_LENGTH = 30


def bounded(name: str, value: object) -> int:
    """An argument inside of its bounds; the default where it is no number."""
    low, high, default = LIMITS[name]
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


def clean_genre(value: object) -> str:
    """Letters, digits, spaces, hyphens and ampersands of a genre name, at most GENRE_LENGTH of them."""
    kept = "".join(ch for ch in str(value or "").lower() if ch.isascii() and (ch.isalnum() or ch in " -&"))
    return kept.strip()[:GENRE_LENGTH].strip()


def filtered(scored: DataFrame, limit: int, min_popularity: int = 0, genres: Iterable[str] = (), digits: int | None = None, relax: bool = True) -> DataFrame:
    """The most similar candidates of each persona: persona, track_id, similarity, position, relaxed.

    scored: persona, track_id, track_popularity, genre, similarity, without the persona's seeds. Where no candidate of a persona
    passes popularity and genre, all of them count again (relax). digits: similarity is rounded before it is ordered by.
    """
    wanted = [g.lower() for g in genres]
    ok = F.coalesce(F.col("track_popularity") >= min_popularity, F.lit(False))
    if wanted:
        ok &= F.coalesce(F.lower("genre").isin(wanted), F.lit(False))
    rows = scored.withColumn("_ok", ok)
    if relax:
        some = rows.groupBy(F.col("persona").alias("_persona")).agg(F.max("_ok").alias("_some"))
        rows = rows.join(some, F.col("persona") == F.col("_persona")).withColumn("relaxed", ~F.col("_some")).where(F.col("_ok") | F.col("relaxed"))
    else:
        rows = rows.where("_ok").withColumn("relaxed", F.lit(False))
    if digits is not None:
        rows = rows.withColumn("similarity", F.round("similarity", digits))
    best = W.partitionBy("persona").orderBy(F.desc("similarity"), F.desc("track_popularity"), "track_id")
    out = rows.withColumn("position", F.row_number().over(best).cast("long")).where(F.col("position") <= limit)
    return out.select("persona", "track_id", "similarity", "position", "relaxed")


def seeds_by_text(hits: DataFrame, catalog: DataFrame, n: int = 3, popular: int = 50) -> DataFrame:
    """(persona, track_id): of each persona's hits (persona, track_id, track_popularity, place) the first n popular ones; where
    these are fewer, the first n of all; a persona without hits has the catalog's first n tracks. hits may hold null tracks."""
    w = W.partitionBy("persona")
    good = F.coalesce(F.col("track_popularity") >= popular, F.lit(False))
    rows = hits.where(F.col("track_id").isNotNull()).withColumn("_enough", F.sum(good.cast("int")).over(w) >= n).where(~F.col("_enough") | good)
    found = rows.withColumn("_n", F.row_number().over(w.orderBy("place"))).where(F.col("_n") <= n).select("persona", "track_id")
    first = catalog.select("track_id").orderBy("track_id").limit(n)
    bare = hits.select("persona").distinct().join(found, "persona", "left_anti")
    return found.unionByName(bare.join(F.broadcast(first), F.lit(True), "cross"))  # n rows


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str], latest: str) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of new rows with one key the latest counts."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(latest)))
    once = new.withColumn("_n", n).where("_n = 1").drop("_n")
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once)


def invitation_status(now: Column) -> Column:
    """The status of an invitation (status, expires_at) at a time: what is pending beyond its end has expired."""
    return F.when((F.col("status") == "pending") & (F.col("expires_at") < now), "expired").otherwise(F.col("status"))


def accepted(invitations: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all invitations, changed ones) after answers (invite_id, user_id, answered_at).

    The first answer before the end counts, unless it is the creator's own; it needs a pending invitation. invitations:
    invite_id, creator_id, status, expires_at, participant_id, accepted_at.
    """
    open_ = invitations.where("status = 'pending'").select("invite_id", "creator_id", "expires_at")
    fit = answers.join(open_, "invite_id").where((F.col("user_id") != F.col("creator_id")) & (F.col("answered_at") <= F.col("expires_at")))
    first = fit.groupBy(F.col("invite_id").alias("_id")).agg(F.min(F.struct("answered_at", "user_id")).alias("_a"))
    rows = invitations.join(first, F.col("invite_id") == F.col("_id"), "left").withColumn("_new", F.col("_a").isNotNull())
    rows = rows.withColumns({"status": F.when(F.col("_new"), "accepted").otherwise(F.col("status")), "participant_id": F.coalesce("_a.user_id", "participant_id"), "accepted_at": F.coalesce("_a.answered_at", "accepted_at")})
    return rows.select(invitations.columns), rows.where("_new").select(invitations.columns)


def ingested(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows with their source, counts per source with the number of different tracks): repeats go inside of a source only."""
    parts = [df.select("user_id", "track_id").distinct().withColumn("source", F.lit(k)) for k, df in sources.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("user_id").agg(*[F.count_if(F.col("source") == k).alias(f"{k}_count") for k in sources], F.count("*").alias("total_raw"), F.count_distinct("track_id").alias("unique_tracks"))
    return rows, counts


def shared(pairs: DataFrame, vectors: DataFrame, genres: DataFrame, artists: DataFrame) -> DataFrame:
    """Of pairs (a, b): both users' mean vector, genre shares halved and added, sets of genres (both, either, only one), artists
    that both have. vectors: user_id, vector; genres: user_id, genre_name, pct; artists: user_id, artist."""
    g = genres.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("genre_name", "pct"))).alias("g"))
    a = artists.groupBy("user_id").agg(F.array_sort(F.collect_set("artist")).alias("artists"))
    user = vectors.join(g, "user_id", "left").join(a, "user_id", "left")
    left, right = (user.select(*[F.col(c).alias(f"{k}_{c}" if c != "user_id" else k) for c in user.columns]) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    keys = lambda k: F.coalesce(F.map_keys(f"{k}_g"), F.array().cast("array<string>"))
    share = lambda k, x: F.coalesce(F.try_element_at(F.col(f"{k}_g"), x), F.lit(0.0)) / 2
    every = F.array_sort(F.array_union(keys("a"), keys("b")))
    none = F.array().cast("array<string>")
    return both.select(
        "a",
        "b",
        F.zip_with("a_vector", "b_vector", lambda x, y: (x + y) / 2).alias("vector"),
        F.map_from_arrays(every, F.transform(every, lambda x: share("a", x) + share("b", x))).alias("genres"),
        F.array_sort(F.array_intersect(keys("a"), keys("b"))).alias("common_genres"),
        F.array_sort(F.array_except(keys("a"), keys("b"))).alias("only_a"),
        F.array_sort(F.array_except(keys("b"), keys("a"))).alias("only_b"),
        F.array_sort(F.array_intersect(F.coalesce("a_artists", none), F.coalesce("b_artists", none))).alias("shared_artists"),
    )


# Queries. Personas are genres, their seeds five tracks that a hash draws.

#: The seed of the draw.
SEED = 42

_Z = "z as (select " + ", ".join(f"avg({f}) as m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) as s_{f}" for f in VECTOR) + " from audio_features)"
_V = "v as (select track_id, [" + ", ".join(f"({f} - m_{f}) / s_{f}" for f in VECTOR) + "] as vec from audio_features cross join z)"
_G = "tg as (select track_id, min(genre_name) as genre from playlist_tracks join genres using (genre_id) group by 1)"
_S = f"s as (select persona, track_id from (select genre as persona, track_id, row_number() over (partition by genre order by md5('{SEED}:' || track_id), track_id) as k from tg join tracks using (track_id) join audio_features using (track_id)) where k <= 5)"
_U = "u as (select persona, [" + ", ".join(f"avg(vec[{i + 1}])" for i in range(len(VECTOR))) + "] as uv from s join v using (track_id) group by 1)"
_COS = "list_dot_product(vec, uv) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(uv, uv)))"
PERSONAS_SQL = f"{_Z}, {_V}, {_G}, {_S}, {_U}, c as materialized (select u.persona, v.track_id, track_popularity, genre, round({_COS}, 9) as sim from u cross join v join tracks using (track_id) join tg using (track_id) where not exists (select 1 from s where s.persona = u.persona and s.track_id = v.track_id))"


def persona_tables(c: Catalog, seed: int = SEED, n: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, Scaler]:
    """(tracks with vector and genre, personas with user_vector, their seeds, the scaler), each written once. A persona is a genre;
    its seeds are the n tracks of the genre that a hash with this seed puts first."""
    steps = Steps(c.spark, "personas")
    rows = c.audio_features()
    scaler = Scaler.fit(rows)
    genre = c.relation("playlist_tracks genres").groupBy("track_id").agg(F.min("genre_name").alias("genre"))
    tracks = rows.select("track_id", scaler.vector().alias("vector")).join(c.tracks().select("track_id", "track_popularity", "artist_id"), "track_id").join(genre, "track_id", "left")
    tracks = steps.write(tracks)
    draw = F.row_number().over(W.partitionBy("genre").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("track_id").cast("string"))), "track_id"))
    seeds = steps.write(tracks.where("genre is not null").withColumn("_n", draw).where(F.col("_n") <= n).select(F.col("genre").alias("persona"), "track_id"))
    mean = [F.avg(F.element_at("vector", i + 1)) for i in range(len(VECTOR))]
    users = steps.write(seeds.join(tracks.select("track_id", "vector"), "track_id").groupBy("persona").agg(F.array(*mean).alias("user_vector")))
    return tracks.where("genre is not null"), users, seeds, scaler


#: Personas that are compared with the catalog at once.
AT_ONCE = 1000


def persona_scores(c: Catalog, seed: int = SEED, tables: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored candidates of each persona, their seeds), written once: metrics and checks read them again and again. Personas
    are queries against the whole catalog, at most AT_ONCE of them sent to all tasks at a time."""
    tracks, users, seeds, _ = tables or persona_tables(c, seed)
    steps, scored = Steps(c.spark, "scores"), None
    blocks = -(-users.count() // AT_ONCE)
    for b in range(max(1, blocks)):
        part = users if blocks < 2 else users.where(F.pmod(F.xxhash64("persona"), F.lit(blocks)) == b)
        pairs = tracks.join(F.broadcast(part), F.lit(True), "cross").join(seeds, ["persona", "track_id"], "left_anti")
        rows = steps.write(pairs.select("persona", "track_id", "track_popularity", "genre", F.round(cosine(F.col("vector"), F.col("user_vector")), 9).alias("similarity")))
        scored = rows if scored is None else scored.unionByName(rows)
    return scored, seeds


_PICK = "select persona, track_id, {sim} as similarity, position, relaxed from (select *, row_number() over (partition by persona order by {sim} desc, track_popularity desc, track_id) as position from ({rows})) where position <= {limit}"
_ASK = "select *, not any_ok as relaxed from (select *, coalesce(max(ok) over (partition by persona), false) as any_ok from (select *, coalesce(track_popularity >= {pop} and lower(genre) in ('asia', 'europe'), false) as ok from c)) where ok or not any_ok"


@query("rec_filtered", f"with {PERSONAS_SQL} " + _PICK.format(sim="sim", limit=10, rows=_ASK.format(pop=60)))
def rec_filtered(c: Catalog) -> DataFrame:
    """Ten tracks of two genres with popularity 60 or more for each persona."""
    return filtered(persona_scores(c)[0], 10, 60, ("Asia", "Europe"))


@query("rec_relaxed", f"with {PERSONAS_SQL} " + _PICK.format(sim="sim", limit=5, rows=_ASK.format(pop=101)))
def rec_relaxed(c: Catalog) -> DataFrame:
    """No track has popularity 101, so the filters are relaxed for all personas."""
    return filtered(persona_scores(c)[0], 5, 101, ("Asia", "Europe"))


@query("rec_browser", f"with {PERSONAS_SQL} " + _PICK.format(sim="round(sim, 4)", limit=10, rows="select *, false as relaxed from c where track_popularity >= 20"))
def rec_browser(c: Catalog) -> DataFrame:
    """Similarity rounded to four digits before it is ordered by, without relaxation."""
    return filtered(persona_scores(c)[0], 10, 20, digits=4, relax=False)


@query(
    "f_leaderboard",
    "select artist_name, count(*) as tracks, round(avg(track_popularity) * 1.000000000001, 2) as avg_popularity from tracks join artists using (artist_id) where contains(lower(artist_name), '0012') group by 1 order by avg_popularity desc, artist_name limit 10",
)
def f_leaderboard(c: Catalog) -> DataFrame:
    """The first ten artists whose name holds a text."""
    rows = c.relation("tracks artists").where(F.lower("artist_name").contains("0012"))
    n = bounded("limit", "ten")
    return rows.groupBy("artist_name").agg(F.count("*").alias("tracks"), rounded(F.avg("track_popularity"), 2).alias("avg_popularity")).orderBy(F.desc("avg_popularity"), "artist_name").limit(n)


@query(
    "rec_seeds_by_text",
    """with q as (select * from (values ('a', '00012'), ('b', '0009'), ('c', 'nothing like that')) t(persona, words)), r as (select persona, track_id, track_popularity, row_number() over (partition by persona order by track_popularity desc, track_id) as place from q join (select * from tracks join artists using (artist_id)) on contains(lower(track_name), words) or contains(lower(artist_name), words)),
    h as (select * from r where place <= 10), n as (select *, count(*) filter (track_popularity >= 50) over (partition by persona) >= 3 as enough from h), p as (select *, row_number() over (partition by persona order by place) as k from n where not enough or track_popularity >= 50)
    select persona, track_id from p where k <= 3 union all select persona, track_id from q cross join (select track_id from tracks order by track_id limit 3) where persona not in (select persona from h)""",
)
def rec_seeds_by_text(c: Catalog) -> DataFrame:
    from .listeners import search

    rows = c.relation("tracks artists").select("track_id", "track_name", "artist_name", "track_popularity")
    place = F.row_number().over(W.partitionBy("persona").orderBy(F.desc("track_popularity"), "track_id"))
    hits = None
    for persona, words in (("a", "00012"), ("b", "0009"), ("c", "nothing like that")):
        part = search(rows, words).select(F.lit(persona).alias("persona"), "track_id", "track_popularity")
        hits = part if hits is None else hits.unionByName(part)
    asked = c.spark.createDataFrame([("a",), ("b",), ("c",)], "persona string")
    ranked = asked.join(hits.withColumn("place", place), "persona", "left")
    return seeds_by_text(ranked, c.tracks())


_INV = "i as (select event_id as invite_id, user_id as creator_id, case event_type when 'error' then 'completed' else 'pending' end as status, ts + interval 2 day as expires_at from events where event_id % 5 = 0), r as (select event_id - event_id % 5 as invite_id, user_id, ts as answered_at from events where event_id % 5 <> 0)"


@query(
    "blend_invitations",
    f"with {_INV}, f as (select invite_id, first(user_id order by answered_at, user_id) as participant_id from r join i using (invite_id) where status = 'pending' and user_id <> creator_id and answered_at <= expires_at group by 1) select invite_id, case when participant_id is not null then 'accepted' when status = 'pending' and expires_at < timestamp '2024-01-20 00:00:00' then 'expired' else status end as status, participant_id from i left join f using (invite_id)",
    prefix=False,
)
def blend_invitations(c: Catalog) -> DataFrame:
    """Every fifth event as an invitation, the four after it as answers; what is open at a later time has expired."""
    e = c.raw("events")
    status = F.when(F.col("event_type") == "error", "completed").otherwise("pending")
    rows = e.where("event_id % 5 = 0").select(F.col("event_id").alias("invite_id"), F.col("user_id").alias("creator_id"), status.alias("status"), (F.col("ts") + F.expr("interval 2 days")).alias("expires_at"), F.lit(None).cast("long").alias("participant_id"), F.lit(None).cast("timestamp").alias("accepted_at"))
    answers = e.where("event_id % 5 <> 0").select((F.col("event_id") - F.col("event_id") % 5).alias("invite_id"), "user_id", F.col("ts").alias("answered_at"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return accepted(rows, answers)[0].select("invite_id", invitation_status(now).alias("status"), "participant_id")


@query("upsert_replace", "select user_id, last_type, n from (select user_id, event_type as last_type, event_id as n, row_number() over (partition by user_id order by (event_id % 2) desc, event_id desc) as k from events) where k = 1", prefix=False)
def upsert_replace(c: Catalog) -> DataFrame:
    """A row for each user: from the even events, replaced by one from the odd events where there is one."""
    rows = c.raw("events").select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("n"))
    none = rows.limit(0)
    old = replace_rows(none, rows.where("n % 2 = 0"), ["user_id"], "n")
    return replace_rows(old, rows.where("n % 2 = 1"), ["user_id"], "n")


@query(
    "ingest_counts",
    "with " + SIGNALS_SQL + ", d as (select distinct user_id, track_id, case when source in ('liked', 'recent') then source else 'top' end as source from signals) select user_id, count(*) filter (source = 'top') as top_count, count(*) filter (source = 'recent') as recent_count, count(*) filter (source = 'liked') as liked_count, count(*) as total_raw, count(distinct track_id) as unique_tracks from d group by 1",
)
def ingest_counts(c: Catalog) -> DataFrame:
    rows = signals(c)
    return ingested({"top": rows.where("source not in ('liked', 'recent')"), "recent": rows.where("source = 'recent'"), "liked": rows.where("source = 'liked'")})[1]


_SH = "with " + SIGNALS_SQL + _TG + """, g as (select user_id, list(genre_name) as gs from p where k <= 6 group by 1), la as (select user_id, list(distinct artist_name) as ars from signals join tracks using (track_id) join artists using (artist_id) where source = 'liked' group by 1),
    y as (select user_id, gs, coalesce(ars, []) as ars from g left join la using (user_id))"""


@query(
    "blend_sets",
    _SH + " select x.user_id as a, z.user_id as b, array_to_string(list_sort(list_intersect(x.gs, z.gs)), ', ') as common_genres, array_to_string(list_sort(list_filter(x.gs, lambda q: not list_contains(z.gs, q))), ', ') as only_a, array_to_string(list_sort(list_filter(z.gs, lambda q: not list_contains(x.gs, q))), ', ') as only_b, array_to_string(list_sort(list_intersect(x.ars, z.ars)), ', ') as shared_artists from y x join y z on x.user_id + 1 = z.user_id",
)
def blend_sets(c: Catalog) -> DataFrame:
    """Genres and liked artists that neighbouring users share."""
    from .profiles import _pairs

    genres = profile_genres(c)
    vectors = genres.select("user_id").distinct().withColumn("vector", F.array(F.lit(0.0)))
    artists = likes(c).join(c.relation("tracks artists").select("track_id", "artist_name"), "track_id").select("user_id", F.col("artist_name").alias("artist"))
    out = shared(_pairs(c), vectors, genres, artists)
    return out.select("a", "b", *[F.array_join(k, ", ").alias(k) for k in ("common_genres", "only_a", "only_b", "shared_artists")])


_TASTE_HALF = "select {k} as user_id, " + ", ".join(f"avg({f}) as {f}" for f in VECTOR) + " from signals join audio_features using (track_id) group by 1"


@query("blend_vector", "with " + SIGNALS_SQL + ", m as (" + _TASTE_HALF.format(k="user_id") + ") select x.user_id as a, y.user_id as b, " + ", ".join(f"round((x.{f} + y.{f}) / 2 * 1.000000000001, 5) as {f}" for f in VECTOR) + " from m x join m y on x.user_id + 1 = y.user_id")
def blend_vector(c: Catalog) -> DataFrame:
    """The vector by which two users together are recommended to."""
    from .profiles import _pairs

    means = signals(c).join(c.audio_features(), "track_id").groupBy("user_id").agg(F.array(*[F.avg(f) for f in VECTOR]).alias("vector"))
    none = c.spark.createDataFrame([], "user_id long, genre_name string, pct double, artist string")
    out = shared(_pairs(c), means, none.select("user_id", "genre_name", "pct"), none.select("user_id", "artist"))
    return out.select("a", "b", *[rounded(F.element_at("vector", i + 1), 5).alias(f) for i, f in enumerate(VECTOR)])
