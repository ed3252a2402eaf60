"""The whole profile of a listener: means, shares, favourites, archetype; its summary in lines, and the recap with highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import ARCHETYPES, archetype_sql
from ..schema import VECTOR
from ..sources.catalog import Catalog
from ..sources.files import as_documents, from_documents
from .labels import TAGLINES, tagline
from .registry import query
from .reports import MOOD, mood
from .signals import SIGNALS_SQL, signals
from .windows import TIE, rounded

#: The descriptions of the archetypes, in their order.
DESCRIPTIONS = (
    "Your listening patterns prioritize deep focus, hypnotic soundscapes, and instrumental arrangements over vocal hooks.",
    "You lean heavily toward stripped-down productions, natural acoustic textures, and reflective melodies.",
    "Your taste is optimized for high-bpm peak moments, heavy bass, and unstoppable dance grooves.",
    "You gravitate toward cheerful, uplifting musical keys that bring joy, bounce, and optimism.",
    "Your profile favors aggressive energy and brooding atmospheres that deliver dramatic emotional impact.",
    "You value rapid-fire vocal deliveries, sophisticated phrasing, and rhythmic storytelling.",
    "Your playlist creates a soothing, comforting sanctuary with mid-to-low tempo gems.",
    "You refuse to be boxed into one lane, finding harmony across diverse energies, moods, and styles.",
)
#: Features that lie between 0 and 1, in the order of the audio profile; those of highlights with their names.
BOUNDED = ("energy", "danceability", "valence", "acousticness", "instrumentalness", "speechiness", "liveness")
NAMED = {"energy": "energy", "danceability": "danceability", "valence": "positivity", "acousticness": "acousticness", "instrumentalness": "instrumentalness", "speechiness": "speechiness"}
#: The sentences of highlights, and the ends of those about energy and valence.
LINES = {
    "strongest_feature": "Your strongest audio characteristic is {} at {}%.",
    "weakest_feature": "Your music tends to be low in {} ({}%).",
    "dominant_genre": "{} makes up {}% of your matched catalog listening.",
    "genre_concentration": "Your top 2 genres — {} and {} — account for {}% of your taste.",
    "tempo": "You gravitate toward {} music — your average tempo is {} BPM.",
    "coverage_strong": "{}% of your analyzed tracks matched the catalog — strong coverage.",
    "coverage_weak": "{}% of your analyzed tracks matched the catalog. Your taste includes many newer or less mainstream tracks.",
    "energy_valence_combo": "Your tracks are {}",
}
PACES = ("high-tempo (fast-paced)", "mid-tempo", "slow-tempo (relaxed)")
COMBOS = (
    ("energy >= 0.7 and valence >= 0.6", "high-energy and positive — the hallmark of uplifting, danceable music."),
    ("energy >= 0.7 and valence < 0.4", "high-energy but darker in mood — intense and powerful."),
    ("energy < 0.5 and valence >= 0.6", "calm but uplifting — soothing and feel-good."),
    ("energy < 0.5 and valence < 0.4", "low-energy and melancholic — reflective and introspective."),
)


def description(archetype: Column) -> Column:
    out = F.lit(DESCRIPTIONS[-1])
    for (name, _), text in zip(ARCHETYPES[:-1], DESCRIPTIONS[:-1], strict=True):
        out = F.when(archetype == name, text).otherwise(out)
    return out


def filled(pattern: str, *values: Column) -> Column:
    parts = pattern.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def shares(rows: DataFrame, value: str, name: str, most: int | None = None) -> DataFrame:
    """(user_id, name: array of (value, n, pct)): how often each value occurs, the most frequent first, then by value. A user's
    counts are ranked, not its rows."""
    by = W.partitionBy("user_id")
    n = rows.where(F.col(value).isNotNull()).groupBy("user_id", F.col(value).alias("value")).agg(F.count("*").alias("n"))
    n = n.withColumns({"pct": rounded(F.col("n") * 100.0 / F.sum("n").over(by), 1), "k": F.row_number().over(by.orderBy(F.desc("n"), "value"))})
    if most:
        n = n.where(F.col("k") <= most)
    return n.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value", "n", "pct"))), lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"), s["pct"].alias("pct"))).alias(name))


def profile(plays: DataFrame, tracks: DataFrame, features: DataFrame, appearances: DataFrame) -> DataFrame:
    """One row for each user of plays (user_id, track_id, each once) with a known track.

    tracks: track_id, artist_name, track_popularity; features: track_id and VECTOR; appearances: track_id, genre_name,
    subgenre_name, a row for each playlist. Returns user_id, tracks, the features' means to four digits, <feature>_pct of
    the bounded ones, avg_tempo, avg_loudness, avg_popularity, genres, subgenres (5), artists (5), moods (arrays of value, n,
    pct), archetype, tagline, description. Tracks without features count as tracks, and for genres and artists.
    """
    mine = plays.join(tracks, "track_id")
    known = mine.groupBy("user_id").agg(F.count("*").alias("tracks"), rounded(F.avg("track_popularity"), 1).alias("avg_popularity"))
    heard = mine.select("user_id", "track_id").join(features, "track_id")
    means = heard.groupBy("user_id").agg(*[rounded(F.avg(f), 4).alias(f) for f in VECTOR], *[rounded(F.avg(f) * 100.0, 1).alias(f"{f}_pct") for f in BOUNDED], rounded(F.avg("tempo"), 1).alias("avg_tempo"), rounded(F.avg("loudness"), 2).alias("avg_loudness"))
    placed = mine.select("user_id", "track_id").join(appearances, "track_id")
    rows = known.join(means, "user_id", "left")
    for part in (shares(placed, "genre_name", "genres"), shares(placed, "subgenre_name", "subgenres", 5), shares(mine, "artist_name", "artists", 5), shares(heard.withColumn("mood", F.expr(mood(0.5, MOOD))), "mood", "moods")):
        rows = rows.join(part, "user_id", "left")
    rows = rows.withColumn("archetype", F.expr(archetype_sql()))
    return rows.withColumns({"tagline": tagline(F.col("archetype")), "description": description(F.col("archetype"))})


def _said(name: str, most: int | None = None) -> Column:
    """An array of shares as text; empty where there is none."""
    part = F.col(name) if most is None else F.slice(name, 1, most)
    return F.coalesce(F.array_join(F.transform(part, lambda s: F.concat(s["value"], F.lit(" ("), s["pct"].cast("string"), F.lit("%)"))), ", "), F.lit(""))


def summary_text() -> Column:
    """Lines about a row of profile()."""
    text = lambda c, none="0.0": F.coalesce(F.col(c).cast("string"), F.lit(none))
    genres = _said("genres", 3)
    return F.concat_ws(
        "\n",
        filled("Archetype: {}", F.col("archetype")),
        filled("Tagline: {}", F.col("tagline")),
        filled("Analyzed: {} seed tracks", F.col("tracks").cast("string")),
        filled("Energy: {}% | Danceability: {}% | Valence: {}%", text("energy_pct"), text("danceability_pct"), text("valence_pct")),
        filled("Acousticness: {}% | Instrumentalness: {}%", text("acousticness_pct"), text("instrumentalness_pct")),
        filled("Tempo: {} BPM | Loudness: {} dB | Avg Popularity: {}", text("avg_tempo"), text("avg_loudness"), text("avg_popularity")),
        filled("Dominant Genres: {}", F.when(genres == "", "N/A").otherwise(genres)),
    )


def highlights(most: int = 6) -> Column:
    """Array of (kind, text) about a row of profile() with coverage_pct: the first that are true. Of equal features the first in
    NAMED's order counts."""
    fixed = lambda c: F.format_string("%.1f", c)
    parts = F.filter(F.array(*[F.struct(F.col(f"{f}_pct").alias("pct"), F.lit(k).alias("place"), F.lit(n).alias("name")) for k, (f, n) in enumerate(NAMED.items())]), lambda s: s["pct"].isNotNull())
    top = F.element_at(F.array_sort(F.transform(parts, lambda s: F.struct((-s["pct"]).alias("o"), s["place"].alias("place"), s["name"].alias("name"), s["pct"].alias("pct")))), 1)
    low = F.element_at(F.array_sort(parts), 1)
    some = F.size(parts) > 0
    first, second = F.get("genres", F.lit(0)), F.get("genres", F.lit(1))
    pace = F.when(F.col("avg_tempo") >= 130, PACES[0]).when(F.col("avg_tempo") >= 90, PACES[1]).otherwise(PACES[2])
    combo = F.lit(None).cast("string")
    for condition, text in reversed(COMBOS):
        combo = F.when(F.expr(condition), text).otherwise(combo)
    strong = F.col("coverage_pct") >= 70
    line = lambda ok, kind, text: F.when(ok, F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    lines = F.array(
        line(some, "strongest_feature", filled(LINES["strongest_feature"], top["name"], fixed(top["pct"]))),
        line(some & (top["name"] != low["name"]), "weakest_feature", filled(LINES["weakest_feature"], low["name"], fixed(low["pct"]))),
        line(first.isNotNull(), "dominant_genre", filled(LINES["dominant_genre"], F.concat(F.upper(F.substring(first["value"], 1, 1)), F.expr("substring(genres[0].value, 2)")), fixed(first["pct"]))),
        line(second.isNotNull(), "genre_concentration", filled(LINES["genre_concentration"], first["value"], second["value"], fixed(rounded(first["pct"] + second["pct"], 1)))),
        line(F.col("avg_tempo") != 0, "tempo", filled(LINES["tempo"], pace, F.floor(F.col("avg_tempo") + 0.5).cast("string"))),
        line(F.col("coverage_pct") > 0, "coverage", F.when(strong, filled(LINES["coverage_strong"], fixed(F.col("coverage_pct")))).otherwise(filled(LINES["coverage_weak"], fixed(F.col("coverage_pct"))))),
        line(combo.isNotNull(), "energy_valence_combo", filled(LINES["energy_valence_combo"], combo)),
    )
    return F.slice(F.filter(lines, lambda x: x.isNotNull()), 1, most)


def recap(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows of profile() with counts (user_id, tracks_analyzed, tracks_matched, coverage_pct): overview, personality, the six largest
    genres, ten artists at most, moods and highlights, one row a user."""
    rows = rows.join(counts, "user_id")
    overview = F.struct("tracks_analyzed", "tracks_matched", "coverage_pct")
    personality = F.struct("archetype", "tagline", "description")
    return rows.select("user_id", overview.alias("overview"), personality.alias("personality"), F.slice("genres", 1, 6).alias("genres"), F.slice("artists", 1, 10).alias("artists"), "moods", highlights().alias("highlights"))


def selected(songs: DataFrame) -> DataFrame:
    """The profile of chosen songs (user_id, VECTOR, genre, track_popularity), as a page computes it: missing features count as 0
    in means and as 0.5 in moods, a missing genre is pop, per cents come from the means to four digits. Returns user_id,
    songs, means, <feature>_pct, avg_tempo, avg_loudness, avg_popularity, genres (value, n, pct), moods (value, n, pct),
    archetype, tagline, description."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = songs.groupBy("user_id").agg(F.count("*").alias("songs"), *[rounded(F.avg(zero(f)), 4).alias(f) for f in VECTOR], rounded(F.avg(zero("track_popularity")), 1).alias("avg_popularity"))
    rows = rows.withColumns({f"{f}_pct": rounded(F.col(f) * 100.0, 1) for f in BOUNDED} | {"avg_tempo": rounded(F.col("tempo"), 1), "avg_loudness": rounded(F.col("loudness"), 2), "archetype": F.expr(archetype_sql())})
    named = songs.select("user_id", F.coalesce("genre", F.lit("pop")).alias("genre"), F.expr(mood(0.5, MOOD).replace("energy", "coalesce(energy, 0.5)").replace("valence", "coalesce(valence, 0.5)")).alias("mood"))
    for value, name in (("genre", "genres"), ("mood", "moods")):
        rows = rows.join(shares(named, value, name), "user_id")
    return rows.withColumns({"tagline": tagline(F.col("archetype")), "description": description(F.col("archetype"))})


# Queries over all listeners of the signals.


def _profiles(c: Catalog) -> DataFrame:
    plays = signals(c).select("user_id", "track_id").distinct()
    tracks = c.relation("tracks artists").select("track_id", "artist_name", "track_popularity")
    return profile(plays, tracks, c.audio_features(), c.relation("playlist_tracks genres").select("track_id", "genre_name", "subgenre_name"))


def _counts(c: Catalog) -> DataFrame:
    rows = signals(c).select("user_id", "track_id").distinct().join(c.tracks().select("track_id", F.lit(1).alias("known")), "track_id", "left")
    n = rows.groupBy("user_id").agg(F.count("*").alias("tracks_analyzed"), F.count("known").alias("tracks_matched"))
    return n.withColumn("coverage_pct", rounded(F.col("tracks_matched") * 100.0 / F.col("tracks_analyzed"), 1))


def _sql_shares(name: str, rows: str, value: str) -> str:
    return f"{name}_n as (select user_id, {value} as value, count(*) as n from {rows} where {value} is not null group by 1, 2), {name}_k as (select *, round((n * 100.0 / sum(n) over (partition by user_id))::double * {TIE}, 1) as pct, row_number() over (partition by user_id order by n desc, value) as k from {name}_n)"


def _sql_said(name: str, most: int) -> str:
    return f"(select string_agg(value || ' (' || pct || '%)', ', ' order by k) from {name}_k x where x.user_id = p.user_id and k <= {most})"


_P = (
    f"with {SIGNALS_SQL}, plays as (select distinct user_id, track_id from signals), mine as (select * from plays join tracks using (track_id) join artists using (artist_id)), heard as (select mine.user_id, audio_features.* from mine join audio_features using (track_id)), "
    "placed as (select mine.user_id, genre_name, subgenre_name from mine join playlist_tracks using (track_id) join genres using (genre_id)), moods as (select user_id, " + mood(0.5, MOOD) + " as mood from heard), "
    + ", ".join(_sql_shares(*x) for x in (("genre", "placed", "genre_name"), ("sub", "placed", "subgenre_name"), ("artist", "mine", "artist_name"), ("mood", "moods", "mood")))
    + f", m as (select user_id, {', '.join(f'round(avg({f}) * {TIE}, 4) as {f}' for f in VECTOR)}, {', '.join(f'round(avg({f}) * 100.0 * {TIE}, 1) as {f}_pct' for f in BOUNDED)}, round(avg(tempo) * {TIE}, 1) as avg_tempo, round(avg(loudness) * {TIE}, 2) as avg_loudness from heard group by 1),"
    f" p as (select *, {archetype_sql()} as archetype from (select user_id, count(*) as tracks, round(avg(track_popularity) * {TIE}, 1) as avg_popularity from mine group by 1) left join m using (user_id))"
)
_SQL_TAG, _SQL_TEXT = ("case archetype " + " ".join("when '{}' then '{}'".format(a[0], t) for a, t in zip(ARCHETYPES, texts, strict=True)) + " end" for texts in (TAGLINES, DESCRIPTIONS))
_FLAT = ("genres", "subgenres", "artists", "moods")


@query(
    "profile_report",
    _P + f" select p.*, {_SQL_TAG} as tagline, {_SQL_TEXT} as description, " + ", ".join(f"coalesce({_sql_said(n, k)}, '') as {f}" for f, n, k in zip(_FLAT, ("genre", "sub", "artist", "mood"), (1000, 5, 5, 4), strict=True)) + " from p",
)
def profile_report(c: Catalog) -> DataFrame:
    """Every column of each listener's profile, lists as text."""
    rows = _profiles(c)
    return rows.select(*[x for x in rows.columns if x not in _FLAT], *[_said(x).alias(x) for x in _FLAT])


def _sql_filled(pattern: str, *values: str) -> str:
    parts = pattern.split("{}")
    return " || ".join([f"'{parts[0]}'", *[f"{v} || '{p}'" for v, p in zip(values, parts[1:], strict=True)]])


_LINES = [
    _sql_filled("Archetype: {}", "archetype"),
    _sql_filled("Tagline: {}", _SQL_TAG),
    _sql_filled("Analyzed: {} seed tracks", "tracks"),
    _sql_filled("Energy: {}% | Danceability: {}% | Valence: {}%", *[f"coalesce({f}_pct, 0.0)" for f in ("energy", "danceability", "valence")]),
    _sql_filled("Acousticness: {}% | Instrumentalness: {}%", *[f"coalesce({f}_pct, 0.0)" for f in ("acousticness", "instrumentalness")]),
    _sql_filled("Tempo: {} BPM | Loudness: {} dB | Avg Popularity: {}", *[f"coalesce({f}, 0.0)" for f in ("avg_tempo", "avg_loudness", "avg_popularity")]),
    _sql_filled("Dominant Genres: {}", f"coalesce({_sql_said('genre', 3)}, 'N/A')"),
]


@query("profile_lines", _P + " select user_id, " + " || chr(10) || ".join(_LINES) + " as summary from p")
def profile_lines(c: Catalog) -> DataFrame:
    """Each profile's summary, all of its lines."""
    return _profiles(c).select("user_id", summary_text().alias("summary"))


_FIXED = "printf('%.1f', {})".format
_SORTED = "list_sort([" + ", ".join(f"{{{{'o': {{sign}}{f}_pct, 'p': {k}, 'n': '{n}', 'v': {f}_pct}}}}" for k, (f, n) in enumerate(NAMED.items())) + "])[1]"
_GENRE = "(select {} from genre_k x where x.user_id = p.user_id and k = {})"
_SAID = [
    f"case when energy_pct is not null then {_sql_filled(LINES['strongest_feature'], 'top.n', _FIXED('top.v'))} end",
    f"case when top.n <> low.n then {_sql_filled(LINES['weakest_feature'], 'low.n', _FIXED('low.v'))} end",
    f"case when g1 is not null then {_sql_filled(LINES['dominant_genre'], 'upper(g1[1:1]) || g1[2:]', _FIXED('p1'))} end",
    f"case when g2 is not null then {_sql_filled(LINES['genre_concentration'], 'g1', 'g2', _FIXED(f'round((p1 + p2) * {TIE}, 1)'))} end",
    f"case when avg_tempo <> 0 then {_sql_filled(LINES['tempo'], f'''case when avg_tempo >= 130 then '{PACES[0]}' when avg_tempo >= 90 then '{PACES[1]}' else '{PACES[2]}' end''', 'floor(avg_tempo + 0.5)::bigint')} end",
    f"case when coverage_pct >= 70 then {_sql_filled(LINES['coverage_strong'], _FIXED('coverage_pct'))} when coverage_pct > 0 then {_sql_filled(LINES['coverage_weak'], _FIXED('coverage_pct'))} end",
    "case " + " ".join(f"when {k} then '{LINES['energy_valence_combo'].format(t)}'" for k, t in COMBOS) + " end",
]


@query(
    "profile_recap",
    _P + f""", n as (select user_id, count(*) as tracks_analyzed, count(track_popularity) as tracks_matched from plays left join tracks using (track_id) group by 1),
    h as (select p.*, tracks_analyzed, tracks_matched, round(tracks_matched * 100.0 / tracks_analyzed * {TIE}, 1) as coverage_pct, {_SORTED.format(sign="-")} as top, {_SORTED.format(sign="")} as low,
        {_GENRE.format("value", 1)} as g1, {_GENRE.format("value", 2)} as g2, {_GENRE.format("pct", 1)} as p1, {_GENRE.format("pct", 2)} as p2 from p join n using (user_id))
    select user_id, tracks_analyzed, tracks_matched, coverage_pct, archetype, coalesce({_sql_said('genre', 6)}, '') as genres, coalesce((select string_agg(value || ' (' || n || ')', ', ' order by k) from artist_k x where x.user_id = p.user_id and k <= 5), '') as artists,
        array_to_string(([x for x in [{', '.join(_SAID)}] if x is not null])[1:6], ' ') as highlights from h p""",
)
def profile_recap(c: Catalog) -> DataFrame:
    """Each listener's recap, lists as text."""
    rows = recap(_profiles(c), _counts(c))
    artists = F.coalesce(F.array_join(F.transform("artists", lambda s: F.concat(s["value"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", "), F.lit(""))
    return rows.select("user_id", "overview.*", "personality.archetype", _said("genres").alias("genres"), artists.alias("artists"), F.array_join(F.transform("highlights", lambda h: h["text"]), " ").alias("highlights"))


_CHOSEN = (
    f"with {SIGNALS_SQL}, g as (select track_id, min(genre_name) as genre from playlist_tracks join genres using (genre_id) group by 1), c as (select user_id, track_popularity, case when track_id % 5 <> 0 then genre end as genre, {', '.join(f'case when track_id % 7 <> 0 then {f} end as {f}' for f in VECTOR)} from (select distinct user_id, track_id from signals) join tracks using (track_id) left join audio_features using (track_id) left join g using (track_id)), "
    + "named as (select user_id, coalesce(genre, 'pop') as genre, " + mood(0.5, MOOD).replace("energy", "coalesce(energy, 0.5)").replace("valence", "coalesce(valence, 0.5)") + " as mood from c), "
    + ", ".join(_sql_shares(*x) for x in (("genre", "named", "genre"), ("mood", "named", "mood")))
    + f", p as (select *, {', '.join(f'round({f} * 100.0 * {TIE}, 1) as {f}_pct' for f in BOUNDED)}, round(tempo * {TIE}, 1) as avg_tempo, round(loudness * {TIE}, 2) as avg_loudness, {archetype_sql()} as archetype from (select user_id, count(*) as songs, {', '.join(f'round(avg(coalesce({f}, 0.0)::double) * {TIE}, 4) as {f}' for f in VECTOR)}, round(avg(coalesce(track_popularity, 0)) * {TIE}, 1) as avg_popularity from c group by 1))"
)


@query("profile_browser", _CHOSEN + f" select p.*, {_SQL_TAG} as tagline, {_SQL_TEXT} as description, {_sql_said('genre', 1000)} as genres, {_sql_said('mood', 4)} as moods from p")
def profile_browser(c: Catalog) -> DataFrame:
    """The profile of each listener's tracks as chosen songs, of which some lack genre or features."""
    genre = c.relation("playlist_tracks genres").groupBy("track_id").agg(F.min("genre_name").alias("genre"))
    rows = signals(c).select("user_id", "track_id").distinct().join(c.tracks().select("track_id", "track_popularity"), "track_id").join(c.audio_features(), "track_id", "left").join(genre, "track_id", "left")
    k = F.col("track_id")
    rows = rows.select("user_id", "track_popularity", F.when(k % 5 != 0, F.col("genre")).alias("genre"), *[F.when(k % 7 != 0, F.col(f)).alias(f) for f in VECTOR])
    out = selected(rows)
    return out.select(*[x for x in out.columns if x not in ("genres", "moods")], _said("genres").alias("genres"), _said("moods").alias("moods"))


@query("f_documents", _P + " select user_id, archetype, tracks, energy, coalesce((select string_agg(value, ',' order by k) from genre_k x where x.user_id = p.user_id), '') as genres from p")
def f_documents(c: Catalog) -> DataFrame:
    """Profiles written as JSON documents and read back by their schema."""
    rows = _profiles(c)
    kinds = rows.drop("user_id").schema
    back = from_documents(as_documents(rows, ["user_id"]), kinds)
    return back.select("user_id", "archetype", "tracks", "energy", F.coalesce(F.array_join(F.transform("genres", lambda s: s["value"]), ","), F.lit("")).alias("genres"))
