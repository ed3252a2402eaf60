"""The catalog's reports: overviews, genres, artists, decades, popularity, moods, exports and build tables."""

from __future__ import annotations

from ..plans.report import Measure, Report, bound, common, computed, count, deviation, largest, least, mean, names, quantile, rounded, unique, where
from ..schema import VECTOR

GENRE, ARTIST, DECADE = {"genre_name": "genre_name"}, {"artist_name": "artist_name"}, {"release_decade": "release_decade"}
_APPEAR, _HEARD = "playlist_tracks genres tracks", "playlist_tracks genres tracks audio_features"
_POP = "track_popularity"
#: Digits to which a feature's mean is given.
_DIGITS = {"loudness": 2, "tempo": 1}


def _means(*features: str, prefix: str = "avg_", suffix: str = "") -> dict[str, Measure]:
    return {f"{prefix}{f}{suffix}": mean(f, _DIGITS.get(f, 3)) for f in features}


def _interval(digits: int, n: str = "count(*)") -> dict[str, Measure]:
    return {"ci_lower_95": bound(_POP, -1, digits, n), "ci_upper_95": bound(_POP, 1, digits, n)}


def _share(column: str, digits: int) -> str:
    return f"round({column} * 100.0 / sum({column}) over (), {digits})"


def mood(limit: float, labels: tuple[str, str, str, str]) -> str:
    """Quadrants of valence and energy: both high, valence alone, energy alone, neither."""
    return f"case when valence >= {limit} and energy >= {limit} then '{labels[0]}' when valence >= {limit} then '{labels[1]}' when energy >= {limit} then '{labels[2]}' else '{labels[3]}' end"


#: Labels of the two mood definitions, of popularity buckets, and their limits.
MOOD_WIDE = ("Upbeat/Happy", "Relaxed/Content", "Aggressive/Intense", "Melancholic/Sad")
MOOD = ("Upbeat / Euphoric", "Chill / Peaceful", "Intense / Aggressive", "Melancholic / Sad")
BUCKET_LABELS = ("Zero", "Very Low", "Low", "Medium", "High", "Very High")
BUCKET_RANGES = ((0, 0), (1, 19), (20, 39), (40, 59), (60, 79), (80, 100))


def buckets(style: str, open_ended: bool) -> str:
    """Popularity buckets; open_ended: whatever is in none of them, null included, counts as the highest."""
    label = {"(": "{} ({})", "_": "{}_{}"}[style]
    first = ["00", *(f"{a:02d}-{b}" for a, b in BUCKET_RANGES[1:])]
    cases = [f"when {_POP} between {a} and {b} then '{label.format(r, n)}'" for (a, b), r, n in zip(BUCKET_RANGES, first, BUCKET_LABELS, strict=True)]
    if open_ended:
        cases[-1] = f"else '{label.format(first[-1], BUCKET_LABELS[-1])}'"
    return "case " + " ".join(cases) + " end"


def _decile(feature: str) -> Report:
    return Report(
        "tracks audio_features",
        {f"{feature}_decile": f"round({feature} * 10, 0) * 10"},
        {"track_count": count(), "avg_popularity": mean(_POP, 2), "std_popularity": deviation(_POP, 2)},
        order=(f"{feature}_decile",),
    )


def _spread_by_genre(feature: str, quartiles: bool = False) -> Report:
    more = {f"p{int(p * 100)}_{feature}": quantile(feature, p, 3) for p in (0.25, 0.75)} if quartiles else {"track_count": unique("track_id")}
    return Report(_HEARD, GENRE, {f"avg_{feature}": mean(feature, 3), f"median_{feature}": quantile(feature, 0.5), f"std_{feature}": deviation(feature, 3)} | more, order=(f"-avg_{feature}", "genre_name"))


_TOP_TRACK = {c: c for c in ("track_id", "track_name", "artist_name", "album_name", "release_year", _POP, "duration_min", "danceability", "energy", "valence", "tempo")}
_TOP = Report("tracks artists albums? audio_features playlist_tracks genres", _TOP_TRACK, {"genres": names("genre_name")}, order=(f"-{_POP}", "track_id"))
_VECTOR = {c: c for c in ("track_id", "track_name", "artist_name", _POP, *VECTOR)}
_ALBUM_HIT = where(f"{_POP} >= 70")

REPORTS: dict[str, Report] = {
    "q01_total_tracks": Report("tracks", measures={"total_tracks": count()}),
    "q02_total_artists": Report("artists", measures={"total_artists": count()}),
    "q03_genre_counts": Report("genres", measures={"total_macro_genres": unique("genre_name"), "total_subgenres": unique("subgenre_name"), "total_genre_subgenre_combos": count()}),
    "q04_tracks_by_genre": Report(
        "playlist_tracks genres", GENRE, {"unique_tracks": unique("track_id"), "playlist_appearances": count()}, then={"pct_of_catalog": _share("unique_tracks", 2)}, order=("-unique_tracks", "genre_name")
    ),
    "q05_popularity_by_genre": Report(
        _APPEAR,
        GENRE,
        {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 2), "median_popularity": quantile(_POP, 0.5), "std_popularity": deviation(_POP, 2)} | _interval(2),
        order=("-avg_popularity", "genre_name"),
    ),
    "q06_top_artists": Report(
        "tracks artists",
        ARTIST,
        {"track_count": count(), "avg_popularity": mean(_POP, 1), "peak_popularity": largest(_POP), "popularity_consistency": deviation(_POP, 1)},
        having="track_count >= 5",
        order=("-avg_popularity", "artist_name"),
        limit=20,
    ),
    "q07_prolific_artists": Report(
        "tracks artists audio_features", ARTIST, {"track_count": count(), "avg_popularity": mean(_POP, 1)} | _means("danceability", "energy"), order=("-track_count", "artist_name"), limit=20
    ),
    "q08_energy_by_genre": _spread_by_genre("energy", True),
    "q09_danceability_by_genre": _spread_by_genre("danceability"),
    "q10_valence_by_genre": _spread_by_genre("valence"),
    "q11_genre_matrix": Report(_HEARD, GENRE, {"tracks": unique("track_id")} | _means(*VECTOR) | {"avg_popularity": mean(_POP, 2)}, order=("genre_name",)),
    "q12_popularity_buckets": Report(
        "tracks", {"bucket": buckets("(", True)}, {"track_count": count(), "avg_score_in_bucket": mean(_POP, 1)}, then={"pct_of_total": _share("track_count", 2)}, order=("bucket",)
    ),
    "q13_popularity_by_energy": _decile("energy"),
    "q14_popularity_by_danceability": _decile("danceability"),
    "q15_top_tracks": Report(_TOP.over, _TOP.by, _TOP.measures, order=_TOP.order, limit=25, keep=(*[c for c in _TOP_TRACK if c != "track_id"], "genres")),
    "q16_artist_summary": Report(
        "tracks artists audio_features albums?",
        ARTIST,
        {"track_count": count("track_id"), "avg_popularity": mean(_POP, 1), "max_popularity": largest(_POP), "min_popularity": least(_POP), "std_popularity": deviation(_POP, 1)}
        | _means("danceability", "energy", "valence")
        | {"avg_tempo_bpm": mean("tempo", 1), "album_count": unique("album_id"), "earliest_release_year": least("release_year"), "latest_release_year": largest("release_year")},
        order=("-avg_popularity", "artist_name"),
    ),
    "q17c_cumulative_tracks": Report(
        "tracks albums",
        {"release_year": "release_year"},
        {"tracks_released": unique("track_id"), "avg_popularity": mean(_POP, 2)},
        filter="release_year is not null",
        then={"cumulative_tracks": "cast(sum(tracks_released) over (order by release_year) as bigint)"},
        order=("release_year",),
    ),
    "q18b_cross_genre_artists": Report(
        "tracks artists playlist_tracks genres",
        ARTIST,
        {"genre_count": unique("genre_name"), "genres_list": names("genre_name"), "total_tracks": unique("track_id"), "avg_popularity": mean(_POP, 1)},
        having="genre_count >= 3",
        order=("-genre_count", "-avg_popularity", "artist_name"),
        limit=30,
    ),
    "q18c_decades": Report(
        "tracks albums audio_features",
        DECADE,
        {"track_count": count(), "avg_popularity": mean(_POP, 2)} | _means("danceability", "energy", "valence"),
        filter="release_decade is not null",
        then={"pop_delta_from_prev_decade": "round(avg_popularity - lag(avg_popularity) over (order by release_decade), 2)"},
        order=("release_decade",),
    ),
    "q19_full_context": Report(
        "tracks artists albums? audio_features playlist_tracks genres",
        {c: c for c in ("track_id", "track_name", "artist_name", "album_name", "release_year", "release_decade", _POP)}
        | {"duration_min": rounded("duration_min", 2)}
        | {c: c for c in ("duration_category", "genre_name", "subgenre_name", "danceability", "energy", "key", "loudness")}
        | {"musical_key_mode": "case when mode = 1 then 'Major' else 'Minor' end"}
        | {c: c for c in ("speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo")}
        | {"mood_quadrant": mood(0.6, MOOD_WIDE)},
    ),
    "q19b_hit_albums": Report(
        "tracks artists albums",
        {c: c for c in ("album_id", "album_name", "artist_name", "release_year")},
        {"total_tracks_in_catalog": count("track_id"), "high_popularity_tracks": _ALBUM_HIT, "album_avg_popularity": mean(_POP, 1), "peak_track_popularity": largest(_POP)},
        having="high_popularity_tracks >= 2",
        order=("-high_popularity_tracks", "-album_avg_popularity", "album_id"),
        keep=("album_name", "artist_name", "release_year", "total_tracks_in_catalog", "high_popularity_tracks", "album_avg_popularity", "peak_track_popularity"),
    ),
    "q20a_features_by_decade": Report(
        "tracks albums audio_features",
        DECADE,
        {"track_count": unique("track_id"), "avg_tempo_bpm": mean("tempo", 1), "avg_loudness_db": mean("loudness", 2)} | _means("danceability", "energy", "acousticness", "valence") | {"avg_popularity": mean(_POP, 2)},
        filter="release_decade is not null",
        order=("release_decade",),
    ),
    "q20b_release_months": Report(
        "tracks albums",
        {"release_month": "release_month"},
        {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 2)},
        filter="release_month is not null",
        then={"month_name": "case release_month " + " ".join(f"when {k + 1} then '{m}'" for k, m in enumerate("January February March April May June July August September October November December".split())) + " end"},
        order=("-track_count", "release_month"),
    ),
    "q20c_major_minor": Report(
        "tracks audio_features",
        {"key_mode": "case when mode = 1 then 'Major' else 'Minor' end"},
        {"track_count": count(), "avg_popularity": mean(_POP, 2), "median_popularity": quantile(_POP, 0.5)} | _means("valence", "energy"),
    ),
    "q20d_moods": Report(
        "tracks audio_features playlist_tracks genres",
        {"mood_quadrant": mood(0.6, MOOD_WIDE)},
        {"track_count": count(), "avg_popularity": mean(_POP, 2), "top_genres": names("genre_name")},
        then={"pct_of_catalog": _share("track_count", 1)},
        order=("-track_count", "mood_quadrant"),
    ),
    "v1_genre_summary": Report(
        _HEARD,
        {"genre": "genre_name"},
        {"unique_tracks": unique("track_id"), "playlist_appearances": count(), "avg_popularity": mean(_POP, 2), "median_popularity": quantile(_POP, 0.5), "stddev_popularity": deviation(_POP, 2)}
        | _means("danceability", "energy", "valence", "tempo", "speechiness", "acousticness"),
        order=("-unique_tracks", "genre"),
    ),
    "v2_artist_leaderboard": Report(
        "tracks artists",
        ARTIST,
        {"track_count": count(), "avg_popularity": mean(_POP, 1), "max_popularity": largest(_POP), "min_popularity": least(_POP), "stddev_popularity": deviation(_POP, 1)},
        having="track_count >= 3",
        order=("-avg_popularity", "artist_name"),
    ),
    "v3_popularity_buckets": Report("tracks", {"popularity_bucket": buckets("_", False)}, {"track_count": count()}, then={"pct_of_total": _share("track_count", 2)}, order=("popularity_bucket",)),
    "v4_top_tracks": _TOP,
    "v5_release_decades": Report(
        "tracks albums audio_features",
        DECADE,
        {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 2)} | _means("danceability", "energy", "valence", "tempo"),
        filter="release_decade is not null",
        order=("release_decade",),
    ),
    "v6_genre_audio_profile": Report(
        _HEARD,
        GENRE | {"subgenre_name": "subgenre_name"},
        {"track_count": unique("track_id")} | _means(*VECTOR) | {"avg_popularity": mean(_POP, 2)},
        order=("genre_name", "-track_count", "subgenre_name"),
    ),
    "mv_track_vectors": Report("tracks artists audio_features playlist_tracks? genres?", _VECTOR, {"genre_name": names("genre_name")}),
    "e1_overview": Report(
        "tracks artists audio_features playlist_tracks? genres? albums?",
        measures={"total_tracks": unique("track_id"), "total_artists": unique("artist_id"), "total_genres": unique("genre_name"), "total_subgenres": unique("subgenre_name"), "avg_popularity": mean(_POP, 1)}
        | _means("danceability", "energy", "valence", "tempo")
        | {"earliest_year": least("release_year"), "latest_year": largest("release_year")},
    ),
    "e2_genres": Report(
        _APPEAR,
        GENRE,
        {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 1)} | _interval(2, "nullif(count(*), 0)"),
        then={"pct_of_total": _share("track_count", 1)},
        order=("-track_count", "genre_name"),
    ),
    "e3_decades": Report(
        "tracks albums audio_features", DECADE, {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 1)} | _means("danceability", "energy", "valence"), filter="release_decade is not null", order=("release_decade",)
    ),
    "e4_genre_profiles": Report(
        _HEARD,
        GENRE,
        {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 1)}
        | {f"{f}_pct": mean(f"{f} * 100", 1) for f in ("danceability", "energy", "valence", "acousticness", "speechiness", "instrumentalness", "liveness")}
        | {"avg_tempo": mean("tempo", 1), "avg_loudness": mean("loudness", 1)},
        order=("genre_name",),
    ),
    "e6_mood_share": Report("tracks audio_features", {"mood": mood(0.5, MOOD)}, {"track_count": count()}, then={"pct": _share("track_count", 1)}, order=("-track_count", "mood")),
    "e7_artist_leaderboard": Report(
        "tracks artists audio_features",
        ARTIST,
        {"track_count": count(), "avg_popularity": mean(_POP, 1), "max_popularity": largest(_POP)} | _means("danceability", "energy", "valence"),
        having="track_count >= 3",
        order=("-avg_popularity", "-track_count", "artist_name"),
        limit=50,
    ),
    "e9_popular_tracks": Report(
        "tracks artists audio_features playlist_tracks? genres?", _VECTOR, {"genre_name": names("genre_name")}, filter=f"{_POP} >= 60", order=(f"-{_POP}", "track_id"), limit=20
    ),
    "e10_candidates": Report(
        "tracks artists audio_features playlist_tracks? genres?", _VECTOR, {"genre_name": names("genre_name")}, filter=f"{_POP} >= 30", having="genre_name like '%ASIA%'"
    ),
    "x_artist_stats": Report(
        "tracks audio_features playlist_tracks genres",
        {"artist_id": "artist_id"},
        {"track_count": count(), "avg_popularity": mean(_POP, 4), "max_popularity": largest(_POP), "min_popularity": least(_POP)}
        | {f"avg_{f}": mean(f, 4) for f in ("danceability", "energy", "valence")}
        | {"genre_primary": common("genre_name")},
    ),
    "x_genre_stats": Report(
        _HEARD, GENRE, {"track_count": count(), "unique_track_count": unique("track_id"), "avg_popularity": mean(_POP, 4)} | {f"avg_{f}": mean(f, 4) for f in VECTOR}
    ),
    "bi_measures": Report(
        "tracks artists audio_features playlist_tracks genres",
        GENRE,
        {
            "tracks": unique("track_id"),
            "artists": unique("artist_id"),
            "avg_popularity": mean(_POP, 4),
            "median_popularity": quantile(_POP, 0.5),
            "std_popularity": deviation(_POP, 4),
            "ci_95": computed(f"round(1.96 * stddev_samp({_POP}) / sqrt(count(distinct track_id)), 4)"),
            "hits": computed(f"count(distinct case when {_POP} >= 70 then track_id end)"),
            "avg_danceability_pct": mean("danceability * 100", 3),
            "avg_energy_pct": mean("energy * 100", 3),
            "avg_valence_pct": mean("valence * 100", 3),
            "dance_energy_index": computed("round(sqrt(avg(danceability) * 100 * avg(energy) * 100), 3)"),
            "_v": computed("avg(valence)"),
            "_e": computed("avg(energy)"),
        },
        then={"mood": mood(0.5, MOOD).replace("valence", "_v").replace("energy", "_e"), "share_of_catalog": "round(tracks * 100.0 / sum(tracks) over (), 2)"},
        keep=("genre_name", "tracks", "artists", "avg_popularity", "median_popularity", "std_popularity", "ci_95", "hits", "avg_danceability_pct", "avg_energy_pct", "avg_valence_pct", "dance_energy_index", "mood", "share_of_catalog"),
    ),
    "exp_genre": Report(
        _HEARD,
        GENRE,
        {"appearances": count(), "track_count": unique("track_id"), "avg_popularity": mean(_POP, 2), "median_popularity": quantile(_POP, 0.5), "std_popularity": deviation(_POP, 2)}
        | _interval(2)
        | _means(*VECTOR),
    ),
    "exp_subgenre": Report(_HEARD, GENRE | {"subgenre_name": "subgenre_name"}, {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 2)} | _means("danceability", "energy", "valence", "tempo")),
    "exp_artist": Report(
        "tracks artists audio_features",
        ARTIST,
        {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 2), "max_popularity": largest(_POP)} | _means("danceability", "energy", "valence"),
        having="track_count >= 3",
    ),
    "exp_buckets": Report("tracks", {"popularity_bucket": buckets("_", False)}, {"track_count": count(), "avg_popularity": mean(_POP, 2)}, then={"pct": _share("track_count", 2)}),
    "exp_decade": Report("tracks albums audio_features", DECADE, {"track_count": unique("track_id"), "avg_popularity": mean(_POP, 2)} | _means(*VECTOR)),
    "exp_search_index": Report(
        "tracks artists audio_features playlist_tracks? genres?",
        {c: c for c in ("track_id", "track_name", "artist_name", _POP)} | {f: rounded(f, 4) for f in VECTOR},
        {"genre": common("genre_name")},
        order=(f"-{_POP}", "track_name", "track_id"),
        limit=2500,
    ),
    "kpi_catalog": Report(
        "tracks audio_features albums?",
        measures={"total_tracks": count(), "total_artists": unique("artist_id"), "total_albums": unique("album_id"), "avg_popularity": mean(_POP, 2), "median_popularity": quantile(_POP, 0.5), "avg_duration_min": mean("duration_min", 2), "zero_popularity": where(f"{_POP} = 0"), "hits": _ALBUM_HIT}
        | {f"avg_{f}": mean(f, 3) for f in ("danceability", "energy", "valence", "acousticness", "tempo")}
        | {"first_year": least("release_year"), "last_year": largest("release_year")},
    ),
    "eda_artist_threshold": Report("tracks artists", ARTIST, {"track_count": count(), "avg_popularity": mean(_POP, 2), "std_popularity": computed(f"coalesce(round(stddev_samp({_POP}), 2), 0)")}, having="track_count >= 10"),
    "f_duration_bin": Report("tracks", {"duration_category": "duration_category"}, {"track_count": count(), "avg_popularity": mean(_POP, 2), "avg_minutes": mean("duration_min", 3)}),
    "f_mood": Report(
        "tracks audio_features",
        {"mood": mood(0.5, MOOD), "tempo_bracket": "case when tempo < 90 then 'Slow (<90 BPM)' when tempo <= 130 then 'Mid-tempo (90-130 BPM)' else 'Fast (>130 BPM)' end"},
        {"track_count": count(), "avg_dance_energy": mean("sqrt(danceability * energy)", 3), "avg_acoustic_energy_balance": mean("acousticness - energy", 3)},
    ),
}
