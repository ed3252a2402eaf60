"""Names and fixed values of the catalog."""

from __future__ import annotations

#: The features that similarity uses, in their order, and all features with key and mode.
VECTOR = ("danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo")
FEATURES = ("danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo")

#: The least and the largest value that cleaning counts as inside a column's domain.
BOUNDS = {
    "track_popularity": (0, 100),
    "danceability": (0.0, 1.0),
    "energy": (0.0, 1.0),
    "key": (-1, 11),
    "loudness": (-60.0, 5.0),
    "mode": (0, 1),
    "speechiness": (0.0, 1.0),
    "acousticness": (0.0, 1.0),
    "instrumentalness": (0.0, 1.0),
    "liveness": (0.0, 1.0),
    "valence": (0.0, 1.0),
    "tempo": (0.0, 300.0),
    "duration_ms": (1000, 3600000),
}
