"""Feature columns: archetypes, vectors, cosine similarity, rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Archetypes with their conditions, in order; the last has none.
ARCHETYPES = (
    ("Atmospheric & Instrumental Dreamer", "instrumentalness >= 0.35"),
    ("Acoustic & Introspective Soul", "acousticness >= 0.50 and energy < 0.55"),
    ("High-Energy Party Enthusiast", "energy >= 0.75 and danceability >= 0.70"),
    ("Euphoric Groove Explorer", "valence >= 0.65 and danceability >= 0.60"),
    ("Nocturnal Adrenaline Seeker", "energy >= 0.72 and valence < 0.45"),
    ("Lyrical Flow & Rhythm Connoisseur", "speechiness >= 0.15 and danceability >= 0.60"),
    ("Chill Vibester & Sunday Lounger", "energy < 0.50 and valence >= 0.50"),
    ("Eclectic Sonic Connoisseur", ""),
)
#: What a missing feature counts as.
DEFAULTS = {"energy": 0.5, "danceability": 0.5, "valence": 0.5, "acousticness": 0.5, "instrumentalness": 0.0, "speechiness": 0.0}


def archetype_sql(column: str = "{}") -> str:
    """A case expression over the features; column: how a feature's name is written."""
    full = {f: f"coalesce({column.format(f)}, {v})" for f, v in DEFAULTS.items()}
    out = "case "
    for name, condition in ARCHETYPES[:-1]:
        for f, text in full.items():
            condition = condition.replace(f, text)
        out += f"when {condition} then '{name}' "
    return out + f"else '{ARCHETYPES[-1][0]}' end"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def half_up(c: Column, digits: int) -> Column:
    """Rounding with ties towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
