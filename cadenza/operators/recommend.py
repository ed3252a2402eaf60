"""Similarity recommendations: scaling, projection, candidates, ranking by several signals, diversity, explanations.

Users' vectors and their candidates are rows, so all users are computed at once. The catalog is scanned once per call; a
user's candidates are cut to a bounded pool before anything sequential runs.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import clamp, cosine, half_up
from ..plans.staged import Steps
from ..schema import VECTOR
from ..sources.catalog import Catalog
from ..sources.files import load_json, save_json
from .nearest import nearest
from .registry import query
from .windows import rounded

#: How much each signal counts, the pool of candidates, and the limits of diversity.
WEIGHTS = {"audio": 0.45, "representation": 0.25, "genre": 0.10, "artist": 0.04, "popularity": 0.06, "novelty": 0.10}
POOL = 500
LAMBDA, ARTIST_CAP, GENRE_PENALTY = 0.72, 2, 0.04


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation of each feature; a deviation of 0 counts as 1."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]

    @classmethod
    def fit(cls, rows: DataFrame, features: tuple[str, ...] = VECTOR) -> Scaler:
        r = rows.agg(*[g(f) for f in features for g in (F.avg, F.stddev_pop)]).first()
        return cls(tuple(float(x or 0) for x in r[::2]), tuple(float(x or 0) or 1.0 for x in r[1::2]))

    def inverse(self, vector: Column) -> Column:
        return F.array(*[F.element_at(vector, i + 1) * s + m for i, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))])

    def vector(self, features: tuple[str, ...] = VECTOR) -> Column:
        return F.array(*[(F.col(f) - m) / s for f, m, s in zip(features, self.mean, self.scale, strict=True)])


@dataclass(frozen=True)
class Projection:
    """Principal axes of scaled vectors, as many as explain the wanted share of variance; the largest loading is positive."""

    axes: tuple[tuple[float, ...], ...]
    ratios: tuple[float, ...]

    @classmethod
    def fit(cls, rows: DataFrame, scaler: Scaler, share: float = 0.95, features: tuple[str, ...] = VECTOR) -> Projection:
        pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
        found = rows.agg(*[F.covar_pop(a, b) for a, b in pairs]).first()  # a handful of sums in one pass
        place = {f: i for i, f in enumerate(features)}
        matrix = np.zeros((len(features),) * 2)
        for (a, b), v in zip(pairs, found, strict=True):
            i, j = place[a], place[b]
            matrix[i, j] = matrix[j, i] = (v or 0) / scaler.scale[i] / scaler.scale[j]
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1].clip(0), vectors[:, ::-1].T
        ratios = values / max(values.sum(), 1e-300)
        k = int(np.searchsorted(np.cumsum(ratios), share - 1e-12)) + 1
        signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
        return cls(tuple(map(tuple, (vectors * signs[:, None])[:k].tolist())), tuple(ratios[:k].tolist()))

    def apply(self, vector: Column) -> Column:
        at = lambda axis: sum((F.element_at(vector, i + 1) * w for i, w in enumerate(axis)), F.lit(0.0))
        return F.array(*[at(axis) for axis in self.axes])


def save_model(scaler: Scaler, axes: Projection, path: str) -> None:
    """Both as one JSON document; a handful of numbers."""
    save_json({"features": list(VECTOR), "scaler": asdict(scaler), "projection": asdict(axes)}, path)


def load_model(path: str) -> tuple[Scaler, Projection]:
    d = load_json(path)
    if d.get("features") != list(VECTOR):
        raise ValueError(f"{path}: a model of other features")
    s, p = d["scaler"], d["projection"]
    return Scaler(tuple(s["mean"]), tuple(s["scale"])), Projection(tuple(map(tuple, p["axes"])), tuple(p["ratios"]))


def user_vectors(seeds: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, vector): weighted means of the seeds' vectors; seeds outside of the catalog are skipped, users without a
    known seed have no row. seeds: user_id, track_id, weight; vectors: track_id, vector."""
    rows = seeds.join(vectors, "track_id").select("user_id", "weight", F.posexplode("vector").alias("dim", "x"))
    means = rows.groupBy("user_id", "dim").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"))
    return means.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("vector"))


def candidates(users: DataFrame, catalog: DataFrame, excluded: DataFrame, pool: int = POOL) -> DataFrame:
    """The most similar tracks of each user, without those excluded: user_id, user_vector, catalog's columns, similarity,
    position.

    users: user_id, user_vector; excluded: user_id, track_id. Every user is a query against the whole catalog, in blocks of
    which most are ruled out, see nearest(); the pools are joined to what is known of their tracks.
    """
    found = nearest(users, catalog, excluded, pool)
    return found.join(users, "user_id").join(catalog, "track_id").select("user_id", *catalog.columns, "user_vector", "similarity", "position")


def on_axes(axes: Projection) -> Column:
    """Cosine of vector and user_vector in the space of the principal axes; neither is null. As one expression of Spark it is
    too long to be compiled and takes 55 microseconds a row."""
    turn = np.array(axes.axes).T

    @F.arrow_udf("double")
    def between(vector: pa.Array, user_vector: pa.Array) -> pa.Array:
        a, b = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) @ turn for v in (vector, user_vector))
        norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return pa.array(np.where(norm > 0, (a * b).sum(1) / np.where(norm > 0, norm, 1), 0.0))

    return between("vector", "user_vector")


def without_artists(rows: DataFrame, banned: DataFrame) -> DataFrame:
    """rows (user_id, artist_name) without those of artists that a user doesn't want (user_id, artist_name), whatever the case."""
    key = F.lower(F.trim("artist_name"))
    gone = banned.select(F.col("user_id").alias("_u"), key.alias("_a")).distinct()
    return rows.join(gone, (F.col("user_id") == F.col("_u")) & (key == F.col("_a")), "left_anti")


def popularity_prior(popularity: Column) -> Column:
    p = clamp(popularity / 100.0)
    return F.log1p(p * 100) / F.log(F.lit(101.0))


def relevance(rows: DataFrame) -> DataFrame:
    """Adds genre_score, artist_score and relevance to rows with similarity, representation, genres (array),
    profile_genres (map of per cents), artist_name, top_artists (array) and track_popularity."""
    genre = clamp(F.aggregate(F.coalesce("genres", F.array().cast("array<string>")), F.lit(0.0), lambda s, g: s + F.coalesce(F.col("profile_genres")[g], F.lit(0.0)) / 100))
    known = F.exists("top_artists", lambda a: F.lower(F.trim(a)) == F.col("_artist"))
    artist = F.when(F.coalesce(known, F.lit(False)), 1.0).otherwise(0.0)
    # One column after another, since several signals and the sum would each compute them again.
    rows = rows.withColumn("_artist", F.lower(F.trim("artist_name"))).withColumns({"genre_score": genre, "artist_score": artist, "_prior": popularity_prior(F.col("track_popularity"))})
    audio, shown = (clamp((F.col(c) + 1) / 2) for c in ("similarity", "representation"))
    parts = {"audio": audio, "representation": shown, "genre": F.col("genre_score"), "artist": F.col("artist_score"), "popularity": F.col("_prior"), "novelty": 1 - F.col("_prior")}
    return rows.withColumn("relevance", sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))).drop("_artist", "_prior")


def diverse(rows: DataFrame, limit: int, weight: float = LAMBDA, cap: int = ARTIST_CAP, penalty: float = GENRE_PENALTY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Greedy choice for each user: relevance against the likeness to what was chosen, with a cap per artist and a penalty
    for genres that repeat. rows: user_id, track_id, artist_name, genres, vector, relevance; at most POOL rows a user.

    The largest likeness of each candidate is kept from step to step. Returns user_id, track_id, rank, score, and the columns
    of rows in keep.
    """

    def choose(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("relevance", "descending"), ("track_id", "ascending")])).combine_chunks()
        n = table.num_rows
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        norm = np.linalg.norm(x, axis=1)
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        lists = table.column("genres").combine_chunks()
        holds = pc.list_parent_indices(lists).to_numpy(), pc.dictionary_encode(lists.flatten().cast("string"))
        genres = np.zeros((n, max(1, len(holds[1].dictionary))))
        genres[holds[0], holds[1].indices.to_numpy(zero_copy_only=False)] = 1
        artists = np.unique([(a or "").strip().lower() for a in table.column("artist_name").to_pylist()], return_inverse=True)[1]
        gain, like, repeats, open_, used, out = table.column("relevance").to_numpy(), np.zeros(n), np.zeros(n), np.ones(n, bool), np.zeros(n, int), []
        while len(out) < limit and open_.any():
            score = np.where(open_, weight * gain - (1 - weight) * like - penalty * repeats, -np.inf)
            k = int(score.argmax())  # rows are in the order that decides ties
            out.append((k, score[k]))
            open_[k] = False
            used[artists[k]] += 1
            if used[artists[k]] >= cap:
                open_ &= artists != artists[k]
            like = np.maximum(like, unit @ unit[k])
            repeats += genres @ genres[k] > 0
        at = pa.array([k for k, _ in out], pa.int64())
        got = {c: table.column(c).take(at) for c in ("user_id", "track_id", *keep)}
        return pa.table(got | {"rank": pa.array(range(1, len(out) + 1), pa.int32()), "score": pa.array([s for _, s in out], pa.float64())})

    kinds = dict(rows.dtypes)
    thin = rows.select(*dict.fromkeys(["user_id", "track_id", "artist_name", "genres", "vector", "relevance", *keep]))
    return thin.groupBy("user_id").applyInArrow(choose, f"user_id {kinds['user_id']}, track_id {kinds['track_id']}, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "rank int, score double").select("user_id", "track_id", "rank", "score", *keep)


def explained(rows: DataFrame, most: int = 3) -> DataFrame:
    """Adds reasons: the features in which a track (vector) is nearest to the user (user_vector), each with its proximity in per
    cent of six deviations, and a sentence. For raw values see proximities()."""
    parts = [F.struct((-F.greatest(F.lit(0.0), 1 - F.abs(F.element_at("vector", i + 1) - F.element_at("user_vector", i + 1)) / 6) * 100).alias("order"), F.lit(f).alias("feature")) for i, f in enumerate(VECTOR)]
    near = F.slice(F.array_sort(F.array(*parts)), 1, most)
    reasons = F.transform(near, lambda s: F.struct(s["feature"].alias("feature"), F.round(-s["order"], 1).alias("proximity")))
    sentence = F.concat(F.lit("Close to your taste in "), F.array_join(F.transform(near, lambda s: s["feature"]), ", "))
    return rows.withColumns({"reasons": reasons, "explanation": sentence})


#: The parts of an explanation by proximity.
ALIGNED, SHARES = "Strong alignment in {} ({}% match) and {} ({}% match)", "shares your preferred genre ({})"


def proximities(rows: DataFrame, spans: dict[str, float], most: int = 3) -> DataFrame:
    """Adds to rows (raw, user_raw: arrays of feature values; genre, user_genre) what a track has in common with a user:
    top_features (feature, proximity in per cent of the feature's span, value), deltas, shares_genre, explanation_text. The
    feature order decides ties."""
    raw, user = (lambda i: F.element_at("raw", i + 1)), (lambda i: F.element_at("user_raw", i + 1))
    near = lambda i, f: F.bround(F.greatest(F.lit(0.0), 1 - F.abs(raw(i) - user(i)) / (spans[f] or 1.0)) * 100, 1)
    parts = [F.struct((-near(i, f)).alias("order"), F.lit(i).alias("place"), F.lit(f).alias("feature"), F.bround(raw(i), 3).alias("value")) for i, f in enumerate(VECTOR)]
    rows = rows.withColumn("_near", F.slice(F.array_sort(F.array(*parts)), 1, max(2, most)))
    same = F.coalesce(F.lower("genre") == F.lower("user_genre"), F.lit(False))
    name = lambda k: F.initcap(F.col("_near")[k]["feature"])
    per_cent = lambda k: F.format_string("%.0f", F.bround(-F.col("_near")[k]["order"], 0))
    text = ALIGNED.split("{}")
    first = F.concat(F.lit(text[0]), name(0), F.lit(text[1]), per_cent(0), F.lit(text[2]), name(1), F.lit(text[3]), per_cent(1), F.lit(text[4]))
    head, tail = SHARES.split("{}")
    second = F.when(same & (F.col("genre") != "Other"), F.concat(F.lit(head), F.col("genre"), F.lit(tail)))
    shown = F.transform(F.slice("_near", 1, most), lambda s: F.struct(s["feature"].alias("feature"), (-s["order"]).alias("proximity"), s["value"].alias("value")))
    deltas = F.create_map(*[x for i, f in enumerate(VECTOR) for x in (F.lit(f), F.bround(raw(i) - user(i), 4))])
    return rows.withColumns({"top_features": shown, "deltas": deltas, "shares_genre": same, "explanation_text": F.concat(F.concat_ws(", ", first, second), F.lit("."))}).drop("_near")


def aligned_features(scale: tuple[float, ...], most: int = 3) -> Column:
    """Of a track's raw values and a user's (raw, user_raw) the features that differ least in deviations (scale): distance,
    feature, user_value, track_value, delta, standardized; nearest first, ties in the features' order."""
    raw, user = (lambda i: F.element_at("raw", i + 1)), (lambda i: F.element_at("user_raw", i + 1))
    delta = lambda i: raw(i) - user(i)
    parts = [
        F.struct(half_up(F.abs(delta(i) / s), 3).alias("distance"), F.lit(i).alias("place"), F.lit(f).alias("feature"), half_up(user(i), 3).alias("user_value"), half_up(raw(i), 3).alias("track_value"), half_up(delta(i), 3).alias("delta"), half_up(delta(i) / s, 3).alias("standardized"))
        for i, (f, s) in enumerate(zip(VECTOR, scale, strict=True))
    ]
    return F.slice(F.array_sort(F.array(*parts)), 1, most)


#: From which value on a signal is mentioned, and the sentences of an explanation.
MENTION = {"genre": 0.15, "artist": 0.5, "novelty": 0.65}
SENTENCES = {
    "feature": "Closely matches your profile on {} ({})",
    "higher": "slightly higher {}",
    "lower": "slightly lower {}",
    "similar": "similar {}",
    "genre": "Aligns with your {} preference",
    "artist": "From an artist in your listening history",
    "novelty": "Less mainstream track — surfaces a less obvious discovery",
    "variety": "Adds genre variety to your recommendation list",
    "reranked": "Ranked by audio-feature similarity with diversity-aware reranking.",
    "plain": "Ranked by canonical audio-feature cosine similarity.",
}


def _filled(name: str, *values: Column) -> Column:
    parts = SENTENCES[name].split("{}")
    return F.concat(*[x for p, v in zip(parts, [*values, None], strict=True) for x in ([F.lit(p)] if v is None else [F.lit(p), v])])


def narrative(aligned: Column, repeats: Column | None = None) -> Column:
    """Sentences about what is true of a track: the nearest feature of aligned (aligned_features()), and the signals that are
    large enough to be mentioned: genre_score with matched_genres, artist_score, novelty, and, where lists are made diverse,
    repeats = 0 (the track's genres among those chosen before)."""
    near = F.get(aligned, F.lit(0))
    way = F.when(near["delta"] > 0, _filled("higher", near["feature"])).when(near["delta"] < 0, _filled("lower", near["feature"])).otherwise(_filled("similar", near["feature"]))
    parts = F.array(
        F.when(near.isNotNull(), _filled("feature", near["feature"], way)),
        F.when((F.col("genre_score") >= MENTION["genre"]) & (F.size("matched_genres") > 0), _filled("genre", F.array_join(F.slice("matched_genres", 1, 2), " and "))),
        F.when(F.col("artist_score") >= MENTION["artist"], _filled("artist")),
        F.when(F.col("novelty") >= MENTION["novelty"], _filled("novelty")),
        F.when(repeats == 0, _filled("variety")) if repeats is not None else F.lit(None).cast("string"),
    )
    said = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, ". "), F.lit("."))).otherwise(SENTENCES["plain" if repeats is None else "reranked"])


def matched_genres() -> Column:
    """Of a track's genres those of which the profile (profile_genres: per cents) has enough to be mentioned."""
    return F.filter(F.coalesce("genres", F.array().cast("array<string>")), lambda g: F.coalesce(F.col("profile_genres")[g], F.lit(0.0)) / 100 >= MENTION["genre"])


def result_rows(rows: DataFrame) -> DataFrame:
    """Rows as they are handed out: user_id, rank, track_id, track_name, artist_name, genre_name, track_popularity, scores to four
    digits, features and explanation as structs. rows: these columns, similarity, relevance, the features, aligned
    (aligned_features()), narrative, and the signals genre_score, artist_score, novelty, matched_genres."""
    explanation = F.struct(
        F.col("aligned").alias("strongest_feature_alignments"),
        F.struct("matched_genres", half_up(F.col("genre_score"), 4).alias("score"), (F.col("genre_score") >= MENTION["genre"]).alias("above_threshold")).alias("genre_contribution"),
        F.struct((F.col("artist_score") >= MENTION["artist"]).alias("is_preferred_artist"), half_up(F.col("artist_score"), 4).alias("score")).alias("artist_contribution"),
        F.struct(half_up(F.col("novelty"), 4).alias("score"), (F.col("novelty") >= MENTION["novelty"]).alias("is_novel")).alias("novelty_contribution"),
        "narrative",
    )
    return rows.select("user_id", "rank", "track_id", "track_name", "artist_name", "genre_name", "track_popularity", half_up(F.col("similarity"), 4).alias("similarity_score"), half_up(F.col("relevance"), 4).alias("relevance_score"), F.struct(*VECTOR).alias("audio_features"), explanation.alias("explanation"))


# Queries: embeddings stand for tracks (64 dimensions), the first vectors for users.

_E = "with e as (select vec_id, label, embedding::double[] as v from embeddings)"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _embeddings(c: Catalog) -> DataFrame:
    return c.raw("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


@query("rec_cosine_topk", f"""{_E}, s as (select u.vec_id as user_id, t.vec_id as track_id, round({_COS.format('u.v', 't.v')}, 9) as similarity from e u, e t where u.vec_id % 100 = 0 and u.vec_id <> t.vec_id)
    select user_id, track_id, round(similarity, 6) as similarity, n as position from (select *, row_number() over (partition by user_id order by similarity desc, track_id) as n from s) where n <= 10""", prefix=False)
def rec_cosine_topk(c: Catalog) -> DataFrame:
    """The ten nearest tracks of each hundredth vector, by nearest(); those that have no direction or parts that are no numbers
    are compared one by one, as SQL does."""
    steps, e = Steps(c.spark, "topk"), _embeddings(c)
    odd = F.coalesce(F.size("vector") == 0, F.lit(True)) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = e.where(~odd).select(F.col("vec_id").alias("track_id"), F.lit(0).alias("track_popularity"), "vector")
    others = steps.write(e.where(odd).select(F.col("vec_id").alias("track_id"), "vector"))  # empty, most often
    asked = lambda df: df.where("track_id % 100 = 0").select(F.col("track_id").alias("user_id"), F.col("vector").alias("user_vector"))

    def one_by_one(users: DataFrame, tracks: DataFrame) -> DataFrame:
        pairs = tracks.join(users, F.col("track_id") != F.col("user_id"))
        return pairs.select("user_id", "track_id", F.round(cosine(F.col("user_vector"), F.col("vector")), 9).alias("similarity"))

    users = asked(plain)
    scored = nearest(users, plain, users.select("user_id", F.col("user_id").alias("track_id")), 10).select("user_id", "track_id", "similarity")
    every = plain.select("track_id", "vector")
    for some, tracks in ((users, others), (asked(others), every), (asked(others), others)):
        scored = scored.unionByName(one_by_one(some, tracks))
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("similarity"), "track_id"))
    return scored.withColumn("position", n.cast("long")).where("position <= 10").withColumn("similarity", F.round("similarity", 6))


_Z = "with s as (select " + ", ".join(f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}, min({f}) as l_{f}, max({f}) as h_{f}" for f in VECTOR) + " from audio_features)"


@query("sc_standard", _Z + " select track_id, " + ", ".join(f"round(({f} - m_{f}) / coalesce(nullif(s_{f}, 0), 1), 6) as {f}" for f in VECTOR) + " from audio_features cross join s")
def sc_standard(c: Catalog) -> DataFrame:
    rows = c.audio_features()
    z = Scaler.fit(rows).vector()
    return rows.select("track_id", *[F.round(F.element_at(z, i + 1), 6).alias(f) for i, f in enumerate(VECTOR)])


@query("sc_inverse", "select track_id, " + ", ".join(f"round({f} * 1.000000000001, 5) as {f}" for f in VECTOR) + " from audio_features")
def sc_inverse(c: Catalog) -> DataFrame:
    """Scaled and scaled back."""
    rows = c.audio_features()
    scaler = Scaler.fit(rows)
    back = scaler.inverse(scaler.vector())
    return rows.select("track_id", *[rounded(F.element_at(back, i + 1), 5).alias(f) for i, f in enumerate(VECTOR)])


@query("sc_minmax", _Z + " select track_id, " + ", ".join(f"round(({f} - l_{f}) / coalesce(nullif(h_{f} - l_{f}, 0), 1), 6) as {f}" for f in VECTOR) + " from audio_features cross join s")
def sc_minmax(c: Catalog) -> DataFrame:
    rows = c.audio_features()
    ends = rows.agg(*[g(f).alias(f"{p}_{f}") for f in VECTOR for p, g in (("l", F.min), ("h", F.max))])
    share = lambda f: (F.col(f) - F.col(f"l_{f}")) / F.coalesce(F.nullif(F.col(f"h_{f}") - F.col(f"l_{f}"), F.lit(0.0)), F.lit(1.0))
    return rows.crossJoin(F.broadcast(ends)).select("track_id", *[F.round(share(f), 6).alias(f) for f in VECTOR])  # one row


@query("sc_pca")
def sc_pca(c: Catalog) -> DataFrame:
    """Shares of variance of the principal axes that explain 95 % together."""
    rows = c.audio_features()
    p = Projection.fit(rows, Scaler.fit(rows))
    return c.spark.createDataFrame([(i + 1, round(r, 6)) for i, r in enumerate(p.ratios)], "axis int, ratio double")


_PRIOR = "ln(1 + least(greatest(track_popularity / 100.0, 0), 1) * 100) / ln(101.0)"


@query("rec_popularity", f"select track_id, round({_PRIOR}, 6) as prior, round(1 - {_PRIOR}, 6) as novelty from tracks")
def rec_popularity(c: Catalog) -> DataFrame:
    prior = popularity_prior(F.col("track_popularity"))
    return c.tracks().select("track_id", F.round(prior, 6).alias("prior"), F.round(1 - prior, 6).alias("novelty"))


def _users(c: Catalog) -> tuple[DataFrame, DataFrame, Projection]:
    """Scaled catalog vectors, vectors of the users with likes, and the principal axes that both are compared on."""
    steps = Steps(c.spark, "users")
    genres = c.relation("playlist_tracks genres").groupBy("track_id").agg(F.array_sort(F.collect_set("genre_name")).alias("genres"))
    rows = c.relation("tracks artists audio_features").select("track_id", "artist_name", "track_popularity", *VECTOR)
    rows = steps.write(rows.join(genres, "track_id", "left"))  # plain features, which repeat, are stored in less than vectors
    scaler = Scaler.fit(rows)
    axes = Projection.fit(rows, scaler)
    catalog = rows.select("track_id", "artist_name", "track_popularity", scaler.vector().alias("vector"), "genres")
    return catalog, steps.write(_means(c, catalog, steps)), axes


def _means(c: Catalog, catalog: DataFrame, steps: Steps) -> DataFrame:
    """(user_id, user_vector): the mean of what each user likes."""
    liked = steps.write(_likes(c))
    seeds = liked.withColumn("weight", F.lit(1.0))
    return user_vectors(seeds, _among(catalog.select("track_id", "vector"), liked, steps)).withColumnRenamed("vector", "user_vector")


def _among(catalog: DataFrame, liked: DataFrame, steps: Steps) -> DataFrame:
    """The rows of catalog that are liked: where users like the same tracks, few."""
    return catalog.join(steps.write(liked.select("track_id").distinct()), "track_id", "left_semi")


def recommend_from(catalog: DataFrame, users: DataFrame, axes: Projection, excluded: DataFrame, limit: int = 10, banned: DataFrame | None = None) -> DataFrame:
    """Ranked and diversified recommendations with explanations for any vectors: of users, of pairs, of personas.

    users: user_id, user_vector, profile_genres (map of per cents), top_artists (array); excluded: user_id, track_id; banned:
    user_id, artist_name. Without vector a user has no rows: see by_resolution.
    """
    pool = candidates(users.where(F.col("user_vector").isNotNull()).select("user_id", "user_vector"), catalog, excluded)
    if banned is not None:
        pool = without_artists(pool, banned)
    ranked = relevance(pool.withColumn("representation", on_axes(axes)).join(users.drop("user_vector"), "user_id", "left"))
    chosen = diverse(ranked, limit, keep=("artist_name", "track_popularity", "vector", "similarity", "relevance"))
    return explained(chosen.join(users.select("user_id", "user_vector"), "user_id")).select("user_id", "rank", "track_id", "artist_name", "track_popularity", F.round("similarity", 4).alias("similarity"), F.round("relevance", 4).alias("relevance"), F.round("score", 4).alias("score"), "reasons", "explanation")


def by_resolution(users: DataFrame, mode: str = "auto", least: str = "developing") -> DataFrame:
    """users (enhanced, preference, liked: arrays or null; status) with user_vector and why: the first vector that may be used.
    Where there is none, why is popularity and the vector null."""
    from .listeners import resolved_vector

    vector, why = resolved_vector(mode, least)
    return users.withColumns({"user_vector": vector, "why": why})


def embedded(users: DataFrame, axes: Projection) -> DataFrame:
    """users (user_id, user_vector) with their place on the principal axes."""
    return users.withColumn("embedding", axes.apply(F.col("user_vector")))


def _likes(c: Catalog) -> DataFrame:
    from .signals import likes

    return likes(c).select("user_id", "track_id")


def _tastes(c: Catalog, catalog: DataFrame) -> DataFrame:
    """(user_id, profile_genres: map of per cents, top_artists) from the likes."""
    steps = Steps(c.spark, "tastes")
    liked = steps.write(_likes(c))
    liked = steps.write(liked.join(_among(catalog.select("track_id", "artist_name", "genres"), liked, steps), "track_id"))
    tastes = liked.select("user_id", F.explode("genres").alias("g")).groupBy("user_id", "g").agg(F.count("*").alias("n"))
    tastes = tastes.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("user_id"))).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("g", "pct"))).alias("profile_genres"))
    artists = liked.groupBy("user_id").agg(F.collect_set("artist_name").alias("top_artists"))
    return artists.join(tastes, "user_id", "left")


def recommendations(c: Catalog, limit: int = 10) -> DataFrame:
    """Recommendations for all users with likes."""
    catalog, users, axes = _users(c)
    return recommend_from(catalog, users.join(_tastes(c, catalog), "user_id", "left"), axes, _likes(c), limit)


_LIKED = "l as (select distinct user_id, 1 + cast(json_extract_string(props, '$.k') as bigint) as track_id from events where event_type = 'purchase')"
_ZV = _Z.replace("with s as", "zs as") + ", zv as (select track_id, artist_name, track_popularity, [" + ", ".join(f"({f} - m_{f}) / coalesce(nullif(s_{f}, 0), 1)" for f in VECTOR) + "] as v from tracks join artists using (artist_id) join audio_features using (track_id) cross join zs)"
_USERS = "uv as (select user_id, [" + ", ".join(f"avg(v[{i + 1}])" for i in range(len(VECTOR))) + "] as u from l join zv using (track_id) group by 1)"
_PRIOR_OF = "ln(1 + least(greatest(track_popularity / 100.0, 0), 1) * 100) / ln(101.0)"


@query(
    "rec_pool",
    f"""with {_LIKED}, {_ZV}, {_USERS}, sims as (select user_id, track_id, track_popularity, artist_name, round(case when list_dot_product(v, v) = 0 or list_dot_product(u, u) = 0 then 0 else list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))) end, 9) as sim from uv cross join zv where not exists (select 1 from l where l.user_id = uv.user_id and l.track_id = zv.track_id)),
    ranked as (select *, row_number() over (partition by user_id order by sim desc, track_popularity desc, track_id) as position from sims),
    tg as (select track_id, list(distinct genre_name) as genres from playlist_tracks join genres using (genre_id) group by 1),
    gp as (select user_id, g, n * 100.0 / sum(n) over (partition by user_id) as pct from (select user_id, unnest(genres) as g, count(*) as n from l join zv using (track_id) join tg using (track_id) group by 1, 2)),
    ga as (select r.user_id, r.track_id, least(sum(pct / 100), 1) as genre_score from (select user_id, track_id, unnest(genres) as g from ranked join tg using (track_id) where position <= 50) r join gp on gp.user_id = r.user_id and gp.g = r.g group by 1, 2),
    la as (select distinct user_id, artist_name from l join zv using (track_id)), p as (select *, {_PRIOR_OF} as prior from ranked where position <= 50)
    select p.user_id, p.track_id, cast(position as int) as position, round(sim, 6) as similarity, round(coalesce(genre_score, 0) * 1.000000000001, 6) as genre_score, case when la.user_id is not null then 1.0 else 0.0 end as artist_score,
        round((0.45 * (sim + 1) / 2 + 0.25 * (sim + 1) / 2 + 0.10 * coalesce(genre_score, 0) + 0.04 * case when la.user_id is not null then 1.0 else 0.0 end + 0.06 * prior + 0.10 * (1 - prior)) * 1.000000000001, 6) as relevance
    from p left join ga using (user_id, track_id) left join la on la.user_id = p.user_id and la.artist_name = p.artist_name""",
)
def rec_pool(c: Catalog) -> DataFrame:
    """Each listener's fifty most similar tracks with all signals of relevance; all axes being kept, likeness on them is that of
    the vectors."""
    catalog, users, _ = _users(c)
    pool = candidates(users, catalog, _likes(c), 50)
    rows = relevance(pool.withColumn("representation", F.col("similarity")).join(_tastes(c, catalog), "user_id", "left"))
    return rows.select("user_id", "track_id", "position", F.round("similarity", 6).alias("similarity"), rounded(F.col("genre_score"), 6).alias("genre_score"), "artist_score", rounded(F.col("relevance"), 6).alias("relevance"))


@query("rec_rank6")
def rec_rank6(c: Catalog) -> DataFrame:
    """Relevance of the users' pools by all six signals."""
    catalog, users, axes = _users(c)
    rows = candidates(users, catalog, _likes(c), 50).withColumns({"representation": on_axes(axes), "profile_genres": F.create_map(F.lit("ASIA"), F.lit(60.0), F.lit("EUROPE"), F.lit(40.0)), "top_artists": F.array(F.lit("Customer#000000001"))})
    return relevance(rows).select("user_id", "track_id", F.round("relevance", 6).alias("relevance"), rounded(F.col("genre_score"), 6).alias("genre_score"), "artist_score")


@query("rec_mmr")
def rec_mmr(c: Catalog) -> DataFrame:
    return recommendations(c).drop("reasons")


_HIST = "with h as (select user_id, 1 + cast(json_extract_string(props, '$.k') as bigint) as track_id, event_type, value from events) "


@query("rec_history_excl", _HIST + "select user_id, count(distinct track_id) as excluded from h where event_type = 'purchase' or (event_type in ('click', 'view') and (value is null or value >= 85)) group by 1", prefix=False)
def rec_history_excl(c: Catalog) -> DataFrame:
    """What a user has liked or surely heard is left out: likes, and plays that were matched with enough confidence."""
    k = (F.get_json_object("props", "$.k").cast("long") + 1).alias("track_id")
    e = c.raw("events")
    liked = e.where("event_type = 'purchase'").select("user_id", k)
    heard = e.where("event_type in ('click', 'view') and (value is null or value >= 85)").select("user_id", k)
    return liked.union(heard).distinct().groupBy("user_id").agg(F.count("*").alias("excluded"))


_SPANS = "with r as (select " + ", ".join(f"avg({f}) as m_{f}, max({f}) - min({f}) as s_{f}" for f in VECTOR) + " from audio_features)"


@query("rec_proximity", _SPANS + " select track_id, " + ", ".join(f"round(greatest(0, 1 - abs({f} - m_{f}) / nullif(s_{f}, 0)) * 100, 3) as {f}" for f in VECTOR) + " from audio_features cross join r")
def rec_proximity(c: Catalog) -> DataFrame:
    """How near each feature is to the catalog's mean, in per cent of its span."""
    rows = c.audio_features()
    r = rows.agg(*[x for f in VECTOR for x in (F.avg(f).alias(f"m_{f}"), (F.max(f) - F.min(f)).alias(f"s_{f}"))])
    near = lambda f: F.greatest(F.lit(0.0), 1 - F.abs(F.col(f) - F.col(f"m_{f}")) / F.nullif(F.col(f"s_{f}"), F.lit(0.0))) * 100
    return rows.crossJoin(F.broadcast(r)).select("track_id", *[F.round(near(f), 3).alias(f) for f in VECTOR])  # one row
