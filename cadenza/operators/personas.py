"""Evaluation by personas: what is held out for them, three ways to recommend, their comparison, technical checks, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import cosine
from ..plans.staged import Steps
from ..schema import VECTOR
from ..sources.catalog import Catalog
from ..sources.files import load_json, save_json
from .evaluation import list_diversity, micro, novelty, ranking_metrics, summary, temporal_split
from .labels import fingerprint
from .recommend import Projection, Scaler, aligned_features, diverse, narrative, popularity_prior
from .registry import query
from .serving import PERSONAS_SQL, SEED, persona_scores, persona_tables

#: The length of the truth, of a list, and the lift over chance that counts as passed.
TRUTH, LIST, LIFT = 50, 10, 0.40
YEAR = 1996


def _first(rows: DataFrame, n: int, *order) -> DataFrame:
    by = W.partitionBy("persona").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def by_similarity(scored: DataFrame, n: int = LIST) -> DataFrame:
    return _first(scored, n, F.desc("similarity"), F.desc("track_popularity"), "track_id")


def by_popularity(scored: DataFrame, n: int = LIST) -> DataFrame:
    return _first(scored, n, F.desc("track_popularity"), "track_id")


def by_mixture(scored: DataFrame, n: int = LIST) -> DataFrame:
    """Similarity with a tenth of popularity."""
    mixed = F.round(0.9 * (F.col("similarity") + 1) / 2 + 0.1 * F.col("track_popularity") / 100, 9)
    return _first(scored.withColumn("mixed", mixed), n, F.desc("mixed"), "track_id")


#: Ways to recommend: each takes (scored candidates, how many) and returns persona, track_id, rank.
MODELS = {"content": by_similarity, "popularity": by_popularity, "mixed": by_mixture}


def truth(scored: DataFrame, held_out: DataFrame, n: int = TRUTH) -> DataFrame:
    """Each persona's n most similar tracks among those held out: persona, track_id, gain."""
    return by_similarity(scored.join(held_out.select("track_id"), "track_id", "left_semi"), n).select("persona", "track_id", F.lit(1.0).alias("gain"))


def comparison(scored: DataFrame, known: DataFrame, k: int = LIST) -> DataFrame:
    """One row for each model: means of its metrics over the personas."""
    parts = [ranking_metrics(f(scored, k).select("persona", "track_id", "rank"), known, k).withColumn("model", F.lit(name)) for name, f in MODELS.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "hit_rate")], F.count("*").alias("personas"))


#: Fixed values of the enhanced model: how much each signal counts, its pool, how much relevance counts against likeness to what
#: was chosen, and how many tracks of an artist a list may have.
ENHANCED = {"audio": 0.80, "genre": 0.08, "artist": 0.04, "popularity": 0.02, "novelty": 0.06}
ENHANCED_POOL, ENHANCED_LAMBDA, ENHANCED_CAP = 500, 0.75, 2


def enhanced(profile: DataFrame, seeds: DataFrame, held_out: DataFrame, n: int = LIST) -> DataFrame:
    """(persona, track_id, rank) of the enhanced model. profile, held_out: track_id, artist_name, genre, track_popularity and the
    features; seeds: persona, track_id.

    Scaler and principal axes come from the profile alone. A persona is the mean of its seeds on the axes; its pool are the held
    out tracks most similar to it there. Relevance adds the similarity, spread from 0 to 1 over the pool, a genre and an artist
    that a seed has too, the popularity as a part of the profile's largest, and what is left of it as novelty. The first of a
    list is the most relevant; each next one has the best of relevance against its likeness to those before. Equal scores go
    by id.
    """
    scaler = Scaler.fit(profile)
    axes = Projection.fit(profile, scaler)
    known = profile.join(seeds, "track_id").select("persona", "artist_name", "genre", axes.apply(scaler.vector()).alias("place"))
    users = known.groupBy("persona").agg(F.array(*[F.avg(F.element_at("place", i + 1)) for i in range(len(axes.axes))]).alias("user"), F.collect_set("genre").alias("own_genres"), F.collect_set("artist_name").alias("own_artists"))
    top = F.coalesce(F.nullif(F.max(F.col("track_popularity").cast("double")), F.lit(0.0)), F.lit(1.0))
    most = profile.agg(top.alias("_most"))
    rows = held_out.select("track_id", "artist_name", "genre", "track_popularity", scaler.vector().alias("vector")).withColumn("place", axes.apply(F.col("vector")))
    steps = Steps(profile.sparkSession, "enhanced")
    users = steps.write(users)
    if users.count() <= 1000:
        users = F.broadcast(users)
    pairs = rows.join(users, F.lit(True), "cross").join(seeds, ["persona", "track_id"], "left_anti").withColumn("similarity", cosine(F.col("place"), F.col("user")))
    pool = _first(pairs, ENHANCED_POOL, F.desc("similarity"), "track_id")
    by = W.partitionBy("persona")
    low, high = F.min("similarity").over(by), F.max("similarity").over(by)
    pool = pool.withColumns({"_low": low, "_high": high}).crossJoin(F.broadcast(most))  # one row
    popular = F.coalesce(F.col("track_popularity"), F.lit(0)) / F.col("_most")
    parts = {
        "audio": F.when(F.col("_high") > F.col("_low"), (F.col("similarity") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))).otherwise(1.0),
        "genre": F.array_contains("own_genres", F.coalesce("genre", F.lit("unknown"))).cast("double"),
        "artist": F.array_contains("own_artists", F.coalesce("artist_name", F.lit("unknown"))).cast("double"),
        "popularity": popular,
        "novelty": 1 - popular,
    }
    ranked = pool.select(F.col("persona").alias("user_id"), "track_id", "artist_name", F.lit(None).cast("array<string>").alias("genres"), "vector", sum((w * parts[k] for k, w in ENHANCED.items()), F.lit(0.0)).alias("relevance"))
    return diverse(ranked, n, ENHANCED_LAMBDA, ENHANCED_CAP, 0.0).select(F.col("user_id").alias("persona"), "track_id", "rank")


def per_persona(lists: DataFrame, known: DataFrame, vectors: DataFrame, tracks: DataFrame, k: int = LIST) -> DataFrame:
    """(model, unit, metric, value) of lists (model, persona, track_id, rank): the ranking metrics against known (persona,
    track_id, gain), diversity over vectors (raw space) and novelty over tracks; null where a metric is not defined."""
    names = [r[0] for r in lists.select("model").distinct().collect()]  # a handful of models
    out = None
    for name in sorted(names):
        mine = lists.where(F.col("model") == name).where(F.col("rank") <= k).select("persona", "track_id", "rank")
        rows = ranking_metrics(mine, known, k).join(list_diversity(mine, vectors), "persona", "left").join(novelty(mine, tracks), "persona", "left")
        metrics = [c for c in rows.columns if c != "persona"]
        long = rows.withColumnRenamed("persona", "unit").unpivot("unit", metrics, "metric", "value").withColumn("model", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out.select("model", "unit", "metric", F.col("value").cast("double").alias("value"))


def report(lists: DataFrame, known: DataFrame, vectors: DataFrame, tracks: DataFrame, held_out: DataFrame, k: int = LIST, rounds: int = 1000) -> DataFrame:
    """(model, metric, macro_mean, macro_std, macro_median, macro_min, macro_max, ci_lower, ci_upper, n_valid): the summary of each
    metric over personas, and as metrics without spread catalog_coverage and artist_coverage of held_out (track_id,
    artist_name), micro_precision and micro_recall."""
    steps = Steps(lists.sparkSession, "report")
    values = steps.write(per_persona(lists, known, vectors, tracks, k))
    rows = summary(values, ["model", "metric"], rounds)
    top = lists.where(F.col("rank") <= k)
    got = top.select("model", "track_id").distinct().join(held_out.select("track_id", "artist_name"), "track_id", "left").groupBy("model").agg(F.count_distinct("track_id").alias("t"), F.count_distinct("artist_name").alias("a"))
    all_ = held_out.agg(F.count_distinct("track_id").alias("nt"), F.count_distinct("artist_name").alias("na"))
    covered = got.crossJoin(F.broadcast(all_)).select("model", (F.col("t") / F.nullif("nt", F.lit(0))).alias("catalog_coverage"), (F.col("a") / F.nullif("na", F.lit(0))).alias("artist_coverage"))  # one row
    whole = covered.join(micro(top, known, ["model"], k).select("model", "micro_precision", "micro_recall"), "model")
    whole = whole.unpivot("model", ["catalog_coverage", "artist_coverage", "micro_precision", "micro_recall"], "metric", "macro_mean")
    return rows.unionByName(whole, allowMissingColumns=True)


def by_chance(scored: DataFrame, n: int = 500) -> DataFrame:
    """Per persona the mean similarity of n of its candidates, drawn by a fixed shuffle of their ids."""
    draw = _first(scored, n, (F.col("track_id") * 7919) % 10007, "track_id")
    return draw.groupBy("persona").agg(F.avg("similarity").alias("chance"))


def lifts(scored: DataFrame) -> DataFrame:
    found = by_similarity(scored).groupBy("persona").agg(F.avg("similarity").alias("found"))
    out = found.join(by_chance(scored), "persona")
    return out.select("persona", "found", "chance", (F.col("found") - F.col("chance")).alias("lift"))


def checks(scored: DataFrame, seeds: DataFrame, n: int = 25) -> DataFrame:
    """(check_name, passed): scores in bounds, lists that descend, no seeds, no repeats, every lift above LIFT."""
    rows = by_similarity(scored, n)
    last = F.lag("similarity").over(W.partitionBy("persona").orderBy("rank"))
    one = lambda df, name, passed: df.agg(passed.alias("passed")).select(F.lit(name).alias("check_name"), "passed")
    parts = [
        one(rows, "bounded", F.bool_and(F.col("similarity").between(-1, 1))),
        one(rows.withColumn("_last", last), "descending", F.bool_and(F.col("similarity") <= F.coalesce("_last", "similarity"))),
        one(rows.join(seeds, ["persona", "track_id"], "left_semi"), "no_seeds", F.count("*") == 0),
        one(rows.groupBy("persona", "track_id").count(), "no_repeats", F.max("count") == 1),
        one(lifts(scored), "lift", F.bool_and(F.col("lift") > LIFT)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_manifest(seeds: DataFrame, path: str, most: int = 100_000) -> None:
    """Personas with their seeds and each one's fingerprint as JSON; larger sets than most are refused."""
    rows = seeds.groupBy("persona").agg(F.array_sort(F.collect_list("track_id")).alias("ids")).withColumn("mark", fingerprint(F.col("ids"))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} personas")
    save_json({"personas": {r["persona"]: {"track_ids": r["ids"], "fingerprint": r["mark"]} for r in rows}}, path)


def load_manifest(spark, path: str) -> DataFrame:
    """(persona, track_id) as saved; a fingerprint that doesn't fit is an error."""
    from hashlib import sha256

    out = []
    for persona, d in load_json(path)["personas"].items():
        if sha256("|".join(sorted(map(str, d["track_ids"]))).encode()).hexdigest()[:8] != d["fingerprint"]:
            raise ValueError(f"{persona}: the ids are not those that were saved")
        out += [(persona, i) for i in d["track_ids"]]
    return spark.createDataFrame(out, "persona string, track_id long")


_HELD = f"(select o_orderkey as track_id from orders where year(o_orderdate) >= {YEAR})"
_RANKS = """r as (select 'content' as model, persona, track_id, sim, row_number() over (partition by persona order by sim desc, track_popularity desc, track_id) as k from c
    union all select 'popularity', persona, track_id, sim, row_number() over (partition by persona order by track_popularity desc, track_id) from c
    union all select 'mixed', persona, track_id, sim, row_number() over (partition by persona order by round(0.9 * (sim + 1) / 2 + 0.1 * track_popularity / 100, 9) desc, track_id) from c)"""
_TRUTH = f"t as (select persona, track_id from (select persona, track_id, row_number() over (partition by persona order by sim desc, track_popularity desc, track_id) as n from c join {_HELD} using (track_id)) where n <= {TRUTH})"
_LIFTS = "d as (select persona, avg(sim) as chance from (select persona, sim, row_number() over (partition by persona order by (track_id * 7919) % 10007, track_id) as n from c) where n <= 500 group by 1), x as (select persona, avg(sim) as found from r where model = 'content' and k <= 10 group by 1)"


def _held(c: Catalog) -> DataFrame:
    return temporal_split(c.relation("tracks albums"), YEAR)[1]


@query("ev_truth", f"with {PERSONAS_SQL}, {_TRUTH} select persona, track_id from t")
def ev_truth(c: Catalog) -> DataFrame:
    return truth(persona_scores(c)[0], _held(c)).select("persona", "track_id")


@query(
    "ev_compare",
    f"with {PERSONAS_SQL}, {_RANKS}, {_TRUTH}, h as (select model, persona, count(t.track_id) as hits from r left join t using (persona, track_id) where k <= 10 group by 1, 2) select model, round(avg(hits / 10.0), 6) as precision, round(avg(hits / 50.0), 6) as recall, round(avg(case when hits > 0 then 1.0 else 0.0 end), 6) as hit_rate, count(*) as personas from h group by 1",
)
def ev_compare(c: Catalog) -> DataFrame:
    """Three models against what is held out for each persona."""
    scored, _ = persona_scores(c)
    rows = comparison(scored, truth(scored, _held(c)))
    return rows.select("model", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "hit_rate")], "personas")


@query("ev_lift", f"with {PERSONAS_SQL}, {_RANKS}, {_LIFTS} select persona, round(found, 6) as found, round(chance, 6) as chance, round(found - chance, 5) as lift, found - chance > {LIFT} as passed from x join d using (persona)")
def ev_lift(c: Catalog) -> DataFrame:
    rows = lifts(persona_scores(c)[0])
    return rows.select("persona", F.round("found", 6).alias("found"), F.round("chance", 6).alias("chance"), F.round("lift", 5).alias("lift"), (F.col("lift") > LIFT).alias("passed"))


@query(
    "ev_checks",
    f"""with {PERSONAS_SQL}, {_RANKS}, {_LIFTS}, q as (select *, lag(sim) over (partition by persona order by k) as before from r where model = 'content' and k <= 25)
    select 'bounded' as check_name, bool_and(sim between -1 and 1) as passed from q union all select 'descending', bool_and(sim <= coalesce(before, sim)) from q
    union all select 'no_seeds', count(*) = 0 from q join s using (persona, track_id) union all select 'no_repeats', max(n) = 1 from (select count(*) as n from q group by persona, track_id)
    union all select 'lift', bool_and(found - chance > {LIFT}) from x join d using (persona)""",
)
def ev_checks(c: Catalog) -> DataFrame:
    return checks(*persona_scores(c))


@query("ev_leakage", f"with y as (select track_id, release_year as y from tracks join albums using (album_id)) select count(*) filter (y < {YEAR}) as profile, count(*) filter (y >= {YEAR}) as held_out, (select count(*) from (select track_id from y where y < {YEAR} intersect select track_id from y where y >= {YEAR})) as both from y")
def ev_leakage(c: Catalog) -> DataFrame:
    """Sizes of the two parts of the split, and how many tracks are in both: none."""
    before, after = temporal_split(c.relation("tracks albums"), YEAR)
    shared = before.select("track_id").intersect(after.select("track_id")).agg(F.count("*").alias("both"))
    sizes = before.agg(F.count("*").alias("profile")).crossJoin(after.agg(F.count("*").alias("held_out")))
    return sizes.crossJoin(shared)  # one row each


_PICKED = "n as materialized (select persona, track_id, genre, track_popularity, vec, uv from r join c using (persona, track_id, track_popularity) join v using (track_id) join u using (persona) where model = 'content' and k <= 10)"
_RAW = "((vec[{k}] * s_{f} + m_{f}) - (uv[{k}] * s_{f} + m_{f}))"
_NEAR = "list_sort([" + ", ".join("{{'d': floor(abs({x} / s_{f}) * 1000 + 0.5) / 1000, 'p': {k}, 'f': '{f}', 'delta': floor({x} * 1000 + 0.5) / 1000}}".format(x=_RAW.format(k=i + 1, f=f), f=f, k=i) for i, f in enumerate(VECTOR)) + "])[1]"


@query(
    "rec_narrative",
    f"""with {PERSONAS_SQL}, {_RANKS.replace("track_id, sim,", "track_id, track_popularity, sim,")}, {_PICKED}, w as (select *, {_NEAR} as near from n cross join z)
    select persona, track_id, 'Closely matches your profile on ' || near.f || ' (' || case when near.delta > 0 then 'slightly higher ' when near.delta < 0 then 'slightly lower ' else 'similar ' end || near.f || ')'
        || case when genre = persona then '. Aligns with your ' || genre || ' preference' else '' end || case when 1 - ln(1 + track_popularity) / ln(101.0) >= 0.65 then '. Less mainstream track — surfaces a less obvious discovery' else '' end || '.' as narrative from w""",
)
def rec_narrative(c: Catalog) -> DataFrame:
    """Sentences for each persona's list; the genre counts where it is the persona's own, novelty where it is large."""
    tables = persona_tables(c)
    tracks, users, _, scaler = tables
    rows = by_similarity(persona_scores(c, tables=tables)[0]).join(tracks.select("track_id", "vector"), "track_id").join(users, "persona")
    own = F.col("genre") == F.col("persona")
    rows = rows.withColumns({"raw": scaler.inverse(F.col("vector")), "user_raw": scaler.inverse(F.col("user_vector")), "genre_score": F.when(own, 1.0).otherwise(0.0), "artist_score": F.lit(0.0), "novelty": 1 - popularity_prior(F.col("track_popularity")), "matched_genres": F.when(own, F.array("genre")).otherwise(F.array().cast("array<string>"))})
    return rows.select("persona", "track_id", narrative(aligned_features(scaler.scale)).alias("narrative"))


@query("ev_report")
def ev_report(c: Catalog) -> DataFrame:
    """All metrics of the popularity, content and enhanced models over personas whose seeds lie in the profile, held out tracks
    being recommended."""
    steps = Steps(c.spark, "evaluated")
    names = c.relation("tracks artists albums").select("track_id", "artist_name", "artist_id", "track_popularity", "release_year")
    genre = c.relation("playlist_tracks genres").groupBy("track_id").agg(F.min("genre_name").alias("genre"))
    tracks = steps.write(names.join(c.audio_features(), "track_id").join(genre, "track_id"))
    profile, held = temporal_split(tracks, YEAR)
    draw = F.row_number().over(W.partitionBy("genre").orderBy(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("track_id").cast("string"))), "track_id"))
    seeds = steps.write(profile.withColumn("_n", draw).where("_n <= 5").select(F.col("genre").alias("persona"), "track_id"))
    scaler = Scaler.fit(profile)
    vectors = tracks.select("track_id", scaler.vector().alias("vector"))
    mean = F.array(*[F.avg(F.element_at("vector", i + 1)) for i in range(len(VECTOR))])
    users = steps.write(seeds.join(vectors, "track_id").groupBy("persona").agg(mean.alias("user_vector")))
    pairs = held.select("track_id", "track_popularity").join(vectors, "track_id").join(F.broadcast(users) if users.count() <= 1000 else users, F.lit(True), "cross")
    scored = steps.write(pairs.select("persona", "track_id", "track_popularity", F.round(cosine(F.col("vector"), F.col("user_vector")), 9).alias("similarity")))
    known = steps.write(by_similarity(scored, TRUTH).select("persona", "track_id", F.greatest("similarity", F.lit(0.0)).alias("gain")))
    found = {"popularity": by_popularity(scored), "content": by_similarity(scored), "enhanced_personalized": enhanced(profile, seeds, held)}
    lists = None
    for name, rows in found.items():
        rows = steps.write(rows.select(F.lit(name).alias("model"), "persona", "track_id", F.col("rank").cast("int").alias("rank")))
        lists = rows if lists is None else lists.unionByName(rows)
    raw = tracks.select("track_id", F.array(*VECTOR).alias("vector"))
    out = report(lists, known, raw, tracks, held.select("track_id", "artist_name"), rounds=100)
    return out.select("model", "metric", *[F.round(x, 6).alias(x) for x in ("macro_mean", "macro_std", "macro_median", "macro_min", "macro_max", "ci_lower", "ci_upper")], "n_valid")
