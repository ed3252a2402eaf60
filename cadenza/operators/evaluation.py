"""Offline evaluation: split by year, ranking metrics, coverage, diversity, novelty, bootstrap intervals."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import cosine
from ..plans.order_stats import in_order, quantiles
from ..plans.staged import Steps
from ..sources.catalog import Catalog
from .registry import query


def temporal_split(tracks: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Tracks before the year, and from it on; those without a year are in neither."""
    return tracks.where(F.col("release_year") < year), tracks.where(F.col("release_year") >= year)


def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per persona: precision, recall, hit rate, average precision and nDCG at k.

    recs: persona, track_id, rank (from 1); truth: persona, track_id, gain. Precision divides by k even if fewer were
    recommended; personas without recommendations have zeros.
    """
    top = recs.where(F.col("rank") <= k).join(truth, ["persona", "track_id"], "left").withColumn("hit", F.when(F.col("gain").isNotNull(), 1).otherwise(0))
    sofar = F.sum("hit").over(W.partitionBy("persona").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    top = top.withColumn("ap", F.col("hit") * sofar / F.col("rank")).withColumn("dcg", F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1))
    got = top.groupBy("persona").agg(F.sum("hit").alias("hits"), F.sum("ap").alias("ap"), F.sum("dcg").alias("dcg"))
    ideal = truth.withColumn("n", F.row_number().over(W.partitionBy("persona").orderBy(F.desc("gain"), "track_id")))
    ideal = ideal.groupBy("persona").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("n") <= k, F.col("gain") / F.log2(F.col("n") + 1))).alias("best"))
    rows = ideal.join(got, "persona", "left").fillna(0, ["hits", "ap", "dcg"])
    return rows.select("persona", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"), (F.col("ap") / F.least("relevant", F.lit(k))).alias("ap"), F.coalesce(F.col("dcg") / F.nullif(F.col("best"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def list_diversity(recs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per persona the mean cosine distance of all pairs of its list; null below two tracks."""
    x = recs.join(vectors, "track_id").select("persona", "rank", "vector")
    y = x.select(F.col("persona").alias("_p"), F.col("rank").alias("_r"), F.col("vector").alias("_v"))
    pairs = x.join(y, (F.col("persona") == F.col("_p")) & (F.col("rank") < F.col("_r")))
    means = pairs.groupBy("persona").agg(F.avg(1 - cosine(F.col("vector"), F.col("_v"))).alias("diversity"))
    return recs.select("persona").distinct().join(means, "persona", "left")


def novelty(recs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per persona the mean surprise of its tracks: -log2 of popularity in per cent; popularity 0 counts as the largest surprise."""
    p = F.col("track_popularity")
    surprise = F.when(p > 0, -F.log2(F.least(p, F.lit(100)) / 100.0)).otherwise(F.log2(F.lit(100.0)))
    return recs.join(tracks.select("track_id", "track_popularity"), "track_id").groupBy("persona").agg(F.avg(surprise).alias("novelty"))


def coverage(recs: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: the share of the catalog's tracks and artists that are recommended to anyone."""
    named = recs.select("track_id").distinct().join(tracks.select("track_id", "artist_id"), "track_id")
    got = named.agg(F.count("*").alias("t"), F.count_distinct("artist_id").alias("a"))
    all_ = tracks.agg(F.count("*").alias("nt"), F.count_distinct("artist_id").alias("na"))
    return got.crossJoin(F.broadcast(all_)).select((F.col("t") / F.col("nt")).alias("catalog_coverage"), (F.col("a") / F.col("na")).alias("artist_coverage"))  # one row each


def safety(recs: DataFrame, seeds: DataFrame, score: str) -> DataFrame:
    """One row of counts that must be 0: seeds recommended, repeated tracks, scores that rise along a list."""
    last = F.lag(score).over(W.partitionBy("persona").orderBy("rank"))
    rising = recs.withColumn("_up", F.col(score) > last).agg(F.count_if("_up").alias("rising"))
    leaked = recs.join(seeds, ["persona", "track_id"], "left_semi").agg(F.count("*").alias("seeds"))
    repeated = recs.groupBy("persona", "track_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return leaked.crossJoin(repeated).crossJoin(rising)  # one row each


#: Rounds of the bootstrap, the values that it needs at least, the share outside of its interval.
ROUNDS, LEAST, ALPHA = 1000, 5, 0.05
#: How often a value is drawn in a round, by a uniform number: the Poisson distribution of mean 1, cut where less than 2^-32 is left.
_DRAWN = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def drawn(unit: Column, round_: Column, seed: int) -> Column:
    """How often a unit is drawn in a round: always the same for a seed, whatever the engine or the order of rows."""
    uniform = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), unit.cast("string"), round_.cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return sum((F.when(uniform >= p, 1).otherwise(0) for p in _DRAWN), F.lit(0))


def summary(values: DataFrame, by: list[str], rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """Per group of values (by, unit, value): n_valid, macro_mean, macro_std, macro_median, macro_min, macro_max, and the bootstrap
    interval ci_lower, ci_upper of the mean (null below LEAST values or without rounds). Null and NaN values don't count; a
    group without values has n_valid 0.

    Every round of every group is one sum in one aggregation: a value's weight in a round comes from a hash of its unit and the
    round, so nothing is drawn on the driver and no task holds a group. All groups draw alike."""
    x = F.when(~F.isnan("value"), F.col("value"))
    whole = values.groupBy(*by).agg(F.count(x).alias("n_valid"), F.avg(x).alias("macro_mean"), F.stddev_pop(x).alias("macro_std"), F.min(x).alias("macro_min"), F.max(x).alias("macro_max"))
    steps = Steps(values.sparkSession, "summary")
    rows = steps.write(values.where(x.isNotNull()).select(*by, "unit", F.col("value").cast("double").alias("value"), in_order(F.col("value")).alias("_order")))
    middle = quantiles(rows, by, "value", "_order", [0.5], steps).select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(by)], F.col("q")[0].alias("macro_median"))
    same = lambda right, mark: functools.reduce(lambda a, b: a & b, [whole[k].eqNullSafe(right[f"{mark}{i}"]) for i, k in enumerate(by)])
    out = whole.join(middle, same(middle, "_m"), "left").drop(*[f"_m{i}" for i in range(len(by))])
    if not rounds:
        return out.withColumns({"ci_lower": F.lit(None).cast("double"), "ci_upper": F.lit(None).cast("double")})
    many = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    times = drawn(F.col("unit"), F.col("_round"), seed)
    means = many.groupBy(*by, "_round").agg((F.sum(F.col("value") * times) / F.nullif(F.sum(times), F.lit(0))).alias("_mean"))
    ends = means.groupBy(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(by)]).agg(F.percentile("_mean", F.array(F.lit(ALPHA / 2), F.lit(1 - ALPHA / 2))).alias("_ends"))  # as many values as rounds
    out = out.join(ends, functools.reduce(lambda a, b: a & b, [out[k].eqNullSafe(ends[f"_e{i}"]) for i, k in enumerate(by)]), "left")
    enough = F.col("n_valid") >= LEAST
    return out.withColumns({"ci_lower": F.when(enough, F.col("_ends")[0]), "ci_upper": F.when(enough, F.col("_ends")[1])}).drop("_ends", *[f"_e{i}" for i in range(len(by))])


def micro(recs: DataFrame, truth: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per group of lists (by, persona, track_id, rank): hits, recommendations and truth of all its personas together, and their
    quotients. Every persona of truth counts for each group."""
    top = recs.where(F.col("rank") <= k).join(truth.select("persona", "track_id", F.lit(1).alias("_hit")), ["persona", "track_id"], "left")
    got = top.groupBy(*by).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("total_hits"), F.count("*").alias("total_recommendations"))
    got = got.crossJoin(F.broadcast(truth.agg(F.count("*").alias("total_ground_truth"))))  # one row
    return got.withColumns({"micro_precision": F.col("total_hits") / F.nullif("total_recommendations", F.lit(0)), "micro_recall": F.col("total_hits") / F.nullif("total_ground_truth", F.lit(0))})


# Queries: customers are personas; their orders of the earlier years are recommended by price, later ones are the truth.

_RECS = "with recs as (select o_custkey as persona, o_orderkey as track_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders), truth as (select o_custkey as persona, o_orderkey as track_id, cast(1 + o_orderkey % 3 as double) as gain from orders where o_orderkey % 2 = 0)"


def _lists(c: Catalog) -> tuple[DataFrame, DataFrame]:
    o = c.raw("orders").select(F.col("o_custkey").alias("persona"), F.col("o_orderkey").alias("track_id"), "o_totalprice")
    rank = F.row_number().over(W.partitionBy("persona").orderBy(F.desc("o_totalprice"), "track_id"))
    return o.withColumn("rank", rank).drop("o_totalprice"), o.where("track_id % 2 = 0").select("persona", "track_id", (1 + F.col("track_id") % 3).cast("double").alias("gain"))


_HITS = _RECS + ", h as (select persona, rank, gain, case when gain is not null then 1 else 0 end as hit from recs left join truth using (persona, track_id) where rank <= 10), n as (select persona, count(*) as relevant from truth group by 1)"


@query("ev_split", "with s as (select case when year(o_orderdate) < 1998 then 'profile' else 'held_out' end as part from orders) select part, count(*) as tracks from s group by 1", prefix=False)
def ev_split(c: Catalog) -> DataFrame:
    before, after = temporal_split(c.relation("tracks albums"), 1998)
    return before.agg(F.count("*").alias("tracks")).select(F.lit("profile").alias("part"), "tracks").unionByName(after.agg(F.count("*").alias("tracks")).select(F.lit("held_out").alias("part"), "tracks"))


@query("ev_precision", _HITS + " select persona, round(coalesce(sum(hit), 0) / 10.0, 6) as precision, round(coalesce(sum(hit), 0) / any_value(relevant), 6) as recall, case when sum(hit) > 0 then 1.0 else 0.0 end as hit_rate from n left join h using (persona) group by 1", prefix=False)
def ev_precision(c: Catalog) -> DataFrame:
    return ranking_metrics(*_lists(c), 10).select("persona", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "hit_rate")


@query("ev_ndcg", _HITS + ", i as (select persona, sum(gain / log2(k + 1)) as best from (select persona, gain, row_number() over (partition by persona order by gain desc, track_id) as k from truth) where k <= 10 group by 1) select persona, round(coalesce(sum(coalesce(gain, 0) / log2(rank + 1)), 0) / any_value(best), 6) as ndcg from i left join h using (persona) group by 1", prefix=False)
def ev_ndcg(c: Catalog) -> DataFrame:
    return ranking_metrics(*_lists(c), 10).select("persona", F.round("ndcg", 6).alias("ndcg"))


@query("ev_ap", _HITS + ", a as (select persona, hit * sum(hit) over (partition by persona order by rank) / rank as p from h) select persona, round(coalesce(sum(p), 0) / least(any_value(relevant), 10), 6) as ap from n left join a using (persona) group by 1", prefix=False)
def ev_ap(c: Catalog) -> DataFrame:
    return ranking_metrics(*_lists(c), 10).select("persona", F.round("ap", 6).alias("ap"))


@query("ev_coverage", _RECS + " select round(count(distinct case when rank <= 3 then track_id end) / count(distinct track_id), 6) as catalog_coverage, round(count(distinct case when rank <= 3 then persona end) / count(distinct persona), 6) as artist_coverage from recs", prefix=False)
def ev_coverage(c: Catalog) -> DataFrame:
    out = coverage(_lists(c)[0].where("rank <= 3"), c.tracks())
    return out.select(F.round("catalog_coverage", 6).alias("catalog_coverage"), F.round("artist_coverage", 6).alias("artist_coverage"))


@query("ev_ild", """with e as (select vec_id // 10 as persona, vec_id % 10 as rank, embedding::double[] as v from embeddings) select x.persona, round(avg(1 - list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))), 6) as diversity
    from e x join e y on x.persona = y.persona and x.rank < y.rank group by 1""", prefix=False)
def ev_ild(c: Catalog) -> DataFrame:
    e = c.raw("embeddings").select(F.col("vec_id").alias("track_id"), F.floor(F.col("vec_id") / 10).alias("persona"), (F.col("vec_id") % 10).alias("rank"), F.col("embedding").cast("array<double>").alias("vector"))
    return list_diversity(e.select("persona", "track_id", "rank"), e.select("track_id", "vector")).select("persona", F.round("diversity", 6).alias("diversity"))


@query("ev_novelty", "select artist_id as persona, round(avg(case when track_popularity > 0 then -log2(track_popularity / 100.0) else log2(100.0) end), 6) as novelty from tracks group by 1")
def ev_novelty(c: Catalog) -> DataFrame:
    recs = c.tracks().select(F.col("artist_id").alias("persona"), "track_id")
    return novelty(recs, c.tracks()).select("persona", F.round("novelty", 6).alias("novelty"))


_W = " + ".join(f"case when u >= {p!r} then 1 else 0 end" for p in _DRAWN)


@query(
    "ev_bootstrap",
    _HITS + f""", v as (select n.persona, coalesce(sum(hit), 0) / 10.0 as value from n left join h using (persona) group by 1),
    b as (select round, sum(value * ({_W})) / sum({_W}) as mean from (select value, round, ('0x' || substr(md5('42:' || persona || ':' || round), 1, 8))::bigint / 4294967296.0::double as u from v, range(200) r(round)) group by 1)
    select count(*) as n_valid, round(avg(value), 6) as macro_mean, round(stddev_pop(value), 6) as macro_std, round(median(value::double), 6) as macro_median, round(min(value), 6) as macro_min, round(max(value), 6) as macro_max,
        round((select quantile_cont(mean, 0.025) from b), 6) as ci_lower, round((select quantile_cont(mean, 0.975) from b), 6) as ci_upper from v""",
    prefix=False,
)
def ev_bootstrap(c: Catalog) -> DataFrame:
    """The mean precision of all personas with its interval after 200 rounds."""
    rows = ranking_metrics(*_lists(c), 10).select(F.lit("precision").alias("metric"), F.col("persona").alias("unit"), F.col("precision").alias("value"))
    return summary(rows, ["metric"], 200).select("n_valid", *[F.round(m, 6).alias(m) for m in ("macro_mean", "macro_std", "macro_median", "macro_min", "macro_max", "ci_lower", "ci_upper")])
