"""Distributions, correlations and rank statistics, each in a few aggregations."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order_stats import in_order, quantiles, running_total
from ..plans.staged import Steps
from ..schema import VECTOR
from ..sources.catalog import Catalog
from .labels import SKEW_SQL, skew_label
from .registry import query
from .windows import rounded

_LONG = "select * from (unpivot (select {} from audio_features) on {} into name feature value x)".format(", ".join(VECTOR), ", ".join(VECTOR))


def long_features(c: Catalog) -> DataFrame:
    return c.audio_features().unpivot([], list(VECTOR), "feature", "x")


def adjusted_skewness(n: Column, g: Column) -> Column:
    """Of a sample, from the population value; null below three rows."""
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(n: Column, g: Column) -> Column:
    """Excess of a sample, from the population value; null below four rows."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: size, mean, deviation, quartiles, ends, skewness with its description, kurtosis, interval of the mean, the inner
    fences, and how many values lie beyond 1.5 and 3 interquartile ranges, in numbers and per cent. Rows are written once;
    quartiles are exact and hold no group."""
    steps = Steps(rows.sparkSession, "distribution")
    rows = steps.write(rows.select(by, F.col(value).cast("double").alias(value), in_order(F.col(value)).alias("_order")))
    x, n = F.col(value), F.col("n")
    stats = rows.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"))
    stats = steps.write(stats.join(quantiles(rows, [by], value, "_order", [0.25, 0.5, 0.75], steps), by).withColumn("iqr", F.col("q")[2] - F.col("q")[0]))
    fences = stats.select(F.col(by).alias("_by"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "iqr")
    beyond = lambda k: F.count_if((x < F.col("q1") - k * F.col("iqr")) | (x > F.col("q3") + k * F.col("iqr")))
    out = rows.join(fences, F.col(by) == F.col("_by")).groupBy("_by").agg(beyond(1.5).alias("outliers"), beyond(3.0).alias("far_outliers"))
    half = 1.96 * F.col("std") / F.sqrt("n")
    return stats.join(out, F.col(by) == F.col("_by")).select(
        by,
        "n",
        rounded(F.col("mean"), 4).alias("mean"),
        rounded(F.col("std"), 4).alias("std"),
        F.round("low", 4).alias("low"),
        *[rounded(F.col("q")[k], 4).alias(f"p{p}") for k, p in enumerate((25, 50, 75))],
        F.round("high", 4).alias("high"),
        rounded(F.col("iqr"), 4).alias("iqr"),
        rounded(adjusted_skewness(n, F.col("s")), 3).alias("skewness"),
        rounded(adjusted_kurtosis(n, F.col("k")), 3).alias("kurtosis"),
        rounded(F.col("mean") - half, 4).alias("ci_low"),
        rounded(F.col("mean") + half, 4).alias("ci_high"),
        "outliers",
        "far_outliers",
        rounded(F.col("outliers") * 100.0 / n, 2).alias("outlier_pct"),
        rounded(F.col("far_outliers") * 100.0 / n, 2).alias("far_outlier_pct"),
        rounded(F.col("q")[0] - 1.5 * F.col("iqr"), 4).alias("lower_fence"),
        rounded(F.col("q")[2] + 1.5 * F.col("iqr"), 4).alias("upper_fence"),
        skew_label(adjusted_skewness(n, F.col("s"))).alias("skew_description"),
    )


@query(
    "st_distribution",
    f"""with x as ({_LONG}), s as (select feature, count(x) as n, avg(x) as mean, stddev_samp(x) as std, min(x) as low, max(x) as high, quantile_cont(cast(x as double), 0.25) as q1, quantile_cont(cast(x as double), 0.5) as q2,
        quantile_cont(cast(x as double), 0.75) as q3, skewness(x) as s, kurtosis(x) as k from x group by 1),
    o as (select feature, count(case when x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) then 1 end) as outliers, count(case when x < q1 - 3 * (q3 - q1) or x > q3 + 3 * (q3 - q1) then 1 end) as far_outliers from x join s using (feature) group by 1)
    select feature, n, round(mean * 1.000000000001, 4) as mean, round(std * 1.000000000001, 4) as std, round(low, 4) as low, round(q1 * 1.000000000001, 4) as p25, round(q2 * 1.000000000001, 4) as p50, round(q3 * 1.000000000001, 4) as p75, round(high, 4) as high,
        round((q3 - q1) * 1.000000000001, 4) as iqr, round(s * 1.000000000001, 3) as skewness, round(k * 1.000000000001, 3) as kurtosis,
        round((mean - 1.96 * std / sqrt(n)) * 1.000000000001, 4) as ci_low, round((mean + 1.96 * std / sqrt(n)) * 1.000000000001, 4) as ci_high, outliers, far_outliers,
        round(outliers * 100.0 / n * 1.000000000001, 2) as outlier_pct, round(far_outliers * 100.0 / n * 1.000000000001, 2) as far_outlier_pct, round((q1 - 1.5 * (q3 - q1)) * 1.000000000001, 4) as lower_fence, round((q3 + 1.5 * (q3 - q1)) * 1.000000000001, 4) as upper_fence,
        """ + SKEW_SQL + """ as skew_description from s join o using (feature)""",
)
def st_distribution(c: Catalog) -> DataFrame:
    return distribution(long_features(c), "feature", "x")


@query(
    "st_fences",
    f"""with x as ({_LONG}), s as (select feature, quantile_cont(cast(x as double), 0.25) as q1, quantile_cont(cast(x as double), 0.75) as q3 from x group by 1)
    select feature, count(case when x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) then 1 end) as outliers,
        round(count(case when x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) then 1 end) * 100.0 / count(*) * 1.000000000001, 2) as pct from x join s using (feature) group by 1""",
)
def st_fences(c: Catalog) -> DataFrame:
    out = distribution(long_features(c), "feature", "x")
    return out.select("feature", "outliers", rounded(F.col("outliers") * 100.0 / F.col("n"), 2).alias("pct"))


_COLUMNS = ("track_popularity", *VECTOR)
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


@query("st_pearson_matrix", "with x as (select * from tracks join audio_features using (track_id)) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from x" for a, b in _PAIRS))
def st_pearson_matrix(c: Catalog) -> DataFrame:
    """All pairs in one aggregation over one scan."""
    one = c.relation("tracks audio_features").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS])
    long = one.unpivot([], [f"{a}|{b}" for a, b in _PAIRS], "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), F.round("r", 6).alias("r"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): the average rank of each different value. Only counts of different values are ordered, in parts."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_t"))
    counts = running_total(counts, [value], "_t", "_up_to", Steps(rows.sparkSession, "ranks"))
    return counts.select(F.col(value).alias(f"_{value}"), (F.col("_up_to") + (F.col("_t") + 1) / 2).alias(name), F.col("_t").alias(f"{name}_ties"))


@query(
    "st_spearman",
    """with x as (select track_popularity as a, energy as b from tracks join audio_features using (track_id)),
    r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from x)
    select 'energy' as feature, round(corr(ra, rb), 6) as rho, count(*) as n from r""",
)
def st_spearman(c: Catalog) -> DataFrame:
    rows = c.relation("tracks audio_features").select("track_popularity", "energy")
    for column, name in (("track_popularity", "ra"), ("energy", "rb")):
        ranks = average_ranks(rows, column, name)
        rows = rows.join(ranks, F.col(column) == F.col(f"_{column}"))
    return rows.agg(F.round(F.corr("ra", "rb"), 6).alias("rho"), F.count("*").alias("n")).select(F.lit("energy").alias("feature"), "rho", "n")


_GROUPED = "with x as (select genre_name as g, track_popularity as v from playlist_tracks join genres using (genre_id) join tracks using (track_id))"


def variance_parts(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups k, rows n, sums of squares between and within groups."""
    per = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    return one.withColumn("between", F.col("squares") - F.col("n") * F.col("grand") * F.col("grand"))


@query(
    "st_anova",
    _GROUPED + """, p as (select g, count(*) as n, avg(v) as m, var_pop(v) as s from x group by 1), o as (select count(*) as k, sum(n) as n, sum(n * m) / sum(n) as grand from p)
    select cast(any_value(o.k) as bigint) as groups, cast(any_value(o.n) as bigint) as n, round(sum(p.n * (m - grand) * (m - grand)) / (any_value(o.k) - 1) / nullif(sum(p.n * s) / (any_value(o.n) - any_value(o.k)), 0), 4) as f from p cross join o""",
)
def st_anova(c: Catalog) -> DataFrame:
    """The quotient is null where groups don't vary inside."""
    one = variance_parts(c.relation("playlist_tracks genres tracks"), "genre_name", "track_popularity")
    f = (F.col("between") / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0))
    return one.select(F.col("k").alias("groups"), "n", F.round(f, 4).alias("f"))


@query(
    "st_eta2",
    _GROUPED + """, p as (select g, count(*) as n, avg(v) as m, var_pop(v) as s from x group by 1), o as (select sum(n * m) / sum(n) as grand from p),
    e as (select sum(n * (m - grand) * (m - grand)) as b, sum(n * s) as w from p cross join o) select round(b / (b + w), 6) as eta2, case when b / (b + w) >= 0.14 then 'large' when b / (b + w) >= 0.06 then 'medium' when b / (b + w) >= 0.01 then 'small' else 'negligible' end as effect from e""",
)
def st_eta2(c: Catalog) -> DataFrame:
    one = variance_parts(c.relation("playlist_tracks genres tracks"), "genre_name", "track_popularity")
    e = F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0))
    label = F.when(e >= 0.14, "large").when(e >= 0.06, "medium").when(e >= 0.01, "small").otherwise("negligible")
    return one.select(F.round(e, 6).alias("eta2"), label.alias("effect"))


@query(
    "st_kruskal",
    _GROUPED + """, r as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from x), n as (select count(*) as n from x), t as (select sum(c * c * c - c) as t from (select count(*)::double as c from x group by v)),
    s as (select sum(q) as q from (select sum(r) * sum(r) / count(*) as q from r group by g)) select round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n::double * n * n - n)), 4) as h from n, t, s""",
)
def st_kruskal(c: Catalog) -> DataFrame:
    rows = c.relation("playlist_tracks genres tracks").select("genre_name", "track_popularity")
    ranks = average_ranks(rows, "track_popularity", "r")
    ranked = rows.join(ranks, F.col("track_popularity") == F.col("_track_popularity"))
    sums = ranked.groupBy("genre_name").agg(F.sum("r").alias("s"), F.count("*").cast("double").alias("m")).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.sum("m").alias("n"))
    t = F.col("r_ties").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("t"))
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("t") / (n * n * n - n), F.lit(0.0))
    return sums.crossJoin(F.broadcast(ties)).select(F.round(h, 4).alias("h"))  # one row each


# p-values, on the driver for the few rows of a result.


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz steps)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front, tiny = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a, 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def gamma_tail(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = f = 1 / b
    for k in range(1, 1000):
        b += 2
        d = 1 / (b - k * (k - a) * d)
        c = b - k * (k - a) / c
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def p_anova(f: float | None, groups: int, n: int) -> float:
    """Of an F value; groups without inner variance (null) differ for sure."""
    return 0.0 if f is None else beta_tail((n - groups) / (n - groups + (groups - 1) * f), (n - groups) / 2, (groups - 1) / 2)


def p_kruskal(h: float, groups: int) -> float:
    return gamma_tail((groups - 1) / 2, h / 2)


def p_correlation(r: float, n: int) -> float:
    """Two-sided, of Pearson's or Spearman's coefficient."""
    return 0.0 if abs(r) >= 1 else beta_tail(1 - r * r, (n - 2) / 2, 0.5)
