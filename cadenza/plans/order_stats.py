"""Order statistics of whole groups, however large: places, running totals, exact quantiles. No task holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staged import Steps

#: Rows that are put in order in one part.
ONE_PART = 20_000
#: Bits by which a round of quantiles narrows a value down.
NARROW = 16


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right, whose keys are called _k0, _k1, ...; null keys are equal. Without keys right is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)])
    return left.join(right, on).drop(*[f"_k{i}" for i in range(len(keys))])


def _keyed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def positions(rows: DataFrame, groups: list[str], keys: list[str], steps: Steps, at: str = "position", of: str = "size") -> DataFrame:
    """rows with their place from 0 in their group's order of keys, and the group's size. Rows with equal keys follow each other in
    any order.

    The table is dealt out by ranges of groups and keys, so that a part is cut wherever it is full; rows are counted inside of
    parts and moved up by the parts before.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *groups, *keys).sortWithinPartitions(*groups, *keys)
    dealt = steps.write(dealt.withColumn("_id", F.monotonically_increasing_id()))  # the part's number and the row's, once written
    part = F.shiftright("_id", 33)
    before = F.coalesce(F.sum("_n").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy(part.alias("_of")).agg(F.count("*").alias("_n")).select("_of", before.alias("_before"))  # a row a part
    placed = dealt.join(F.broadcast(starts), part == F.col("_of")).withColumn("_at", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_of", "_before")
    first = placed.groupBy(*_keyed(groups)).agg(F.min("_at").alias("_first"), F.count("*").alias(of))
    return _same(placed, first, groups).withColumn(at, F.col("_at") - F.col("_first")).drop("_at", "_first")


def running_total(rows: DataFrame, keys: list[str], value: str, name: str, steps: Steps, groups: list[str] | None = None) -> DataFrame:
    """rows with the total of value over the rows of their group that come before in the keys' order; keys differ in a group.
    Totals are made inside of parts, cut anywhere in a group, and moved up by the totals of the group's parts before."""
    groups = groups or []
    rows = steps.write(rows)
    if rows.count() <= ONE_PART:
        rows = rows.withColumn("_part", F.lit(0))
    else:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = steps.write(rows.repartitionByRange(parts, *groups, *keys).withColumn("_part", F.spark_partition_id()))
    by = [*groups, "_part"]
    sums = rows.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _same(rows.withColumn("_in", inside), sums.select(*_keyed(by), before.alias("_before")), by).withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def in_order(value: Column) -> Column:
    """A long that is ordered as the doubles are: their bits, those of negative ones turned over. Both zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))


def quantiles(rows: DataFrame, groups: list[str], value: str, order: str, ps: list[float], steps: Steps, name: str = "q") -> DataFrame:
    """(groups, name: array) of each group's exact quantiles, interpolated between neighbours; groups without values have no row.

    rows: groups, value (double), order (in_order() of it), written before, since every round reads them. A round counts the
    next bits of the values that share the bits found so far with a wanted rank, at most 2^16 counts for each; after at most
    four rounds the rank's value is known, mostly sooner, when all values that are left are equal.
    """
    rows = rows.select(*groups, value, order).where(F.col(value).isNotNull())
    x, key = F.col(value), F.col(order)
    shift = 64 - NARROW
    counted = lambda df, extra: df.groupBy(*groups, *extra, F.shiftright(key, shift).alias("_bits")).agg(F.count("*").alias("_n"), F.min(x).alias("_low"), F.max(x).alias("_high"))  # noqa: B023, E731
    counts = steps.write(counted(rows, []))
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    place = lambda p: F.lit(float(p)) * (F.col("_size") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("end"), (F.ceil(place(p)) if e else F.floor(place(p))).cast("long").alias("rank")) for i, p in enumerate(ps) for e in (0, 1)])
    wanted = sizes.select(*groups, "_size", F.explode(ranks).alias("_r")).select(*groups, "_size", "_r.*")
    found, parts = None, list(groups)
    while True:
        before = F.sum("_n").over(W.partitionBy(*parts).orderBy("_bits")) - F.col("_n")  # of some 2^16 counts at most
        cut = counts.select(*_keyed(parts), "_bits", "_n", "_low", "_high", before.alias("_before"))
        met = _same(wanted.withColumnRenamed("_bits", "_prefix") if "_bits" in wanted.columns else wanted, cut, ["_prefix" if k == "_prefix" else k for k in parts])
        met = met.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
        met = met.select(*groups, "_size", "i", "end", (F.col("rank") - F.col("_before")).alias("rank"), "_bits", "_low", "_high")
        met = steps.write(met) if shift else met  # read once in the last round
        sure = met.where((F.col("_low") == F.col("_high")) | F.lit(shift == 0)).select(*groups, "_size", "i", "end", F.col("_low").alias("v"))
        found = sure if found is None else found.unionByName(sure)
        wanted = met.where(F.col("_low") != F.col("_high")).drop("_low", "_high")
        if shift == 0 or wanted.isEmpty():
            break
        open_ = wanted.select(*_keyed(groups), F.col("_bits").alias("_prefix")).distinct()
        last, shift = shift, shift - NARROW
        on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(open_[f"_k{i}"]) for i, k in enumerate(groups)] + [F.shiftright(key, last) == open_["_prefix"]])
        counts = steps.write(counted(rows.join(open_, on).drop(*[f"_k{i}" for i in range(len(groups))]), ["_prefix"]))
        parts = [*groups, "_prefix"]
    share = lambda i: place(ps[i]) - F.floor(place(ps[i]))
    end = lambda i, e: F.max(F.when((F.col("i") == i) & (F.col("end") == e), F.col("v")))
    ends = found.groupBy(*groups, "_size").agg(*[end(i, e).alias(f"_v{i}{e}") for i in range(len(ps)) for e in (0, 1)])
    return ends.select(*groups, F.array(*[F.col(f"_v{i}0") + (F.col(f"_v{i}1") - F.col(f"_v{i}0")) * share(i) for i in range(len(ps))]).alias(name))
