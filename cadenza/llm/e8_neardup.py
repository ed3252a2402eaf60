"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points in several tables, with the nearest
neighbouring cells probed, and every candidate's cosine checked in double precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .grouping import bounds, pairs, spanning, whole_groups

#: Rows of one cell that are compared at once; a larger cell is compared in pairs of such blocks.
BLOCK = 1024
#: Rows that a task holds before it compares them.
HELD = 8192


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of plus or minus one, or eight halves with evenly many minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for k in range(256):
        signs = np.array([1 - 2 * (k >> i & 1) for i in range(8)])
        if signs.prod() > 0:
            out.append(signs / 2)
    return np.array(out)


ROOTS = _roots()


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the two nearest points with whole and with half coordinates of even sum."""

    def even(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        odd = np.flatnonzero(z.sum(1) % 2)
        rest = (y - z)[odd]
        worst = np.abs(rest).argmax(1)
        z[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
        return z

    whole, half = even(x), even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


@dataclass(frozen=True)
class Lattice:
    """tables: how many; blocks: E8 points of a cell's key (8 dimensions each); scale: a lattice step in projected space
    relative to the distance of two unit vectors at the threshold; probes: neighbouring cells of each table that a vector visits."""

    threshold: float = 0.95
    tables: int = 10
    blocks: int = 2
    scale: float = 0.9
    probes: int = 3
    seed: int = 11

    def projections(self, dim: int) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        width = 8 * self.blocks
        # Noise of two vectors at the threshold has unit length in eight projected dimensions.
        size = np.sqrt(2 - 2 * self.threshold) * np.sqrt(8 / dim) * self.scale * 2
        return np.stack([np.linalg.qr(rng.normal(size=(max(dim, width), width)))[0][:dim] / size for _ in range(self.tables)])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables x (1 + probes) keys of 64 bits: the own cell first, then the neighbours that lie nearest."""
        n, dim = unit.shape
        out = np.zeros((n, self.tables, 1 + self.probes), np.int64)
        mult = np.random.default_rng(self.seed + 1).integers(1, 2**63, (self.blocks, 8), np.int64) | 1
        with np.errstate(over="ignore"):
            for t, matrix in enumerate(self.projections(dim)):
                y = (unit @ matrix).reshape(n, self.blocks, 8)
                key, gain, move = np.full(n, t, np.int64) * np.int64(0x9E3779B97F4A7C1), [], []
                for b in range(self.blocks):
                    point = nearest(y[:, b])
                    key = key + ((2 * point).astype(np.int64) * mult[b]).sum(1)
                    gain.append((y[:, b] - point) @ ROOTS.T)
                    move.append(((2 * ROOTS).astype(np.int64) * mult[b]).sum(1))
                gain, move = np.concatenate(gain, 1), np.concatenate(move)
                best = np.argpartition(-gain, self.probes, 1)[:, : self.probes] if self.probes else np.zeros((n, 0), int)
                out[:, t, 0] = key
                out[:, t, 1:] = key[:, None] + move[best]
        return out


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs with the keys a and b (pairs x tables x 1 + probes) the first table and the smallest cell where they meet."""
    big = np.iinfo(np.int64).max
    one = np.where((a == b[:, :, :1]).any(2), b[:, :, 0], big)
    two = np.where((b == a[:, :, :1]).any(2), a[:, :, 0], big)
    cell = np.minimum(one, two)
    met = (one != big) | (two != big)
    t = met.argmax(1)
    return t, cell[np.arange(len(t)), t]


def links(vectors: DataFrame, lattice: Lattice, staged: common.Staged) -> DataFrame:
    """From distinct vectors (id long, n long, embedding): rows (id, n) with how many vectors are linked, counting n for each,
    where other is null; and rows (id, other) with links that give the same components.

    Cells are staged without the vectors. Those that one vector visits alone are left out, and only then a vector follows, once
    for each block of a cell that it is compared in."""
    keys = staged.write(vectors.select("id", "embedding").mapInArrow(_keyed(lattice), "id long, t int, cell long, home boolean"), "cells")
    size = keys.groupBy("t", "cell").agg(F.count("*").alias("_m"), F.max("home").alias("_home")).where((F.col("_m") > 1) & F.col("_home"))
    size = size.select(F.col("t").alias("_t"), F.col("cell").alias("_cell"), F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    shared = keys.join(size, (F.col("t") == F.col("_t")) & (F.col("cell") == F.col("_cell"))).drop("_t", "_cell")
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    shared = shared.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    shared = shared.withColumn("low", F.least("b", "o")).withColumn("high", F.greatest("b", "o")).drop("o", "_blocks")
    shared = shared.join(vectors.select(F.col("id").alias("_id"), "n", "embedding"), F.col("id") == F.col("_id")).drop("_id")
    order = ["t", "cell", "low", "high"]
    spread = shared.repartition(common.partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return spread.mapInArrow(_compared(lattice), "id long, n long, other long")


def _keyed(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = lattice.cells(_unit(b.column("embedding")))
            n, tables, many = cells.shape
            row = pa.array(np.repeat(np.arange(n), tables * many))
            t = np.tile(np.repeat(np.arange(tables), many), n)
            home = np.tile(np.arange(many) == 0, n * tables)
            # A neighbour that is the own cell again can't be; equal neighbours can't be either.
            yield pa.RecordBatch.from_arrays([b.column("id").take(row), pa.array(t, pa.int32()), pa.array(cells.ravel()), pa.array(home)], names=["id", "t", "cell", "home"])

    return run


def _compared(lattice: Lattice):
    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: rows.column(c).to_numpy()
        unit = _unit(rows.column("embedding").chunk(0))
        ids, n, t, cell, home, block, low, high = (get(c) for c in ("id", "n", "t", "cell", "home", "b", "low", "high"))
        us, vs = [], []
        for i, j in pairs(bounds([t, cell, low, high])):
            # In a pair of different blocks only rows of different blocks meet; one of the two must be at home here.
            ok = (home[i] | home[j]) & ((low[i] == high[i]) | (block[i] != block[j])) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= lattice.threshold
            us.append(i[near])
            vs.append(j[near])
        u, v = np.concatenate([np.zeros(0, int), *us]), np.concatenate([np.zeros(0, int), *vs])
        if not len(u):
            return
        rows_, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        cells = lattice.cells(unit[rows_])
        a, b = place[: len(u)], place[len(u) :]
        first = []
        for k in range(0, len(u), 50_000):
            tt, cc = _meeting(cells[a[k : k + 50_000]], cells[b[k : k + 50_000]])
            first.append((tt == t[u[k : k + 50_000]]) & (cc == cell[u[k : k + 50_000]]))
        ok = np.concatenate(first)
        u, v = u[ok], v[ok]
        if not len(u):
            return
        who, at = np.unique(np.concatenate([ids[u], ids[v]]), return_inverse=True)
        count = np.bincount(at, np.concatenate([n[v], n[u]])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(count), pa.nulls(len(who), pa.int64())], names=["id", "n", "other"])
        x, y = spanning(ids[u], ids[v])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.zeros(len(x), np.int64)), pa.array(y)], names=["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("t", "cell", "low", "high"), HELD):
            yield from compare(rows)

    return run


def near_duplicates(vectors: DataFrame, lattice: Lattice | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id (smallest linked id), kept (id = component_id).

    Equal vectors are one class whose size counts; classes are compared in the cells they share. Null or zero vectors, and
    those with null or non-finite parts, link with nothing. Vectors of different lengths are never compared with another. Ids
    are taken to be distinct; an empty table gives no rows; other columns aren't read.
    """
    lattice = lattice or Lattice()
    spark = vectors.sparkSession
    staged = common.Staged(spark, "e8")
    e = F.col("embedding")
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"  # wider input stays wide
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast(kind).alias("embedding"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    key = [F.when(fine, F.xxhash64(F.lit(k), e)).alias(f"h{k}") for k in (1, 2)]
    rows = staged.write(rows.select("id", F.when(fine, e).alias("embedding"), *key, F.size(e).alias("dim")), "rows")
    classes = rows.where("embedding is not null").groupBy("h1", "h2", "dim").agg(F.min("id").alias("class"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = staged.write(classes, "classes")
    found = []
    for (dim,) in classes.select("dim").distinct().collect():  # one run for each length of vectors
        found.append(links(classes.where(F.col("dim") == dim).select(F.col("class").alias("id"), "n", "embedding"), lattice, staged))
    found = found or [spark.createDataFrame([], "id long, n long, other long")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = staged.write(out, "links")
    groups = components(out.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    degree = out.where("other is null").groupBy("id").agg(F.sum("n").alias("linked"))
    by_class = classes.join(degree, classes["class"] == degree["id"], "left").drop("id").join(groups, F.col("class") == F.col("node"), "left")
    by_class = by_class.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("dim").alias("_dim"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    alone = rows.where("embedding is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = rows.where("embedding is not null").join(by_class, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("dim") == F.col("_dim"))).select("id", "n_links", "component_id")
    result = joined.unionByName(alone)
    return staged.keep(result.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col))


def op5_e8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all embeddings."""
    common.bounded_batches(spark)
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
