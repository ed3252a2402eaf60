"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. MinHash bands bring candidates together; their MinHash values are compared a few
at a time, and a pair is dropped once the posterior probability that it reaches the threshold falls below a tolerance; the
rest is verified on the shingle sets themselves. Documents with equal sets are one class. Pairs are counted where they meet
and never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .grouping import bounds, pairs, spanning, whole_groups
from .pieces import _LOWER, _MASKS, PAD, WORDS, passes, text_bytes

#: Documents that are compared at once; larger groups are compared in pairs of such blocks.
BLOCK = 1024
#: Bytes of the bit sets that verify a group at once.
BITSET_BYTES = 32 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Join:
    threshold: float = 0.8
    words: int = 5
    bands: int = 20
    rows: int = 5
    chunk: int = 10
    tolerance: float = 1e-4
    seed: int = 5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def needed(self) -> list[int]:
        """After each chunk of MinHash values, the fewest equal ones that keep a pair."""
        return _needed(self.threshold, self.hashes, self.chunk, self.tolerance)

    def candidates(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of signatures a[i], b[j] are still possible after all values; each chunk looks at what is left."""
        left, equal = np.arange(len(i)), np.zeros(len(i), np.int32)
        for k, least in enumerate(self.needed()):
            part = slice(k * self.chunk, (k + 1) * self.chunk)
            equal = equal + (a[i[left], part] == b[j[left], part]).sum(1)
            ok = equal >= least
            left, equal = left[ok], equal[ok]
        return left


@cache
def _needed(threshold: float, hashes: int, chunk: int, tolerance: float) -> list[int]:
    """With a uniform prior, the similarity after m equal of n values has a Beta(m + 1, n - m + 1) distribution; its upper
    tail at the threshold is a sum of binomial terms."""
    out = []
    for n in range(chunk, hashes + 1, chunk):
        term = lambda k: exp(lgamma(n + 2) - lgamma(k + 1) - lgamma(n + 2 - k) + k * log(threshold) + (n + 1 - k) * log(1 - threshold))  # noqa: B023, E731
        tail, least = 0.0, 0
        for m in range(n + 1):
            tail += term(m)
            if tail >= tolerance:
                least = m
                break
        out.append(least)
    return out


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending, one text after another; and where each text's begin.

    Words are runs without white space, ASCII letters regardless of case. A text of fewer words is one shingle of all its
    words; a text without words has none.
    """
    n = int(offsets[-1])
    buf = np.append(_LOWER[buf[:n]], np.zeros(PAD, np.uint8))
    inside, edge = ~_SPACE[buf[:n]], np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1]) if n else inside
    after = np.append(inside[1:] & ~edge[1:n], False) if n else inside
    starts, ends = np.flatnonzero(inside & (~before | edge[:n])), np.flatnonzero(inside & ~after) + 1
    length = ends - starts
    load, bounded = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,)), np.minimum(length, 8 * WORDS)
    hashed = length.astype(np.uint64)
    for k in range(WORDS):
        hashed = (hashed ^ (load[np.minimum(starts + 8 * k, len(load) - 1)] & _MASKS[k][bounded])) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    for k in np.flatnonzero(length > 8 * WORDS).tolist():
        hashed[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]].tobytes())
    at = np.searchsorted(starts, offsets)
    size = np.diff(at)
    # Each text gets words - 1 empty places, so that no window runs into the next text.
    count = np.where(size >= words, size - words + 1, (size > 0).astype(np.int64))
    first = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = np.repeat(at[1:], count)
    mixed = np.zeros(len(first), np.uint64)
    for k in range(words):
        word = np.where(first + k < last, hashed[np.minimum(first + k, max(0, len(hashed) - 1))] if len(hashed) else np.zeros(len(first), np.uint64), np.uint64(0))
        mixed = (mixed ^ word) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    ends_ = np.cumsum(count)
    parts = [np.unique(mixed[a:b]) for a, b in zip((ends_ - count).tolist(), ends_.tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)


def _each(column: pa.Array, words: int):
    buf, offsets = text_bytes(column)
    for a, b in passes(offsets):
        yield a, b, *shingles(np.append(buf[offsets[a] : offsets[b]], np.zeros(PAD, np.uint8)), offsets[a : b + 1] - offsets[a], words)


def signatures(docs: DataFrame, join: Join, id_col: str, text_col: str) -> DataFrame:
    """(id, version, h1, h2, size, sig, keys): the text's hash, a digest of its shingle set, the set's size, MinHash values of
    16 bits, band keys."""
    rng = np.random.default_rng(join.seed)
    factors = rng.integers(1, 2**63, join.hashes, np.int64).astype(np.uint64) | np.uint64(1)
    adds = rng.integers(0, 2**63, join.hashes, np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, at in _each(batch.column(1), join.words):
                n = b - a
                size = np.diff(at)
                some = np.flatnonzero(size)
                sig = np.zeros((n, join.hashes), np.uint16)
                h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(some):
                    for k in range(join.hashes):
                        value = sets * factors[k] + adds[k]
                        value ^= value >> np.uint64(31)
                        value *= np.uint64(0x9E3779B97F4A7C15)
                        sig[some, k] = np.minimum.reduceat(value, at[some]) >> np.uint64(16) & np.uint64(0xFFFF)
                    h1[some] = np.add.reduceat(sets, at[some])
                    h2[some] = np.add.reduceat((sets ^ (sets >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F), at[some])
                banded = sig.reshape(n, join.bands, join.rows).astype(np.uint64)
                keys = np.broadcast_to(np.arange(join.bands, dtype=np.uint64), (n, join.bands)).copy()
                for k in range(join.rows):
                    keys = (keys ^ banded[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * join.bands, pa.int32()), pa.array(keys.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), pa.array(size), pa.array([x.tobytes() for x in sig], pa.binary()), lists], names=["id", "version", "h1", "h2", "size", "sig", "keys"])

    thin = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("version"))
    return thin.mapInArrow(run, "id long, version long, h1 long, h2 long, size long, sig binary, keys array<long>")


def _blocks(df: DataFrame, key: list[str], counts: DataFrame) -> DataFrame:
    """Rows with their group's block pairs (low, high), each row in as many as its group has blocks; b is the row's own block."""
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in key], F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    on = [df[k] == counts[f"_{k}"] for k in key]
    out = df.join(counts, on).withColumn("b", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    out = out.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumns({"low": F.least("b", "o"), "high": F.greatest("b", "o")}).drop("o", "_blocks", *[f"_{k}" for k in key])
    order = [*key, "low", "high"]
    return out.repartition(common.partitions(df.sparkSession), *order).sortWithinPartitions(*order)


def _signature(table: pa.Table, hashes: int) -> np.ndarray:
    column = table.column("sig").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hashes)


def _possible(join: Join):
    """Links that span the pairs of one band's bucket that pass all MinHash values."""
    key = ("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, key, 8192):
            sig = _signature(rows, join.hashes)
            ids, block, *group = (rows.column(c).to_numpy() for c in ("id", "b", *key))
            us, vs = [], []
            for i, j in pairs(bounds(group)):
                ok = (group[1][i] == group[2][i]) | (block[i] != block[j])
                i, j = i[ok], j[ok]
                left = join.candidates(sig, sig, i, j)
                us.append(ids[i[left]])
                vs.append(ids[j[left]])
                if sum(map(len, us)) > 500_000:  # only what still spans them is kept
                    x, y = spanning(np.concatenate(us), np.concatenate(vs))
                    us, vs = [x], [y]
            x, y = spanning(np.concatenate([np.zeros(0, np.int64), *us]), np.concatenate([np.zeros(0, np.int64), *vs]))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])

    return run


def _overlap(sets: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes the sets of i and j share, by bit sets over the hashes that two or more sets have."""
    size = np.diff(at)
    order = np.argsort(sets, kind="stable")
    ranked = sets[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    group = np.cumsum(new) - 1
    shared = np.bincount(group) > 1
    label = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(size)), size)[order]
    keep = shared[group]
    column, owner = label[group[keep]], owner[keep]
    total, width = np.zeros(len(i), np.int64), max(64, BITSET_BYTES // max(1, len(size)) * 8 // 64 * 64)
    for low in range(0, int(shared.sum()), width):
        here = (column >= low) & (column < low + width)
        used = min(width, int(shared.sum()) - low)
        bits = np.zeros((len(size), -(-used // 64)), np.uint64)
        np.bitwise_or.at(bits, (owner[here], (column[here] - low) // 64), np.uint64(1) << ((column[here] - low) % 64).astype(np.uint64))
        step = max(1, (8 << 20) // (8 * bits.shape[1]))
        for k in range(0, len(i), step):
            total[k : k + step] += np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype=np.int64)
    return total


def _verified(join: Join):
    """(id, n, null): how many documents are linked with id here; (id, 0, other): links that span the same."""
    key = ("group", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, key, 2048):
            sig = _signature(rows, join.hashes)
            ids, n, block, *group = (rows.column(c).to_numpy() for c in ("id", "n", "b", *key))
            sets, ats = [], [np.zeros(1, np.int64)]
            for _, _, s, at in _each(rows.column("text"), join.words):
                sets.append(s)
                ats.append(at[1:] + ats[-1][-1])
            sets, at = np.concatenate(sets), np.concatenate(ats)
            size = np.diff(at)
            begins = bounds(group)
            for a, z in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                us, vs, degree = [], [], np.zeros(z - a, np.int64)
                for i, j in pairs(np.array([0, z - a])):
                    ok = (group[1][a] == group[2][a]) | (block[a + i] != block[a + j])
                    i, j = i[ok], j[ok]
                    left = join.candidates(sig[a:z], sig[a:z], i, j)
                    i, j = i[left], j[left]
                    both = _overlap(sets[at[a] : at[z]], at[a : z + 1] - at[a], i, j)
                    # In whole numbers: shared >= threshold * (all of both).
                    near = both * 1_000_000 >= round(join.threshold * 1_000_000) * (size[a + i] + size[a + j] - both)
                    i, j = i[near], j[near]
                    degree += np.bincount(i, n[a + j], minlength=z - a).astype(np.int64) + np.bincount(j, n[a + i], minlength=z - a).astype(np.int64)
                    if len(i):
                        x, y = spanning(ids[a + i], ids[a + j])
                        us.append(x)
                        vs.append(y)
                some = np.flatnonzero(degree)
                if len(some):
                    x, y = spanning(np.concatenate(us), np.concatenate(vs))
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[a:z][some], x)), pa.array(np.append(degree[some], np.zeros(len(x), np.int64))), pa.array([None] * len(some) + y.tolist(), pa.int64())], names=["id", "n", "other"])

    return run


def jaccard_join(docs: DataFrame, join: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, version (the text's hash), n_links (other rows whose shingle sets have Jaccard similarity >= threshold),
    class_id (smallest id that links lead to), kept (false for all but one document of those that links join).

    Texts without words (null, empty, white space) link with nothing and are kept. Kept is the document with the smallest id,
    null ids last; of equal ids with different texts one, by their hash. Rows that repeat both id and text are one document: each
    counts as a link, and they are kept or not alike. Texts are read whole. An empty table gives no rows; other columns aren't
    read, whatever their names. A pair is missed if it shares none of the bands (about 4 in 10,000 at a similarity of 0.8) or
    its MinHash values fall below the tolerance.
    """
    join = join or Join()
    spark = docs.sparkSession
    staged = common.Staged(spark, "jaccard")
    # Texts with one digest and size are one class; its number is a hash of both.
    rows = signatures(docs, join, id_col, text_col).withColumn("class", F.xxhash64("h1", "h2", "size"))
    rows = staged.write(rows, "signatures")
    unique = rows.where("size > 0").groupBy(F.col("class").alias("id")).agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first(F.struct("sig", "keys")).alias("s"))
    unique = staged.write(unique.select("id", "first", "n", "s.sig", "s.keys"), "unique")

    # Signatures follow only the documents that share a bucket with another.
    banded = unique.select("id", F.explode("keys").alias("key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").select(F.col("key").alias("_key"), "_m")
    shared = staged.write(banded.join(counts, F.col("key") == F.col("_key")).select("id", "key", "_m"), "shared")
    counts = shared.select("key", "_m").distinct()
    signed = shared.select("id", "key").join(unique.select(F.col("id").alias("_id"), "sig"), F.col("id") == F.col("_id")).drop("_id")
    spans = _blocks(signed, ["key"], counts).mapInArrow(_possible(join), "u long, v long")
    group = components(spans.distinct()).select(F.col("node").alias("_node"), F.col("component").alias("group"))
    members = staged.write(unique.join(group, unique["id"] == group["_node"]).select("id", "first", "n", "sig", "group"), "members")

    # One row of each class that may have links brings its text.
    wanted = members.select(F.col("id").alias("_class"))
    bearers = rows.join(wanted, rows["class"] == wanted["_class"]).groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "version")).alias("b"))
    bearers = bearers.select(F.col("class").alias("_class"), F.col("b.id").alias("_id"), F.col("b.version").alias("_version"))
    text = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text"))
    text = text.join(bearers, text["id"].eqNullSafe(bearers["_id"]) & (text["version"] == bearers["_version"])).select("_class", "text").dropDuplicates(["_class"])
    full = members.join(text, members["id"] == text["_class"]).drop("_class", "first")
    counts = members.groupBy("group").agg(F.count("*").alias("_m"))
    found = staged.write(_blocks(full, ["group"], counts).mapInArrow(_verified(join), "id long, n long, other long"), "links")
    staged.drop(shared, members)
    classed = components(found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    degree = found.where("other is null").groupBy(F.col("id").alias("_of")).agg(F.sum("n").alias("linked"))
    known = unique.join(degree, unique["id"] == degree["_of"], "left").join(classed, unique["id"] == classed["node"], "left")
    known = known.select(F.col("id").alias("_class"), "first", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", unique["id"]).alias("group"))
    known = staged.write(known, "classes")
    heads = known.groupBy(F.col("group").alias("_group")).agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", F.col("_class").alias("class"))).alias("head"))
    known = known.join(heads, F.col("group") == F.col("_group")).select("_class", "n_links", F.col("head.first").alias("class_id"), F.col("head.class").alias("_head"))
    linked = rows.where("size > 0").select("id", "version", "class").join(known, F.col("class") == F.col("_class"))
    linked = linked.select("id", "version", "n_links", "class_id", ((F.col("class") == F.col("_head")) & F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"))
    alone = rows.where("size = 0").select("id", "version", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    staged.drop(unique)
    return staged.keep(linked.unionByName(alone).withColumnRenamed("id", id_col))


def op8_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of five-word shingle similarity 0.8 or more among all documents."""
    common.bounded_batches(spark)
    return jaccard_join(common.table(spark, sf_dir, "documents"))
