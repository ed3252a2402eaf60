"""Sharding by a k-d tree: weighted medians along the widest metadata dimension, until leaves reach the target bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A dimension is compared in so many bits, then rows that agree in it by so many bits of the group's hash.
DIM_BITS, HASH_BITS = 20, 32
#: Buckets of one round of the search for a median.
BUCKETS = 4096


@dataclass
class Node:
    """A cell with its number of shards; leaves have one. dim and at: rows whose key in dim is below at go left."""

    shards: int
    first: int
    dim: int = -1
    at: int = 0
    below: list[Node] = field(default_factory=list)

    def column(self, keys: list[Column]) -> Column:
        if not self.below:
            return F.lit(self.first)
        return F.when(keys[self.dim] < self.at, self.below[0].column(keys)).otherwise(self.below[1].column(keys))


def _keys(dims: list[str], spans: dict[str, tuple[float, float]]) -> list[Column]:
    out = []
    for d in dims:
        low, high = spans[d]
        share = (F.coalesce(F.col(d), F.lit(low)) - low) / (high - low) if high > low else F.lit(0.0)
        cell = F.floor(share * (2**DIM_BITS - 1)).cast("long")
        out.append(F.shiftleft(cell, HASH_BITS) + F.col("_hash"))
    return out


def tree(rows: DataFrame, dims: list[str], weight: str, shards: int) -> tuple[Node, list[Column]]:
    """The tree over rows with columns dims (double), weight (long) and _hash (long below 2^HASH_BITS).

    Each level is a few aggregations that return at most BUCKETS rows a cell to the driver, whatever the input's size.
    """
    span = rows.agg(*[f(d).alias(f"{d}_{n}") for d in dims for n, f in (("low", F.min), ("high", F.max))]).first()
    spans = {d: (float(span[f"{d}_low"] or 0), float(span[f"{d}_high"] or 0)) for d in dims}
    keys = _keys(dims, spans)
    root = Node(shards, 0)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        cell = root.column(keys)
        ids = [n.first for n in level]
        wide = rows.where(cell.isin(ids)).groupBy(cell.alias("c")).agg(F.sum(weight).alias("w"), *[f(F.shiftright(k, HASH_BITS)).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("low", F.min), ("high", F.max))]).collect()
        seen = {r["c"]: r for r in wide}
        search = {}
        for n in level:
            r = seen.get(n.first)
            if r is None:
                n.dim, goal = 0, 0
            else:
                widths = [r[f"high{i}"] - r[f"low{i}"] for i in range(len(dims))]
                n.dim = widths.index(max(widths))
                goal = r["w"] * (n.shards // 2) / n.shards
            search[n.first] = [0, DIM_BITS + HASH_BITS, 0, goal]  # low end, open bits, weight below it, goal
        while any(s[1] > 0 for s in search.values()):
            shift = {c: max(0, s[1] - 12) for c, s in search.items()}
            bucket, inside = F.lit(None).cast("long"), F.lit(False)
            for n in level:
                low, bits = search[n.first][:2]
                here = (cell == n.first) & (keys[n.dim] >= low) & (keys[n.dim] < low + (1 << bits))
                bucket = F.when(here, F.shiftright(keys[n.dim] - low, shift[n.first])).otherwise(bucket)
                inside = inside | here
            found = rows.where(inside).groupBy(cell.alias("c"), bucket.alias("b")).agg(F.sum(weight).alias("w")).collect()
            for c, s in search.items():
                total = s[2]
                for b, w in sorted((r["b"], r["w"]) for r in found if r["c"] == c):
                    if total + w > s[3]:
                        if shift[c] == 0 and s[3] - total > total + w - s[3]:  # the nearer side of the last group
                            b, total = b + 1, total + w
                        break
                    total += w
                else:
                    b = 1 << (s[1] - shift[c])
                s[0], s[1], s[2] = s[0] + (b << shift[c]), shift[c], total
        for n in level:
            n.at = search[n.first][0]
            left = n.shards // 2
            n.below = [Node(left, n.first), Node(n.shards - left, n.first + left)]
        level = [b for n in level for b in n.below]
    return root, keys


def text_metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size (UTF-8 bytes plus 1), text_crc32, _hash and the dimensions, all of them functions of the text alone."""
    text = F.coalesce(docs[text_col], F.lit(""))
    size = F.octet_length(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (size + 1).cast("long").alias("size"),
        common.crc32_text(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(2**HASH_BITS)).alias("_hash"),
        F.log2(size + 1.0).alias("log_bytes"),
        (size / F.greatest(F.length(text), F.lit(1))).alias("bytes_a_char"),
        F.log2(lines + 1.0).alias("log_lines"),
    )


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (from 0 without gaps in each shard).

    shards: how many leaves; else as many as hold about target_bytes each. Equal texts (null counts as empty) share a shard,
    since every dimension depends on the text alone; sizes are equal up to the size of one group of copies at each split.
    Empty tables give no rows; repeated rows stay repeated; other columns aren't read.
    """
    spark = docs.sparkSession
    staged = common.Staged(spark, "kd-shards")
    rows = staged.write(text_metadata(docs, id_col, text_col), "rows")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    root, keys = tree(rows, ["log_bytes", "bytes_a_char", "log_lines"], "size", shards)
    placed = rows.select("doc_id", "size", "text_crc32", root.column(keys).cast("int").alias("shard"))
    return staged.keep(common.gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    out = kd_shards(common.table(spark, sf_dir, "documents"), shards=8)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
