"""Ranked lexical search over dual-sorted wavelet trees.

Each shard holds the postings of some documents: one list a term, in the order of impact, all lists in one sequence of
document numbers. The sequence is kept as a wavelet tree whose levels split it by the bits of the numbers, so a list can be
walked by document as well. A node of the tree stands for a range of documents; a term's list inside of it is an interval
whose first posting has the largest impact. The sum over an item's terms of these impacts bounds every document below the
node; the nodes with the best bounds are opened first, and leaves are exact scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .terms import ALPHANUMERIC, each, token_counts

#: A shard is closed when it has so many postings, or so many documents.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 16
#: Nodes that are opened at once.
STEP = 96
#: Bytes of items' texts that one round of searching takes to the tasks; more items make more rounds.
BLOCK_BYTES = 16 << 20

INDEX = "ids array<long>, terms array<string>, starts array<long>, impacts binary, bits binary"


@dataclass(frozen=True)
class Collection:
    """How many documents have a term, and how many terms all of them have."""

    documents: int
    terms: int

    def impacts(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to the score of a document of so many terms in which it occurs tf times."""
        m = 25 + (75 * size.astype(np.int64) * self.documents) // max(1, self.terms)
        return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def collection(docs: DataFrame, text_col: str = "text") -> Collection:
    """One pass over all texts; a row a batch is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = token_counts(b.column(0), ALPHANUMERIC)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["d", "n"])

    common.ship(docs.sparkSession)
    d, n = docs.select(docs[text_col]).mapInArrow(run, "d long, n long").agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Collection(d, n)


class Shard:
    """Documents whose postings are gathered until they make one row of the index."""

    def __init__(self, of: Collection, most: tuple[int, int]):
        self.of, self.most, self.numbers, self.ids, self.parts, self.postings = of, most, {}, [], [], 0

    def add(self, ids: pa.Array, tokens) -> None:
        own = np.fromiter((self.numbers.setdefault(w, len(self.numbers)) for w in tokens.words()), np.int64, len(tokens.first))
        pair, tf = np.unique((tokens.texts << 32) | own[tokens.codes], return_counts=True) if len(tokens.codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        doc = pair >> 32
        self.parts.append((doc + len(self.ids), pair & 0xFFFFFFFF, self.of.impacts(tf, tokens.counts[doc])))
        self.ids += ids.to_pylist()
        self.postings += len(pair)

    @property
    def full(self) -> bool:
        return self.postings >= self.most[0] or len(self.ids) >= self.most[1]

    def row(self) -> pa.RecordBatch:
        """Documents are numbered by their ids (nulls last), lists are sorted by impact, then by document."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        doc, term, impact = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.parts, strict=True))
        by_name = np.argsort(np.array(list(self.numbers), object)) if self.numbers else np.zeros(0, np.int64)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        keys = np.sort((rank[term] << 38) | ((1_000_000 - impact) << 18) | place[doc])  # impacts are at most 1,000,000, places under 2^18
        names = np.array(list(self.numbers), object)[by_name].tolist()
        starts = np.searchsorted(keys >> 38, np.arange(len(names) + 1))
        bits = tree_bits(keys & ((1 << 18) - 1), height(n))
        impacts = (1_000_000 - ((keys >> 18) & ((1 << 20) - 1))).astype(np.uint32)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        words = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(names, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([one([self.ids[k] for k in order], pa.int64()), words, one(starts, pa.int64()), pa.array([impacts.tobytes()], pa.binary()), pa.array([bits.tobytes()], pa.binary())], names=[c.split()[0] for c in INDEX.split(", ")])


def height(n: int) -> int:
    return max(1, (n - 1).bit_length())


def tree_bits(docs: np.ndarray, levels: int) -> np.ndarray:
    """The bits of each level in machine words. A level's sequence is the one above with all zeros before all ones; both keep
    their order, so every node's part of a list stays in one piece."""
    out = np.zeros((levels, len(docs) // 64 + 1), np.uint64)
    for level in range(levels):
        bit = (docs >> (levels - 1 - level)) & 1 == 1
        out[level].view(np.uint8)[: -(-len(docs) // 8)] = np.packbits(bit, bitorder="little")
        docs = np.concatenate([docs[~bit], docs[bit]])
    return out


class Tree:
    """A shard's tree with the impacts of every level in that level's order."""

    def __init__(self, bits: bytes, impacts: bytes, levels: int):
        now = np.frombuffer(impacts, np.uint32)
        n = len(now)
        self.words = np.frombuffer(bits, np.uint64).reshape(levels, -1)
        self.width = self.words.shape[1]
        count = np.bitwise_count(self.words).astype(np.int32)
        self.before = (np.cumsum(count, axis=1, dtype=np.int32) - count).ravel()
        self.zeros = n - count.sum(1, dtype=np.int64)
        self.impacts = np.empty((levels + 1, n + 1), np.uint32)
        self.impacts[:, n] = 0
        for level in range(levels + 1):
            self.impacts[level, :n] = now
            if level < levels:
                bit = np.unpackbits(self.words[level].view(np.uint8), count=n, bitorder="little").astype(bool)
                now = np.concatenate([now[~bit], now[bit]])
        self.words, self.levels = self.words.ravel(), levels

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ones stand before a place of a level."""
        word = level * self.width + (at >> 6)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def best(self, low: np.ndarray, high: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) of the k best documents with a score above 0; equal scores by document. low, high: each term's
        list; weight: what it counts. Nodes are dropped once their bound can't change the k best."""
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        low, high = low[None, :].astype(np.int64), high[None, :].astype(np.int64)
        bound = np.where(high > low, self.impacts[0][low], 0) @ weight
        top = np.int64(self.levels)
        while len(bound):
            first = prefix << (top - level)
            if len(scores) == k:
                open_ = (bound > scores[-1]) | ((bound == scores[-1]) & (first < docs[-1]))
                if not open_.all():
                    level, prefix, bound, low, high, first = (x[open_] for x in (level, prefix, bound, low, high, first))
            order = np.lexsort((first, -bound))
            now, rest = order[:STEP], order[STEP:]
            a, b, lv = low[now], high[now], level[now][:, None]
            one_a, one_b = self.ones(lv, a), self.ones(lv, b)
            zeros = self.zeros[lv]
            a, b = np.concatenate([a - one_a, zeros + one_a]), np.concatenate([b - one_b, zeros + one_b])
            lv = np.concatenate([level[now], level[now]]) + 1
            below = np.concatenate([prefix[now] << 1, (prefix[now] << 1) | 1])
            best = np.where(b > a, self.impacts[lv[:, None], a], 0) @ weight
            leaf = (lv == top) & (best > 0)
            if leaf.any():
                scores, docs = np.append(scores, best[leaf]), np.append(docs, below[leaf])
                kept = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[kept], docs[kept]
            inner = (lv < top) & (best > 0)
            level, prefix, bound = np.append(level[rest], lv[inner]), np.append(prefix[rest], below[inner]), np.append(bound[rest], best[inner])
            low, high = np.concatenate([low[rest], a[inner]]), np.concatenate([high[rest], b[inner]])
        return scores, docs


def build_index(docs: DataFrame, of: Collection, id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int] = (POSTINGS, DOCUMENTS)) -> DataFrame:
    """One row a shard, closed at so many postings or documents (most). Tasks make shards of the documents that they read, so
    nothing is shuffled; a text is never cut, and a shard holds at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(of, most)
        for batch in batches:
            for a, b, tokens in each(batch.column(1), ALPHANUMERIC):
                shard.add(batch.column(0)[a:b], tokens)
                if shard.full:
                    yield shard.row()
                    shard = Shard(of, most)
        if shard.ids:
            yield shard.row()

    common.ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, INDEX)


def frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of these terms occurs: the lengths of its lists in all shards."""
    held = index.sparkSession.sparkContext.broadcast(terms)  # the terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(held.value, pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                at = pc.index_in(wanted, batch.column(0)[k].values)
                starts = batch.column(1)[k].values.to_numpy()
                found = np.flatnonzero(at.is_valid())
                place = at.drop_null().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(starts[place + 1] - starts[place], pa.int64())], names=["term", "n"])

    rows = index.select("terms", "starts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r.term]: r.n for r in rows}


def _found(index: DataFrame, items: list[list[tuple[str, int]]], k: int) -> DataFrame:
    """(item, score, doc_id): each shard's k best documents for each item, given as (term, weight)."""
    held = index.sparkSession.sparkContext.broadcast(items)  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sorted({t for item in held.value for t, _ in item})
        number = {t: i for i, t in enumerate(words)}
        wanted = pa.array(words, pa.string())
        asked = [(np.array([number[t] for t, _ in item], np.int64), np.array([w for _, w in item], np.int64)) for item in held.value]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, names, starts = (batch.column(c)[row].values for c in range(3))
                starts = starts.to_numpy()
                tree = Tree(batch.column(4)[row].as_py(), batch.column(3)[row].as_py(), height(len(ids)))
                at = pc.index_in(wanted, names).fill_null(-1).to_numpy()
                item, score, doc = [], [], []
                for i, (terms, weight) in enumerate(asked):
                    place = at[terms]
                    some = place >= 0
                    if not some.any():
                        continue
                    place = place[some]
                    s, d = tree.best(starts[place], starts[place + 1], weight[some], k)
                    item.append(np.full(len(s), i))
                    score.append(s)
                    doc.append(d)
                if item:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item), pa.int32()), pa.array(np.concatenate(score)), ids.take(pa.array(np.concatenate(doc)))], names=["item", "score", "doc_id"])

    return index.mapInArrow(run, "item int, score long, doc_id long")


def search(index: DataFrame, of: Collection, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items its k best documents with a score above 0.

    Items are taken in blocks of bounded bytes, each against all shards; a shard gives at most k rows an item, which are cut
    again in parts before one task ranks an item. Equal scores go by doc_id, null ids last. Items without terms (null, empty)
    or whose terms no document holds have no rows; a row that is there twice is ranked twice. No items or an empty index give
    no rows.
    """
    spark = index.sparkSession
    rows = items.select(items[item_col].cast("long").alias("item_id"), F.coalesce(items[text_col], F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = total // BLOCK_BYTES + 1
    out = None
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        terms = []
        for first, last, tokens in each(block.column("text"), ALPHANUMERIC):
            names = [w.decode() for w in tokens.words()]
            terms += [Counter(names[c] for c in tokens.codes[tokens.at[i] : tokens.at[i + 1]].tolist()) for i in range(last - first)]
        df = frequencies(index, sorted(set().union(*terms)))
        weighed = [[(t, n * of.weight(df[t])) for t, n in sorted(item.items()) if t in df] for item in terms]
        named = spark.createDataFrame(pa.table({"item": pa.array(range(len(terms)), pa.int32()), "item_id": block.column("item_id")})) if terms else spark.createDataFrame([], "item int, item_id long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        found = _found(index, weighed, k).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        found = found.withColumn("_n", F.row_number().over(W.partitionBy("item", "_part").orderBy(*order))).where(F.col("_n") <= k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        found = found.join(named, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, most: tuple[int, int] = (POSTINGS, DOCUMENTS)) -> DataFrame:
    """The k best of docs (doc_id, text) for each of items (item_id, text).

    Null and empty texts have no terms and are never found; repeated rows are documents of their own; long texts are whole;
    other columns aren't read.
    """
    staged = common.Staged(docs.sparkSession, "search")
    of = collection(docs)
    index = staged.write(build_index(docs, of, most=most), "index")
    return staged.keep(staged.write(search(index, of, items, k), "found"))


def op11_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    common.bounded_batches(spark)
    return ranked_search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""with d as (select doc_id, unnest({_TERMS}) as term from documents where text is not null),
    q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
    size as (select doc_id, count(*) as n from d group by 1),
    whole as (select count(*) as docs, sum(n)::bigint as terms from size),
    tf as (select doc_id, term, count(*) as tf from d group by 1, 2),
    w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, whole group by term, docs),
    s as (select q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * size.n * whole.docs) // whole.terms))))::bigint as score
        from q join tf using (term) join w using (term) join size using (doc_id) cross join whole group by 1, 2),
    r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
    select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 10"""
