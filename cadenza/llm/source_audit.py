"""Audit of how the terms of sources differ from their language, and sources of one language from each other.

A language keeps the terms of at least three of its documents. A group (language, source) gives each kept term a smoothed share
p of its occurrences, in whole billionths; so does the language (q). A term's divergence is (p - q)^2 / q. Postings, one row a
term with its count in each source, hold all counts. The terms that stand out are searched by bounds: a group's terms of equal
count have equal p, and the smallest q among them bounds the divergence of all; buckets are evaluated from the best bound on
until no bound that is left reaches the k-th value. Pairs of sources are added up from postings: only terms that both have are
visited pair by pair, all others depend on counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .grouping import pairs
from .terms import LETTERS, each, strings

#: Documents that a kept term needs, the ranks of terms.
LEAST, RANKS = 3, 200
#: Terms that a task holds before it gives its counts away.
HELD = 1 << 19
#: For the first estimate of the k-th value, so many times k terms are evaluated.
SEED = 4


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / whole), by long division in thousands: exact for any whole under 9 * 10^15."""
    left, out = count + 1, F.lit(0).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    out, left = div(left, whole), left % whole
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + div(left, whole), left % whole
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """share() of arrays; a whole of 0 (no kept terms) counts as 1 and is never used."""
    whole = np.maximum(whole, 1)
    out, left = np.divmod(count + 1, whole)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Counts:
    """What a task has counted so far: for (group, term) occurrences and documents."""

    def __init__(self):
        self.groups, self.terms, self.keys, self.n, self.docs, self.held = {}, {}, [], [], [], 0

    def add(self, group: np.ndarray, tokens) -> None:
        own = np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in tokens.words()), np.int64, len(tokens.first))
        if not len(own):
            return
        pair, times = np.unique((tokens.texts << 32) | own[tokens.codes], return_counts=True)
        self._put((group[pair >> 32] << 32) | (pair & 0xFFFFFFFF), times, np.ones(len(pair), np.int64))
        if self.held > 1 << 21:
            self._fold()

    def _put(self, keys, n, docs):
        self.keys.append(keys)
        self.n.append(n)
        self.docs.append(docs)
        self.held += len(keys)

    def _fold(self) -> None:
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        n, docs = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.n, self.docs))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n, self.docs, self.held = [], [], [], 0
        if len(at):
            self._put(keys[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at))
            self.held = 0  # what is folded doesn't count again

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._fold()
        if not self.keys:
            return
        (keys,), (n,), (docs,) = self.keys, self.n, self.docs
        names, terms = list(self.groups), strings(list(self.terms))
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        for k in range(0, len(keys), 1 << 16):
            part = slice(k, k + (1 << 16))
            group = pa.array(keys[part] >> 32)
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), terms.take(pa.array(keys[part] & 0xFFFFFFFF)), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up inside of tasks; a key may come from many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            group = np.fromiter((counts.groups.setdefault(g, len(counts.groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), np.int64, batch.num_rows)
            for a, b, tokens in each(batch.column(2), LETTERS):
                counts.add(group[a:b], tokens)
                if len(counts.terms) > HELD:
                    yield from counts.rows()
                    counts.terms, counts.keys, counts.n, counts.docs = {}, [], [], []
        yield from counts.rows()

    common.ship(docs.sparkSession)
    return _named(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, sources: array of (source, n)) of the kept terms. Counts move once, by language and term; a term's row
    grows with the sources of its language, whose pairs are asked for."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return rows.where(F.col("docs") >= least).drop("docs")


def group_sizes(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_lang, kept) of every group that occurs: its kept occurrences, the language's, and its kept terms."""
    groups = _named(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    sizes = posted.select("lang", F.explode("sources").alias("s")).groupBy(F.col("lang").alias("_l"), F.col("s.source").alias("_s")).agg(F.sum("s.n").alias("n_group"))
    langs = posted.groupBy(F.col("lang").alias("_m")).agg(F.sum("total").alias("n_lang"), F.count("*").alias("kept"))
    out = groups.join(sizes, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left").join(langs, F.col("lang") == F.col("_m"), "left")
    return out.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_group", "n_lang", "kept")])


def _entries(posted: DataFrame) -> DataFrame:
    rows = posted.select("lang", "term", "total", F.explode("sources").alias("s"))
    return rows.select("lang", F.col("s.source").alias("source"), "term", F.col("s.n").alias("n"), "total", F.length(F.bin("total")).alias("octave"))


def buckets(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """A group's terms of one count whose counts in the language have one bit length: how many, p, what the language's counts are
    of (whole), and the bound of their divergence (null: none lies above the language)."""
    rows = _entries(posted).groupBy("lang", "source", "n", "octave").agg(F.min("total").alias("low"), F.count("*").alias("terms"))
    sized = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), (F.col("n_group") + F.col("kept")).alias("of"), (F.col("n_lang") + F.col("kept")).alias("whole"))
    rows = rows.join(sized, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).withColumns({"p": share(F.col("n"), F.col("of")), "q": share(F.col("low"), F.col("whole"))})
    return rows.select("lang", "source", "n", "octave", "terms", "p", "whole", F.when(F.col("p") > F.col("q"), gap(F.col("p"), F.col("q"))).alias("bound"))


def _evaluated(posted: DataFrame, chosen: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms in these buckets that lie above the language."""
    chosen = chosen.select(*[F.col(c).alias(f"_{c}") for c in ("lang", "source", "n", "octave")], "p", "whole")
    on = [F.col(c) == F.col(f"_{c}") for c in ("lang", "source", "n", "octave")]
    rows = _entries(posted).join(chosen, on).withColumn("q", share(F.col("total"), F.col("whole"))).where("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))


def standing_out(posted: DataFrame, cut: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms above the language by divergence, up to this rank. cut: buckets()."""
    group, best = ["lang", "source"], [F.desc("value"), F.asc("item")]
    before = F.sum("terms").over(W.partitionBy(*group).orderBy(F.desc("bound"), "n", "octave").rowsBetween(W.unboundedPreceding, -1))
    open_ = cut.where("bound is not null")
    seed = open_.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < SEED * ranks)
    ranked = _evaluated(posted, seed).withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*best))).where(F.col("rank") <= ranks)
    kth = ranked.where(F.col("rank") == ranks).select(F.col("lang").alias("_gl"), F.col("source").alias("_gs"), F.col("value").alias("kth"))
    wanted = open_.join(kth, (F.col("lang") == F.col("_gl")) & (F.col("source") == F.col("_gs")), "left").where("kth is null or bound >= kth")
    return _evaluated(posted, wanted).withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*best))).where(F.col("rank") <= ranks)


class _Groups:
    """The groups as arrays; terms without occurrences have the share zero."""

    def __init__(self, table: pa.Table):
        self.names = pc.binary_join_element_wise(table.column("lang"), table.column("source"), "\0").combine_chunks()
        self.whole = (pc.add(table.column("n_group"), table.column("kept"))).to_numpy()
        self.zero = shares(np.zeros(len(self.whole), np.int64), self.whole)
        lang = table.column("lang").combine_chunks().dictionary_encode()
        self.lang = lang.indices.to_numpy().astype(np.int64)
        self.members = [np.flatnonzero(self.lang == k) for k in range(len(lang.dictionary))]

    def find(self, lang: pa.Array, source: pa.Array) -> np.ndarray:
        return pc.index_in(pc.binary_join_element_wise(lang, source, "\0"), self.names).to_numpy().astype(np.int64)


class _Sums:
    """Exact sums by pair of groups; what is held is folded from time to time."""

    def __init__(self, groups: int):
        self.groups, self.keys, self.values, self.held = groups, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(a * self.groups + b)
        self.values.append(value)
        self.held += len(value)
        if self.held > 1 << 21:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.values])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, values = keys[at], np.add.reduceat(values[order], at) if len(at) else values
        self.keys, self.values, self.held = [keys], [values], 0
        return keys, values

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys, values = self.fold()
        for k in range(0, len(keys), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part] // self.groups), pa.array(keys[part] % self.groups), pa.array(values[part])], names=["a", "b", "value"])


def shared_terms(posted: DataFrame, groups: pa.Table) -> DataFrame:
    """(a, b, value): what terms that both groups have change in their divergence, against groups that lack them."""
    held = posted.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Groups(held.value)
        sums = _Sums(len(g.whole))
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            at, entries = at - at[0], lists.flatten()
            own = g.find(batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))), entries.field("source"))
            p, z = shares(entries.field("n").to_numpy(), g.whole[own]), g.zero[own]
            for i, j in pairs(at):
                for x, y in ((i, j), (j, i)):
                    sums.add(own[x], own[y], gaps(p[x], p[y]) - gaps(p[x], z[y]) - gaps(z[x], p[y]) + gaps(z[x], z[y]))
        yield from sums.rows()

    return posted.select("lang", "sources").mapInArrow(run, "a long, b long, value long")


def single_terms(counted: DataFrame, groups: pa.Table) -> DataFrame:
    """(a, b, value): divergence of all pairs of a language if no two groups shared a term, from (lang, source, n, terms): how
    many terms have this count there; without what all pairs have for terms that neither holds."""
    held = counted.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Groups(held.value)
        sums = _Sums(len(g.whole))
        for batch in batches:
            own = g.find(batch.column(0), batch.column(1))
            terms, p = batch.column(3).to_numpy(), shares(batch.column(2).to_numpy(), g.whole[own])
            for k in np.unique(g.lang[own]).tolist():
                others, rows = g.members[k], np.flatnonzero(g.lang[own] == k)
                for a in range(0, len(rows), step := max(1, (1 << 18) // len(others))):
                    row, other = (x.ravel() for x in np.meshgrid(rows[a : a + step], others, indexing="ij"))
                    row, other = row[own[row] != other], other[own[row] != other]
                    x, z, q, m = own[row], g.zero[own[row]], g.zero[other], terms[row]
                    sums.add(x, other, m * (gaps(p[row], q) - gaps(z, q)))
                    sums.add(other, x, m * (gaps(q, p[row]) - gaps(q, z)))
        yield from sums.rows()

    return counted.select("lang", "source", "n", "terms").mapInArrow(run, "a long, b long, value long")


def pair_divergence(posted: DataFrame, cut: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each group against each other source of its language, summed over all kept terms.

    The groups go to all tasks: the result has their square."""
    spark = posted.sparkSession
    table = groups.select("lang", "source", "n_group", "kept").toArrow()
    number = spark.createDataFrame(pa.table({"at": pa.array(range(table.num_rows), pa.int64()), **{c: table.column(c) for c in ("lang", "source", "n_group", "kept")}})) if table.num_rows else spark.createDataFrame([], "at long, lang string, source string, n_group long, kept long")
    counted = cut.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms"))
    sums = shared_terms(posted, table).unionByName(single_terms(counted, table)).groupBy("a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    other = number.select(*[F.col(c).alias(f"_{c}") for c in number.columns])
    both = number.join(other, (F.col("lang") == F.col("_lang")) & (F.col("at") != F.col("_at"))).join(sums, (F.col("at") == F.col("a")) & (F.col("_at") == F.col("b")), "left")
    zero = lambda n, kept: share(F.lit(0).cast("long"), F.nullif(n + kept, F.lit(0)))
    rest = F.col("kept").cast("decimal(38,0)") * gap(zero(F.col("n_group"), F.col("kept")), zero(F.col("_n_group"), F.col("_kept")))
    out = both.select("lang", "source", F.col("_source").alias("item"), F.when(F.col("kept") == 0, 0).otherwise(rest + F.coalesce("value", F.lit(0))).cast("long").alias("value"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def source_audit(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` compares a group with each other source of its language, part `term`
    lists the terms by which it stands out.

    Null languages, sources and texts count as empty. A group without terms takes part in pairs; a language without kept terms
    has pairs of value 0 and no terms. Rows that repeat are documents of their own. Equal values go by the item's bytes. Texts
    are whole; other columns aren't read; an empty table gives no rows.
    """
    staged = common.Staged(docs.sparkSession, "audit")
    posted = staged.write(postings(docs), "postings")
    groups = staged.write(group_sizes(docs, posted), "groups")
    cut = staged.write(buckets(posted, groups), "buckets")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    terms = staged.write(part(standing_out(posted, cut, ranks), "term"), "terms")
    return staged.keep(terms.unionByName(part(staged.write(pair_divergence(posted, cut, groups), "pairs"), "pair")))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of documents."""
    common.bounded_batches(spark)
    return source_audit(common.table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""with named as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, text from documents),
    t as (select d, lang, source, unnest({_TERMS}) as term from named),
    kept as (select lang, term, count(*) as total from t group by 1, 2 having count(distinct d) >= 3),
    langs as (select lang, sum(total)::bigint as n, count(*) as v from kept group by 1),
    grp as (select distinct lang, source from named),
    c as (select t.lang, t.source, t.term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3),
    size as (select grp.lang, grp.source, coalesce(sum(n), 0)::bigint as n from grp left join c using (lang, source) group by 1, 2),
    p as (select size.lang, size.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (size.n + langs.v) as p, 1 + (1000000000 * (kept.total + 1)) // (langs.n + langs.v) as q
        from size join langs using (lang) join kept using (lang) left join c on c.lang = size.lang and c.source = size.source and c.term = kept.term),
    pair as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
        union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p where n > 0 and p > q),
    k as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
    select lang, source, part, item, value::bigint as value, cast(rank as int) as rank from k where part = 'pair' or rank <= 200"""
