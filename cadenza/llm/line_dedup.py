"""Fuzzy line deduplication by MinHash, in DataFrame functions alone.

A line's shingles are its windows of WIDTH characters, one at every character (lower case, white space folded). Equal lines are
one node. MinHash values over the shingles are banded into buckets. Bitmaps of the shingles prove of most pairs in a bucket that
they differ in too many; the others are verified exactly. Lines of a bucket are first verified against its smallest line, then
larger buckets that still hold more than one component are split by further MinHash values, and the lines of each part are verified
against two of them. That settles most buckets by pairs that grow with the lines. What is left is compared completely: all pairs
of different components in a bucket. Union-find over the verified links gives the components, and one line of each stays.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH = 9
BANDS, ROWS = 8, 3
THRESHOLD = 0.8
#: Buckets of so many lines are not split before all their pairs are compared.
SMALL = 64
#: How many MinHash values beyond a band's own split a larger bucket of several components, and their orders.
DEPTHS, ORDERS = (2, 4, 6, 8), 3
#: 64-bit words of the bitmap that bounds how many shingles two lines can share.
WORDS = 32
#: Windows that one row of the sketch hashes.
STEP = 12
#: Windows that one row of the bitmaps hashes.
MAP_STEP = 4
#: Bits of a filter that leaves out lines before they are shuffled: a table of at most FILTER_BITS / 64 rows, whatever the input.
FILTER_BITS = 1 << 22
_VALUES = BANDS * ROWS
#: A value reads the shingle's hash from one of these bits on, so that neighbouring values order shingles independently.
_SHIFTS = (0, 11, 22, 33)
_LOW = 2**31 - 1
_BLANKS = ("  ", "\t", "\r", "\f", "\x0b")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, also where use has it inside of a lambda."""
    return F.transform(F.array(value), use)[0]


def _normal(raw: Column) -> Column:
    """Lower case, white space folded to single spaces, none at the ends."""
    odd = reduce(lambda a, b: a | b, [F.contains(raw, F.lit(b)) for b in _BLANKS])
    return F.lower(F.trim(F.when(odd, F.regexp_replace(raw, r"\s+", " ")).otherwise(raw)))


def _wide(line: Column) -> Column:
    """The line in two bytes a character (a rare sign beyond U+FFFF counts as two), so that a window's place is known."""
    return F.encode(line, "UTF-16BE")


def _last(wide: Column) -> Column:
    """Where the last window begins; a shorter text is one window."""
    return F.greatest(F.length(wide) - F.lit(2 * WIDTH - 1), F.lit(1))


def _window(wide: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(wide, at, F.lit(2 * WIDTH)))


def _shingles(line: Column) -> Column:
    """64-bit hashes of the windows at every character."""
    return _let(_wide(line), lambda wide: F.transform(F.sequence(F.lit(1), _last(wide), F.lit(2)), lambda at: _window(wide, at)))


def _starts(lines: DataFrame, step: int, *keep: str) -> DataFrame:
    """A row for every `step` windows of lines (line, keep): keep, and their hashes h0, h1, ... Beyond the last window, that one
    is taken again."""
    wide = lines.select(*keep, _wide(F.col("line")).alias("wide"))
    starts = wide.select(*keep, "wide", F.explode(F.sequence(F.lit(1), _last(F.col("wide")), F.lit(2 * step))).alias("p"))
    at = [F.least(F.col("p") + F.lit(2 * j), _last(F.col("wide"))) for j in range(step)]
    return starts.select(*keep, *[_window(F.col("wide"), a).alias(f"h{j}") for j, a in enumerate(at)])


def _minhash(lines: DataFrame) -> DataFrame:
    """(k, mark, many, v0 int, v1 int, ...) of lines (k, mark, line): _VALUES MinHash values for each distinct k, many if it has
    different marks, and the smallest of them.

    Windows become rows, STEP of them in each, and are summed up before the shuffle; texts do not move. A value is the least of
    31 bits of the shingle's hash, XORed with a constant; constants that read the same bits differ in their leading ones.
    """
    rng = random.Random(17)
    hashed = _starts(lines, STEP, "k", "mark")
    bits = [F.shiftrightunsigned(f"h{j}", s).bitwiseAND(F.lit(_LOW)).cast("int").alias(f"x{i}_{j}") for i, s in enumerate(_SHIFTS) for j in range(STEP)]
    values, share = [], _VALUES // len(_SHIFTS)
    for n in range(_VALUES):
        flip = F.lit(int((n // len(_SHIFTS) + rng.random()) / share * 2**31))
        values.append(F.min(F.least(*[F.col(f"x{n % len(_SHIFTS)}_{j}").bitwiseXOR(flip) for j in range(STEP)])).alias(f"v{n}"))
    ranked = hashed.select("k", "mark", *bits).groupBy("k").agg(F.min("mark").alias("mark"), F.max("mark").alias("_last"), *values)
    return ranked.select("k", "mark", (F.col("mark") != F.col("_last")).alias("many"), *[f"v{n}" for n in range(_VALUES)])


def _bands() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[F.col(f"v{ROWS * b + r}") for r in range(ROWS)]) for b in range(BANDS)])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (u, v) those whose shingles reach the threshold."""
    own = _among(texts, pairs.select(F.explode(F.array("u", "v")).alias("k")))
    left = own.select(F.col("k").alias("_u"), F.col("line").alias("_lu"))
    right = own.select(F.col("k").alias("_v"), F.col("line").alias("_lv"))
    joined = pairs.join(left, F.col("u") == F.col("_u")).join(right, F.col("v") == F.col("_v"))
    both = lambda s: F.size(F.array_intersect(s["a"], s["b"]))
    reach = lambda all_, both: both >= F.lit(THRESHOLD / (1 + THRESHOLD)) * (all_ + both) - F.lit(1e-9)
    sets = F.struct(_shingles(F.col("_lu")).alias("a"), _shingles(F.col("_lv")).alias("b"))
    near = _let(sets, lambda s: reach(F.size(F.array_union(s["a"], s["b"])), both(s)))
    return joined.where(near).select("u", "v")


def _ends(members: DataFrame) -> DataFrame:
    """Of members (k, c, key) pairs (u, v) of each key's two ends with its other members, for keys with more than one c; the
    order in which k has ends is another one for each key."""
    order = F.xxhash64("key")
    turned = F.col("k").bitwiseXOR(order)
    ends = members.groupBy("key").agg(F.min(turned).alias("low"), F.max(turned).alias("high"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    ends = ends.select(F.col("key").alias("_key"), F.array(F.col("low").bitwiseXOR(order), F.col("high").bitwiseXOR(order)).alias("ends"))
    joined = members.join(ends, F.col("key") == F.col("_key"))
    both = joined.select("k", F.explode("ends").alias("end")).where("k <> end")
    return both.select(F.least("k", "end").alias("u"), F.greatest("k", "end").alias("v")).distinct()


def _among(rows: DataFrame, keys: DataFrame, name: str = "k") -> DataFrame:
    """Rows whose k (or the column named) is among that of keys, and a few others: what the hash says without a shuffle. With more
    keys than FILTER_BITS more rows stay; none that is wanted ever goes."""
    bit = F.pmod(name, F.lit(FILTER_BITS))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(bit, 6).alias("_word")).agg(F.bit_or(place).alias("_bits"))
    joined = rows.join(F.broadcast(words), F.shiftright(bit, 6) == F.col("_word"))
    return joined.where(F.col("_bits").bitwiseAND(place) != 0).drop("_word", "_bits")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, at, k, mark, line) of all lines that are not blank; a null id comes last, mark tells places apart."""
    thin = docs.where(docs[text_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text"))
    raw = thin.select("id", "version", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    # As a generated row the line is made once, not again for the filter and each hash.
    lines = raw.select("id", "version", "at", F.explode(F.array(_normal(F.col("raw")))).alias("line")).where("line <> ''")
    return lines.select("id", "version", "at", F.xxhash64("line").alias("k"), F.xxhash64("id", "version", "at").alias("mark"), "line")


def _links(sketch: DataFrame, shared: DataFrame, texts: DataFrame, staged: common.Staged) -> DataFrame:
    """Components of the nodes of different lines that the threshold links; shared (k, b, key, n, leader) are the buckets' members,
    b only where n > SMALL."""
    maps = staged.write(_maps(texts), "maps")
    stars = shared.where("k <> leader").select(F.col("leader").alias("u"), F.col("k").alias("v")).distinct()
    links = staged.write(_verified(staged.write(_likely(stars, maps), "pairs"), texts), "links")
    known, rest = _open(shared.where("n > 2"), links, staged)
    large = rest.where(F.col("n") > SMALL)
    if not large.isEmpty():
        values = _among(sketch, large).select(F.col("k").alias("_k"), F.array(*[f"v{n}" for n in range(_VALUES)]).alias("v"))
        pairs = _ends(large.join(values, F.col("k") == F.col("_k")).select("k", "c", F.explode(_deeper()).alias("key")))
        pairs = pairs.join(known, F.col("u") == F.col("_n"), "left").select("u", "v", F.coalesce("component", "u").alias("cu"))
        pairs = pairs.join(known, F.col("v") == F.col("_n"), "left").where(F.col("cu") != F.coalesce("component", "v")).select("u", "v")
        more = _verified(staged.write(_likely(pairs, maps), "pairs"), texts)
        links = staged.write(links.unionByName(more), "links")
        known, rest = _open(rest.drop("c"), links, staged)
    more = _verified(staged.write(_across(rest, maps), "pairs"), texts)
    links = staged.write(links.unionByName(more), "links")
    staged.drop(maps)
    return components(links)


def _open(shared: DataFrame, links: DataFrame, staged: common.Staged) -> tuple[DataFrame, DataFrame]:
    """Components (_n, component) as far as few rounds give them, and shared (k, b, key, n) with them (c) in the buckets that hold
    several."""
    known = staged.write(components(links, rounds=3).select(F.col("node").alias("_n"), "component"), "known")
    placed = shared.join(known, F.col("k") == F.col("_n"), "left").select("k", "b", "key", "n", F.coalesce("component", "k").alias("c"))
    placed = staged.write(placed, "placed")
    several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select(F.col("key").alias("_key"))
    return known, staged.write(placed.join(several, F.col("key") == F.col("_key")).drop("_key"), "open")


def _maps(texts: DataFrame) -> DataFrame:
    """(k, w, w0 long, w1 long, ...) of texts (k, line): how many windows, and a bitmap of the shingles."""
    each = _starts(texts.withColumn("w", F.expr(f"greatest(length(encode(line, 'UTF-16BE')) div 2 - {WIDTH - 1}, 1)")), MAP_STEP, "k", "w")
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"h{j}").bitwiseAND(F.lit(63)).cast("int")).alias(f"bit{j}") for j in range(MAP_STEP)]
    word = [F.shiftright(f"h{j}", 6).bitwiseAND(F.lit(WORDS - 1)).alias(f"word{j}") for j in range(MAP_STEP)]
    either = lambda i: reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"word{j}") == i, F.col(f"bit{j}")).otherwise(F.lit(0).cast("long")) for j in range(MAP_STEP)])
    return each.select("k", "w", *bit, *word).groupBy("k", "w").agg(*[F.bit_or(either(i)).alias(f"w{i}") for i in range(WORDS)])


def _near() -> Column:
    """Not of rows (w, w0, ...; w_, w0_, ...) whose maps prove that the sets don't reach the threshold: bits in which they differ
    are at least as many shingles that one set has alone, and sets that reach it have few of these for their windows."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"w{i}_"))) for i in range(WORDS)])
    most = F.least(F.lit((1 - THRESHOLD) / THRESHOLD) * F.least("w", "w_"), F.lit((1 - THRESHOLD) / (1 + THRESHOLD)) * (F.col("w") + F.col("w_")))
    return apart <= most + F.lit(1e-6)


def _likely(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Of pairs (u, v) those that the maps leave."""
    right = maps.select(*[F.col(c).alias(f"{c}_") for c in maps.columns])
    return pairs.join(maps, F.col("u") == F.col("k")).join(right, F.col("v") == F.col("k_")).where(_near()).select("u", "v")


def _across(members: DataFrame, maps: DataFrame) -> DataFrame:
    """Of members (k, c, key) all pairs (u, v) of one key and different c, but for those that the maps rule out."""
    left = members.select(F.col("k").alias("_k"), "c", "key").join(maps, F.col("k") == F.col("_k")).drop("_k")
    right = left.select(*[F.col(c).alias(f"{c}_") for c in left.columns])
    met = left.join(right, (F.col("key") == F.col("key_")) & (F.col("k") < F.col("k_")) & (F.col("c") != F.col("c_")) & _near())
    return met.select(F.col("k").alias("u"), F.col("k_").alias("v")).distinct()


def _deeper() -> Column:
    """Keys of the parts of a bucket (b, key) by the values after its band's own, in steps that have no divisor in common with
    their number."""
    value = lambda d, step: F.get("v", F.pmod(F.col("b") * ROWS + (ROWS + d) * step, F.lit(_VALUES)).cast("int"))
    further = [[value(d, step) for d in range(max(DEPTHS))] for step in (1, 7, 13)[:ORDERS]]
    return F.array(*[F.xxhash64("key", F.lit(o), *row[:d]) for o, row in enumerate(further) for d in DEPTHS])


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, common.Staged]:
    """(id, version, removed array<int>): numbers (from 0, split at newlines) of each text's lines that repeat an earlier one;
    version is the text's hash."""
    staged = common.Staged(docs.sparkSession, "lines")
    lines = staged.write(_lines(docs, id_col, text_col), "lines")
    sketch = staged.write(_minhash(lines.select("k", "mark", "line")), "sketch")
    banded = sketch.select("k", F.posexplode(_bands()).alias("b", "key"))
    buckets = banded.groupBy("key").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.bit_xor("k").alias("odd"), F.count("*").alias("n"))
    buckets = staged.write(buckets.where("low < high"), "buckets")
    # Up to three members are known from these sums.
    third = F.col("odd").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    all_ = F.when(F.col("n") == 2, F.array("low", "high")).otherwise(F.array("low", "high", third))
    few = buckets.where("n <= 3").select(F.explode(all_).alias("k"), F.lit(None).cast("int").alias("b"), "key", "n", F.col("low").alias("leader"))
    more = buckets.where("n > 3").select(F.col("key").alias("_key"), "n", F.col("low").alias("leader"))
    rest = _among(banded, buckets.where("n > 3"), "key").join(more, F.col("key") == F.col("_key"))
    shared = few.unionByName(staged.write(rest.select("k", "b", "key", "n", "leader"), "members"))

    # Lines that repeat or share a bucket; one place of each of the latter brings its text.
    met = shared.select(F.col("k").alias("_k")).distinct()
    wanted = sketch.join(met, F.col("k") == F.col("_k"), "left").where("many or _k is not null")
    wanted = staged.write(wanted.select("k", F.when(F.col("_k").isNotNull(), F.col("mark")).alias("bearer")), "wanted")
    bearers = wanted.where("bearer is not null").select(F.col("k").alias("_k"), "bearer")
    texts = _among(lines.select("k", "mark", "line"), bearers.select(F.col("_k").alias("k")))
    texts = staged.write(texts.join(bearers, (F.col("k") == F.col("_k")) & (F.col("mark") == F.col("bearer"))).select("k", "line"), "texts")
    known = _links(sketch, shared, texts, staged)
    staged.drop(sketch, buckets, texts)
    held = _among(lines.select("id", "version", "at", "k"), wanted)
    # The first place of each component stays; of a line without links, its own first place.
    nodes = wanted.join(known, F.col("k") == F.col("node"), "left").select(F.col("k").alias("_k"), F.coalesce("component", "k").alias("c"))
    places = staged.write(held.join(nodes, F.col("k") == F.col("_k")).select("id", "version", "at", "c"), "places")
    # A place as one struct; nulls come first in structs, so that ids carry a sign of their own.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "version", "at")
    kept = places.groupBy("c").agg(F.min(place).alias("kept")).withColumnRenamed("c", "_c")
    gone = places.join(kept, F.col("c") == F.col("_c")).where(place != F.col("kept"))
    out = staged.write(gone.groupBy("id", "version").agg(F.collect_set("at").alias("removed")), "removed")
    staged.drop(wanted, lines, places)
    return out, staged


def without_repeats(docs: DataFrame, id_col: str, text_col: str, count: str) -> DataFrame:
    """dedup_lines with a name for the column of counts."""
    removed, staged = removed_lines(docs, id_col, text_col)
    version, key, numbers = common.fresh(docs, 3)
    left = docs.withColumn(version, F.xxhash64(docs[text_col]))
    right = removed.select(F.col("id").alias(key), F.col("version").alias(f"{version}_"), F.col("removed").alias(numbers))
    on = left[id_col].cast("long").eqNullSafe(right[key]) & (left[version] == right[f"{version}_"]) & left[text_col].isNotNull()
    joined = left.join(right, on, "left")
    none = F.coalesce(right[numbers], F.array().cast("array<int>"))
    lines = F.filter(F.split(left[text_col], "\n"), lambda _, at: ~F.array_contains(none, at))
    text = F.when(F.size(none) == 0, left[text_col]).otherwise(F.array_join(lines, "\n"))
    columns = [c for c in docs.columns if c != count]
    return staged.keep(joined.select(*[text.alias(c) if c == text_col else left[c] for c in columns], F.size(none).alias(count)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's repeated lines taken out, and n_removed (int): how many.

    Lines are compared in lower case and with white space folded; all that are not blank take part, those of fewer than WIDTH
    characters as one shingle. Of the lines of a component the one with the smallest (id, line number) stays, null ids last, so
    a document may end up with an empty text but is never dropped; blank lines and null texts stay as they are. Rows that repeat
    both id and text are one document and come out alike, once for each; rows of one id and different texts are told apart by
    the text's hash. An empty table gives no rows. Other columns pass through whatever their names, but for n_removed, which is
    replaced.
    """
    return without_repeats(docs, id_col, text_col, "n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat another document's or their own: doc_id, text, n_lines, n_removed."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return out.select("doc_id", "text", lines.alias("n_lines"), "n_removed")
