"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on a bounded sample of labels.

A word's embedding is the sum of the rows that its whole form and its first 3 to 8 bytes hash to. Filters of several widths
run over the words of a whole text, each keeps its largest response, and a logistic layer weighs them. Thresholds are
calibrated for each language; a score depends on the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pieces import _LOWER, _MASKS, PAD, distinct, passes, text_bytes

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
PREFIXES = range(3, 9)
#: Bounds of the training sample: texts of each class, and the bytes of a text that may be drawn.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2500, 4000, 16384
#: Sample texts that are handled at once outside of training steps.
CHUNK = 100
_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MAX = max(WIDTHS)


def _mix(values: np.ndarray, kind: int) -> np.ndarray:
    v = (values + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    return (v >> np.uint64(47)).astype(np.int32)  # 17 bits: BUCKETS


@dataclass
class Texts:
    """Words of some texts: the hashed features of each distinct word (BUCKETS: none), and for each text its words'
    numbers followed by _MAX empty ones (number len(features) - 1). at: where texts begin; ends: where their last window
    begins, and one more. A window that begins before that end stays inside of its own text and its empty words."""

    features: np.ndarray
    words: np.ndarray
    at: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offsets: np.ndarray) -> Texts:
        n = int(offsets[-1])
        buf = np.append(_LOWER[buf[:n]], np.zeros(PAD, np.uint8))
        inside, edge = _WORD[buf[:n]], np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.append(False, inside[:-1]) if n else inside
        after = np.append(inside[1:] & ~edge[1:n], False) if n else inside
        starts, ends = np.flatnonzero(inside & (~before | edge[:n])), np.flatnonzero(inside & ~after) + 1
        codes, first = distinct(buf, starts, ends)
        a, length = starts[first], np.minimum(ends[first] - starts[first], 32)
        load = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))
        features = np.full((len(first) + 1, 1 + len(PREFIXES)), BUCKETS, np.int32)
        whole = np.zeros(len(first), np.uint64)
        for k in range(4):
            whole = (whole ^ (load[np.minimum(a + 8 * k, len(load) - 1)] & _MASKS[k][length])) * np.uint64(0x9E3779B97F4A7C15)
            whole ^= whole >> np.uint64(31)
        features[:-1, 0] = _mix(whole, 1)
        head = load[np.minimum(a, len(load) - 1)] if len(a) else whole
        for k, size in enumerate(PREFIXES):
            features[:-1, 1 + k] = np.where(length >= size, _mix(head & _MASKS[0][size], size), BUCKETS)
        counts = np.diff(np.searchsorted(starts, offsets))
        at = np.append(0, np.cumsum(counts + _MAX))
        words = np.full(int(at[-1]), len(first), np.int64)
        words[np.repeat(at[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(codes))] = codes
        return cls(features, words, at, at[:-1] + np.maximum(counts, 1))


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def pooled(self, t: Texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each width the largest responses of each text's filters."""
        embedded = self.table[t.features].sum(1, dtype=np.float32)
        out, responses = [], []
        for width, kernel, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            taps = [embedded @ kernel[k] for k in range(width)]
            response = taps[0][t.words]
            for k in range(1, width):
                response[:-k] += taps[k][t.words[k:]]
            top = np.maximum.reduceat(response, np.stack([t.at[:-1], t.ends], 1).ravel(), axis=0)[::2]
            out.append(np.maximum(top + bias, 0))
            responses.append(response)
        return out, responses

    def logit(self, t: Texts) -> np.ndarray:
        if len(t.at) < 2:
            return np.zeros(0)
        return np.concatenate(self.pooled(t)[0], 1) @ self.weights + self.offset

    def score(self, t: Texts) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logit(t) + b, -40, 40)))


def _texts(texts: list[bytes]) -> Texts:
    buf, offsets = text_bytes(pa.array(texts, pa.binary()).cast(pa.string()))
    return Texts.of(buf, offsets)


def train(texts: list[bytes], labels: np.ndarray, langs: list[str], prior: float, epochs: int = 6, seed: int = 7) -> Network:
    """The network from a sample; prior: the share of label 1 among all labels that may be used.

    Three fifths of the sample give the embeddings' first dimension (log odds of a text with that feature), a fifth the
    gradients, and after it the log odds too. The last fifth is left out of all of that: it calibrates the scores and the
    thresholds of the network as it is returned.
    """
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS + 1, DIM), np.float32)
    table[:-1, 1:] = rng.normal(0, 0.01, (BUCKETS, DIM - 1))
    filters = [rng.normal(0, 0.05, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, ::2] += 0.5
    net = Network(table, filters, [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.05, np.float32), offset=-1.0)
    fold = rng.permutation(len(texts)) % 5
    if len(set(labels.tolist())) < 2 or min(np.bincount(fold, minlength=5)) < 2:
        net.weights[:] = 0  # nothing to learn from: every score is the prior
        net.offset = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return net

    first = _log_odds(texts, labels, np.flatnonzero(fold < 3))
    net.table[:, 0] = first
    net.table[-1] = 0

    params = [net.weights, *net.filters, *net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    held = np.flatnonzero(fold == 3)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(held)
        for k in range(0, len(order), 128):
            batch = order[k : k + 128]
            t, y, step = _texts([texts[i] for i in batch]), labels[batch], step + 1
            tops, responses = net.pooled(t)
            x = np.concatenate(tops, 1)
            p = 1 / (1 + np.exp(-np.clip(x @ net.weights + net.offset, -30, 30)))
            err = ((p - y) * weight[batch] / len(batch)).astype(np.float32)
            net.offset -= 0.05 * float(err.sum())
            grads = [x.T @ err + 1e-4 * net.weights]
            back = err[:, None] * net.weights
            embedded = net.table[t.features].sum(1, dtype=np.float32)
            by_filter, by_bias = [], []
            doc = np.repeat(np.arange(len(batch)), np.diff(t.at))
            for w, (width, top, response) in enumerate(zip(WIDTHS, tops, responses, strict=True)):
                g = back[:, w * FILTERS : (w + 1) * FILTERS] * (top > 0)
                reached = (response + net.bias[w] >= top[doc]) & (np.arange(len(doc)) < t.ends[doc])[:, None]
                grad = np.zeros_like(net.filters[w])
                for f in range(FILTERS):
                    at = np.flatnonzero(reached[:, f])
                    at = at[np.append(True, np.diff(doc[at]) > 0)] if len(at) else at  # the first of equals
                    up = g[doc[at], f]
                    for j in range(width):
                        words = t.words[np.minimum(at + j, len(t.words) - 1)]
                        grad[j, :, f] += embedded[words].T @ up
                        np.add.at(net.table, t.features[words].ravel(), np.repeat(-0.02 * up[:, None] * net.filters[w][j, :, f], t.features.shape[1], 0))
                by_filter.append(grad)
                by_bias.append(g.sum(0))
            net.table[-1] = 0
            for p_, (m, v), g in zip(params, moments, [*grads, *by_filter, *by_bias], strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= 0.02 / (1 + epoch) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    # From now on the log odds are those of all texts but the ones that calibrate.
    second = _log_odds(texts, labels, np.flatnonzero(fold < 4))
    net.table[:, 0] += second - first
    net.table[-1] = 0
    held = np.flatnonzero(fold == 4)
    z, y = np.concatenate([net.logit(_texts([texts[i] for i in held[k : k + CHUNK]])) for k in range(0, len(held), CHUNK)]), labels[held]
    share = max(y.mean(), 1e-6)
    w = np.where(y == 1, prior / share, (1 - prior) / max(1 - share, 1e-6))
    net.scale = _platt(z, y, w)
    s = 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -40, 40)))
    net.threshold = _best(s, y, w)
    own = np.array([langs[i] or "" for i in held])
    for lang in sorted(set(own.tolist())):
        here = own == lang
        if min(y[here].sum(), (1 - y[here]).sum()) >= 10:
            net.thresholds[lang] = _best(s[here], y[here], w[here])
    return net


def _log_odds(texts: list[bytes], labels: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log odds of label 1 for texts with each feature; a feature of one or two texts says nothing."""
    y = labels[which]
    pos, neg = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for k in range(0, len(which), CHUNK):
        part = which[k : k + CHUNK]
        t = _texts([texts[i] for i in part])
        doc = np.repeat(np.arange(len(part)), np.diff(t.at))
        seen = np.unique((doc[:, None] * np.int64(BUCKETS + 1) + t.features[t.words]).ravel())
        toxic = labels[part][seen // (BUCKETS + 1)] == 1
        pos += np.bincount(seen[toxic] % (BUCKETS + 1), minlength=BUCKETS + 1)
        neg += np.bincount(seen[~toxic] % (BUCKETS + 1), minlength=BUCKETS + 1)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    return np.where(pos + neg > 2, np.clip(odds, -1, 5), 0).astype(np.float32)


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with a little shrinkage so that separable data stay finite."""
    theta, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 0.05 * (theta - [1.0, 0.0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return (max(0.05, float(theta[0])), float(theta[1]))


def _best(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The threshold with the highest F1, in the middle of the gap to the next score below."""
    order = np.argsort(-s)
    hit, miss = np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + (w * y).sum())
    k = int(f1.argmax())
    below = s[order[k + 1]] if k + 1 < len(s) else 0.0
    return float(min(0.9, max(0.1, (s[order[k]] + below) / 2)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, float]:
    """At most SAMPLE_TOXIC and SAMPLE_CLEAN labelled texts of up to SAMPLE_BYTES, drawn by a hash of the id from ids whose
    crc32 mod 3 isn't 1; and the share of label 1 among all such ids."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    size = docs.where(F.octet_length(text_col).between(1, SAMPLE_BYTES)).select(docs[id_col].alias("doc_id"))
    usable = usable.join(size.distinct(), "doc_id", "left_semi")
    share = usable.agg(F.avg("y")).first()[0] or 0.0
    drawn = [usable.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    texts = docs.where(F.octet_length(text_col).between(1, SAMPLE_BYTES)).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", F.encode("text", "UTF-8").alias("text"), "lang", "y"), float(share)


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Network:
    """The network for docs, from the bounded sample of labelled texts alone.

    Null and empty texts, null ids and null labels teach nothing; of rows with one id one is taken, and a label is the highest
    of an id's. Without labels of both kinds every score is the share of label 1. Other columns aren't read.
    """
    rows, prior = sample(docs, labels, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        net = train([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64), [r["lang"] or "" for r in rows], prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    common.ship(docs.sparkSession)
    made = rows.repartition(1).mapInArrow(run, "net binary").collect()  # no partition at all, if the sample is known to be empty
    return pickle.loads(made[0]["net"]) if made else train([], np.zeros(0, np.int64), [], prior)


def with_score(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text under a new name; rows and all other columns pass through as they are.

    Null and empty texts get the score of a text without words; repeated rows and null ids stay; an empty table gives no rows.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    common.ship(docs.sparkSession)
    held, place = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)  # BUCKETS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            buf, offsets = text_bytes(b.column(place))
            parts = [net.score(Texts.of(np.append(buf[offsets[x] : offsets[y]], np.zeros(PAD, np.uint8)), offsets[x : y + 1] - offsets[x])) for x, y in passes(offsets)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; cases as in with_score."""
    thin = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return with_score(thin, net).select(F.col("id").alias(id_col), "score")


def thresholds(net: Network, lang: F.Column) -> F.Column:
    """The calibrated threshold of a language, and the common one for languages without enough labels."""
    out = F.lit(net.threshold)
    for k, v in net.thresholds.items():
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learnt from ids whose crc32 mod 3 isn't 1."""
    common.bounded_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
