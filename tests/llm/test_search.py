"""Ranked search over wavelet trees against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import wavelet_search as ws

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n, size = sum(map(bool, counts)), [sum(c.values()) for c in counts]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, s in zip(docs, counts, size, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * s * n // sum(size)))) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Of", "É", "été", "a1", "x" * 50, "日本", *(f"w{k}" for k in range(60))]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(1, 60))) + rng.choice(["", "\n", "!\0?"]) for _ in range(n)]


@pytest.mark.parametrize("most", [(1 << 20, 1 << 16), (300, 1 << 16), (1 << 20, 7)])
def test_equals_plain_scores(spark, most):
    """Any size of shards; copies with equal scores, null, empty and long texts, null and repeated ids, clashing columns."""
    body = texts(1, 150)
    docs = [(k, t) for k, t in enumerate(body)] + [(1000 + k, body[3]) for k in range(40)] + [(2, body[9]), (2, body[9]), (None, body[5]), (None, body[5]), (77, None), (78, ""), (79, " ,.")]
    docs.append((5000, " ".join(texts(2, 2000))))
    items = [(k, t) for k, t in enumerate(texts(3, 25))] + [(100, None), (101, ""), (102, "unheardof"), (103, "the the the OF of"), (104, body[3]), (None, "w5")]
    ws.common.bounded_batches(spark, records=20)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, term string").repartition(3)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ws.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()), key=repr)
    assert got == plain(docs, items, 10)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ws, "BLOCK_BYTES", 300)
    docs, items = list(enumerate(texts(4, 60))), list(enumerate(texts(5, 12)))
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ws.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3).collect()), key=repr)
    assert got == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ws.ranked_search(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert ws.ranked_search(one, items).count() == 0
    assert ws.ranked_search(one.withColumn("text", ws.F.lit(None).cast("string")), one.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_tree_counts_and_opens_few_nodes():
    """Ranks equal plain counts, and a search for rare terms opens a small part of the tree."""
    rng = np.random.default_rng(1)
    docs = rng.integers(0, 4096, 20000)
    tree = ws.Tree(ws.tree_bits(docs, 12).tobytes(), np.ones(20000, np.uint32).tobytes(), 12)
    at = rng.integers(0, 20001, 50)
    bit = docs >> 11 & 1
    assert tree.ones(np.zeros(50, np.int64), at).tolist() == [int(bit[:a].sum()) for a in at]
    opened, ones = 0, tree.ones

    def counted(level, at):
        nonlocal opened
        opened += len(at)
        return ones(level, at)

    tree.ones = counted
    impacts = np.sort(rng.integers(1, 1000, 4096))[::-1].astype(np.uint32)
    tree = ws.Tree(ws.tree_bits(np.concatenate([rng.permutation(4096), [7, 9]]), 12).tobytes(), np.append(impacts, [900, 800]).astype(np.uint32).tobytes(), 12)
    ones, tree.ones = tree.ones, counted
    score, found = tree.best(np.array([0, 4096]), np.array([4096, 4098]), np.array([1, 1000]), 2)
    assert sorted(found.tolist()) == [7, 9] and (score > 800_000).all()
    assert opened < 2 * 12 * ws.STEP
