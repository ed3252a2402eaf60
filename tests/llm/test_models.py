"""The toxicity classifier, the Kneser-Ney model with its base rules, and the pipeline's stages."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.llm import kneser_ney, toxicity_cnn

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def corpus():
    rng = random.Random(3)
    part = ["ka", "lo", "mi", "ne", "tu", "so", "ri"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(1, 4)))
    rows = [(k, "\n".join(" ".join(word() for _ in range(12)) for _ in range(6)), "xx") for k in range(120)]
    rows += [(200, "".join(rng.choice("qzxjwvkbp#$%") for _ in range(9)) + " " + " ".join("".join(rng.choice("qzxjwvkbp0123#$") for _ in range(9)) for _ in range(80)), "xx")]
    rows += [(201, " ".join(["ka lo mi"] * 40), "xx"), (202, None, None), (203, "", "xx"), (204, "é ñ\tß\x0b# ü\nü\nü", "yy"), (205, " ".join(["w" * 40] * 4 + ["x" * 40]), "yy")]
    return rows


def test_quality(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, gram int")
    got = {r.doc_id: r for r in kneser_ney.quality(df).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(got[k].kept for k in range(120))
    assert not got[200].base_failed and not got[200].kept
    assert not any(got[k].kept for k in (201, 202, 203))
    assert got[203].log_perplexity is None
    assert kneser_ney.quality(df.limit(0)).count() == 0


def test_counts_cover_every_word(spark):
    df = spark.createDataFrame([("Ab ab",), ("ab\nc",), (None,)], "text string")
    got = {r.gram: r.n for r in kneser_ney.count_grams(df.repartition(3)).collect()}
    a, b, c = (int(kneser_ney.CLASS[ord(x)]) for x in "abc")
    code = lambda *s: sum(x << (6 * k) for k, x in enumerate(reversed(s)))
    # The second word of a text sees the last two classes of the first, and the space.
    assert got == {code(0, 0, 0, a): 2, code(0, 0, a, b): 2, code(0, a, b, 1): 3, code(a, b, 0, a): 1, code(b, 0, a, b): 1, code(a, b, 0, c): 1, code(b, 0, c, 1): 1}


def test_order_of_words_counts(spark):
    """Words whose end says how the next begins: the same words in another order are rejected, and scores equal a plain version."""
    rng = random.Random(9)
    follows = {x: "bcdfghjklm"[k] for k, x in enumerate("nopqrstuvw")}

    def running(n):
        out, begin = [], "b"
        for _ in range(n):
            end = rng.choice("nopqrstuvw")
            out.append(begin + "".join(rng.choice("aei") for _ in range(rng.randrange(1, 4))) + end)
            begin = follows[end]
        return out

    texts = [running(80) for _ in range(300)]
    shuffled = [rng.sample(t, len(t)) for t in texts[:15]]
    rows = [(k, " ".join(t), "en") for k, t in enumerate([*texts, *shuffled])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in kneser_ney.quality(df).collect()}
    assert sum(got[k].kept for k in range(300)) >= 0.98 * 300
    assert not any(got[k].kept for k in range(300, 315))
    counts = Counter()
    for _, t, _ in rows:
        counts.update(plain_grams(t))
    lm = kneser_ney.KneserNey(np.array([*counts]), np.array([*counts.values()]))
    for k in (0, 7, 301):
        grams = plain_grams(rows[k][1])
        assert np.isclose(got[k].log_perplexity, -lm.score(np.array(grams)).mean())


def plain_grams(text):
    out, past = [], (0, 0)
    for w in text.split():
        classes = [*(int(kneser_ney.CLASS[x]) for x in w.encode()), 1]
        for k in range(len(classes)):
            context = [*past, 0] if k == 0 else [past[1], 0, classes[0]] if k == 1 else [0 if k == 2 else classes[k - 3], classes[k - 2], classes[k - 1]]
            out.append(sum(x << (6 * (3 - j)) for j, x in enumerate([*context, classes[k]])))
        past = (classes[-3] if len(classes) > 2 else 0, classes[-2])
    return out


def test_model_is_a_distribution():
    rng = np.random.default_rng(2)
    words = [rng.integers(3, 12, rng.integers(1, 7)) for _ in range(400)]
    grams = Counter()
    for w in words:
        s = [0, 0, 0, *w.tolist(), 1]
        for k in range(len(s) - 3):
            grams[sum(x << (6 * (3 - j)) for j, x in enumerate(s[k : k + 4]))] += 1
    lm = kneser_ney.KneserNey(np.array([*grams]), np.array([*grams.values()]))
    for context in ((0, 0, 0), (0, 0, 5), (3, 4, 5), (11, 11, 11), (50, 50, 50)):
        head = sum(x << (6 * (2 - j)) for j, x in enumerate(context)) << 6
        assert np.isclose(np.exp(lm.score(head + np.arange(64))).sum(), 1, atol=1e-9)
    seen = lm.score(np.array([*grams]))
    assert np.average(seen, weights=[*grams.values()]) > np.log(1 / 64)


def toxic_rows(n=900):
    rng = random.Random(5)
    clean = ["".join(rng.choice("abcdefghi") for _ in range(5)) for _ in range(150)]
    rows = []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "scum", "trashy" + rng.choice("abcdefg")]))
        rows.append((k, " ".join(words), rng.choice(["en", "fr"]), y))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:3] for r in rows] + [(5000, None, "en"), (5001, "", None), (5002, "日本 12 ..", "ja"), (5003, "x" * 50000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity_cnn.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity_cnn.score(docs, net).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    held = {r[0] for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).select("doc_id").collect()}
    hits = [(got[k] >= 0.7) == bool(y) for k, _, _, y in rows if k in held]
    assert np.mean(hits) > 0.95
    assert got[5000] == got[5001] < 0.7
    assert toxicity_cnn.score(docs.limit(0), net).count() == 0
    again = toxicity_cnn.fit(docs.repartition(3), labels.repartition(2))
    assert np.allclose(again.weights, net.weights) and again.thresholds == net.thresholds


def test_network_is_not_trained_on_the_driver(spark, monkeypatch):
    rows = toxic_rows(60)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity_cnn, "_log_odds", None)  # tasks import the module anew
    assert toxicity_cnn.fit(docs, labels).weights.any()


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = toxic_rows(300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity_cnn.fit(docs, x) for x in (labels, other))
    assert np.array_equal(a.table, b.table) and a.scale == b.scale


def test_without_labels_every_score_is_the_prior(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    net = toxicity_cnn.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity_cnn.score(docs, net).first().score < 0.5


def test_score_does_not_depend_on_its_batch():
    texts = [r[1].encode() for r in toxic_rows(60)]
    net = toxicity_cnn.train(texts, np.array([r[3] for r in toxic_rows(60)]), ["en"] * 60, 0.25)
    together = net.score(toxicity_cnn._texts(texts))
    alone = np.concatenate([net.score(toxicity_cnn._texts([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert len(net.score(toxicity_cnn._texts([]))) == 0
    assert pa.array([]) is not None


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "lines", "duplicates", "packing"]
    quality = corpus_pipeline.quality(spark, docs, folder)
    want = {i for i, t in docs.select("doc_id", "text").collect() if not (base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0])}
    kept = {r.doc_id for r in quality.collect()}
    assert quality.columns == docs.columns and kept <= want and len(kept) > 0.7 * len(want)
    pieces = corpus_pipeline.packing(spark, quality, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_stage_lines_of_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    a, b, c = ([word() for _ in range(30)] for _ in range(3))
    rows = [(1, [a, b]), (2, [a[:9] + ["inserted"] + a[9:], c]), (3, [b[:9] + ["changed"] + b[10:]])]
    rows = [(k, "\n".join(map(" ".join, x)), "en", "s", 5) for k, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (rows[0][1], 5), 2: (" ".join(c), len(" ".join(c))), 3: ("", 0)}
