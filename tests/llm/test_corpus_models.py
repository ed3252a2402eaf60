"""The audit of sources against plain counting, and the language model against a plain version of its own formulas."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import common, maxent_lm, source_audit

LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_audit(rows, ranks):
    rows = [(lang or "", source or "", LETTER.findall(lower(text))) for _, text, lang, source in rows]
    docs, total, own, out = Counter(), Counter(), defaultdict(Counter), []
    for lang, source, terms in rows:
        own[lang, source].update(terms)
        total.update((lang, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    for lang, source in own:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 3]
        v, whole = len(kept), sum(total[lang, t] for t in kept)
        n = lambda s: sum(own[lang, s][t] for t in kept)  # noqa: B023, E731
        p = lambda s: {t: 1 + 10**9 * (own[lang, s][t] + 1) // (n(s) + v) for t in kept}  # noqa: B023, E731
        mine = p(source)
        value = {s: sum((mine[t] - q) ** 2 // q for t, q in p(s).items()) for x, s in own if x == lang and s != source}
        q = {t: 1 + 10**9 * (total[lang, t] + 1) // (whole + v) for t in kept}
        terms = {t: (mine[t] - q[t]) ** 2 // q[t] for t in kept if own[lang, source][t] and mine[t] > q[t]}
        for part, found, most in (("pair", value, None), ("term", terms, ranks)):
            best = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, f, k + 1) for k, (item, f) in enumerate(best)]
    return sorted(out)


def audited(spark, rows, ranks):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n int, term string").repartition(3)
    return sorted(tuple(r) for r in source_audit.source_audit(df, ranks).collect())


@pytest.mark.parametrize("ranks", [3, 200])
def test_audit_equals_plain_counts(spark, ranks):
    rng = random.Random(ranks)
    words = ["the", "The", "é", "Éa", "x" * 40, *(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300))]
    weights = lambda s: [1 / (1 + (k * (s + 3)) % 97) for k in range(len(words))]
    rows = [(k, " ".join(rng.choices(words, weights(s := rng.randrange(5)), k=rng.randrange(0, 70))) + " 12!", rng.choice(["en", "fr"]), f"s{s}") for k in range(160)]
    rows += [(500 + k, rows[3][1], "en", "s0") for k in range(30)]  # copies
    rows += [(600, None, None, None), (601, "", "", ""), (602, "rare once", "de", "s1"), (603, "other", "de", None), (604, None, "de", "s2"), (605, "the", "en", "lonely"), (605, "the", "en", "lonely"), (606, " ".join(rng.choices(words, k=3000)), "en", "s9"), (607, "", "fr", "empty")]
    assert audited(spark, rows, ranks) == plain_audit(rows, ranks)


def test_audit_of_empty_tables(spark):
    assert audited(spark, [(1, "a", "en", "s")] , 5) == []
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert source_audit.source_audit(df).count() == 0


def test_shares_are_exact(spark):
    rng = random.Random(1)
    cases = [(rng.randrange(10 ** rng.randrange(1, 15)), rng.randrange(1, 9 * 10**15)) for _ in range(300)]
    cases = [(min(c, w), w) for c, w in cases]
    want = [1 + 10**9 * (c + 1) // w for c, w in cases]
    assert source_audit.shares(np.array([c for c, _ in cases]), np.array([w for _, w in cases])).tolist() == want
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c long, w long")
    assert [r.s for r in df.select("k", source_audit.share(source_audit.F.col("c"), source_audit.F.col("w")).alias("s")).orderBy("k").collect()] == want


def corpus(n=500):
    """Two languages whose words follow their own kind, so that what stands before tells what comes."""
    rng = random.Random(2)
    one, two = ["the", "of", "and"] + [f"{a}{b}en" for a in "bcdf" for b in "aeiou"], ["la", "de", "que"] + [f"{a}{b}aux" for a in "lmnp" for b in "aeiou"]
    rows = []
    for k in range(n):
        words = one if rng.random() < 0.5 else two
        rows.append((k, " ".join(rng.choices(words, [6, 4, 3] + [1] * 20, k=rng.randrange(1, 60))) + rng.choice(["", ".", " Zz9#%d" % k])))
    return rows + [(1001, None), (1002, ""), (1003, " \n\t "), (1004, "unseen wordsé " * 3), (1005, "THE the\x0bOf"), (None, "the of"), (7, "la de"), (7, "la de"), (1006, " ".join(rng.choices(one, k=4000)))]


def test_scores_equal_plain_version(spark):
    """Counts, base score and score of every text, with most tokens outside of the head; the model beats the base on texts that
    it has not seen, and its probabilities add up to one."""
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, token string").repartition(3)
    staged = common.Staged(spark, "test")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    texts = [WORD.findall(lower(t)) for d, t in rows if not held(d)]
    count = Counter(w for t in texts for w in t)
    n, v = sum(count.values()) + len(texts), len(count) + 1
    model, rare, losses = maxent_lm.fit(staged, df.where(~maxent_lm.held_out(df.doc_id)).select("text"), head=20)
    assert (model.train_tokens, model.distinct, model.ends) == (n, v, len(texts))
    assert len(model.words) <= 20 and rare.count() == len(count) - len(model.words)
    assert losses[-1] < 0.9 * losses[0] and abs(losses[-1] - losses[len(losses) // 2]) < 0.02  # the prior is not part of it

    sign = lambda b: b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 29 + b % 3 if b > 127 else 28
    own = {w: 1 + k for k, w in enumerate(model.classes.own)}

    def kind(w):
        b = w.encode()
        return own.get(b) or int(25 + model.classes.endings[sign(b[-1]) * 32 + (sign(b[-2]) if len(b) > 1 else 0)])

    size = np.ones(maxent_lm.CLASSES)
    size[0] += len(texts)
    for w, c in count.items():
        size[kind(w)] += c + 1
    assert (size == model.size).all()
    table = maxent_lm.log_softmax(model.weights, np.arange(maxent_lm.CONTEXTS))
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-4)
    inside = Counter()
    for w, c in count.items():
        inside[kind(w)] += (c + 1) / size[kind(w)]
    assert all(math.isclose(x + 1 / size[k], 1) for k, x in inside.items())

    def plain(text):
        words = WORD.findall(lower(text))
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(texts) + 1) / (n + v + 1))
        kinds, score = [kind(w) for w in words] + [0], 0.0
        for k, c in enumerate(kinds):
            one, two = (kinds[k - j] if k >= j else 0 for j in (1, 2))
            last = next((x for x in reversed(kinds[:k]) if 1 <= x <= maxent_lm.OWN), 0)
            inner = (len(texts) + 1) / size[0] if c == 0 else (count[words[k]] + 1) / size[c]
            score += table[(last * maxent_lm.CLASSES + two) * maxent_lm.CLASSES + one, c] / math.log(10) + math.log10(inner)
        return len(words) + 1, sum(w in count for w in words) + 1, base, score

    got = maxent_lm.scores(df, model, rare, staged).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for d, t in rows:
        want[d].append((held(d), *plain(t)))
    for r in got:
        assert r.train_tokens == n
        assert any((r.held_out, r.n_tokens, r.n_known) == w[:3] and math.isclose(r.base_score, w[3], abs_tol=1e-6) and math.isclose(r.score, w[4], abs_tol=1e-3 * r.n_tokens) for w in want[r.doc_id]), (r, want[r.doc_id])
    out = [r for r in got if r.held_out]
    assert len(out) > 40 and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_scores_without_training_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert maxent_lm.lm_scores(empty).count() == 0
    unseen = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (r,) = maxent_lm.lm_scores(spark.createDataFrame([(unseen, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_table_of_contexts_is_made_in_its_own_size():
    ends = np.arange(maxent_lm.FORMS) % maxent_lm.ENDINGS
    weights = np.random.default_rng(1).normal(0, 1, (maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    model = maxent_lm.Model(maxent_lm.Classes((), ends), weights, np.ones(maxent_lm.CLASSES, np.int64), pa.array([b"a"], pa.binary()), np.ones(1, np.int64), 1, 1, 1)
    tracemalloc.start()
    _, table = maxent_lm._loaded(-1, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    maxent_lm._LOADED.clear()
    assert peak < 2 * table.nbytes and np.allclose((10.0 ** table[:1000]).sum(1), 1, atol=1e-4)
