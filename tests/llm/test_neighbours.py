"""Near duplicates of vectors, texts and lines, components, sharding: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bayes_jaccard, components, e8_neardup, grouping, kd_shards, line_dedup


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 260)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_lattice_point():
    x = np.random.default_rng(3).normal(size=(300, 8)) * 2
    p = e8_neardup.nearest(x)
    assert np.allclose((2 * p) % 1, 0) and np.allclose(p.sum(1) % 2, 0) and (((2 * p) % 2).std(1) == 0).all()
    assert (((x - p) ** 2).sum(1) <= ((x[:, None] - (p[:, None] + e8_neardup.ROOTS)) ** 2).sum(2).min(1) + 1e-9).all()
    assert len(e8_neardup.ROOTS) == 240 and np.allclose((e8_neardup.ROOTS**2).sum(1), 2)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 64)) * 0.2, base[:5], base[:1].repeat(30, 0) + rng.normal(size=(30, 64)) * 0.15]).astype(np.float32)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [None] + [1.0] * 63, 1), (904, [float("inf")] * 64, 1), (905, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, id int")
    got = {r.vec_id: r for r in e8_neardup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = roots(range(len(u)), zip(*np.nonzero(near), strict=True))
    assert [got[k].n_links for k in range(len(u))] == near.sum(1).tolist()
    assert [got[k].component_id for k in range(len(u))] == [want[k] for k in range(len(u))]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[k].n_links == 0 and got[k].component_id == k for k, *_ in bad)
    assert e8_neardup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_a_cell_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(e8_neardup, "BLOCK", 4)
    rng = np.random.default_rng(6)
    x = (np.ones((25, 64)) + rng.normal(size=(25, 64)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {r.n_links for r in e8_neardup.near_duplicates(df).collect()} == {24}


def texts(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(rng.randrange(40, 90))] for _ in range(25)]
    out = [" ".join(b) for b in base]
    for b in base[:12]:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randrange(0, 3)):
                c[rng.randrange(len(c))] = word()
            out.append(" ".join(c))
    out += [out[0], out[0].upper(), "", None, " \n ", "one two", "one two", "ONE  two", "a b c d e", "a b c d e f"]
    return out


def shingle_sets(rows):
    out = []
    for t in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(bayes_jaccard, "BLOCK", block)
    rows = texts()
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in enumerate(rows)], "doc_id long, text string, key string, size int")
    sets = shingle_sets(rows)
    edges = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = roots(range(len(sets)), edges)
    got = {r.doc_id: r for r in bayes_jaccard.jaccard_join(df).collect()}
    assert len(got) == len(rows)
    assert {k: r.n_links for k, r in got.items()} == {k: sum(a == k for a, _ in edges) for k in got}
    assert {k: r.class_id for k, r in got.items()} == want
    assert bayes_jaccard.jaccard_join(df.limit(0)).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    join = bayes_jaccard.Join()
    needed = join.needed()
    assert needed == sorted(needed) and needed[-1] < 80
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (500, join.hashes), np.uint16)
    b = np.where(rng.random((500, join.hashes)) < 0.85, a, a + 1).astype(np.uint16)
    i = np.arange(500)
    assert len(join.candidates(a, b, i, i)) >= 499
    assert len(join.candidates(a, a[::-1].copy(), i, i)) == 0


def test_overlap_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(9)]
    at = np.append(0, np.cumsum([len(s) for s in sets]))
    i, j = np.triu_indices(9, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    for size in (32 << 20, 64):
        monkeypatch.setattr(bayes_jaccard, "BITSET_BYTES", size)
        assert bayes_jaccard._overlap(np.concatenate(sets), at, i, j).tolist() == want


def test_groups_and_pairs():
    import pyarrow as pa

    keys = np.repeat([1, 2, 5, 7], [3, 1, 6, 2])
    batches = pa.Table.from_pydict({"k": keys, "v": np.arange(12)}).to_batches(max_chunksize=2)
    tables = list(grouping.whole_groups(iter(batches), ("k",), 3))
    assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(12))
    assert sum(len(set(t.column("k").to_pylist())) for t in tables) == 4
    got = [(a, b) for i, j in grouping.pairs(grouping.bounds([keys]), 4) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert got == [(a, b) for a in range(12) for b in range(a + 1, 12) if keys[a] == keys[b]]


def test_lines(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(40)]
    near = passage[:20] + [word()] + passage[21:]
    unique = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = [
        (1, "\n".join([unique[0], " ".join(passage), "short line", unique[1]])),
        (2, "\n".join([unique[2], " ".join(near), "short line"])),
        (3, " ".join(passage).upper() + "\n" + unique[3]),
        (4, "\n".join([unique[4], unique[4], "", ""])),
        (5, " ".join(passage)),
        (6, None),
        (7, ""),
        (8, unique[5]),
    ]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, removed string, k int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed"]
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got == {
        1: (rows[0][1], 0),
        2: (unique[2], 2),
        3: (unique[3], 1),
        4: (unique[4] + "\n\n", 1),
        5: ("", 1),
        6: (None, 0),
        7: ("", 0),
        8: (unique[5], 0),
    }
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def windows(line, n=9):
    return {line[k : k + n] for k in range(max(1, len(line) - n + 1))}


def jaccard(a, b):
    return len(windows(a) & windows(b)) / len(windows(a) | windows(b))


def removed(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {r.doc_id for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()}


def test_recall_of_near_lines(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows, kinds = [], {"substituted": [], "inserted": []}
    for kind, found in kinds.items():
        while len(found) < 300:
            a = [word() for _ in range(rng.randrange(12, 60))]
            b, at = list(a), rng.randrange(len(a))
            b[at : at + (kind == "substituted")] = [word()]
            a, b = " ".join(a), " ".join(b)
            if 0.8 <= jaccard(a, b) <= 0.95:
                found.append(len(rows) + 1)
                rows += [a, b]
    gone = removed(spark, rows)
    assert all(k % 2 for k in gone)
    for found in kinds.values():
        assert len(gone & set(found)) >= 0.98 * len(found)


def test_lines_without_spaces(spark):
    rng = random.Random(12)
    url = ["https://www.example.org/" + "".join(rng.choice("abcdefghij/") for _ in range(60)) for _ in range(6)]
    han = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80)) for _ in range(3)]
    odd = ["\u2028".join("abcdefgh"[k : k + 3] * 2 for k in range(j, j + 5)) for j in (0, 1)]
    near = [url[0][:-1] + "#", han[0][:70] + han[0][69:], han[0][:40] + han[1][40:], "短" * 8, "長" * 8, "x" * 24 + url[1]]
    rows = url + han + odd + near
    want = {b for b in range(len(rows)) if any(jaccard(rows[a], rows[b]) >= 0.8 for a in range(b))}
    assert removed(spark, rows) == want == {11, 12, 16}


def test_line_of_many_words(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40000)]
    assert removed(spark, [" ".join(words), " ".join(words[:100] + ["other"] + words[100:]), " ".join(words[:20000])]) == {1}


def test_lines_of_repeated_and_unnamed_documents(spark):
    rows = [(1, "some line\nown line of one"), (1, "some line\nown line of one"), (1, "some line\nanother text"), (None, "some line"), (None, "last"), (0, "  \n\nlast")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, added0_0 int, n_removed int, __id int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "added0_0", "__id", "n_removed"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_removed) for r in out.collect())
    first = next(t for i, t, n in got if i == 1 and n == 0)
    assert "some line" in first and len(got) == len(rows)
    one = [(t, n) for i, t, n in got if i == 1]
    assert one.count(("some line\nown line of one", 0)) in (0, 2) and sum(n for _, n in one) in (1, 2)
    assert [x for x in got if x[0] < 1] == [(-1, "", 1), (-1, "", 1), (0, "  \n\nlast", 0)]


def test_lines_that_share_a_bucket(spark):
    """One passage in very many variants: pairs stay in proportion, no line below the threshold goes, nearly all above do."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    base, rows = [word() for _ in range(12)], []
    for _ in range(500):
        b = list(base)
        b[rng.randrange(len(b))] = word()
        rows.append(" ".join(b))
    rows = list(dict.fromkeys(rows))
    links = [(a, b) for b in range(len(rows)) for a in range(b) if jaccard(rows[a], rows[b]) >= 0.8]
    root = list(range(len(rows)))
    for _ in range(20):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {b for b in range(len(rows)) if root[b] != b}
    gone = removed(spark, rows)
    assert gone <= want and len(gone) >= 0.95 * len(want)


def test_lines_of_open_buckets_are_compared_completely(spark):
    """A thousand variants of one line at either side of the threshold: every line goes that brute force removes, and no other."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    base, rows = [word() for _ in range(20)], []
    for _ in range(1000):
        b = list(base)
        for _ in range(rng.choice((1, 2))):
            b[rng.randrange(len(b))] = word()
        rows.append(" ".join(b))
    rows = list(dict.fromkeys(rows))
    sets, first = [windows(r) for r in rows], list(range(len(rows)))
    for b in range(len(rows)):
        near = {first[a] for a in range(b) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
        if near:
            first[: b + 1] = [min(near) if x in near or x == b else x for x in first[: b + 1]]
    assert removed(spark, rows) == {b for b in range(len(rows)) if first[b] != b}


def test_small_bitmaps_lose_no_line(spark, monkeypatch):
    """With one word for all shingles bitmaps prove little, and the links are the same."""
    monkeypatch.setattr(line_dedup, "WORDS", 1)
    test_lines_that_share_a_bucket(spark)


def test_bitmaps_rule_out_lines_before_texts_are_read(spark, monkeypatch):
    """Pairs that share a bucket and are far below the threshold aren't verified; of those above it one shares no bucket."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for changed in [8] * 60 + [1] * 10:
        a = [word() for _ in range(30)]
        at = set(rng.sample(range(30), changed))
        rows += [" ".join(a), " ".join(word() if k in at else w for k, w in enumerate(a))]
    verified, seen = line_dedup._verified, []
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts: seen.append(pairs.count()) or verified(pairs, texts))
    assert {b for b in range(1, len(rows), 2) if jaccard(rows[b - 1], rows[b]) >= 0.8} == set(range(121, 140, 2))
    assert removed(spark, rows) == set(range(121, 140, 2)) - {127}
    assert sum(seen) <= 15


def test_white_space_of_lines_is_folded(spark):
    line = "one line with\ttabs and  spaces"
    assert removed(spark, [line, " ".join(line.split()) + "\r", "\t" + line.upper(), "another line of some words"]) == {1, 2}


def test_shards(spark):
    rng = random.Random(8)
    rows = [(k, "w" * rng.randrange(0, 200) + str(rng.randrange(10**6)) + "\n" * rng.randrange(5)) for k in range(600)] + [(600 + k, "copy") for k in range(10)] + [(700, None), (701, ""), (702, "é" * 50)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    got = kd_shards.kd_shards(df, shards=8).collect()
    assert len(got) == len(rows)
    size, shard_of = [0] * 8, {}
    text = dict(rows)
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 1
        size[r.shard] += r.size
        shard_of.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert max(size) - min(size) < 0.05 * sum(size) / 8 * 2
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    some = kd_shards.kd_shards(df, target_bytes=20000)
    assert some.select(F.max("shard")).first()[0] + 1 == -(-sum(size) // 20000)
    assert kd_shards.kd_shards(df.limit(0), shards=4).count() == 0
    assert {r.shard for r in kd_shards.kd_shards(df.where("doc_id >= 600 and doc_id < 610"), shards=4).collect()} <= {0, 1, 2, 3}
