import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.functions.features import archetype_sql, cosine
from cadenza.operators import evaluation, matching, profiles, quality, recommend, statistics, transforms
from cadenza.schema import FEATURES, VECTOR
from cadenza.sources import files
from cadenza.sources.buckets import Buckets


def raw(spark, rows):
    base = {"track_popularity": "80", "track_album_id": "alb_1", "track_album_name": "Album", "playlist_name": "Hits", "playlist_id": "pl_1", "playlist_genre": "pop", "playlist_subgenre": "dance pop", "duration_ms": "200000"}
    base |= {f: "0.5" for f in FEATURES} | {"key": "6", "mode": "1", "loudness": "-4.5", "tempo": "120"}
    full = [base | r for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in files.RAW.names) for r in full], files.RAW).withColumn("source_row", F.monotonically_increasing_id())


def test_clean_and_star(spark):
    df = raw(
        spark,
        [
            {"track_id": "track_1", "track_name": "Song One", "track_artist": "A", "track_album_release_date": "2019-06-14"},
            {"track_id": "track_2", "track_name": "Two", "track_artist": "B", "track_album_release_date": "2018"},
            {"track_id": "track_3", "track_name": "Three", "track_artist": "nan", "track_album_release_date": "2015-05"},
            {"track_id": "track_5", "track_name": " Song Five ", "track_artist": "A", "track_album_release_date": "2015-05", "track_popularity": "bad", "energy": "bad"},
            {"track_id": "track_5", "track_name": "later", "track_artist": "A", "track_album_release_date": "odd", "playlist_id": "pl_2"},
        ],
    )
    rows = {(r.track_id, r.playlist_id): r for r in transforms.clean(df).collect()}
    assert len(rows) == 4
    two, five = rows["track_2", "pl_1"], rows["track_5", "pl_1"]
    assert (two.release_date, two.release_year, two.release_month, two.release_decade) == ("2018-01-01", 2018, 1, "2010s")
    assert (five.track_name, five.release_date, five.release_month, five.track_popularity, five.energy) == ("Song Five", "2015-05-01", 5, 0, None)
    assert (five.duration_min, five.duration_category) == (3.33, "Medium (2.5-3.5m)")
    assert rows["track_5", "pl_2"].release_year is None
    tables = transforms.star(transforms.clean(df), "source_row")
    assert {t: n.count() for t, n in tables.items()} == {"genres": 1, "artists": 2, "albums": 1, "tracks": 3, "audio_features": 3, "playlist_tracks": 4}
    assert {r.artist_name: r.artist_id for r in tables["artists"].collect()} == {"A": 1, "B": 2}
    assert [r.track_name for r in tables["tracks"].where("track_id = 'track_5'").collect()] == ["Song Five"]
    assert {r.column: r.outside for r in quality.violations(transforms.clean(df)).collect()}["energy"] == 0
    assert {r.column: r.nulls for r in quality.profile(df).collect()}["track_id"] == 0


def test_distribution_of_outliers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40, 50, 1000)] + [("b", 1.0)], "g string, x double")
    r = {x.g: x for x in statistics.distribution(df, "g", "x").collect()}
    assert (r["a"].n, r["a"].p50, r["a"].outliers) == (6, 35.0, 1)
    assert r["a"].skewness > 1
    assert r["b"]["std"] is None and r["b"].skewness is None


def test_p_values():
    assert math.isclose(statistics.p_kruskal(3.841459, 2), 0.05, abs_tol=1e-6)
    assert math.isclose(statistics.p_anova(4.256495, 3, 12), 0.05, abs_tol=1e-6)
    assert math.isclose(statistics.p_correlation(0.6319, 10), 0.05, abs_tol=1e-4)
    assert statistics.p_anova(None, 2, 40) == 0.0


def test_text(spark):
    row = spark.createDataFrame([("Café (Live) - feat. X", "The  Beatles!", "a b", "", "Dance Pop")], "a string, b string, c string, d string, e string").select(
        text.normalized(F.col("a")).alias("n"), text.without_suffixes(F.col("a")).alias("v"), text.artist(F.col("b")).alias("t"), text.dice(F.col("c"), F.col("c")).alias("same"), text.dice(F.col("c"), F.col("d")).alias("none"), text.genre_class(F.col("e")).alias("g")
    ).first()
    assert (row.n, row.v, row.t, row.same, row.none, row.g) == ("caf live feat x", "caf", "beatles", 1.0, 0.0, "edm")


def test_matching_stages_and_ties(spark):
    tracks = spark.createDataFrame(
        [("1", "Hello World", "The Band", "First", 200000, 2001, 50), ("2", "Twice", "Duo", "X", 100000, 2000, 40), ("3", "Twice", "Duo", "Y", 105000, 1999, 40), ("4", "Same", "Duo", "Z", 1, 2000, 1), ("5", "Same", "Duo", "Z", 1, 2000, 1)],
        "track_id string, track_name string, artist_name string, album_name string, duration_ms int, release_year int, track_popularity int",
    )
    records = spark.createDataFrame(
        [(1, "1", "zzz", "", None, None), (2, None, "HELLO, world!", "the band", None, None), (3, None, "Hello World (Remix)", "Band", None, None), (4, None, "Twice", "Duo", "Y", None), (5, None, "Twice", "Duo", None, 107999), (6, None, "Twice", "Duo", None, None), (7, None, "Helo World", "Band", None, None), (8, None, "Same", "Duo", None, None), (9, None, "Else", None, None, None)],
        "record_id int, outside_id string, track_name string, artist_name string, album_name string, duration_ms int",
    )
    got = {r.record_id: (r.track_id, r.match_status, r.matching_method) for r in matching.match(records, tracks).collect()}
    assert got == {
        1: ("1", "matched", "exact_id"),
        2: ("1", "matched", "normalized_exact"),
        3: ("1", "matched", "variant_normalized"),
        4: ("3", "matched", "normalized_exact"),
        5: ("3", "matched", "normalized_exact"),
        6: ("3", "ambiguous", "normalized_exact"),  # the earliest year is a guess
        7: ("1", "matched", "fuzzy_trigram"),
        8: ("4", "ambiguous", "normalized_exact"),
        9: (None, "unmatched", "none"),
    }


def catalog(spark, n=40):
    rng = np.random.default_rng(0)
    rows = [(i, f"artist {i % 7}", i % 100, [("g%d" % (i % 3))], rng.normal(size=9).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "track_id long, artist_name string, track_popularity int, genres array<string>, vector array<double>")


def test_recommendations_exclude_seeds_and_keep_order(spark):
    tracks = catalog(spark)
    seeds = spark.createDataFrame([(1, 3, 1.0), (1, 5, 2.0), (1, 999, 1.0)], "user_id int, track_id long, weight double")
    users = recommend.user_vectors(seeds, tracks.select("track_id", "vector")).withColumnRenamed("vector", "user_vector")
    rows = recommend.candidates(users, tracks, seeds.select("user_id", "track_id"), 20).orderBy("position").collect()
    assert len(rows) == 20 and not {r.track_id for r in rows} & {3, 5}
    assert all(a.similarity >= b.similarity for a, b in zip(rows, rows[1:], strict=False))
    ranked = spark.createDataFrame([(1, r.track_id, r.artist_name, r.genres, r.vector, (r.similarity + 1) / 2) for r in rows], "user_id int, track_id long, artist_name string, genres array<string>, vector array<double>, relevance double")
    chosen = recommend.diverse(ranked, 10).orderBy("rank").collect()
    assert [r.rank for r in chosen] == list(range(1, 11)) and chosen[0].track_id == rows[0].track_id
    names = {r.track_id: r.artist_name for r in rows}
    assert max(sum(names[c.track_id] == a for c in chosen) for a in names.values()) <= 2


def test_scaler_and_projection(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 9)) @ rng.normal(size=(9, 9))
    df = spark.createDataFrame(x.tolist(), list(VECTOR))
    s = recommend.Scaler.fit(df)
    z = np.array([r[0] for r in df.select(s.vector()).collect()])
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0), 1)
    p = recommend.Projection.fit(df, s)
    want = np.linalg.eigvalsh(np.cov(z.T, ddof=0))[::-1]
    assert np.allclose(p.ratios, (want / want.sum())[: len(p.ratios)]) and sum(p.ratios) >= 0.95 > sum(p.ratios[:-1])
    got = np.array([r[0] for r in df.select(p.apply(s.vector())).collect()])
    assert np.allclose(got, z @ np.array(p.axes).T)


def test_metrics(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "persona int, track_id long, rank int")
    truth = spark.createDataFrame([(1, 10, 1.0), (1, 12, 1.0), (1, 99, 1.0), (2, 1, 1.0)], "persona int, track_id long, gain double")
    r = {x.persona: x for x in evaluation.ranking_metrics(recs, truth, 3).collect()}
    assert math.isclose(r[1].precision, 2 / 3) and math.isclose(r[1].recall, 2 / 3)
    assert math.isclose(r[1].ap, (1 + 2 / 3) / 3)
    assert math.isclose(r[1].ndcg, (1 + 0.5) / (1 + 1 / math.log2(3) + 0.5))
    assert (r[2].precision, r[2].ndcg, r[2].hit_rate) == (0, 0, 0)
    values = spark.createDataFrame([("a", k, k / 10) for k in range(1, 6)] + [("b", 1, 1.0)], "m string, unit int, value double")
    low = {x.m: x for x in evaluation.summary(values, ["m"], 100).collect()}
    assert low["a"].ci_lower <= low["a"].macro_mean <= low["a"].ci_upper and low["b"].ci_lower is None
    s = evaluation.safety(recs.withColumn("s", F.lit(1.0) / F.col("rank")), spark.createDataFrame([(1, 11)], "persona int, track_id long"), "s").first()
    assert (s.seeds, s.repeated, s.rising) == (1, 0, 0)


def test_taste_weights_and_upsert(spark):
    rows = spark.createDataFrame([(1, "recent", 7, "2024-01-31 00:00:00", 20), (1, "manual", 7, None, 1), (1, "recent", 8, None, 1)], "user_id int, source string, track_id long, t string, interaction_count int").withColumn("played_at", F.to_timestamp("t")).withColumn("confidence", F.lit(1.0))
    w = {(r.source, r.track_id): r for r in profiles.weights(rows, profiles.Taste()).collect()}
    assert math.isclose(w["recent", 7].weight, 10 * math.exp(-0.08)) and w["recent", 8].weight == 1.0
    assert {(r.source, r.track_id) for r in profiles.first_source(rows, profiles.Taste()).collect()} == {("manual", 7), ("recent", 8)}
    old = rows.select("user_id", "source", "track_id", "played_at", "interaction_count")
    new = old.where("source = 'recent'").withColumn("interaction_count", F.lit(3))
    merged = {(r.source, r.track_id): r.interaction_count for r in profiles.upsert(old, new).collect()}
    assert merged == {("recent", 7): 20, ("manual", 7): 1, ("recent", 8): 3}
    likes = spark.createDataFrame([(1, 2)], "user_id int, track_id long")
    assert profiles.like(likes, likes.union(spark.createDataFrame([(1, 3)], likes.schema))).count() == 2
    assert profiles.unlike(likes, likes).count() == 0


def test_archetypes(spark):
    df = spark.createDataFrame([(0.8, 0.8, 0.5, 0.1, 0.0, 0.0), (0.4, 0.4, 0.6, 0.1, 0.0, 0.0), (None, None, None, None, None, None), (0.5, 0.5, 0.5, 0.5, 0.4, 0.0)], "energy double, danceability double, valence double, acousticness double, instrumentalness double, speechiness double")
    assert [r[0] for r in df.select(F.expr(archetype_sql())).collect()] == ["High-Energy Party Enthusiast", "Chill Vibester & Sunday Lounger", "Acoustic & Introspective Soul", "Atmospheric & Instrumental Dreamer"]


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nwith a break')], "k int, t string")
    for kind in ("csv", "parquet", "json"):
        files.write(df, f"{tmp_path}/x.{kind}", single=True)
        assert files.read(spark, f"{tmp_path}/x.{kind}", None if kind != "csv" else df.schema).count() == 1
    with pytest.raises(ValueError):
        files.read(spark, "x.txt")
    assert files.statements("-- no; \nselect ';' as a;\nselect 2;") == ["select ';' as a", "select 2"]
    assert files.run_script(spark, "select 1 as a; select :x as b", {"x": 5})[1].first().b == 5
    files.save_json({"a": {"b": 2}}, f"{tmp_path}/c.json")
    assert files.load_json(f"{tmp_path}/c.json", {"a": {"b": 1, "c": 3}}) == {"a": {"b": 2, "c": 3}}
    assert files.document(df, "rows")["rows"][0]["k"] == 1


def test_stream_equals_batch(spark, tmp_path):
    from cadenza.streaming import plays

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    plays.upserting(plays.play_stream(spark, f"{tmp_path}/in", 10), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = Buckets(spark, f"{tmp_path}/out", ["user_id"]).read()
    want = plays.rollup(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    stream = plays.windowed(plays.play_stream(spark, f"{tmp_path}/in", 10))
    q = stream.writeStream.format("memory").queryName("plays").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("plays").count() > 0
