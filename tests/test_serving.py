"""Bounds of arguments, relaxation, invitations, replaced rows, manifests and models on disk, labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import labels, personas, recommend, serving
from cadenza.schema import VECTOR
from cadenza.sources.catalog import Catalog

FOLDER = "/root/testdata/sf0.001"


def test_arguments_are_bounded():
    assert [serving.bounded("limit", v) for v in (0, 7, "20", 900, "x", None)] == [1, 7, 20, 50, 10, 10]
    assert serving.bounded("min_popularity", 99) == 90
    assert serving.clean_genre(" R&B; drop table--" + "x" * 50) == "r&b drop table--" + "x" * 14
    assert serving.clean_genre(None) == ""


def test_filters_are_relaxed_for_those_without_a_candidate(spark):
    rows = [("a", 1, 90, "pop", 0.5), ("a", 2, 10, "pop", 0.9), ("b", 1, 5, "pop", 0.3), ("b", 3, 5, None, 0.3), ("c", 1, None, "pop", 0.2)]
    df = spark.createDataFrame(rows, "persona string, track_id long, track_popularity int, genre string, similarity double")
    got = {(r.persona, r.track_id): (r.position, r.relaxed) for r in serving.filtered(df, 5, 50, ["POP"]).collect()}
    assert got == {("a", 1): (1, False), ("b", 1): (1, True), ("b", 3): (2, True), ("c", 1): (1, True)}
    assert {r.persona for r in serving.filtered(df, 5, 50, relax=False).collect()} == {"a"}


def test_invitations(spark):
    inv = spark.createDataFrame([(1, 10, "pending", 100), (2, 10, "pending", 100), (3, 10, "completed", 100), (4, 10, "pending", 5)], "invite_id long, creator_id long, status string, t int")
    inv = inv.select("invite_id", "creator_id", "status", F.timestamp_seconds("t").alias("expires_at"), F.lit(None).cast("long").alias("participant_id"), F.lit(None).cast("timestamp").alias("accepted_at"))
    answers = spark.createDataFrame([(1, 10, 1), (1, 11, 50), (1, 12, 40), (2, 13, 101), (3, 14, 1), (4, 15, 6)], "invite_id long, user_id long, t int").select("invite_id", "user_id", F.timestamp_seconds("t").alias("answered_at"))
    after, changed = serving.accepted(inv, answers)
    now = F.timestamp_seconds(F.lit(50))
    got = {r.invite_id: (r.s, r.participant_id) for r in after.withColumn("s", serving.invitation_status(now)).collect()}
    assert got == {1: ("accepted", 12), 2: ("pending", None), 3: ("completed", None), 4: ("expired", None)}
    assert [r.invite_id for r in changed.collect()] == [1]


def test_replaced_rows(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, None, None)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in serving.replace_rows(old, new, ["k"], "t").collect()) == [(1, "a"), (2, "d"), (3, None)]


def test_manifest_and_model_come_back(spark, tmp_path):
    seeds = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "persona string, track_id long")
    personas.save_manifest(seeds, str(tmp_path / "m.json"))
    assert sorted(map(tuple, personas.load_manifest(spark, str(tmp_path / "m.json")).collect())) == [("x", 1), ("x", 3), ("y", 2)]
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace("3", "4"))
    with pytest.raises(ValueError):
        personas.load_manifest(spark, str(tmp_path / "m.json"))
    rows = Catalog(spark, FOLDER).audio_features()
    scaler = recommend.Scaler.fit(rows)
    axes = recommend.Projection.fit(rows, scaler)
    recommend.save_model(scaler, axes, str(tmp_path / "model.json"))
    assert recommend.load_model(str(tmp_path / "model.json")) == (scaler, axes)


def test_principal_axes_against_numpy(spark):
    rows = Catalog(spark, FOLDER).audio_features()
    p = recommend.Projection.fit(rows, recommend.Scaler.fit(rows))
    x = np.array([[r[f] for f in VECTOR] for r in rows.select(*VECTOR).collect()], float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(p.ratios, (values[::-1] / values.sum())[: len(p.ratios)])
    assert sum(p.ratios) >= 0.95 > sum(p.ratios[:-1])
    for k, axis in enumerate(p.axes):
        assert np.isclose(abs(np.dot(axis, vectors[:, ::-1][:, k])), 1)


def test_labels(spark):
    df = spark.createDataFrame([(0.2,), (-0.7,), (1.0,), (-1.5,), (None,)], "v double")
    got = [r.s for r in df.select(labels.skew_label(F.col("v")).alias("s")).collect()]
    assert got == ["approximately symmetric", "moderately skewed (negative)", "moderately skewed (positive)", "highly skewed (negative/left)", None]
    assert [r.s for r in df.select(labels.strength_label(F.col("v")).alias("s")).collect()] == ["weak", "strong", "strong", "strong", None]


def test_unwanted_artists(spark):
    rows = spark.createDataFrame([(1, "A "), (1, "b"), (2, "a"), (1, None)], "user_id int, artist_name string")
    banned = spark.createDataFrame([(1, "a")], "user_id int, artist_name string")
    assert sorted((r.user_id, r.artist_name or "") for r in recommend.without_artists(rows, banned).collect()) == [(1, ""), (1, "b"), (2, "a")]


def test_vectors_are_resolved_and_embedded(spark):
    rows = [(1, [1.0], [2.0], [3.0], "established"), (2, [1.0], [2.0], None, "limited"), (3, None, None, [3.0], None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "user_id int, enhanced array<double>, preference array<double>, liked array<double>, status string")
    got = {r.user_id: (r.user_vector, r.why) for r in recommend.by_resolution(df).collect()}
    assert got == {1: ([1.0], "enhanced"), 2: ([2.0], "preference"), 3: ([3.0], "liked"), 4: (None, "popularity")}
    axes = recommend.Projection(((0.0, 1.0), (1.0, 1.0)), (0.6, 0.4))
    users = spark.createDataFrame([(1, [2.0, 5.0])], "user_id int, user_vector array<double>")
    assert recommend.embedded(users, axes).first().embedding == [5.0, 7.0]


def test_recommendations_of_any_vector(spark):
    c = Catalog(spark, FOLDER)
    catalog, users, axes = recommend._users(c)
    one = users.limit(1).withColumns({"profile_genres": F.lit(None).cast("map<string,double>"), "top_artists": F.lit(None).cast("array<string>")})
    one = spark.createDataFrame(one.collect(), one.schema)
    none = spark.createDataFrame([], "user_id long, track_id long")
    first = recommend.recommend_from(catalog, one, axes, none, 5).collect()
    assert [r["rank"] for r in sorted(first, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    banned = spark.createDataFrame([(r.user_id, r.artist_name) for r in first], "user_id long, artist_name string")
    again = recommend.recommend_from(catalog, one, axes, none, 5, banned).collect()
    assert not {r.artist_name for r in first} & {r.artist_name for r in again} and len(again) == 5
