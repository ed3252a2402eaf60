"""The stages of the pipeline on rows: repeated rows, null ids, empty tables, clashing names; and the whole run."""

import random
import time

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
CLASHES = ["score", "n_removed", "_gone", "__id", "_scored", "added0_0", "version", "class", "kept"]


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    """Texts of 200 words, a near copy, a repeated row, null ids, and texts without words; with columns of awkward names."""
    rng = random.Random(3)
    base = [words(rng, 200) for _ in range(30)]
    near = [w if k != 100 else "changed" for k, w in enumerate(base[4])]
    rows = [(k, "\n".join(" ".join(b[i : i + 20]) for i in range(0, 200, 20)), "en") for k, b in enumerate(base)]
    rows += [(40, " ".join(near), "en"), (41, " ".join(base[4]), None), (None, " ".join(base[7]), "en"), (None, " ".join(words(rng, 200)), "de")]
    rows += [rows[5], rows[5], (50, None, "en"), (51, "", "en"), (52, "  \n ", None), (None, None, None)]
    df = spark.createDataFrame([(i, t, g, "web", None if t is None else len(t)) for i, t, g in rows], SCHEMA)
    for k, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(k))
    return df


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.lang or "") for r in df.select("doc_id", "text", "lang").collect())


def test_stages_keep_rows_and_columns(spark, table):
    before = rows_of(table)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, FOLDER)
        assert out.columns == table.columns, name
        assert out.select(CLASHES).distinct().count() == 1, name
        assert stage(spark, table.limit(0), FOLDER).count() == 0, name
        if name != "lines":
            after = rows_of(out)
            assert all(after.count(r) == before.count(r) for r in after), name  # rows go or stay, and never multiply


def test_quality_rejects_by_base_rules(spark, table):
    kept = {r[1] for r in rows_of(corpus_pipeline.quality(spark, table, FOLDER))}
    assert kept <= {*range(30), 40, 41, 0} and len(kept) > 20


def test_toxicity_keeps_every_clean_row(spark, table):
    assert len(rows_of(corpus_pipeline.toxicity(spark, table, FOLDER))) >= table.count() - 1


def test_duplicates_keep_the_smallest_id(spark, table):
    after = rows_of(corpus_pipeline.duplicates(spark, table, FOLDER))
    ids = [r[1] for r in after if not r[0]]
    assert 4 in ids and not {40, 41} & set(ids) and ids.count(5) == 3
    assert 7 in ids and sum(r[0] for r in after) == 2  # the null id's copy of 7 goes, the other two stay
    assert {50, 51, 52} <= set(ids)


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, known, FOLDER)
        assert out.columns == docs.columns and {r[1] for r in rows_of(out)} <= {r[1] for r in rows_of(known)}, name
        known = spark.createDataFrame(out.collect(), docs.schema)
    want = {r.doc_id: r.text for r in known.collect()}
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {p.doc_id for p in pieces} == set(want)
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    assert max(sizes.values()) <= 2048
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(labels.get(i) == 1 for i in want) <= 0.3 * sum(v == 1 for v in labels.values())


def test_plans_of_a_finished_operator_are_freed(spark):
    """The driver's JVM drops what Python dropped, so that a run of many operators doesn't fill it with plans."""
    staged = corpus_pipeline.common.Staged(spark, "freed")
    df = spark.range(10).selectExpr("id + 1 AS x")
    kept = spark.sparkContext._jvm.java.lang.ref.WeakReference(df._jdf)
    assert kept.get() is not None
    del df
    for _ in range(20):  # Python's side tells the JVM a moment later
        staged.keep(spark.range(1))
        if kept.get() is None:
            break
        time.sleep(0.1)
    else:
        raise AssertionError("the plan is still held")
