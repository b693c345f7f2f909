"""Quality classifier and language ID."""

import numpy as np
from pyspark.sql import functions as F

from lodeseek.llm import langid, registry, weak_quality


def test_estimation_finds_planted_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    k = len(weak_quality.LABELLERS)
    right = np.linspace(0.75, 0.95, k)
    votes = np.where(rng.random((len(good), k)) < right, np.where(good, 1, 2)[:, None], np.where(good, 2, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    p = (votes * 3 ** np.arange(k - 1, -1, -1)).sum(1)
    patterns, inverse, counts = np.unique(p, return_inverse=True, return_counts=True)
    assert (weak_quality.digits(patterns)[inverse] == votes).all()
    post, _, share = weak_quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05
    assert ((post[inverse] > 0.5) == good).mean() > 0.97


def test_estimation_without_votes():
    post, _, _ = weak_quality.estimate(np.empty(0, np.int64), np.empty(0))
    assert len(post) == 0


def test_scorer_agrees_with_held_back_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got[got.quality == 1].kept).mean() > 0.97
    assert (~got[got.quality == 0].kept).mean() > 0.9


def test_quality_of_odd_rows(odd, none, odd_rows):
    got = weak_quality.classify(odd, "doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].score == by[4].score == by[5].score == 0 and not by[3].kept
    assert by[1].score == by[2].score
    assert weak_quality.classify(none, "doc_id").collect() == []


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    again = registry.op2_language(spark, sf).toPandas().set_index("doc_id").sort_index()
    assert (again.loc[got.doc_id, "score"].to_numpy() == got.score.to_numpy()).all()


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    lied = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, "doc_id").collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(lied, "doc_id").collect()}
    assert a == b


def test_language_of_odd_rows(odd, none, odd_rows, spark):
    got = langid.identify(odd, "doc_id").collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (3, 4, 5, 7)} == {"und"} and by[3].score == 0
    assert by[9].lang_pred in ("en", "fr", "de")
    assert langid.identify(none, "doc_id").collect() == []
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled, "doc_id").collect()} == {"und"}


def test_ftrl_keeps_useless_weights_at_zero():
    rng = np.random.default_rng(1)
    m = langid.Ftrl(50, 2)
    for _ in range(400):
        y = int(rng.random() < 0.5)
        m.step(np.array([y, 10 + rng.integers(40)]), np.array([1.0, 0.02]), y)
    w = m.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w[10:] == 0).mean() > 0.5


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(2)
    s = rng.normal(size=(5000, 3))
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(s * 4, y) - 4) < 0.4
