"""Language mixture and quality: held-out accuracy, the formulas against plain loops, edge rows."""

import numpy as np
from cases import edge_docs, empty_docs
from pyspark.sql import functions as F

from plumbline.llm import lang_mixture, pu_quality
from plumbline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = QUERIES["op10_language_mixture"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert len(rows) == docs.count() and len(held) > 100
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_of_two_languages(spark):
    """Proportions by expectation-maximisation equal a plain loop, and a mixed text shows both languages."""
    model = lang_mixture.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.length("text") > 800)
    one, two = (docs.where(F.col("lang") == lang).orderBy("doc_id").first()["text"] for lang in ("en", "de"))
    letters = lang_mixture.letter_table()
    found, weight = lang_mixture.grams(one[:800] + " " + two[:800], letters)
    mix = dict(model.infer(found, weight))
    assert set(mix) >= {"en", "de"} and abs(mix["en"] - 0.5) < 0.2
    share = np.full(len(model.languages), 1 / len(model.languages))
    for _ in range(lang_mixture.ROUNDS):
        new = np.zeros_like(share)
        for g, n in zip(found, weight):
            joint = share * model.prob[g]
            new += n * joint / joint.sum()
        share = new / weight.sum()
    assert np.allclose(share, model.proportions(model.prob[found], weight)[0], atol=1e-3)


def test_language_edges(spark):
    docs = edge_docs(spark)
    rows = {r["doc_id"]: r for r in lang_mixture.with_languages(docs, lang_mixture.fit(docs)).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert rows[7]["lang_pred"] == "de" and None in rows
    nothing = lang_mixture.fit(empty_docs(spark))
    assert lang_mixture.with_languages(empty_docs(spark), nothing).collect() == []
    assert {r["lang_pred"] for r in lang_mixture.with_languages(docs, nothing).collect()} == {"und"}


def test_quality_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = QUERIES["op2_pu_quality"](spark, SF_DIR).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_non_negative_risk():
    """On two clouds the classifier learned without negatives tells them apart."""
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(1.5, 1, (2000, 4)), rng.normal(-1.5, 1, (2000, 4))
    unlabelled = np.vstack([positive[:1200], negative[:800]])
    model = pu_quality.fit_nnpu(positive[1200:], unlabelled, 0.6)
    assert (model.score(positive[:500]) > 0.5).mean() > 0.95 and (model.score(negative[:500]) < 0.5).mean() > 0.95


def test_quality_edges(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([(1, 1), (7, None), (None, 1), (3, 0)], "doc_id long, quality int")
    rows = pu_quality.scored(docs, pu_quality.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = pu_quality.fit(empty_docs(spark), labels.limit(0))
    assert nothing is None and pu_quality.scored(empty_docs(spark), nothing).collect() == []
    assert {r["score"] for r in pu_quality.scored(docs, None).collect()} == {0.5}
