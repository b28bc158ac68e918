import re
from collections import Counter

import numpy as np

from lodforge.llm import quality
from lodforge.llm.common import table

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {k for i, w in enumerate(windows) if many[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, small):
    documents = table(spark, small, "documents").select("doc_id", "text")
    found = {r["doc_id"]: r for r in quality.quality_rules(documents, None).drop("text").collect()}
    for row in documents.collect():
        assert tuple(found[row["doc_id"]][c] for c in quality.COUNTS[:5]) == brute(row["text"])
    for text in [None, "", "a a a a a a a a a", "a b c d e f g h " * 3 + "x", "p q " * 5 + "\n" + "p q " * 5, "x y z"]:
        assert quality.rule_counts(text)[:5] == brute(text)


def test_cases_and_rules(spark):
    out = quality.quality_rules(cases.frame(spark), None)
    rows = out.collect()
    assert len(rows) == len(cases.rows()) and "n_words" in out.columns and out.columns.count("size") == 1
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(cases.frame(spark, []), None).count() == 0
    assert quality.fit_rules(cases.frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.fit_rules(cases.frame(spark), spark.createDataFrame([(9, None), (None, 1)], "doc_id long, quality int")) is None


def test_forest_scores_outliers_higher():
    rows = np.random.default_rng(0).normal(size=(2000, 3)).astype(np.float32)
    forest = quality.IsolationForest(rows, quality.Fit(trees=64))
    odd = forest.score(np.full((1, 3), 6, np.float32))[0]
    assert odd > np.quantile(forest.score(rows), 0.999)


def test_held_out_labels(spark):
    """Fitted on part of the labelled rows, judged on the others."""
    sf = "/root/testdata/sf0.1"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_rules(documents, labels.where("doc_id % 2 = 0"))
    judged = quality.quality_rules(documents.select("doc_id", "text"), model).drop("text").join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    good = judged["quality"] == 1
    assert judged[good]["kept"].mean() > 0.985
    assert judged[~good]["kept"].mean() < 0.1
