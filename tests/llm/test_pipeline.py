import hashlib
from collections import Counter

import corpus_pipeline
from lodforge.llm.common import table

from . import cases
from .test_simhash import brute_components, brute_print


def test_stages_take_effect(spark, small):
    docs = table(spark, small, "documents")
    docs = docs.union(docs.orderBy("doc_id").limit(1).selectExpr("doc_id + 100000", "concat(text, ' and the password: hunter2hunter2 was left here by the people')", "lang", "source", "n_chars"))
    columns, whole = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = corpus_pipeline.identify_language(spark, docs, small)
    assert kept.columns == columns and kept.count() >= 0.98 * len(whole)
    single = corpus_pipeline.drop_near_copies(spark, docs, small)
    roots = brute_components({i: brute_print(r["text"]) for i, r in whole.items()})
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(roots.values()))
    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, docs, small).collect()}
    assert set(masked) == set(whole)
    changed = [i for i in whole if masked[i]["text"] != whole[i]["text"]]
    assert changed and all("[SECRET]" in masked[i]["text"] for i in changed)
    mixed = corpus_pipeline.mix_sources(spark, docs, small)
    assert mixed.columns == columns and set(Counter(r["doc_id"] for r in mixed.collect()).values()) <= {1, 2}


def test_whole_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_secrets(spark, table(spark, small, "documents"), small).collect()}
    same = [r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows]
    assert all(same)


def test_cases(spark, small):
    docs = cases.frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, "case")
    corpus_pipeline.encode_tokens(spark, docs, small).collect()
