import zlib

import numpy as np

from lodforge.llm import language
from lodforge.llm.common import table

from . import cases


def test_held_out_accuracy(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.identify(documents, language.train_language(documents)).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]).all()
    judged = found[found["held_out"]]
    assert (judged["lang_pred"] == judged["lang"]).mean() > 0.98 and found["score"].between(0, 1).all()


def test_every_window_counts():
    """A text in one language with a short foreign opening is judged by the whole."""
    network = language.Network(["a", "b"], language.Fit())
    x = np.concatenate([language.windows(language.folded("qua que qui quo " * 100), 192), language.windows(language.folded("schu scha sche " * 100), 192)])
    network.train(x, np.repeat([0, 1], [9, 8])[: len(x)] if len(x) == 17 else np.array([0] * (len(x) - 8) + [1] * 8))
    names, scores = network.predict(["schu scha sche " * 20 + "qua que qui quo " * 400, "schu scha sche", None, "123 !!"])
    assert names == ["a", "b", "und", "und"] and list(scores[2:]) == [0, 0]


def test_cases(spark):
    frame = cases.frame(spark)
    network = language.train_language(frame, language.Fit(steps=20))
    found = language.identify(frame, network).collect()
    assert len(found) == len(cases.rows())
    by = {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == by[12] == "und" and by[7] != "und"
    nothing = cases.frame(spark, [])
    assert language.train_language(nothing) is None and language.identify(nothing, None).count() == 0
    assert {r["lang_pred"] for r in language.identify(frame, None).collect()} == {"und"}
    kept = language.keep_identified(frame, 0.0)
    assert kept.columns == frame.columns and kept.where("doc_id in (0, 1, 2, 12)").count() == 0
