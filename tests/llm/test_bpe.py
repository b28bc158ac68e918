import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodforge.llm import bpe
from lodforge.llm.common import table

from . import cases

PATH = public_tokenizers.path(bpe.DEFAULT)


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \tx", "don't we'll", "x" * 30000, "ab" * 300, "é" * 999, "中文" * 300, "<|endoftext|> a", "= " * 300, "\U0001f600́ z", "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(1500))]


def test_equals_library_on_hard_texts(library):
    own = bpe.Bpe.of(PATH, public_tokenizers.PATTERN)
    ids = own.encode(TEXTS)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in TEXTS]
    assert own.decode(ids) == [t.encode() for t in TEXTS]


def test_equals_library_on_documents(spark, small, library):
    documents = table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in bpe.round_trip(documents).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_cases_and_columns(spark):
    frame = cases.frame(spark)
    assert bpe.round_trip(frame).count() == len(cases.rows())
    back = frame.withColumn("ids", bpe.encode_column()).withColumn("raw", bpe.decode_column("ids")).collect()
    assert all(bytes(r["raw"]) == (r["text"] or "").encode() for r in back)
    assert bpe.round_trip(cases.frame(spark, [])).count() == 0
