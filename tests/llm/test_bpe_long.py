"""Long words contract many pairs a step; the tokens must be those of one pair at a time."""

import random
import time

import numpy as np
import public_tokenizers
import tiktoken

from lodforge.llm import bpe

PATH = public_tokenizers.path(bpe.DEFAULT)


def test_random_long_words_equal_library():
    own = bpe.Bpe.of(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    draw = random.Random(3)
    words = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("ab", "abc", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éaß中", "xX=", "ers", "tion", "theand") for n in (50, 97, 300, 1500) for _ in range(4)]
    words += [base * 300 for base in ("ab", "the", "information", "xxy", "stst", "a" * 7 + "b")]
    assert own.encode(words) == [np.array(library.encode_ordinary(w), "<u4").tobytes() for w in words]


def test_very_long_words_end_soon():
    own = bpe.Bpe.of(PATH, public_tokenizers.PATTERN)
    draw = random.Random(5)
    for word in ("ab" * 50_000, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))):
        began = time.time()
        ids = own.encode([word])
        assert time.time() - began < 30 and own.decode(ids) == [word.encode()]


def test_pieces_of_any_size_equal_library(monkeypatch):
    own = bpe.Bpe.of(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    draw = random.Random(8)
    monkeypatch.setattr(bpe, "LONG", 100)
    words = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("ab", "a", "etaoin", "éaß中", "aaaaaaab") for n in (350, 1499)] + ["stst" * 301]
    words = [w + "abcdefghijklm"[k % 13] for k, w in enumerate(words)]
    for piece, back in ((400, 1), (900, 8)):
        monkeypatch.setattr(bpe, "PIECE", piece)
        monkeypatch.setattr(bpe, "BACK", back)
        own.young, own.old = {}, {}
        assert own.encode(words) == [np.array(library.encode_ordinary(w), "<u4").tobytes() for w in words]


def test_words_of_a_million_letters_and_long_texts_stay_within_the_limit(monkeypatch):
    own = bpe.Bpe.of(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    draw = random.Random(9)
    texts = ["ab" * 500_000, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), " ".join(draw.choices(["the", "word", "Ünï", "12", "xyzzy\n"], k=10_000_000))]
    for text in texts:
        ids = own.encode([text])
        assert ids == [np.array(library.encode_ordinary(text), "<u4").tobytes()] and own.decode(ids) == [text.encode()]


def test_slices_of_words_and_ids(monkeypatch):
    own = bpe.Bpe.of(PATH, public_tokenizers.PATTERN)
    texts = ["", "one two three four five", "x", "", "Zwölf große Boxkämpfer " * 50]
    whole = own.encode(texts)
    monkeypatch.setattr(bpe, "SLICE", 3)
    monkeypatch.setattr(bpe, "GROUP", 1)
    assert own.encode(texts) == whole and own.decode(whole) == [t.encode() for t in texts]


def test_session_settings_stay(spark, small):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.createDataFrame([(1, "some words"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens) for r in bpe.round_trip(rows).collect()} >= {(None, 0)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
