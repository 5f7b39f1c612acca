"""Encoders that have met words before give the library's ids."""

from __future__ import annotations

import random
import struct

import pytest

from hazeline.llm import encoding, queries, token_store
from hazeline.session import shared_folder


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("remembered", [700_000, 50])
def test_warm_encoders_match_the_library(name, spaced, remembered, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", remembered)
    rnd = random.Random(9)
    parts = ["İ", "İ!", "a", "word", "Straße", "ſ", "é", "é", "1st", "x2", "don't", "\n", "!", "...", "_", "ß.", "ǆ", "Ω;", "ﬁ,"]
    texts = ["İ ſ ß é ǆ Ω ﬁ a word", *("".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "  "]) for _ in range(rnd.randint(0, 12))) for _ in range(1500))]
    for narrow in (False, True):
        warm = encoding.Encoder(queries.tokenizer(name), spaced, narrow)
        kind = "H" if narrow else "I"
        for _ in range(2):
            for text, ids in zip(texts, warm.encode_all(texts), strict=True):
                want = warm.tokenizer.encode(text, add_special_tokens=False).ids
                assert ids == struct.pack(f"<{len(want)}{kind}", *want), text


def test_one_id_of_a_store(spark):
    texts = {3: "some words of a text", 5: "", 9: "others " * 400, 12: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = shared_folder(spark, "ids")
    token_store.write_tokens(docs, path, queries.tokenizer("byte_bpe_50k.json"), shard_tokens=100)
    library = encoding.Encoder(queries.tokenizer("byte_bpe_50k.json"), True).tokenizer
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for i in {0, len(ids) // 2, len(ids) - 1}:
            assert token_store.token_at(spark, path, doc_id, i) == ids[i]
        with pytest.raises(LookupError):
            token_store.token_at(spark, path, doc_id, len(ids))
    with pytest.raises(LookupError):
        token_store.token_at(spark, path, 4, 0)


def test_words_with_marks_are_remembered_over_texts(monkeypatch):
    """A word met in one text isn't learned again for the next, and what is kept stays bounded."""
    monkeypatch.setattr(encoding, "BRIEF", 20)
    warm = encoding.Encoder(queries.tokenizer("byte_bpe_50k.json"), True)
    met, real = [], warm.learn
    monkeypatch.setattr(warm, "learn", lambda x: met.append(x) or real(x))
    for _ in warm.encode_all(["one x2, (three) and four"] * 1000):
        pass
    assert met.count(" x2,") == 1 and met.count(" (three)") == 1
    list(warm.encode_all([f"one x{i}, y{i}" for i in range(200)]))
    assert len(warm.brief) <= 22 and set(warm.brief) <= set(warm.known)


def test_encoder_is_released():
    path = queries.tokenizer("word_bpe_49k.json")
    kept = encoding.worker_encoder(path, False)
    assert encoding.worker_encoder(path, False) is kept
    encoding.release_encoders()
    assert encoding.worker_encoder(path, False) is not kept
    encoding.release_encoders()
    encoding.release_encoders()
