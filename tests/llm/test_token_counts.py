"""Token counts against the tokenizer library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelens.llm import token_counts as tc
from tracelens.llm.token_counts import TokenCounts, count_tokens, prove_whole

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, n_bytes int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_every_proved_string_is_one_token(library):
    whole, unproved = prove_whole(PATH)
    assert len(whole) > 40_000
    assert {len(e.ids) for e in library.encode_batch(sorted(whole), add_special_tokens=False)} == {1}
    # strings of the vocabulary that merges never reach alone, or that the cutting would part, are not taken for whole
    assert len(whole) < library.get_vocab_size()
    assert all(ord(c) < 0x10000 for c in unproved)


ODD = ["a", "Z", " ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "'ll", "1", "²", "½", "é", "é", "中", "՘", "₏", "\U0001f600", "\U00100001", "\U000f0000", " ", " ", "\u0085", "\x1c", "\x00",
       "<|endoftext|>", "<|endoftext", "<|", "!", "?!", "‍", "﻿", "word", " word", " the", "9999", "_"]


def test_odd_texts(library):
    counts, draw = TokenCounts(PATH, *prove_whole(PATH)), random.Random(1)
    for _ in range(8000):
        text = "".join(draw.choices(ODD, k=draw.randint(0, 24)))
        assert counts.count(text) == tokens(library, text), repr(text)


def test_every_first_byte_has_a_place():
    counts = TokenCounts(PATH, *prove_whole(PATH))
    for c in (0x7F, 0x80, 0x7FF, 0x800, 0xFFFD, 0x10000, 0x3FFFF, 0xFFFFF, 0x10FFFF):
        assert counts.alphabet.shown(chr(c))


def test_stretches_of_long_texts(library, monkeypatch):
    monkeypatch.setattr(tc, "SPLIT_CHARS", 7)
    counts, draw = TokenCounts(PATH, *prove_whole(PATH)), random.Random(2)
    for _ in range(300):
        text = "".join(draw.choices(ODD, k=draw.randint(10, 200)))
        assert counts.count(text) == tokens(library, text), repr(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tc, "KEPT", 3)
    counts, draw = TokenCounts(PATH, *prove_whole(PATH)), random.Random(3)
    for _ in range(300):
        text = "".join(draw.choices("abcdefgh ", k=60))
        assert counts.count(text) == tokens(library, text)


def test_table(spark, library):
    texts = [None, "", " ", "a", "repeated", "repeated", "<|endoftext|>", "x" * 300_000, ("ab  c\n" * 60_000) + "\U0001f600", "word " * 1500]
    rows = [(None if k == 3 else k, t, "clash", 1) for k, t in enumerate(texts)]
    got = count_tokens(spark.createDataFrame(rows, SCHEMA), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = [(d, len((t or "").encode()), tokens(library, t)) for d, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_kinds_of_vocabulary_are_refused(name):
    with pytest.raises(ValueError, match="byte-level"):
        prove_whole(public_tokenizers.path(name))
