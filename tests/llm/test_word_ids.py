"""Ids by remembered words against the tokenizer's own ids of whole texts."""

from __future__ import annotations

import random
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veracity.llm import packing
from veracity.llm.queries import tokenizer_path


def same(texts, own, whole):
    for text, ids, want in zip(texts, own.encode([t.encode() for t in texts]), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)


def test_any_unicode_text():
    rng = random.Random(1)
    own, whole = packing.WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert own.ids is not None
    special = [0x130, 0x131, 0x301, 0x307, 0x308, 0x345, 0x3A3, 0x1E9E, 0xDF, 0xAA, 0xB5, 0xBA, 0xFF, 0x212B, 0xAC00, 0x1100, 0x1161, 0xFB01, 0x1F600, 0x200D, 0xFE0F, 0xE000, 0xFFFD, *range(0, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    pools = [
        lambda: rng.randrange(0x80), lambda: rng.randrange(0x80, 0x180), lambda: rng.choice(special), lambda: rng.choice([*b" .,'!?\"-<|>sdt"]),
        lambda: rng.choice([x for x in (rng.randrange(sys.maxunicode + 1), rng.randrange(0x300, 0x370), rng.randrange(0x10000)) if not 0xD800 <= x < 0xE000] or [0x41]),
    ]
    texts = ["".join(chr(rng.choice(pools)()) for _ in range(rng.randint(0, 12))) for _ in range(40_000)]
    texts += ["KENDİ.", "İ!", "ȧ.", "é, É!", "<|ENDOFTEXT|> <|endoftext|>. a<|startoftext|>b,", "it's, IT'S' x'd. '", "Straße, ÀÉ."]
    same(texts, own, whole)


def test_other_tokenizers_are_asked_for_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.WordTokenizer(path)
    assert own.ids is None
    same(["", "One  two, THREE", "a\n\nb İ!"], own, Tokenizer.from_file(path))
