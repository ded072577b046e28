"""The table of pieces against the libraries behind it."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from ledgerflow.llm import bpe, token_count, training_order

#: Letters, digits, contractions, white space and look-alikes of it, other scripts, a special string.
PARTS = [*"ab1 \n\t\r'slTdrevm.!\x1c\x1f\x85\xa0\x0b é漢٣ ​　﻿", "'ll", "<|endoftext|>", "  ", "\r\n", "🙂"]


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(seed, n):
    rng = random.Random(seed)
    return [*("".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)), "", "a" * 500, "漢字" * 300, " " * 90, "x" * 64, "x" * 65, "it's he'll 'sab o'clock"]


@pytest.mark.parametrize("seed", range(5))
def test_ids_equal_the_library(seed):
    encode, encoder = library().encode_ordinary, training_order._encoder("byte_bpe_50k.tiktoken")
    texts = texts_of(seed, 3000)
    ids, edges = encoder.ids(texts)
    assert [ids[lo:hi].tolist() for lo, hi in zip(edges, edges[1:], strict=False)] == [encode(x) for x in texts]
    assert encoder.counts(texts).tolist() == [len(encode(x)) for x in texts]
    assert encoder.counts([]).tolist() == encoder.ids([])[0].tolist() == []


def test_long_text_across_parts():
    encode, encoder = library().encode_ordinary, training_order._encoder("byte_bpe_50k.tiktoken")
    text = " ".join("".join(random.Random(i).choices("abcdé", k=9)) for i in range(80_000))
    assert encoder.ids([text, text])[0].tolist() == 2 * encode(text)


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "ROOM", 50)
    encode = library().encode_ordinary
    encoder = bpe.Encoder(lambda texts: [encode(x) for x in texts])
    for seed in range(20):
        texts = texts_of(seed, 30)
        assert encoder.counts(texts).tolist() == [len(encode(x)) for x in texts]
    assert encoder.kept[0] < 500  # long pieces leave no row


def test_counts_equal_the_json_library():
    encode, encoder, apart = token_count._tokenizer("byte_bpe_50k.json")
    assert encoder is not None and apart == ["<|endoftext|>"]
    texts = texts_of(9, 3000)
    assert token_count._counts("byte_bpe_50k.json", texts) == [len(x) for x in encode(texts)]


def test_slots_are_the_permutation_of_ordinals():
    n = np.arange(1000)
    slots = training_order.permute(n, 1000, 7)

    def one(x):
        while True:
            left, right = x >> 5, x & 31
            for turn in range(training_order.ROUNDS):
                left, right = right, left ^ int(training_order._mix(np.array([right + (turn << 40)], np.uint64), 7)[0]) & 31
            x = left << 5 | right
            if x < 1000:
                return x

    assert slots.tolist() == [one(x) for x in range(1000)]


def test_pieces_that_recur_outlast_a_full_table(monkeypatch):
    """When the table starts anew, what came in several calls is not solved again and has the same ids."""
    monkeypatch.setattr(bpe, "ROOM", 50)
    solved = []

    def encode(pieces):
        solved.extend(pieces)
        return [[len(p), ord(p[-1])] for p in pieces]

    encoder = bpe.Encoder(encode)
    for i in range(40):
        ids, edges = encoder.ids([f"often seen {'x' * i}{i}", f"rare{i}a rare{i}b"])
        assert ids[:4].tolist() == [5, ord("n"), 5, ord("n")] and len(edges) == 3
    assert solved.count("often") == solved.count(" seen") == 1 and len(solved) > 80
