import random

import pytest
import public_tokenizers

from ledgerflow.llm import piece_nbest


def test_forward_pass_takes_all_lengths_together(monkeypatch):
    """Segments of all lengths are looked up together, once for each size of a piece, and equal the plain forward pass."""
    pieces = piece_nbest.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(11)
    words = ["aaaaaaaaaaaaaaaa", "é", "中", "▁", "\ud800", "a\U0001f600b", *("▁" * (n % 2) + "".join(rng.choice("etaoin shrdluéΩ中\U0001f600") for _ in range(n)) for n in range(1, 64) for _ in range(3))]
    calls, rows = [], pieces._rows
    monkeypatch.setattr(pieces, "_rows", lambda h: calls.append(len(h)) or rows(h))
    found = dict(pieces.forward_many(words))
    assert len(calls) <= pieces.longest and len(found) == len(set(words))
    for word in words:
        best, ids, loss = pieces.forward(word)
        assert found[word][1] == ids and found[word][0] == pytest.approx(best[-1]) and found[word][2] == pytest.approx(loss)
