import os
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerflow.llm import all_pairs, bloom_lm


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_packs_hold_columns():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, 200, n).astype(t) for t in (np.uint16, np.uint32, np.uint64, np.int64, np.float64)]
        found = all_pairs.unpack(all_pairs.pack(*columns))
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(columns, found, strict=True))


def test_far_bigrams_cost_few_bytes(spark, tmp_path, monkeypatch):
    """Where no bigram has room in the filter, no table of the tokens or of their bigrams is written."""
    monkeypatch.setattr(bloom_lm, "FILTER_BITS", 0)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(5000 * rng.random() ** 2)}" for _ in range(1500))) for i in range(60)]
    monkeypatch.setattr("ledgerflow.llm.common.shared_path", lambda spark, label: str(tmp_path / label))
    found = bloom_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), all_pairs=True).collect()
    assert len(found) == 60 and all(r.n_tokens == 1501 for r in found)
    assert size_of(tmp_path) < 8 * 60 * 1501


@pytest.mark.parametrize("near", [False, True])
def test_every_token_is_dealt_once(near):
    """Each token is near or in one pack, under its own row and fold."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(3000)) for _ in range(20)]
    tokens, sizes = bloom_lm.Tokens()(texts)
    words = np.unique(tokens)[::2]
    pairs = np.unique(bloom_lm.pairs_of(tokens, sizes)[1])[::3] if near else np.zeros(0, np.uint64)
    table = all_pairs.Near(words, pairs)
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(7, 27), pa.int64()), "held_out": [i % 5 == 0 for i in range(20)], "text": texts})
    packs = list(all_pairs._deal(type("Shared", (), {"value": table}), 4)(iter([batch])))
    at = table.tables()(tokens, sizes)[3]
    far = [x for _, x in packs if x[0] != all_pairs.NEAR]
    rows = np.concatenate([all_pairs.unpack(x[2])[2].astype(np.int64) + 2 * x[1] for x in far])
    owner = np.repeat(np.arange(7, 27), sizes)
    left = np.bincount(np.delete(owner, at), minlength=27)
    assert (np.bincount(rows >> 1, minlength=27) == left).all() and bool(len(at)) == near
    assert ((rows & 1 == 1) == ((rows >> 1) % 5 == 2)).all()
    counted = sum(int(all_pairs.unpack(x[2])[2].sum()) for _, x in packs if x[0] == all_pairs.NEAR)
    assert counted == (owner[at] % 5 != 2).sum()
