"""Every operator against a brute-force version, with nulls, empty texts, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash

from ledgerflow.llm import bloom_lm, components, decontaminate, html_text, language_id, line_dedup, piece_nbest, quality, queries, simhash, token_count, training_order
from ledgerflow.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key long, band long, digest string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); the other columns have names that operators use inside."""
    full = [(r[0], r[1], *(r[2:] or (None, None)), None, 1, 2, 3, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [(None, "one two three"), (None, None), (3, None), (4, ""), (5, "   \n\t"), (6, "Hello, World! <|endoftext|> x"), (6, "Hello, World! <|endoftext|> x"), (7, "Hello, World! <|endoftext|> x"), (8, "Ünïcode ß 𝄞 é " * 3), (9, "word " * 30_000), (10, "a" * 5000)]


@pytest.fixture(scope="module")
def edges(spark):
    return documents(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choices(vocabulary, k=n))


# --- training order


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection(size):
    slots = training_order.permute(np.arange(size), size, 99)
    assert sorted(slots) == list(range(size))
    if size > 50:
        assert (slots != training_order.permute(np.arange(size), size, 100)).any()


def test_shards_hold_every_sequence(spark, edges):
    out = shared_path(spark, "test_order")
    size = training_order.materialise(edges, out, seq_len=16, rows_per_shard=100)
    rows = training_order.read_shards(spark, out).collect()
    assert sorted(r.slot for r in rows) == list(range(size))
    assert all(r.shard_id == r.slot // 100 for r in rows)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        word = {int(rank): base64.b64decode(word) for word, rank in (line.split() for line in file)}
    texts = {}
    for r in sorted(rows, key=lambda r: r.seq_no):
        texts.setdefault(r.doc_id, []).append(np.frombuffer(r.tokens, "<u2"))
    assert b"".join(word[int(t)] for t in np.concatenate(texts[10]) if t != training_order.END_OF_TEXT) == b"a" * 5000
    assert {r.doc_id for r in rows} == {None, 5, 6, 7, 8, 9, 10}
    assert len([r for r in rows if r.doc_id == 6]) == 2 * len([r for r in rows if r.doc_id == 7])
    later = training_order.read_shards(spark, out, start=250).collect()
    assert sorted(r.slot for r in later) == list(range(250, size))


def test_no_sequences(spark, nothing):
    out = shared_path(spark, "test_order")
    assert training_order.materialise(nothing, out) == 0
    assert training_order.read_shards(spark, out).count() == 0


# --- token counts


def test_token_counts_and_cache(spark, edges, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cache = shared_path(spark, "test_cache")
    wanted = sorted((str(i), len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in EDGES)
    for _ in range(2):  # the second time nothing is missing
        found = token_count.count_tokens(edges, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == wanted
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == len({t or "" for _, t in EDGES})
    assert token_count.count_tokens(nothing, cache).count() == 0


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    """A batch of whole texts has at most a thousand rows; the session's own setting is left as it was."""
    import pyarrow as pa

    def encoder(name):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([batch.num_rows] * batch.num_rows, pa.int64())], ["digest", "n_tokens"])

        return run

    monkeypatch.setattr(token_count, "_encoder", encoder)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    found = token_count.count_tokens(documents(spark, [(i, f"text {i}") for i in range(9000)]).coalesce(1))
    assert 0 < found.agg({"n_tokens": "max"}).first()[0] <= 1000 and spark.conf.get(setting) == before


# --- language


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language_id.init(3, hidden=4).items()}
    x, y = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)
    _, grad = language_id.gradients(p, x, y)
    for k in p:
        for place in list(zip(*np.nonzero(grad[k]), strict=True))[:4]:
            moved = {n: v.copy() for n, v in p.items()}
            moved[k][place] += 1e-3
            up = language_id.gradients(moved, x, y)[0]
            moved[k][place] -= 2e-3
            assert abs((up - language_id.gradients(moved, x, y)[0]) / 2e-3 - grad[k][place]) < 1e-4


def test_windows_cover_each_byte_once():
    p = language_id.init(3)
    texts = [b"", b"x", b"abc " * 500, b"y" * 241]
    found = language_id.pooled(p, texts)
    assert np.allclose(found.sum(axis=1), [0, 1, 1, 1], atol=1e-4)
    short = np.frombuffer(texts[1], np.uint8)[:, None]
    assert np.allclose(language_id.label_positions(p, short, np.array([1]))[0, 0], found[1], atol=1e-5)


def test_fast_network_equals_the_plain_one():
    """Positions' probabilities of windows of several lengths, both directions, against the training network's states."""
    rng = np.random.default_rng(3)
    p = language_id.init(4)
    lengths = np.array([1, 7, 40, 40])
    windows = rng.integers(0, 256, (40, 4)).astype(np.uint8)
    found = language_id.label_positions(p, windows, lengths)
    for k, n in enumerate(lengths):
        x = windows[:n, k:k + 1]
        forward = np.stack([s[5] for s in language_id._run(p, "f", x)])[:, 0]
        backward = np.stack([s[5] for s in language_id._run(p, "b", x[::-1])])[::-1][:, 0]
        logits = forward @ p["Wf"] + backward @ p["Wb"] + p["bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        assert np.allclose(found[:n, k], prob / prob.sum(axis=1, keepdims=True), atol=1e-4)


def test_context_is_enough():
    """Windows with a few bytes of context give nearly what one pass over the whole text gives, under a trained network."""
    rng = random.Random(4)
    parts = {0: ["the", "th", "ing", "er", "and"], 1: ["sch", "ung", "ich", "der"], 2: ["eau", "oi", "les", "que"]}
    text = lambda k: " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 3))) for _ in range(200)).encode()
    labels = [i % 3 for i in range(60)]
    p = language_id.train([text(k) for k in labels], labels, 3, steps=120)
    for k in range(3):
        one = text(k)
        whole = language_id.label_positions(p, np.frombuffer(one, np.uint8)[:, None], np.array([len(one)]))[:, 0].mean(axis=0)
        assert np.abs(language_id.pooled(p, [one])[0] - whole).max() < 0.02


def test_sample_counts_copies_once(spark):
    rows = [(i, "the same text of one language", "en", "s") for i in range(300)] + [(1000 + i, f"text number {i} is another", "en", "s") for i in range(100)] + [(2000, "seul", "fr", "s")]
    found = language_id.training_windows(documents(spark, rows), per_language=50).collect()
    assert len(found) == 51 and len({r.piece for r in found}) == 51


def test_languages_are_told_apart(spark, edges, nothing):
    rng = random.Random(3)
    parts = {"en": ["the", "th", "ing", "er", "and"], "de": ["sch", "ung", "ich", "der", "ü"], "fr": ["eau", "oi", "é", "les", "que"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(40)), lang, "s") for i, lang in ((i, rng.choice(list(parts))) for i in range(300))]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(held) == sorted(i for i, r in found.items() if r.held_out)
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    model = language_id.fit(docs)
    odd = language_id.identify(edges, model).collect()
    assert len(odd) == len(EDGES) and {r.lang_pred for r in odd if r.doc_id in (3, 4, 5)} == {"und"}
    assert language_id.language_id(nothing).count() == 0
    assert {r.lang_pred for r in language_id.language_id(edges).collect()} == {"und"}  # no label to learn from


# --- pages


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x = "</p><p>no";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice">We use cookies, many of them, all of the time.</div>
%s<aside>Other things that are long enough to be taken for text by their length alone.</aside>
<div id=comments><p>I disagree with all of this, and here are a great many words that say why.</p></div>
<form><label>Mail</label><input name=q><button>Go</button></form><footer>&copy; nobody in particular, with a footer of some length.</footer></body></html>"""


@pytest.mark.parametrize("body", [
    "<article><h1>A &amp; B</h1><p>First   paragraph\n with <b>bold</b> words and <a href=x>a link</a>.<p>Second one,<br>broken &eacute;.</article>",
    "<div class=wrap><div class=content><h1>A &amp; B</h1><p>First   paragraph\n with <b>bold</b> words and <a href=x>a link</a>.</p><p>Second one,<br>broken &eacute;.</p></div></div>",
    "<main><h1>A &amp; B</h1><p>First   paragraph\n with <b>bold</b> words and <a href=x>a link</a>.<div class=ad>Buy</div><p>Second one,<br>broken &eacute;.</main>"])
def test_article_is_found(body):
    assert html_text.main_text(PAGE % body) == "A & B\n\nFirst paragraph with bold words and a link.\n\nSecond one, broken é."


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "plain words, no tag"), (4, "u", "<p>a</p></div></p><p>b<br/>c"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<script>only"), (6, "u", "<script>only"), (7, "u", "<p>x < y &amp; <b>z"), (8, "u", "<!-- open")]
    found = html_text.extract_text(spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in found}
    assert len(found) == len(pages) and by[1] == by[2] == by[6] == by[8] == "" and by[None] == "plain words, no tag" and by[4] == "a\n\nb c" and by[5] == "deep"
    assert all(r.n_chars == len(r.text) for r in found)


# --- language model


def tokens_of(text):
    return [*SPACE.findall(lower(text)), None]


def plain_scores(rows, known_words, context_words):
    """Base and model scores of (id, text) rows by dictionaries, with the same smoothing and quantised counts."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    training = [tokens_of(t) for i, t in rows if not held(i)]
    counts = collections.Counter(w for t in training for w in t)
    total = sum(counts.values()) + 0.5 * (len(counts) + 1)
    top = lambda most: {w for w in counts if sum(n >= counts[w] for n in counts.values()) <= most}
    contexts, known = top(context_words), top(known_words)
    least = min((counts[w] for w in known), default=1)
    shown = lambda n, least: least * bloom_lm.LEVEL ** (np.floor(np.log(n / least) / np.log(bloom_lm.LEVEL) + 1e-9) + 0.5) if n else 0.0
    pairs = collections.Counter((v, w) for t in training for v, w in zip(["start", *t], t, strict=False) if w in contexts and (v == "start" or v in contexts))
    pairs = {k: shown(n, 2) for k, n in pairs.items() if n >= 2}
    taken = collections.Counter()
    for (v, _), n in pairs.items():
        taken[v] += n - bloom_lm.DISCOUNT

    def model(t):
        out = 0.0
        for v, w in zip(["start", *t], t, strict=False):
            p = (shown(counts[w], least if w in known else 1) + 0.5) / total
            if v == "start" or v in contexts:
                c = max(1, counts[None] if v == "start" else counts[v])
                p = p * (1 - min(0.98, taken[v] / c)) + max(0, pairs.get((v, w), 0) - bloom_lm.DISCOUNT) / c
            out += np.log10(min(1, p))
        return out

    out = []
    for i, text in rows:
        t = tokens_of(text)
        out.append((str(i), held(i), len(t), sum(w in counts for w in t), sum(counts.values()), sum(np.log10((counts[w] + 0.5) / total) for w in t), model(t)))
    return sorted(out)


@pytest.mark.parametrize(("known", "contexts"), [(1000, 1000), (40, 12), (3, 2)])
def test_scores_equal_a_plain_version(spark, monkeypatch, known, contexts):
    """With and without words that are joined by shuffle; the filter is so large that it makes no error."""
    rng = random.Random(5)
    rows = [*EDGES, *((i, prose(rng, rng.randint(1, 200), 60)) for i in range(20, 80))]
    for name, value in (("KNOWN_WORDS", known), ("CONTEXT_WORDS", contexts), ("BITS", 200)):
        monkeypatch.setattr(bloom_lm, name, value)
    found = sorted((str(r.doc_id), *r[1:]) for r in bloom_lm.score(documents(spark, rows).repartition(5)).collect())
    for one, other in zip(found, plain_scores(rows, known, contexts), strict=True):
        assert one[:5] == other[:5] and one[5] == pytest.approx(other[5]) and one[6] == pytest.approx(other[6])


def plain_scores_of_all_pairs(rows, known_words):
    """``plain_scores`` with every bigram of the training texts."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    training = [tokens_of(t) for i, t in rows if not held(i)]
    counts = collections.Counter(w for t in training for w in t)
    total = sum(counts.values()) + 0.5 * (len(counts) + 1)
    known = {w for w in counts if sum(n >= counts[w] for n in counts.values()) <= known_words}
    least = min((counts[w] for w in known), default=1)
    shown = lambda n, least: least * bloom_lm.LEVEL ** (np.floor(np.log(n / least) / np.log(bloom_lm.LEVEL) + 1e-9) + 0.5) if n else 0.0
    pairs = collections.Counter((v, w) for t in training for v, w in zip(["start", *t], t, strict=False))
    contexts = {**counts, "start": len(training)}
    taken = collections.Counter()
    for (v, _), n in pairs.items():
        taken[v] += shown(n, 1) - bloom_lm.DISCOUNT

    def model(v, w):
        p = (shown(counts[w], least if w in known else 1) + 0.5) / total
        if c := contexts.get(v):
            p = p * (1 - min(0.98, taken[v] / c)) + max(0, shown(pairs[v, w], 1) - bloom_lm.DISCOUNT) / c
        return np.log10(min(1, p))

    out = []
    for i, text in rows:
        t = tokens_of(text)
        out.append((str(i), held(i), len(t), sum(w in counts for w in t), sum(counts.values()), sum(np.log10((counts[w] + 0.5) / total) for w in t), sum(model(v, w) for v, w in zip(["start", *t], t, strict=False))))
    return sorted(out)


@pytest.mark.parametrize(("known", "bits"), [(1000, 1 << 27), (1000, 40_000), (40, 40_000), (3, 0)])
def test_all_bigrams_count_at_any_size_of_the_filter(spark, monkeypatch, known, bits):
    """What the filter has no room for is joined, and so are words and contexts that are not broadcast."""
    rng = random.Random(8)
    rows = [*EDGES, *((i, prose(rng, rng.randint(1, 200), 60)) for i in range(20, 80))]
    for name, value in (("KNOWN_WORDS", known), ("CONTEXT_WORDS", 5), ("BITS", 200), ("FILTER_BITS", bits)):
        monkeypatch.setattr(bloom_lm, name, value)
    found = sorted((str(r.doc_id), *r[1:]) for r in bloom_lm.score(documents(spark, rows).repartition(5), all_pairs=True).collect())
    for one, other in zip(found, plain_scores_of_all_pairs(rows, known), strict=True):
        assert one[:5] == other[:5] and one[5] == pytest.approx(other[5]) and one[6] == pytest.approx(other[6])
    found = sorted((str(r.doc_id), *r[1:]) for r in bloom_lm.score(documents(spark, rows)).collect())
    for one, other in zip(found, plain_scores(rows, known, 5), strict=True):
        assert one[:5] == other[:5] and one[6] == pytest.approx(other[6])


def test_score_predicts_held_out_text(spark, nothing):
    rng = random.Random(6)
    docs = documents(spark, [(i, prose(rng, rng.randint(1, 200), 60)) for i in range(120)])
    held_out = [r for r in bloom_lm.score(docs).collect() if r.held_out]
    assert all(r.score < 0 for r in held_out) and sum(r.score for r in held_out) > 1.1 * sum(r.base_score for r in held_out)
    assert bloom_lm.score(nothing).count() == 0


def test_keys_of_words():
    """Equal words have equal keys wherever they are, different ones don't; long words and blocks' ends too."""
    rng = random.Random(7)
    texts = ["", "  ", "A a\tB\x0bb\x1c", "x" * 64 + " " + "x" * 65 + " " + "y" * 300_000 + " a", "é É\u00a0É", *(prose(rng, 3000, 900) for _ in range(40))]
    keys, sizes = bloom_lm.Tokens()(texts)
    words = [w for t in texts for w in tokens_of(t)]
    assert len(words) == len(keys) == sizes.sum() and sizes.tolist() == [len(tokens_of(t)) for t in texts]
    assert len(set(zip(words, keys.tolist(), strict=True))) == len(set(words)) == len(set(keys.tolist()))


def test_filter_has_a_bound(spark, monkeypatch):
    """Where bigrams are too many for the filter, the rarer ones stay out, and scores stay probabilities."""
    rng = random.Random(8)
    docs = documents(spark, [(i, prose(rng, 300, 30)) for i in range(60)])
    monkeypatch.setattr(bloom_lm, "FILTER_BITS", 8000)
    assert all(r.score < 0 for r in bloom_lm.score(docs).collect())


def test_filter_counts_are_never_too_low():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    top = rng.integers(1, 12, 3000)
    segment_bits = 8192
    mixed = keys * np.uint64(3)
    bits = np.zeros(bloom_lm.SEGMENTS * segment_bits // 8, np.uint8)
    for segment in range(bloom_lm.SEGMENTS):
        own = mixed % np.uint64(bloom_lm.SEGMENTS) == segment
        part = bits[segment * segment_bits // 8:(segment + 1) * segment_bits // 8]
        for level in range(1, 12):
            for place in bloom_lm.Filter.places(mixed[own & (top >= level)], level, segment_bits):
                np.bitwise_or.at(part, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    found = bloom_lm.Filter(bits, segment_bits).levels(bloom_lm.UNIGRAM, keys)
    assert (found >= top).all() and (found == top).mean() > 0.9


# --- decontamination


def contaminated(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    out = []
    for doc_id, text in docs:
        words, hit, ids = split(text), set(), set()
        for item, t in items:
            own = split(t)
            k = min(10, len(own))
            windows = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else ()
            for i in range(len(words) - k + 1) if own else ():
                if tuple(words[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    ids.add(item)
        named = sorted(str(x) for x in ids if x is not None)
        out.append((str(doc_id), len(words), len(hit), len(ids), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [200_000, 30])  # in one pass, and in blocks of those that occur
def test_contamination(spark, nothing, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(8, 30))) for i in range(12)] + [(20, "Two words"), (21, "!?"), (22, None), (None, "null item here"), (9, "Ünïcode ß")]
    texts = []
    for i in range(40):
        words = prose(rng, rng.randint(0, 80)).split()
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1] or ""
            at = rng.randint(0, len(words))
            words[at:at] = own.upper().split()[rng.randint(0, 2):]
        texts.append((i, ", ".join(words)))
    rows = EDGES + texts + texts[:3] + [(60, "TWO...words two words"), (61, items[0][1] + " " + items[0][1])]
    benchmark = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, h long")
    docs = documents(spark, rows)
    wanted = contaminated(rows, items)
    found = decontaminate.find_contamination(docs, benchmark).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == wanted
    assert sum(x[-1] for x in wanted) > 10
    clean = decontaminate.remove_documents(docs, benchmark)
    assert clean.columns == docs.columns and not decontaminate.find_contamination(clean, benchmark).where("contaminated").count()
    spans = {r.doc_id: r.clean for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert spans[60] == "" and spans[61] == ""
    same_id = [(None, "two words and more"), (None, "other text of mine"), (7, "say two words"), (7, "two words"), (7, "nothing here")]
    assert sorted(r.clean for r in decontaminate.remove_spans(documents(spark, same_id), benchmark).collect()) == ["", "and more", "nothing here", "other text of mine", "say"]
    assert sorted(r.text for r in decontaminate.remove_documents(documents(spark, same_id), benchmark).collect()) == ["nothing here", "other text of mine"]
    assert decontaminate.find_contamination(nothing, benchmark).count() == 0
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


# --- lines


@pytest.mark.parametrize("block", [4096, 2])
def test_line_classes(spark, nothing, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(11)
    lines = [prose(rng, rng.randint(8, 40), 3000) for _ in range(60)]

    def near(line):
        words = line.split()
        words[rng.randrange(len(words))] = "changed"
        return " ".join(words)

    rows = [(i, "\n".join(rng.choice([rng.choice(lines), near(rng.choice(lines)), "Short one", "", prose(rng, 12, 3000)]) for _ in range(rng.randint(1, 8)))) for i in range(80)]
    chain = [prose(rng, 40, 3000)]
    for _ in range(12):
        chain.append(near(chain[-1]))  # linked one by one, the ends are far apart
    rows += [(100 + i, line) for i, line in enumerate(chain)] + EDGES + [(5, "   \n\t")]
    found = line_dedup.dedup_lines(documents(spark, rows).repartition(6), all_lines=False).collect()
    places = [((i is None, i), k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    assert len(found) == len(places)
    norm = lambda x: " ".join(x.lower().split())
    fit = lambda x: x.count(" ") >= 4 and len(x) >= 8
    texts = sorted({norm(x) for _, _, x in places if fit(norm(x))})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if line_dedup.jaccard(a, b) >= line_dedup.SIMILARITY:
            root[find(a)] = find(b)
    keep = {}
    for (last, i), k, line in sorted(places, key=lambda p: (p[0][0], p[0][1] or 0, p[1])):
        if fit(norm(line)):
            keep.setdefault(find(norm(line)), (i, k))
    wanted = sorted((str(i), k, *(map(str, keep[find(norm(line))]) if fit(norm(line)) else (str(i), str(k)))) for (_, i), k, line in places)
    assert sorted((str(r.doc_id), r.line_no, str(r.class_doc_id), str(r.class_line_no)) for r in found) == wanted
    assert all(r.kept == (r.doc_id == r.class_doc_id and r.line_no == r.class_line_no) for r in found)
    assert len({(r.class_doc_id, r.class_line_no) for r in found if r.doc_id and r.doc_id >= 100}) == 1
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_candidates_of_scattered_edits():
    """Pairs at a similarity of 0.8 to 0.83 whose edits lie all over the line: the share that no band brings together is small."""
    rng = random.Random(41)
    ones, others = [], []
    while len(ones) < 1500:
        one = list(prose(rng, 60, 5000))
        other = one[:]
        for at in rng.sample(range(len(one)), len(one) // 85 + 1):
            other[at] = rng.choice("qrstuvwxyz")
        a, b = "".join(one), "".join(other)
        if 0.8 <= line_dedup.jaccard(a, b) < 0.83:
            ones.append(a)
            others.append(b)
    missed = ~(line_dedup.band_keys(ones) == line_dedup.band_keys(others)).any(axis=1)
    assert missed.mean() < 0.01


def test_long_text_loses_many_lines(spark):
    """A text of very many lines, all but a few of which an earlier one has."""
    lines = [f"this is line number {i} of a long text {i * 7919}" for i in range(20_000)]
    docs = documents(spark, [(1, "\n".join(lines)), (2, "\n".join([lines[5], "a line of its own", *lines, "and one more of its own"]))])
    began = time.time()
    found = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, all_lines=True).collect()}
    assert time.time() - began < 120
    assert found[2].startswith("a line of its own") and found[2].endswith("and one more of its own") and found[2].count("\n") < 200 and len(found[1].split("\n")) > 100


def test_bucket_is_compared_in_full():
    rng = random.Random(37)
    base = [prose(rng, 40, 500) for _ in range(4)]
    lines = []
    for _ in range(40):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "changed"
        lines.append(" ".join(words))
    lines = sorted(set(lines))
    keys = rng.sample(range(10**6), len(lines))

    def joined(pairs):
        root = {k: k for k in keys}
        for a, b in pairs:
            x, y = root[a], root[b]
            root = {k: x if v == y else v for k, v in root.items()}
        return {frozenset(k for k in keys if root[k] == v) for v in root.values()}

    near = [(a, b) for (a, x), (b, y) in itertools.combinations(zip(keys, lines, strict=True), 2) if line_dedup.jaccard(x, y) >= line_dedup.SIMILARITY]
    whole = line_dedup.cross_links(keys, keys, [0] * len(keys), lines)
    assert joined(whole) == joined(near) and len(whole) < len(near)
    blocks = [[i for i in range(len(keys)) if keys[i] % 3 == b] for b in range(3)]
    parts = []
    for x, y in itertools.combinations_with_replacement(range(3), 2):
        rows = sorted({*blocks[x], *blocks[y]})
        parts += line_dedup.cross_links([keys[i] for i in rows], [keys[i] for i in rows], [keys[i] % 3 for i in rows], [lines[i] for i in rows])
    assert joined(parts) == joined(near)


def test_texts_without_repeated_lines(spark):
    line = "these are enough words for one line of text"
    docs = documents(spark, [(1, line + "\nshort\n" + line), (2, line), (3, "other words that are no copy at all, none\n\n" + line.upper()), (4, None), (5, ""), (6, line + "\nshort")])
    out = line_dedup.drop_repeated_lines(docs, all_lines=False)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: line + "\nshort", 3: "other words that are no copy at all, none\n", 4: None, 5: "", 6: "short"}


def test_query_has_short_lines_and_lines_without_blanks(spark, tmp_path):
    long = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(60))
    near = long[:-1] + "x"
    rows = [(1, f"Short\n\n{long}\nA heading here"), (2, f"short\n\n{near}\nfresh"), (3, f"A  heading here\n{long}\nno")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.kept) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    first = {(2, 0): (1, 0), (2, 2): (1, 2), (3, 0): (1, 3), (3, 1): (1, 2)}
    assert found == {(i, k): (*first.get((i, k), (i, k)), (i, k) not in first) for i, t in rows for k in range(len(t.split("\n")))}


def test_star_buckets_across_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 5), (1, 7), (2, 1), (2, 9), (2, 9), (2, 11), (3, 4)]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_pydict({"band": [r[0] for r in rows[i:i + size]], "key": [r[1] for r in rows[i:i + size]]}) for i in range(0, len(rows), size)]
        found = [tuple(x.values()) for b in line_dedup._stars(iter(batches)) for x in b.to_pylist()]
        assert found == [(1, 5, 7), (2, 1, 9), (2, 1, 11)]


def test_star_buckets_whose_keys_come_in_any_order():
    import random

    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted(((rng.randrange(-40, 40), rng.randrange(12)) for _ in range(300)), key=lambda r: r[0])
    buckets = {band: {k for b, k in rows if b == band} for band, _ in rows}
    for size in (1, 2, 7, 50, 300):
        batches = [pa.RecordBatch.from_pydict({"band": [r[0] for r in rows[i:i + size]], "key": [r[1] for r in rows[i:i + size]]}) for i in range(0, len(rows), size)]
        found = [tuple(x.values()) for b in line_dedup._stars(iter(batches)) for x in b.to_pylist()]
        assert all(len({c for b, c, _ in found if b == band}) == (len(keys) > 1) for band, keys in buckets.items())
        assert {(b, k) for b, c, key in found for k in (c, key)} == {(b, k) for b, keys in buckets.items() if len(keys) > 1 for k in keys}
        assert all(c != k for _, c, k in found)


def test_alike_is_the_exact_similarity():
    import random

    rng = random.Random(5)
    for n in (8, 9, 20, 60, 200):
        for _ in range(60):
            a = "".join(rng.choice("abcd ") for _ in range(n))
            at, gone = rng.randrange(n), rng.randrange(1 + n // 5)
            b = (a[:at] + rng.choice(["", "x", "yy"]) + a[at + gone:]).ljust(8, "z")
            x, y = line_dedup._distinct([a, b])
            assert line_dedup._alike(a, b, x, y) == (line_dedup.jaccard(a, b) >= line_dedup.SIMILARITY)


# --- quality


def base_statistics(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    repeated = {k for i, w in enumerate(windows) if w in twice for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics(spark, nothing):
    rng = random.Random(13)
    texts = []
    for i in range(60):
        part = prose(rng, rng.randint(3, 30), 50)
        texts.append((i, "\n".join(rng.choice([part, prose(rng, 9, 50), "a # b", " ", part + " " + part]) for _ in range(rng.randint(0, 9))), rng.choice(["en", None]), "s"))
    rows = [(*e, None, None) for e in EDGES] + texts
    found = quality.judge(documents(spark, rows)).collect()
    wanted = sorted((str(r[0]), *base_statistics(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == wanted
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(nothing).count() == 0


def test_robust_outliers(spark):
    rng = random.Random(17)
    good = [(i, prose(rng, rng.randint(40, 200), 2000), "en", "a") for i in range(400)]
    bad = [(1000 + i, " ".join(w + "###$$$" for w in prose(rng, 60, 2000).split()), "en", "a") for i in range(60)]
    found = {r.doc_id: r for r in quality.judge(documents(spark, good + bad)).collect()}
    assert not any(found[r[0]].kept for r in bad)
    assert sum(found[r[0]].kept for r in good) >= 398
    few = quality.judge(documents(spark, good[:10])).collect()
    assert all(r.kept and r.distance is not None for r in few)  # all rows together are their group


# --- pieces


@pytest.fixture(scope="module")
def pieces():
    return piece_nbest.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def all_paths(pieces, segment):
    done, todo = [], [(0.0, (), len(segment))]
    while todo:
        score, ids, at = todo.pop()
        if not at:
            done.append((score, ids))
            continue
        todo += [(score + s, piece + ids, start) for start, s, piece in pieces.edges(segment, at)]
    return sorted((-s, i) for s, i in done)


def nbest(segments, text, count=piece_nbest.NBEST):
    (_, _, every), = segments.segmented([text], count)
    return [(score, np.frombuffer(ids, np.int32).tolist()) for score, _, ids in every]


@pytest.mark.parametrize("text", ["the cat", "a  b", "héllo", " x", "𝄞a", "ab\ncd e"])
def test_nbest_of_short_texts(pieces, text):
    found = nbest(piece_nbest.Segments(pieces), text, 6)
    whole = all_paths(pieces, piece_nbest.marked(text))
    assert [round(-s, 6) for s, _ in found] == [round(s, 6) for s, _ in whole[:6]]
    assert len({tuple(i) for _, i in found}) == len(found) and {tuple(i) for _, i in found} <= {i for _, i in whole}
    assert all(pieces.decode(i) == text for _, i in found)
    if len(whole) > 1:
        assert abs(pieces.forward(piece_nbest.marked(text))[2] - (whole[1][0] - whole[0][0])) < 1e-6


def test_forward_pass_for_many(pieces):
    rng = random.Random(31)
    words = sorted({piece_nbest.SPACE * rng.randint(0, 2) + "".join(rng.choices("abcdeéü\n𝄞ñ.,*▁"[:-1], k=rng.randint(1, 20))) for _ in range(300)})
    found = dict(pieces.forward_many(words))
    assert sorted(found) == words
    for word in words:
        best, ids, loss = pieces.forward(word)
        assert found[word] == (best[-1], ids, loss)


@pytest.mark.parametrize("text", ["ab" * 9, "aaaaaaaaaa", "thecatsat", "eeeéee"])
def test_search_of_ties(pieces, text):
    """Many paths share a score: the scores are those of the best ones and the paths differ."""
    found, whole = pieces.search(text, 5), all_paths(pieces, text)
    assert [round(-s, 6) for s, _ in found] == [round(s, 6) for s, _ in whole[:5]]
    assert len({ids for _, ids in found}) == len(found) and {ids for _, ids in found} <= {ids for _, ids in whole}


def test_long_segments_in_proportion(pieces):
    """A text without a space is one segment; twice the length takes about twice the time."""
    rng, took = random.Random(5), []
    segments = piece_nbest.Segments(pieces)
    for n in (50_000, 200_000):
        for text in ("a" * n, "".join(rng.choices("abcdefgh", k=n))):
            began = time.process_time()
            (decoded, same, every), = segments.segmented([text], 4)
            took.append(time.process_time() - began)
            assert decoded == text and same and len({ids for _, _, ids in every}) == 4
            assert [s for s, _, _ in every] == sorted((s for s, _, _ in every), reverse=True)
    assert max(took[2:]) < 10 * max(took[:2]) and max(took) < 60


def test_segmentation_round_trip(spark, edges, nothing):
    found = piece_nbest.segment_nbest(edges, with_ids=True).collect()
    assert len(found) == len(EDGES) and all(r.round_trip for r in found)
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) and len(r.nbest_scores) <= piece_nbest.NBEST for r in found)
    assert {r.n_pieces for r in found if r.doc_id in (3, 4)} == {0}
    assert piece_nbest.segment_nbest(nothing).count() == 0


def test_query_returns_all_segmentations(spark, tmp_path, pieces):
    texts = [(1, "the cat  sat on\nthe mat"), (2, "Ünïcode ß 𝄞 é " * 3), (3, None), (4, ""), (None, "a  b"), (5, "word " * 3000)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op9_piece_nbest(spark, str(tmp_path)).collect()}
    segments = piece_nbest.Segments(pieces)
    for i, text in texts:
        whole = nbest(segments, text or "")
        row = found[i]
        assert row.decoded == (text or "") and row.nbest_scores == [s for s, _ in whole] and row.ids == [ids for _, ids in whole]
        assert row.nbest_sha256 == [hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest() for _, ids in whole]
        assert row.nbest_sha256[0] == row.ids_sha256 and row.nbest_sizes == list(map(len, row.ids)) and len(set(row.nbest_sha256)) == len(whole)


# --- simhash


def brute_fingerprint(text):
    words = SPACE.findall(lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_trie_finds_all_pairs():
    rng = random.Random(19)
    for bits, n in ((8, 60), (32, 400)):
        centers = [rng.getrandbits(bits) for _ in range(12)]
        values = sorted({c ^ sum(1 << rng.randrange(bits) for _ in range(rng.randint(0, 1))) ^ (1 << rng.randrange(bits)) for c in rng.choices(centers, k=n)})
        values = [v & (1 << bits) - 1 for v in values]
        values = sorted(set(values))
        found = {(min(i, j), max(i, j)) for a, b in simhash.trie_pairs(np.array(values, np.uint64), np.array([0, len(values)]), bits, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert found == {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2}


def test_near_duplicates(spark, nothing, monkeypatch):
    rng = random.Random(23)
    rows = list(EDGES)
    for i in range(60):
        text = prose(rng, 150, 5000)
        rows.append((100 + 10 * i, text))
        for k in range(1, rng.randint(1, 6)):
            words = text.split()
            words[rng.randrange(len(words))] = "edited"
            rows.append((100 + 10 * i + k, " ".join(words)))
    rows += [(2000 + i, rows[-1][1]) for i in range(20)]
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    found = simhash.near_duplicates(documents(spark, rows).repartition(5)).collect()
    marks = [brute_fingerprint(t) for _, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == sorted((str(i), f"{m:016x}") for (i, _), m in zip(rows, marks, strict=True))
    distinct = sorted(set(marks))
    root = {m: m for m in distinct}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    lowest = {}
    for (i, _), m in zip(rows, marks, strict=True):
        if i is not None:
            lowest[find(m)] = min(i, lowest.get(find(m), i))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted((str(i), str(lowest.get(find(m)))) for (i, _), m in zip(rows, marks, strict=True))
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(lowest.values())
    assert simhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(29)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1064)] + [(None, 3), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
