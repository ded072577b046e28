"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_remainder, stored

HIDDEN = 12
#: Training windows for each language and their characters: the bound of what reaches the driver.
WINDOWS_PER_LANGUAGE = 1000
WINDOW_CHARS = 160
STEPS, BATCH, TRAIN_BYTES = 360, 192, 64
#: Bytes that one window labels, bytes of context on either side of them, and windows run side by side.
CORE, CONTEXT, SIDE_BY_SIDE = 240, 8, 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(languages: int, seed: int = 7, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Random parameters: for each direction input rows of a byte (E) and recurrent weights (U), then the output layer."""
    rng = np.random.default_rng(seed)
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    out = {f"E{d}": make(256, 3 * hidden, scale=0.3) for d in "fb"} | {f"U{d}": make(hidden, 3 * hidden, scale=hidden ** -0.5) for d in "fb"}
    return out | {f"W{d}": make(hidden, languages, scale=hidden ** -0.5) for d in "fb"} | {"bias": np.zeros(languages, np.float32)}


def _run(p: dict, d: str, x: np.ndarray) -> list[tuple]:
    """States of one direction over x [time, batch]: (previous, reset, update, candidate, recurrent part, state) for each step."""
    hidden = p["U" + d].shape[0]
    h, steps = np.zeros((x.shape[1], hidden), np.float32), []
    for row in x:
        e, g = p["E" + d][row], h @ p["U" + d]
        r, z = _sigmoid(e[:, :hidden] + g[:, :hidden]), _sigmoid(e[:, hidden:2 * hidden] + g[:, hidden:2 * hidden])
        n = np.tanh(e[:, 2 * hidden:] + r * g[:, 2 * hidden:])
        new = (1 - z) * n + z * h
        steps.append((h, r, z, n, g[:, 2 * hidden:], new))
        h = new
    return steps


def gradients(p: dict, x: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of every position's label and its gradient, by backpropagation through time."""
    time, batch = x.shape
    runs = {"f": _run(p, "f", x), "b": _run(p, "b", x[::-1])}
    states = {"f": np.stack([s[5] for s in runs["f"]]), "b": np.stack([s[5] for s in runs["b"]])[::-1]}
    logits = states["f"] @ p["Wf"] + states["b"] @ p["Wb"] + p["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    at = np.arange(batch)
    loss = -np.log(prob[:, at, labels] + 1e-9).mean()
    delta = prob
    delta[:, at, labels] -= 1
    delta /= time * batch
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["bias"] = delta.sum(axis=(0, 1))
    for d in "fb":
        rows, out = (x, delta) if d == "f" else (x[::-1], delta[::-1])
        hidden = p["U" + d].shape[0]
        grad["W" + d] = np.einsum("tbh,tbk->hk", states[d], delta, optimize=True)
        later = np.zeros((batch, hidden), np.float32)
        for t in range(time - 1, -1, -1):
            before, r, z, n, g, _ = runs[d][t]
            dh = out[t] @ p["W" + d].T + later
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (before - n) * z * (1 - z), dn * g * r * (1 - r)
            into = np.concatenate([dr, dz, dn * r], axis=1)
            np.add.at(grad["E" + d], rows[t], np.concatenate([dr, dz, dn], axis=1))
            grad["U" + d] += before.T @ into
            later = dh * z + into @ p["U" + d].T
    return float(loss), grad


def train(texts: list[bytes], labels: list[int], languages: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted to labelled windows with Adam; each step draws languages evenly."""
    p, rng = init(languages, seed), np.random.default_rng(seed)
    by = [[t for t, k in zip(texts, labels, strict=True) if k == lang and t] for lang in range(languages)]
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        ys = rng.permutation(np.arange(BATCH) % languages)
        x = np.full((BATCH, TRAIN_BYTES), 32, np.uint8)
        for row, y in zip(x, ys, strict=True):
            text = by[y][rng.integers(len(by[y]))]
            at = rng.integers(max(1, len(text) - TRAIN_BYTES + 1))
            part = np.frombuffer(text[at:at + TRAIN_BYTES], np.uint8)
            row[:len(part)] = part
        _, grad = gradients(p, np.ascontiguousarray(x.T), ys)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1, 20 / step if step < 20 else 1) * (1 - step / (steps + 1))
        for k, g in grad.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.98 * second[k] + 0.02 * g * g
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.98 ** step)) + 1e-8)).astype(np.float32)
    return p


def _forward(p: dict, d: str, x: np.ndarray) -> np.ndarray:
    """Output contributions [time, batch, language] of one direction, in buffers that are used again."""
    u, e, hidden = p["U" + d], p["E" + d], p["U" + d].shape[0]
    cut = [np.ascontiguousarray(m[:, k * hidden:(k + 1) * hidden]) for m in (e, u) for k in range(3)]
    er, ez, en, ur, uz, un = (m * np.float32(s) for m, s in zip(cut, (0.5, 0.5, 1, 0.5, 0.5, 1), strict=True))
    time, batch = x.shape
    h = np.zeros((batch, hidden), np.float32)
    a, z, n, w = (np.empty_like(h) for _ in range(4))
    out = np.empty((time, batch, p["W" + d].shape[1]), np.float32)
    for t in range(time):
        row = x[t]
        for gate, inputs, weights in ((a, er, ur), (z, ez, uz)):
            np.dot(h, weights, out=gate)
            np.take(inputs, row, axis=0, out=w, mode="clip")
            gate += w
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        np.dot(h, un, out=n)
        n *= a
        np.take(en, row, axis=0, out=w, mode="clip")
        n += w
        np.tanh(n, out=n)
        h -= n
        h *= z
        h += n
        np.dot(h, p["W" + d], out=out[t])
    return out


def label_positions(p: dict, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Language probabilities [time, batch, language] of each byte of windows [time, batch], each ``lengths`` long."""
    time = windows.shape[0]
    at = np.arange(time)[:, None]
    back = np.where(at < lengths, lengths - 1 - at, at)  # each window reversed in its own length
    logits = _forward(p, "f", windows)
    logits += np.take_along_axis(_forward(p, "b", np.take_along_axis(windows, back, 0)), back[:, :, None], 0)
    logits += p["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def pooled(p: dict, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all byte positions of each whole text, by overlapping windows."""
    k = len(p["bias"])
    totals = np.zeros((len(texts), k))
    owner, start, length = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, len(text), CORE):
            owner.append(i)
            start.append(at)
            length.append(min(CORE, len(text) - at))
    owner, start, length = (np.array(v, np.int64) for v in (owner, start, length))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offset = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    if len(owner):
        lead, tail = np.minimum(start, CONTEXT), np.minimum(sizes[owner] - start - length, CONTEXT)
        whole = lead + length + tail
    for part in np.array_split(np.argsort(length, kind="stable"), -(-len(owner) // SIDE_BY_SIDE)) if len(owner) else []:
        time = int(whole[part].max())
        at = np.arange(time)[:, None]
        index = offset[owner[part]] + start[part] - lead[part] + np.minimum(at, whole[part] - 1)
        probs = label_positions(p, data[index], whole[part])
        inside = (at >= lead[part]) & (at < lead[part] + length[part])
        np.add.at(totals, owner[part], np.einsum("tbk,tb->bk", probs, inside.astype(np.float32), optimize=True))
    return totals / np.maximum(sizes, 1)[:, None]


def _predictor(p: dict, languages: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < 4_000_000:
                    text = batch.column("text")[at + len(texts)].as_py()
                    if text is None or not any(map(str.isalpha, text)):
                        text = ""
                    texts.append(text.encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                at += len(texts)
                probs = pooled(p, texts)
                best = probs.argmax(axis=1)
                names += [languages[k] if text else "und" for text, k in zip(texts, best, strict=True)]
                scores += [min(1.0, float(row[k])) if text else 0.0 for text, row, k in zip(texts, probs, best, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


#: Times the bound that the draw by thresholds aims at, so that a rank of what is left fills the bound.
AMPLE = 4


def training_windows(docs: DataFrame, lang_col: str = "lang", per_language: int = WINDOWS_PER_LANGUAGE) -> DataFrame:
    """(lang, piece): at most ``per_language`` windows of labelled text for each language, from anywhere in their texts.

    The choice follows a hash of the text, so it is the same on every run and spreads over the
    table; copies count once. Different texts are counted by language first, and only those go on
    whose hash lies under the share that gives ``AMPLE`` times the bound: what is ranked is small,
    however many rows a language has.
    """
    seed = F.xxhash64("text")
    at = F.pmod(seed, F.greatest(F.length("text") - WINDOW_CHARS, F.lit(1))) + 1
    rows = docs.where(F.col(lang_col).isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64("text", F.lit(1)).alias("draw"), F.col("text").substr(at.cast("int"), F.lit(WINDOW_CHARS)).alias("piece"))
    sizes = stored(rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")), "languages")
    share = F.col("draw") / F.lit(2.0 ** 64) + 0.5
    ample = rows.join(sizes, "lang").where(share * F.col("n") <= AMPLE * per_language).groupBy("lang", "draw").agg(F.min("piece").alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return ample.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "piece")


def fit(docs: DataFrame, lang_col: str = "lang") -> tuple[dict, list[str]]:
    """Network and language names learned from a bounded sample of labelled rows; none where no row has a label."""
    sample = training_windows(docs, lang_col).orderBy("lang", "piece").collect()
    languages = sorted({r.lang for r in sample})
    index = {lang: k for k, lang in enumerate(languages)}
    texts = [r.piece.encode("utf-8", "surrogatepass") for r in sample]
    return (train(texts, [index[r.lang] for r in sample], len(languages)) if languages else {}), languages


def identify(docs: DataFrame, model: tuple[dict, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` by a fitted model.

    The network labels every byte of the whole text from the states of both directions; a
    document's probabilities are the mean over its positions, and the score is the largest. Texts
    run in windows of ``CORE`` bytes with ``CONTEXT`` bytes on either side. A text that is null or
    has no letter is ``und`` with score 0, as is every text under a model without languages.
    Ids may be null or repeat; other columns are not used.
    """
    p, languages = model
    rows = documents(docs, id_col, text_col)
    if not languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predictor(p, languages), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True for documents that are not learned from."""
    return id_remainder(F.col(doc_id), 3) == 1


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a network learned from the documents that are not held out, applied to all."""
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
