"""Language identification: averaged hashed subword embeddings with a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample; as the
model is linear after the average, embeddings times weights are one small table
that goes to the tasks. Probabilities are calibrated by a temperature, and a
score below which predictions are not trusted is set on texts left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import hashed_first, mapped, scope, settle
from locusforge.llm.words import LOWER, SPACE, chunks, sums, text_sums

#: Labelled rows used for training, for each language; the choice is by a hash of the key.
SAMPLE_PER_LANGUAGE = 400
#: Characters of a text in the sample.
SAMPLE_CHARS = 50_000
BUCKET_BITS = 15
DIMENSIONS = 16
SIZES = (1, 2, 3, 4)
EPOCHS = 6
RATE = 0.5
#: Share of right predictions that accepted texts should reach.
PRECISION = 0.98
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray
    temperature: float
    accept: float


def is_held_out(key: str = "doc_id") -> Column:
    """Rows never learned from: the CRC-32 of the key as text leaves 2 when divided by 4. A null key isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def subwords(data: np.ndarray, limits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the bucket of every byte run inside a word, a space at either side included, and the runs' limits.

    ASCII letters and those of the Latin-1 block are lowered.
    """
    low = LOWER[data].astype(np.uint32)
    after = np.zeros(len(low), bool)
    after[1:] = data[:-1] == 0xC3
    low[after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
    space = SPACE[data]
    low[space] = 32
    text_end = np.zeros(len(low) + 1, bool)
    text_end[limits[1:-1]] = True
    out = []
    for size in SIZES:
        n = len(low) - size + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(limits), np.int64)))
            continue
        packed = np.zeros(n, np.uint32)
        inside = np.ones(n, bool)
        for k in range(size):
            packed = (packed << np.uint32(8)) | low[k : k + n]
            if 0 < k < size - 1:
                inside &= ~space[k : k + n]
            if k:
                inside &= ~text_end[k : k + n]
        if size == 1:
            inside &= ~space
        elif size == 2:
            inside &= ~(space[:n] & space[1:])
        at = np.flatnonzero(inside)
        mixed = packed[at] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA77 & 0xFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.searchsorted(at, limits)))
    return out


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    out = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        buckets = np.concatenate([b for b, _ in subwords(data, np.array([0, len(data)]))])
        found, counts = np.unique(buckets, return_counts=True)
        out.append((found, counts / max(1, len(buckets))))
    return out


def train(rows: list[tuple[str, str]], seed: int = 11) -> Model | None:
    """Fit on (text, language) rows; None if there are none. Every fifth row sets temperature and acceptance."""
    rows = [(t, l) for t, l in rows if t and any(c.isalpha() for c in t)]
    if not rows:
        return None
    random = np.random.default_rng(seed)
    languages = sorted({l for _, l in rows})
    index = {l: i for i, l in enumerate(languages)}
    pieces, labels, check = [], [], []
    for n, (text, language) in enumerate(rows):
        words = text.split(" ")
        start, size = int(random.integers(len(words))), int(random.integers(1, 25))
        for piece in (text, " ".join(words[start : start + size])):
            if any(c.isalpha() for c in piece):
                pieces.append(piece)
                labels.append(index[language])
                check.append(n % 5 == 0)
    features, labels, check = _features(pieces), np.array(labels), np.array(check)
    if check.all():
        check[:] = False
    embeddings = random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weights = np.zeros((DIMENSIONS, len(languages)))
    learn = np.flatnonzero(~check)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(learn):
            buckets, share = features[i]
            hidden = share @ embeddings[buckets]
            p = _softmax(hidden @ weights)
            p[labels[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            # shares are small, so the embeddings of a text move by a larger step
            embeddings[buckets] -= 20 * rate * np.outer(share, back)
    table = embeddings @ weights
    held = np.flatnonzero(check) if check.any() else learn
    logits = np.stack([features[i][1] @ table[features[i][0]] for i in held])
    truth = labels[held]
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    scores = _softmax(logits / temperature)
    best, right = scores.max(axis=1), scores.argmax(axis=1) == truth
    order = np.argsort(-best)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    accept = float(best[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(languages, table.astype(np.float32), temperature, accept)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _has_letter(chunk) -> np.ndarray:
    low = chunk.data | 0x20
    found = sums((low >= 97) & (low <= 122), chunk.limits) > 0
    for t in np.flatnonzero(~found):
        text = chunk.data[chunk.limits[t] : chunk.limits[t + 1]].tobytes().decode()
        found[t] = any(c.isalpha() for c in text)
    return found


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("__text")):
            names = np.full(chunk.n, UNKNOWN, object)
            scores, accepted = np.zeros(chunk.n), np.zeros(chunk.n, bool)
            known = _has_letter(chunk) if model else np.zeros(chunk.n, bool)
            if known.any():
                total, count = np.zeros((chunk.n, len(model.languages))), np.zeros(chunk.n)
                for buckets, limits in subwords(chunk.data, chunk.limits):
                    count += np.diff(limits)
                    for c in range(len(model.languages)):
                        total[:, c] += text_sums(model.table[buckets, c], limits)
                p = _softmax(total / np.maximum(count, 1)[:, None] / model.temperature)
                best = p.argmax(axis=1)
                names[known] = np.array(model.languages, object)[best[known]]
                scores[known] = p.max(axis=1)[known]
                accepted = known & (scores >= model.accept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__key").slice(chunk.first, chunk.n),
                    batch.column("__held").slice(chunk.first, chunk.n),
                    pa.array(names, pa.string()),
                    pa.array(scores),
                    pa.array(accepted),
                ],
                names=["key", "held_out", "lang_pred", "score", "accepted"],
            )


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the rows that aren't held out and have a language.

    At most ``SAMPLE_PER_LANGUAGE`` rows of each language, the first by a hash
    of the key, are read by the driver, and of each text ``SAMPLE_CHARS``
    characters: the only bounds of the fit.
    """
    known = docs.where(~is_held_out(key) & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(key, lang)
    with scope():
        picked = settle(hashed_first(known, lang, key, SAMPLE_PER_LANGUAGE).select(key).distinct(), "language_sample")
        piece = F.substring(text, 1, SAMPLE_CHARS).alias("__piece")
        rows = docs.join(picked, key).where(F.col(lang).isNotNull()).select(F.col(key), piece, F.col(lang))
        sample = sorted(rows.collect(), key=lambda r: (r[0], r[2], r[1] or ""))
    return train([(r[1], r[2]) for r in sample])


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, accepted) of every row, from its whole text alone.

    A text that is null or has no letter gets ``und`` and the score 0, and so
    does every text if there is no model. Rows of one key are predicted each on
    its own; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("__key"), is_held_out(key).alias("__held"), F.col(text).alias("__text"))
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    return mapped(rows, partial(_predict, model=model), schema).withColumnRenamed("key", key)
