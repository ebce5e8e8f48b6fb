"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

The field is trained in numpy on a bounded sample of labelled documents. Tasks
find the best labels of each document's lines by the Viterbi algorithm; the
share of words in content lines decides whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import hashed_first, mapped, scope, settle
from locusforge.llm.words import Chunk, Words, chunks, line_limits, mix, sums, windows, word_hashes, word_limits

#: Labelled documents used for training, for each quality; the choice is by a hash of the key.
SAMPLE_PER_LABEL = 500
#: Characters of a text in the sample.
SAMPLE_CHARS = 50_000
LEAST_CONTENT = 0.5
EPOCHS = 8
RATE = 0.1
DECAY = 1e-4

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?:;\"')")] = True


class Field(NamedTuple):
    """Weights of line features for content, and of each pair of neighbouring labels (0 boilerplate, 1 content)."""

    weights: np.ndarray
    moves: np.ndarray


class Measures(NamedTuple):
    """Counts of each text, and its lines with a word: their features, word counts and limits."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    line_words: np.ndarray
    bounds: np.ndarray


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which equal an earlier one."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return counts[inverse] > 1, first[inverse] != np.arange(len(keys))


def measure(chunk: Chunk) -> Measures:
    data = chunk.data
    words, lines = word_limits(chunk), line_limits(chunk)
    hashes = word_hashes(data, words)
    n_words = np.diff(words.bounds)
    heads = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, words.starts, 1)
    np.add.at(in_word, words.ends, -1)
    chars = heads & (np.cumsum(in_word[:-1]) > 0)
    symbols = SYMBOLS[data]

    salt = mix(words.owner.astype(np.uint64) + np.uint64(1))
    runs, at = windows(hashes, words, 3)
    twice = np.zeros(len(hashes), bool)
    if len(at):
        again, _ = _repeated(mix(runs + salt[at]))
        for k in range(3):
            twice[at[again] + k] = True

    first = np.searchsorted(words.starts, lines.starts)
    last = np.searchsorted(words.starts, lines.ends)
    full = np.flatnonzero(last > first)
    owner = lines.owner[full]
    kept = Words(lines.starts[full], lines.ends[full], np.searchsorted(full, lines.bounds))
    line_hash = word_hashes(data, kept)
    _, later = _repeated(mix(line_hash + mix(owner.astype(np.uint64) + np.uint64(1)))) if len(full) else (None, np.zeros(0, bool))

    line_words = (last - first)[full]
    edges = np.stack([first[full], last[full]], axis=1).ravel()
    spans = np.stack([kept.starts, kept.ends], axis=1).ravel()

    def share(flags: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return sums(flags, ends)[::2] / np.maximum(whole, 1)

    line_chars = sums(chars, spans)[::2]
    letters = (data | 0x20 >= 97) & ((data | 0x20) <= 122)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    enders = STOPS[data[words.ends - 1]] if len(words.ends) else np.zeros(0, bool)
    closing = enders[last[full] - 1] if len(full) else np.zeros(0, bool)
    upper = share((data >= 65) & (data <= 90), spans, sums(letters, spans)[::2])
    features = np.stack(
        [
            np.ones(len(full)),
            share(symbols, spans, line_words) > 0.25,
            share(symbols, spans, line_words) > 0.75,
            upper > 0.5,
            share(same, edges, line_words) > 0.3,
            line_words < 3,
            line_words > 12,
            closing,
            share(enders, edges, line_words) > 0.6,
            share((data >= 48) & (data <= 57), spans, line_chars) > 0.2,
            line_chars / np.maximum(line_words, 1) > 9,
            share(data == ord("!"), spans, line_words) > 0.5,
        ],
        axis=1,
    ).astype(np.float64)
    return Measures(
        n_words,
        sums(chars, chunk.limits),
        sums(symbols, chunk.limits),
        sums(later, kept.bounds),
        sums(twice, words.bounds),
        features,
        line_words,
        kept.bounds,
    )


def train(texts: list[tuple[str, int]], seed: int = 5) -> Field:
    """Fit on (text, quality) rows by stochastic gradient on the conditional likelihood of line labels.

    Lines of good documents count as content, those of bad ones as boilerplate. Without rows of both kinds the field
    is neutral and labels every line content.
    """
    examples = []
    for chunk in chunks(pa.array([t for t, _ in texts], pa.string())) if texts else []:
        m = measure(chunk)
        for t in range(chunk.n):
            x = m.features[m.bounds[t] : m.bounds[t + 1]]
            if len(x):
                good = texts[chunk.first + t][1] == 1
                examples.append((x, np.full(len(x), int(good))))
    width = measure(next(chunks(pa.array(["a"])))).features.shape[1]
    if len({q for _, q in texts}) < 2 or not examples:
        return Field(np.eye(1, width)[0], np.zeros((2, 2)))
    weights, moves = np.zeros(width), np.zeros((2, 2))
    random = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(len(examples)):
            x, y = examples[i]
            score = np.stack([np.zeros(len(x)), x @ weights], axis=1)
            single, double = _expected(score, moves)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            weights += rate * ((y - single) @ x / len(x) - DECAY * weights)
            moves += rate * ((seen - double) / len(x) - DECAY * moves)
    return Field(weights, moves)


def _expected(score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of content of each line and expected pairs of labels, by forward and backward sums."""
    n = len(score)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = score[0]
    for i in range(1, n):
        ahead[i] = score[i] + np.logaddexp(ahead[i - 1, 0] + moves[0], ahead[i - 1, 1] + moves[1])
    for i in range(n - 2, -1, -1):
        nxt = score[i + 1] + back[i + 1]
        back[i] = np.logaddexp(moves[:, 0] + nxt[0], moves[:, 1] + nxt[1])
    total = np.logaddexp(*ahead[-1])
    single = np.exp(ahead[:, 1] + back[:, 1] - total)
    pairs = ahead[:-1, :, None] + moves[None] + (score[1:] + back[1:])[:, None, :] - total
    return single, np.exp(pairs).sum(axis=0)


def viterbi(content: list[float], moves: list[list[float]]) -> list[int]:
    """The best labels of a line sequence by its content scores; a tie is content."""
    (a, b), (c, d) = moves
    x, y = 0.0, content[0]
    steps = []
    for s in content[1:]:
        to_x = (x + a, 0) if x + a > y + c else (y + c, 1)
        to_y = (x + b, 0) if x + b > y + d else (y + d, 1)
        steps.append((to_x[1], to_y[1]))
        x, y = to_x[0], to_y[0] + s
    label = 0 if x > y else 1
    out = [label]
    for step in reversed(steps):
        label = step[label]
        out.append(label)
    return out[::-1]


def _judge(batches: Iterator[pa.RecordBatch], field: Field, least: float) -> Iterator[pa.RecordBatch]:
    moves = field.moves.tolist()
    for batch in batches:
        for chunk in chunks(batch.column("__text")):
            m = measure(chunk)
            scores = (m.features @ field.weights).tolist()
            content = np.zeros(len(scores), bool)
            for a, b in zip(m.bounds[:-1].tolist(), m.bounds[1:].tolist()):
                if b > a:
                    content[a:b] = viterbi(scores[a:b], moves)
            share = sums(np.where(content, m.line_words, 0), m.bounds) / np.maximum(m.n_words, 1)
            failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
            columns = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__key").slice(chunk.first, chunk.n),
                    *[pa.array(c.astype(np.int64)) for c in columns],
                    pa.array(failed),
                    pa.array(share),
                    pa.array(~failed & (share >= least)),
                ],
                names=["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    """A field of labelled documents: at most ``SAMPLE_PER_LABEL`` of each quality, the first by a hash of the key.

    Of each text the driver reads ``SAMPLE_CHARS`` characters.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull()).select(key, "quality").distinct()
    with scope():
        picked = settle(hashed_first(known, "quality", key, SAMPLE_PER_LABEL).select(key, "quality"), "line_sample")
        piece = F.substring(text, 1, SAMPLE_CHARS).alias("__piece")
        rows = docs.select(key, piece).join(picked, key).where(F.col("__piece").isNotNull()).select(key, "__piece", "quality").collect()
    return train([(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[2], r[1]))])


def judge(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", least: float = LEAST_CONTENT) -> DataFrame:
    """Counts, content share and verdict of every row, from its whole text.

    A null text and one without words have all counts 0, fail the base rules
    and go. Rows of one key are judged each on its own; other columns are not
    read.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = (
        f"key {dict(docs.dtypes)[key]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    )
    return mapped(rows, partial(_judge, field=field, least=least), schema).withColumnRenamed("key", key)
