"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Both tokenizations of a text are runs of token ends on the same bytes. An
interval of ends is split at the common end nearest to its middle, which is
looked for by bisection in the other run; both halves go on alike, and an
interval without a common end is a group. All intervals of a chunk of texts
advance together. Linked token pairs are counted over the corpus in Spark;
blocks of texts ask for the counts of their distinct pairs only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import mapped, scope, settle
from locusforge.llm.words import chunks
from locusforge.session import ship_package

TOKENIZERS = "/opt/tokenizers"
BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
#: Bytes of text aligned at a time, and asked for at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Parts of texts whose pieces a worker remembers, and the longest of them in characters.
REMEMBERED = 300_000
LONGEST = 64
#: Texts whose unknown parts are tokenized together, by the piece tokenizer.
GROUP = 64
#: A pair of ids is one integer; the second id takes so many bits.
ID_BITS = 24
SPACE_MARK = "▁"

# fixed value: how the byte-level tokenizer cuts texts before merging
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The piece tokenizer ends a piece before a single space between two characters that aren't white space, if no piece goes on over it.
BOUNDARY = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """The byte-level tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        special = {t["id"] for t in model["added_tokens"]}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if i not in special}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *special]))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        # merging by the smallest id is merging by the first rule only if ids follow the rules
        ordered = [vocabulary[a + b] for a, b in merges]
        cutter = model.get("pre_tokenizer") or {}
        plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.by_rank = bool(plain) and model.get("normalizer") is None and ordered == sorted(ordered)
        self.file = file
        if self.by_rank:
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocabulary.values()}
            self.engine = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    @lru_cache(1)  # noqa: B019  one per worker
    def plain(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.file)
        out.encode_special_tokens = True
        return out

    def ids(self, text: str) -> list[int]:
        if self.by_rank and len(text) <= 100_000:
            return self.engine.encode_ordinary(text)
        return self.plain.encode(text, add_special_tokens=False).ids


class Pieces:
    """The piece tokenizer, which puts a space before the text: ids of a text, and the bytes of each id."""

    def __init__(self, file: str):
        import sentencepiece

        self.engine = sentencepiece.SentencePieceProcessor(model_file=file)
        n = self.engine.get_piece_size()
        names = [self.engine.id_to_piece(i) for i in range(n)]
        self.bytes = [
            bytes([int(names[i][3:5], 16)]) if self.engine.is_byte(i) else names[i].replace(SPACE_MARK, " ").encode()
            for i in range(n)
        ]
        # no piece goes on over a boundary, and the text isn't changed before
        self.apart = all(SPACE_MARK not in x.lstrip(SPACE_MARK) for x in names)
        probe = "a  b ﬁ Ａ é  x\t\n y "
        self.apart &= b"".join(self.bytes[i] for i in self.ids(probe)) == b" " + probe.encode()

    def ids(self, text: str) -> list[int]:
        return self.engine.encode(text, num_threads=1)

    def each(self, texts: list[str]) -> list[list[int]]:
        return self.engine.encode(texts, num_threads=1) if texts else []


class Tokenizers:
    """Both tokenizers of one worker, with the pieces of short parts of texts."""

    def __init__(self, folder: str):
        self.a, self.b = ByteLevel(f"{folder}/{BYTE_FILE}"), Pieces(f"{folder}/{PIECE_FILE}")
        self.known: dict[str, list[int]] = {}

    def _learn(self, parts: set[str]) -> None:
        """Pieces of those parts that start with a space and aren't long."""
        new = [p for p in parts.difference(self.known) if p[0] == " " and len(p) <= LONGEST]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = [p for p in parts if p[0] == " " and len(p) <= LONGEST]
        self.known.update(zip(new, self.b.each([p[1:] for p in new])))

    def _checked(self, text: str, b: list[int]) -> tuple[list[int], list[int]]:
        """Ids by both, of a text that starts with a space; none if the bytes of either differ from its own."""
        a, raw = self.a.ids(text), text.encode()
        same = b"".join(map(self.b.bytes.__getitem__, b)) == raw and b"".join(map(self.a.bytes.__getitem__, a)) == raw
        return (a, b) if same else ([], [])

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by both; none for a null or empty one and where bytes differ."""
        if not self.b.apart:
            return [self._checked(" " + t, self.b.ids(t)) if t else ([], []) for t in texts]
        out = []
        for first in range(0, len(texts), GROUP):
            cut = [BOUNDARY.split(" " + t) if t else [] for t in texts[first : first + GROUP]]
            self._learn(set(chain.from_iterable(cut)))
            for parts, text in zip(cut, texts[first : first + GROUP]):
                try:
                    b = list(chain.from_iterable(map(self.known.__getitem__, parts)))
                except KeyError:  # it has a long part
                    b = self.b.ids(text)
                out.append(self._checked(" " + text, b) if text else ([], []))
        return out


@lru_cache(2)
def tokenizers_of(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def shared_ends(a: np.ndarray, b: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Which ends of ``a`` are ends of ``b``, for runs that meet at the last end of each interval of ``limits``.

    An interval looks for a common end in a window around its middle, which
    widens until it holds one or all. What lies nearer to the middle than the
    found one is known to be no cut and isn't looked at again.
    """
    out = np.zeros(len(a), bool)
    full = np.diff(limits) > 0
    out[limits[1:][full] - 1] = True
    low, high = limits[:-1][full], limits[1:][full] - 1
    width = np.zeros(len(low), np.int64)
    while True:
        open_ = low < high
        low, high, width = low[open_], high[open_], width[open_]
        if not len(low):
            return out
        middle = (low + high) // 2
        first, last = np.maximum(low, middle - width), np.minimum(high, middle + width + 1)
        sizes = last - first
        heads = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(heads - first, sizes)
        place = np.searchsorted(b, a[at])
        common = b[np.minimum(place, len(b) - 1)] == a[at]
        away = np.abs(at - np.repeat(middle, sizes)) * 2 + (at > np.repeat(middle, sizes))
        nearest = np.minimum.reduceat(np.where(common, away, np.iinfo(np.int64).max), heads)
        found = nearest < np.iinfo(np.int64).max
        d, later = nearest[found] // 2, nearest[found] % 2
        mid = middle[found]
        out[np.where(later, mid + d, mid - d)] = True
        # the end as far behind the middle as the found one lies before it wasn't held against anything nearer
        right = mid + d + np.where((later == 0) & (d > 0), 0, 1)
        wider = ~found & (sizes < high - low)
        low, high, width = (
            np.concatenate([low[found], right, low[wider]]),
            np.concatenate([mid - d, high[found], high[wider]]),
            np.concatenate([np.zeros(2 * len(mid), np.int64), width[wider] * 4 + 1]),
        )
        # in order of place, neighbouring bisections touch the same memory
        order = np.argsort(low, kind="stable")
        low, high, width = low[order], high[order], width[order]


class Aligned(NamedTuple):
    """Of texts end to end: tokens and groups per text, the linked pair and the text of each link, and the groups' digests."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    pairs: np.ndarray
    owner: np.ndarray
    digests: list[str]


@lru_cache(4)
def _decimals(n: int) -> np.ndarray:
    """Decimal numbers with what may follow: a comma, a bar, a semicolon."""
    return np.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], object)


def _ordinal(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place."""
    return np.cumsum(flags) - flags


def align(tokens: list[tuple[list[int], list[int]]], bytes_a: list[bytes], bytes_b: list[bytes]) -> Aligned:
    """Align the two tokenizations of each text."""
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.array(list(chain.from_iterable(t[k] for t in tokens)), np.int64) for k in (0, 1))
    limits_a, limits_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    if not len(a):
        none = np.zeros(0, np.int64)
        return Aligned(n_a, n_b, np.zeros(len(tokens), np.int64), none, none, [""] * len(tokens))
    end_a, end_b = np.cumsum(_lengths(tuple(bytes_a))[a]), np.cumsum(_lengths(tuple(bytes_b))[b])
    cut_a = shared_ends(end_a, end_b, limits_a)
    cut_b = np.zeros(len(b), bool)
    cut_b[np.searchsorted(end_b, end_a[cut_a])] = True
    n_groups = np.add.reduceat(np.append(cut_a, False).astype(np.int64), limits_a[:-1]) * (n_a > 0)
    # every stretch between two neighbouring ends of either run is where one pair of tokens overlaps
    ends = np.sort(np.concatenate([end_a, end_b[~cut_b]]), kind="stable")
    in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    owner = np.searchsorted(limits_a, in_a, "right") - 1
    # groups in order, the tokens of the first run before those of the second
    group_a, group_b = _ordinal(cut_a), _ordinal(cut_b)
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
    text = np.empty(len(a) + len(b), object)
    n = len(bytes_a)
    text[place_a] = _decimals(n)[a + n * cut_a]
    n = len(bytes_b)
    text[place_b] = _decimals(n)[b + 2 * n * cut_b]
    digests = []
    for first, last in zip((limits_a[:-1] + limits_b[:-1]).tolist(), (limits_a[1:] + limits_b[1:]).tolist()):
        whole = "".join(text[first:last].tolist())
        digests.append(hashlib.sha256(whole[:-1].encode()).hexdigest() if whole else "")
    return Aligned(n_a, n_b, n_groups, (a[in_a] << ID_BITS) | b[in_b], owner, digests)


@lru_cache(4)
def _lengths(tokens: tuple[bytes, ...]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


def _aligned(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A row per block of texts: their figures, their distinct pairs, and how often each text has which of them."""
    both = tokenizers_of(folder)
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for chunk in chunks(batch.column("text"), BLOCK_BYTES):
            texts = batch.column("text").slice(chunk.first, chunk.n).to_pylist()
            got = align(both.encode(texts), both.a.bytes, both.b.bytes)
            pairs, which = np.unique(got.pairs, return_inverse=True)
            width = max(len(pairs), 1)
            held, times = np.unique(got.owner * width + which, return_counts=True)
            at = held % width
            starts = np.searchsorted(held // width, np.arange(chunk.n + 1))
            columns = {
                "block": pa.array([block]),
                "ids": _one(batch.column("key").slice(chunk.first, chunk.n)),
                "n_a": _one(got.n_a),
                "n_b": _one(got.n_b),
                "n_groups": _one(got.n_groups),
                "digests": _one(pa.array(got.digests, pa.string())),
                "starts": _one(starts.astype(np.int32)),
                "at": _one(at.astype(np.int32)),
                "times": _one(times.astype(np.int32)),
                "pairs": _one(pairs),
                "held": _one(np.bincount(at, minlength=len(pairs)).astype(np.int64)),
            }
            yield pa.RecordBatch.from_pydict(columns)
            block += 1


ALIGNED = (
    "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
    "starts array<int>, at array<int>, times array<int>, pairs array<long>, held array<long>"
)


def _one(values) -> pa.ListArray:
    """A column of one row that is a list."""
    values = pa.array(values) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _answered(texts: pa.Table, answers: pa.Table, kind: str) -> pa.Table:
    """Figures of the texts of a block, with the counts of their links."""
    flat = {c: texts.column(c).combine_chunks().flatten() for c in texts.column_names if c != "block"}
    starts, at, times = (flat[c].to_numpy().astype(np.int64) for c in ("starts", "at", "times"))
    n = answers.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = answers.column("place").to_numpy()
    count[place] = answers.column("n").to_numpy()
    best[place] = answers.column("best").to_numpy()
    if len(at) and (not n or at.max() >= n):
        raise RuntimeError("a block has pairs without a count")

    def per_text(values: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(values)])
        return pa.array(np.diff(total[starts]))

    return pa.table(
        {
            "key": flat["ids"], "n_a": flat["n_a"], "n_b": flat["n_b"], "n_groups": flat["n_groups"],
            "n_links": per_text(times), "n_best": per_text(times * best[at]), "count_sum": per_text(times * count[at]),
            "groups_sha256": flat["digests"],
        }
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over all blocks: documents that hold the pair linked, and 1 if no pair of its first id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    counts = settle(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n")), "pair_counts")
    first = F.shiftright("pair", ID_BITS).alias("first")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    # an id has at most as many pairs as the other tokenizer has ids
    return counts.withColumn("first", first).join(most, "first").select(
        "pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")
    )


def alignments(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A text is aligned whole. Null and empty texts and those that one of the
    tokenizers doesn't give back byte by byte have zeros and the digest ''. Rows
    of one key are documents of their own and all count; other columns are not
    read. A single text has to fit into a task.
    """
    with scope():
        ship_package(docs.sparkSession)
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        table = settle(mapped(rows, partial(_aligned, folder=folder), ALIGNED), "aligned")
        counts = settle(pair_counts(table), "best_pairs")
        asked = table.select(F.col("block").alias("asking"), F.posexplode("pairs").alias("place", "pair"))
        answers = asked.join(counts, "pair").select("asking", "place", "n", "best")
        texts = table.drop("pairs", "held")
        shape = "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

        def answered(left: pa.Table, right: pa.Table) -> pa.Table:
            return _answered(left, right, shape)

        found = texts.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(answered, shape)
        return settle(found, "alignments", outer=True).withColumnRenamed("key", key)
