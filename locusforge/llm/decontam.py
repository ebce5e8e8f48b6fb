"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question with
other numbers or names has the same template. Windows of template words are
joined by hash; the values that stand in the places of one benchmark value
have to agree, or the match is one of form only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusforge.llm.bits import bit_filter, may_hold
from locusforge.llm.frames import mapped, scope, settle
from locusforge.llm.words import LOWER, Chunk, Words, chunks, mix, sums, word_hashes, word_limits

WINDOW = 8
#: A shorter benchmark text is one window of its own length, down to this.
SHORTEST = 3
#: Part of the benchmark text's windows that a document has to hold in one place.
LEAST_SHARE = 0.5
#: Words in a row that are held whatever their part of the benchmark text.
RUN_WORDS = 13
#: Words put in or left out between two parts of one copy.
DRIFT = 8

UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes oz lb lbs pound pounds ml l "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees celsius "
    "fahrenheit kelvin w kw mw watt watts v volt volts j kj joule joules n newton newtons hz khz mhz ghz kb mb gb tb"
).split()

_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_ALNUM[128:] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:")] = True
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)


def _unit_hashes() -> np.ndarray:
    chunk = next(chunks(pa.array([" ".join(UNITS)])))
    return np.sort(word_hashes(chunk.data, word_limits(chunk)))


UNIT_HASHES = _unit_hashes()


class Reading(NamedTuple):
    """One way to read texts: template words, their values (0 for plain words), their places among all words, text limits."""

    token: np.ndarray
    value: np.ndarray
    word: np.ndarray
    bounds: np.ndarray


#: Names one by one; runs of names as one; and runs with the capitalised words that open sentences; words as they are.
SINGLE, RUNS, OPENED, EXACT = READINGS = range(4)


def _split_units(chunk: Chunk, words: Words) -> Words:
    """``words`` with a listed unit that is glued to its number as a word of its own."""
    data = chunk.data
    if len(data) < 2 or not len(words.starts):
        return words
    digit = (data >= 48) & (data <= 57)
    letter = _ALNUM[data] & ~digit
    cut = np.flatnonzero(digit[:-1] & letter[1:]) + 1
    if not len(cut):
        return words
    at = np.searchsorted(words.starts, cut, "right") - 1
    left = np.stack([words.starts[at], cut], axis=1).ravel()
    right = Words(cut, words.ends[at], np.array([0, len(cut)]))
    value = word_hashes(LOWER[data], right, _ALNUM[data])
    place = np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)
    glued = (UNIT_HASHES[place] == value) & (cut > words.starts[at]) & (sums(letter, left)[::2] == 0)
    cut, at = cut[glued], at[glued]
    ends = words.ends.copy()
    ends[at] = cut
    starts = np.insert(words.starts, at + 1, cut)
    return Words(starts, np.insert(ends, at + 1, words.ends[at]), np.searchsorted(starts, chunk.limits))


def readings(chunk: Chunk) -> list[Reading]:
    """A chunk's words by each of ``READINGS``.

    A word is its letters and digits, lowered; one without any is left out. A
    number has only digits; a name starts with a capital, isn't all capitals and
    doesn't follow the end of a sentence (if ``OPENED`` it may); a unit is a
    listed word after a number or glued to it. The value is the hash of the
    word, or of the run of names, 0 unless it is a placeholder.
    """
    words = _split_units(chunk, word_limits(chunk))
    data = chunk.data
    low = LOWER[data]
    kept = _ALNUM[data]
    spans = np.stack([words.starts, words.ends], axis=1).ravel()
    n_kept = sums(kept, spans)[::2] if len(words.starts) else np.zeros(0, np.int64)
    full = np.flatnonzero(n_kept)
    bounds = np.searchsorted(full, words.bounds)
    if not len(full):
        return [Reading(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds)] * len(READINGS)
    own = Words(words.starts[full], words.ends[full], bounds)
    value = word_hashes(low, own, kept)
    spans = np.stack([own.starts, own.ends], axis=1).ravel()
    digits = sums((data >= 48) & (data <= 57), spans)[::2]
    capitals = sums((data >= 65) & (data <= 90), spans)[::2]
    number = digits == n_kept[full]
    # the first letter or digit of the word
    place = np.cumsum(kept)
    first = np.searchsorted(place, place[own.starts] - kept[own.starts] + 1)
    start = np.ones(len(full), bool)
    start[1:] = _ENDS[data[own.ends[:-1] - 1]]
    opening = bounds[:-1][bounds[:-1] < len(full)]
    start[opening] = True
    head = data[first]
    upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (data[np.minimum(first + 1, len(data) - 1)] < 0x9F))
    opened = upper & ~number & (capitals * 2 < np.maximum(n_kept[full], 2))
    name = opened & ~start
    unit = np.zeros(len(full), bool)
    at = np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)
    unit[1:] = (UNIT_HASHES[at] == value)[1:] & number[:-1]
    unit[opening] = False
    place = np.arange(len(full)) - np.repeat(bounds[:-1], np.diff(bounds))

    def read(names: np.ndarray) -> Reading:
        names = names & ~unit
        token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(names, NAME, value)))
        return Reading(token, np.where(number | names | unit, value, np.uint64(0)), place, bounds)

    # a sentence's end parts names where the next word may be one of its own
    whole = Reading(value, np.zeros(len(full), np.uint64), place, bounds)
    return [read(name), _joined(read(name), start), _joined(read(opened), start), whole]


def _joined(given: Reading, start: np.ndarray) -> Reading:
    """``given`` with each run of names inside a sentence as one."""
    name = given.token == NAME
    more = np.zeros(len(name), bool)
    more[1:] = name[1:] & name[:-1] & ~start[1:]
    heads = np.flatnonzero(~more)
    n = np.diff(np.append(heads, len(name)))
    turn = np.arange(len(name)) - np.repeat(heads, n)
    value = np.add.reduceat(np.where(turn > 0, mix(given.value + turn.astype(np.uint64)), given.value), heads)
    return Reading(given.token[heads], value, given.word[heads], np.searchsorted(heads, given.bounds))


def template_windows(token: np.ndarray, value: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words inside one text with at least half of them plain words, and its first word."""
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + token[k : k + n]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    plain = np.concatenate([[0], np.cumsum(value == 0)])
    at = np.flatnonzero((owner[:n] == owner[size - 1 :]) & (2 * (plain[size:] - plain[:n]) >= size))
    return mix(total[at]), at


def _rows(keys: pa.Array, owner: np.ndarray, reading: int, given: Reading, size: int, hashes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    slots = [given.value[i : i + size] for i in at.tolist()]
    slots = [s[s != 0].view(np.int64).tolist() for s in slots]
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(owner)),
            pa.array((at - given.bounds[owner]).astype(np.int64)),
            pa.array(given.word[at].astype(np.int64)),
            pa.array(np.full(len(at), reading, np.int64)),
            pa.array(np.full(len(at), size, np.int64)),
            pa.array(hashes.view(np.int64)),
            pa.array(slots, pa.list_(pa.int64())),
        ],
        names=["key", "place", "word", "reading", "size", "hash", "slots"],
    )


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            keys = batch.column("key").slice(chunk.first, chunk.n)
            for reading, given in enumerate(readings(chunk)):
                lengths = np.diff(given.bounds)
                least = 1 if reading == EXACT else SHORTEST
                for size in sorted({min(window, int(x)) for x in lengths if x >= least}):
                    hashes, at = template_windows(given.token, given.value, given.bounds, size)
                    owner = np.searchsorted(given.bounds, at, "right") - 1
                    fits = (lengths[owner] >= window) if size == window else (lengths[owner] == size)
                    hashes, at, owner = hashes[fits], at[fits], owner[fits]
                    yield _rows(keys, owner, reading, given, size, hashes, at)


def _text_windows(batches: Iterator[pa.RecordBatch], sizes: list[tuple[int, int]], held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of documents that the filter says may be in the benchmark."""
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            read = readings(chunk)
            keys = batch.column("key").slice(chunk.first, chunk.n)
            for reading, size in sizes:
                given = read[reading]
                hashes, at = template_windows(given.token, given.value, given.bounds, size)
                owner = np.searchsorted(given.bounds, at, "right") - 1
                again = np.zeros(len(at), bool)
                again[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1] + 1) & (owner[1:] == owner[:-1])
                hit = may_hold(held, hashes)
                hashes, at, owner, again = hashes[hit], at[hit], owner[hit], again[hit]
                if size < SHORTEST:
                    alone = np.diff(given.bounds)[owner] == size
                    hashes, at, owner, again = hashes[alone], at[alone], owner[alone], again[alone]
                yield _rows(keys, owner, reading, given, size, hashes, at).append_column("again", pa.array(again))


WINDOW_SCHEMA = "key long, place long, word long, reading long, size long, hash long, slots array<long>"


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, least_share: float = LEAST_SHARE) -> DataFrame:
    """(key, item, place, n_windows, share, kind) of every benchmark text that a document holds.

    A document holds a text if, by one of ``READINGS``, it has at least
    ``least_share`` of the text's template windows at one place or at places
    that ``DRIFT`` or fewer words part from the next, or ``RUN_WORDS`` words in
    a row whatever their share; and each value of the text always has the same
    value in its stead there. Kind is ``copy`` if no value differs, else
    ``reworded``. The best place is returned, counted in words: the one of most
    windows, then the first.

    A null or empty text holds and is nothing. A benchmark text of fewer than
    ``SHORTEST`` words is held only by a document that is nothing else. Rows of
    one key are one document whose places are compared by number. Repeated
    benchmark texts are items of their own; an item without a key is looked for
    under the null key. Null document keys are left out, for the result would
    name none. Other columns are not read.
    """
    items = benchmark.select(F.col(item).cast("long").alias("key"), F.col(text).alias("text"))
    wanted = mapped(items, partial(_item_windows, window=window), WINDOW_SCHEMA)
    wanted = settle(wanted.distinct(), "item_windows")
    # at most as many as READINGS times WINDOW
    sizes = sorted((r[0], r[1]) for r in wanted.select("reading", "size").distinct().collect())
    held = bit_filter(wanted, "hash")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = mapped(rows, partial(_text_windows, sizes=sizes, held=held), WINDOW_SCHEMA + ", again boolean")
    found = settle(found, "text_windows")
    theirs = wanted.select(
        F.col("key").alias("item"), F.col("place").alias("item_place"), F.col("word").alias("item_word"),
        "reading", "size", "hash", F.col("slots").alias("item_slots"),
    )
    met = _met(found, theirs)
    # runs and neighbouring places are found inside the matches of one document with one item
    one = Window.partitionBy("key", "item", "reading")
    row = one.orderBy("at", "item_place")
    far = F.coalesce(F.col("at") - F.lag("at").over(row) > DRIFT, F.lit(True)).cast("long")
    run = F.col("item_place") - F.dense_rank().over(Window.partitionBy("key", "item", "reading", "at").orderBy("item_place"))
    met = met.withColumn("run", run).withColumn("far", far)
    near = F.sum("far").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = settle(met.withColumn("near", near).drop("far"), "matches")
    none = F.lit(0).cast("long")
    ways = [("place", F.col("at"), none), ("near", F.col("near"), none), ("run", F.col("at"), F.col("run"))]
    ways = F.array(*[F.struct(F.lit(w).alias("way"), a.alias("a"), b.cast("long").alias("b")) for w, a, b in ways])
    met = met.withColumn("g", F.explode(ways)).select("*", "g.way", "g.a", "g.b")
    group = ["key", "item", "reading", "way", "a", "b"]
    counts = met.groupBy(*group).agg(
        F.count_distinct("item_place").alias("n_windows"), F.min(F.struct("item_place", "at", "word")).alias("first")
    )
    pairs = met.where(F.size("slots") > 0).select(*group, F.explode(F.arrays_zip("item_slots", "slots")).alias("p"))
    pairs = pairs.select(*group, "p.item_slots", "p.slots").distinct()
    values = pairs.groupBy(*group, "item_slots").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("slots") != F.col("item_slots")).cast("int")).alias("other")
    )
    slots = values.groupBy(*group).agg(F.max("n").alias("most"), F.max("other").alias("other"))
    both = counts.unionByName(slots, allowMissingColumns=True).groupBy(*group)
    judged = both.agg(*[F.max(c).alias(c) for c in ("n_windows", "first", "most", "other")])
    whole = wanted.groupBy(F.col("key").alias("whole_item"), F.col("reading").alias("whole_reading"))
    whole = whole.agg(F.count_distinct("place").alias("all"))
    same = F.col("item").eqNullSafe(F.col("whole_item")) & (F.col("reading") == F.col("whole_reading"))
    judged = judged.join(whole, same).withColumn("share", F.col("n_windows") / F.col("all"))
    long_run = (F.col("way") == "run") & (F.col("n_windows") >= max(RUN_WORDS - window + 1, 1))
    sound = judged.where(((F.col("share") >= least_share) | long_run) & (F.coalesce("most", F.lit(1)) == 1))
    best = F.max(F.struct("n_windows", (-F.col("first.word")).alias("back"), "share", "other")).alias("b")
    return sound.groupBy("key", "item").agg(best).select(
        F.col("key").alias(key),
        F.col("item").alias(item),
        (-F.col("b.back")).alias("place"),
        "b.n_windows",
        "b.share",
        F.when(F.col("b.other") == 1, "reworded").otherwise("copy").alias("kind"),
    )


def _met(found: DataFrame, theirs: DataFrame) -> DataFrame:
    """Windows that a text and an item have in common, with their alignment ``at``.

    A window that an item has once meets every place of a text. One that it has
    several times would meet each place once per repeat; such windows are held
    only against the places where the item would have to stand by its single
    windows, or, of an item without any, by the first place of each, taken where
    a run of equal windows begins.
    """
    item = ["item", "reading", "size"]
    own = Window.partitionBy(*item, "hash")
    marked = theirs.withColumn("times", F.count(F.lit(1)).over(own)).withColumn("head", F.min("item_place").over(own) == F.col("item_place"))
    single = F.max((F.col("times") == 1).cast("int")).over(Window.partitionBy(*item)) == 1
    marked = settle(marked.withColumn("anchored", single), "marked_windows")
    shape = ("key", "item", "reading", "size", "at", "off", "item_place", "slots", "item_slots")

    def aligned(windows: DataFrame, places: DataFrame) -> DataFrame:
        return places.join(windows, ["reading", "size", "hash"]).select(
            *shape[:4], (F.col("place") - F.col("item_place")).alias("at"), (F.col("word") - F.col("item_word")).alias("off"), *shape[6:]
        )

    once = aligned(marked.where("times = 1"), found)
    repeated = marked.where("times > 1")
    if repeated.isEmpty():
        return once.withColumnRenamed("off", "word").drop("size")
    # windows of a text that overlap in a run of equal ones begin but one alignment
    first = aligned(repeated.where("head and not anchored"), found.where("not again"))
    tied = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in item]
    ways = once.unionByName(first).select("key", *[F.col(c).alias(f"__{c}") for c in item], "at").distinct()
    ways = ways.join(repeated.select(*item).distinct().select(*[F.col(c).alias(f"___{c}") for c in item]),
                     [F.col(f"__{c}").eqNullSafe(F.col(f"___{c}")) for c in item], "left_semi")
    spread = repeated.join(ways, tied).withColumn("place", F.col("at") + F.col("item_place"))
    more = spread.join(found.select("key", "reading", "size", "hash", "place", "word", "slots"), ["key", "reading", "size", "hash", "place"])
    more = more.select(*shape[:5], (F.col("word") - F.col("item_word")).alias("off"), *shape[6:])
    return once.unionByName(more).withColumnRenamed("off", "word").drop("size")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, with all their columns; null keys stay."""
    with scope():
        found = settle(leaks(docs, benchmark, key, text, **settings).select(key).distinct(), "leaks", outer=True)
    return docs.join(found, key, "left_anti")
