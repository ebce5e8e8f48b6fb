"""Ranked lexical search by pipelined term partitioning.

Terms are owned by stages, rare terms by early ones. Documents lie in blocks,
items in bundles. A bundle carries the sparse scores of a block's documents
from stage to stage, where a cogroup adds the integer contributions of the
terms that the stage owns. What can't reach the best ``k`` of its block any
more, even if it had all terms of the later stages, is left behind; the result
is exact. The last stage selects the best of each block, and of those the best
are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.bits import bit_filter, may_hold
from locusforge.llm.frames import fresh, mapped, scope, settle
from locusforge.llm.words import LOWER, chunks, word_hashes, word_limits
from locusforge.operators import scale
from locusforge.session import ship_package

BEST = 10
#: Items of a bundle.
BUNDLE = 256
#: A block of documents ends at so many bytes or rows; a longer text is a block of its own.
BLOCK_BYTES = 1 << 22
BLOCK_ROWS = 1 << 12
#: A term in at most one of so many documents belongs to the first, second or third stage, any other one to the last.
OWNERS = (1000, 100, 10)
#: A term's saturated contribution stays below this many times its weight.
SATURATED = 1_000_000
# the fixed values of the score: scale, damping, and share of the length in percent
SCALE, TF_SCALE, DAMPING, LENGTH_PERCENT = 1_000_000_000, 1000, 8, 90

#: Bytes that part terms: ASCII other than letters and digits.
APART = np.zeros(256, bool)
APART[:128] = [not chr(c).isalnum() for c in range(128)]


def _term_rows(chunk, held: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Terms of a chunk as (text, place of its documents, occurrences), and the number of terms of each text.

    With a filter, only terms that it may hold.
    """
    lowered = chunk._replace(data=LOWER[chunk.data])
    words = word_limits(lowered, APART)
    hashes = word_hashes(lowered.data, words)
    owner = words.owner
    kept = np.arange(len(hashes)) if held is None else np.flatnonzero(may_hold(held, hashes))
    kept = kept[np.lexsort((owner[kept], hashes[kept]))]
    h, at = hashes[kept], owner[kept]
    new_term = np.ones(len(kept), bool)
    new_term[1:] = h[1:] != h[:-1]
    new_row = new_term.copy()
    new_row[1:] |= at[1:] != at[:-1]
    rows = np.flatnonzero(new_row)
    firsts = kept[new_term]
    texts = [lowered.data[a:b].tobytes().decode() for a, b in zip(words.starts[firsts].tolist(), words.ends[firsts].tolist())]
    cuts = np.append(np.searchsorted(rows, np.flatnonzero(new_term)), len(rows))
    return texts, hashes[firsts], cuts, at[rows], np.diff(np.append(rows, len(kept))), np.diff(words.bounds)


def _postings(batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each block one row per term, and one without a term that has the keys and lengths of its texts."""
    block = TaskContext.get().partitionId() << 32
    for whole in batches:
        for first in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(first, BLOCK_ROWS)
            for chunk in chunks(batch.column("text"), BLOCK_BYTES):
                texts, _, cuts, at, tf, sizes = _term_rows(chunk, held)
                n = len(texts)
                ends = pa.array(np.append(cuts, cuts[-1]).astype(np.int32))
                alone = pa.array(np.append(np.zeros(n + 1, np.int32), np.int32(chunk.n)))
                keys = batch.column("key").slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, block)),
                        pa.array([*texts, None], pa.string()),
                        pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64))),
                        pa.ListArray.from_arrays(alone, keys),
                        pa.ListArray.from_arrays(alone, pa.array(sizes.astype(np.int64))),
                    ],
                    names=["block", "term", "at", "tf", "ids", "sizes"],
                )
                block += 1


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            texts, hashes, cuts, at, _, _ = _term_rows(chunk, None)
            n = np.diff(cuts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item").take(pa.array(chunk.first + at)),
                    pa.array(np.repeat(np.array(texts, object), n), pa.string()),
                    pa.array(np.repeat(hashes, n).view(np.int64)),
                ],
                names=["item", "term", "hash"],
            )


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the limits of its rows."""
    lists = column.combine_chunks()
    limits = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), limits - limits[0]


def _add(scores: np.ndarray, postings: pa.Table, length: np.ndarray) -> None:
    """Contributions of a stage's terms to the (slot, document) scores of a block."""
    at, limits = _flat(postings.column("at"))
    tf, _ = _flat(postings.column("tf"))
    slots, slot_limits = _flat(postings.column("slots"))
    weight = postings.column("weight").to_numpy()
    gain = np.repeat(weight, np.diff(limits)) * (SCALE * tf // (TF_SCALE * tf + DAMPING * length[at]))
    for i in range(len(weight)):
        a, b = limits[i], limits[i + 1]
        scores[slots[slot_limits[i] : slot_limits[i + 1], None], at[a:b]] += gain[a:b]


def _stage(carried: pa.Table, postings: pa.Table, stage: int, n_docs: int, n_terms: int, best: int) -> pa.Table:
    """A bundle's scores of one block after a stage; after the last, its best documents per item."""
    last = stage == len(OWNERS)
    sizes, _ = _flat(carried.column("sizes"))
    length = 100 - LENGTH_PERCENT + LENGTH_PERCENT * sizes.astype(np.int64) * n_docs // n_terms
    scores = np.zeros((BUNDLE, len(length)), np.int64)
    at, slot, held = (_flat(carried.column(c))[0] for c in ("at", "slot", "score"))
    scores[slot, at] = held
    if postings.num_rows:
        _add(scores, postings, length)
    rest = np.zeros(BUNDLE, np.int64)
    for r in carried.column("rest")[0].as_py():
        if r["stage"] > stage:
            rest[r["slot"]] += SATURATED * r["weight"]
    least = np.zeros(BUNDLE, np.int64)
    if len(length) >= best:
        least = np.partition(scores, len(length) - best, axis=1)[:, len(length) - best]
    slot, at = np.nonzero((scores > 0) & (scores + rest[:, None] >= least[:, None]))
    held = scores[slot, at]
    block = carried.column("block")[0].as_py()
    bundle = carried.column("bundle")[0].as_py()
    if not last:
        one = pa.array([0, len(slot)], pa.int32())
        lists = [pa.ListArray.from_arrays(one, pa.array(x)) for x in (at.astype(np.int32), slot.astype(np.int32), held)]
        kept = carried.select(["bundle", "block", "ids", "sizes", "rest"])
        for name, values in zip(("at", "slot", "score"), lists):
            kept = kept.append_column(name, pa.chunked_array([values]))
        return kept
    ids = carried.column("ids").combine_chunks().flatten()
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((number[at], missing[at], -held, slot))
    slot, at, held = slot[order], at[order], held[order]
    rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
    kept = rank < best
    return pa.table(
        {
            "bundle": pa.array(np.full(int(kept.sum()), bundle, np.int64)),
            "slot": pa.array(slot[kept].astype(np.int32)),
            "id": ids.take(pa.array(at[kept])),
            "score": pa.array(held[kept]),
        }
    )


def _step(stage: int, n_docs: int, n_terms: int, best: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def step(carried: pa.Table, postings: pa.Table) -> pa.Table:
        return _stage(carried, postings, stage, n_docs, n_terms, best)

    return step


CARRIED = (
    "bundle long, block long, ids array<long>, sizes array<long>, rest array<struct<slot:int,stage:int,weight:long>>, "
    "at array<int>, slot array<int>, score array<long>"
)


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", best: int = BEST,
) -> DataFrame:
    """(item, rank, key, score) of the ``best`` documents with a score above 0 of each item.

    A term is a maximal run of letters and digits of ASCII and of all other
    characters, A to Z lowered. Equal scores go by the key, null last. Null and
    empty texts have no terms; a document without terms counts for nothing, an
    item without terms or without a document that holds one has no rows. Rows of
    one item are one item, null too; rows of one key are documents of their own.
    Other columns are not read.
    """
    with scope():
        found = _ranked(docs, items, key, text, item, item_text, best)
        return settle(found, "ranked", outer=True)


def _ranked(
    docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, best: int
) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    kind = dict(items.dtypes)[item]
    asked = items.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    wanted = mapped(asked, _item_terms, f"item {kind}, term string, hash long")
    wanted = settle(wanted.distinct(), "item_terms")
    held = bit_filter(wanted, "hash")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    shape = "block long, term string, at array<int>, tf array<long>, ids array<long>, sizes array<long>"
    table = settle(mapped(rows, partial(_postings, held=held), shape), "postings")
    blocks = table.where("term is null").select("block", "ids", "sizes")
    postings = table.where("term is not null").select("block", "term", "at", "tf")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    counted = blocks.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))).alias("n"), F.sum(total).alias("l")).first()
    n_docs, n_terms = counted["n"] or 0, counted["l"] or 0

    places = scale.row_numbers(wanted.select("item").distinct(), [], [F.col("item").asc_nulls_first()], "place")
    places = settle(
        places.select(
            "item",
            ((F.col("place") - 1) / BUNDLE).cast("long").alias("bundle"),
            F.pmod(F.col("place") - 1, F.lit(BUNDLE)).cast("int").alias("slot"),
        ),
        "bundles",
    )
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    stage = F.lit(len(OWNERS))
    for k, share in reversed(list(enumerate(OWNERS))):
        stage = F.when(F.col("df") * share <= n_docs, k).otherwise(stage)
    owned = postings.groupBy("term").agg(F.sum(F.size("at")).alias("df")).select("term", weight.alias("weight"), stage.cast("int").alias("stage"))
    terms = scale.null_safe_join(wanted.select("item", "term"), places, ["item"]).join(owned, "term").where("weight > 0")
    terms = settle(terms.select("bundle", "slot", "term", "weight", "stage"), "owned_terms")
    by_term = terms.groupBy("bundle", "term", "weight", "stage").agg(F.collect_list("slot").alias("slots"))
    # each stage's own postings lie in a folder of their own
    staged = settle(by_term.join(postings, "term").drop("term"), "owned", by="stage")
    later = terms.groupBy("bundle", "slot", "stage").agg(F.sum("weight").alias("weight"))
    rest = later.groupBy("bundle").agg(F.collect_list(F.struct("slot", "stage", "weight")).alias("rest"))
    none = [F.array().cast(t).alias(c) for c, t in (("at", "array<int>"), ("slot", "array<int>"), ("score", "array<long>"))]
    carried = staged.select("bundle", "block").distinct().join(blocks, "block").join(rest, "bundle")
    carried = settle(carried.select("bundle", "block", "ids", "sizes", "rest", *none), "carried")
    for k in range(len(OWNERS) + 1):
        shape = CARRIED if k < len(OWNERS) else "bundle long, slot int, id long, score long"
        mine = staged.where(F.col("stage") == k).select(
            F.col("bundle").alias("own_bundle"), F.col("block").alias("own_block"), "weight", "slots", "at", "tf"
        )
        carried = carried.groupBy("bundle", "block").cogroup(mine.groupBy("own_bundle", "own_block")).applyInArrow(_step(k, n_docs, n_terms, best), shape)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    top = scale.top_rows(carried, ["bundle", "slot"], order, best, "rank").join(places, ["bundle", "slot"])
    name = fresh([item, "rank", "score"], "key") if key in (item, "rank", "score") else key
    return top.select(F.col("item").alias(item), "rank", F.col("id").alias(name), "score")
