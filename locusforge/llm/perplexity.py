"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The units are bytes, so an n-gram is exact in one integer. Counts of trusted
text are aggregated over the whole corpus; lower orders count distinct left
neighbours. Blocks of documents ask for their distinct n-grams only, the
requests are joined with the count tables, which Spark shards by n-gram, and
the answers meet the texts of the block again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.llm.frames import fresh, give_back, mapped, replayable, salted, scope, settle
from locusforge.llm.langid import is_held_out
from locusforge.llm.words import chunks, text_sums
from locusforge.session import ship_package

ORDER = 4
#: A block, the unit that one task scores, ends at so many bytes or rows; a longer text is a block of its own.
BLOCK_BYTES = 1 << 23
BLOCK_ROWS = 1 << 13
#: Bytes of trusted text of a language that weigh as much as the model of all text.
PRIOR_BYTES = 20_000
#: Held-out trusted texts of a language that weigh as much as the limit of all text.
PRIOR_TEXTS = 12
ALL = "*"
#: Ids of trusted rows are broadcast up to this many, 16 bytes each; beyond that they are joined by shuffling.
MOST_BROADCAST = 2_000_000
#: Bytes of average text that every text is taken to have besides its own, so that short texts aren't judged by chance.
SHRINK = 150
#: The limit lies beyond this quantile of held-out trusted text by so many times its distance from the median.
QUANTILE = 0.98
MARGIN = 1.0
BUCKETS = 1000


def _packed(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, in one integer; places before a text's start are 0."""
    place = np.arange(len(data)) - np.repeat(limits[:-1], np.diff(limits))
    out = np.zeros(len(data), np.int64)
    for k in range(ORDER):
        shifted = np.zeros(len(data), np.int64)
        shifted[k:] = data[: len(data) - k]
        shifted[place < k] = 0
        out |= shifted << (8 * k)
    return out


def _by_group(chunk, groups: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """N-grams of a chunk's texts for each group."""
    grams = _packed(chunk.data, chunk.limits)
    names, codes = np.unique(np.array(groups.to_pylist(), object).astype(str), return_inverse=True)
    owner = np.repeat(codes, np.diff(chunk.limits))
    for n, name in enumerate(names.tolist()):
        yield name, grams if len(names) == 1 else grams[owner == n]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            for name, grams in _by_group(chunk, batch.column("grp").slice(chunk.first, chunk.n)):
                found, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(counts.astype(np.int64))],
                    names=["grp", "gram", "n"],
                )


def _blocked(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task cut into blocks; the cuts depend on the rows alone, not on their batches."""
    block = TaskContext.get().partitionId() << 32
    rows = size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).tolist()
        first = 0
        for i, length in enumerate(lengths):
            if rows and (size + length > BLOCK_BYTES or rows == BLOCK_ROWS):
                if i > first:
                    yield block, batch.slice(first, i - first)
                first, block, rows, size = i, block + 1, 0, 0
            rows, size = rows + 1, size + length
        if len(lengths) > first:
            yield block, batch.slice(first)


def _numbered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of each block as packed batches: they take far less room on their way than rows one by one."""
    for block, batch in _blocked(batches, text):
        packed = pa.BufferOutputStream()
        with pa.ipc.new_stream(packed, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([packed.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"]
        )


def _unpacked(packed: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(value.as_buffer()).read_all() for value in packed])


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each block."""
    last, held = None, {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, parts in held.items():
            found = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), last, np.int64)), pa.array([name] * len(found), pa.string()), pa.array(found)],
                names=["block", "grp", "gram"],
            )

    for block, batch in _blocked(batches, "text"):
        if block != last:
            yield from flush()
            last, held = block, {}
        for chunk in chunks(batch.column("text")):
            for name, grams in _by_group(chunk, batch.column("grp").slice(chunk.first, chunk.n)):
                parts = held.setdefault(name, [])
                parts.append(np.unique(grams))
                if len(parts) > 16:
                    parts[:] = [np.unique(np.concatenate(parts))]
    yield from flush()


def _score(texts: pa.Table, answers: pa.Table, columns: tuple[str, ...], text: str) -> pa.Table:
    """Texts of one block with the sum of surprises of their bytes."""
    tables = {}
    names = answers.column("grp").to_pandas().to_numpy()
    grams = answers.column("gram").to_numpy()
    surprise = answers.column("surprise").to_numpy()
    for name in set(names.tolist()):
        own = np.flatnonzero(names == name)
        own = own[np.argsort(grams[own])]
        tables[name] = grams[own], surprise[own]
    total, n_bytes = [], []
    for part in texts.column(text).chunks:
        part_groups = texts.column("grp").slice(len(total), len(part)).combine_chunks()
        for chunk in chunks(part):
            groups = part_groups.slice(chunk.first, chunk.n).to_pylist()
            wanted = _packed(chunk.data, chunk.limits)
            values = np.zeros(len(wanted))
            owner = np.repeat(np.arange(chunk.n), np.diff(chunk.limits))
            for name in set(groups):
                if name in tables:
                    at = np.flatnonzero(np.array([g == name for g in groups])[owner])
                    keys, given = tables[name]
                    distinct, inverse = np.unique(wanted[at], return_inverse=True)
                    place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                    if (keys[place] != distinct).any():
                        raise RuntimeError("a block has n-grams it didn't ask for: the input changed between two passes")
                    values[at] = given[place][inverse]
            total += text_sums(values, chunk.limits).tolist()
            n_bytes += np.diff(chunk.limits).tolist()
    kept = texts.select(list(columns))
    give_back()
    return kept.append_column("surprise", pa.array(total, pa.float64())).append_column("n_bytes", pa.array(n_bytes, pa.int64()))


def trusted_text(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(text, lang, held) of the rows labelled good and not toxic; held rows set limits, the others are counted."""
    good = settle(_good(labels, key, key), "trusted")
    if good.count() <= MOST_BROADCAST:
        good = F.broadcast(good)
    rows = docs.select(F.col(key), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.join(good, key).select(F.col(key), "text", "lang", is_held_out(key).alias("held"))


def _discounted(table: DataFrame) -> DataFrame:
    """(grp, gram, own, ctx) and the weight left for lower orders, of an order's counts."""
    shape = table.groupBy("grp").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

    def d(k: int, fallback: float) -> Column:
        value = k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}")
        return F.when((value > 0) & (value < k), value).otherwise(fallback).alias(f"d{k}")

    shape = settle(shape.select("grp", d(1, 0.5), d(2, 1.0), d(3, 1.5)), "discounts")
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = salted(table, shape, "grp", "gram").select("grp", "gram", "n", cut.alias("cut"), F.shiftright("gram", 8).alias("ctx"))
    totals = settle(
        rows.groupBy("grp", "ctx").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("left")), "contexts"
    )
    return rows.join(totals, ["grp", "ctx"]).select(
        "grp", "gram", "ctx", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "left"
    )


def build_model(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from the highest: (grp, gram, p) and (grp, ctx, left) tables.

    ``trusted`` has (grp, text). Counts cover all its rows.
    """
    counts = mapped(trusted.select("grp", "text"), _counts, "grp string, gram long, n long")
    counts = settle(counts.groupBy("grp", "gram").agg(F.sum("n").alias("n")), "counts")
    everything = counts.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("grp"), "gram", "n")
    tables = [settle(counts.unionByName(everything), "counts")]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
        lower = tables[-1].groupBy("grp", suffix).agg(F.count(F.lit(1)).alias("n"))
        tables.append(settle(lower, "counts"))
    model, below = [], None
    for order, table in zip(range(1, ORDER + 1), reversed(tables)):
        rows = _discounted(table)
        if below is None:
            p = rows.select("grp", "gram", (F.col("own") + F.col("left") / 256).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            lower = below.select("grp", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = (
                rows.withColumn("suffix", suffix)
                .join(lower, ["grp", "suffix"])
                .select("grp", "gram", (F.col("own") + F.col("left") * F.col("q")).alias("p"))
            )
        below = settle(p, "order")
        model.append((below, settle(rows.select("grp", "ctx", "left").distinct(), "left")))
    return model[::-1]


def answer(requests: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(grp, gram, p) of distinct (grp, gram) requests.

    A request that an order doesn't know goes on to the next lower one with the
    weight its context leaves, so only the unknown ones are joined again.
    """
    open_ = requests.select("grp", "gram", F.col("gram").alias("part"), F.lit(1.0).alias("weight"))
    done = None
    for order, (known, contexts) in zip(range(ORDER, 0, -1), model):
        joined = open_.join(known.select("grp", F.col("gram").alias("part"), "p"), ["grp", "part"], "left")
        joined = settle(joined, "answers")
        hit = joined.where("p is not null").select("grp", "gram", (F.col("weight") * F.col("p")).alias("p"))
        done = hit if done is None else done.unionByName(hit)
        open_ = (
            joined.where("p is null")
            .drop("p")
            .withColumn("ctx", F.shiftright("part", 8))
            .join(contexts, ["grp", "ctx"], "left")
            .select(
                "grp", "gram",
                F.col("part").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)).alias("part"),
                (F.col("weight") * F.coalesce("left", F.lit(1.0))).alias("weight"),
            )
        )
    return done.unionByName(open_.select("grp", "gram", (F.col("weight") / 256).alias("p")))


def surprises(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]], shares: DataFrame) -> DataFrame:
    """(grp, gram, surprise) of distinct (grp, gram) requests.

    The model of a language and that of all text are mixed by the language's
    share, which grows with its trusted text and is 0 without any.
    """
    wanted = settle(asked.select("grp", "gram").distinct(), "wanted")
    own = answer(wanted.where(F.col("grp") != ALL), model)
    every = settle(answer(wanted.select(F.lit(ALL).alias("grp"), "gram").distinct(), model), "all_answers")
    every = every.select("gram", F.col("p").alias("q"))
    # a gram that many languages ask for is one row of each
    mixed = salted(own.join(every, "gram"), shares, "grp", "gram", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    p = F.col("share") * F.col("p") + (1 - F.col("share")) * F.col("q")
    plain = wanted.where(F.col("grp") == ALL).join(every, "gram").select("grp", "gram", (-F.log("q")).alias("surprise"))
    return mixed.select("grp", "gram", (-F.log(p)).alias("surprise")).unionByName(plain)


def score(
    parts: list[tuple[DataFrame, tuple[str, ...], str]], model: list[tuple[DataFrame, DataFrame]], shares: DataFrame
) -> list[DataFrame]:
    """The given columns of every row of each (docs, columns, text) with ``surprise`` (sum over bytes, in nats) and ``n_bytes``.

    ``docs`` has also ``grp`` and the column of the text. What all parts ask for
    is answered together. Two passes cut a part into the same blocks if they
    read the same rows in the same order, as scans of files do; otherwise the
    job fails.
    """
    asked = []
    for docs, _, text in parts:
        rows = mapped(docs.select("grp", F.col(text).alias("text")), _requests, "block long, grp string, gram long")
        asked.append(settle(rows, "requests"))
    with scope():
        wanted = reduce(DataFrame.unionByName, asked)
        answers = settle(surprises(wanted, model, shares), "surprises", outer=True)
    answers = answers.withColumn("surprise", F.col("surprise").cast("float"))
    return [_scored_part(*part, own.join(answers, ["grp", "gram"])) for part, own in zip(parts, asked)]


def _scored_part(docs: DataFrame, columns: tuple[str, ...], text: str, answered: DataFrame) -> DataFrame:
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", surprise double, n_bytes long"
    wanted = docs.select(*dict.fromkeys(["grp", text, *columns]))
    packed = mapped(wanted, partial(_numbered, text=text), "block long, packed binary")

    def scored(texts: pa.Table, given: pa.Table) -> pa.Table:
        return _score(_unpacked(texts.column("packed")), given, columns, text)

    return packed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(scored, schema)


def limits(scores: DataFrame) -> DataFrame:
    """(grp, mid, high, n) of (grp, surprise, n_bytes) rows of held-out trusted text.

    Quantiles are read off counts of rounded values, which combine before the
    shuffle.
    """
    whole = scores.where("n_bytes > 0")
    means = whole.groupBy("grp").agg((F.sum("surprise") / F.sum("n_bytes")).alias("mid"), F.count(F.lit(1)).alias("n"))
    means = settle(means, "means")
    value = (F.col("surprise") + SHRINK * F.col("mid")) / (F.col("n_bytes") + SHRINK)
    buckets = salted(whole, means.drop("n"), "grp", "n_bytes").groupBy("grp", F.floor(value * BUCKETS).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("grp").orderBy("b")) / F.sum("n").over(Window.partitionBy("grp"))
    ranked = buckets.withColumn("q", up_to)

    def at(q: float) -> Column:
        return F.min(F.when(F.col("q") >= q, F.col("b"))) / BUCKETS

    edges = ranked.groupBy("grp").agg(at(0.5).alias("m"), at(QUANTILE).alias("z"))
    return edges.join(means, "grp").select(
        "grp",
        "mid",
        "n",
        (F.col("z") + MARGIN * (F.col("z") - F.col("m")) + 1.0 / BUCKETS).alias("high"),
    )


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: bool = False) -> DataFrame:
    """(key, grp, n_bytes, perplexity, high, kept) of every row; with ``carry`` all columns of ``docs`` and ``kept``.

    A row is kept if the perplexity of its whole text, per byte, is at most the
    limit of its language, which comes from held-out trusted text. Short
    texts are drawn towards the mean of their language. The model of a language
    is mixed with that of all trusted text, and its limit with the limit of all
    held-out trusted text under the latter, the more so the less of its own
    there is; a null language and one without trusted text have only the latter.
    A null or empty text has no perplexity and goes. Without trusted text every other row is kept. Rows of
    one key are judged each on its own. Labels of unknown keys and extra columns
    of ``labels`` don't matter.
    """
    sources = list(docs.columns) if carry else [key]
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(sources)]
    with scope():
        docs = replayable(docs, "documents")
        scored, edges = _scored(docs, labels, key, text, lang, sources, carry)
        # one row, or none without held-out trusted text
        every = edges.where(F.col("grp") == ALL).first()
    own = salted(scored, edges.where(F.col("grp") != ALL), "grp", "n_bytes", "left")
    weight = F.coalesce(F.col("n") / (F.col("n") + PRIOR_TEXTS), F.lit(0.0))
    for name in ("mid", "high"):
        other = F.lit(None if every is None else every[name]).cast("double")
        own = own.withColumn(name, weight * F.coalesce(name, F.lit(0.0)) + (1 - weight) * other)
    value = (F.col("surprise") + SHRINK * F.col("mid")) / (F.col("n_bytes") + SHRINK)
    verdict = (F.col("n_bytes") > 0) & F.coalesce(value <= F.col("high"), F.lit(True))
    if carry:
        return own.where(verdict).select(*back)
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(F.coalesce(value, F.col("surprise") / F.col("n_bytes"))))
    return own.select(
        *back, "grp", "n_bytes", perplexity.alias("perplexity"), F.exp("high").alias("high"), verdict.alias("kept")
    )


def _scored(
    docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, sources: list[str], carry: bool
) -> tuple[DataFrame, DataFrame]:
    """Every row with the columns ``sources`` as c0, c1 and so on and its surprise; and the limits. Both outlive the scope."""
    trusted = trusted_text(docs, labels, key, text, lang)
    # texts without a language are counted under a name of their own, which only the model of all text sees
    own = F.when(F.col("lang") != ALL, F.col("lang")).otherwise("")
    counted = trusted.where("not held").select(own.alias("grp"), "text")
    model = build_model(counted)
    sizes = counted.where("grp <> ''").groupBy("grp").agg(F.sum(F.octet_length("text")).alias("n"))
    share = F.col("n") / (F.col("n") + PRIOR_BYTES)
    shares = settle(sizes.where("n > 0").select("grp", share.alias("share")), "shares")
    known = shares.select(F.col("grp").alias("lang"), "grp")
    if shares.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    plain = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(sources)],
        F.col(key).alias("__k"),
        F.col(lang).alias("lang"),
        *([] if carry else [F.col(text).alias("text")]),
    )
    rows = plain.join(known, "lang", "left").withColumn("grp", F.coalesce("grp", F.lit(ALL)))
    kept_columns = (*[f"c{i}" for i in range(len(sources))], "__k", "grp")
    own_text = f"c{sources.index(text)}" if carry else "text"
    # the limit of all text comes from all held-out trusted text under the model of all text
    again = settle(trusted.where("held").select("text", F.lit(ALL).alias("grp")), "held_out")
    scored, again = score([(rows, kept_columns, own_text), (again, ("grp",), "text")], model, shares)
    scored = settle(scored, "scores", outer=True)
    held = scored.where(is_held_out("__k")).select("__k", "grp", "surprise", "n_bytes").join(_good(labels, key, "__k"), "__k")
    held = held.where(F.col("grp") != ALL).select("grp", "surprise", "n_bytes")
    edges = limits(held.unionByName(again))
    return scored, settle(edges, "limits", outer=True)


def _good(labels: DataFrame, key: str, name: str) -> DataFrame:
    trusted = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where(trusted).select(F.col(key).alias(name)).distinct()
