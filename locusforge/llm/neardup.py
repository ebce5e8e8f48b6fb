"""Near duplicates of any similarity threshold by a chosen-path set similarity join.

Documents are reduced to the distinct hashes of their word shingles and to a
minwise signature. Independent trees branch the documents: a node chooses one
or more signature places by a hash of its path, and each document follows the
minwise token it has there. Similar documents share tokens and so stay
together; nodes of few documents are compared exhaustively, larger ones branch
again. What is still large at the last level (many copies of one text) is
compared with a pivot and in blocks. Every link is confirmed on the full sets:
first those of spanning forests, then, node by node, whatever may tie what the
first ones leave apart. A node gives fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.llm.components import components
from locusforge.llm.frames import fresh, mapped, scope, settle
from locusforge.llm.words import LOWER, chunks, mix, windows, word_hashes, word_limits
from locusforge.operators import scale

SHINGLE_WORDS = 5
PERCENT = 85
SIGNATURE = 128
TREES = 10
LEVELS = 5
LEAF = 48
#: Members of a large node whose signatures choose its pivots, and how many pivots it gets.
SAMPLE = 64
PIVOTS = 3
#: Members of a block when a large node is compared in tiles.
BLOCK = 512
#: Shingles of the members of a block, about: 16 MiB of hashes.
BLOCK_SHINGLES = 2**21
#: Shared shingles that one product of a node's members takes.
WIDTH = 4096
#: Signature places by which an estimate may fall short of the threshold, in standard deviations.
SLACK = 3.0

_random = np.random.default_rng(7)
MULTIPLIERS = _random.integers(0, 2**31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MASKS = _random.integers(0, 2**32, SIGNATURE, dtype=np.uint32)


def shingle_sets(chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a chunk end to end, and their limits.

    ASCII letters are lowered. A text of fewer words than ``size`` has its whole
    word sequence as the one shingle; a text without words has none.
    """
    lowered = chunk._replace(data=LOWER[chunk.data])
    words = word_limits(lowered)
    hashes = word_hashes(lowered.data, words)
    shingles, _ = windows(hashes, words, size)
    counts = np.diff(words.bounds)
    sizes = np.where(counts >= size, counts - size + 1, counts > 0).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    values = np.empty(heads[-1], np.uint64)
    long = np.repeat(counts >= size, sizes)
    values[long] = shingles
    values[~long] = [_fold(hashes[words.bounds[t] : words.bounds[t + 1]]) for t in np.flatnonzero((counts > 0) & (counts < size))]
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[heads[:-1][sizes > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[heads]


def _fold(hashes: np.ndarray) -> int:
    total = np.array([len(hashes)], np.uint64)
    for h in hashes:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h)
    return int(total[0])


def signatures(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One row of minwise values per set; rows of empty sets hold the largest value."""
    full = np.flatnonzero(np.diff(limits))
    out = np.full((len(limits) - 1, SIGNATURE), 0xFFFFFFFF, np.uint32)
    if len(full):
        heads = limits[full]
        short = (values >> np.uint64(32)).astype(np.uint32)
        for k in range(SIGNATURE):
            out[full, k] = np.minimum.reduceat((short ^ MASKS[k]) * MULTIPLIERS[k], heads)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("__text")):
            values, limits = shingle_sets(chunk, size)
            table = signatures(values, limits)
            counts = np.diff(limits)
            full = np.flatnonzero(counts)
            sums = np.zeros((2, chunk.n), np.uint64)
            if len(full):
                sums[0, full] = np.add.reduceat(values, limits[full])
                sums[1, full] = np.add.reduceat(mix(values), limits[full])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id").slice(chunk.first, chunk.n),
                    pa.array(counts.astype(np.int64)),
                    pa.array(mix(sums[0] + counts.astype(np.uint64)).view(np.int64)),
                    pa.array(mix(sums[1]).view(np.int64)),
                    pa.array([row.tobytes() for row in table], pa.binary()),
                ],
                names=["id", "n_shingles", "set_a", "set_b", "signature"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("__text")):
            values, limits = shingle_sets(chunk, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(chunk.first, chunk.n),
                    pa.array([values[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])], pa.binary()),
                ],
                names=["id", "set"],
            )


def _overlaps(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both full sets, and whether they reach the threshold."""
    for batch in batches:
        linked = []
        for left, right in zip(batch.column("set_1"), batch.column("set_2")):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
            both = len(x) + len(y) - len(np.union1d(x, y))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
        )


def _candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A maximum spanning forest of each node over the pairs whose signatures agree in ``least`` places."""
    for batch in batches:
        left, right = [], []
        for members in batch.column("members"):
            rows = sorted(members.as_py(), key=lambda r: r["id"])
            table = np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows])
            pairs = []
            for i in range(len(rows) - 1):
                same = (table[i + 1 :] == table[i]).sum(axis=1)
                pairs += [(-int(same[j]), i, i + 1 + int(j)) for j in np.flatnonzero(same >= least)]
            for i, j in _forest([(i, j) for _, i, j in sorted(pairs)], range(len(rows))):
                left.append(rows[i]["id"])
                right.append(rows[j]["id"])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _forest(pairs: Iterable[tuple[int, int]], labels: Iterable[int]) -> Iterator[tuple[int, int]]:
    """The pairs that tie members of still different labels, in the given order."""
    labels = list(labels)
    root = {x: x for x in labels}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        x, y = top(labels[i]), top(labels[j])
        if x != y:
            root[y] = x
            yield i, j


def _suspects(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Members of each node that agree in ``least`` places with one of another component.

    Only lone members are held against all; each member is named once.
    """
    for batch in batches:
        nodes, found = [], []
        for node, members in zip(batch.column("node").to_pylist(), batch.column("members")):
            rows = members.as_py()
            table = np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows])
            roots = np.array([r["root"] for r in rows], np.int64)
            met = np.zeros(len(rows), bool)
            for i in np.flatnonzero([r["lone"] for r in rows]):
                hits = ((table == table[i]).sum(axis=1) >= least) & (roots != roots[i])
                if hits.any():
                    met |= hits
                    met[i] = True
            ids = np.unique(np.array([r["id"] for r in rows], np.int64)[met])
            nodes += [node] * len(ids)
            found += ids.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.int64())], names=["node", "id"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct values, by products of blocks of shared values."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((n, n), np.int64)
    last = int(place[-1]) + 1 if len(place) else 0
    for first in range(0, last, WIDTH):
        a, b = np.searchsorted(place, [first, first + WIDTH])
        held = np.zeros((n, min(WIDTH, last - first)), np.float32)
        held[owner[a:b], place[a:b] - first] = 1
        total += (held @ held.T).astype(np.int64)
    return total


def _ties(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of the links between the full sets of each node, as many as tie its components together."""
    for batch in batches:
        left, right = [], []
        for members in batch.column("members"):
            part = members.values
            ids, roots = part.field("id").to_numpy(), part.field("root").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.field("set")]
            both = intersections(sets)
            sizes = np.array([len(x) for x in sets])
            linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
            i, j = np.nonzero(np.triu(linked & (roots[:, None] != roots), 1))
            for x, y in _forest(zip(i.tolist(), j.tolist()), roots.tolist()):
                left.append(min(ids[x], ids[y]))
                right.append(max(ids[x], ids[y]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _table(batch.column("s1")), _table(batch.column("s2"))
        ok = np.flatnonzero((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok))], names=["a", "b"])


def _children(tree_rows: DataFrame, percent: int) -> DataFrame:
    """Branch (node, id, signature) rows: each node picks 1 place, or 2 with the chance that makes 1/threshold."""
    extra = 100.0 / percent - 1.0
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SIGNATURE)).cast("int")
    step = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SIGNATURE - 1)).cast("int") + 1
    twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_000)) < int(extra * 1_000_000)
    places = F.when(twice, F.array(first, F.pmod(first + step, F.lit(SIGNATURE)))).otherwise(F.array(first))
    token = F.substring(F.col("signature"), 4 * F.col("place") + 1, F.lit(4))
    return tree_rows.withColumn("place", F.explode(places)).select(
        F.xxhash64("node", "place", token).alias("node"), "id"
    )


def _grow(sets: DataFrame, percent: int, trees: int, levels: int, leaf: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, id) rows of the nodes to compare exhaustively, and of those still large at the last level."""
    roots = F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(trees)]))
    rows = sets.select(roots.alias("node"), "id", "signature")
    small = None
    large = None
    for level in range(levels):
        placed = settle(_children(rows, percent), "nodes")
        sizes = settle(placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        sized = placed.join(sizes, "node")
        part = sized.where(F.col("n") <= leaf).select("node", "id")
        small = part if small is None else small.unionByName(part)
        large = sized.where(F.col("n") > leaf).select("node", "id")
        if sizes.where(F.col("n") > leaf).isEmpty():
            return small, None
        if level + 1 < levels:
            rows = large.join(sets.select("id", "signature"), "id")
    return small, large


def near_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    shingle_words: int = SHINGLE_WORDS,
    trees: int = TREES,
    levels: int = LEVELS,
    leaf: int = LEAF,
) -> DataFrame:
    """(key, n_shingles, component) of every row: the smallest key its text is linked to, directly or not.

    Texts with equal shingle sets are one class from the start, so copies cost
    one row. Of the classes, each tree gives candidate pairs by signature; a
    spanning forest of each node is confirmed on the full sets first. Members
    with candidates that the links found so far leave in different components
    meet again with their full sets, and their node gives the links that tie
    them. A node that stays large is compared with its pivots and in blocks;
    members that its main component leaves out are compared with all its rows.

    A null text and one without words have no shingle and are linked with
    nothing, but rows of one key are one document, compared by its text of most
    shingles. A null key is kept and gets a null component. Other columns are
    not read.
    """
    ids = fresh(docs.columns, "id")
    named = docs.select(F.col(key).cast("long").alias(ids), F.col(text).alias("__t"))
    source = named.select(F.col(ids).alias("__id"), F.col("__t").alias("__text"))
    least = int(np.ceil(SIGNATURE * (percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / SIGNATURE) ** 0.5)))
    with scope():
        rows = _linked(source, percent, least, shingle_words, trees, levels, leaf)
        found = rows.select(F.col("id").alias(key), "n_shingles", F.coalesce("root", "id").alias("component"))
        return settle(found, "components", outer=True)


def _linked(source: DataFrame, percent: int, least: int, size: int, trees: int, levels: int, leaf: int) -> DataFrame:
    """(id, n_shingles, root) of every row; root is null where nothing is linked."""
    with scope():
        sketched = settle(
            mapped(
                source,
                partial(_sketch, size=size),
                "id long, n_shingles long, set_a long, set_b long, signature binary",
            ),
            "sketches",
        )
        classes = sketched.where("n_shingles > 0 and id is not null").groupBy("set_a", "set_b", "n_shingles").agg(
            F.min("id").alias("id"), F.min("signature").alias("signature")
        )
        largest = F.max(F.struct("n_shingles", "set_a", "set_b", "signature"))
        sets = classes.groupBy("id").agg(largest.alias("s")).select("id", "s.signature", "s.n_shingles")
        sets = settle(sets, "sets", outer=True)
        sketched = settle(sketched.drop("signature"), "keys", outer=True)
    with scope():
        small, large = _grow(sets, percent, trees, levels, leaf)
        small = settle(_distinct_nodes(small), "leaves", outer=True)
        large = None if large is None else settle(large.distinct(), "large", outer=True)
    with scope():
        found = _compare(small, sets, least)
        if large is not None:
            with scope():
                near = settle(_pivots(large, sets, least), "pivot_pairs", outer=True)
            found = found.unionByName(near).unionByName(_compare(_blocks(large, leaf), sets, least))
        tried = settle(found.distinct(), "candidates")
        verdicts = settle(_confirm(tried, source, percent, size), "verdicts", outer=True)
    links = verdicts.where("linked").select("a", "b")
    with scope():
        roots = settle(components(links), "roots", outer=True)
    with scope():
        groups = _mixed(small, roots, sets)
        if large is not None:
            groups = groups.unionByName(_left_out(large, sets, roots))
        met = settle(mapped(groups, partial(_suspects, least=least), "node long, id long"), "suspects", outer=True)
    with scope():
        again = settle(_tied(met, verdicts, roots, source, percent, size), "ties", outer=True)
    # rows of one key with different texts are one document
    full = sketched.where("n_shingles > 0 and id is not null")
    firsts = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("b"))
    copies = full.join(settle(firsts, "firsts"), ["set_a", "set_b", "n_shingles"]).select(F.col("id").alias("a"), "b")
    copies = copies.where("a <> b").distinct()
    with scope():
        roots = settle(components(links.unionByName(again).unionByName(copies)), "roots", outer=True)
    return sketched.drop("set_a", "set_b").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each class of near duplicates, that of its smallest key, with all columns.

    Of several rows of one key one stays. Rows with a null key stay as they are.
    """
    with scope():
        found = near_components(docs, key, text, **settings)
        first = settle(found.where(F.col(key) == F.col("component")).select(key).distinct(), "kept", outer=True)
    kept = docs.join(first, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))


def _distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Small nodes without those that hold the same members as another, as different trees give."""
    return _member_lists(nodes).select("node", F.explode("ids").alias("id"))


def _member_lists(nodes: DataFrame) -> DataFrame:
    """(node, ids) of the nodes of at least two members, once per list of members."""
    members = nodes.groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return members.groupBy("ids").agg(F.min("node").alias("node")).where(F.size("ids") > 1)


def _compare(nodes: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Candidate pairs of small nodes."""
    rows = nodes.join(sets.select("id", "signature"), "id")
    members = rows.groupBy("node").agg(F.collect_list(F.struct("id", "signature")).alias("members"))
    return mapped(members.select("members"), partial(_candidates, least=least), "a long, b long")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, id) rows with the root of each member, itself if nothing links it."""
    return nodes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn(
        "root", F.coalesce("root", "id")
    )


def _mixed(nodes: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, members) of the small nodes that hold several components."""
    tagged = _rooted(nodes, roots)
    mixed = tagged.groupBy("node").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    rows = tagged.join(mixed.select("node"), "node").join(sets.select("id", "signature"), "id")
    member = F.struct("id", "signature", "root", F.lit(True).alias("lone"))
    return rows.groupBy("node").agg(F.collect_list(member).alias("members"))


def _tied(
    met: DataFrame, verdicts: DataFrame, roots: DataFrame, source: DataFrame, percent: int, size: int
) -> DataFrame:
    """Links that tie the components of each node, by the full sets; single pairs only if not yet tried."""
    lists = _member_lists(met).withColumns({"a": F.col("ids")[0], "b": F.element_at("ids", -1)})
    pairs = lists.where(F.size("ids") == 2).join(verdicts.select("a", "b"), ["a", "b"], "left_anti")
    open_lists = pairs.unionByName(lists.where(F.size("ids") > 2))
    nodes = settle(open_lists.select("node", F.explode("ids").alias("id")), "open")
    rows = _rooted(nodes, roots).join(_sets_of(nodes, source, size), "id")
    members = rows.groupBy("node").agg(F.collect_list(F.struct("id", "root", "set")).alias("members"))
    return mapped(members.select("members"), partial(_ties, percent=percent), "a long, b long").distinct()


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The commonest value at each place of the signatures of a node's sample."""
    for batch in batches:
        out = []
        for sample in batch.column("sample"):
            table = np.sort(np.stack([np.frombuffer(s, np.uint32) for s in sample.as_py()]), axis=0)
            runs = np.zeros(table.shape, np.int64)
            for i in range(1, len(table)):
                runs[i] = np.where(table[i] == table[i - 1], runs[i - 1] + 1, 0)
            out.append(table[runs.argmax(axis=0), np.arange(SIGNATURE)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "middle"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places at which each member agrees with the consensus of its node."""
    for batch in batches:
        same = (_table(batch.column("signature")) == _table(batch.column("middle"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("id"), pa.array(same.astype(np.int64))], names=["node", "id", "same"]
        )


def _table(signatures_: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures_.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _pivots(large: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Pairs of each member of a large node with the node's pivots.

    Near copies are made from one text, to which they are nearer than to each
    other. Pivots are the members that agree best with the consensus signature
    of a sample of the node; the sample only steers the choice of the pivots.
    """
    rows = settle(large.join(sets, "id"), "large_signatures")
    sample = scale.top_rows(rows, ["node"], [F.xxhash64("id"), F.col("id")], SAMPLE)
    sample = sample.groupBy("node").agg(F.collect_list("signature").alias("sample"))
    middle = settle(mapped(sample, _consensus, "node long, middle binary"), "consensus")
    agreed = mapped(
        rows.join(middle, "node").select("node", "id", "signature", "middle"), _agreement, "node long, id long, same long"
    )
    best = scale.top_rows(agreed, ["node"], [F.col("same").desc(), F.col("id")], PIVOTS).select("node", F.col("id").alias("p"))
    pivots = settle(best.join(sets.select(F.col("id").alias("p"), F.col("signature").alias("s1")), "p"), "pivots")
    pairs = rows.join(pivots, "node").where("id <> p")
    pairs = pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"), "s1", F.col("signature").alias("s2"))
    return mapped(pairs, partial(_near, least=least), "a long, b long").distinct()


def _blocks(large: DataFrame, leaf: int) -> DataFrame:
    """Large nodes dealt by a hash of the member into nodes of about ``leaf`` members."""
    sizes = settle(large.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "sizes")
    block = F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("n") / leaf))
    return large.join(sizes, "node").select(F.xxhash64("node", block).alias("node"), "id")


def _left_out(large: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, members) of large nodes in tiles: blocks of members outside the main component by blocks of all members.

    Blocks are small enough for the full sets of two of them to meet in one task.
    """
    tagged = settle(_rooted(large, roots), "large")
    parts = tagged.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    main = settle(parts.groupBy("node").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1"), "main")
    mixed = tagged.join(main, "node").join(sets, "id")
    mixed = settle(mixed.withColumn("out", F.col("root") != F.col("main")), "mixed")

    def blocks(count: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    sizes = mixed.groupBy("node").agg(
        blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks"),
        blocks(F.count_if("out"), F.sum(F.when(F.col("out"), F.col("n_shingles")))).alias("out_blocks"),
    )
    dealt = mixed.join(settle(sizes, "sizes"), "node")

    def spread(rows: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        return rows.withColumn(names[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(
            names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        )

    lone = spread(dealt.where("out"), "out_blocks", "blocks", ("i", "j")).withColumn("lone", F.lit(True))
    every = spread(dealt, "blocks", "out_blocks", ("j", "i")).withColumn("lone", F.lit(False))
    member = F.struct("id", "signature", "root", "lone")
    tiles = lone.unionByName(every).groupBy("node", "i", "j").agg(F.collect_list(member).alias("members"))
    return tiles.select(F.xxhash64("node", "i", "j").alias("node"), "members")


def _sets_of(ids: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """(id, set) of the full shingle sets of the given ids, of several texts the one with most shingles."""
    wanted = settle(ids.select("id").distinct(), "wanted")
    texts = source.join(wanted, source["__id"] == wanted["id"]).select("id", "__text")
    full = settle(mapped(texts, partial(_full_sets, size=size), "id long, set binary"), "full_sets")
    return full.groupBy("id").agg(F.max_by("set", F.struct(F.length("set"), "set")).alias("set"))


def _confirm(pairs: DataFrame, source: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b, linked) by the full shingle sets of both texts."""
    full = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), source, size)
    rows = pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("set_1")), "a").join(
        full.select(F.col("id").alias("b"), F.col("set").alias("set_2")), "b"
    )
    return mapped(
        rows.select("a", "b", "set_1", "set_2"), partial(_overlaps, percent=percent), "a long, b long, linked boolean"
    )
