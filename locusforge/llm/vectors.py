"""Approximate nearest neighbours by inner product over balanced posting lists.

Equal vectors are one class. A bounded sample is split again and again at the
median along its main direction, so that the lists are balanced; their centres
are tied in a graph that fits into memory. A vector at the border of lists is
put into each of them. A query walks the graph to the lists whose distance is
within a ratio of the nearest one's; the ratio is set so that the wanted part
of the true neighbours of some queries, found by brute force over all rows,
lies in the lists it selects. Members are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import mapped, scope, settle
from locusforge.operators import scale
from locusforge.session import ship_package

BEST = 20
#: Queries are the rows whose id is divisible by this.
EVERY = 20
#: Vectors, about, of which the lists are made: the only bound of the fit.
SAMPLE = 1 << 14
#: Members that a list is meant to have, and the most lists; lists grow beyond that and are read in blocks.
LIST_ROWS = 512
MOST_LISTS = 2048
#: A vector is in at most so many lists, those within this ratio of its nearest one.
COPIES = 4
BORDER = 1.08
#: Neighbours of a centre in the graph, and centres that a walk keeps open at least.
DEGREE = 16
OPEN = 32
#: Queries whose true neighbours set the ratio, and the part of these that the lists have to hold.
TRIALS = 256
RECALL = 0.98
#: Lists that a query reads first.
NEAREST = 4
#: Members and queries of a tile.
BLOCK = 2048
#: Scores nearer than this to the last one kept are computed anew, value by value.
CLOSE = 1e-9
SEED = 20


class Index(NamedTuple):
    """Centres in the space with one more dimension, their graph, a sound size of each list, the longest norm and the ratio."""

    centres: np.ndarray
    graph: np.ndarray
    sizes: np.ndarray
    norm: float
    ratio: float


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Points whose distance to a lifted query falls as the inner product grows."""
    scaled = vectors / norm
    rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", scaled, scaled), 0.0))
    return np.hstack([scaled, rest[:, None]])


def lifted_queries(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors / np.linalg.norm(vectors, axis=1)[:, None], np.zeros((len(vectors), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def balanced_centres(points: np.ndarray, n: int) -> np.ndarray:
    """Centres of ``n`` parts of nearly equal size: each split is at a quantile along the direction of two means."""
    rnd = np.random.default_rng(SEED)
    out, todo = [], [(points, n)]
    while todo:
        part, k = todo.pop()
        if k == 1 or len(part) < 2:
            out.append(part.mean(axis=0))
            continue
        a, b = part[rnd.choice(len(part), 2, replace=False)]
        for _ in range(6):
            side = part @ (b - a) > (b - a) @ (a + b) / 2
            if side.all() or not side.any():
                break
            a, b = part[~side].mean(axis=0), part[side].mean(axis=0)
        order = np.argsort(part @ (b - a), kind="stable")
        left = k // 2
        cut = min(max(len(part) * left // k, 1), len(part) - 1)
        todo += [(part[order[:cut]], left), (part[order[cut:]], k - left)]
    return np.array(out)


def graph_of(centres: np.ndarray) -> np.ndarray:
    """Neighbours of each centre: the nearest ones, and one that keeps the graph in one piece."""
    n = len(centres)
    near = min(DEGREE, n - 1)
    rows = []
    squares = np.einsum("ij,ij->i", centres, centres)
    for first in range(0, n, 256):
        d = squares - 2 * centres[first : first + 256] @ centres.T
        d[np.arange(len(d)), first + np.arange(len(d))] = np.inf
        rows.append(np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(d), 0), np.int64))
    nearest = np.vstack(rows)
    return np.hstack([nearest, ((np.arange(n) + 1) % n)[:, None]])


def walk(points: np.ndarray, index: Index, ratio: float) -> np.ndarray:
    """Distances of each point to the centres that its walk has seen, infinite for the others.

    Every round opens all centres seen that are within ``ratio`` of the nearest
    one or among the ``OPEN`` nearest, and sees their neighbours.
    """
    n = len(index.centres)
    seen = np.full((len(points), n), np.inf)
    opened = np.zeros(seen.shape, bool)
    starts = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
    rows, cols = np.repeat(np.arange(len(points)), len(starts)), np.tile(starts, len(points))
    least = min(OPEN, n) - 1
    while len(rows):
        away = points[rows] - index.centres[cols]
        seen[rows, cols] = np.sqrt(np.einsum("ij,ij->i", away, away))
        limit = np.maximum(seen.min(axis=1) * ratio, np.partition(seen, least, axis=1)[:, least])
        fresh = (seen <= limit[:, None]) & ~opened & np.isfinite(seen)
        opened |= fresh
        at, node = np.nonzero(fresh)
        met = np.zeros(seen.shape, bool)
        met[np.repeat(at, index.graph.shape[1]), index.graph[node].ravel()] = True
        rows, cols = np.nonzero(met & np.isinf(seen))
    return seen


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _assign(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Lists of each class: the nearest one, and those within the border that no chosen one is nearer to."""
    width = index.centres.shape[1] - 1
    between = distances(index.centres, index.centres)
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            seen = walk(lifted(_matrix(part.column("vec"), width), index.norm), index, BORDER)
            order = np.argsort(seen, axis=1, kind="stable")[:, : 2 * COPIES]
            owners, lists, heads = [], [], []
            for i, row in enumerate(order.tolist()):
                chosen = [row[0]]
                for c in row[1:]:
                    if len(chosen) == COPIES or not seen[i, c] <= BORDER * seen[i, row[0]]:
                        break
                    if between[c, chosen].min() >= seen[i, c] * 0.5:
                        chosen.append(c)
                owners += [i] * len(chosen)
                lists += chosen
                heads += [True] + [False] * (len(chosen) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), part.column("cls").take(pa.array(owners, pa.int64())), pa.array(heads, pa.bool_())],
                names=["list", "cls", "head"],
            )


def _select(batches: Iterator[pa.RecordBatch], index: Index, enough: int) -> Iterator[pa.RecordBatch]:
    """Lists that each query reads: those within the ratio, and the nearest until they hold enough members."""
    width = index.centres.shape[1] - 1
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            points = lifted_queries(_matrix(part.column("vec"), width))
            seen = walk(points, index, index.ratio)
            order = np.argsort(seen, axis=1, kind="stable")
            before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
            ranked = np.take_along_axis(seen, order, axis=1)
            near = (ranked <= index.ratio * ranked[:, :1]) | (before < enough)
            at, place = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[at, place].astype(np.int32)), pa.array(place.astype(np.int32)), part.column("cls").take(pa.array(at))],
                names=["list", "nth", "cls"],
            )


def _nearest(queries: np.ndarray, members: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score) of the best members of each query and those as near as the last of them.

    Scores are summed value by value for each pair alone, so that a pair has the same one wherever it is met.
    """
    rough = queries @ members.T
    if rough.shape[1] > best:
        last = np.partition(rough, rough.shape[1] - best, axis=1)[:, rough.shape[1] - best]
        q, m = np.nonzero(rough >= (last - CLOSE * np.maximum(np.abs(last), 1.0))[:, None])
    else:
        q, m = (x.ravel() for x in np.indices(rough.shape))
    return q, m, (queries[q] * members[m]).sum(axis=1)


def _trial(batches: Iterator[pa.RecordBatch], queries: np.ndarray, best: int) -> Iterator[pa.RecordBatch]:
    """The best classes of a task's batches for each of some queries."""
    for batch in batches:
        if not batch.num_rows:
            continue
        q, m, score = _nearest(queries, _matrix(batch.column("vec"), queries.shape[1]), best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.astype(np.int32)), batch.column("cls").take(pa.array(m)), pa.array(score)], names=["trial", "cls", "score"]
        )


def _compare(queries: pa.Table, members: pa.Table, best: int) -> pa.Table:
    """The best members of a tile for each of its queries."""
    if not queries.num_rows or not members.num_rows:
        q, m, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    else:
        flat = [t.column("vec").combine_chunks() for t in (queries, members)]
        width = len(flat[0][0])
        q, m, score = _nearest(*(_matrix(x, width) for x in flat), best)
        kept = score >= queries.column("least").to_numpy()[q]
        q, m, score = q[kept], m[kept], score[kept]
    return pa.table(
        {
            "query": queries.column("cls").take(pa.array(q)),
            "cls": members.column("cls").take(pa.array(m)),
            "first": members.column("first").take(pa.array(m)),
            "score": pa.array(score, pa.float64()),
        }
    )


def sound_rows(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, once each."""
    value = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.where(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0))
    return given.select(F.col(key).cast("long").alias("id"), value.alias("vec")).distinct()


def nearest(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, best: int = BEST, recall: float = RECALL
) -> DataFrame:
    """(query, rank, neighbour, score) of the rows whose key is divisible by ``every``, as query_id, rank, vec_id, score.

    The neighbours of a query are the rows of another key with the largest inner
    product, equal ones by key; ``best`` of them, or all if there are fewer.
    Vectors that are null, empty, zero or hold a null or non-finite value take
    no part, nor do null keys and vectors of another length than most have.
    Repeated rows are one. About ``recall`` of the true neighbours are found;
    scores and their order among those found are exact. Other columns are not read.
    """
    with scope():
        return settle(_found(rows, key, vector, every, best, recall), "nearest", outer=True)


def _found(rows: DataFrame, key: str, vector: str, every: int, best: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    ship_package(spark)
    given = settle(sound_rows(rows, key, vector), "vectors")
    widths = given.groupBy(F.size("vec").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.orderBy(F.col("n").desc(), F.col("w").desc()).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], shape)
    given = given.where(F.size("vec") == width["w"])
    # of a class only its first ids can be among the best, whatever its size
    first = scale.top_rows(given, ["vec"], [F.col("id")], best + 1, "nth")
    classes = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), F.col("ids")[0].alias("first"), "ids", "vec")
    classes = settle(classes, "classes")
    packs = given.where(F.col("id") % every == 0).groupBy("vec", F.floor(F.col("id") / (every * 1024)).alias("pack"))
    packs = packs.agg(F.collect_list("id").alias("queries")).join(classes.select("vec", "cls"), "vec")
    packs = settle(packs.select("cls", "queries"), "packs")
    asking = settle(classes.join(packs.select("cls").distinct(), "cls", "left_semi").select("cls", "vec"), "queries")
    index, lists = build(classes, asking, best, recall)
    found = search(classes, asking, index, lists, best + 1)
    top = scale.top_rows(found, ["query"], [F.col("score").desc(), F.col("first")], best + 1, "nth")
    each = top.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("id"))
    ranked = scale.top_rows(each, ["query"], [F.col("score").desc(), F.col("id")], best + 1, "nth")
    order = F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("near")
    ranked = ranked.groupBy("query").agg(order)
    asked = packs.join(ranked, packs["cls"] == ranked["query"]).select(F.explode("queries").alias("query_id"), "near")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, best)
    return asked.select("query_id", F.posexplode(others).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )


def _hashed(rows: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` of ``n`` rows, by a hash of the class's first id."""
    return rows.where(F.pmod(F.xxhash64("first", F.lit(seed)), F.lit(1 << 40)) < int(min(wanted / max(n, 1), 1.0) * (1 << 40)))


def build(classes: DataFrame, asking: DataFrame, best: int, recall: float) -> tuple[Index, DataFrame]:
    """The index of all classes and (list, cls, head), its lists.

    The driver reads about ``SAMPLE`` vectors and ``TRIALS`` queries with their
    ``best`` neighbours; the norm, the lists and the neighbours cover all rows.
    """
    dot = F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(dot)).alias("norm")).first()
    sample = np.array([r["vec"] for r in _hashed(classes, stats["n"], SAMPLE, 1).select("vec", "first").orderBy("first").collect()])
    if not len(sample):
        sample = np.array([r["vec"] for r in classes.select("vec").limit(1).collect()])
    n_lists = int(min(max(stats["n"] // LIST_ROWS, 1), MOST_LISTS, len(sample)))
    centres = balanced_centres(lifted(sample, stats["norm"]), n_lists)
    index = Index(centres, graph_of(centres), np.zeros(len(centres), np.int64), stats["norm"], 1.0)
    lists = settle(mapped(classes.select("cls", "vec"), partial(_assign, index=index), "list int, cls long, head boolean"), "lists")
    sizes = index.sizes.copy()
    for r in lists.where("head").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["n"]
    index = index._replace(sizes=sizes)
    n_asking = asking.count()
    trials = asking.withColumnRenamed("cls", "first")
    trials = np.array([r["vec"] for r in _hashed(trials, n_asking, TRIALS, 2).orderBy("first").limit(2 * TRIALS).collect()])
    if not len(trials):
        return index._replace(ratio=np.inf), lists
    near = mapped(classes.select("cls", "vec"), partial(_trial, queries=trials, best=best + 1), "trial int, cls long, score double")
    near = scale.top_rows(near, ["trial"], [F.col("score").desc(), F.col("cls")], best + 1, "nth")
    held = near.join(lists, "cls").groupBy("trial", "cls").agg(F.collect_list("list").alias("lists")).collect()
    away = distances(lifted_queries(trials), centres)
    least = np.maximum(away.min(axis=1), CLOSE)
    needed = [max(min(away[r["trial"], c] for c in r["lists"]) / least[r["trial"]], 1.0) for r in held]
    ratio = float(np.quantile(needed, min(recall + (1 - recall) / 4, 1.0), method="higher")) if needed else np.inf
    return index._replace(ratio=ratio * (1 + CLOSE)), lists


def search(classes: DataFrame, asking: DataFrame, index: Index, lists: DataFrame, best: int) -> DataFrame:
    """(query, cls, first, score) of the best classes in each tile of the lists that a query reads, once per class.

    The nearest lists of all queries are read first. The last of the best found
    there is what a member of the other lists has to reach, so that those give
    few rows.
    """
    visits = mapped(asking, partial(_select, index=index, enough=2 * best), "list int, nth int, cls long")
    visits = settle(visits, "visits")
    near = _met(classes, asking, lists, visits.where(F.col("nth") < NEAREST).withColumn("least", F.lit(float("-inf"))), best)
    near = settle(near.distinct(), "near")
    top = scale.top_rows(near.select("query", "cls", "score"), ["query"], [F.col("score").desc(), F.col("cls")], best, "place")
    least = top.where(F.col("place") == best).select(F.col("query").alias("cls"), F.col("score").alias("least"))
    rest = visits.where(F.col("nth") >= NEAREST).join(least, "cls", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    far = _met(classes, asking, lists, rest, best)
    return near.unionByName(far).distinct()


def _met(classes: DataFrame, asking: DataFrame, lists: DataFrame, visits: DataFrame, best: int) -> DataFrame:
    """The best classes for each query in each tile of (list, cls, least) visits, if they reach ``least``."""

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    sizes = settle(parts(lists, "m").join(parts(visits, "q"), "list"), "tiles")  # one row per list

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("cls"), F.col(own)).cast("int").alias(f"of_{own}")
        each: Column = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"of_{other}")
        return rows.join(F.broadcast(sizes), "list").select(*rows.columns, block, each)

    tile = ["list", "of_q", "of_m"]
    queries = dealt(visits.select("list", "cls", "least"), "q", "m").join(asking, "cls").select(*tile, "cls", "vec", "least")
    members = dealt(lists.select("list", "cls"), "m", "q").join(classes.select("cls", "first", "vec"), "cls")
    members = members.select(*tile, "cls", "first", "vec")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compare(left, right, best)

    return queries.groupBy(*tile).cogroup(members.groupBy(*tile)).applyInArrow(compared, "query long, cls long, first long, score double")
