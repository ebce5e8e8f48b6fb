"""Finding association loci: filters, locus breaker, window and LD clumping."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.operators.intervals import bin_of, join_points_to_intervals, mark_overlapping
from locusforge.operators.scale import null_safe_join
from locusforge.session import cut_lineage, only_scans, ship_package, stored

# Thresholds and distances of the configured steps.
EQTL_LEAD_PVALUE = 1e-3
FINNGEN_LEAD_PVALUE = 1e-5
PQTL_PVALUE = 1.7e-11
LBC_BASELINE_PVALUE = 1e-5
LBC_DISTANCE = 250_000
LBC_FLANK = 100_000
LARGE_LOCUS = 1_500_000
CLUMP_DISTANCE = 500_000

# An island of at most this many candidate positions is clumped in one array fold.
FOLD_POSITIONS = 5_000
# Rows of a tile of a larger island, which one task folds together with the bins beside it.
TILE_ROWS = 200_000
# Longs of 64 bits in the sketch of a variant's studies.
SKETCH_WORDS = 4


def pvalue_filter(df: DataFrame, strength: str, threshold: float) -> DataFrame:
    """Rows whose -log10 p reaches the threshold, itself given as -log10 p."""
    return df.where(F.col(strength) >= F.lit(float(threshold)))


def blacklist_filter(df: DataFrame, blacklist: DataFrame, on: str, listed: str) -> DataFrame:
    """Drop rows whose value is on the blacklist."""
    return df.join(blacklist.select(F.col(listed).alias(on)), on, "left_anti")


def locus_peak(df: DataFrame, locus: Sequence[str], *, position: str, strength: str, tie: str) -> DataFrame:
    """Lead, start, end and size of each locus; equal leads go by position, then id."""
    return df.groupBy(*locus).agg(
        F.min_by(
            F.struct(F.col(tie).alias("id"), F.col(position).alias("pos"), F.col(strength).alias("strength")),
            F.struct((-F.col(strength)).alias("a"), F.col(position).alias("b"), F.col(tie).alias("c")),
        ).alias("lead"),
        F.min(position).alias("start"),
        F.max(position).alias("end"),
        F.count(F.lit(1)).alias("n"),
    )


def locus_breaker(
    df: DataFrame,
    group: Sequence[str],
    *,
    position: str,
    strength: str,
    tie: str,
    baseline: float,
    gap: int = LBC_DISTANCE,
    threshold: float,
    flank: int = LBC_FLANK,
) -> DataFrame:
    """Blocks of neighbouring signals, broken where a gap exceeds ``gap``.

    Rows below the baseline strength are dropped. Two rows in one bin of width
    ``gap`` are never more than ``gap`` apart, so only the extent of each bin
    matters for the breaks: rows are first reduced to one row per bin on the map
    side, and the window runs over bins, of which a chromosome has few. A group
    with very many rows costs no more than any other.
    """
    group = list(group)
    lead = F.struct(
        (-F.col(strength)).alias("neg"), F.col(position).alias("pos"), F.col(tie).alias("id")
    )
    bins = (
        df.where(F.col(strength) >= F.lit(float(baseline)))
        .groupBy(*group, bin_of(F.col(position), gap).alias("__bin"))
        .agg(
            F.min(position).alias("__lo"),
            F.max(position).alias("__hi"),
            F.min(lead).alias("__lead"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    w = Window.partitionBy(*group).orderBy("__bin")
    starts = (F.col("__lo") - F.lag("__hi").over(w) > gap).cast("int")
    blocks = (
        bins.withColumn("__new", F.coalesce(starts, F.lit(0)))
        .withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "block")
        .agg(
            F.min("__lo").alias("first"),
            F.max("__hi").alias("last"),
            F.min("__lead").alias("__lead"),
            F.sum("__n").alias("n"),
        )
    )
    return blocks.where(-F.col("__lead.neg") >= F.lit(float(threshold))).select(
        *group,
        "block",
        (F.col("first") - flank).alias("start"),
        (F.col("last") + flank).alias("end"),
        "n",
        F.col("__lead.id").alias("lead_id"),
        F.col("__lead.pos").alias("lead_pos"),
        (-F.col("__lead.neg")).alias("lead_strength"),
    )


def _apart(signals: DataFrame, group: list[str], distance: int) -> DataFrame:
    """Occupied bins, and whether one is alone: a single signal with none less than ``distance`` away, which the row has."""
    w = Window.partitionBy(*group).orderBy("__bin")
    bins = signals.groupBy(*group, "__bin").agg(
        F.min("pos").alias("pos"), F.max("pos").alias("__hi"), F.min("neg").alias("neg"), F.min("id").alias("id"),
        F.count(F.lit(1)).alias("__n"),
    )
    before = F.coalesce(F.col("pos") - F.lag("__hi").over(w) >= distance, F.lit(True))
    after = F.coalesce(F.lead("pos").over(w) - F.col("__hi") >= distance, F.lit(True))
    return bins.withColumn("__alone", (F.col("__n") == 1) & before & after).select(*group, "__bin", "__alone", "pos", "neg", "id")


def _islands(best: DataFrame, group: list[str], distance: int) -> DataFrame:
    """Island number and size per occupied bin; islands lie at least ``distance`` apart."""
    w = Window.partitionBy(*group).orderBy("__bin")
    bins = best.groupBy(*group, "__bin").agg(
        F.min("pos").alias("__lo"), F.max("pos").alias("__hi"), F.count(F.lit(1)).alias("__n")
    )
    cut = F.coalesce((F.col("__lo") - F.lag("__hi").over(w) >= distance).cast("int"), F.lit(0))
    numbered = bins.withColumn("__cut", cut).withColumn(
        "__island", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    size = numbered.groupBy(*group, "__island").agg(F.sum("__n").alias("__size"))
    return null_safe_join(numbered, size, [*group, "__island"]).select(*group, "__bin", "__island", "__size")


def _fold_islands(rows: DataFrame, group: list[str], distance: int) -> DataFrame:
    """Greedy choice inside each island, strongest first, as a fold over a sorted array."""
    cell = F.struct("neg", "pos", "id")
    sorted_rows = rows.groupBy(*group, "__island").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    kind = sorted_rows.schema["cells"].dataType.simpleString()
    leads = F.aggregate(
        F.col("cells"),
        F.expr(f"cast(array() as {kind})"),
        lambda acc, x: F.when(
            F.exists(acc, lambda lead: F.abs(lead["pos"] - x["pos"]) < distance), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return sorted_rows.select(*group, F.explode(leads).alias("lead")).select(*group, "lead.*")


#: What a tile says of a row: a lead, claimed by one, or dependent on rows of another tile.
LEAD, CLAIMED, OPEN = range(3)


def _decide(positions: list[int], own: list[bool], leads: list[int], distance: int) -> list[int]:
    """State of each row of a tile and its borders, given strongest first.

    A lead claims what lies less than ``distance`` away. A row of another tile
    is open unless a known lead claims it; a row of this tile is open if a
    stronger open one is that near and no lead is.
    """
    leads, open_ = sorted(leads), []
    states = []

    def near(places: list[int], x: int) -> bool:
        i = bisect_right(places, x - distance)
        return i < len(places) and places[i] < x + distance

    for x, mine in zip(positions, own):
        if near(leads, x):
            states.append(CLAIMED)
        elif not mine or near(open_, x):
            states.append(OPEN)
            insort(open_, x)
        else:
            states.append(LEAD)
            insort(leads, x)
    return states


def _clump_in_tiles(rows: DataFrame, group: list[str], distance: int, tile_rows: int) -> DataFrame:
    """Greedy choice for islands of any size, tile by tile.

    Neighbouring bins make a tile of about ``tile_rows`` rows, which is folded
    together with the rows one bin beyond it. What depends on open rows of
    another tile stays open and meets the leads found so far in the next round,
    so that only chains over many tiles take many rounds. The outcome equals
    choosing one after the other.
    """
    ship_package(rows.sparkSession)
    columns = [*group, "neg", "pos", "id", "__bin"]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", __state int"
    open_, leads = rows.select(*columns), None
    while True:
        tiled = _tiles(open_, group, tile_rows)
        shown = null_safe_join(open_, tiled, [*group, "__bin"]).select(*columns, "__tile", "__near", F.lit(False).alias("__lead"))
        if leads is not None:
            around = F.explode(F.array(*[F.col("__bin") + k for k in (-1, 0, 1)])).alias("__bin")
            places = tiled.select(*group, "__bin", "__tile")
            met = null_safe_join(leads.select(*group, "neg", "pos", "id", around), places, [*group, "__bin"])
            met = met.select(*columns, F.lit(-1).cast("long").alias("__tile"), F.array("__tile").alias("__near"), F.lit(True).alias("__lead"))
            shown = shown.unionByName(met)
        shown = shown.withColumn("__in", F.explode("__near"))

        def fold(tile: pd.DataFrame) -> pd.DataFrame:
            known = tile["__lead"].to_numpy()
            part = tile[~known].sort_values(["neg", "pos"])
            own = (part["__tile"] == part["__in"]).tolist()
            found = sorted(set(tile["pos"][known].tolist()))
            part = part.assign(__state=_decide(part["pos"].tolist(), own, found, distance))
            return part[own][[*columns, "__state"]]

        decided = cut_lineage(shown.groupBy(*group, "__in").applyInPandas(fold, schema))
        found = decided.where(F.col("__state") == LEAD).select(*columns)
        leads = found if leads is None else leads.unionByName(found)
        open_ = decided.where(F.col("__state") == OPEN).select(*columns)
        if open_.isEmpty():
            return leads.select(*group, "neg", "pos", "id")


def _tiles(rows: DataFrame, group: list[str], tile_rows: int) -> DataFrame:
    """Tile of each occupied bin, and the tiles that its rows are shown to: its own and those of the bins beside it."""
    w = Window.partitionBy(*group).orderBy("__bin")
    bins = rows.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    bins = bins.withColumn("__tile", F.floor(before / tile_rows))
    beside = [
        F.when(F.abs(move("__bin").over(w) - F.col("__bin")) == 1, move("__tile").over(w)) for move in (F.lag, F.lead)
    ]
    return cut_lineage(bins.withColumn("__near", F.array_distinct(F.array_compact(F.array("__tile", *beside)))).drop("__n"))


def window_clump(
    df: DataFrame,
    group: Sequence[str],
    *,
    position: str,
    strength: str,
    tie: str,
    distance: int = CLUMP_DISTANCE,
    threshold: float,
    fold_positions: int = FOLD_POSITIONS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Leads: the strongest signal of a group claims all positions less than
    ``distance`` away, and so on with what is left. Equal signals go by position,
    then id.

    A signal alone in its bin of width ``distance``, with no other bin's signals
    in reach, is a lead and needs no comparison. Of the others, a position is
    first reduced to its strongest row, since the rest can never lead; the group
    falls into islands that cannot reach each other; small islands are folded in
    one pass and larger ones solved in tiles, all exact.
    """
    group = list(group)
    signals = df.where((F.col(strength) >= F.lit(float(threshold))) & F.col(position).isNotNull()).select(
        *group, F.col(position).cast("bigint").alias("pos"), (-F.col(strength)).alias("neg"), F.col(tie).alias("id")
    )
    if not only_scans(signals):
        signals = cut_lineage(signals)
    signals = signals.withColumn("__bin", bin_of(F.col("pos"), distance))
    bins = stored(_apart(signals, group, distance), "bins")
    alone = bins.where("__alone").select(*group, "neg", "pos", "id")
    crowded = bins.where("NOT __alone").select(*group, "__bin")
    best = cut_lineage(
        null_safe_join(signals, crowded, ["__bin", *group])
        .groupBy(*group, "__bin", "pos")
        .agg(F.min(F.struct("neg", "id")).alias("__b"))
        .select(*group, "__bin", "pos", "__b.*")
    )
    islands = cut_lineage(_islands(best, group, distance))
    placed = null_safe_join(best, islands, [*group, "__bin"])
    leads = alone
    if not islands.where(F.col("__size") <= fold_positions).isEmpty():
        leads = leads.unionByName(_fold_islands(placed.where(F.col("__size") <= fold_positions), group, distance))
    if not islands.where(F.col("__size") > fold_positions).isEmpty():
        large = placed.where(F.col("__size") > fold_positions)
        leads = leads.unionByName(_clump_in_tiles(large, group, distance, tile_rows))
    return leads.select(
        *group, F.col("id").alias("lead_id"), F.col("pos").alias("lead_pos"), (-F.col("neg")).alias("lead_strength")
    )


def split_large_loci(
    loci: DataFrame,
    stats: DataFrame,
    group: Sequence[str],
    *,
    position: str,
    strength: str,
    tie: str,
    threshold: float,
    large: int = LARGE_LOCUS,
    distance: int = CLUMP_DISTANCE,
) -> DataFrame:
    """Replace loci wider than ``large`` by window-clumped leads with their own windows."""
    group = list(group)
    width = F.col("end") - F.col("start")
    keep = loci.where(width <= large).select(*group, "start", "end", "lead_id", "lead_pos", "lead_strength")
    wide = loci.where(width > large).select(*group, "block", "start", "end")
    inside = join_points_to_intervals(
        stats.select(*group, position, strength, tie),
        wide,
        by=group,
        point=position,
        start="start",
        end="end",
        width=large,
    )
    leads = window_clump(
        inside,
        [*group, "block"],
        position=position,
        strength=strength,
        tie=tie,
        distance=distance,
        threshold=threshold,
    )
    half = distance // 2
    split = leads.select(
        *group,
        (F.col("lead_pos") - half).alias("start"),
        (F.col("lead_pos") + half).alias("end"),
        "lead_id",
        "lead_pos",
        "lead_strength",
    )
    return keep.unionByName(split)


def expand_ld(ld: DataFrame, a: str, b: str, r: str, population: str | None = None) -> DataFrame:
    """Both directions of pairs that are stored once, from a single read."""
    extra = [population] if population else []
    forward = F.struct(F.col(a).alias("variant"), F.col(b).alias("tag"))
    backward = F.struct(F.col(b).alias("variant"), F.col(a).alias("tag"))
    ways = F.array_compact(F.array(forward, F.when(F.col(a) != F.col(b), backward)))
    return ld.select(F.explode(ways).alias("__way"), F.col(r).alias("r"), *extra).select(
        "__way.variant", "__way.tag", "r", *extra
    )


def ld_join(loci: DataFrame, ld: DataFrame, *, variant: str, population: str | None = None, min_r2: float = 0.0) -> DataFrame:
    """LD partners of each lead, by variant and population.

    Pairs below the r2 limit are dropped before the shuffle.
    """
    on = ["variant"] + ([population] if population else [])
    strong = ld.where(F.col("r") * F.col("r") >= min_r2)
    return loci.withColumn("variant", F.col(variant)).join(strong, on).withColumn(
        "r2", F.col("r") * F.col("r")
    )


def _sketch_bit(study: Column) -> tuple[Column, Column]:
    """Word and bit of a study in a sketch."""
    code = F.xxhash64(study)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), code.bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.shiftrightunsigned(code, 6), F.lit(SKETCH_WORDS)), bit


def _study_sketch(leads: DataFrame, study: str, variant: str) -> DataFrame:
    """Per variant a bit for each study it leads in, by a hash of the study."""
    word, bit = _sketch_bit(F.col(study))
    none = F.lit(0).cast("bigint")
    rows = leads.select(F.col(variant).alias("__led"), word.alias("__word"), bit.alias("__bit"))
    return rows.groupBy("__led").agg(
        *[F.bit_or(F.when(F.col("__word") == k, F.col("__bit")).otherwise(none)).alias(f"__w{k}") for k in range(SKETCH_WORDS)]
    )


def _sketched(study: Column) -> Column:
    """Whether the sketch has the study's bit, as it has for each of its studies and few others."""
    word, bit = _sketch_bit(study)
    held = F.lit(False)
    for k in range(SKETCH_WORDS):
        held = held | ((word == k) & (F.col(f"__w{k}").bitwiseAND(bit) != 0))
    return held


def ld_clump(
    leads: DataFrame,
    ld: DataFrame,
    *,
    study: str,
    variant: str,
    strength: str,
    min_r2: float = 0.5,
    population: str | None = None,
    out: str = "ld_clumped",
) -> DataFrame:
    """Flag leads that a stronger lead of the same study explains through LD.

    Any stronger lead counts, flagged itself or not: unlike a greedy fold, the
    flag of a lead does not depend on those of others, so one pass decides it.

    One row per (study, variant) is expected. Stronger leads are expanded to
    their partners and met again on (study, variant): no pairs of leads arise
    other than those linked by LD. A pair carries a sketch of the studies that
    its tag leads in, so that most partners which are no leads of the study
    stay out of the shuffle; the join behind it is exact.
    """
    sketched = ld.where(F.col("r") * F.col("r") >= min_r2).join(
        _study_sketch(leads, study, variant), F.col("tag") == F.col("__led")
    )
    linked = ld_join(leads, sketched, variant=variant, population=population, min_r2=min_r2)
    reach = linked.where(_sketched(F.col(study))).select(
        F.col(study).alias("__study"),
        F.col("tag").alias("__tag"),
        F.struct(F.col(strength).alias("s"), (F.col(variant)).alias("v")).alias("__by"),
    )
    # dealt first: an aggregate before the shuffle would sort all partners of a task's leads and merge few
    # the strongest explaining lead per (study, tag) decides; ties go to the smaller variant
    best = reach.repartition("__study", "__tag").groupBy("__study", "__tag").agg(
        F.min(F.struct((-F.col("__by.s")).alias("neg"), F.col("__by.v").alias("v"))).alias("__best")
    )
    own = F.struct((-F.col(strength)).alias("neg"), F.col(variant).alias("v"))
    return (
        leads.join(best, (F.col(study) == F.col("__study")) & (F.col(variant) == F.col("__tag")), "left")
        .withColumn(out, F.coalesce(F.col("__best") < own, F.lit(False)))
        .drop("__study", "__tag", "__best")
    )


def explained_by(
    loci: DataFrame,
    better: DataFrame | Mapping[str, DataFrame],
    *,
    locus: str | Sequence[str],
    by: Sequence[str],
    start: str,
    end: str,
    width: float,
    out: str = "explained",
    asked: Mapping[str, Column] | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Flag loci that overlap a locus of a better method in the same study.

    Several methods, by the name of their flag, are looked up in one join;
    ``asked`` says which loci a flag is wanted for. ``places`` may have the same
    loci where that frame takes less to compute.
    """
    return mark_overlapping(
        loci, better, key=locus, by=by, start=start, end=end, width=width, out=out, asked=asked, places=places
    )
