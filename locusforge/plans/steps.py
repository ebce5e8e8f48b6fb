"""Release steps: compositions of operators, lazy from frame to frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.functions.paths import partition_key, study_id
from locusforge.operators import annotate, evidence, intervals, loci, manifests, posteriors, validation, variants
from locusforge.operators.scale import nest_rows, null_safe_join
from locusforge.session import shuffles_removed, stored


def manifest_run(files: DataFrame, manifest_files: DataFrame, common_path: str, path: str = "path") -> DataFrame:
    """Listing of raw files to pending manifests of the studies without one.

    Several files of a study are allowed; the last path in order is taken.
    """
    raw = files.select(study_id(F.col(path)).alias("studyId"), F.col(path).alias("rawPath"))
    known = manifest_files.select(study_id(F.col(path)).alias("studyId"))
    latest = manifests.last_per_key(raw, "studyId", "rawPath", [F.col("rawPath")], "rawPath")
    return manifests.make_manifest_rows(manifests.new_studies(latest, known, "studyId"), common_path)


def finemapping_manifests(
    files: DataFrame, input_path: str, output_path: str, log_path: str, max_rows: int = variants.LOCUS_CHUNK,
    path: str = "path",
) -> DataFrame:
    """Listing of a dataset partitioned by locus to numbered manifest rows.

    A partition of several files counts once; paths without a partition are left out.
    """
    keys = files.select(partition_key(F.col(path), on_error="null").alias("key")).where(F.col("key").isNotNull())
    rows = manifests.locus_rows(keys, "key", input_path, output_path, log_path)
    chunked = variants.chunk_rows(rows, [F.col("study_locus_input")], max_rows)
    return variants.index_in_chunk(chunked, max_rows).drop("row")


def annotate_variants(
    rows: DataFrame,
    genes: DataFrame,
    *,
    variant: str,
    by: Sequence[str],
    position: str,
    gene: str,
    site: str,
    curated: str,
    canonical: str,
    distance: int = 500_000,
) -> DataFrame:
    """Genes within reach of each variant, one consequence per gene, collected per variant.

    Variants without a gene nearby are kept.
    """
    near = intervals.gene_distance(rows, genes, by=by, position=position, site=site, distance=distance)
    picked = annotate.pick_consequence(
        near.select(variant, gene, curated, canonical, "distance", site), [variant, gene], curated, canonical,
        ["distance", site],
    )
    nested = nest_rows(picked, [variant], F.struct(gene, "distance"), "genes")
    return rows.join(nested, variant, "left")


def summary_statistics_to_credible_sets(
    stats: DataFrame,
    ld: DataFrame,
    *,
    study: str,
    variant: str,
    position: str,
    strength: str,
    threshold: float,
    distance: int = loci.CLUMP_DISTANCE,
    clump_r2: float = 0.5,
    tag_r2: float = 0.5,
    mass: float = posteriors.CREDIBLE_MASS,
    chromosome: Sequence[str] = (),
) -> DataFrame:
    """Window clumping, LD clumping, probabilities from LD, credible sets."""
    leads = loci.window_clump(
        stats, [study, *chromosome], position=position, strength=strength, tie=variant, distance=distance,
        threshold=threshold,
    )
    kept = loci.ld_clump(
        leads, ld, study=study, variant="lead_id", strength="lead_strength", min_r2=clump_r2
    ).where(~F.col("ld_clumped"))
    tags = (
        loci.ld_join(kept, ld, variant="lead_id", min_r2=tag_r2)
        .groupBy(study, "lead_id", "tag")
        .agg(F.max("r2").alias("r2"), F.max("lead_strength").alias("lead_strength"))
    )
    locus = [study, "lead_id"]
    return posteriors.credible_set(
        posteriors.pics(tags, locus, lead_strength="lead_strength", r2="r2", min_r2=tag_r2), locus, pip="pip",
        tie="tag", mass=mass,
    )


def locus_breaker_step(
    stats: DataFrame,
    group: Sequence[str],
    *,
    position: str,
    strength: str,
    tie: str,
    baseline: float,
    threshold: float,
    gap: int = loci.LBC_DISTANCE,
    flank: int = loci.LBC_FLANK,
    large: int = loci.LARGE_LOCUS,
    distance: int = loci.CLUMP_DISTANCE,
    excluded: tuple | None = None,
) -> DataFrame:
    """Locus breaker, wide loci split by window clumping, leads of an excluded region dropped."""
    signals = loci.pvalue_filter(stats, strength, baseline)
    found = loci.locus_breaker(
        signals, group, position=position, strength=strength, tie=tie, baseline=baseline, gap=gap,
        threshold=threshold, flank=flank,
    )
    split = loci.split_large_loci(
        found, signals, group, position=position, strength=strength, tie=tie, threshold=threshold, large=large,
        distance=distance,
    )
    return intervals.exclude_region(split, "lead_pos", *excluded) if excluded else split


def colocalisation(overlaps: DataFrame, rows: DataFrame, *, locus: str, log_bf: str) -> DataFrame:
    """Both methods from one aggregate of the overlaps, told apart by a method column.

    ``rows`` holds all variants of the loci. Columns of the other method are null.
    """
    both = posteriors.coloc(overlaps, rows, locus=locus, log_bf=log_bf, pips=("left_pip", "right_pip"))
    methods = both.withColumn("method", F.explode(F.array(F.lit("eCAVIAR"), F.lit("COLOC"))))
    own = {"clpp": "eCAVIAR", **{f"h{i}": "COLOC" for i in range(5)}}
    return methods.withColumns({c: F.when(F.col("method") == m, F.col(c)) for c, m in own.items()})


def credible_set_validation(
    sets: DataFrame,
    studies: DataFrame,
    known: DataFrame,
    ld: DataFrame,
    *,
    locus: str,
    study: str,
    variant: str,
    chromosome: str,
    position: str,
    start: str,
    end: str,
    ref: str,
    alt: str,
    strength: str,
    method: str,
    composite: Column,
    failed: Column,
    threshold: float,
    mhc: tuple,
    width: float,
    distance: int = loci.CLUMP_DISTANCE,
    min_r2: float = 0.5,
    susie: str = "SuSiE",
    statistics: str = "PICS",
    top_hits: str = "PICS top hit",
    invalid: Sequence[str] = validation.CREDIBLE_SET_REASONS,
) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid credible sets with their reasons, all fifteen of them.

    ``studies`` may list a study more than once (ambiguous) and marks those that
    ``failed`` their own validation. ``known`` has one row per variant with its
    alleles, to which those of the set are held. A lead is LD clumped by a
    stronger one of its study, window clumped if it is significant but leads no
    window. A set of another method that overlaps a ``susie`` one of its study
    is explained by it; one of ``top_hits`` is redundant beside one of
    ``statistics``. A rule whose columns are null does not hold.
    """
    spark = sets.sparkSession
    # the sets are numbered and written: what is found out in narrow rows, step by step, meets them by number at the end
    rows = stored(sets.withColumn("__row", F.monotonically_increasing_id()), "sets")
    located = F.col(chromosome).isNotNull() & F.col(position).isNotNull()
    with shuffles_removed(spark):
        windows = loci.window_clump(
            rows.where(located), [study, chromosome], position=position, strength=strength, tie=variant,
            distance=distance, threshold=threshold,
        )
    windows = windows.groupBy(F.col(study).alias("__s"), F.col("lead_id").alias("__v")).agg(
        F.collect_set(chromosome).alias("__led")
    )
    index = studies.groupBy(F.col(study).alias("__study")).agg(
        (F.count(F.lit(1)) > 1).alias("__ambiguous"), F.bool_or(failed).alias("__failed")
    )
    leads = stored(rows.groupBy(study, variant).agg(F.max(strength).alias(strength)), "leads")
    facts = loci.ld_clump(
        leads, ld, study=study, variant=variant, strength=strength, min_r2=min_r2, out="__clumped"
    ).drop(strength)
    facts = facts.join(windows, (F.col(study) == F.col("__s")) & (F.col(variant) == F.col("__v")), "left").drop("__s", "__v")
    alleles = known.select(variant, F.col(ref).alias("__ref"), F.col(alt).alias("__alt"))
    facts = annotate.map_to_variants(facts, alleles, {variant: variant}, ["__ref", "__alt"], "__unmapped")
    facts = facts.join(index, F.col(study) == F.col("__study"), "left")
    facts = stored(facts.withColumn("__missing", F.col(study).isNotNull() & F.col("__study").isNull()).drop("__study"), "facts")
    own = {
        "__unlocated": ~located,
        "__composite": composite,
        "__weak": F.col(strength) < threshold,
        "__in_mhc": (F.col(chromosome) == mhc[0]) & F.col(position).between(mhc[1], mhc[2]),
        "__significant": located & (F.col(strength) >= threshold),
    }
    told = rows.select("__row", *dict.fromkeys([study, variant, chromosome, ref, alt]), *[c.alias(n) for n, c in own.items()])
    first = {
        "AMBIGUOUS_STUDY": F.col("__ambiguous"),
        "FAILED_STUDY": F.col("__failed"),
        "MISSING_STUDY": F.col("__missing"),
        "NO_GENOMIC_LOCATION_FLAG": F.col("__unlocated"),
        "COMPOSITE_FLAG": F.col("__composite"),
        "INCONSISTENCY_FLAG": (F.col(ref) != F.col("__ref")) | (F.col(alt) != F.col("__alt")),
        "PALINDROMIC_ALLELE_FLAG": validation.palindromic(F.col(ref), F.col(alt)),
        "SUBSIGNIFICANT_FLAG": F.col("__weak"),
        "LD_CLUMPED": F.col("__clumped"),
        "IN_MHC": F.col("__in_mhc"),
    }
    led = F.coalesce(F.array_contains("__led", F.col(chromosome)), F.lit(False))
    last = {
        "WINDOW_CLUMPED": F.col("__significant") & ~led,
        "NON_MAPPED_VARIANT_FLAG": F.col("__unmapped"),
    }
    found = validation.qc_flags(null_safe_join(told, facts, [variant, study]), first, "__first")
    found = stored(validation.qc_flags(found, last, "__last").select("__row", "__first", "__last"), "found")
    repeated = manifests.duplicate_flag(rows.select("__row", locus), [locus], "__repeated").where("__repeated")
    repeated = stored(repeated.select("__row", "__repeated"), "repeated")
    places = rows.select(*dict.fromkeys(["__row", start, end, study, method]))
    explained = loci.explained_by(
        places,
        {"__susie": places.where(F.col(method) == susie), "__statistics": places.where(F.col(method) == statistics)},
        locus=[start, end, study], by=[study], start=start, end=end, width=width,
        asked={"__susie": F.col(method) != susie, "__statistics": F.col(method) == top_hits},
    ).where("__susie OR __statistics")
    explained = stored(explained.select("__row", "__susie", "__statistics"), "explained")
    rows = rows.join(found, "__row").join(repeated, "__row", "left").join(explained, "__row", "left")
    rows = validation.qc_flags(rows, {"DUPLICATED_STUDYLOCUS_ID": F.col("__repeated")}, "__before")
    overlaps = {"REDUNDANT_PICS_TOP_HIT": F.col("__statistics"), "EXPLAINED_BY_SUSIE": F.col("__susie")}
    flagged = validation.qc_flags(rows, overlaps)
    flagged = flagged.withColumn("qualityControls", F.concat("__before", "__first", "qualityControls", "__last"))
    return validation.split_valid(flagged.select(*sets.columns, "qualityControls"), invalid)


def ld_index(
    entries: DataFrame,
    variants_index: DataFrame,
    chain: DataFrame,
    *,
    row: str,
    column: str,
    r: str,
    population: str,
    index: str,
    by: Sequence[str],
    position: str,
    ref: str,
    alt: str,
    start: str,
    end: str,
    offset: str,
    width: float,
    min_r2: float = 0.0,
) -> DataFrame:
    """Matrix entries of the listed populations to partner arrays on the new assembly.

    Variants whose position has no counterpart there are left out.
    """
    lifted = intervals.lift_coordinates(
        variants_index, chain, by=by, position=position, start=start, end=end, offset=offset, width=width, out="__new"
    ).where(F.col("__new").isNotNull())
    ids = lifted.select(index, F.concat_ws("_", *by, "__new", ref, alt).alias("variantId"))
    return annotate.ld_index_build(
        entries, ids, row=row, column=column, r=r, population=population, index=index, variant_id="variantId",
        min_r2=min_r2,
    )


def catalog_study_index(
    studies: DataFrame, ancestries: DataFrame, included: DataFrame | None, key: str, item: Column
) -> DataFrame:
    """Catalogue studies on the inclusion list with their ancestries collected."""
    kept = manifests.inclusion_join(studies, included, key, key) if included is not None else studies
    return annotate.study_ancestry_join(kept, ancestries, key, item)


def catalog_top_hits(
    associations: DataFrame, known: DataFrame, on: dict[str, str], columns: Sequence[str], strength: str, threshold: float
) -> DataFrame:
    """Curated associations as loci, with reasons where a variant is unknown or the signal weak."""
    mapped = annotate.map_to_variants(associations, known, on, columns)
    rules = {"NON_MAPPED_VARIANT_FLAG": F.col("non_mapped"), "SUBSIGNIFICANT_FLAG": F.col(strength) < threshold}
    return validation.qc_flags(mapped, rules).drop("non_mapped")


def molecular_credible_sets(
    snps: DataFrame,
    summary: DataFrame,
    blacklist: DataFrame,
    *,
    on: Sequence[str],
    study: Column,
    method: str,
    listed: str,
    lead_strength: str,
    threshold: float,
) -> DataFrame:
    """Members of the sets whose lead passes, without blacklisted quantification methods."""
    kept = loci.blacklist_filter(summary, blacklist, method, listed)
    return annotate.ingest_study_locus(
        snps, kept, on=on, study=study, lead_strength=lead_strength, threshold=threshold, method="SuSie"
    )


def evidence_release(
    sources: dict[str, DataFrame],
    partner_sources: dict[str, DataFrame],
    *,
    partner: bool,
    excluded: Sequence[str],
    id_columns: Sequence[str],
    order: Sequence[Column],
    targets: DataFrame,
    target: str,
    diseases: DataFrame,
    disease: str,
) -> tuple[DataFrame, DataFrame]:
    """Evidence of all sources, each once, split by whether target and disease are known.

    The partner mode adds the partner sources and excludes none.
    """
    chosen = {**sources, **partner_sources} if partner else sources
    rows = evidence.evidence_union(chosen, id_columns, order)
    rows = manifests.exclude_sources(rows, "datasourceId", [] if partner else excluded)
    rows = validation.resolve(rows, targets, target, target, "__no_target")
    rows = validation.resolve(rows, diseases, disease, disease, "__no_disease")
    flagged = validation.qc_flags(
        rows, {"UNRESOLVED_TARGET": F.col("__no_target"), "UNRESOLVED_DISEASE": F.col("__no_disease")}
    ).drop("__no_target", "__no_disease")
    return validation.split_valid(flagged, ["UNRESOLVED_TARGET", "UNRESOLVED_DISEASE"])


def associations(
    rows: DataFrame, closure: DataFrame, *, target: str, disease: str, source: str, score: str
) -> DataFrame:
    """Direct associations, and indirect ones in which evidence counts for ancestors too."""
    direct = evidence.harmonic_association(rows, [target, disease], source, score)
    indirect = evidence.harmonic_association(
        evidence.propagate(rows, closure, disease), [target, disease], source, score
    )
    return direct.withColumn("kind", F.lit("direct")).unionByName(indirect.withColumn("kind", F.lit("indirect")))
