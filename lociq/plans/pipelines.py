"""The germline and the somatic analysis as graphs of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators import genotype, learning, matrix, panel, reads, spatial, transitions
from lociq.scratch import stored
from lociq.sources import sinks


@dataclass
class Inputs:
    """Tables of one section. ``phased`` has an ``ord`` column; pools and the panel may be absent."""

    variants: DataFrame
    phased: DataFrame
    reads: DataFrame
    spots: DataFrame
    known: DataFrame | None = None
    exclude: DataFrame | None = None
    include: DataFrame | None = None
    kept: DataFrame | None = None
    missing: DataFrame | None = None


def call(inputs: Inputs, min_depth: int = 0, min_gq: int = 8, min_qual: float = 0.0) -> DataFrame:
    return genotype.called(genotype.snv_sites(inputs.variants), min_depth, min_gq, min_qual)


def germline(inputs: Inputs, spot_diameter: float | None = None, min_neighbours: int = 2, model: str = "forest", training_rows: int = 90_000, confidence: float = 0.5, class_folder: str | None = None) -> dict[str, DataFrame]:
    """Calls, the panel split, the error model, classes of uncertain calls, reads credited with variants, the
    neighbour filter and the matrix. Shared intermediate tables are written once. With ``class_folder`` the classified variants are
    also written there, a VCF for each class."""
    calls = stored(call(inputs), "calls")
    split = panel.with_origin(calls, inputs.known) if inputs.known is not None else calls.withColumn("origin", F.lit("denovo"))
    changes = stored(transitions.transitions(calls, inputs.phased), "transitions")
    learned = transitions.thresholds(changes)
    judged = stored(transitions.error_status(split.filter("origin = 'denovo'"), learned), "judged")
    labelled = learning.training_sets(changes, judged.filter("status = 'error'"))
    training = learning.filled_with_zero(learning.features(learning.sampled(labelled, training_rows).join(calls, ["chrom", "pos", "ref", "alt"])))
    fitted = learning.train(training, model)
    unsure = learning.filled_with_mean(learning.features(judged.filter("status IN ('no_error', 'missing')")))
    classes = stored(learning.classified(fitted, unsure), "classes")
    if class_folder:
        sinks.write_classes(classes, class_folder, model.upper(), confidence)
    sure = learning.confident(classes, confidence).filter("predicted IN ('homozygous', 'heterozygous')")
    pool = panel.pool([("defined", panel.valid_genotypes(split.filter("origin = 'defined'"))), ("denovo", panel.valid_genotypes(sure))])
    return {"calls": calls, "transitions": changes, "thresholds": learned, "judged": judged, "classes": classes, "pool": pool} | _spots(inputs, pool, spot_diameter, min_neighbours)


def somatic(inputs: Inputs, spot_diameter: float | None = None, min_neighbours: int = 2) -> dict[str, DataFrame]:
    """Without classifier: calls and what phasing confirmed form the pool."""
    calls = stored(call(inputs), "calls")
    split = panel.with_origin(calls, inputs.known) if inputs.known is not None else calls.withColumn("origin", F.lit("denovo"))
    pool = panel.pool([(o, panel.valid_genotypes(split.filter(F.col("origin") == o))) for o in ("defined", "denovo")])
    return {"calls": calls, "pool": pool} | _spots(inputs, pool, spot_diameter, min_neighbours)


def _spots(inputs: Inputs, pool: DataFrame, spot_diameter: float | None, min_neighbours: int) -> dict[str, DataFrame]:
    spots = stored(spatial.in_tissue(inputs.spots, inputs.missing), "spots")
    ordered = pool.withColumn("ord", F.concat("ref", "alt"))
    found = stored(reads.detected(reads.first_overlaps(inputs.reads.join(spots.select("barcode"), "barcode", "left_semi"), ordered), ordered), "detected")
    edges = stored(spatial.graph(spots, spatial.radius(spot_diameter)), "edges")
    pairs = found.select("barcode", "chrom", "pos")
    if inputs.exclude is not None:
        pairs = spatial.excluded(pairs, spatial.pool_positions(inputs.exclude))
    if inputs.include is not None:
        pairs = spatial.included(pairs, spatial.pool_positions(inputs.include))
    kept = spatial.pool_positions(inputs.kept, allow_multiallelic=True) if inputs.kept is not None else None
    after = stored(spatial.supported(pairs, edges, spots, min_neighbours, kept), "supported")
    count = spatial.counts(spots, pairs, after)
    return {"detected": found, "edges": edges, "supported": after, "counts": count, "matrix": matrix.long(after)}
