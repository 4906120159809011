"""Spots, their neighbour graph, and filters of variants by neighbour support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions import fields

NEIGHBOURS = 12
DIAMETERS = 6


def in_tissue(spots: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Spots flagged in tissue (a null flag counts as in) and not listed in ``missing`` (barcode)."""
    rows = spots.filter(F.coalesce("in_tissue", F.lit(1)) == 1)
    return rows.join(missing.select("barcode"), "barcode", "left_anti") if missing is not None else rows


def radius(spot_diameter: float | None, neighbour_distance: float = 1.5) -> float:
    """Largest distance of neighbours: ``neighbour_distance`` times six spot diameters (100 if unknown)."""
    return neighbour_distance * (100.0 if spot_diameter is None else spot_diameter) * DIAMETERS


def graph(spots: DataFrame, within: float, most: int = NEIGHBOURS) -> DataFrame:
    """Directed edges (src, dst, dist2): for each spot its ``most`` nearest others at squared distance up to
    ``within`` squared, ties to the smaller barcode.

    Spots are put in cells as wide as the radius; each meets the nine cells around it, an equi-join. Ranking what
    lies within the radius equals taking nearest neighbours first and cutting by radius after.
    """
    cell = lambda c: F.floor(F.col(c) / within)
    here = spots.select(F.col("barcode").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = spots.select(F.col("barcode").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("ax"), cell("y").alias("ay"))
    step = lambda: F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    around = around.withColumn("dx", step()).withColumn("dy", step()).select("dst", "x1", "y1", (F.col("ax") + F.col("dx")).alias("cx"), (F.col("ay") + F.col("dy")).alias("cy"))
    dx, dy = F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")
    near = here.join(around, ["cx", "cy"]).filter("src <> dst").withColumn("dist2", dx * dx + dy * dy).filter(F.col("dist2") <= within * within)
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist2", "dst"))
    return near.withColumn("place", place).filter(F.col("place") <= most).select("src", "dst", "dist2")


def degrees(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of every spot, 0 included."""
    count = edges.groupBy(F.col("src").alias("barcode")).agg(F.count("*").alias("degree"))
    return spots.select("barcode").join(count, "barcode", "left").select("barcode", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(degree: DataFrame) -> DataFrame:
    return degree.agg(F.avg("degree").alias("mean"), F.min("degree").alias("min"), F.max("degree").alias("max"))


def pool_positions(variants: DataFrame, allow_multiallelic: bool = False) -> DataFrame:
    """Distinct (chrom, pos) of a pool, bare chromosomes. Rows with several alternative alleles are skipped for
    exclude and include pools and honoured for kept ones (``allow_multiallelic``)."""
    rows = variants if allow_multiallelic else variants.filter(~F.col("alt").contains(","))
    return rows.select(fields.bare_chrom(F.col("chrom")).alias("chrom"), "pos").distinct()


def excluded(spot_snvs: DataFrame, pool: DataFrame) -> DataFrame:
    return spot_snvs.join(pool, ["chrom", "pos"], "left_anti")


def included(spot_snvs: DataFrame, pool: DataFrame) -> DataFrame:
    return spot_snvs.join(pool, ["chrom", "pos"], "left_semi")


def support(spot_snvs: DataFrame, edges: DataFrame) -> DataFrame:
    """(barcode, chrom, pos, support): how many neighbours of the spot have the variant too, 0 included.

    A spot has at most twelve neighbours, so a spot's variants reach at most the spots that point at it; the counting
    join is on (barcode, chrom, pos), which spreads a variant that all spots share.
    """
    rows = spot_snvs.select("barcode", "chrom", "pos").distinct()
    sent = rows.join(edges.select(F.col("dst").alias("barcode"), F.col("src").alias("to")), "barcode").groupBy(F.col("to").alias("barcode"), "chrom", "pos").agg(F.count("*").alias("support"))
    return rows.join(sent, ["barcode", "chrom", "pos"], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def supported(spot_snvs: DataFrame, edges: DataFrame, spots: DataFrame, min_neighbours: int = 2, kept: DataFrame | None = None) -> DataFrame:
    """Pairs whose position is in ``kept``, or whose spot has at least ``min_neighbours`` neighbours with the variant.
    Support is counted once, on the unfiltered pairs. Spots without a position are left out; 0 keeps everything."""
    rows = support(spot_snvs.join(spots.select("barcode"), "barcode", "left_semi"), edges)
    enough = F.col("support") >= min_neighbours
    if kept is not None:
        rows = rows.join(kept.select("chrom", "pos").distinct().withColumn("is_kept", F.lit(True)), ["chrom", "pos"], "left")
        enough = enough | F.coalesce("is_kept", F.lit(False))
    return rows.filter(enough).select("barcode", "chrom", "pos")


def counts(spots: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Variants of every spot before and after the filter, 0 included."""
    both = before.select("barcode", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("barcode", F.lit(0).alias("b"), F.lit(1).alias("a")))
    found = both.groupBy("barcode").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    return spots.select("barcode").join(found, "barcode", "left").na.fill(0, ["n_before", "n_after"])


def map_summary(count: DataFrame) -> DataFrame:
    """Of a count map: spots, spots with any, sum, maximum and mean after the filter."""
    return count.agg(F.count("*").alias("n_spots"), F.count_if(F.col("n_after") > 0).alias("n_nonzero"), F.sum("n_after").alias("total"), F.max("n_after").alias("max"), F.avg("n_after").alias("mean"))


def filter_statistics(count: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: spots, spots with variants, distinct variants before and after, removed percentage, mean and most kept
    per spot with any."""
    union = lambda t, name: t.agg(F.count_distinct("chrom", "pos").alias(name))
    spots = count.agg(F.count("*").alias("n_spots"), F.count_if(F.col("n_before") > 0).alias("spots_before"), F.count_if(F.col("n_after") > 0).alias("spots_after"), F.coalesce(F.max("n_after"), F.lit(0)).alias("max_kept"), F.sum("n_after").alias("kept_pairs"))
    # Three tables of one row each.
    out = spots.join(F.broadcast(union(before, "snvs_before"))).join(F.broadcast(union(after, "snvs_after")))
    removed = 100 * F.try_divide((F.col("snvs_before") - F.col("snvs_after")).cast("double"), F.col("snvs_before").cast("double"))
    return out.withColumn("removed_pct", F.coalesce(removed, F.lit(0.0))).withColumn("mean_kept", F.coalesce(F.try_divide(F.col("kept_pairs").cast("double"), F.col("spots_after").cast("double")), F.lit(0.0)))


def plot_coordinates(spots: DataFrame, scale: float) -> DataFrame:
    """Image coordinates: scaled, with the axes swapped."""
    return spots.select("barcode", (F.col("y") * scale).alias("x_plot"), (F.col("x") * scale).alias("y_plot"))


def distance(edges: DataFrame) -> DataFrame:
    return edges.withColumn("dist", F.sqrt("dist2"))
